"""Identity checks: manifests, approved pairs of oracles, audit documents, scope of policy files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of a manifest row that must not be blank, what its sources may be, and the document format. Fixed values.
REQUIRED = (
    "record_id", "source", "source_url", "base_revision", "candidate_revision", "base_commit", "candidate_commit", "base_blob_sha1", "candidate_blob_sha1",
    "source_license", "source_path", "family_id", "contract_id", "old_version", "new_version", "policy_pack", "mutation_id",
)
PUBLIC_KINDS, MANUAL_KIND = ("public-version-history", "public-schema-repository"), "manual-unrelated"
USES = ("accuracy-bearing", "traceability-only", "rejected-v9-overlap")
#: What an audit document must say, by JSON pointer. Fixed values.
AUDIT_TRUE = ("/conclusion/all_preserved_v9_outcomes_match", "/conclusion/all_preserved_v9_stdout_match", "/conclusion/negative_controls_passed")
AUDIT_FALSE = ("/conclusion/identity_interchangeable",)
AUDIT_ALL = ("/reconstruction/records", "/reconstruction/historical_pair_fingerprints_verified", "/preserved_v9_replay/invocations", "/preserved_v9_replay/outcome_matches", "/preserved_v9_replay/exact_stdout_matches")
AUDIT_NONE = ("/reconstruction/historical_pair_fingerprint_failures", "/preserved_v9_replay/rejected", "/preserved_v9_replay/outcome_mismatches", "/preserved_v9_replay/exact_stdout_mismatches", "/preserved_v9_replay/stderr_nonempty")
AUDIT_RESULT = "COMPLETE_PRESERVED_V9_MATCH"
PAIRING = ("training_dataset_sha256", "training_oracle_jar_sha256", "execution_oracle_jar_sha256", "policy_packs_sha256", "equivalence_audit_sha256")


def manifest_problems(transitions: DataFrame) -> DataFrame:
    """(record_id, problem) of manifest rows: blank fields, unknown uses, a source address that does not fit its kind,
    repeated ids. Columns a manifest lacks count as blank."""
    of = lambda c: F.col(c) if c in transitions.columns else F.lit(None).cast("string")
    checks = [F.when(F.coalesce(F.trim(of(c).cast("string")), F.lit("")) == "", F.lit(f"blank {c}")) for c in REQUIRED]
    checks.append(F.when(~F.coalesce(of("external_use").isin(*USES), F.lit(False)), F.lit("unknown external_use")))
    url, kind = F.coalesce(of("source_url"), F.lit("")), of("source_kind")
    checks.append(F.when(kind.isin(*PUBLIC_KINDS) & ~url.rlike("^https?://"), F.lit("a public source needs a web address")))
    checks.append(F.when((kind == MANUAL_KIND) & ~url.startswith("manual://"), F.lit("a manual source needs a manual:// address")))
    one = transitions.select("record_id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    twice = transitions.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("record_id", F.lit("repeated record_id").alias("problem"))
    return one.unionByName(twice)


def summary_problems(transitions: DataFrame, summary: dict) -> DataFrame:
    """(problem) of a manifest's summary against its rows: totals, counts by change, limitations, source files, and what
    is for tracing only. ``summary`` is the document's own, a small object."""
    spark = transitions.sparkSession
    told: list[str] = []
    trace = summary.get("traceability_only") or {}
    if any(not str(x).strip() for x in summary.get("limitations") or []):
        told.append("a limitation is blank")
    if not summary.get("preserved_source_files"):
        told.append("no preserved source files")
    if trace.get("status") != "traceability-only":
        told.append("the traceability status is another")
    if trace.get("accuracy_evidence"):
        told.append("tracing claims accuracy evidence")
    clean = list(trace.get("clean_record_ids") or [])
    if trace.get("clean_record_count") != len(clean):
        told.append("clean_record_count does not match clean_record_ids")
    if not str(trace.get("overlap_characterization") or "").strip():
        told.append("overlap_characterization is blank")
    if any(s["selected"] != s["clean"] + s["rejected"] for s in (trace.get("rejection_skew") or {}).values()):
        told.append("rejection_skew does not add up")
    fixed = spark.createDataFrame([(t,) for t in told], "problem string")
    total = transitions.agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") == 0) | (F.col("n") != summary.get("total_transitions", -1))).select(F.concat(F.lit("total_transitions does not match "), F.col("n").cast("string"), F.lit(" rows")).alias("problem"))
    declared = spark.createDataFrame([(k, int(v)) for k, v in (summary.get("mutation_id_counts") or {}).items()], "mutation_id string, declared long")
    counted = transitions.groupBy("mutation_id").agg(F.count(F.lit(1)).alias("n"))
    counts = counted.join(declared, "mutation_id", "full_outer").filter(F.coalesce("n", F.lit(0)) != F.coalesce("declared", F.lit(0))).select(F.concat(F.lit("count of "), F.coalesce("mutation_id", F.lit("null"))).alias("problem"))
    traced = transitions.filter("external_use = 'traceability-only'").select("record_id").distinct()
    listed = spark.createDataFrame([(c,) for c in set(clean)], "record_id string")
    apart = traced.join(listed.withColumn("_b", F.lit(True)), "record_id", "full_outer").join(traced.withColumn("_a", F.lit(True)), "record_id", "left").filter("_a is null or _b is null")
    return fixed.unionByName(total).unionByName(counts).unionByName(apart.select(F.concat(F.lit("clean_record_ids and rows differ in "), F.coalesce("record_id", F.lit("null"))).alias("problem")))


def one_identity(records: DataFrame, column: str) -> str:
    """The only value of an identity column; none or several are refused."""
    found = [r[0] for r in records.filter(F.col(column).isNotNull()).select(column).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{column} must hold exactly one value")
    return found[0]


def approved(pairing: dict[str, str], registry: list[dict[str, str]]) -> None:
    """Refuses a pairing of training and execution identities that the registry does not list in full."""
    for field in PAIRING:
        if not str(pairing.get(field) or "").strip():
            raise ValueError(f"{field} is missing")
    if not any(all(known.get(f) == pairing[f] for f in PAIRING) for known in registry):
        raise ValueError("this pairing has not been audited")


def _at(document: object, pointer: str) -> object:
    for part in pointer.strip("/").split("/"):
        document = document.get(part) if isinstance(document, dict) else None
    return document


def audit_problems(text: str, pairing: dict[str, str], n_records: int, format_version: str) -> list[str]:
    """What an equivalence audit (a small JSON document) fails to say about ``pairing`` and ``n_records`` records."""
    try:
        doc = json.loads(text)
    except ValueError:
        return ["no JSON"]
    texts = {
        "/format_version": format_version, "/status": "COMPLETE", "/conclusion/behavioral_result": AUDIT_RESULT,
        "/identity_boundary/historical_v9_jar_sha256": pairing["training_oracle_jar_sha256"], "/identity_boundary/backward_v10_jar_sha256": pairing["execution_oracle_jar_sha256"],
        "/inputs/v9_dataset_sha256": pairing["training_dataset_sha256"], "/inputs/v10_jar_sha256": pairing["execution_oracle_jar_sha256"], "/inputs/policy_packs_sha256": pairing["policy_packs_sha256"],
    }
    wanted: dict[str, object] = {**texts, **dict.fromkeys(AUDIT_TRUE, True), **dict.fromkeys(AUDIT_FALSE, False), **dict.fromkeys(AUDIT_ALL, n_records), **dict.fromkeys(AUDIT_NONE, 0)}
    found = {p: _at(doc, p) for p in wanted}
    return [p for p, want in wanted.items() if type(found[p]) is not type(want) or found[p] != want]


def dual_provenance(records: DataFrame, model: dict[str, str], execution: dict[str, str], audit_text: str, audit_sha256: str, registry: list[dict[str, str]], format_version: str) -> dict[str, str]:
    """The identities of a scored evaluation, or ValueError: one training oracle and policy file in the records
    (oracle_hash, policy_hash), the same in the model (dataset_sha256, oracle_jar_sha256, policy_packs_sha256) and in the
    execution (oracle_jar_sha256, policy_packs_sha256), an approved pairing, and an audit that covers every record."""
    oracle, policy = one_identity(records, "oracle_hash"), one_identity(records, "policy_hash")
    if model.get("oracle_jar_sha256") != oracle:
        raise ValueError("the model was trained on another oracle's labels")
    if model.get("policy_packs_sha256") != policy or execution.get("policy_packs_sha256") != policy:
        raise ValueError("policy files differ")
    pairing = dict(zip(PAIRING, (model.get("dataset_sha256", ""), oracle, execution.get("oracle_jar_sha256", ""), policy, audit_sha256)))
    approved(pairing, registry)
    missing = audit_problems(audit_text, pairing, records.count(), format_version)
    if missing:
        raise ValueError(f"the audit does not say: {', '.join(missing)}")
    return {**pairing, "equivalence_audit_result": AUDIT_RESULT}


def policy_scope(name: str, sha256: str, fixture_name: str, fixture_sha256: str, audit_only: bool = False) -> None:
    """A policy file made for audits only is refused in production; an audit of the mechanism takes exactly that file."""
    is_fixture = sha256 == fixture_sha256
    if not audit_only and is_fixture:
        raise ValueError("this policy file is for audits only")
    if audit_only and not (is_fixture and name == fixture_name):
        raise ValueError("the audit needs the fixture of that name and hash")
