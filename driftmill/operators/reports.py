"""Batch reports over external transitions: component joins, overlap projections, raw traces, seeds against a reference."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmill.functions.hashing import canonical, loads
from driftmill.operators.candidates import classify_operations, generate_rows, operation_table

#: Marks of a diagnosis that ran what it must not run. Fixed values.
FORBIDDEN = ("oracle_invoked", "model_inference_invoked", "labels_produced")
ACCEPT, REJECT = "ACCEPT_NO_NEAR_STRUCTURAL_OVERLAP", "REJECT_NEAR_STRUCTURAL_OVERLAP"


def components(df: DataFrame, keep: list[str], text: str, member: str = "definitions") -> DataFrame:
    """``keep`` plus (component, schema): the named parts of each document's ``member``; none where it is no object."""

    def make(t: str | None) -> Iterator[tuple[str, str]]:
        try:
            doc = loads(t)
        except (ValueError, RecursionError):
            return
        parts = doc.get(member) if isinstance(doc, dict) else None
        for name in sorted(parts) if isinstance(parts, dict) else ():
            yield name, canonical(parts[name])

    return generate_rows(df, keep, {"_text": text}, "ordinal int, component string, schema string", make).drop("ordinal")


def component_join(df: DataFrame, keep: list[str], base: str, candidate: str, member: str = "definitions") -> DataFrame:
    """``keep`` plus (component, status, base_schema, candidate_schema): a full outer join of two documents' components;
    status is added, removed, changed or same (order of members does not count)."""
    a = components(df, keep, base, member).withColumnRenamed("schema", "base_schema")
    b = components(df, keep, candidate, member).withColumnRenamed("schema", "candidate_schema")
    status = F.when(F.col("base_schema").isNull(), "added").when(F.col("candidate_schema").isNull(), "removed").when(F.col("base_schema") == F.col("candidate_schema"), "same").otherwise("changed")
    return a.join(b, [*keep, "component"], "full_outer").select(*keep, "component", status.alias("status"), "base_schema", "candidate_schema")


def component_changes(joined: DataFrame, keep: list[str], prefixes: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` plus (component, decision, kinds, n_operations) of the changed components of ``component_join``."""
    ops = operation_table(joined.filter("status = 'changed'"), [*keep, "component"], "base_schema", "candidate_schema")
    return classify_operations(ops, [*keep, "component"], prefixes)


def _untouched(diagnostics: DataFrame) -> DataFrame:
    """Diagnoses; one that ran an oracle or a model, or made labels, is an error."""
    ran = F.lit(False)
    for c in FORBIDDEN:
        if c in diagnostics.columns:
            ran = ran | F.coalesce(F.col(c), F.lit(False))
    return diagnostics.withColumn("record_id", F.when(ran, F.raise_error(F.concat(F.lit("forbidden execution in "), "record_id")).cast("string")).otherwise(F.col("record_id")))


def projection(diagnostics: DataFrame, manifest: DataFrame | None = None, threshold: int = 1, distance: str = "distance") -> DataFrame:
    """Diagnoses plus (accepted, decision): near a known structure (``distance`` up to ``threshold``) is rejected. With a
    manifest, both must name the same records. A null distance is no evidence of distance: rejected."""
    rows = _untouched(diagnostics)
    if manifest is not None:
        left, right = rows.select("record_id"), manifest.select("record_id")
        if not left.exceptAll(right).isEmpty() or not right.exceptAll(left).isEmpty():
            raise ValueError("manifest and diagnoses name different records")
    accepted = F.coalesce(F.col(distance) > threshold, F.lit(False))
    return rows.withColumn("accepted", accepted).withColumn("decision", F.when(accepted, ACCEPT).otherwise(REJECT))


def projection_summary(projected: DataFrame) -> DataFrame:
    """One row: candidates, accepted, rejected, and whether any is left."""
    n = F.coalesce(F.sum(F.col("accepted").cast("int")), F.lit(0))
    total = F.count(F.lit(1))
    return projected.agg(total.alias("candidate_count"), n.alias("accepted_count"), (total - n).alias("rejected_count"), F.when(n == 0, "NO_NON_OVERLAPPING_CANDIDATES").otherwise("NON_OVERLAPPING_CANDIDATES_FOUND").alias("outcome"))


def raw_traces(manifest: DataFrame, diagnostics: DataFrame, path: str) -> DataFrame:
    """Manifest rows with the texts before and after at ``path`` (a JSON path) and the diagnosis of the same record; for
    tracing only. A row without a diagnosis is an error."""
    found = _untouched(diagnostics)
    others = [c for c in found.columns if c not in manifest.columns and c not in FORBIDDEN]
    joined = manifest.join(found.select("record_id", *others, F.lit(True).alias("_found")), "record_id", "left")
    checked = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no diagnosis of "), "record_id")).cast("string")).otherwise(F.col("record_id"))
    return joined.withColumn("record_id", checked).drop("_found").withColumns({"before": F.get_json_object("base_schema", path), "after": F.get_json_object("candidate_schema", path), "use": F.lit("traceability-only")})


def against_reference(runs: DataFrame, reference: DataFrame, values: list[str]) -> DataFrame:
    """(seed, matches) of runs looked up by seed in a reference report; a seed it lacks is an error."""
    known = reference.select("seed", *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(True).alias("_found"))
    same: Column = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_r_{v}"))
    lost = F.raise_error(F.concat(F.lit("the reference has no seed "), F.col("seed").cast("string"))).cast("boolean")
    return runs.join(known, "seed", "left").select("seed", F.when(F.col("_found").isNull(), lost).otherwise(same).alias("matches"))


def replay(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, outcome_match, stdout_match, stderr_empty, found): each recorded run against its replay. Both: key, outcome,
    stdout_sha256; the replay also stderr. A run without a replay matches nothing; a null outcome equals only null."""
    again = actual.select(key, F.col("outcome").alias("_o"), F.col("stdout_sha256").alias("_s"), (F.trim(F.coalesce("stderr", F.lit(""))) == "").alias("_e"), F.lit(True).alias("_f"))
    both = expected.join(again, key, "left").withColumn("found", F.coalesce("_f", F.lit(False)))
    same = lambda a, b: F.col("found") & F.col(a).eqNullSafe(F.col(b))
    return both.select(key, same("outcome", "_o").alias("outcome_match"), same("stdout_sha256", "_s").alias("stdout_match"), (F.col("found") & F.coalesce("_e", F.lit(False))).alias("stderr_empty"), "found")


def replay_verdict(compared: DataFrame) -> DataFrame:
    """One row: invocations, matches, mismatches, and whether everything recorded was reproduced."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0))
    total = F.count(F.lit(1))
    whole = (total > 0) & (n("outcome_match") == total) & (n("stdout_match") == total) & (n("stderr_empty") == total)
    return compared.agg(total.alias("invocations"), n("outcome_match").alias("outcome_matches"), n("stdout_match").alias("stdout_matches"), (total - n("stderr_empty")).alias("stderr_nonempty"), (total - n("found")).alias("missing"), F.when(whole, "COMPLETE").otherwise("INCOMPLETE").alias("status"))
