"""External transitions: manifest checks, contamination gate, scoring and strata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmill.functions.signatures import signature_key, structural
from driftmill.operators.metrics import stratified_accuracy
from driftmill.operators.models import score

def contamination(external: DataFrame, corpus: DataFrame, order: str | None = None) -> DataFrame:
    """``external`` plus ``reasons``: which of source, family, pair and feature row the corpus holds already, and
    whether an earlier row of the manifest has the same pair. Rows stand in the order of ``order``: manifest_no where there
    is one, else record_id.

    Both: record_id, source, family_id, pair_fingerprint, features. Each membership is a join with distinct keys.
    """
    order = order or ("manifest_no" if "manifest_no" in external.columns else "record_id")
    rows = external.withColumn("_full", signature_key(F.transform("features", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))).withColumn("_sig", signature_key(structural(F.col("features"))))
    known = corpus.withColumn("_full", signature_key(F.transform("features", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))).withColumn("_sig", signature_key(structural(F.col("features"))))
    for column in ("source", "family_id", "pair_fingerprint", "_full", "_sig"):
        keys = known.filter(F.col(column).isNotNull()).select(column).distinct().withColumn(f"_has_{column}", F.lit(True))
        rows = rows.join(keys, column, "left")
    firsts = external.filter("pair_fingerprint is not null").groupBy("pair_fingerprint").agg(F.min(order).alias("_first"))
    rows = rows.join(firsts, "pair_fingerprint", "left")
    names = {"source": "source", "family_id": "family", "pair_fingerprint": "pair", "_full": "feature row", "_sig": "structural row"}
    told = [F.when(F.col(f"_has_{c}"), F.lit(f"{n} is in the corpus")) for c, n in names.items()] + [F.when(F.col(order) > F.col("_first"), F.lit("pair occurs earlier"))]
    return rows.withColumn("reasons", F.array_compact(F.array(*told))).select(*external.columns, "reasons")


def unsupported_policies(external: DataFrame, packs: DataFrame) -> DataFrame:
    """Policy packs asked for that are not known."""
    return external.select(F.lower(F.trim("policy_pack")).alias("pack")).filter("pack is not null").subtract(packs.select("pack"))


def status_counts(gated: DataFrame) -> DataFrame:
    """One row: transitions, eligible ones, contaminated ones, and those no accuracy may rest on."""
    bearing = F.col("external_use") == "accuracy-bearing"
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return gated.agg(F.count(F.lit(1)).alias("n_transitions"), one(bearing & (F.size("reasons") == 0)).alias("n_eligible"), one(bearing & (F.size("reasons") > 0)).alias("n_contaminated"), one(~bearing).alias("n_not_for_accuracy"))


def evaluate(gated: DataFrame, models: list[tuple[str, str]]) -> DataFrame:
    """Strata of accuracy for what the gate lets through, by change, policy and both; rows without a label are not scored."""
    ok = gated.filter((F.col("external_use") == "accuracy-bearing") & (F.size("reasons") == 0) & F.col("label").isNotNull())
    scored = score(ok, ["record_id", "mutation", "policy_pack", "label"], "features", models)
    return stratified_accuracy(scored, F.col("label") == F.col("predicted"), "mutation", "policy_pack")


def feature_diagnostic(pairs: DataFrame, left: str, right: str, names: list[str]) -> DataFrame:
    """(challenge, training, place, name, left, right): the places in which matched rows differ."""
    from driftmill.functions.signatures import differing_places

    named = F.array(*map(F.lit, names))
    return pairs.select("query_id", "base_id", F.explode(differing_places(F.col(left), F.col(right))).alias("d")).select("query_id", "base_id", "d.place", F.get(named, F.col("d.place")).alias("name"), "d.left", "d.right")
