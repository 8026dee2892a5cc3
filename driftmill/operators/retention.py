"""Retention of generated records under caps: order, duplicates and caps interact, so it is one pass in declared order.

The pass runs in one task over rows that arrive sorted, family after family: no row reaches the driver and only what is
kept is remembered (fingerprints and counters). That one task is the rule's own bound; ``splitting.quota`` is the
distributed rule for one cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("seed_no", "seed_id", "ordinal", "kind", "variant", "policy_no", "policy_pack", "outcome", "fingerprint")


class Fold:
    """What the rule remembers between families."""

    def __init__(self, per_stratum: int | None, per_outcome: int | None, within_family: bool, keep_variants: frozenset[str]):
        self.per_stratum, self.per_outcome, self.within_family, self.keep_variants = per_stratum, per_outcome, within_family, keep_variants
        self.seen: set[str] = set()
        self.strata: dict[tuple, int] = {}
        self.outcomes: dict[str, int] = {}
        self.by_kind: dict[str, int] = {}

    def full(self) -> bool:
        return self.per_outcome is not None and all(self.outcomes.get(o, 0) >= self.per_outcome for o in ("safe", "warning", "breaking"))

    def family(self, rows: list[dict]) -> Iterator[tuple[dict, str]]:
        """Decisions over one family's rows. Its changes are taken by what is kept of their kind so far, the least first;
        those with as much stay in order."""
        kept_before = dict(self.by_kind)
        for r in sorted(rows, key=lambda r: (kept_before.get(r["kind"], 0), r["ordinal"], r["policy_no"])):
            yield r, self.decide(r)

    def decide(self, r: dict) -> str:
        if r["outcome"] not in ("safe", "warning", "breaking"):
            return "rejected"
        if r["fingerprint"] in self.seen:
            return "duplicate"
        stratum: tuple = (r["policy_pack"], r["kind"], r["outcome"])
        if self.within_family:
            stratum = (r["seed_id"], *stratum, *([r["variant"]] if r["kind"] in self.keep_variants else []))
        if self.per_stratum is not None and self.strata.get(stratum, 0) >= self.per_stratum:
            return "over quota"
        if self.per_outcome is not None and self.outcomes.get(r["outcome"], 0) >= self.per_outcome:
            return "over quota"
        self.seen.add(r["fingerprint"])  # a row that is over quota does not reserve its fingerprint
        self.strata[stratum] = self.strata.get(stratum, 0) + 1
        self.outcomes[r["outcome"]] = self.outcomes.get(r["outcome"], 0) + 1
        self.by_kind[r["kind"]] = self.by_kind.get(r["kind"], 0) + 1
        return "retained"


def retain(rows: DataFrame, per_stratum: int | None, per_outcome: int | None = None, within_family: bool = False, keep_variants: tuple[str, ...] = ()) -> DataFrame:
    """(seed_no, ordinal, policy_no, decision): retained, duplicate (of a retained row), over quota, rejected, or not reached.

    rows: COLUMNS; families in order of seed_no, their changes by ordinal, each under its policies by policy_no. A stratum
    is policy, change and outcome; with ``within_family`` the cap holds inside each family, and for the changes in
    ``keep_variants`` for each variant. Once every outcome is full no further family is read. Nulls: an outcome that is
    null or unknown is rejected; null fingerprints are one fingerprint.
    """
    spec = (per_stratum, per_outcome, within_family, frozenset(keep_variants))
    ordered = rows.select(*COLUMNS).repartition(1).sortWithinPartitions("seed_no", "seed_id", "ordinal", "policy_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, family, of = Fold(*spec), [], None

        def close() -> list[tuple]:
            reached = not fold.full()
            done = fold.family(family) if reached else ((r, "not reached") for r in family)
            return [(r["seed_no"], r["ordinal"], r["policy_no"], d) for r, d in done]

        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                if (r["seed_no"], r["seed_id"]) != of:
                    out += close()
                    family, of = [], (r["seed_no"], r["seed_id"])
                family.append(r)
            yield _batch(out, b.schema)
        yield _batch(close(), None)

    def _batch(out: list[tuple], _: pa.Schema | None) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["seed_no", "ordinal", "policy_no", "decision"])

    typed = ordered.withColumns({"seed_no": F.col("seed_no").cast("long"), "ordinal": F.col("ordinal").cast("int"), "policy_no": F.col("policy_no").cast("int")})
    return typed.mapInArrow(run, "seed_no long, ordinal int, policy_no int, decision string")


def report(decisions: DataFrame) -> DataFrame:
    """Rows by decision."""
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
