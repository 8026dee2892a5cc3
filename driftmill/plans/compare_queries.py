"""Queries of problem 5: two copies of the invocation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftmill.operators.compare import diff_summary, diff_tables
from driftmill.plans.registry import Registry
from driftmill.runtime import table

FIELDS = (
    "record_id", "family_id", "policy_pack", "declared_mutation", "mutation_variant", "historical_pair_fingerprint",
    "expected_v9_outcome", "actual_v10_outcome", "exit_code", "expected_stdout_sha256", "actual_stdout_sha256",
    "outcome_match", "stdout_match", "stderr_empty", "rejection_stage", "rejection_reason",
)
TEXTS = {f for f in FIELDS if f not in ("exit_code", "outcome_match", "stdout_match", "stderr_empty")}


def _fold(side: str, f: str) -> str:
    return f"lower(trim({side}.{f}, E' \\t\\n\\r'))" if f in TEXTS else f"{side}.{f}"


_CURRENT = "select * from {t} qualify row_number() over (partition by invocation_no order by recorded_at desc) = 1"
FOUND_SQL = (
    f"with l as ({_CURRENT.format(t='invocation_log')}), m as ({_CURRENT.format(t='invocation_mirror')}) "
    "select l.invocation_no, 'missing_in_mirror' as field_name from l where l.invocation_no not in (select invocation_no from m) "
    "union all select m.invocation_no, 'missing_in_log' from m where m.invocation_no not in (select invocation_no from l) "
    + " ".join(f"union all select l.invocation_no, '{f}' from l join m using (invocation_no) where {_fold('l', f)} is distinct from {_fold('m', f)}" for f in FIELDS)
)


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_tables(table(spark, sf_dir, "invocation_log"), table(spark, sf_dir, "invocation_mirror"), "invocation_no", "recorded_at", list(FIELDS), "missing_in_log", "missing_in_mirror")


def register(r: Registry) -> None:
    @r.add("p5_found", FOUND_SQL)
    def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return diff(spark, sf_dir)

    @r.add("p5_summary", f"select field_name, count(*) as n_rows from ({FOUND_SQL}) group by 1")
    def p5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
        return diff_summary(diff(spark, sf_dir))
