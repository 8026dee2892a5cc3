"""Ten contract changes as a small in-memory source, and prepared records made from such rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmill.operators.schema_diff import change_features

COLUMNS = "id string, contract_family string, policy_pack string, number_of_fields long, fields_added long, fields_removed long, data_type_changes long, compatibility_status string, breaking_changes long, dependent_consumers long, deterministic_breaking boolean"
#: The ten published example rows. Fixed values.
ROWS = [
    ("orders.created.no-change", "orders.created", "baseline", 3, 0, 0, 0, "compatible", 0, 4, False),
    ("payments.completed.optional-region", "payments.completed", "baseline", 4, 1, 0, 0, "compatible", 0, 9, False),
    ("payments.completed.currency-removed", "payments.completed", "baseline", 2, 0, 1, 0, "incompatible", 1, 9, True),
    ("finance.settlement.amount-type", "finance.settlement", "baseline", 3, 0, 0, 1, "incompatible", 1, 6, True),
    ("user.events.required-region", "user.events", "baseline", 3, 1, 0, 0, "incompatible", 1, 3, True),
    ("orders.created.enum-added-baseline", "orders.created", "baseline", 4, 0, 0, 0, "unknown", 0, 4, False),
    ("orders.created.enum-added-strict", "orders.created", "strict", 4, 0, 0, 0, "incompatible", 1, 4, True),
    ("analytics.events.enum-added-relaxed", "analytics.events", "relaxed", 4, 0, 0, 0, "compatible", 0, 2, False),
    ("analytics.events.enum-removed", "analytics.events", "baseline", 4, 0, 0, 0, "incompatible", 1, 2, True),
    ("orders.created.multiple-breaks", "orders.created", "baseline", 2, 1, 1, 1, "incompatible", 3, 4, True),
]


def contract_changes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, COLUMNS).withColumn("old_version", F.lit("1.0.0")).withColumn("new_version", F.lit("1.1.0"))


def prepared(changes: DataFrame) -> DataFrame:
    """Records with v1 features and targets: risk is 0.8 for a breaking change, else 0.15."""
    breaking = F.when(F.col("deterministic_breaking"), 1.0).otherwise(0.0)
    return change_features(changes).select(
        F.col("id").alias("record_id"), F.lit("fixture").alias("source"), F.col("contract_family").alias("family_id"), F.col("contract_family").alias("split_group_id"), "policy_pack", "features",
        breaking.alias("breaking_change"), F.when(F.col("compatibility_status") == "incompatible", 1.0).otherwise(0.0).alias("incompatible"), F.when(F.col("deterministic_breaking"), 0.8).otherwise(0.15).alias("risk_score"),
    )


#: Six synthetic changes: name, fields, added, removed, type changes, status, breaking changes, consumers, and the targets
#: breaking, incompatible, risk. Fixed values.
SYNTHETIC = [
    ("orders-no-change", 8, 0, 0, 0, "compatible", 0, 2, 0.0, 0.0, 0.0),
    ("orders-safe-addition", 9, 1, 0, 0, "compatible", 0, 3, 0.0, 0.0, 0.15),
    ("orders-removed-field", 7, 0, 1, 0, "incompatible", 1, 4, 1.0, 1.0, 0.65),
    ("orders-type-change", 8, 0, 0, 1, "incompatible", 1, 5, 1.0, 1.0, 0.7),
    ("orders-multiple-breaking", 6, 0, 2, 2, "incompatible", 3, 8, 1.0, 1.0, 1.0),
    ("orders-unknown-impact", 8, 0, 0, 0, "unknown", 0, 1, 0.0, 0.0, 0.25),
]


def synthetic(spark: SparkSession) -> DataFrame:
    """(contract_family, features, breaking_change, incompatible, risk_score) of the six, all of version 1.0.0."""
    kinds = "contract_family string, number_of_fields long, fields_added long, fields_removed long, data_type_changes long, compatibility_status string, breaking_changes long, dependent_consumers long, breaking_change double, incompatible double, risk_score double"
    rows = spark.createDataFrame(SYNTHETIC, kinds).withColumn("new_version", F.lit("1.0.0"))
    return change_features(rows).select("contract_family", "features", "breaking_change", "incompatible", "risk_score")
