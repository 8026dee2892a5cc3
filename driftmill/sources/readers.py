"""Sources: numeric CSV, exact-schema Parquet, prepared data sets, evidence reports, manifests, model files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmill.operators import evidence, integrity, policy

S, D, B = T.StringType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


GENERATION = _struct(
    oracle_jar_sha256=S, policy_packs_sha256=S, oracle_outcome=S, declared_mutation=S, mutation_variant=S, root_object_profile=S, oracle_stdout=S,
    compatibility_mode=S, generator_version=S, generation_seed=T.DecimalType(20, 0), label_source=S, oracle_invariant_rationale=S, pair_fingerprint=S,
)
RECORD = _struct(
    record_id=S, source=S, family_id=S, split_group_id=S, dataset_role=S, contract_id=S, old_version=S, new_version=S, policy_pack=S,
    features=T.ArrayType(D), breaking_change=D, incompatible=D, risk_score=D, compatibility_label=S, generation=GENERATION,
)
PREPARED = T.StructType([T.StructField("format_version", S), T.StructField("dataset_version", S), T.StructField("feature_version", S), T.StructField("benchmark_ready", B), T.StructField("records", T.ArrayType(RECORD))])
RUN = _struct(family_id=S, mutation_family=S, mutation_variant=S, consumer_profile=S, compatibility_mode=S, policy_pack=S, exit_code=T.IntegerType(), outcome=S, stdout=S, stderr=S, rejection_stage=S, rejection_reason=S)
SOURCE_COLUMNS = ["filename", "json_schema", "unique_id"]


def numeric_csv(spark: SparkSession, path: str, columns: int, targets: int, header: bool = False) -> DataFrame:
    """(features, targets) of lines of numbers, the last ``targets`` columns apart. Blank lines are skipped; a line with
    another number of cells or a cell that is no number is an error when it is read."""
    if not 0 < targets < columns:
        raise ValueError("targets must leave at least one feature")
    schema = T.StructType([*[T.StructField(f"c{i}", D) for i in range(columns)], T.StructField("_corrupt_record", S)])
    rows = spark.read.schema(schema).option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    bad = F.col("_corrupt_record").isNotNull() | F.greatest(*[F.col(f"c{i}").isNull().cast("int") for i in range(columns)]).cast("boolean")
    fail = F.raise_error(F.concat(F.lit("bad line: "), F.coalesce("_corrupt_record", F.lit("an empty cell")))).cast("array<double>")
    cells = F.array(*[F.col(f"c{i}") for i in range(columns)])
    good = F.when(bad, fail).otherwise(cells)
    return rows.select(good.alias("_v")).select(F.slice("_v", 1, columns - targets).alias("features"), F.slice("_v", columns - targets + 1, targets).alias("targets"))


def schema_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Source schemas; the columns must be exactly filename, json_schema, unique_id, in this order."""
    df = spark.read.parquet(path)
    if df.columns != SOURCE_COLUMNS:
        raise ValueError(f"expected the columns {SOURCE_COLUMNS}, found {df.columns}")
    return df


def prepared_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, meta) of a prepared data set. The role is standard where it is missing, texts of the provenance empty,
    the seed 0. Validate with ``record_problems``."""
    doc = spark.read.schema(PREPARED).option("multiLine", True).json(path)
    meta = doc.select("format_version", "dataset_version", "feature_version", "benchmark_ready")
    r = doc.select("feature_version", F.explode("records").alias("r")).select("feature_version", "r.*").withColumn("dataset_role", F.coalesce("dataset_role", F.lit("standard")))
    empty = {f.name: F.lit(0) if f.name == "generation_seed" else F.lit("") for f in GENERATION if f.name not in ("root_object_profile", "oracle_invariant_rationale")}
    filled = F.struct(*[F.coalesce(F.col(f"generation.{f.name}"), empty[f.name].cast(f.dataType)).alias(f.name) if f.name in empty else F.col(f"generation.{f.name}") for f in GENERATION])
    return r.withColumn("generation", F.when(F.col("generation").isNotNull(), filled)), meta


def record_problems(records: DataFrame, width: int) -> DataFrame:
    """(record_id, problem) of records that a data set must not hold."""
    p = lambda cond, text: F.when(F.coalesce(cond, F.lit(True)), F.lit(text))
    checks = [p(F.trim(c) == "", f"blank {c}") for c in ("record_id", "family_id", "split_group_id", "contract_id", "policy_pack")]
    checks += [
        p((F.size("features") != width) | F.exists("features", lambda x: x.isNull() | F.isnan(x) | (x < 0)), "features are not valid"),
        p(~F.col("breaking_change").isin(0.0, 1.0) | ~F.col("incompatible").isin(0.0, 1.0) | ~F.col("risk_score").between(0, 1), "targets are not valid"),
        F.when(F.col("compatibility_label").isNotNull() & ((F.col("compatibility_label") == "breaking") != (F.col("breaking_change") == 1)), F.lit("label and target disagree")),
    ]
    one = records.select("record_id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    twice = records.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("record_id", F.lit("repeated record_id").alias("problem"))
    return one.unionByName(twice)


def conformance_json(spark: SparkSession, path: str, versions: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, cells): the raw runs of a report; aggregates are derived again, never trusted. A format_version that is not in
    ``versions`` is an error when it is read."""
    doc = spark.read.schema(T.StructType([T.StructField("format_version", S), T.StructField("runs", T.ArrayType(RUN))])).option("multiLine", True).json(path)
    if versions is not None:
        known = F.coalesce(F.col("format_version").isin(*versions), F.lit(False))
        wrong = F.raise_error(F.concat(F.lit("unknown format_version: "), F.coalesce("format_version", F.lit("null")))).cast(T.ArrayType(RUN))
        doc = doc.withColumn("runs", F.when(known, F.col("runs")).otherwise(wrong))
    runs = doc.select(F.explode("runs").alias("r")).select("r.*").withColumnsRenamed({"mutation_family": "mutation", "compatibility_mode": "mode"})
    return runs, evidence.cells(runs)


def promotion_json(spark: SparkSession, path: str) -> DataFrame:
    p = _struct(mutation_family=S, compatibility_mode=S, policy_pack=S, observed_label=S, oracle_jar_sha256=S, policy_packs_sha256=S, independent_families=T.LongType(), oracle_checks=T.LongType(), rationale=S)
    doc = spark.read.schema(T.StructType([T.StructField("promotions", T.ArrayType(p))])).option("multiLine", True).json(path)
    names = {"mutation_family": "mutation", "compatibility_mode": "mode", "observed_label": "label", "oracle_jar_sha256": "oracle_hash", "policy_packs_sha256": "policy_hash"}
    return doc.select(F.explode("promotions").alias("p")).select("p.*").withColumnsRenamed(names)


def policy_json(spark: SparkSession, path: str) -> DataFrame:
    """(pack, rule, rule_no, action) of a pack file, and is_default where it names a default pack; a small document."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    default, packs = policy.parse_packs(text)
    return policy.resolve(spark, packs, default)


def manifest_json(spark: SparkSession, path: str) -> DataFrame:
    """The transitions of a manifest with their place in it (manifest_no); its summary is read by ``manifest_summary``."""
    fields = dict.fromkeys(("source_kind", "external_use", "base_schema", "candidate_schema", *integrity.REQUIRED), S)
    doc = spark.read.schema(T.StructType([T.StructField("format_version", S), T.StructField("transitions", T.ArrayType(_struct(**fields)))])).option("multiLine", True).json(path)
    return doc.select(F.posexplode("transitions").alias("manifest_no", "t")).select("manifest_no", "t.*")


def manifest_summary(spark: SparkSession, path: str) -> dict:
    """The summary of a manifest, a small object."""
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0]).get("summary") or {}


def model_json(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, text) of model files: few and small."""
    return [(r["path"], r["content"].decode()) for r in spark.read.format("binaryFile").load(path).select("path", F.col("content")).collect()]


def verified_bytes(spark: SparkSession, path: str, sha256: str) -> bytes:
    """A file whose SHA-256 must be the one given."""
    r = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("h")).first()
    if r is None or r["h"] != sha256:
        raise ValueError("the file is not the pinned one")
    return bytes(r["content"])
