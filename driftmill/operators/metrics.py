"""Classification, regression and threshold metrics; each is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmill.functions.labels import CLASSES


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def confusion(df: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    """true/false positives and negatives of 0/1 values, by ``by``."""
    p, t = predicted == 1, actual == 1
    return df.groupBy(*by).agg(_n(p & t).alias("tp"), _n(p & ~t).alias("fp"), _n(~p & ~t).alias("tn"), _n(~p & t).alias("fn"))


def classification(c: DataFrame) -> DataFrame:
    """accuracy, precision, recall and F1 of confusion rows; without anything to divide by they are 0."""
    tp, fp, tn, fn = (F.coalesce(F.col(x), F.lit(0)) for x in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.withColumns({"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)})


def confusion_cells(df: DataFrame, actual: str, predicted: str, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """(actual, predicted, n) for every pair of classes, 0 where none occurs."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, p) for a in classes for p in classes], "actual string, predicted string")  # 9 rows
    n = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def stratified_accuracy(df: DataFrame, hit: Column, first: str, second: str) -> DataFrame:
    """Accuracy over everything, by each of two columns and by both, in one pass of grouping sets."""
    df.withColumn("_hit", F.when(hit, 1).otherwise(0)).createOrReplaceTempView("_driftmill_strata")
    return df.sparkSession.sql(
        f"SELECT CASE grouping_id({first}, {second}) WHEN 3 THEN 'overall' WHEN 1 THEN '{first}' WHEN 2 THEN '{second}' ELSE '{first}:{second}' END AS stratum, "
        f"{first}, {second}, count(*) AS n, sum(_hit) AS n_correct, round(sum(_hit) / count(*), 6) AS accuracy "
        f"FROM _driftmill_strata GROUP BY GROUPING SETS ((), ({first}), ({second}), ({first}, {second}))"
    )


def regression(df: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    d = predicted - actual
    return df.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.count(d).alias("n"))


def threshold_sweep(df: DataFrame, score: Column, actual: Column, thresholds: list[float]) -> DataFrame:
    """Metrics at each threshold. A row is expanded to the few thresholds on the map side and counted there."""
    t = df.select(score.alias("s"), actual.alias("t"), F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    return classification(confusion(t, (F.col("s") >= F.col("threshold")).cast("int"), F.col("t"), "threshold"))


def majority_baseline(df: DataFrame, label: Column) -> DataFrame:
    """One row: the class in more than half of the rows (a tie is 0) and how often it is right."""
    a = df.agg(F.count(label).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("ones"))
    guess = F.when(2 * F.col("ones") > F.col("n"), 1).otherwise(0)
    return a.select("n", guess.alias("majority"), ratio(F.when(guess == 1, F.col("ones")).otherwise(F.col("n") - F.col("ones")), F.col("n")).alias("accuracy"))


def breaking_count_rule(features: Column, version: str) -> Column:
    """1 where the breaking-change count is positive. Only v1 rows hold that count, at place 6."""
    if version != "v1":
        raise ValueError("only v1 rows hold a count of breaking changes")
    return (features[6] > 0).cast("int")


def baseline_comparison(df: DataFrame, actual: Column, rules: dict[str, Column]) -> DataFrame:
    """Metrics of several 0/1 rules side by side, in one pass."""
    stacked = df.select(actual.alias("t"), F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.cast("int").alias("p")) for k, v in rules.items()])).alias("x")).select("t", "x.*")
    return classification(confusion(stacked, F.col("p"), F.col("t"), "rule"))


def across_seeds(df: DataFrame, by: str, accuracy: str = "accuracy") -> DataFrame:
    """Mean, least and greatest accuracy of repeated runs."""
    return df.groupBy(by).agg(F.avg(accuracy).alias("mean_accuracy"), F.min(accuracy).alias("min_accuracy"), F.max(accuracy).alias("max_accuracy"), F.count(F.lit(1)).alias("n_seeds"))


def summed_confusion(cells: DataFrame, by: str) -> DataFrame:
    """Element-wise sum of confusion cells (by, actual, predicted, n)."""
    return cells.groupBy(by, "actual", "predicted").agg(F.sum("n").alias("n"))


def bucket_rule(df: DataFrame, bucket: Column, label: str, tie_is_error: bool = True) -> DataFrame:
    """(bucket, predicted, ones, zeros): each bucket's commoner label of two; a tie is an error, or null."""
    n = df.groupBy(bucket.alias("bucket")).agg(_n(F.col(label) == 1).alias("ones"), _n(F.col(label) == 0).alias("zeros"))
    tie = (F.raise_error(F.lit("a bucket is tied")) if tie_is_error else F.lit(None)).cast("int")
    return n.select("bucket", F.when(F.col("ones") > F.col("zeros"), 1).when(F.col("ones") < F.col("zeros"), 0).otherwise(tie).alias("predicted"), "ones", "zeros")
