"""Session-level helpers: table access, lineage cuts, task spreading, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local folder will do for one machine
    (tests); on a cluster that is an error, as no machine's folder is the others'."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"driftmill-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Cut tables that have not been dropped.
OPEN_CUTS: list[Cut] = []


class Cut:
    """A table written to the shared folder; ``df`` reads it and ``drop`` removes a superseded one."""

    def __init__(self, df: DataFrame, note: str = "cut"):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/driftmill/{note}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        OPEN_CUTS.append(self)

    def drop(self) -> None:
        spark = self.df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if self in OPEN_CUTS:
            OPEN_CUTS.remove(self)


def clear_cuts() -> None:
    """Delete all cut tables of this driver: for long sessions, once the results that read them are written."""
    for c in list(OPEN_CUTS):
        c.drop()


def cut(df: DataFrame, note: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    A plain ``checkpoint()`` runs the last stage twice (once to count, once to write); a written table runs it
    once and keeps column pruning and statistics for what follows.
    """
    return Cut(df, note).df


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give Python-heavy work enough tasks where the input has fewer splits than the cluster has cores.

    Inputs with as many splits as cores or more are left alone, so no shuffle is paid at scale.
    """
    want = parallelism(df.sparkSession)
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= want else df.repartition(want * per_core)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a table whose row count is checked here; a larger one stays a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def unit_hash(seed: int | str, *cols: Column | str) -> Column:
    """A uniform double in [0, 1) that depends only on seed and columns, so a retried task draws it again."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(str(seed)), *cols), 11) / F.lit(float(1 << 53))).cast("double")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; Python workers import it from there."""
    sc = spark.sparkContext
    if getattr(sc, "_driftmill_shipped", False):
        return
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="driftmill-"), "driftmill.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("driftmill", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._driftmill_shipped = True
