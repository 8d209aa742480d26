"""Sessions, shared scratch storage and skew-safe building blocks used by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key that holds more than 1 / HOT_SHARE of all rows counts as hot; fewer than HOT_SHARE keys can.
HOT_SHARE = 64
#: Fewer rows than this fit one task whatever their keys.
LEAST_ROWS = 100_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is tested with; on a cluster use the cluster's own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodesift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or an own one where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lodesift-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


class Scratch:
    """Written tables in the shared folder that cut a plan's lineage; they survive the loss of executors.

    ``write`` runs the plan once and returns a DataFrame over the files.  ``drop`` removes tables that no
    later plan reads; what is left stays until the cluster clears its checkpoint folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark).rstrip('/')}/lodesift-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{self.count}-{name}"
        self.count += 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lodesift_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._lodesift_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cached(df: DataFrame) -> DataFrame:
    """Kept on the executors' disks while in use; lost blocks are recomputed from the lineage."""
    return df.persist(StorageLevel.DISK_ONLY)


def hot_keys(weights: DataFrame, key: str, weight: str, share: int = HOT_SHARE, least: int = LEAST_ROWS) -> list:
    """Keys that hold more than 1/share of the total weight, by construction fewer than ``share`` of them.

    Under ``least`` rows in all there is nothing to split, and none is hot; that changes the plan only.
    """
    total = weights.agg(F.sum(weight)).first()[0] or 0
    if total < least:
        return []
    return [r[0] for r in weights.where(F.col(weight) > F.lit(total / share)).select(key).collect()]


def lookup(rows: DataFrame, found: DataFrame, key: str, weight: str | None = None, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``rows`` joined with ``found`` (one row a key) on ``key`` so that no hot key meets in one task.

    ``weight`` names the column of ``found`` with the number of rows a key has in ``rows``, unless the ``hot`` keys are known.
    These, fewer than HOT_SHARE rows, are broadcast; all other rows take an ordinary shuffled join.
    """
    if hot is None and getattr(rows, "_lodesift_path", None) and rows.count() < LEAST_ROWS:
        hot = []  # a written table's count is in its footers, so ``found`` need not run for it
    if hot is None:
        hot = hot_keys(found, key, weight) if weight else []
    if weight:
        found = found.drop(weight)
    if not hot:
        return rows.join(found, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return (
        rows.where(is_hot)
        .join(F.broadcast(found.where(is_hot)), key, how)
        .unionByName(rows.where(~is_hot).join(found.where(~is_hot), key, how))
    )


def star_links(rows: DataFrame, key: str, member: str, salts: int | None = None) -> DataFrame:
    """Links (a, b), a < b, that connect all members of each key with few rows: n - 1 at most for n members.

    The members of a key are first joined to the smallest of their salt, then those to the smallest of the
    key, so a key that holds a third of all rows is spread over ``salts`` tasks.
    """
    spark = rows.sparkSession
    salts = salts or max(8, partitions(spark))
    rows = rows.where(F.col(key).isNotNull() & F.col(member).isNotNull()).select(
        F.col(key).alias("_k"), F.col(member).alias("_m"), F.pmod(F.xxhash64(member), F.lit(salts)).alias("_s")
    )
    part = rows.groupBy("_k", "_s").agg(F.min("_m").alias("_p"))
    near = rows.join(part, ["_k", "_s"]).select(F.col("_p").alias("a"), F.col("_m").alias("b"))
    top = part.groupBy("_k").agg(F.min("_p").alias("_t"))
    far = part.join(top, "_k").select(F.col("_t").alias("a"), F.col("_p").alias("b"))
    return near.unionByName(far).where("a < b")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their places in the order, from 0, without bringing all of them into one task.

    The rows are cut into ranges of the order, numbered within each and moved on by the sizes of the ranges before.
    """
    spark = rows.sparkSession
    parts = rows.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    parts = Scratch(spark, "numbered").write(parts, "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_own")).cast("bigint")).drop("_part", "_own", "_before")


def ranked(rows: DataFrame, by: list[str], key: str, name: str, seed: int = 0) -> DataFrame:
    """``rows`` with a rank from 0 in the pseudo-random order of the keys of each group, in two steps, so no group meets in one task."""
    h = F.xxhash64(F.lit(seed), key)
    rows = rows.withColumn("_h", h).withColumn("_slice", F.shiftrightunsigned("_h", 54))
    sizes = rows.groupBy(*by, "_slice").agg(F.count("*").alias("_m"))
    before = sizes.withColumn("_before", F.sum("_m").over(Window.partitionBy(*by).orderBy("_slice")) - F.col("_m")).drop("_m")
    own = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_h", key)) - 1
    return rows.withColumn("_own", own).join(before, [*by, "_slice"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_h", "_slice", "_own", "_before")


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """``first`` with the columns of tables of one row each, as scalar subqueries."""
    out = first
    for i, other in enumerate(others):
        out = out.withColumn(f"_{i}", other.select(F.struct(*other.columns)).scalar())
    return out.select(*first.columns, *[f"_{i}.{c}" for i, other in enumerate(others) for c in other.columns])
