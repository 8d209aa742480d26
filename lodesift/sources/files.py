"""Reading loosely structured records and writing partitioned, resumable outputs."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodesift.operators.checks import strict

#: Keys under which a JSON document may hold its rows.
WRAPPERS = ("products", "items", "listings", "records", "data")


def read_lines(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """JSON lines; blank lines are left out."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON or JSON lines by the file name, .gz included; rows of a JSON document may be wrapped."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if name.endswith((".jsonl", ".ndjson")):
        return read_lines(spark, path)
    if not name.endswith(".json"):
        raise ValueError(f"no manifest format: {path}")
    rows = spark.read.option("multiLine", True).json(path)
    for key in WRAPPERS:
        if key in rows.columns and rows.schema[key].dataType.typeName() == "array":
            return rows.select(F.explode(key).alias("r")).select("r.*")
    return rows


def column_of(rows: DataFrame, names: list[str]) -> str | None:
    """The first of the names that the rows have, letter case aside."""
    there = {c.lower(): c for c in reversed(rows.columns)}
    return next((there[n.lower()] for n in names if n.lower() in there), None)


def write_lines(rows: DataFrame, path: str, ordered: bool = True, mode: str = "errorifexists") -> None:
    """JSON lines with nulls kept and, if ordered, columns in the order of their names."""
    rows = rows.select(*sorted(rows.columns)) if ordered else rows
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_splits(rows: DataFrame, path: str, split: str, names: list[str], mode: str = "errorifexists") -> None:
    """A folder of JSON lines for each name, also where it is empty; a row of another split is an error."""
    bad = rows.where(~F.coalesce(F.col(split).isin(names), F.lit(False))).select(split).limit(1).collect()
    if bad:
        raise ValueError(f"unknown split {bad[0][0]!r}")
    for name in names:
        write_lines(rows.where(F.col(split) == name), f"{path}/{split}={name}", mode=mode)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows, once for each key, whose key the Parquet folder does not hold yet."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates([key])
    if there(spark, path):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows.write.mode("append").parquet(path)


def there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a fixed schema, .gz included; a value that does not fit its type is an error."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def read_wanted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is wanted; a wanted key that no row has is an error."""
    keys = wanted.select(key).distinct()
    strict(keys.join(rows.select(key), key, "left_anti"), f"{key} without rows")
    return rows.join(keys, key, "left_semi")


def read_splits(spark: SparkSession, path: str, split: str, names: list[str], schema: StructType | str | None = None) -> DataFrame:
    """What write_splits wrote, with the folder's split; a row that says otherwise is an error."""
    parts = []
    for name in names:
        reader = spark.read.schema(schema) if schema else spark.read
        rows = reader.json(f"{path}/{split}={name}", pathGlobFilter="*.json")
        if not rows.columns:
            continue
        if split in rows.columns:
            strict(rows.where(~F.coalesce(F.col(split) == name, F.lit(False))).select(split).distinct(), f"rows of another split in {name}")
        parts.append(rows.withColumn(split, F.lit(name)))
    if not parts:
        raise ValueError(f"no rows under {path}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_parquet_if_changed(rows: DataFrame, path: str, source: str) -> bool:
    """Writes the rows unless the folder was made of a source with the same contents; says whether it did."""
    spark = rows.sparkSession
    held = contents(spark, source).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256)).first()[0]
    stamp = f"{path}.source"
    if there(spark, path) and there(spark, stamp) and spark.read.text(stamp).first()[0] == held:
        return False
    rows.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(held,)], "value string").coalesce(1).write.mode("overwrite").text(stamp)
    return True


def publish(spark: SparkSession, path: str, write, source: str | None = None) -> None:
    """``write(folder)`` fills a folder beside the path that takes its place when all is written; a path that exists is never replaced.

    source: where the rows come from, which may not lie inside the path.
    """
    if there(spark, path):
        raise FileExistsError(path)
    if source and f"{source.rstrip('/')}/".startswith(f"{path.rstrip('/')}/"):
        raise ValueError(f"{source} lies inside {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex[:8]}"
    files = place(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(staged)
        if not files.rename(place(staged), place(path)):
            raise OSError(f"{staged} cannot take the place of {path}")
    finally:
        files.delete(place(staged), True)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row as a JSON document in a folder."""
    report.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the JSON object of the columns, keys sorted, no spaces, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def stable_json_hash(x: object) -> str:
    """SHA-256 of JSON with sorted keys and no spaces, a fixed format; canonical_hash is the same as a column."""
    return hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def generated_products(spark: SparkSession, n: int, values: dict[str, list[str]], seed: int = 42) -> DataFrame:
    """Synthetic records whose columns take their values in turn, with their cycle and a seed of their own."""
    rows = spark.range(n).select(F.format_string("product_%04d", F.col("id") + 1).alias("product_id"), "id")
    cells = [F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("id") % len(v) + 1).cast("int")).alias(k) for k, v in values.items()]
    longest = max((len(v) for v in values.values()), default=1)
    own = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2**31)).alias("generation_seed")
    return rows.select("product_id", *cells, F.floor(F.col("id") / longest).alias("cycle"), own)
