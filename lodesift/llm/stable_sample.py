"""Samples that are the same in every run and keep what they held as data grows.

Consistent weighted Poisson sampling: a record is in the sample when the fraction that the hash of its id gives is
below weight * constant.  The weight is the largest that the record ever had; those running maxima are stored, so the
chance of inclusion never falls and a record once selected stays selected.

The maxima are stored as one folder a delivery, which holds the largest weights in that delivery alone, and the maximum
over all folders counts.  A delivery never rewrites what is there; one that was lost in the middle has no mark of success and
is not read, and bringing it in again, or twice, changes nothing, as a maximum taken twice is the same.

Defined results: null ids are no records; null, negative and not-a-number weights count as 0 and are never selected;
a repeated id has one row; an empty table gives an empty sample; other columns of the rows are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions.hashing import fraction
from lodesift.session import Scratch, lookup, table

DIGITS = 13


def running_weights(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """(id, weight): the largest weight of each id."""
    w = F.col(weight).cast("double")
    now = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.when(F.isnan(w) | w.isNull() | (w < 0), 0.0).otherwise(w).alias("weight"))
    return now.groupBy("id").agg(F.max("weight").alias("weight"))


def select(weights: DataFrame, constant: float, salt: str = "sample") -> DataFrame:
    """The rows of ``weights`` that belong to the sample; constant is the chance of a record of weight 1."""
    return weights.where(fraction(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), DIGITS) < F.col("weight") * F.lit(constant))


def stored(spark: SparkSession, state: str) -> list[str]:
    """The folders of the deliveries that were written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(state).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(state)):
        return []
    return sorted(s.getPath().toString() for s in files.listStatus(path(state)) if files.exists(path(s.getPath(), "_SUCCESS")))


def bring_in(rows: DataFrame, key: str, weight: str, state: str) -> None:
    """Stores the maxima of a delivery beside those of the others."""
    running_weights(rows, key, weight).write.parquet(f"{state}/{uuid.uuid4().hex}")


def maxima(spark: SparkSession, state: str) -> DataFrame | None:
    """(id, weight): the running maxima over all stored deliveries; None where there are none."""
    folders = stored(spark, state)
    return spark.read.parquet(*folders).groupBy("id").agg(F.max("weight").alias("weight")) if folders else None


def compact(spark: SparkSession, state: str) -> None:
    """Brings the stored deliveries together in one folder; the old ones go only after it is written, and one that stays does no harm."""
    old = stored(spark, state)
    if len(old) > 1:
        maxima(spark, state).write.parquet(f"{state}/{uuid.uuid4().hex}")
        path = spark._jvm.org.apache.hadoop.fs.Path
        for folder in old:
            path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(folder), True)


def grown_sample(rows: DataFrame, key: str, weight: str, state: str, constant: float, salt: str = "sample") -> DataFrame:
    """The sample after ``rows`` came in; the folder ``state`` holds the running maxima."""
    bring_in(rows, key, weight, state)
    return select(maxima(rows.sparkSession, state), constant, salt)


def weighted_samples(spark, sf_dir: str) -> DataFrame:
    """(sample_id, export_batch, w): the weight is the number of different pictures that a delivery names, at least 1."""
    pictures = F.size(F.array_distinct(F.filter("source_image_ids", lambda x: x.isNotNull())))
    return table(spark, sf_dir, "export_ids").select("sample_id", "export_batch", F.greatest(F.lit(1), F.coalesce(pictures, F.lit(1))).alias("w"))


def named(chosen: DataFrame) -> DataFrame:
    return chosen.select(F.col("id").alias("sample_id"), F.col("weight").cast("bigint").alias("weight"))


def whole_sample(spark, sf_dir: str, constant: float = 0.05) -> DataFrame:
    """Samples of export_ids, from all deliveries of the table at once: what bringing them in one by one must give."""
    return named(select(running_weights(weighted_samples(spark, sf_dir), "sample_id", "w"), constant))


def export_sample(spark, sf_dir: str, constant: float = 0.05, state: str | None = None) -> DataFrame:
    """Samples of export_ids, its deliveries brought in one after the other, rows without a batch first.

    Each delivery is read by itself and meets only the stored maxima of those before it.  Without a folder ``state``
    the maxima begin empty in a scratch folder.
    """
    rows = weighted_samples(spark, sf_dir)
    state = state or f"{Scratch(spark, 'maxima').root}/state"
    batches = sorted((r[0] for r in rows.select("export_batch").distinct().collect()), key=lambda b: (b is not None, b))
    for batch in batches or [None]:
        bring_in(rows.where(F.col("export_batch").eqNullSafe(F.lit(batch))), "sample_id", "w", state)
    return named(select(maxima(spark, state), constant))


def component_sample(spark, sf_dir: str, constant: float = 0.05) -> DataFrame:
    """Whole components: all members of the component_ids selected by their largest number of members."""
    rows = table(spark, sf_dir, "component").select("component_id", "member_indices").where("component_id is not null")
    members = F.array_distinct(F.filter("member_indices", lambda x: x.isNotNull()))
    rows = rows.select("component_id", members.alias("members")).withColumn("w", F.coalesce(F.size("members"), F.lit(0)))
    scratch = Scratch(spark, "sample")
    bring_in(rows, "component_id", "w", f"{scratch.root}/state")
    chosen = select(maxima(spark, f"{scratch.root}/state"), constant, "component")
    # the id's selection follows from its running maximum, so a lookup by id is enough; it is hot-safe
    counted = rows.groupBy("component_id").agg(F.count("*").alias("n")).join(chosen.withColumnRenamed("id", "component_id"), "component_id", "left_semi")
    counted = scratch.write(counted, "chosen")
    kept = lookup(rows.select("component_id", "members"), counted, "component_id", "n")
    return kept.select("component_id", F.explode("members").alias("product_index")).distinct()
