"""Resolving references of exported samples to stored pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.hashing import bits64
from lodesift.functions.text import plain
from lodesift.session import Scratch, lookup, table

#: Other spellings of split names.
SPLIT_NAMES = {"valid": "validation", "val": "validation"}
SHA_RUN = "^[0-9A-F]{64}$"


def split_name(split: str | Column) -> Column:
    """Plain split name with its other spellings replaced; null for null and blank."""
    s = plain(split)
    out = s
    for short, full in SPLIT_NAMES.items():
        out = F.when(s == short, F.lit(full)).otherwise(out)
    return F.when(out != "", out)


def named_pictures(samples: DataFrame, assets: DataFrame, key: str = "sample_id", refs: str = "source_image_ids", phash: bool = False) -> DataFrame:
    """(key, picture[, all_bits]), once each: the pictures that each sample names, with the bits of their perceptual hashes, sorted.

    A reference names the asset whose image_id it holds as a whole run of letters and digits, in any letter case,
    or whose sha256 it holds.  Assets with the same sha256 are one picture.  Null references, and runs that no asset
    has, name nothing.  Runs of a length that no image_id has are left out before anything is shuffled.
    """
    spark = samples.sparkSession
    scratch = Scratch(spark, "pictures")
    # names as tagged bytes, half as long as hexadecimal text
    by_name = lambda x: F.concat(F.lit(b"i"), F.encode(x, "UTF-8"))
    by_hash = lambda x: F.concat(F.lit(b"s"), F.unhex(x))
    sha = F.upper(F.trim("sha256"))
    extra = [bits64("phash").alias("bits")] if phash else []
    assets = assets.where("image_id is not null").select(F.upper("image_id").alias("id"), F.when(sha.rlike(SHA_RUN), sha).alias("sha"), *extra)
    lengths = [r[0] for r in assets.select(F.length("id").alias("n")).groupBy("n").count().select("n").collect()]  # lengths of ids are few
    assets = assets.select(by_name("id").alias("id"), by_hash("sha").alias("sha"), *[c for c in ("bits",) if phash])
    words = F.array_distinct(F.regexp_extract_all(F.upper(F.concat_ws(" ", refs)), F.lit(r"([\p{L}\p{N}]+)")))
    runs = F.concat(
        F.transform(F.filter(words, lambda x: F.length(x).isin(lengths)), by_name), F.transform(F.filter(words, lambda x: x.rlike(SHA_RUN)), by_hash)
    )
    held = samples.where(F.col(key).isNotNull()).select(key, F.explode(runs).alias("run")).distinct()
    held = scratch.write(held, "runs")
    counted = scratch.write(held.groupBy("run").agg(F.count("*").alias("n")), "counted")
    picture = F.coalesce("sha", "id").alias("picture")
    named = [F.col("bits")] if phash else []
    by_id = assets.select(F.col("id").alias("run"), picture, *named).join(counted.where(F.substring("run", 1, 1) == b"i"), "run")
    by_sha = assets.where("sha is not null").select(F.col("sha").alias("run"), F.col("sha").alias("picture"), *named)
    by_sha = by_sha.join(counted.where(F.substring("run", 1, 1) == b"s"), "run")
    all_bits = [F.array_sort(F.collect_set("bits")).alias("all_bits")] if phash else []
    there = by_id.unionByName(by_sha).groupBy("run").agg(F.min("picture").alias("picture"), F.max("n").alias("n"), *all_bits)
    found = lookup(held, scratch.write(there, "found"), "run", "n")
    return found.select(key, "picture", *[c for c in ("all_bits",) if phash]).distinct()


def latest_samples(spark, sf_dir: str) -> DataFrame:
    """One row for each sample_id: the delivery of the highest batch."""
    rows = table(spark, sf_dir, "export_ids").where("sample_id is not null")
    kept = ["split", "source", "source_product_ids", "source_image_ids"]
    order = F.struct(F.coalesce("export_batch", F.lit(0)), *[F.col(c) for c in kept])
    return rows.groupBy("sample_id").agg(F.max(order).alias("r")).select("sample_id", *[F.col(f"r.{c}") for c in kept])
