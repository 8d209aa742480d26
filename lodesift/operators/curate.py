"""Curation of raw listings: usable pictures, candidates, texts from several sources, names of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.operators.checks import Violation, strict


def usable_pictures(listings: DataFrame, pictures: DataFrame, key: str, ids: str, picture: str, least_width: int, least_height: int, keep: int = 3) -> DataFrame:
    """(key, image_ids, usable): the first ``keep`` ids, in the listing's order, of pictures large enough, and how many there are.

    ids: an array column, pictures: one row an id with width and height.  Listings without any are left out.
    """
    flat = listings.select(key, F.posexplode(ids).alias("_pos", "_id")).where(F.coalesce(F.col("_id") != "", F.lit(False)))
    large = pictures.where((F.col("width") >= least_width) & (F.col("height") >= least_height)).select(F.col(picture).alias("_id")).distinct()
    each = flat.join(large, "_id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_id"))).alias("_all"))
    return each.select(key, F.transform(F.slice("_all", 1, keep), lambda x: x["_id"]).alias("image_ids"), F.size("_all").alias("usable"))


def candidates(listings: DataFrame, usable: DataFrame, key: str, required: list[str], least: int = 3) -> DataFrame:
    """Listings that have every required column and at least ``least`` usable pictures, with their image_ids."""
    complete = F.lit(True)
    for c in required:
        complete = complete & F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    return listings.where(complete).join(usable.where(F.col("usable") >= least).select(key, "image_ids"), key)


def correspond(rows: DataFrame, names: str, known: DataFrame, name: str, check: bool = True) -> DataFrame:
    """rows joined with the one row of ``known`` of each name; with ``check`` an unknown name is an error."""
    if check:
        strict(rows.select(F.col(names).alias(name)).join(known.select(name), name, "left_anti").select(name).distinct(), f"no correspondence of {names}")
    return rows.join(known.withColumnRenamed(name, names), names)


def prioritized(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first source, and of every later one those whose key no earlier one has; sources share their columns."""
    out = sources[0]
    for later in sources[1:]:
        out = out.unionByName(later.join(out.select(key).distinct(), key, "left_anti"))
    return out


def enriched(rows: DataFrame, texts: DataFrame, key: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Every row with the text columns of its key; null or the default where there is no text."""
    out = rows.join(texts, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in (defaults or {}).items()})


def dependency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of a functional dependency; a key with several values is an error."""
    pairs = rows.select(key, value).distinct()
    strict(pairs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), f"{key} does not determine {value}")
    return pairs


def first_name(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the smallest name of each key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(name).alias(name))


def latest(names: DataFrame, name: str, pattern: str = r"(\d+)$") -> DataFrame:
    """The one row whose name has the largest number; names without a number do not count."""
    number = F.regexp_extract(name, pattern, 1)
    order = F.nullif(number, F.lit("")).try_cast("bigint")
    return names.where(order.isNotNull()).agg(F.max_by(name, F.struct(order, name)).alias(name), F.max(order).alias("number")).where("number is not null")


def first_seen(values: str | Column) -> Column:
    """Distinct values of an array without nulls, in the order of their first places."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull()))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key): keys that only the left or only the right rows have; no rows if both hold the same keys."""
    one = lambda a, b, side: a.select(key).distinct().join(b.select(key), key, "left_anti").select(F.lit(side).alias("side"), key)
    return one(left, right, "left").unionByName(one(right, left, "right"))


def joined(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null there."""
    if not parts:
        raise Violation("no parts to join")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
