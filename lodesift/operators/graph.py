"""Links between records and the groups they form."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.hashing import hamming
from lodesift.session import Scratch, hot_keys, lookup, star_links


def relation_links(rows: DataFrame, key: str, relations: list[str]) -> DataFrame:
    """(a, b): links that connect the keys of each value of the relations, arrays of values included; nulls relate nothing.

    The keys of a value are linked through salted minima, so a value that a third of all rows has is spread over tasks.
    """
    parts = []
    for r in relations:
        flat = rows.select(F.col(key).alias("m"), (F.explode(r) if rows.schema[r].dataType.typeName() == "array" else F.col(r)).alias("v"))
        parts.append(flat.where("v is not null").select("m", F.concat(F.lit(f"{r}:"), F.col("v").cast("string")).alias("v")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return star_links(union.distinct(), "v", "m").distinct()


def slice_choices(bits: str | Column, most: int, parts: int) -> Column:
    """(number, value) of every choice of parts - most of the slices of 64 bits; values that differ in ``most`` bits agree in one of them."""
    cut = [round(64 * i / parts) for i in range(parts + 1)]
    part = [F.shiftrightunsigned(F.shiftleft(bits, 64 - b), 64 - b + a) for a, b in zip(cut, cut[1:], strict=False)]
    return F.array(*[F.struct(F.lit(k).alias("i"), F.xxhash64(*[part[i] for i in chosen]).alias("v")) for k, chosen in enumerate(combinations(range(parts), parts - most))])


def hamming_pairs(rows: DataFrame, key: str, bits: str, most: int = 4, spare: int = 2) -> DataFrame:
    """(a, b, distance): pairs of different keys whose bits differ in ``most`` places at most.

    Equal values are compared once: the join runs on distinct values, cut in most + spare slices, of which values so near agree in ``spare``; two
    slices hold 21 bits, so that what meets by chance stays few among millions of values.  The keys are joined back at the end.
    """
    held = rows.where(F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).alias("h")).distinct()
    flat = held.select("h").distinct().select("h", F.explode(slice_choices("h", most, most + spare)).alias("s")).select("h", "s.i", "s.v")
    met = flat.withColumnRenamed("h", "x").join(flat.withColumnRenamed("h", "y"), ["i", "v"])
    near = met.where((F.col("x") <= F.col("y")) & (hamming("x", "y") <= most)).select("x", "y").distinct()
    both = near.join(held.select(F.col("h").alias("x"), F.col("k").alias("kx")), "x").join(held.select(F.col("h").alias("y"), F.col("k").alias("ky")), "y").where("kx <> ky")
    return both.select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b"), hamming("x", "y").alias("distance")).distinct()


def groups_of(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, group): the smallest id that each id is linked with, by label propagation with pointer jumping."""
    scratch = Scratch(links.sparkSession, "groups")
    both = scratch.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("group")), "labels")
    hot = hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), "b", "n")
    for _ in range(rounds):
        told = lookup(both, labels.withColumnRenamed("id", "b"), "b", hot=hot).groupBy(F.col("a").alias("id")).agg(F.min("group").alias("near"))
        nearer = labels.join(told, "id").select("id", F.least("group", "near").alias("group"), F.col("group").alias("old"))
        jumped = nearer.join(labels.select(F.col("id").alias("group"), F.col("group").alias("far")), "group", "left")
        after = scratch.write(jumped.select("id", F.least("group", "far").alias("group"), "old"), "labels")
        moved = after.where("group <> old").limit(1).count()
        labels = after.drop("old")
        if not moved:
            scratch.drop(both)
            return labels
    raise RuntimeError(f"labels still move after {rounds} rounds")


def group_names(groups: DataFrame, prefix: str) -> DataFrame:
    """(group, name, members): a name from the hash of the sorted member ids."""
    each = groups.groupBy("group").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("members"))
    return each.select("group", F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json("members"), 256), 1, 20)).alias("name"), F.size("members").alias("members"))
