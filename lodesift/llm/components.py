"""Consolidating pairwise matches into groups.

Connectivity by low-diameter decomposition.  Every vertex draws an exponential shift; clusters start from the
vertices at their shifted times and grow one hop a step, each vertex going to the cluster that reaches it first.
Clusters become super-vertices, only links between different clusters go on to the next level, and the
assignments of the levels are composed at the end.  A level keeps a fixed share of the vertices at most in
expectation, so there are O(log n) levels even for long chains, and every step is an aggregation or an equi-join.

Defined results: null endpoints, links of a record with itself and repeated links (in either order) change
nothing; records without links are in no group; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.session import Scratch, lookup, star_links, table

MAX_LEVELS = 200


def start_time(vertex: str | Column, level: int, beta: float) -> Column:
    """Minus an Exp(beta) shift that depends on the vertex and the level only."""
    h = F.xxhash64(F.lit(f"level{level}"), vertex)
    u = (F.shiftrightunsigned(h, 11).cast("double") + 1) / F.lit(2.0**53)
    return F.log(u) / F.lit(beta)


def grow(links: DataFrame, level: int, beta: float, hops: int) -> DataFrame:
    """(v, c): the centre of the cluster that reaches v first within ``hops`` hops; links has both directions."""
    own = F.struct(start_time("v", level, beta).alias("t"), F.col("v").alias("c"))
    reached = links.groupBy(F.col("b").alias("v")).agg(
        F.min(F.struct((start_time("a", level, beta) + 1).alias("t"), F.col("a").alias("c"))).alias("m")
    )
    state = reached.select("v", F.least(own, "m").alias("m"))
    for _ in range(hops - 1):
        told = (
            links.join(state.withColumnRenamed("v", "a"), "a")
            .groupBy(F.col("b").alias("v"))
            .agg(F.min(F.struct((F.col("m.t") + 1).alias("t"), F.col("m.c").alias("c"))).alias("n"))
        )
        state = state.join(told, "v").select("v", F.least("m", "n").alias("m"))
    return state.select("v", F.col("m.c").alias("c"))


def contract(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """The links between different clusters, both directions, once each."""
    at = lambda end: clusters.select(F.col("v").alias(end), F.col("c").alias(f"_{end}"))
    return (
        links.where("a < b").join(at("a"), "a").join(at("b"), "b").where("_a <> _b")
        .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        .distinct().transform(both_ways)
    )


def both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.*")


def compose(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(v, c) of the first level with c the final centre: the assignments of all levels, last to first."""
    final = levels[-1]
    for lower in reversed(levels[:-1]):
        members = lower.groupBy("c").agg(F.count("*").alias("n"))
        last = final.select(F.col("v").alias("c"), F.col("c").alias("top"))
        found = members.join(last, "c", "left").select("c", "n", F.coalesce("top", "c").alias("top"))
        final = scratch.write(lookup(lower, found, "c", "n").select("v", F.col("top").alias("c")), "composed")
    return final


def smallest_member(assigned: DataFrame) -> DataFrame:
    """(id, group): the centre replaced by the smallest id of the group."""
    groups = assigned.groupBy("c").agg(F.min("v").alias("group"), F.count("*").alias("n"))
    return lookup(assigned, groups, "c", "n").select(F.col("v").alias("id"), "group")


def connected_groups(links: DataFrame, a: str = "a", b: str = "b", beta: float = 0.02, hops: int = 3) -> DataFrame:
    """(id, group): every id that a link holds, with the smallest id linked with it directly or indirectly.

    beta: rate of the shifts; smaller values give larger clusters.  hops: growth steps a level.
    """
    scratch = Scratch(links.sparkSession, "components")
    ends = links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    rest = scratch.write(ends.distinct().transform(both_ways), "links")
    levels: list[DataFrame] = []
    while not rest.isEmpty():
        if len(levels) == MAX_LEVELS:
            raise RuntimeError(f"links are left after {MAX_LEVELS} levels")
        clusters = scratch.write(grow(rest, len(levels), beta, hops), "clusters")
        after = scratch.write(contract(rest, clusters), "links")
        scratch.drop(rest)
        levels.append(clusters)
        rest = after
    if not levels:
        return ends.select(F.col("a").alias("id"), F.col("b").alias("group")).limit(0)
    return smallest_member(compose(levels, scratch))


def membership_links(rows: DataFrame, group_id: str, members: str, valid: DataFrame | None = None) -> DataFrame:
    """(a, b): links among the members of each row, and among those of all rows with the same non-null id.

    valid: one column of the ids that count; all others are left out before links are made.
    """
    ids = F.array_sort(F.array_distinct(F.filter(members, lambda x: x.isNotNull())))
    key = F.when(F.col(group_id).isNotNull(), F.concat(F.lit("id:"), F.col(group_id).cast("string")))
    key = F.coalesce(key, F.concat(F.lit("row:"), F.sha2(F.to_json(F.col("_ids")), 256)))
    flat = rows.select(group_id, ids.alias("_ids")).where(F.size("_ids") > 0)
    flat = flat.select(key.alias("key"), F.explode("_ids").alias("member")).distinct()
    if valid is not None:
        flat = flat.join(valid.toDF("member"), "member", "left_semi")
    return star_links(flat, "key", "member")


def product_links(spark, sf_dir: str) -> DataFrame:
    """(a, b): the links of match_pair and component between products of all_product."""
    valid = table(spark, sf_dir, "all_product").select(F.col("product_index").alias("id")).where("id is not null").distinct()
    pairs = table(spark, sf_dir, "match_pair").where("left_index <> right_index")
    pairs = pairs.select(F.least("left_index", "right_index").alias("a"), F.greatest("left_index", "right_index").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(valid.toDF(end), end, "left_semi")
    rows = table(spark, sf_dir, "component").select("component_id", "member_indices")
    return pairs.select("a", "b").unionByName(membership_links(rows, "component_id", "member_indices", valid))


def product_groups(spark, sf_dir: str) -> DataFrame:
    """(id, group) of all products that are linked with another one."""
    return connected_groups(product_links(spark, sf_dir))

