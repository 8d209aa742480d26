"""Splits that keep related records together.

Relations become weighted links.  Borůvka rounds: every tree picks its least outgoing link, the picks join the
spanning forest, a table written in the shared folder, and the trees they connect are contracted, until no link
leaves a tree.  Each round at least halves the trees that still have links, so there are O(log n) rounds.  The
trees' roots are stratified by size band and dealt systematically along each band's fixed pseudo-random order, so
every band, and with it the whole, has the wanted proportions up to one tree a band.

Defined results: null ids are no records; records without relations are trees of their own; null relation values
relate nothing; repeated deliveries count once; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodesift.llm.components import compose, product_groups
from lodesift.llm.pictures import latest_samples, named_pictures, split_name
from lodesift.session import LEAST_ROWS, Scratch, beside, lookup, star_links, table

MAX_ROUNDS = 200
JUMPS = 2
#: Wanted proportions, in the order in which the splits are dealt.
PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
SLICES = 1024


def round_of(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The picks (a, b, w) of one round and the map (v, c) of the trees that have links.

    links: (a, b, w) once each, a < b; w orders all links: weight, hash and the two records first linked.
    """
    ends = links.select(F.explode(F.array(F.struct("w", F.col("a").alias("v"), F.col("b").alias("to")), F.struct("w", F.col("b").alias("v"), F.col("a").alias("to")))).alias("l")).select("l.*")
    picks = scratch.write(ends.groupBy("v").agg(F.min(F.struct("w", "to")).alias("p")).select("v", F.col("p.to").alias("to"), F.col("p.w").alias("w")), "picks")
    # two trees that pick each other hang on the smaller one, which is a root
    other = picks.select(F.col("v").alias("to"), F.col("to").alias("back"))
    up = picks.join(other, "to", "left").select("v", F.when((F.col("back") == F.col("v")) & (F.col("v") < F.col("to")), F.col("v")).otherwise(F.col("to")).alias("c"))
    for _ in range(JUMPS):
        up = scratch.write(up, "up")
        fans = up.groupBy("c").agg(F.count("*").alias("n"))
        above = fans.join(up.select(F.col("v").alias("c"), F.col("c").alias("top")), "c")
        # a table that is looked through for hot keys is written first, so that it runs once
        above = above if up.count() < LEAST_ROWS else scratch.write(above, "above")
        up = lookup(up, above, "c", "n").select("v", F.col("top").alias("c"))
    return picks, scratch.write(up, "trees")


def contracted(links: DataFrame, trees: DataFrame) -> DataFrame:
    """The links between different trees, of several between two trees the least."""
    at = lambda end: trees.select(F.col("v").alias(end), F.col("c").alias(f"_{end}"))
    moved = links.join(at("a"), "a").join(at("b"), "b").where("_a <> _b")
    return moved.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("w").alias("w"))


def spanning_forest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest's links (a, b, weight) and (id, root) of every record that has a link; root is the smallest id.

    links: a, b, weight; those of small weight are taken first.
    """
    scratch = Scratch(links.sparkSession, "forest")
    ends = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    ends = ends.groupBy("a", "b").agg(F.min("weight").alias("weight"))
    rest = scratch.write(ends.select("a", "b", F.struct("weight", F.xxhash64("a", "b").alias("h"), F.col("a").alias("x"), F.col("b").alias("y")).alias("w")), "links")
    chosen, levels = [], []
    while not rest.isEmpty():
        if len(levels) == MAX_ROUNDS:
            raise RuntimeError(f"links are left after {MAX_ROUNDS} rounds")
        picks, trees = round_of(rest, scratch)
        after = scratch.write(contracted(rest, trees), "links")
        scratch.drop(rest)
        chosen.append(picks.select(F.col("w.x").alias("a"), F.col("w.y").alias("b"), F.col("w.weight").alias("weight")))
        levels.append(trees)
        rest = after
    if not levels:
        return ends.limit(0), ends.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)
    forest = scratch.write(reduce(DataFrame.unionByName, chosen).distinct(), "forest")
    assigned = compose(levels, scratch)
    roots = assigned.groupBy("c").agg(F.min("v").alias("root"), F.count("*").alias("n"))
    roots = scratch.write(roots, "roots")
    return forest, lookup(assigned, roots, "c", "n").select(F.col("v").alias("id"), "root")


def dealt(ids: DataFrame, rooted: DataFrame, proportions: tuple[tuple[str, float], ...] = PROPORTIONS, seed: int = 13) -> DataFrame:
    """(id, root, split): every id's tree goes to one split.

    ids: one column ``id``; rooted: (id, root) of those with relations.  The trees of a band of sizes stand in a
    pseudo-random order; a tree goes to the split in whose part of the band's records its middle falls.
    """
    scratch = Scratch(ids.sparkSession, "dealt")
    trees = ids.where("id is not null").select("id").distinct().join(rooted, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    trees = scratch.write(trees, "trees")
    sizes = trees.groupBy("root").agg(F.count("*").alias("n"))
    h = F.xxhash64(F.lit(seed), "root")
    sizes = sizes.select("root", "n", F.floor(F.log2("n")).cast("int").alias("band"), h.alias("h"), F.shiftrightunsigned(h, 54).cast("int").alias("slice"))
    sizes = scratch.write(sizes, "sizes")
    # the running sum in two steps, of slices and within a slice, so that no band meets in one task
    slices = sizes.groupBy("band", "slice").agg(F.sum("n").alias("m"))
    band = Window.partitionBy("band").orderBy("slice")
    slices = slices.withColumn("before", F.sum("m").over(band) - F.col("m")).withColumn("all", F.sum("m").over(Window.partitionBy("band")))
    inner = Window.partitionBy("band", "slice").orderBy("h", "root")
    placed = sizes.withColumn("own", F.sum("n").over(inner) - F.col("n") / 2).join(slices, ["band", "slice"])
    # a fixed turn of each band keeps the bands' rounding from adding up
    turn = F.pmod(F.col("band") * F.lit(0.6180339887), F.lit(1.0))
    at = F.pmod((F.col("before") + F.col("own")) / F.col("all") + turn, F.lit(1.0))
    split, edge = F.lit(proportions[-1][0]), 1.0
    for name, share in reversed(proportions):
        split, edge = F.when(at < edge, F.lit(name)).otherwise(split) if edge < 1 else F.lit(name), edge - share
    placed = placed.select("root", "n", split.alias("split"))
    return lookup(trees, scratch.write(placed, "placed"), "root", "n").select("id", "root", "split")


def sample_links(spark, sf_dir: str, samples: DataFrame) -> DataFrame:
    """(a, b, weight) of samples with a common source product (1), picture (2) or group of products (3)."""
    held = samples.select("sample_id", F.explode("source_product_ids").alias("product")).where("product is not null").distinct()
    pictures = named_pictures(samples, table(spark, sf_dir, "asset"))
    groups = product_groups(spark, sf_dir)
    products = table(spark, sf_dir, "all_product").where("source_product_id is not null").select(F.col("source_product_id").alias("product"), F.col("product_index").alias("id")).distinct()
    grouped = products.join(groups, "id").select("product", "group").distinct()
    related = held.join(grouped, "product").select("sample_id", "group").distinct()
    return (
        star_links(held, "product", "sample_id").withColumn("weight", F.lit(1))
        .unionByName(star_links(pictures, "picture", "sample_id").withColumn("weight", F.lit(2)))
        .unionByName(star_links(related, "group", "sample_id").withColumn("weight", F.lit(3)))
    )


def export_trees(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The latest samples and (id, root) of those with relations."""
    samples = latest_samples(spark, sf_dir)
    samples = Scratch(spark, "splits").write(samples, "samples")
    return samples, spanning_forest(sample_links(spark, sf_dir, samples))[1]


def parted_samples(spark, sf_dir: str) -> DataFrame:
    """(sample_id, group_id): samples of groups that stand in two or more splits at present."""
    samples, rooted = export_trees(spark, sf_dir)
    rooted = Scratch(spark, "splits").write(rooted, "rooted")
    named = samples.select(F.col("sample_id").alias("id"), split_name("split").alias("split"))
    spread = rooted.join(named, "id").groupBy("root").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.count("*").alias("n"))
    spread = Scratch(spark, "splits").write(spread.where("lo <> hi").select("root", "n"), "spread")
    return lookup(rooted, spread, "root", "n").select(F.col("id").alias("sample_id"), F.col("root").alias("group_id"))


def export_splits(spark, sf_dir: str) -> DataFrame:
    """(sample_id, group_id, split): new splits in the given proportions that part no related samples."""
    samples, rooted = export_trees(spark, sf_dir)
    return dealt(samples.select(F.col("sample_id").alias("id")), rooted).select(F.col("id").alias("sample_id"), F.col("root").alias("group_id"), "split")


def export_forest(spark, sf_dir: str) -> DataFrame:
    """(a, b, weight): the links of the spanning forest over the samples; weight tells a common product, picture or group of products."""
    samples = Scratch(spark, "splits").write(latest_samples(spark, sf_dir), "samples")
    return spanning_forest(sample_links(spark, sf_dir, samples))[0]


def split_report(spark, sf_dir: str) -> DataFrame:
    """(split, wanted, samples, share, parted): what each new split was to have and has, and the groups that stand in several splits."""
    found = Scratch(spark, "splits").write(export_splits(spark, sf_dir), "found")
    parted = found.groupBy("group_id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("parted"))
    wanted = spark.createDataFrame(list(PROPORTIONS), "split string, wanted double")
    sizes = found.groupBy("split").agg(F.count("*").alias("samples"))
    total = found.agg(F.count("*").alias("all"))
    out = beside(wanted.join(sizes, "split", "left"), total, parted)
    return out.select("split", "wanted", F.coalesce("samples", F.lit(0)).alias("samples"), F.try_divide(F.coalesce("samples", F.lit(0)), F.col("all")).alias("share"), "parted")
