"""Building blocks for labelled variants of records."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodesift.functions.hashing import hex16
from lodesift.functions.text import normalized
from lodesift.session import Scratch, ranked


def nearest_donor(rows: DataFrame, key: str, block: str, same: list[str]) -> DataFrame:
    """(key, donor): the smallest other key of the block whose ``same`` columns agree, if need be of the whole block.

    The two smallest keys of each group are enough to name every row's donor, so no pairs are made.
    """
    def two(by: list[str], name: str) -> DataFrame:
        first = rows.groupBy(*by).agg(F.min(key).alias(f"{name}1"))
        rest = rows.join(first, by).where(F.col(key) != F.col(f"{name}1")).groupBy(*by).agg(F.min(key).alias(f"{name}2"))
        return first.join(rest, by, "left")

    other = lambda n: F.when(F.col(key) != F.col(f"{n}1"), F.col(f"{n}1")).otherwise(F.col(f"{n}2"))
    out = rows.join(two([block, *same], "s"), [block, *same], "left").join(two([block], "b"), block, "left")
    return out.select(key, F.coalesce(other("s"), other("b")).alias("donor"))


def least_two(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, _1, _2): the two smallest keys of each group, _2 null if there is one only; a task sends no more than these keys of a group."""
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy(key))
    return rows.withColumn("_place", place).where("_place <= 2").groupBy(*by).agg(F.min(key).alias("_1"), F.nullif(F.max(key), F.min(key)).alias("_2"))


def compatible_donor(rows: DataFrame, key: str, block: str, fields: tuple[str, ...] = ("color", "material"), fallback: bool = False) -> DataFrame:
    """(key, donor), one for each row: the smallest other key of the block whose fields agree or are empty on a side; null if there is none.

    fallback: then the smallest other key of the whole block.  Rows of a block with the same values are one class.  The two smallest keys of each
    class give those of each combination of values, any value among them, and these the two that a class may take, so no pairs of rows are made and
    each row looks up its class once.
    """
    empty, any_ = "\x00empty", "\x00any"
    value = lambda f: F.coalesce(F.nullif(normalized(f), F.lit("")), F.lit(empty))
    held = rows.select(key, F.col(block).alias("_b"), *[value(f).alias(f) for f in fields])
    by, own = ["_b", *fields], [f"_own{i}" for i in range(len(fields))]
    classes = least_two(held.where(F.col(key).isNotNull() & F.col("_b").isNotNull()), by, key)
    views = classes.select("_b", *[F.array(F.col(f), F.lit(any_)).alias(f) for f in fields], F.explode(F.array_compact(F.array("_1", "_2"))).alias(key))
    for f in fields:
        views = views.withColumn(f, F.explode(f))
    two = least_two(views, by, key)
    # a filled value meets itself and empty ones, an empty value meets any; in the whole block (not _fits) all do
    asked = classes.select("_b", *fields, *[F.col(f).alias(o) for f, o in zip(fields, own, strict=True)], F.explode(F.array(*[F.lit(x) for x in (True, False)[: 1 + fallback]])).alias("_fits"))
    for f in fields:
        met = F.when(~F.col("_fits") | (F.col(f) == empty), F.array(F.lit(any_))).otherwise(F.array(F.col(f), F.lit(empty)))
        asked = asked.withColumn(f, F.explode(met))
    # Spark guesses a side's size from compressed files and without what was exploded: by that guess it would send large sides through the driver
    both = lambda fits: F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.when(F.col("_fits") == fits, F.array("_1", "_2")))))))
    found = asked.hint("merge").join(two.hint("merge"), by).groupBy("_b", *own).agg(both(True).alias("_fit"), both(False).alias("_all"))
    found = found.select("_b", *[F.col(o).alias(f) for f, o in zip(fields, own, strict=True)], "_fit", "_all")
    other = lambda a: F.when(F.col(key) != F.get(a, F.lit(0)), F.get(a, F.lit(0))).when(F.col(key).isNotNull(), F.get(a, F.lit(1)))
    each = held.join(found.hint("merge"), by, "left").groupBy(key).agg(F.min(other("_fit")).alias("_fit"), F.min(other("_all")).alias("_all"), F.count("*").alias("_n"))
    return each.select(key, F.coalesce("_fit", "_all").alias("donor"), F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).drop("col")


def farthest_value(rows: DataFrame, key: str, value: str, distance, candidates: DataFrame, seed: int = 42) -> DataFrame:
    """(key, value, chosen): the distinct candidate farthest from the row's value, ties by a hash of seed, key and candidate.

    Distances are taken once for each pair of distinct values; what a row looks up are the candidates that tie for the farthest.  Distinct values
    are few against rows; how the two lists of them meet is left to Spark's own size check.
    """
    own = rows.select(value).where(F.col(value).isNotNull()).distinct()
    others = candidates.select(F.col(value).alias("_c")).where(F.coalesce(F.col("_c") != "", F.lit(False))).distinct()
    pairs = own.join(others, normalized(value) != normalized("_c")).select(value, "_c", F.round(distance(F.col(value), F.col("_c")), 9).alias("_d"))
    best = pairs.groupBy(value).agg(F.max("_d").alias("_d")).join(pairs, [value, "_d"]).groupBy(value).agg(F.collect_list("_c").alias("_ties"))
    order = lambda c: F.struct(hex16(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), c)).alias("h"), c.alias("c"))
    return rows.select(key, value).join(best, value, "left").select(key, value, F.array_max(F.transform("_ties", order))["c"].alias("chosen"))


def turn(order: list[Column], names: tuple[str, ...], by: list[str], apart: int = 1) -> Column:
    """Names dealt in turn along the order of a group; with ``apart`` each name is kept for so many rows, so two turns do not go together."""
    n = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / apart)
    return F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))


def expanded(rows: DataFrame, key: str, labels: str) -> DataFrame:
    """A row for each label, numbered from 0, with id ``key_nn``."""
    out = rows.select("*", F.posexplode(labels).alias("sample_index", "label"))
    return out.withColumn("sample_id", F.concat_ws("_", key, F.lpad(F.col("sample_index").cast("string"), 2, "0")))


def adjusted_quota(quota: dict[str, int], capacity: dict[str, int], records: int, each: int = 3, rest: str = "pass") -> dict[str, int]:
    """The quotas with what exceeds a label's capacity moved to ``rest``; they must come to ``each`` labels a record."""
    out = dict(quota)
    for label, most in capacity.items():
        over = out.get(label, 0) - most
        if over > 0:
            out[label] = most
            out[rest] = out.get(rest, 0) + over
    if sum(out.values()) != each * records:
        raise ValueError(f"the quotas come to {sum(out.values())}, not {each} for each of {records} records")
    return out


def class_flow(classes: dict[tuple[str, ...], int], quotas: dict[str, int], each: int) -> dict[tuple[tuple[str, ...], str], int]:
    """How many records of each class get each label, by maximum flow; raises if the quotas cannot be met.

    classes: the records by the labels that they may have.  A label goes to a record once, so a class takes a label as often as it has records at most.
    """
    left: dict[tuple, int] = {}
    near: dict[object, list] = {}

    def edge(a: object, b: object, most: int) -> None:
        left[a, b], left[b, a] = most, 0
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)

    for label in sorted(quotas):
        edge("begin", label, quotas[label])
    for labels, n in sorted(classes.items()):
        for label in labels:
            edge(label, labels, n)
        edge(labels, "end", each * n)
    flow = 0
    while True:
        came, queue = {"begin": None}, deque(["begin"])
        while queue and "end" not in came:
            at = queue.popleft()
            for to in near.get(at, []):
                if to not in came and left[at, to] > 0:
                    came[to] = at
                    queue.append(to)
        if "end" not in came:
            break
        path, at = [], "end"
        while came[at] is not None:
            path.append((came[at], at))
            at = came[at]
        step = min(left[e] for e in path)
        for a, b in path:
            left[a, b] -= step
            left[b, a] += step
        flow += step
    if flow != each * sum(classes.values()) or flow != sum(quotas.values()):
        raise ValueError("the quotas cannot be met")
    return {(labels, label): left[labels, label] for labels in classes for label in labels if label in quotas and left[labels, label]}


def allocated(rows: DataFrame, key: str, eligible: dict[str, Column], quotas: dict[str, int], each: int = 3, seed: int = 42) -> DataFrame:
    """(key, labels): exactly ``each`` different labels for every record, every label as often as its quota.

    The quotas are solved for classes of records that may have the same labels, of which there are 2 ** labels at most whatever the number of records.
    Within a class the labels' shares stand one after the other on a ring of ``each`` rounds; the record of rank r takes the places r, r + n, r + 2n ...,
    which are of different labels because none has more than n places.
    """
    names = sorted(quotas)
    may = F.filter(F.array(*[F.when(F.coalesce(eligible.get(n, F.lit(True)), F.lit(False)), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    scratch = Scratch(rows.sparkSession, "allocated")
    held = scratch.write(rows.select(key, may.alias("_may")), "eligible")
    classes = {tuple(r["_may"]): r["n"] for r in held.groupBy("_may").agg(F.count("*").alias("n")).collect()}
    given = class_flow(classes, quotas, each)
    shares = []
    for labels, n in classes.items():
        bounds, total = [], 0
        for label in labels:
            total += given.get((labels, label), 0)
            bounds.append(total)
        shares.append((list(labels), n, bounds))
    of = rows.sparkSession.createDataFrame(shares, "_may array<string>, _n bigint, _bounds array<bigint>")
    placed = ranked(held, ["_may"], key, "_rank", seed).join(F.broadcast(of), "_may")  # a row a class
    label_at = lambda j: F.get("_may", F.size(F.filter("_bounds", lambda b: b <= F.col("_rank") + F.lit(j) * F.col("_n"))))
    return placed.select(key, F.array_sort(F.array(*[label_at(j) for j in range(each)])).alias("labels"))


def resampled(rows: DataFrame, key: str, product: str, label: str, quotas: dict[str, int], per_product: int, seed: int = 42) -> DataFrame:
    """A training selection: at most ``per_product`` rows a product, then at most its quota of each label, both in hash order."""
    h = hex16(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    few = rows.withColumn("_h", h).withColumn("_n", F.row_number().over(Window.partitionBy(product).orderBy("_h", key))).where(F.col("_n") <= per_product)
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(label) == name, F.lit(n)).otherwise(quota)
    # the largest quota as a literal lets Spark cut each task's rows of a label before they are shuffled
    return few.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy("_h", key))).where(F.col("_n") <= max(quotas.values(), default=0)).where(F.col("_n") <= quota).drop("_h", "_n")


def duplicated_detail(images: str = "images") -> Column:
    """The pictures with the first detail in the place of the second."""
    first = F.get(F.col(f"{images}.detail"), F.lit(0))
    return F.struct(F.col(f"{images}.main").alias("main"), F.array(first, first).alias("detail"))


def swapped_detail(index: Column, donor: str, images: str = "images") -> tuple[Column, Column]:
    """The pictures with the donor's detail in the place that the sample's number (from 1) names, and that place."""
    place = (index - 1) % 2
    pick = lambda n: F.when(place == n, F.get(F.col(f"{donor}.detail"), F.lit(n))).otherwise(F.get(F.col(f"{images}.detail"), F.lit(n)))
    return F.struct(F.col(f"{images}.main").alias("main"), F.array(pick(0), pick(1)).alias("detail")), F.concat(F.lit("detail:"), (place + 1).cast("string"))


def stage_and_split(target: Column) -> tuple[Column, Column]:
    """Stage and split that the name of a target set stands for."""
    stage = F.when(target == "test", F.lit("test")).when(target.startswith("sft_"), F.lit("sft")).otherwise(F.lit("grpo"))
    return stage, F.when(target == "test", F.lit("test")).when(target.endswith("_valid"), F.lit("validation")).otherwise(F.lit("train"))


def made(rows: DataFrame, key: str = "product_id") -> DataFrame:
    """A sample for each label of each record, changed as the label says.

    rows: key, title, category, images, labels (array) and donor (struct of title and images, null where there is none).
    duplicate_detail_image doubles the first detail, wrong_image takes the donor's detail, title_mismatch its title; a sample that needs a donor and has
    none is left out.  Other labels keep the record; attribute labels are changed by ``title.mutation``.
    """
    flat_rows = rows.select("*", F.posexplode("labels").alias("_pos", "violation_type")).withColumn("sample_index", F.col("_pos") + 1)
    flat_rows = flat_rows.where(~F.col("violation_type").isin("wrong_image", "title_mismatch") | F.col("donor").isNotNull())
    kind = F.col("violation_type")
    swapped, place = swapped_detail(F.col("sample_index"), "donor.images")
    images = F.when(kind == "duplicate_detail_image", duplicated_detail()).when(kind == "wrong_image", swapped).otherwise(F.struct(F.col("images.main").alias("main"), F.col("images.detail").alias("detail")))
    return flat_rows.select(
        F.concat_ws("_", key, F.lpad(F.col("sample_index").cast("string"), 2, "0")).alias("product_id"), F.col(key).alias("source_product_id"), "sample_index", kind, difficulty(kind).alias("difficulty"),
        F.when(kind == "title_mismatch", F.col("donor.title")).otherwise(F.col("title")).alias("title"), "category", images.alias("images"), F.when(kind == "wrong_image", place).alias("target_image_ref"),
    )


#: Difficulty of a label in made samples.
DIFFICULTY = {"easy": ("pass", "duplicate_detail_image", "image_quality"), "medium": ("category_mismatch", "wrong_image", "color_mismatch"), "hard": ("title_mismatch", "material_mismatch")}


def difficulty(label: str | Column, levels: dict[str, tuple[str, ...]] = DIFFICULTY) -> Column:
    c, out = F.col(label) if isinstance(label, str) else label, F.lit(None).cast("string")
    for level, labels in levels.items():
        out = F.when(c.isin(*labels), F.lit(level)).otherwise(out)
    return out
