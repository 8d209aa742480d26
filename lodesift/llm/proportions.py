"""Samples whose shares of categories follow given targets.

One pass over the records fills a reservoir for every target: each record has a fixed pseudo-random priority, and a task's
reservoir of a target holds the records of lowest priority that it has met, as many as the target's quota can come to at
most, beside the exact number of those it has met.  Reservoirs merge: the records of lowest priority of a target are among
those of its tasks' reservoirs.  When the counts are final, the quotas follow from the number of distinct ids, and the
merged reservoirs are trimmed to them, range of priorities by range, so that no target meets in one task: a uniform
sample of the target's records.

Defined results: null ids are no records; null values match nothing; a target without restrictions matches every
record; an id counts once however often it is delivered; a target that asks for more records than there are gets
all of them and is reported as exhausted; an empty table exhausts every target that asks for any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodesift.functions.hashing import col
from lodesift.functions.text import plain
from lodesift.session import Scratch, table

FIELDS = ("violation_type", "difficulty", "category")
#: The smallest share of all records that a sample of one target set may hold, as 1 / SAMPLE_PART.
SAMPLE_PART = 5
#: Hexadecimal digits of a priority; a range of priorities is named by its first bits.
DIGITS, RANGE_BITS = 13, 10


def priority(key: str | Column, seed: int) -> Column:
    """A fixed pseudo-random number of 52 bits."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), col(key).cast("string")), 256), 1, DIGITS), 16, 10).cast("bigint")


def need(share_bp: Column, min_rows: Column, n: int) -> Column:
    """Records that a target asks for if the sample has n."""
    return F.greatest(F.coalesce(min_rows, F.lit(0)), F.floor((F.coalesce(share_bp, F.lit(0)) * F.lit(n) + 9999) / 10000)).cast("bigint")


def restriction(fields: list[Column]) -> Column:
    """Bit i is set where field i is not null."""
    out = F.lit(0)
    for i, f in enumerate(fields):
        out = out + F.when(f.isNotNull(), F.lit(1 << i)).otherwise(0)
    return out


def matched(records: DataFrame, wanted: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(target_id, id, most) of every record and every target that it matches, once each, and of every record with target_id null.

    wanted: target_id, most and the plain fields.  A record's different cells come together first, so repeated deliveries are
    dropped before they are shuffled and each record is in one task.
    """
    names = [f"_{f}" for f in fields]
    wanted = wanted.withColumn("_mask", restriction([F.col(n) for n in names])).fillna("", names)
    masks = sorted(r[0] for r in wanted.select("_mask").distinct().collect())  # at most 2 ** len(fields) numbers
    every = wanted.limit(0).select("target_id", "most", "_mask", *names)
    nothing = wanted.sparkSession.range(1).select(F.lit(None).cast(wanted.schema["target_id"].dataType).alias("target_id"), F.lit(0).cast("bigint").alias("most"), F.lit(-1).alias("_mask"), *[F.lit("").alias(n) for n in names])
    wanted = every.unionByName(wanted.select("target_id", "most", "_mask", *names)).unionByName(nothing)
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.struct(*[plain(f).alias(n) for f, n in zip(fields, names, strict=True)]).alias("cell"))
    cells = rows.groupBy("id").agg(F.collect_set("cell").alias("cells"))

    def views(c: Column) -> Column:
        out = [F.struct(F.lit(-1).alias("_mask"), *[F.lit("").alias(n) for n in names])]
        for mask in masks:
            used = [c[n] if mask >> i & 1 else F.lit("") for i, n in enumerate(names)]
            full = F.lit(True)
            for u in used:
                full = full & u.isNotNull()
            out.append(F.when(full, F.struct(F.lit(mask).alias("_mask"), *[u.alias(n) for u, n in zip(used, names, strict=True)])))
        return F.filter(F.array(*out), lambda x: x.isNotNull())

    flat = cells.select("id", F.explode(F.array_distinct(F.flatten(F.transform("cells", views)))).alias("v")).select("id", "v.*")
    return flat.join(wanted, ["_mask", *names]).select("target_id", "id", "most")


class Reservoir:
    """The (priority, id) of lowest priority among those added, ``most`` of them and those that tie with the last."""

    def __init__(self, most: int):
        self.most, self.seen, self.bound = most, 0, None
        self.priority, self.ids = np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, priority_: np.ndarray, ids: np.ndarray) -> None:
        self.seen += len(ids)
        if not self.most:
            return
        if self.bound is not None:
            near = priority_ <= self.bound
            priority_, ids = priority_[near], ids[near]
        self.priority, self.ids = np.concatenate([self.priority, priority_]), np.concatenate([self.ids, ids])
        if len(self.ids) > 2 * self.most:
            self.trim()

    def trim(self) -> None:
        if len(self.ids) > self.most:
            self.bound = np.partition(self.priority, self.most - 1)[self.most - 1]
            near = self.priority <= self.bound
            self.priority, self.ids = self.priority[near], self.ids[near]


def reservoirs(pairs: DataFrame, seed: int) -> DataFrame:
    """(target_id, n, priority, id): for each task and target a row with the number met, n, and the rows of its reservoir."""
    kind, id_kind = (pairs.schema[c].dataType.simpleString() for c in ("target_id", "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, Reservoir] = {}
        types = None
        for batch in batches:
            types = types or (batch.column("target_id").type, batch.column("id").type)
            codes = batch.column("target_id").dictionary_encode()
            code = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            names = codes.dictionary.to_pylist()
            order = np.argsort(code, kind="stable")
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(object)
            level, most = batch.column("priority").to_numpy(), batch.column("most").to_numpy()
            for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else ():
                name = None if code[at[0]] < 0 else names[code[at[0]]]
                held.setdefault(name, Reservoir(int(most[at[0]]))).add(level[at], ids[at])
        for name, r in held.items():
            r.trim()
            columns = [[name] * (len(r.ids) + 1), [r.seen] + [None] * len(r.ids), [None, *r.priority.tolist()], [None, *r.ids.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (types[0], pa.int64(), pa.int64(), types[1]), strict=True)], ["target_id", "n", "priority", "id"])

    return pairs.select("target_id", "id", "most", priority("id", seed).alias("priority")).mapInArrow(run, f"target_id {kind}, n bigint, priority bigint, id {id_kind}")


def proportional_sample(
    records: DataFrame, targets: DataFrame, key: str = "product_id", fields: tuple[str, ...] = FIELDS, size: int | None = None, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """The sample (target_set, target_id, id) and the report (target_set, target_id, need, available, taken, exhausted).

    targets: target_id, target_set, the fields (null: not restricted), share_bp and min_rows.
    size: records that a target set's sample is to have; a fifth of the records by default.
    """
    scratch = Scratch(records.sparkSession, "proportions")
    # a quota follows from the number of ids; the number of rows bounds it before the pass (Parquet keeps it in its footers)
    bound = records.count() // SAMPLE_PART if size is None else size
    wanted = targets.select("target_id", need(F.col("share_bp"), F.col("min_rows"), bound).alias("most"), *[plain(f).alias(f"_{f}") for f in fields])
    held = scratch.write(reservoirs(matched(records, wanted, key, fields), seed), "reservoirs")
    counts = held.where("n is not null").groupBy("target_id").agg(F.sum("n").alias("available"))
    total = counts.where("target_id is null").agg(F.sum("available")).first()[0] or 0
    quota = targets.select("target_id", "target_set", need(F.col("share_bp"), F.col("min_rows"), total // SAMPLE_PART if size is None else size).alias("need"))
    kept = held.where("id is not null").select("target_id", "id", "priority", F.shiftright("priority", 4 * DIGITS - RANGE_BITS).alias("range"))
    ranges = kept.groupBy("target_id", "range").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("target_id").orderBy("range")) - F.col("m")
    cuts = ranges.withColumn("before", before).join(quota, "target_id").where("before < need").select("target_set", "target_id", "range", (F.col("need") - F.col("before")).alias("left"))
    place = F.row_number().over(Window.partitionBy("target_id", "range").orderBy("priority", "id"))
    trimmed = kept.join(cuts, ["target_id", "range"]).withColumn("place", place).where("place <= left")
    sample = scratch.write(trimmed.select("target_set", "target_id", "id"), "sample")
    taken = sample.groupBy("target_id").agg(F.count("*").alias("taken"))
    report = (
        quota.join(counts, "target_id", "left").join(taken, "target_id", "left").fillna(0, ["available", "taken"])
        .select("target_set", "target_id", "need", "available", "taken", (F.col("taken") < F.col("need")).alias("exhausted"))
    )
    return sample, report


def product_sample(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return proportional_sample(table(spark, sf_dir, "all_product"), table(spark, sf_dir, "sample_target"))
