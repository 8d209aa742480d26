"""Near-duplicate records with small edits.

Order MinHash.  A record is the sequence of its occurrence-labelled k-mers of words; each of SKETCHES hash functions
samples the ORDER labelled k-mers of smallest priority and keeps them in their text order, and records of a block that
hold the same ordered sample of the same function are candidates.  Priorities are weighted: k-mers that most records
of a block hold come late, those that fewer than about the square root of the block's records hold are all alike, so a
bucket stays small on average however large the block is.  How often a k-mer occurs in its block is read from a
count-min sketch of at most 2 ** COUNTERS counters, the only thing that is broadcast; it never counts too low, so a
sample with a k-mer that no other record can have makes no bucket.

A candidate has to pass a bound on its bit signatures (never missed by a near pair), then a banded alignment of both
texts, which gives their edit similarity: aligned words are common features, so a pair with enough of them is near.
The case is defined by common features whatever their order; pairs whose aligned words are too few (words moved) are
decided by the exact number of common features.

The search is a random one: a pair at the threshold is missed by all functions with a small chance (README).

Records with the same features are one class; pairs are made between classes only, and the classes' members are
expanded at the end.

Defined results: null ids, null categories and null or blank texts are in no pair; a repeated delivery counts
once; texts of any length are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.functions.text import filled, plain
from lodesift.llm.components import connected_groups
from lodesift.llm.sketch import flat, merged, mixed, seeds, unsigned
from lodesift.session import Scratch, table

THRESHOLD = 0.6
#: Hash functions, k-mers sampled by each, and words of a k-mer.
SKETCHES, ORDER, K = 64, 2, 1
#: A k-mer counts as frequent from FREQUENT times the square root of the block's records on; its weight falls with this power.
FREQUENT, POWER = 6.0, 1.3
#: At most 2 ** COUNTERS counters of two bytes.
COUNTERS = 24
CHUNK = 1 << 18  # padded places handled at once
ONE = np.uint64(1)


def labelled(words: np.ndarray, sizes: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mers with occurrence labels, their number in each record, occurrence numbers) of the records' words, end to end."""
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    kept = np.maximum(sizes - k + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(sizes)), kept)
    at = begin[owner] + (np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(kept)])[:-1], kept))
    mers = words[at]
    for j in range(1, k):
        inside = at + j < (begin + sizes)[owner]
        mers = mixed(mers * np.uint64(3) + np.where(inside, words[np.minimum(at + j, len(words) - 1)], np.uint64(0)))
    order = np.lexsort((mers, owner))
    same = np.concatenate([[False], (mers[order][1:] == mers[order][:-1]) & (owner[order][1:] == owner[order][:-1])])
    run = np.arange(len(order))
    number = np.empty(len(order), np.int64)
    number[order] = run - np.maximum.accumulate(np.where(same, 0, run))
    return np.where(number > 0, mixed(mers + number.astype(np.uint64)), mers), kept, number


class Counts:
    """A count-min sketch with one row: never too low, at most MOST."""

    MOST = 65_535

    def __init__(self, bits: int, counters: np.ndarray | None = None):
        self.bits = bits
        self.counters = np.zeros(1 << bits, np.uint16) if counters is None else counters

    def places(self, block: np.ndarray, mers: np.ndarray) -> np.ndarray:
        return (mixed(block * np.uint64(5) ^ mers) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, places: np.ndarray) -> None:
        at, n = np.unique(places, return_counts=True)
        self.counters[at] = np.minimum(self.MOST, self.counters[at] + n)

    def of(self, places: np.ndarray) -> np.ndarray:
        return self.counters[places]


def counted(sets: DataFrame, k: int, bits: int) -> Counts:
    """How often each block has each labelled k-mer, from all records."""

    def add(own: np.ndarray, batch: pa.RecordBatch) -> None:
        mers, kept, _ = labelled(*flat(batch.column("words")), k)
        counts = Counts(bits, own)
        counts.add(counts.places(np.repeat(unsigned(batch.column("block")), kept), mers))

    capped = lambda x, y: np.minimum(x.astype(np.int64) + y, Counts.MOST).astype(np.uint16)
    return Counts(bits, merged(sets, ["block", "words"], 1 << bits, np.uint16, add, capped))


def ordered_samples(mers: np.ndarray, kept: np.ndarray, cost: np.ndarray, fit: np.ndarray, block: np.ndarray, sketches: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(record, bucket) of every record's samples: the ``order`` k-mers of least priority in text order.

    cost: how late a k-mer comes; fit: whether another record can have it, without which a sample makes no bucket.
    """
    begin = np.concatenate([[0], np.cumsum(kept)])[:-1]
    rows, keys, salts = [], [], seeds(sketches)
    short_salts = (salts >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    by_size = np.argsort(kept, kind="stable")
    by_size = by_size[kept[by_size] >= order]
    at = 0
    while at < len(by_size):
        most = int(kept[by_size[min(len(by_size) - 1, at + 255)]])
        n = max(1, min(256, CHUNK // most))
        who = by_size[at : at + n]
        most = int(kept[who[-1]])
        at += n
        place = begin[who][:, None] + np.minimum(np.arange(most), kept[who][:, None] - 1)
        token, late, ok = mers[place], cost[place], fit[place]
        late = np.where(np.arange(most) < kept[who][:, None], late, np.float32(np.inf))
        line = np.arange(len(who))[:, None]
        short = (mixed(token) >> np.uint64(32)).astype(np.uint32)
        for r in range(sketches):
            level = short * short_salts[r]
            level ^= level >> np.uint32(15)
            level *= np.uint32(0x2C1B3C6D)
            priority = level.astype(np.float32)
            priority *= late
            chosen = np.argpartition(priority, order - 1, axis=1)[:, :order] if most > order else np.broadcast_to(np.arange(order), (len(who), order))
            chosen = np.sort(chosen, axis=1)
            good = ok[line, chosen].all(1)
            key = block[who] + salts[r]
            for j in range(order):
                key = mixed(key * np.uint64(3) + token[line[:, 0], chosen[:, j]])
            rows.append(who[good])
            keys.append(key[good])
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def buckets(sets: DataFrame, sketches: int, order: int, k: int) -> DataFrame:
    """(key, cls, n, bits): a row for each sample of each class, with its number of features and bit signature.

    sets: cls and block as bigint, words as array<bigint> in text order.
    """
    words = sets.agg(F.sum(F.size("words"))).first()[0] or 0
    bits = int(min(COUNTERS, max(12, int(4 * words).bit_length())))
    counts = counted(sets, k, bits)
    held = sets.sparkSession.sparkContext.broadcast(counts.counters)
    sizes = sets.groupBy("block").agg(F.count("*").alias("records"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counts(bits, held.value)
        for batch in batches:
            words, size = flat(batch.column("words"))
            block, records = unsigned(batch.column("block")), batch.column("records").to_numpy().astype(np.float64)
            mers, kept, number = labelled(words, size, k)
            often = known.of(known.places(np.repeat(block, kept), mers))
            cost = np.maximum(often, np.repeat(FREQUENT * np.sqrt(records), kept)) ** POWER
            rows, keys = ordered_samples(mers, kept, cost.astype(np.float32), often > 1, block, sketches, order)
            single, ones, first = labelled(words, size, 1)
            signature, n = signatures(single, ones, first)
            columns = [keys.view(np.int64), unsigned(batch.column("cls"))[rows].view(np.int64), n[rows].astype(np.int32), signature[rows].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "cls", "n", "bits"])

    # the blocks' sizes are left to Spark's own size check: a row a block
    return sets.join(sizes, "block").select("cls", "block", "records", "words").mapInArrow(run, "key bigint, cls bigint, n int, bits bigint")


def signatures(words: np.ndarray, kept: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each record, a bit flipped for each different word, and the number of those.

    Two records' signatures differ in at most as many bits as they have features that the other lacks.
    """
    owner = np.repeat(np.arange(len(kept)), kept)[number == 0]
    bit = np.left_shift(ONE, mixed(words[number == 0] + np.uint64(77)) & np.uint64(63))
    out = np.zeros(len(kept), np.uint64)
    np.bitwise_xor.at(out, owner, bit)
    return out, np.bincount(owner, minlength=len(kept))


def needed(n_a, n_b, threshold: float):
    """Common features that two records need for the threshold."""
    return np.ceil(threshold * (n_a + n_b) / (1 + threshold) - 1e-9).astype(np.int64)


def candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: classes of one bucket whose signatures allow the threshold; hot buckets are left to AQE's skew split."""
    end = lambda name: rows.select("key", *[F.col(c).alias(f"{c}_{name}") for c in ("cls", "n", "bits")])
    apart = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b")))
    total = F.col("n_a") + F.col("n_b")
    most = total - 2 * F.ceil(total * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    met = end("a").join(end("b"), "key").where("cls_a < cls_b").where(apart <= most)
    return met.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()


def aligned_words(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Words that an alignment of each row of a with the same row of b matches, within ``band`` places of the diagonal.

    a and b are padded with different fillers that match nothing.
    """
    above = np.zeros((len(a), b.shape[1] + 1), np.int32)
    for i in range(a.shape[1]):
        lo, hi = max(0, i - band), min(b.shape[1], i + band + 1)
        if lo >= hi:
            break
        row = above.copy()
        row[:, lo + 1 : hi + 1] = np.maximum(above[:, lo + 1 : hi + 1], above[:, lo:hi] + (a[:, i, None] == b[:, lo:hi]))
        row[:, lo + 1 :] = np.maximum.accumulate(row[:, lo + 1 :], axis=1)
        above = row
    return above[:, -1]


def padded(values: np.ndarray, sizes: np.ndarray, who: np.ndarray, filler: int) -> np.ndarray:
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    most = int(sizes[who].max())
    place = np.minimum(begin[who][:, None] + np.arange(most), max(0, len(values) - 1))
    return np.where(np.arange(most) < sizes[who][:, None], values[place], np.uint64(filler))


def aligned(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity, edit_similarity) of the pairs that reach the threshold.

    pairs: a, b and the features of both as hashes, distinct and in text order.  The edit similarity is the aligned share of
    both texts; a pair that it does not carry over the threshold by itself is decided by the exact common features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, n), (y, m) = flat(batch.column("a_features")), flat(batch.column("b_features"))
            need, total = needed(n, m, threshold), n + m
            matched = np.zeros(len(n), np.int64)
            order = np.argsort(total, kind="stable")
            at = 0
            while at < len(order):
                count = max(1, min(2048, CHUNK // max(1, int(total[order[min(len(order) - 1, at + 2047)]]))))
                who = order[at : at + count]
                at += count
                # a pair of the threshold has at most this many words without a partner
                band = int((total[who] - 2 * need[who]).max())
                matched[who] = aligned_words(padded(x, n, who, 1), padded(y, m, who, 2), band)
            common = matched.copy()
            begin_a, begin_b = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(m)])
            for i in np.flatnonzero(matched < need):
                common[i] = len(np.intersect1d(x[begin_a[i] : begin_a[i + 1]], y[begin_b[i] : begin_b[i + 1]], assume_unique=True))
            near = common >= need
            # an alignment may leave out common words that moved; the similarity counts them
            for i in np.flatnonzero(near & (matched >= need)):
                common[i] = len(np.intersect1d(x[begin_a[i] : begin_a[i + 1]], y[begin_b[i] : begin_b[i + 1]], assume_unique=True))
            columns = [batch.column("a").filter(pa.array(near)), batch.column("b").filter(pa.array(near)), pa.array((common / (total - common))[near]), pa.array((2 * matched / total)[near])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "similarity", "edit_similarity"])

    return pairs.select("a", "b", "a_features", "b_features").mapInArrow(run, "a bigint, b bigint, similarity double, edit_similarity double")


def classes(records: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(cls, name, block, words, features) of each distinct block and feature set; (id, cls) of each record.

    records: id, block, words (in text order, may repeat).  cls is a hash of block and features, name the smallest id;
    words are hashed in text order, those of the record of the smallest id.
    """
    kept = records.where("id is not null and block is not null and size(words) > 0")
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    rows = kept.select("id", F.xxhash64("block").alias("block"), hashed.alias("words"))
    rows = rows.withColumn("cls", F.xxhash64("block", F.array_sort(F.array_distinct("words")))).distinct()
    rows = scratch.write(rows, "records")
    named = rows.groupBy("cls").agg(F.min(F.struct("id", "block", "words")).alias("r"))
    named = named.select("cls", F.col("r.id").alias("name"), F.col("r.block").alias("block"), F.col("r.words").alias("words"))
    return scratch.write(named, "classes"), rows.select("id", "cls").distinct()


def near_classes(sets: DataFrame, threshold: float, scratch: Scratch, sketches: int = SKETCHES, order: int = ORDER, k: int = K) -> DataFrame:
    """(a, b, similarity, edit_similarity), a < b: the classes of a block whose common share of features reaches the threshold."""
    rows = buckets(sets.select("cls", "block", "words"), sketches, order, k)
    pairs = scratch.write(candidates(rows, threshold), "candidates")
    at = lambda end: sets.select(F.col("cls").alias(end), F.array_distinct("words").alias(f"{end}_features"))
    return aligned(pairs.join(at("a"), "a").join(at("b"), "b"), threshold)


def near_records(records: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a, b, similarity, edit_similarity) and membership (id, cls, name of the class)."""
    scratch = Scratch(records.sparkSession, "near")
    sets, members = classes(records, scratch)
    members = scratch.write(members.join(sets.select("cls", "name"), "cls").select("id", "cls", "name"), "members")
    return scratch.write(near_classes(sets, threshold, scratch), "pairs"), members


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b): every pair of different ids of near classes or of one class."""
    at = lambda end: members.select(F.col("cls").alias(end), F.col("id").alias(f"id_{end}"))
    many = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    both = pairs.select("a", "b").unionByName(many).join(at("a"), "a").join(at("b"), "b").where("id_a <> id_b")
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group_id, links) of all records near another one: links counts the classes near the record's own."""
    names = members.select("cls", "name").distinct()
    at = lambda end: names.select(F.col("cls").alias(end), F.col("name").alias(f"{end}_name"))
    linked = connected_groups(pairs.join(at("a"), "a").join(at("b"), "b").select(F.col("a_name").alias("a"), F.col("b_name").alias("b")))
    both = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    sizes = members.join(members.groupBy("cls").agg(F.count("*").alias("n")), "cls")
    return (
        sizes.join(linked.withColumnRenamed("id", "name"), "name", "left").join(both, "cls", "left")
        .where("group is not null or n > 1")
        .select("id", F.coalesce("group", "name").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def product_records(spark, sf_dir: str) -> DataFrame:
    """(id, block, words) of all_product: words of the title, then the image ids."""
    rows = table(spark, sf_dir, "all_product").where(filled("title"))
    images = F.concat(F.array(F.col("images.main.image_id")), F.coalesce(F.transform("images.detail", lambda d: d["image_id"]), F.array().cast("array<string>")))
    words = F.regexp_extract_all(F.lower("title"), F.lit("([a-z0-9]+)"))
    words = F.concat(words, F.filter(F.coalesce(images, F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return rows.select(F.col("product_id").alias("id"), plain("category").alias("block"), words.alias("words"))


def product_pairs(spark, sf_dir: str) -> DataFrame:
    pairs, members = near_records(product_records(spark, sf_dir))
    return expanded(pairs, members).toDF("product_id_a", "product_id_b")


def product_groups(spark, sf_dir: str) -> DataFrame:
    pairs, members = near_records(product_records(spark, sf_dir))
    return groups(pairs, members).withColumnRenamed("id", "product_id")
