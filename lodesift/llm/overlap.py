"""Same or near-same records across splits.

The evaluation records' keys, written as words, are spread by hash over shards; each shard is held as a compressed
full-text index: the Burrows-Wheeler transform with sampled rank counts and a sampled suffix array.  The training records'
words are streamed through backward search on their shard, which gives the longest suffix of each word that the index
holds; a match that is maximal on both sides, from separator to separator, is kept and located in the text, and the located
line is the evaluation word that it meets.  A training record is the sequence of its words; the words that a pair of
records has in common are spans of that sequence, which are merged where they touch and counted.

A picture with a perceptual hash has one word for every choice of two of six slices of its bits: hashes that differ
in at most four bits agree in at least two slices, so none is missed; located hashes are compared on all their bits in the shard.

Defined results: samples without a split, an id or resolvable pictures overlap through what they have; a repeated
delivery counts once; null hashes are near nothing; empty tables give an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.llm.pictures import latest_samples, named_pictures, split_name
from lodesift.session import Scratch, partitions, table

NEAR_BITS = 4
SLICES = 6
BLOCK = 64
SHARD_WORDS = 400_000
SEPARATOR = 10
#: Every SAMPLED-th character's place is kept in the index; hashes looked up at once.
SAMPLED, CHUNK = 8, 100_000
CUTS = [round(64 * i / SLICES) for i in range(SLICES + 1)]
CHOICES = list(combinations(range(SLICES), SLICES - NEAR_BITS))


class FullTextIndex:
    """Backward search over a text of lines; the text begins with a separator, every line ends with one, and a zero byte ends it."""

    def __init__(self, text: np.ndarray):
        order = self.suffixes(text)
        self.bwt = text[order - 1]
        self.size = len(text)
        present = np.flatnonzero(np.bincount(text, minlength=256))
        self.code = np.full(256, -1, np.int16)
        self.code[present] = np.arange(len(present))
        coded = self.code[self.bwt].astype(np.uint8)
        pad = -len(coded) % BLOCK
        self.blocks = np.pad(coded, (0, pad + BLOCK), constant_values=255).reshape(-1, BLOCK)
        counts = np.stack([(self.blocks == c).sum(1, dtype=np.int64) for c in range(len(present))], 1)
        self.before = np.zeros((len(self.blocks) + 1, len(present)), np.int32)
        np.cumsum(counts, 0, out=self.before[1:])
        self.first = np.zeros(len(present) + 1, np.int64)
        np.cumsum(np.bincount(coded, minlength=len(present)), out=self.first[1:])
        # places in the text are kept for every SAMPLED-th character only
        self.rows = np.flatnonzero(order % SAMPLED == 0).astype(np.int32)
        self.places = order[self.rows].astype(np.int32)
        self.ends = np.flatnonzero(text == SEPARATOR).astype(np.int32)

    def located(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of rows of the transform, by stepping back to the next kept place."""
        out, steps = np.full(len(rows), -1, np.int64), 0
        open_, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(open_):
            found = np.minimum(np.searchsorted(self.rows, at), len(self.rows) - 1)
            kept = self.rows[found] == at
            out[open_[kept]] = self.places[found[kept]] + steps
            open_, at = open_[~kept], at[~kept]
            c = self.code[self.bwt[at]].astype(np.int64)
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return out

    def lines(self, rows: np.ndarray) -> np.ndarray:
        """Numbers of the lines before which the separators at the rows stand."""
        return np.searchsorted(self.ends, self.located(rows))

    @staticmethod
    def suffixes(text: np.ndarray) -> np.ndarray:
        """The order of all suffixes, by doubling from the first eight characters on."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | padded[k : k + n]
        width = 8
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            step = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            if step[-1] == n - 1:
                return order
            rank = np.empty(n, np.int64)
            rank[order] = step + 1
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - width)] = rank[width:]
            key = (rank.astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
            width *= 2

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of the coded characters c before the places ``at``."""
        block, rest = at // BLOCK, at % BLOCK
        inside = (self.blocks[block] == c[:, None].astype(np.uint8)) & (np.arange(BLOCK) < rest[:, None])
        return self.before[block, c] + inside.sum(1)

    def longest(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of characters the length of its longest suffix in the text, and a row of the transform where that stands."""
        length = np.zeros(len(grid), np.int64)
        place = np.zeros(len(grid), np.int64)
        low, high = np.zeros(len(grid), np.int64), np.full(len(grid), self.size, np.int64)
        alive = np.arange(len(grid))
        for j in range(grid.shape[1] - 1, -1, -1):
            c = self.code[grid[alive, j]].astype(np.int64)
            known = c >= 0
            alive, c, low, high = alive[known], c[known], low[known], high[known]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
            length[alive], place[alive] = grid.shape[1] - j, low
            if not len(alive):
                break
        return length, place


def met_lines(held: list[bytes], streamed: list[bytes]) -> np.ndarray:
    """For each streamed word the number of the held word (sorted, without repeats) that a maximal match of it spans, or -1."""
    index = FullTextIndex(np.frombuffer(b"\n" + b"".join(w + b"\n" for w in held) + b"\0", np.uint8))
    sizes = np.fromiter(map(len, streamed), np.int64, len(streamed))
    out = np.full(len(streamed), -1, np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        grid = np.frombuffer(b"".join(b"\n" + streamed[i] + b"\n" for i in at), np.uint8).reshape(len(at), size + 2)
        length, place = index.longest(grid)
        whole = length == size + 2
        out[at[whole]] = index.lines(place[whole])
    return out


def shards_for(spark, rows: int, most: int = SHARD_WORDS) -> int:
    return max(2 * partitions(spark), rows // most)


def met_words(streamed: DataFrame, indexed: DataFrame) -> DataFrame:
    """(word, met): the words of ``streamed`` with the word of ``indexed`` that they span whole; both have one column ``word`` of distinct words."""
    shards = shards_for(streamed.sparkSession, streamed.count() + indexed.count())
    shard = F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard")

    def search(held: pd.DataFrame, stream: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(stream):
            return pd.DataFrame({"word": pd.Series(dtype=object), "met": pd.Series(dtype=object)})  # an empty side has no columns
        words = sorted(w.encode() for w in held["word"])
        line = met_lines(words, [w.encode() for w in stream["word"]])
        found = line >= 0
        return pd.DataFrame({"word": pd.Series(stream["word"].to_numpy(dtype=object)[found], dtype=object), "met": pd.Series([words[k].decode() for k in line[found]], dtype=object)})

    return indexed.select("word", shard).groupBy("shard").cogroup(streamed.select("word", shard).groupBy("shard")).applyInPandas(search, "word string, met string")


def slice_grid(bits: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """The words of hashes for their choices of two slices, as rows of six characters between separators."""
    bits = bits.astype(np.uint64)
    grid = np.full((len(bits), 7), SEPARATOR, np.uint8)
    grid[:, 1] = 64 + choice
    for k, (i, j) in enumerate(CHOICES):
        at = np.flatnonzero(choice == k)
        value = sum(((bits[at] >> np.uint64(CUTS[s])) & np.uint64((1 << (CUTS[s + 1] - CUTS[s])) - 1)) << np.uint64(shift) for s, shift in ((i, 12), (j, 0)))
        for d in range(4):
            grid[at, 5 - d] = 64 + ((value >> np.uint64(6 * d)) & np.uint64(63))
    return grid


def near_hashes(rows: DataFrame) -> DataFrame:
    """(t, e): hashes of both sides that differ in NEAR_BITS bits at most.

    rows: (side, bits), once each; side is t or e, and the hashes of side e are indexed.  A line of the index is a choice's slices, once each,
    with the hashes that have it.
    """
    spread = rows.select("side", "bits", F.posexplode(slice_values("bits")).alias("choice", "value"))
    shard = F.pmod(F.xxhash64("choice", "value"), F.lit(shards_for(rows.sparkSession, len(CHOICES) * rows.count()))).cast("int")
    spread = spread.select(shard.alias("shard"), "side", "bits", F.col("choice").cast("short").alias("choice"))

    def search(held: pd.DataFrame, stream: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(stream):
            return pd.DataFrame({"t": pd.Series(dtype="int64"), "e": pd.Series(dtype="int64")})
        own, bits = slice_grid(held["bits"].to_numpy(), held["choice"].to_numpy()), held["bits"].to_numpy()
        other, asked = slice_grid(stream["bits_t"].to_numpy(), stream["choice_t"].to_numpy()), stream["bits_t"].to_numpy()
        lines, of = np.unique(own[:, :6], axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        begin = np.concatenate([[0], np.cumsum(np.bincount(of.ravel(), minlength=len(lines)))])
        index = FullTextIndex(np.concatenate([lines.ravel(), np.array([SEPARATOR, 0], np.uint8)]))
        length, place = index.longest(other)
        met = np.flatnonzero(length == other.shape[1])
        line = index.lines(place[met])
        found = []
        for part in range(0, len(met), CHUNK):  # a hash meets every hash of its line
            t, k = met[part : part + CHUNK], line[part : part + CHUNK]
            many = begin[k + 1] - begin[k]
            who = np.repeat(np.arange(len(t)), many)
            e = order[np.repeat(begin[k], many) + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)]
            pair = np.stack([asked[t][who], bits[e]], 1)
            near = np.bitwise_count((pair[:, 0] ^ pair[:, 1]).view(np.uint64)) <= NEAR_BITS
            found.append(pair[near])
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"t": pairs[:, 0], "e": pairs[:, 1]})

    held = spread.where("side = 'e'").groupBy("shard")
    stream = spread.where("side = 't'").select(*[F.col(c).alias(f"{c}_t") for c in spread.columns]).groupBy("shard_t")
    return held.cogroup(stream).applyInPandas(search, "t bigint, e bigint").distinct()


def number_key(sample_id: str | Column = "sample_id") -> Column:
    """Product code in upper case and number, the last two parts of an id; null where there are no such parts."""
    parts = F.regexp_extract(sample_id, r"([^_]+)_0*(\d+)$", 0)
    return F.when(parts != "", F.concat(F.upper(F.regexp_extract(sample_id, r"([^_]+)_0*(\d+)$", 1)), F.lit("_"), F.regexp_extract(sample_id, r"([^_]+)_0*(\d+)$", 2)))


def slice_values(bits: str) -> Column:
    """The value of each choice of two slices of a perceptual hash."""
    part = [F.shiftrightunsigned(F.shiftleft(bits, 64 - b), 64 - b + a) for a, b in zip(CUTS, CUTS[1:], strict=False)]
    return F.array(*[F.shiftleft(part[i], 12) + part[j] for i, j in CHOICES])


def merged_spans(places: Column) -> Column:
    """How many runs of neighbouring numbers a sorted array of them has."""
    return F.size(F.filter(places, lambda p: ~F.array_contains(places, p - 1)))


def overlaps(samples: DataFrame, assets: DataFrame) -> DataFrame:
    """(train_id, other_id, by_key, by_picture, by_near, words, spans): what each overlapping pair of samples shares.

    words: words of the training sample that the other one meets; spans: what is left of them when neighbours are merged.
    samples: sample_id, split, source_image_ids, one row a sample.
    """
    spark = samples.sparkSession
    scratch = Scratch(spark, "overlap")
    named = split_name("split")
    sided = samples.where("sample_id is not null").withColumn("side", F.when(named == "train", "t").when(named.isin("validation", "test"), "e")).where("side is not null")
    sided = sided.select("sample_id", "side", "source_image_ids")
    shown = named_pictures(sided.withColumn("id", F.struct("sample_id", "side")), assets, "id", phash=True)
    shown = shown.select("id.sample_id", "id.side", "picture", F.coalesce("all_bits", F.array().cast("array<bigint>")).alias("all_bits"))
    # the pictures of a sample in a fixed order are its words behind the key, which is word 0
    held = shown.groupBy("sample_id", "side").agg(F.array_sort(F.collect_set(F.struct("picture", "all_bits"))).alias("pictures"))
    shown = scratch.write(held.select("sample_id", "side", F.posexplode("pictures").alias("at", "p")).select("sample_id", "side", (F.col("at") + 1).alias("at"), "p.picture", "p.all_bits"), "shown")
    keys = sided.select("sample_id", "side", F.lit(0).alias("at"), F.concat(F.lit("k"), number_key()).alias("word")).where("word is not null")
    pictures = shown.select("sample_id", "side", "at", F.concat(F.lit("p"), F.base64("picture")).alias("word"))
    whole = scratch.write(keys.unionByName(pictures), "whole")
    of_side = lambda side: whole.where(F.col("side") == side).select("word").distinct()
    met = scratch.write(met_words(of_side("t"), of_side("e")), "met")
    streamed = whole.where("side = 't'").join(met, "word").select(F.col("sample_id").alias("t"), "at", "met")
    same = streamed.join(whole.where("side = 'e'").select(F.col("sample_id").alias("e"), F.col("word").alias("met")), "met").select("t", "e", "at", F.substring("met", 1, 1).alias("kind"))
    bits = shown.select("sample_id", "side", "at", F.explode("all_bits").alias("bits"))
    near = scratch.write(near_hashes(bits.select("side", "bits").distinct()), "near")
    close = near.withColumnRenamed("t", "tb").join(bits.where("side = 't'").select(F.col("sample_id").alias("t"), "at", F.col("bits").alias("tb")), "tb").withColumnRenamed("e", "eb")
    close = close.join(bits.where("side = 'e'").select(F.col("sample_id").alias("e"), F.col("bits").alias("eb")).distinct(), "eb").select("t", "e", "at", F.lit("n").alias("kind"))
    flags = [F.max(F.col("kind") == k).alias(n) for k, n in (("k", "by_key"), ("p", "by_picture"), ("n", "by_near"))]
    found = same.unionByName(close).groupBy(F.col("t").alias("train_id"), F.col("e").alias("other_id")).agg(*flags, F.array_sort(F.collect_set("at")).alias("at"))
    return found.select("train_id", "other_id", "by_key", "by_picture", "by_near", F.size("at").alias("words"), merged_spans(F.col("at")).alias("spans"))


def export_overlaps(spark, sf_dir: str) -> DataFrame:
    return overlaps(latest_samples(spark, sf_dir), table(spark, sf_dir, "asset"))


def overlap_pairs(spark, sf_dir: str) -> DataFrame:
    """(sample_id_a, sample_id_b): every overlapping pair, the smaller id first."""
    found = export_overlaps(spark, sf_dir)
    return found.select(F.least("train_id", "other_id").alias("sample_id_a"), F.greatest("train_id", "other_id").alias("sample_id_b"))


def overlap_counts(spark, sf_dir: str) -> DataFrame:
    """Samples of each held-out split and source, those that overlap with training, and the pairs, words and merged spans they are in."""
    samples = latest_samples(spark, sf_dir)
    found = overlaps(samples, table(spark, sf_dir, "asset"))
    each = found.groupBy(F.col("other_id").alias("sample_id")).agg(F.count("*").alias("pairs"), F.sum("words").alias("words"), F.sum("spans").alias("spans"))
    held_out = samples.select("sample_id", "source", split_name("split").alias("split")).where("split in ('validation', 'test')")
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "words", "spans")]
    return held_out.join(each, "sample_id", "left").groupBy("split", "source").agg(F.count("*").alias("samples"), F.count("pairs").alias("overlapping"), *counts)
