"""Evaluation texts that stand in training texts.

Size-partitioned MinHash containment search.  A shingle is a pair of words that stand next to each other or have one
word between them, so that single words put in, left out or replaced spare most shingles.  The items are cut into windows
and the documents into overlapping stretches, in two sizes: short ones for passages of RUN words, long ones for those of
WINDOW words.  Of a stretch only the shingles that some item has are kept.  How many these are puts it into a size class: with
too few it can hold no passage, and the more there are beside the passage, the smaller is the likeness that a
containment comes to, so the class fixes how many of the SKETCHES minima make a band.  A window and a stretch with a
band in common are a candidate; a candidate is verified on its words: a whole run of RUN words, or NEED of WINDOW words
in order within STRETCH words.

Only two bit sets of bounded size (shingles and bands of the items) are broadcast.  Bands that pass them meet the
items' bands in an equi-join, and only stretches of candidates are read again, so the documents are read twice whatever the
number of items.

The search is a random one: a passage of RUN words, and one of WINDOW words with CONTAINED of its shingles, is missed
with a chance under one in a thousand; passages that keep fewer shingles, which NEED words can in the worst
case, are missed more often (README).

Defined results: null and empty texts hold nothing; an item of fewer than 13 words leaks nowhere, of fewer than 30
only as a whole run; a repeated item or document has a row for each id; texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.functions.text import words_of
from lodesift.llm.sketch import Bits, bits_of, flat, merged, mixed, seeds, signed, unsigned
from lodesift.session import Scratch, table

RUN, WINDOW, STRETCH, SHARE = 13, 30, 38, 80
NEED = -(-WINDOW * SHARE // 100)
#: Minima of a sketch.
SKETCHES = 256
#: Words of a piece of a document; a stretch begins at every piece.
STEP = 12
#: Name, words of an item's window, its step, pieces of a document's stretch, shingles expected of a passage, and of a window.
SIZES = (("short", 20, 7, 2, 23, 37), ("long", 38, 8, 4, 33, 73))
CONTAINED = 33 / 73
#: Words of a document that are read again for a candidate.
READ = 4 * STEP + 4
CERTAIN = 0.999
#: The bit set has at most 2 ** BITS bits, the counts at most 2 ** COUNTERS bytes.
BITS, COUNTERS = 28, 26
#: A shingle of more than OFTEN items comes later, by this power of how many more.
OFTEN, POWER = 4, 1.3
#: Pieces sketched at once, words remembered with their hashes, and pieces of a document whose candidates are one row.
CHUNK, REMEMBERED, PART = 16_384, 1_000_000, 1_000
NONE = np.float32(np.inf)


class Numbers(dict):
    """Numbers of words in the order in which they are met first."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class WordHashes:
    """Stable 64-bit hashes of words."""

    def __init__(self):
        self.numbers, self.hashes = Numbers(), np.zeros(0, np.uint64)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all texts' words, end to end, and how many each text has."""
        if len(self.numbers) > REMEMBERED:
            self.__init__()
        words = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        place = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        if len(self.numbers) > len(self.hashes):
            new = map(xxhash.xxh3_64_intdigest, islice(self.numbers, len(self.hashes), None))
            self.hashes = np.concatenate([self.hashes, np.fromiter(new, np.uint64, len(self.numbers) - len(self.hashes))])
        return self.hashes[place], sizes


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that begin at each word: with the next one, and with the one after it; words end with two fillers."""
    return mixed(words[:-2] * np.uint64(3) + words[1:-1]), mixed(words[:-2] * np.uint64(3) + words[2:])


class ShingleCounts:
    """In how many items a shingle stands, never too low, at most 255."""

    def __init__(self, counters: np.ndarray):
        self.counters = counters
        self.shift = np.uint64(64 - (len(counters).bit_length() - 1))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique(self.places(hashes), return_counts=True)
        self.counters[at] = np.minimum(255, self.counters[at].astype(np.int64) + n)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return self.counters[self.places(hashes)]


#: How late a shingle comes, by its count.
LATE = ((np.maximum(np.arange(256), OFTEN) / OFTEN) ** POWER).astype(np.float32)


def minima(hashes: np.ndarray, late: np.ndarray, sizes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """SKETCHES minima of each part of hashes; the parts stand end to end and none is empty.

    The first hashes of all parts are compared with the second ones, and so on, the longest parts first, so that every step runs along an array.
    """
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    many = np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), "left")
    place = np.concatenate([begin[:n] + k for k, n in enumerate(many)])
    short, late = (hashes[place] >> np.uint64(32)).astype(np.uint32), late[place]
    out = np.empty((len(multipliers), len(sizes)), np.float32)
    for r, a in enumerate((multipliers >> np.uint64(32)).astype(np.uint32) | np.uint32(1)):
        value = (short * a).astype(np.float32)
        value *= late
        least, at = value[: many[0]], many[0]
        for n in many[1:]:
            np.minimum(least[:n], value[at : at + n], out=least[:n])
            at += n
        out[r, order] = least
    return out


def rows_of_band(name: str, n: int) -> int:
    """Minima in a band for stretches of a size class: as many as leave a passage's chance to be missed small."""
    _, _, _, _, common, window = next(s for s in SIZES if s[0] == name)
    like = common / (window + max(n, common) - common)
    return next((r for r in (3, 2) if 1 - (1 - like**r) ** (SKETCHES // r) >= CERTAIN), 1)


def bands(least: np.ndarray, rows: int, name: str) -> np.ndarray:
    """The bands' hashes, one column a sketch."""
    many = len(least) // rows
    tag = mixed(np.arange(many, dtype=np.uint64) + np.uint64(1000 * rows + len(name)))
    out = np.repeat(tag[:, None], least.shape[1], 1)
    for k in range(rows):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += least[k : many * rows : rows].view(np.uint32)
    return mixed(out)


def windows(words: np.ndarray, name: str) -> Iterator[tuple[np.ndarray, int]]:
    """The different shingles of each window of an item and how many of them any passage in it has at least."""
    _, size, step, _, _, _ = next(s for s in SIZES if s[0] == name)
    passage, spared = (RUN, 2 * RUN - 3) if name == "short" else (WINDOW, 13)
    if len(words) < passage:
        return
    for at in sorted({*range(0, max(1, len(words) - size + 1), step), max(0, len(words) - size)}):
        part = words[at : at + size]
        one, two = shingles(np.concatenate([part, np.zeros(2, np.uint64)]))
        held = np.concatenate([one[:-1], two[:-2]])
        different = np.unique(held)
        # of the passage's shingles as many may be alike as the window has repeated ones
        yield different, max(1, spared - (len(held) - len(different)))


def window_rows(items: DataFrame, item_key: str) -> DataFrame:
    """(item_key, size, shingles, least): the windows of every item, size being the number of a SIZES entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, words in enumerate(batch.column("words").to_pylist()):
                words = np.array(words, np.int64).view(np.uint64)
                out += [(i, s, different.view(np.int64), least) for s, (name, *_) in enumerate(SIZES) for different, least in windows(words, name)]
            columns = [batch.column(item_key).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.int32())]
            columns += [pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [item_key, "size", "shingles", "least"])

    return items.select(item_key, "words").mapInArrow(run, f"{item_key} {items.schema[item_key].dataType.simpleString()}, size int, shingles array<bigint>, least bigint")


def shingle_counts(rows: DataFrame, item_key: str, n: int) -> ShingleCounts:
    """The counts of all items' shingles; of their n places in windows about five are of one shingle, so it has 60 counters or more."""
    flat_rows = rows.select(item_key, F.explode("shingles").alias("h")).distinct()
    size = 1 << int(min(COUNTERS, max(12, int(12 * n).bit_length())))

    def add(own: np.ndarray, batch: pa.RecordBatch) -> None:
        ShingleCounts(own).add(unsigned(batch.column(0)))

    capped = lambda x, y: np.minimum(255, x.astype(np.int64) + y).astype(np.uint8)
    return ShingleCounts(merged(flat_rows, ["h"], size, np.uint8, add, capped))


def item_bands(rows: DataFrame, item_key: str, known: ShingleCounts) -> DataFrame:
    """(item_key, key): the bands of all windows for every size class."""
    multipliers, classes = seeds(SKETCHES), [sorted({rows_of_band(s[0], n) for n in range(2 * STEP * s[3] + 1)}) for s in SIZES]
    held = rows.sparkSession.sparkContext.broadcast(known.counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = ShingleCounts(held.value)
        for batch in batches:
            hashes, sizes = flat(batch.column("shingles"))
            if not len(hashes):
                continue
            small = minima(hashes, LATE[counts.of(hashes)], sizes, multipliers)
            of_size = batch.column("size").to_numpy()
            for s, (name, *_) in enumerate(SIZES):
                at = np.flatnonzero(of_size == s)
                for r in classes[s] if len(at) else ():
                    keys = bands(small[:, at], r, name)
                    yield pa.RecordBatch.from_arrays([batch.column(item_key).take(pa.array(np.tile(at, len(keys)))), signed(keys.ravel())], [item_key, "key"])

    return rows.mapInArrow(run, f"{item_key} {rows.schema[item_key].dataType.simpleString()}, key bigint").distinct()


def document_bands(docs: DataFrame, key: str, text: str, known: ShingleCounts, wanted: Bits, least: dict[str, int]) -> DataFrame:
    """(key, place, band): the bands of all stretches that some item may have; place is a word's number."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((known.counters, wanted.bits, wanted.held))
    multipliers = seeds(SKETCHES)
    table_of = {s[0]: np.array([rows_of_band(s[0], n) for n in range(2 * STEP * s[3] + 1)]) for s in SIZES}
    gap = max(s[3] for s in SIZES) - 1

    def found(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(piece, band) of pieces of STEP words from the first one on; texts are parted by empty pieces."""
        counts, band_bits = ShingleCounts(held.value[0]), Bits(*held.value[1:])
        one, two = shingles(np.concatenate([words, np.zeros(2, np.uint64)]))
        both = np.stack([one, two], 1)
        often = counts.of(both)
        mask = often > 0
        size = np.add.reduceat(mask.sum(1), np.arange(0, len(words), STEP)) if len(words) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size), np.full(gap + 1, size.sum())])
        pieces = len(size)
        for first in range(0, pieces, CHUNK):
            last = min(pieces, first + CHUNK)
            end = min(pieces, last + gap)
            inside = mask[first * STEP : end * STEP]
            hashes, late = both[first * STEP : end * STEP][inside], LATE[often[first * STEP : end * STEP][inside]]
            filled = np.flatnonzero(size[first:end])
            if not len(filled):
                continue
            small = np.full((SKETCHES, end - first + gap), NONE, np.float32)
            small[:, filled] = minima(hashes, late, size[first:end][filled], multipliers)
            for name, _, _, many, _, _ in SIZES:
                n = total[first + many : last + many] - total[first:last]
                for rows in np.unique(table_of[name]):
                    at = np.flatnonzero((n >= least[name]) & (table_of[name][n] == rows))
                    for part in np.array_split(at, max(1, len(at) // 2_048)):
                        if len(part):
                            lows = small[:, part]
                            for j in range(1, many):
                                lows = np.minimum(lows, small[:, part + j])
                            keys = bands(lows, int(rows), name)
                            row, column = np.nonzero(band_bits.holds(keys.ravel()).reshape(keys.shape))
                            yield first + part[column], keys[row, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            words, sizes = hashes.of(batch.column(1).to_pylist())
            pieces = np.where(sizes > 0, -(-sizes // STEP) + gap, 0)
            begin = np.concatenate([[0], np.cumsum(pieces)])
            spread = np.zeros(begin[-1] * STEP, np.uint64)
            spread[np.arange(len(words)) + np.repeat(begin[:-1] * STEP - (np.cumsum(sizes) - sizes), sizes)] = words
            for piece, bands_ in found(spread):
                who = np.searchsorted(begin, piece, "right") - 1
                place = (piece - begin[who]) * STEP
                columns = [batch.column(0).take(pa.array(who)), pa.array(place.astype(np.int64)), signed(bands_)]
                yield pa.RecordBatch.from_arrays(columns, [key, "place", "key"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, place bigint, key bigint")


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for w in b:
        seen = state & at.get(w, 0)
        state = ((state + seen) | (state - seen)) & full
    return len(a) - state.bit_count()


def stands_in(item: list[int], part: list[int]) -> bool:
    """Whether RUN words of the item stand together in the part, or NEED of some WINDOW in order within STRETCH words."""
    held = set(item)
    if sum(w in held for w in part) < RUN:
        return False
    runs = {tuple(item[i : i + RUN]) for i in range(len(item) - RUN + 1)}
    if any(tuple(part[j : j + RUN]) in runs for j in range(len(part) - RUN + 1)):
        return True
    if len(item) < WINDOW or common_subsequence(item, part) < NEED:
        return False
    for j in range(max(1, len(part) - STRETCH + 1)):
        stretch = part[j : j + STRETCH]
        if common_subsequence(item, stretch) < NEED:
            continue
        for i in range(len(item) - WINDOW + 1):
            if common_subsequence(item[i : i + WINDOW], stretch) >= NEED:
                return True
    return False


def stretches(docs: DataFrame, places: DataFrame, key: str, text: str, item_key: str) -> DataFrame:
    """(key, item_key, part): the words of the candidates' stretches, as hashes."""
    grouped = places.groupBy(key, F.floor(F.col("place") / (PART * STEP)).alias("_part")).agg(F.collect_list(F.struct("place", item_key)).alias("found"))
    kind, item_kind = docs.schema[key].dataType.simpleString(), places.schema[item_key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            words, sizes = hashes.of(batch.column(text).to_pylist())
            lists = batch.column("found")
            met, many = lists.flatten(), np.diff(lists.offsets.to_numpy())
            who = np.repeat(np.arange(len(many)), many)
            place, end = met.field("place").to_numpy(), np.cumsum(sizes)
            first = (end - sizes)[who] + place
            size = np.clip(end[who] - first, 0, READ)
            ends = np.concatenate([[0], np.cumsum(size)])
            values = words[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
            part = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(values))
            columns = [batch.column(key).take(pa.array(who)), met.field(item_key), part]
            yield pa.RecordBatch.from_arrays(columns, [key, item_key, "part"])

    met = docs.select(key, text).join(grouped, key).select(key, text, "found")
    return met.mapInArrow(run, f"{key} {kind}, {item_key} {item_kind}, part array<bigint>")


def can_stand(item: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which rows of words have RUN words of the item together, or NEED of them within STRETCH words."""
    held = np.zeros((len(parts), parts.shape[1] + 1), np.int32)
    held[:, 1:] = np.isin(parts, item).cumsum(1)
    width = parts.shape[1]
    run = (held[:, RUN:] - held[:, :-RUN] == RUN).any(1) if width >= RUN else np.zeros(len(parts), bool)
    size = min(STRETCH, width)
    return run | ((held[:, size:] - held[:, : width + 1 - size]) >= NEED).any(1)


def verified(rows: DataFrame, key: str, item_key: str) -> DataFrame:
    """(key, item_key) of the candidates that hold a passage; rows: both keys, words of the item and of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = flat(batch.column("words"))
            values, m = flat(batch.column("part"))
            begin, start = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(m)])
            good = np.zeros(len(n), bool)
            names = batch.column(item_key).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            order = np.argsort(names, kind="stable")
            for who in np.split(order, np.flatnonzero(np.diff(names[order])) + 1):
                if not len(who):
                    continue
                item = words[begin[who[0]] : begin[who[0] + 1]]
                place = np.minimum(start[who][:, None] + np.arange(READ), max(0, len(values) - 1))
                parts = np.where(np.arange(READ) < m[who][:, None], values[place] if len(values) else np.uint64(0), np.uint64(0))
                for i in who[can_stand(item, parts)]:
                    good[i] = stands_in(item.tolist(), values[start[i] : start[i + 1]].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in (key, item_key)], [key, item_key])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, item_key)]
    return rows.select(key, item_key, "words", "part").mapInArrow(run, ", ".join(kinds))


def item_words(items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(item_key, words): the hashed words of every item of RUN words or more, once each."""
    rows = items.where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).select(item_key, item_text).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            words, sizes = hashes.of(batch.column(1).to_pylist())
            good = pa.array(sizes >= RUN)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), signed(words))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), lists.filter(good)], [item_key, "words"])

    return rows.mapInArrow(run, f"{item_key} {rows.schema[item_key].dataType.simpleString()}, words array<bigint>")


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key): every document with the items of which it holds a passage."""
    scratch = Scratch(docs.sparkSession, "leakage")
    docs = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    items = items.select(F.col(item_key).alias("_item"), F.col(item_text).alias("_text"))
    words = scratch.write(item_words(items, "_item", "_text"), "items")
    rows = scratch.write(window_rows(words, "_item"), "windows")
    # where no item has the length of a size, nothing of that size is looked for
    found = {r["size"]: r for r in rows.groupBy("size").agg(F.min("least").alias("least"), F.sum(F.size("shingles")).alias("n")).collect()}
    least = {s[0]: found[k]["least"] if k in found else 1 << 40 for k, s in enumerate(SIZES)}
    known = shingle_counts(rows, "_item", sum(r["n"] for r in found.values()))
    index = scratch.write(item_bands(rows, "_item", known), "bands")
    wanted = bits_of(index, "key", index.count(), BITS)
    met = document_bands(docs, "_doc", "_text", known, wanted, least).join(index, "key")
    places = scratch.write(met.select("_doc", "place", "_item").distinct(), "places")
    parts = stretches(docs, places, "_doc", "_text", "_item").join(words, "_item")
    return verified(parts, "_doc", "_item").distinct().toDF(key, item_key)


def benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
