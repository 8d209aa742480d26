"""Text quality: prose, lists, tables and junk.

Statistics are computed for every line: words, word length, symbols, digits, separators, line ends, repetition and
the share of common words.  A Gaussian mixture is fitted by expectation-maximization to the standardized statistics
of the lines of a bounded sample of labelled documents; a component's kind is the one in whose labelled documents
it is most frequent.  A document's lines are then read as a run of prose and other passages that change rarely:
the most probable run gives the characters of each kind.

Fitting takes the statistics of at most ``sample`` labelled documents, those of the smallest id hashes, and of at most
LINES lines of each, evenly spread; they are computed where the documents are.  Scoring reads every document whole, in
Arrow batches and without a shuffle.

Statistics of whole texts come from the same counts.

Defined results: null and blank texts have no passages and are reported with zero counts; labels of unknown
documents or kinds are left out; without labelled documents nothing can be fitted and an error says so.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.functions.text import TO_SPACE, WORD
from lodesift.session import table

KINDS = ("prose", "list", "table", "junk")
#: Most labelled documents that the mixture is fitted to.
SAMPLE = 2_000
#: Most lines of a labelled document that the mixture is fitted to.
LINES = 1_000
COMPONENTS = 40
STARTS = 3
#: Share of a component's text in documents labelled prose from which on the component is prose.
PROSE_SHARE = 0.6
ROUNDS = 60
#: Log odds against a change between prose and other passages from one line to the next, and the most a line can tell.
CHANGE, MOST = 4.0, 12.0
DIGITS = "0123456789"
SEPARATORS = ",;|\t:=<>/{}"
SPACES = " \t\r\x0b\x0c"
ALL_SPACES = SPACES + "\x85\xa0\u2002\u2003\u2009\u3000"
#: Characters that wrongly decoded text is full of, and pictographs.
ODD = re.compile("[\x80-\xa0¢-¾À-ÃÅ-ÈÊËÌÎ-ÐÒ-ÕØ-ÙÛÝÞàâãåæçèêëìîïðòôõøùûýþÿ€Š-žƒˆ‚„†‡‰‹›™\ufffd\U0001f000-\U0001faff]")
IDEOGRAPH = re.compile(r"[㐀-鿿]")
END = (".", "!", "?", "。", "！", "？", ".”", '."', "…")
#: Log density under which a line is like no component.
BACKGROUND = -35.0
TURN = 12  # words in which repetition is looked for
FEATURES = ("words", "word_length", "common", "symbols", "digits", "separators", "distinct", "repeats", "odd", "ends")
#: Of a whole text: lines that are not blank, words, letters a word, and shares of symbols, of lines that end a sentence and of common words.
STATISTICS = ("lines", "words", "mean_word_length", "symbol_ratio", "ended_lines", "common_words")


class CommonWords:
    """Frequent words of all languages; those of ideographs are looked for inside runs."""

    def __init__(self, words: Iterable[str]):
        words = {w.lower() for w in words if w}
        self.words = frozenset(w for w in words if not IDEOGRAPH.search(w))
        inside = sorted((w for w in words if IDEOGRAPH.search(w)), key=lambda w: (-len(w), w))
        self.inside = re.compile("|".join(map(re.escape, inside))) if inside else None


def line_counts(low: str, common: CommonWords) -> tuple[list[str], int, int, float, int, list[str]]:
    """Words, visible characters, letters and digits, words where two ideographs count as one, common words without and with ideographs."""
    plain = low.isascii()
    words = low.translate(TO_SPACE).split() if plain else WORD.findall(low)
    visible = len(low) - sum(map(low.count, SPACES if plain else ALL_SPACES)) or 1
    letters = sum(map(len, words))
    hits = sum(map(common.words.__contains__, words))
    weight, inside = len(words), []
    if not plain:
        ideographs = len(IDEOGRAPH.findall(low))
        if ideographs:
            long = sum(1 for w in words if IDEOGRAPH.search(w))
            weight = weight - long + ideographs / 2
            inside = common.inside.findall(low) if common.inside else []
    return words, visible, letters, weight, hits, inside


def line_statistics(text: str, common: CommonWords) -> tuple[list[list[float]], list[int]]:
    """FEATURES and characters of every line that is not blank."""
    lines = [x for x in text.splitlines() if x and not x.isspace()]
    again = Counter(lines) if len(lines) > 1 else None
    out = []
    for line in lines:
        low = line.lower()
        words, visible, letters, weight, hits, inside = line_counts(low, common)
        n = len(words)
        hits += 2 * len(inside)
        odd = 0 if low.isascii() else len(ODD.findall(low))
        if n <= TURN:
            distinct = len(set(words)) / n if n else 0.0
        else:
            distinct = sum([len(set(words[i : i + TURN])) for i in range(0, n, TURN)]) / n
        out.append([
            n, letters / n if n else 0.0, hits / weight if weight else 0.0, (visible - letters) / visible, sum(map(low.count, DIGITS)) / visible,
            (sum(map(line.count, SEPARATORS)) + line.count("   ")) / (n + 1), distinct, again[line] if again else 1, odd / visible, line.rstrip().endswith(END),
        ])
    return out, [len(x) for x in lines]


def text_statistics(text: str | None, common: CommonWords) -> tuple[int, float, float | None, float | None, float | None, float | None]:
    """STATISTICS of a whole text; those without a denominator are None.

    Two ideographs count as a word, and an ideograph of a common word as half a common word, so the share of common
    words is at most 1.
    """
    lines = [x for x in (text or "").splitlines() if x and not x.isspace()]
    n = known = 0.0
    seen = letters = ends = 0
    for line in lines:
        _, visible, some, weight, hits, inside = line_counts(line.lower(), common)
        n, known = n + weight, known + hits + sum(map(len, inside)) / 2
        seen, letters, ends = seen + visible, letters + some, ends + line.rstrip().endswith(END)
    share = lambda a, of: a / of if of else None
    return len(lines), n, share(letters, n), share(seen - letters, seen), share(ends, len(lines)), share(known, n)


def scaled(rows: np.ndarray) -> np.ndarray:
    """The statistics on scales on which they spread evenly."""
    x = np.asarray(rows, float).reshape(-1, len(FEATURES)).copy()
    x[:, 0] = np.log1p(np.minimum(x[:, 0], 60))
    x[:, 1] = np.log1p(np.minimum(x[:, 1], 80))
    x[:, 2] = np.sqrt(np.minimum(x[:, 2], 1.0))
    x[:, 3] = np.sqrt(x[:, 3])
    x[:, 4] = np.sqrt(x[:, 4])
    x[:, 5] = np.log1p(5 * np.minimum(x[:, 5], 4))
    x[:, 7] = np.log(np.minimum(x[:, 7], 8))
    x[:, 8] = np.sqrt(x[:, 8])
    return x


class Mixture:
    """A Gaussian mixture with full covariances."""

    def __init__(self, x: np.ndarray, k: int = COMPONENTS, rounds: int = ROUNDS, seed: int = 5, ridge: float = 0.05):
        rng = np.random.default_rng(seed)
        self.mean0, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean0) / self.scale
        n, d = z.shape
        k = min(k, n)
        centres = [z[rng.integers(n)]]
        near = ((z - centres[0]) ** 2).sum(1)
        for _ in range(k - 1):  # spread starting centres
            pick = rng.choice(n, p=near / near.sum()) if near.sum() else rng.integers(n)
            centres.append(z[pick])
            near = np.minimum(near, ((z - z[pick]) ** 2).sum(1))
        self.mean = np.array(centres)
        self.weight = np.full(k, 1 / k)
        self.cov = np.repeat(np.eye(d)[None], k, 0)
        self.settle()
        last = self.fit = -np.inf
        for _ in range(rounds):
            r, total = self.shares(z)
            mass = r.sum(0) + 1e-9
            self.weight = mass / mass.sum()
            self.mean = r.T @ z / mass[:, None]
            for j in range(k):
                c = z - self.mean[j]
                self.cov[j] = (r[:, j, None] * c).T @ c / mass[j] + ridge * np.eye(d)
            self.settle()
            near_same = total - last < 1e-4 * abs(total)
            last = self.fit = total
            if near_same:
                break

    def settle(self) -> None:
        self.root = np.array([np.linalg.inv(np.linalg.cholesky(c)) for c in self.cov])
        self.constant = np.log(self.weight + 1e-300) + np.array([np.log(np.diag(r)).sum() for r in self.root]) - 0.5 * len(self.mean[0]) * np.log(2 * np.pi)

    def densities(self, z: np.ndarray) -> np.ndarray:
        out = np.empty((len(z), len(self.mean)))
        for j in range(len(self.mean)):
            y = (z - self.mean[j]) @ self.root[j].T
            out[:, j] = self.constant[j] - 0.5 * np.einsum("ij,ij->i", y, y)
        return out

    def shares(self, z: np.ndarray) -> tuple[np.ndarray, float]:
        p = self.densities(z)
        top = p.max(1, keepdims=True)
        e = np.exp(p - top)
        s = e.sum(1, keepdims=True)
        return e / s, float((np.log(s) + top).sum())

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.densities((x - self.mean0) / self.scale)


class Reader:
    """A fitted mixture with its components' kinds; reads texts."""

    def __init__(self, stats: list[tuple[list[list[float]], list[int]]], kinds: list[str], common: CommonWords):
        self.common = common
        x = scaled(np.array([r for rows, _ in stats for r in rows]))
        kind = np.repeat([KINDS.index(k) for k in kinds], [len(rows) for rows, _ in stats])
        chars = np.array([c for _, cs in stats for c in cs], float)
        self.mixture = max((Mixture(x, seed=s) for s in range(STARTS)), key=lambda m: m.fit)
        share, _ = self.mixture.shares((x - self.mixture.mean0) / self.mixture.scale)
        mass = np.stack([(share[kind == k] * chars[kind == k, None]).sum(0) for k in range(len(KINDS))])
        # prose where most of the component's text stands in prose documents, else the kind it is most frequent in
        rate = mass[1:] / np.maximum(1.0, chars @ (kind[:, None] == np.arange(1, len(KINDS))))[:, None]
        self.kind = np.where(mass[0] >= PROSE_SHARE * mass.sum(0), 0, rate.argmax(0) + 1)

    def passages(self, texts: list[str]) -> np.ndarray:
        """Characters of each kind, one row a text."""
        stats = [line_statistics(t, self.common) for t in texts]
        out = np.zeros((len(texts), len(KINDS)))
        sizes = [len(rows) for rows, _ in stats]
        if not sum(sizes):
            return out
        p = self.mixture.of(scaled(np.array([r for rows, _ in stats for r in rows])))
        by_kind = np.stack([np.logaddexp.reduce(p[:, self.kind == k], 1) if (self.kind == k).any() else np.full(len(p), -1e9) for k in range(len(KINDS))], 1)
        prose = by_kind[:, 0]
        # what no component explains is junk
        by_kind[:, KINDS.index("junk")] = np.logaddexp(by_kind[:, KINDS.index("junk")], BACKGROUND)
        rest = np.logaddexp.reduce(by_kind[:, 1:], 1)
        odds = np.clip(prose - rest, -MOST, MOST)
        other = by_kind[:, 1:].argmax(1) + 1
        at = 0
        for i, (_, chars) in enumerate(stats):
            for is_prose, k, c in zip(likely_run(odds[at : at + len(chars)].tolist()), other[at : at + len(chars)].tolist(), chars, strict=True):
                out[i, 0 if is_prose else k] += c
            at += len(chars)
        return out


def reader_of(texts: list[str], kinds: list[str], common: CommonWords) -> Reader:
    """A reader fitted to whole texts."""
    return Reader([line_statistics(t, common) for t in texts], kinds, common)


def likely_run(odds: list[float]) -> list[bool]:
    """The most probable sequence of prose and other lines, given each line's log odds for prose."""
    if not odds:
        return []
    if all(o > 0 for o in odds) or all(o <= 0 for o in odds):
        return [odds[0] > 0] * len(odds)
    yes, no, back = odds[0], 0.0, []
    for o in odds[1:]:
        from_no, from_yes = no - CHANGE > yes, yes - CHANGE > no
        back.append((not from_no, from_yes))
        yes, no = (no - CHANGE if from_no else yes) + o, (yes - CHANGE if from_yes else no)
    state = yes > no
    out = [state]
    for keep_yes, came_yes in reversed(back):
        state = keep_yes if state else came_yes
        out.append(state)
    return out[::-1]


def fitted(docs: DataFrame, labels: DataFrame, common: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> Reader:
    """A reader fitted to at most ``sample`` labelled documents and ``lines`` lines of each; the common words are a small list."""
    order = F.xxhash64("doc_id")
    known = labels.where(F.col("kind").isin(*KINDS) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("kind").alias("kind"))
    chosen = known.orderBy(order, "doc_id").limit(sample)
    words = common_words(common)
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, chars = [], []
            for text in batch.column("text").to_pylist():
                rows, sizes = line_statistics(text, held.value)
                kept = sorted({round(k) for k in np.linspace(0, len(rows) - 1, min(lines, len(rows)))})
                stats.append([float(x) for k in kept for x in rows[k]])
                chars.append([sizes[k] for k in kept])
            columns = [batch.column("doc_id"), batch.column("kind"), pa.array(stats, pa.list_(pa.float64())), pa.array(chars, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kind", "stats", "chars"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("doc_id", "kind", "text")
    found = rows.mapInArrow(run, f"doc_id {kind}, kind string, stats array<double>, chars array<bigint>").where("size(chars) > 0").collect()
    if not found:
        raise ValueError("no labelled documents to fit to")
    found = sorted(found, key=lambda r: (r["doc_id"], r["kind"]))
    return Reader([(np.array(r["stats"]).reshape(-1, len(FEATURES)).tolist(), r["chars"]) for r in found], [r["kind"] for r in found], words)


def common_words(common: DataFrame) -> CommonWords:
    return CommonWords(r[0] for r in common.where("word is not null").select("word").distinct().collect())


def statistics(docs: DataFrame, common: CommonWords, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, STATISTICS): one row for each text, null and blank ones with no lines and words and without ratios."""
    held = docs.sparkSession.sparkContext.broadcast(common)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_statistics(t, held.value) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in found], pa.float64() if k else pa.int64()) for k in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *STATISTICS])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, lines bigint, " + ", ".join(f"{c} double" for c in STATISTICS[1:]))


def passages(docs: DataFrame, reader: Reader, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chars, prose, list, table, junk): characters of each kind of passage of each text."""
    held = docs.sparkSession.sparkContext.broadcast(reader)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = held.value.passages(texts).astype(np.int64)
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(found[:, k]) for k in range(len(KINDS)))]
            yield pa.RecordBatch.from_arrays(columns, [key, "chars", *KINDS])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, chars bigint, prose bigint, list bigint, table bigint, junk bigint")


def document_passages(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return passages(docs, fitted(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "common_word")))


def document_statistics(spark, sf_dir: str) -> DataFrame:
    return statistics(table(spark, sf_dir, "documents"), common_words(table(spark, sf_dir, "common_word")))


def poor_documents(spark, sf_dir: str) -> DataFrame:
    """(doc_id): documents at least half of whose characters stand in lists, tables or junk."""
    found = document_passages(spark, sf_dir)
    return found.where("prose + list + table + junk > 0 and prose <= list + table + junk").select("doc_id")
