"""Mapping freely typed values to a reference list.

All names and aliases of a field stand in one trie, each in every order of its words and without separators; the
orders of long ones are too many to be stored and are made as the search walks them.
A value is searched with a Levenshtein automaton (adjacent letters swapped count as one slip) that walks the
trie and leaves a branch as soon as no continuation can stay within the distance allowed for the value's length; it gives
every entry within that distance.

Labels and remarks around a value are told by structure, not by a word list: words are left off its ends as long as no
entry of the field has such a word, and parts set off by brackets, colons, commas or dashes as long as they hold such a
word.  Of all readings the nearest counts; one with words left off may have fewer slips for its length.

A reference list of at most MOST_REFERENCES entries is sent to the workers, where the rows are mapped without a shuffle.  A
longer one is cut into blocks; the different values meet every block, and the blocks' results are brought together.

Defined results: null and blank values have no row; values of any length are searched whole; the nearer entry goes first, then
the reading with fewer words left off, the name nearer in length and the smaller value_id; 0 reports that no entry is near;
an empty reference list reports every value.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.functions.text import filled
from lodesift.session import Scratch, partitions, table

#: Values longer than the first number may differ by the second from an entry.
SLIPS = ((15, 3), (5, 2), (3, 1), (0, 0))
#: The same where words were left off.
SLIPS_LEFT = ((15, 2), (7, 2), (4, 1), (0, 0))
#: References of more words than this have their orders made during the search (``Orders``) instead of stored; the answers are the same.
ORDERED_ABOVE = 5
#: Letters down to which the nodes of ``Orders`` remember what follows.
KEPT = 3
REMEMBERED = 200_000
#: Entries that a worker holds at once; longer lists are cut into blocks of this size.
MOST_REFERENCES = 100_000
SET_OFF = re.compile(r"[()\[\]{}<>:：;,|!?]+|\s[-–—]+\s|\.\s")


def words_of(value: str) -> list[str]:
    """Lower case words without accents and separators."""
    text = "".join(c for c in unicodedata.normalize("NFKD", value.casefold()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", text.casefold())


def allowed(word: str, slips: tuple[tuple[int, int], ...] = SLIPS) -> int:
    return next((d for length, d in slips if len(word) > length), 0)


class Orders:
    """A trie node of every word order of references, made when it is walked.

    states: (value_id, the words still to come, what is left of the present word).
    """

    def __init__(self, states: Iterable[tuple[int, tuple[str, ...], str]], depth: int = 0):
        self.states, self.depth, self.kept = set(states), depth, None

    def items(self) -> list[tuple[str, Orders | tuple[int, ...]]]:
        if self.kept is not None:
            return self.kept
        ends, after = set(), {}
        for value_id, rest, left in self.states:
            if left:
                after.setdefault(left[0], []).append((value_id, rest, left[1:]))
            elif not rest:
                ends.add(value_id)
            else:
                for w in set(rest):
                    k = rest.index(w)
                    after.setdefault(w[0], []).append((value_id, rest[:k] + rest[k + 1 :], w[1:]))
        out = [(c, Orders(s, self.depth + 1)) for c, s in after.items()] + ([("", tuple(sorted(ends)))] if ends else [])
        if self.depth <= KEPT:
            self.kept = out
        return out


class Trie:
    """Reference spellings, searched within a distance."""

    def __init__(self, entries: Iterable[tuple[int, list[str]]]):
        self.root: dict = {}
        self.longest = 0
        self.vocabulary: set[str] = set()
        long = []
        for value_id, spellings in sorted(entries):
            for spelling in spellings:
                words = words_of(spelling or "")
                if words:
                    self.vocabulary.update(words)
                    self.longest = max(self.longest, sum(map(len, words)))
                    if len(words) > ORDERED_ABOVE:
                        long.append((value_id, tuple(sorted(words)), ""))
                    else:
                        for order in set(permutations(words)):
                            self.add("".join(order), value_id)
        self.long = Orders(long)
        self.searched = lru_cache(REMEMBERED)(self.search)

    def add(self, path: str, value_id: int) -> None:
        self.longest = max(self.longest, len(path))
        node = self.root
        for c in path:
            node = node.setdefault(c, {})
        ends = node.get("", ())
        if value_id not in ends:
            node[""] = (*ends, value_id)

    def within(self, word: str, most: int) -> Iterator[tuple[int, int, int]]:
        """(distance, difference in length, value_id) of every spelling within ``most`` slips."""
        n = len(word)
        if n > self.longest + most:
            return
        stack = [(node, c, None, list(range(n + 1)), None, 1) for c, node in [*self.root.items(), *self.long.items()] if c]
        while stack:
            node, c, last, above, before, depth = stack.pop()
            row = [depth]
            low = depth
            lo, hi = max(1, depth - most), min(n, depth + most)
            row += [most + 1] * (lo - 1)
            for j in range(lo, hi + 1):
                x = above[j - 1] + (word[j - 1] != c)
                if row[j - 1] < x:
                    x = row[j - 1] + 1
                if j < len(above) and above[j] < x:
                    x = above[j] + 1
                if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == c and before[j - 2] < x:
                    x = min(x, before[j - 2] + 1)
                row.append(x)
                low = min(low, x)
            row += [most + 1] * (n - hi)
            if low > most:
                continue
            for k, child in node.items():
                if k:
                    stack.append((child, k, c, row, above, depth + 1))
                elif row[n] <= most:
                    for value_id in child:
                        yield row[n], abs(depth - n), value_id

    def search(self, word: str) -> tuple[tuple[int, int, int], ...]:
        """(distance, difference in length, value_id) of every entry within the distance allowed for the word, nearest first."""
        best: dict[int, tuple[int, int]] = {}
        for distance, apart, value_id in self.within(word, allowed(word)):
            best[value_id] = min(best.get(value_id, (distance, apart)), (distance, apart))
        return tuple(sorted((d, a, v) for v, (d, a) in best.items()))


class Words:
    """The words of a field's references, to tell what is none of them: a word of five letters or more may have two slips, a shorter one of the two one."""

    def __init__(self, words: Iterable[str]):
        self.trie = Trie((len(w), [w]) for w in words)
        self.near = lru_cache(REMEMBERED)(self.is_near)

    def is_near(self, word: str) -> bool:
        return any(d <= (2 if min(len(word), size) >= 5 else 1) for d, _, size in self.trie.within(word, 2 if len(word) >= 5 else 1))


def parts_of(value: str) -> list[list[str]]:
    """The words of each part that is set off."""
    return [w for w in map(words_of, SET_OFF.split(value)) if w]


def ends(parts: list[list[str]], known: list[bool]) -> list[int]:
    """Numbers of words that may be left off at the beginning: whole parts with an unknown word, then unknown words."""
    out, at = [0], 0
    for part in parts:
        flags = known[at : at + len(part)]
        for k, flag in enumerate(flags[:-1]):
            if flag:
                break
            out.append(at + k + 1)
        if all(flags):
            break
        at += len(part)
        out.append(at)
    return out


def readings(parts: list[list[str]], known: list[bool], most: int) -> Iterator[tuple[str, int]]:
    """(letters, words left off) of the shorter readings of at most ``most`` letters."""
    words = [w for part in parts for w in part]
    sizes = [0]
    for w in words:
        sizes.append(sizes[-1] + len(w))
    tails = [len(words) - k for k in ends([part[::-1] for part in parts[::-1]], known[::-1])]
    for begin in ends(parts, known):
        for end in tails:
            if begin < end and end - begin < len(words) and sizes[end] - sizes[begin] <= most:
                yield "".join(words[begin:end]), len(words) - (end - begin)


def entries(trie: Trie, value: str, known: list[bool] | None, words: Words | None = None) -> list[tuple[int, int, int, int]]:
    """(distance, words left off, difference in length, value_id) of every near entry, best first.

    known: whether each word of the value is near a reference's; found by ``words`` if not given.
    """
    parts = parts_of(value)
    every = [w for part in parts for w in part]
    if not every:
        return []
    most = trie.longest + SLIPS[0][1]
    found = [(d, 0, a, v) for d, a, v in trie.searched("".join(every))] if sum(map(len, every)) <= most else []
    if not found or found[0][0]:
        if known is None:
            known = [words.near(w) for w in every]
        for letters, left in readings(parts, known, most):
            found += [(d, left, a, v) for d, a, v in trie.searched(letters) if d <= allowed(letters, SLIPS_LEFT)]
    best: dict[int, tuple[int, int, int]] = {}
    for *rank, value_id in found:
        best[value_id] = min(best.get(value_id, tuple(rank)), tuple(rank))
    return sorted((*rank, v) for v, rank in best.items())


class Field:
    """The references of a field: nearest entry and all near ones of a value."""

    def __init__(self, references: Iterable[tuple[int, list[str]]]):
        self.trie = Trie(references)
        self.words = Words(self.trie.vocabulary)
        self.near = lru_cache(REMEMBERED)(lambda value: entries(self.trie, value, None, self.words))

    def nearest(self, value: str) -> int:
        found = self.near(value)
        return found[0][-1] if found else 0


def reference_rows(values: DataFrame) -> DataFrame:
    """(field_name, value_id, spellings) of the entries that have an id and a field."""
    spellings = F.filter(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    return values.where("value_id is not null and field_name is not null").select("field_name", "value_id", spellings.alias("spellings"))


def typed_values(rows: DataFrame, fields: Iterable[str], key: str | None = None) -> DataFrame:
    """(key, field_name, value) of every value that is neither null nor blank, once each."""
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
    kept = rows.where(F.col(key).isNotNull()) if key else rows
    return kept.select(*([key] if key else []), F.explode(each).alias("x")).select(*([key] if key else []), "x.*").where(filled("value")).distinct()


def near_entries(values: DataFrame, references: DataFrame, most: int = MOST_REFERENCES) -> DataFrame:
    """(field_name, value, distance, left, apart, value_id): every entry near each value.

    values: (field_name, value), once each; left is the number of words left off the value.
    """
    out = "field_name string, value string, distance int, left int, apart int, value_id bigint"
    count = references.count()
    if count <= most:
        held = values.sparkSession.sparkContext.broadcast([(r[0], r[1], r[2]) for r in references.collect()])

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fields = {f: Field((v, s) for g, v, s in held.value if g == f) for f in {g for g, _, _ in held.value}}
            for batch in batches:
                rows = [(f, v, *e) for f, v in zip(batch["field_name"], batch["value"], strict=True) if f in fields for e in fields[f].near(v)]
                yield pd.DataFrame(rows, columns=["field_name", "value", "distance", "left", "apart", "value_id"])

        return values.mapInPandas(search, out)
    return blocked_entries(values, references, -(-count // most), out)


def blocked_entries(values: DataFrame, references: DataFrame, blocks: int, out: str) -> DataFrame:
    """As near_entries, for a list in ``blocks`` blocks: which words are known is found in all blocks first, then the entries."""
    salts = max(1, partitions(values.sparkSession) // blocks)
    scratch = Scratch(values.sparkSession, "canonical")
    block = F.pmod(F.xxhash64("value_id"), F.lit(blocks)).cast("int")
    held = references.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), block.alias("block"), F.col("field_name").alias("f"), "value_id", "spellings").groupBy("block", "salt")

    def met(rows: DataFrame, hashed: list[str]) -> DataFrame:
        return rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int").alias("salt"), *rows.columns).groupBy("block", "salt")

    def of_fields(own: pd.DataFrame) -> dict[str, list[tuple[int, list[str]]]]:
        fields: dict[str, list[tuple[int, list[str]]]] = {}
        for f, v, s in zip(own["f"], own["value_id"], own["spellings"], strict=True) if len(own) else ():
            fields.setdefault(f, []).append((v, list(s)))
        return fields

    def near_words(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        words = {f: Words(Trie(e).vocabulary) for f, e in of_fields(own).items()}
        found = [(f, w) for f, w in zip(rows["field_name"], rows["word"], strict=True) if f in words and words[f].near(w)] if len(rows) else []
        return pd.DataFrame(found, columns=["field_name", "word"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [[w for part in parts_of(v) for w in part] for v in batch["value"]]
            yield batch.assign(words=words)

    spelled = scratch.write(values.mapInPandas(split, "field_name string, value string, words array<string>"), "spelled")
    flat = spelled.select("field_name", "value", F.posexplode("words").alias("at", "word"))
    known = met(flat.select("field_name", "word").distinct(), ["field_name", "word"]).cogroup(held).applyInPandas(near_words, "field_name string, word string").distinct().withColumn("known", F.lit(True))
    flags = flat.join(known, ["field_name", "word"], "left").groupBy("field_name", "value").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("known", F.lit(False)).alias("known")))).alias("flags"))
    flags = scratch.write(flags.select("field_name", "value", F.transform("flags", lambda x: x["known"]).alias("known")), "flags")

    def search(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        tries = {f: Trie(e) for f, e in of_fields(own).items()}
        found = [(f, v, *e) for f, v, k in zip(rows["field_name"], rows["value"], rows["known"], strict=True) if f in tries for e in entries(tries[f], v, list(k))] if len(rows) else []
        return pd.DataFrame(found, columns=["field_name", "value", "distance", "left", "apart", "value_id"])

    found = scratch.write(met(flags, ["field_name", "value"]).cogroup(held).applyInPandas(search, out), "found")
    # a block without the exact entry also tries shorter readings; where another block has it they do not count
    exact = found.where("distance = 0 and left = 0").select("field_name", "value").distinct()
    return found.where("left = 0").unionByName(found.where("left > 0").join(exact, ["field_name", "value"], "left_anti"))


def map_values(rows: DataFrame, references: DataFrame, fields: Iterable[str], key: str, most: int = MOST_REFERENCES) -> DataFrame:
    """(key, field_name, value_id), once each, for every field of every row that is neither null nor blank.

    references: (field_name, value_id, spellings).
    """
    names, count = list(fields), references.count()
    kind = rows.schema[key].dataType.simpleString()
    if count > most:
        typed = Scratch(rows.sparkSession, "canonical").write(typed_values(rows, names, key), "typed")
        near = near_entries(typed.select("field_name", "value").distinct(), references, most)
        best = near.groupBy("field_name", "value").agg(F.min(F.struct("distance", "left", "apart", "value_id"))["value_id"].alias("value_id"))
        return typed.join(best, ["field_name", "value"], "left").select(key, "field_name", F.coalesce("value_id", F.lit(0).cast("bigint")).alias("value_id")).distinct()
    held = rows.sparkSession.sparkContext.broadcast([(r[0], r[1], r[2]) for r in references.collect()])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {f: Field((v, s) for g, v, s in held.value if g == f) for f in names}
        for batch in batches:
            for f in names:
                value = batch[f]
                value = value[value.notna()]
                value = value[value.str.strip() != ""]
                ids = value.map({v: known[f].nearest(v) for v in value.unique()}).astype("int64")
                yield pd.DataFrame({key: batch.loc[value.index, key], "field_name": f, "value_id": ids})

    return rows.select(key, *names).where(F.col(key).isNotNull()).mapInPandas(search, f"{key} {kind}, field_name string, value_id bigint").distinct()


def product_values(spark, sf_dir: str) -> DataFrame:
    return map_values(table(spark, sf_dir, "all_product"), reference_rows(table(spark, sf_dir, "canonical_value")), ("color", "material"), "product_id")


def product_entries(spark, sf_dir: str) -> DataFrame:
    """(field_name, value, value_id, distance, left): every entry near each typed value, with the words left off."""
    values = typed_values(table(spark, sf_dir, "all_product"), ("color", "material"))
    near = near_entries(values, reference_rows(table(spark, sf_dir, "canonical_value")))
    return near.select("field_name", "value", "value_id", "distance", "left")
