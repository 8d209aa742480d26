"""Leaks, overlaps and text quality."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodesift.functions.text import words_of
from lodesift.llm import leakage, overlap, quality
from lodesift.llm.pictures import named_pictures, split_name


def brute_leak(item, doc):
    a, w = words_of(item), words_of(doc)
    runs = {tuple(a[i : i + 13]) for i in range(len(a) - 12)}
    if any(tuple(w[j : j + 13]) in runs for j in range(len(w) - 12)):
        return True
    if plain_lcs(a, w) < 24:
        return False
    for i in range(len(a) - 29):
        for j in range(max(1, len(w) - 37)):
            if plain_lcs(a[i : i + 30], w[j : j + 38]) >= 24:
                return True
    return False


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_matches_the_plain_one():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [[rng.randrange(6) for _ in range(rng.randrange(0, 20))] for _ in range(2)]
        assert leakage.common_subsequence(a, b) == plain_lcs(a, b)


def planted(rng, vocabulary, many):
    """Items and documents that hold whole, shortened and edited passages of them."""
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([5, 14, 40, 60])))) for i in range(12)]
    docs = [None, "", "  ", "Nothing here."]
    for _ in range(many):
        words = say(rng.randrange(0, 80))
        passage = words_of(rng.choice(items)[1])
        at = rng.randrange(0, max(1, len(passage) - 30))
        passage = passage[at : at + rng.choice([11, 13, 15, 30, 36])]
        for _ in range(rng.randrange(0, 7)):
            k = rng.randrange(len(passage)) if passage else 0
            passage = passage[:k] + rng.choice([[], ["Zz"], ["zz", "yy"]]) + passage[k + rng.randrange(0, 2) :]
        docs.append(" ".join(words[:20] + passage + words[20:]).title())
    return items, docs


@pytest.mark.parametrize("size, share", [(2000, 1.0), (60, 0.97)])
def test_leaks_match_brute_force(spark, size, share):
    items, docs = planted(random.Random(2), [f"w{i}" for i in range(size)], 150)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    found = {tuple(r) for r in leakage.leaked_items(d, i).collect()}
    expected = {(d, i) for d, t in enumerate(docs) for i, item in items if t and brute_leak(item, t)}
    assert found <= expected and len(found) >= share * len(expected) and len(expected) > 10


def test_leaks_come_from_shared_bands_only(spark, monkeypatch):
    items, docs = planted(random.Random(3), [f"w{i}" for i in range(500)], 40)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert leakage.leaked_items(d, i).count() > 0
    whole = leakage.item_bands
    monkeypatch.setattr(leakage, "item_bands", lambda *a: whole(*a).limit(0))
    assert leakage.leaked_items(d, i).count() == 0


def test_size_classes_make_bands_that_miss_little():
    for name, _, _, pieces, common, window in leakage.SIZES:
        for n in range(2 * leakage.STEP * pieces + 1):
            like, r = common / (window + max(n, common) - common), leakage.rows_of_band(name, n)
            assert (1 - like**r) ** (leakage.SKETCHES // r) < 0.001 or r == 1


def test_long_document_with_a_passage_at_its_end(spark):
    item = " ".join(f"tok{i}" for i in range(40))
    text = " ".join(f"w{i % 7919}" for i in range(60_000)) + " " + item
    rows = spark.createDataFrame([(1, text), (2, text[: len(text) - len(item)])], "doc_id long, text string")
    assert [tuple(r) for r in leakage.leaked_items(rows, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [(1, 5)]


def test_leaked_items_of_tables(spark):
    text = " ".join(f"tok{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a {text} b"), (1, f"a {text} b"), (2, None), (3, ""), (4, text.upper())], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, text), (7, text), (8, "short one"), (9, None), (None, text)], "item_id long, text string")
    assert sorted(map(tuple, leakage.leaked_items(docs, items).collect())) == [(1, 7), (4, 7)]
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0
    assert leakage.leaked_items(docs.limit(0), items).count() == 0


def test_full_text_index_finds_whole_words_only():
    rng = random.Random(4)
    words = [bytes(rng.choices(b"abc", k=rng.randrange(1, 9))) for _ in range(300)]
    held, streamed = sorted(set(words[:150])), words[100:]
    line = overlap.met_lines(held, streamed)
    assert [None if k < 0 else held[k] for k in line] == [w if w in set(held) else None for w in streamed]


def test_full_text_index_gives_maximal_matches_and_places():
    rng = random.Random(11)
    lines = sorted({bytes(rng.choices(b"abcd", k=rng.randrange(1, 12))) for _ in range(200)})
    text = b"\n" + b"".join(w + b"\n" for w in lines) + b"\0"
    index = overlap.FullTextIndex(np.frombuffer(text, np.uint8))
    asked = [bytes(rng.choices(b"abcde", k=8)) for _ in range(100)]
    length, place = index.longest(np.frombuffer(b"".join(asked), np.uint8).reshape(-1, 8))
    at = index.located(place)
    for w, n, p in zip(asked, length, at, strict=True):
        assert n == max(k for k in range(9) if w[8 - k :] in text)
        assert n == 0 or text[p : p + n] == w[8 - n :]


def test_overlaps_need_the_index(spark, monkeypatch):
    s = spark.createDataFrame([("a_c_1", "train", ["X1"]), ("b_c_1", "test", ["X1"])], "sample_id string, split string, source_image_ids array<string>")
    a = spark.createDataFrame([("X1", "ab" * 32, "0" * 16)], "image_id string, sha256 string, phash string")
    found = overlap.overlaps(s, a).collect()
    assert [(r["by_key"], r["by_picture"], r["by_near"], r["words"], r["spans"]) for r in found] == [(True, True, True, 2, 1)]
    monkeypatch.setattr(overlap, "met_words", lambda t, e: t.select("word", F.col("word").alias("met")).limit(0))
    monkeypatch.setattr(overlap, "near_hashes", lambda rows: rows.select(F.col("bits").alias("t"), F.col("bits").alias("e")).limit(0))
    assert overlap.overlaps(s, a).count() == 0


def test_spans_are_merged_where_they_touch(spark):
    rows = spark.createDataFrame([([0, 1, 2],), ([0, 2, 3, 7],), ([],)], "at array<int>")
    assert [r[0] for r in rows.select(overlap.merged_spans(F.col("at"))).collect()] == [1, 3, 0]


def test_overlaps_match_brute_force(spark):
    rng = random.Random(6)
    flip = lambda h, n: f"{int(h, 16) ^ sum(1 << b for b in rng.sample(range(64), n)):016x}"
    assets = [(f"ID{i:03}AB", rng.choice([f"{i:064x}", None]), rng.choice([f"{rng.getrandbits(64):016x}", None])) for i in range(40)]
    assets += [(f"TW{i:03}AB", None, flip(a[2], rng.choice([1, 3, 4, 5]))) for i, a in enumerate(assets) if a[2]]
    assets += [("CP001AB", assets[0][1] or "f" * 64, None), assets[3]]
    forms = [lambda a: a[0], lambda a: f" x/{a[0].lower()}.JPG", lambda a: f"image_{a[0]}__12ab.png", lambda a: f"sha256:{a[1]}" if a[1] else a[0], lambda a: f"{a[0]}9", lambda a: None]
    samples = []
    for i in range(60):
        refs = [rng.choice(forms)(rng.choice(assets)) for _ in range(rng.randrange(0, 3))]
        samples.append((f"set_{rng.choice(['c0de', 'C0DE', f'k{i}'])}_{rng.randrange(3):02}_x{i}_{rng.randrange(4):02}", rng.choice(["train", " TRAIN", "val", "Valid", "test", None, ""]), rng.choice([refs, refs, None])))
    samples = list({s[0]: s for s in samples}.values())
    by_id, by_sha = {}, {}
    for a in assets:
        by_id.setdefault(a[0], []).append(a)
        if a[1]:
            by_sha.setdefault(a[1].upper(), []).append(a)

    def shown(refs):
        return [a for r in refs or [] if r for w in re.findall("[A-Z0-9]+", r.upper()) for a in by_id.get(w, []) + by_sha.get(w, [])]

    def side(s):
        return {"train": "t", "val": "e", "valid": "e", "test": "e"}.get((s or "").strip().lower())

    expected = set()
    for x in samples:
        for y in samples:
            if side(x[1]) == "t" and side(y[1]) == "e":
                key = lambda s: (s[0].split("_")[-2].upper(), int(s[0].split("_")[-1]))
                same = any(a[0] == b[0] or a[1] and a[1] == b[1] or a[2] and b[2] and (int(a[2], 16) ^ int(b[2], 16)).bit_count() <= 4 for a in shown(x[2]) for b in shown(y[2]))
                if same or key(x) == key(y):
                    expected.add((x[0], y[0]))
    s = spark.createDataFrame(samples, "sample_id string, split string, source_image_ids array<string>")
    a = spark.createDataFrame(assets, "image_id string, sha256 string, phash string")
    got = {(r["train_id"], r["other_id"]) for r in overlap.overlaps(s, a).collect()}
    assert got == expected and expected
    assert overlap.overlaps(s.limit(0), a).count() == 0
    assert named_pictures(s, a.limit(0)).count() == 0


def test_split_names(spark):
    rows = spark.createDataFrame([(x,) for x in ("val", " VALID ", "Train", "", None)], "split string")
    assert [r[0] for r in rows.select(split_name("split")).collect()] == ["validation", "validation", "train", None, None]


PROSE = "The reviewer looked at the picture and said that it was not the one they had asked for, so we sent it back to the seller."
COMMON = quality.CommonWords("the and said that it was not one they had for so we to at a of in is".split())


def sample_texts(n, rng):
    noun = lambda: "".join(rng.choices("bcdfglmnprst", k=6))
    prose = lambda: " ".join(rng.choice(PROSE.split()) if rng.random() < 0.5 else noun() for _ in range(18)) + "."
    made = {
        "prose": lambda: PROSE + " " + prose(),
        "list": lambda: "\n".join(f"- {noun()} {noun()}" for _ in range(12)),
        "table": lambda: "\n".join(f"{noun()}\t{rng.randrange(999)}\t{noun()}\t{rng.random():.2f}" for _ in range(12)),
        "junk": lambda: "".join(rng.choices("#$%&@*<>{}=+", k=200)),
    }
    return [(made[k](), k) for k in quality.KINDS for _ in range(n)]


def test_reader_tells_kinds_apart():
    rng = random.Random(0)
    fit, held = sample_texts(40, rng), sample_texts(20, rng)
    reader = quality.reader_of([t for t, _ in fit], [k for _, k in fit], COMMON)
    chars = reader.passages([t for t, _ in held])
    right = [(row[0] > row[1:].sum()) == (k == "prose") for row, (_, k) in zip(chars, held, strict=True)]
    assert np.mean(right) >= 0.95
    assert reader.passages(["", "  \n "]).sum() == 0
    assert chars.sum() == sum(len(x) for t, _ in held for x in t.splitlines() if x.strip())


def test_passages_of_a_table(spark):
    fit = sample_texts(30, random.Random(1))
    reader = quality.reader_of([t for t, _ in fit], [k for _, k in fit], COMMON)
    rows = spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (3, " "), (4, PROSE * 3000)], "doc_id long, text string").withColumn("prose", F.lit(0))
    got = [tuple(r) for r in quality.passages(rows, reader).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == [1, 1, 2, 3, 4] and got[2][1:] == (0, 0, 0, 0, 0) and got[3][1] == 1
    assert got[0][2] == len(PROSE) and got[4][1] == len(PROSE) * 3000
    with pytest.raises(ValueError):
        quality.fitted(rows, spark.createDataFrame([], "doc_id long, kind string"), spark.createDataFrame([], "word string"))


def test_fitting_is_bounded_and_reads_labels(spark):
    rows = [(i, t * 40 if i == 0 else t, k) for i, (t, k) in enumerate(sample_texts(30, random.Random(3)))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, " ")], "doc_id long, text string").withColumn("kind2", F.lit(1))
    labels = spark.createDataFrame([(i, k) for i, _, k in rows] + [(900, "junk"), (901, "prose"), (None, "prose"), (5, "odd"), (777, "list")], "doc_id long, kind string")
    words = spark.createDataFrame([(w,) for w in COMMON.words] + [(None,)], "word string")
    reader = quality.fitted(docs, labels, words, lines=7)
    held = sample_texts(20, random.Random(4))
    chars = reader.passages([t for t, _ in held])
    assert np.mean([(row[0] > row[1:].sum()) == (k == "prose") for row, (_, k) in zip(chars, held, strict=True)]) >= 0.9


def test_likely_run_bridges_single_lines():
    assert quality.likely_run([9, 9, -3, 9, 9]) == [True] * 5
    assert quality.likely_run([9, 9, -9, -9, -9]) == [True, True, False, False, False]
    assert quality.likely_run([]) == []


def test_statistics_of_every_text(spark):
    from lodesift.llm import queries

    assert "p10_statistics" in queries.QUERIES
    common = quality.CommonWords(["the", "was", "我们", "的"])
    rows = spark.createDataFrame([(1, "The cat was in.\n\nred; blue"), (2, None), (3, " \n\t"), (4, "我们的书。"), (5, "--- ***")], "doc_id long, text string").withColumn("words", F.lit(0))
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.statistics(rows, common).collect()}
    # letters and digits 3+3+3+2+3+4 of 20 visible characters
    assert got[1] == (2, 6.0, 18 / 6, 2 / 20, 0.5, 2 / 6)
    assert got[2] == got[3] == (0, 0.0, None, None, None, None)
    assert got[4] == (1, 2.0, 2.0, 1 / 5, 1.0, 1.5 / 2)
    assert got[5] == (1, 0.0, None, 1.0, 0.0, None)
    assert quality.statistics(rows.limit(0), common).count() == 0
