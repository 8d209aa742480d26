"""Canonical values, proportional and stable samples, encoding."""

import math

import pytest
from pyspark.sql import functions as F

from lodesift.llm import encode, stable_sample
from lodesift.llm.canonical import Field, Trie, map_values, near_entries, reference_rows, typed_values
from lodesift.llm.proportions import Reservoir, matched, proportional_sample, reservoirs

REFERENCES = [("color", 1, ["Navy Blue", "navy", "深蓝"]), ("color", 2, ["Blue", "azul"]), ("color", 3, ["Mint Green"]), ("color", 4, ["Red"]), ("material", 9, ["Faux Leather"])]


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("typed, value", [
    ("Navy Blue", 1), ("blue, navy", 1), ("NAVY", 1), ("深蓝", 1), ("nayv bule", 1), ("color: Azul", 2), ("mint_green (see photo)", 3), ("Min Green", 3), ("rde", 0), ("#12", 0), ("see photo", 0), ("ré d", 4), ("x" * 100_000, 0),
])
def test_nearest_value(typed, value):
    assert Field([(v, s) for f, v, s in REFERENCES if f == "color"]).nearest(typed) == value


@pytest.mark.parametrize("typed, value", [
    ("Red tone", 4), ("red (see description)", 4), ("Red - per listing", 4), ("navy blue, see pics", 1), ("Shade: mint green", 3), ("approx. rde", 0), ("approx. nayv bule", 1), ("100% azul", 2), ("red green", 0), ("Azul 12 #3", 2),
    ("(Red)", 4), ("some words of no entry", 0), ("mint grene finish", 3), ("!?", 0),
])
def test_labels_and_remarks_without_a_word_list(typed, value):
    assert Field([(v, s) for f, v, s in REFERENCES if f == "color"]).nearest(typed) == value


def test_all_entries_within_the_distance(spark):
    rows = spark.createDataFrame([(f, v, s[0], s[1:]) for f, v, s in [*REFERENCES, ("color", 5, ["Rad"]), ("color", 6, ["Redd"])]], "field_name string, value_id long, canonical_name string, aliases array<string>")
    values = spark.createDataFrame([("color", "redo"), ("color", "red"), ("material", "red")], "field_name string, value string")
    got = {(r["value"], r["field_name"], r["value_id"], r["distance"]) for r in near_entries(values, reference_rows(rows)).collect()}
    assert got == {("redo", "color", 4, 1), ("redo", "color", 6, 1), ("red", "color", 4, 0)}


def test_trie_distances_match_brute_force():
    trie = Trie([(1, ["abcde"]), (2, ["abxde"]), (3, ["hello world"])])
    for word in ("abcde", "abdce", "acde", "abcdeff", "helloworld", "hlelowrld", "zzz", ""):
        for most in (0, 1, 2, 3):
            got = {v for _, _, v in trie.within(word, most)}
            assert got == {v for v, path in ((1, "abcde"), (2, "abxde"), (3, "helloworld"), (3, "worldhello")) if osa(word, path) <= most}


def test_map_values_of_rows(spark):
    rows = spark.createDataFrame(
        [("a", "NAVY", None), ("a", "NAVY", None), ("b", "  ", "faux/leather"), ("c", "Qwertz", ""), (None, "red", "red")], "product_id string, color string, material string"
    ).withColumn("value_id", F.lit("clash"))
    references = spark.createDataFrame(REFERENCES, "field_name string, value_id long, spellings array<string>")
    got = sorted(map(tuple, map_values(rows, references, ("color", "material"), "product_id").collect()))
    assert got == [("a", "color", 1), ("b", "material", 9), ("c", "color", 0)]
    assert {r["value_id"] for r in map_values(rows, references.limit(0), ("color",), "product_id").collect()} == {0}
    assert map_values(rows.limit(0), references, ("color",), "product_id").count() == 0


def test_a_list_in_blocks_gives_the_same(spark):
    references = spark.createDataFrame([*REFERENCES, ("color", 5, ["Slate Blue"]), ("color", 6, ["Teal"])], "field_name string, value_id long, spellings array<string>")
    typed = ["Navy", "blue slaet", "red teal", "Red tone", "mint green (see pics)", "Teal blue", "tael!", "none", "", None, "azul, 3", "leather, faux"]
    rows = spark.createDataFrame([(f"p{i}", t, t) for i, t in enumerate(typed)] * 2, "product_id string, color string, material string")
    whole, parts = (sorted(map(tuple, map_values(rows, references, ("color", "material"), "product_id", most=n).collect())) for n in (100, 2))
    assert whole == parts and len(whole) == 20
    values = typed_values(rows, ("color", "material"))
    one, two = (sorted(map(tuple, near_entries(values, references, most=n).collect())) for n in (100, 2))
    assert one == two and one


def test_proportions_report_and_sample(spark):
    rows = [(f"p{i}", "Pass " if i % 2 else "bad", "easy" if i < 10 else None, "chair") for i in range(100)]
    records = spark.createDataFrame(rows + rows[:20] + [(None, "pass", None, None)], "product_id string, violation_type string, difficulty string, category string")
    targets = spark.createDataFrame(
        [(1, "s", "pass", None, None, 5000, 1), (2, "s", None, "EASY", None, 10000, 1), (3, "s", None, None, None, 10000, 0), (4, "t", "none such", None, None, 1, 3), (5, "t", None, None, None, None, None)],
        "target_id long, target_set string, violation_type string, difficulty string, category string, share_bp long, min_rows long",
    )
    sample, report = proportional_sample(records, targets)
    got = {r["target_id"]: (r["need"], r["available"], r["taken"], r["exhausted"]) for r in report.collect()}
    assert got == {1: (10, 50, 10, False), 2: (20, 10, 10, True), 3: (20, 100, 20, False), 4: (3, 0, 0, True), 5: (0, 100, 0, False)}
    taken = {tuple(r) for r in sample.collect()}
    assert len(taken) == 40 and all(int(i[1:]) % 2 for s, t, i in taken if t == 1)
    again, _ = proportional_sample(records.repartition(5), targets)
    assert {tuple(r) for r in again.collect()} == taken
    _, none = proportional_sample(records.limit(0), targets)
    assert {r["target_id"] for r in none.collect() if r["exhausted"]} == {1, 2, 4}


def test_reservoirs_are_bounded_and_merge(spark):
    import numpy as np

    r, rng = Reservoir(20), np.random.default_rng(1)
    levels = rng.permutation(5000)
    for part in np.array_split(levels, 37):
        r.add(part, part.astype(object))
        assert len(r.ids) <= 2 * 20
    r.trim()
    assert sorted(r.ids) == list(range(20)) and r.seen == 5000
    records = spark.range(3000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("k"), F.lit("x").alias("violation_type"), F.lit(None).cast("string").alias("difficulty"), F.lit(None).cast("string").alias("category"))
    wanted = spark.createDataFrame([(1, 50, "x", None, None), (2, 0, None, None, None), (3, 9, "y", None, None)], "target_id long, most long, _violation_type string, _difficulty string, _category string")
    held = reservoirs(matched(records.unionByName(records), wanted, "k", ("violation_type", "difficulty", "category")), 7)
    got = {r["target_id"]: (r["seen"], r["kept"], r["tasks"]) for r in held.groupBy("target_id").agg(F.sum("n").alias("seen"), F.count("id").alias("kept"), F.count("n").alias("tasks")).collect()}
    assert got[None][0] == got[1][0] == got[2][0] == 3000 and got[None][1] == got[2][1] == 0 and 50 <= got[1][1] <= 50 * got[1][2] and 3 not in got


def test_stable_sample_keeps_what_it_held(spark, tmp_path):
    first = spark.createDataFrame([(f"s{i}", 1.0 + i % 3) for i in range(500)] + [(None, 9.0)], "id string, w double")
    later = spark.createDataFrame([(f"s{i}", 0.5) for i in range(400)] + [(f"n{i}", 2.0) for i in range(300)] + [("bad", math.nan), ("neg", -1.0)], "id string, w double")
    state = str(tmp_path / "state")
    one = {r["id"] for r in stable_sample.grown_sample(first, "id", "w", state, 0.1).collect()}
    two = {r["id"] for r in stable_sample.grown_sample(later.repartition(3), "id", "w", state, 0.1).collect()}
    assert one and one <= two and not {"bad", "neg", None} & two
    together = stable_sample.select(stable_sample.running_weights(first.unionByName(later), "id", "w"), 0.1)
    assert {r["id"] for r in together.collect()} == two
    assert 50 < len(one) < 160


TEXTS = ["Hello world, it's 2025.", "", None, "  two  spaces \n\n tabs\t\tend  ", "深蓝 <|endoftext|> ñandú 😀", "a b" * 3000 + "word " * 9000, "x" * 3000, "　 "]


def test_encoding_round_trip_and_special_strings(spark):
    import tiktoken

    rows = spark.createDataFrame(list(enumerate(TEXTS)) + [(1, "again")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = encode.encode_texts(rows)
    got = {r["doc_id"]: r["ids"] for r in out.where("doc_id <> 1").collect()}
    assert got[2] == [] and out.where("doc_id = 1 and size(ids) = 0").count() == 1
    back = {r["doc_id"]: bytes(r["raw"]).decode() for r in encode.decode_ids(out.where("doc_id <> 1")).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS) if i != 1)
    with open(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        enc = encode.encoding(f.read())
    assert isinstance(enc, tiktoken.Encoding)
    for t in TEXTS:
        assert encode.encode(enc, t, long=50, part=20) == (enc.encode_ordinary(t) if t else [])
    assert encode.encode_texts(rows.limit(0)).count() == 0


def test_long_references_in_any_word_order():
    from itertools import permutations

    long = "soft red wool and silk blend blend"
    trie = Trie([(7, [long]), (8, ["soft red wool and linen blend"]), (9, ["red"])])
    paths = {v: {"".join(p) for p in permutations(s.split())} for v, s in ((7, long), (8, "soft red wool and linen blend"), (9, "red"))}
    for typed in (long, "blend silk and wool red soft blend", "silk blend soft blend and wool red", "blend sikl and wol red soft blend", "linen blend and red wool soft", "wihte wool and red silk soft blend blend", "blend blend blend"):
        word = "".join(typed.split())
        got = {(d, v) for d, _, v in trie.within(word, 2)}
        expected = {(d, v) for v, p in paths.items() for x in p if abs(len(x) - len(word)) <= 2 and (d := osa(x, word)) <= 2}
        assert got == expected
    assert Field([(7, [long]), (8, ["soft red wool and linen blend"]), (9, ["red"])]).nearest("blend, sikl and wol red soft blend") == 7
    many = " ".join(f"w{i}x" for i in range(14))
    assert Field([(1, [many])]).nearest(" ".join(reversed(many.split()))) == 1


def test_grown_sample_after_a_lost_call(spark, tmp_path):
    first = spark.createDataFrame([(f"s{i}", 3.0) for i in range(300)], "id string, w double")
    later = spark.createDataFrame([(f"s{i}", 0.5) for i in range(400)], "id string, w double")
    state = tmp_path / "state"
    ids = lambda rows: {r["id"] for r in rows.collect()}
    one = ids(stable_sample.grown_sample(first, "id", "w", str(state), 0.1))
    stable_sample.bring_in(later, "id", "w", str(state))
    lost = next(p for p in state.iterdir() if spark.read.parquet(str(p)).count() == 400)
    (lost / "_SUCCESS").unlink()  # lost before the end of the write
    assert ids(stable_sample.select(stable_sample.maxima(spark, str(state)), 0.1)) == one
    two = ids(stable_sample.grown_sample(later, "id", "w", str(state), 0.1))
    assert one and one <= two
    assert ids(stable_sample.grown_sample(later, "id", "w", str(state), 0.1)) == two  # the same delivery twice
    stable_sample.compact(spark, str(state))
    assert len(stable_sample.stored(spark, str(state))) == 1 and ids(stable_sample.select(stable_sample.maxima(spark, str(state)), 0.1)) == two
    assert stable_sample.maxima(spark, str(tmp_path / "none")) is None


def test_deliveries_one_by_one_give_the_sample_of_all(spark):
    from lodesift.llm import queries

    got, whole = (sorted(map(tuple, queries.QUERIES[q](spark, "/root/testdata/sf0.001").collect())) for q in ("p7_at_once", "p7_sample"))
    assert got == whole and whole
