"""Core operators against worked values and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lodesift.functions import protocol
from lodesift.functions.hashing import bits64, fraction, hamming
from lodesift.functions.text import (
    family, first_value, general_number, lexical_distance, mentions, normal_value, one_value, phrase_pattern, plain, replace_phrase, safe_file_name, scattered_mention, words_of,
)
from lodesift.operators import checks, evaluate, graph, reward, split, synthesize
from lodesift.sources import files
from lodesift.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("title, old, new, expected", [
    ("Plum kettle with plum lid", "Plum", "Sea Foam", "Sea Foam kettle with Sea Foam lid"),
    ("Cast.Iron pan, cast+iron lid", "Cast Iron", "Clay", "Clay pan, Clay lid"),
    ("Rug (Teal)/White and [teal–white] mat", "Teal White", "Red", "Rug (Red and [Red] mat"),
    ("Lamp; oak:ash \\ base", "oak ash base", "pine", "Lamp; pine"),
    ("Red and Black bin", "red & black", "Grün", "Grün bin"),
    ("Nothing said here", "Plum", "Blue", "Nothing said here"),
    ("Plumber's tool", "plum", r"US$5\x", "Plumber's tool"),
    ("a plum b", "plum", r"US$5\x", r"a US$5\x b"),
    ("a PLUM b", "plum", "Plum", "a PLUM b"),
    ("a", "??", "b", "a"),
])
def test_replace_phrase(spark, title, old, new, expected):
    assert one(spark, replace_phrase(F.lit(title), F.lit(old), F.lit(new))) == expected


def test_mentions_and_patterns(spark):
    assert one(spark, mentions(F.lit("Plum kettle with plum lid"), F.lit("plum"))) == 2
    assert one(spark, scattered_mention(F.lit("Warm Sand {K7} brush"), F.lit("K7 Warm Sand"))) is True
    assert one(spark, scattered_mention(F.lit("Sand pail of many other little toys K7 Warm"), F.lit("K7 Warm Sand"))) is False
    assert "(?i)" in one(spark, phrase_pattern(F.lit("a b")))


@pytest.mark.parametrize("value, expected", [(0.25, "0.25"), (12.0, "12"), (1.0, "1"), (123456.0, "123456"), (0.0, "0"), (25.5, "25.5"), (0.0001, "0.0001")])
def test_general_number(spark, value, expected):
    assert one(spark, general_number(F.lit(value))) == expected


def test_values_for_comparison(spark):
    names = {"seagreen": "green", "海绿": "green"}
    same = lambda a, b: one(spark, normal_value(F.lit(a), names) == normal_value(F.lit(b), names))
    assert same("1.5 m", "150 cm") and same("RX_200-b", "rx 200 B") and same("sea green", "海绿") and same("35mm", "3.5cm") and not same("25 cm", "26 cm")
    assert same("ＲＸ２００", "rx200") and same("１．５ ｍ", "150cm") and one(spark, normal_value(F.lit(None).cast("string"))) is None
    assert one(spark, safe_file_name(F.lit("image/id:42"))).startswith("image_id_42__")
    assert one(spark, plain(F.lit("  A b\t"))) == "a b"
    assert one(spark, one_value(F.array(F.lit(" a "), F.lit("a"), F.lit("")), 5)) == "a"
    assert one(spark, one_value(F.array(F.lit("a"), F.lit("b")), 5)) is None
    assert one(spark, first_value(F.array(F.lit("toolong"), F.lit("b")), 5)) == "b"
    assert one(spark, lexical_distance(F.lit("red mug"), F.lit("red cup"))) == pytest.approx(2 / 3)
    assert one(spark, lexical_distance(F.lit(""), F.lit("red"))) == 0
    assert one(spark, family(F.lit("Dark Navy"), {"dark": ("navy",), "cool": ("blue",)})) == "dark"
    assert words_of("Ab-c_1 Ünï") == ["ab", "c", "1", "ünï"] and words_of(None) == []


def test_hashes(spark):
    import hashlib

    h = hashlib.sha256(b"x1").hexdigest()
    assert one(spark, fraction(F.lit("x1"))) == int(h[:12], 16) / 16**12
    assert one(spark, hamming(bits64(F.lit("f" * 16)), bits64(F.lit("0" * 15 + "f")))) == 60
    assert one(spark, bits64(F.lit("xyz"))) is None


@pytest.mark.parametrize("text, valid", [
    ('{"decision":"pass","violation_type":"pass","issue_subtype":null,"evidence":null}', True),
    ('{"decision":"reject","violation_type":"wrong_image","issue_subtype":null,"evidence":"detail:1"}', True),
    ('{"decision":"pass","violation_type":"wrong_image","issue_subtype":null,"evidence":null}', False),
    ('{"decision":"reject","violation_type":"color_mismatch","issue_subtype":null,"evidence":"main"}', False),
    ('{"decision":"pass","violation_type":"pass","issue_subtype":null,"evidence":null,"x":null}', False),
    ('```{"decision":"pass","violation_type":"pass","issue_subtype":null,"evidence":null}```', False),
    ('{"decision":"pass","violation_type":"pass","issue_subtype":null,"evidence":null} x', False),
    ('{"decision":1,"violation_type":"pass","issue_subtype":null,"evidence":null}', False),
    ('{"decision":"reject","violation_type":"image_quality","issue_subtype":null,"evidence":"main"}', False),
    ('{"decision":"reject","violation_type":"wrong_image","issue_subtype":null,"evidence":null}', False),
    ('[1]', False), ("NaN", False), (None, False), ("", False),
])
def test_read_answer(spark, text, valid):
    assert one(spark, protocol.read_answer(F.lit(text).cast("string")))["valid"] is valid


def test_raw_decisions(spark):
    rows = spark.createDataFrame([(1, '{"decision": "reject", "x": 1}'), (2, "no"), (3, None), (4, '["a"]')], "id long, text string")
    assert sorted(map(tuple, protocol.raw_decisions(rows, "id", "text").collect())) == [(1, True, "reject"), (2, False, None), (3, False, None), (4, False, None)]


COSTS = {("pass", "reject"): 0.75}


@pytest.mark.parametrize("kind, answer, expected", [
    (("image_quality", "blur", "main"), ("image_quality", "blur", "main"), 1.0),
    (("image_quality", "blur", "main"), ("image_quality", "blur", None), 0.80 * 0.70),
    (("wrong_image", None, "detail:2"), ("wrong_image", None, "detail:1"), 0.65 / 0.85 * 0.70),
    (("image_quality", "blur", "main"), ("image_quality", "occlusion", "main"), 0.85),
    (("category_mismatch", None, None), ("color_mismatch", None, None), 0.30 / 0.65),
])
def test_rewards(spark, kind, answer, expected):
    lit = lambda x: F.lit(x).cast("string")
    answer_of = lambda k: F.struct(lit("reject").alias("decision"), lit(k[0]).alias("violation_type"), lit(k[1]).alias("issue_subtype"), lit(k[2]).alias("evidence"))
    got = one(spark, reward.scores(answer_of(kind), answer_of(answer), F.lit(True), F.lit("reject"), COSTS))
    assert got["reward"] == pytest.approx(expected)


def test_rewards_of_unreadable_answers(spark):
    lit = lambda x: F.lit(x).cast("string")
    made = lambda d, k: F.struct(lit(d).alias("decision"), lit(k).alias("violation_type"), lit(None).alias("issue_subtype"), lit(None).alias("evidence"))
    got = one(spark, reward.scores(made("reject", "image_quality"), made(None, None), F.lit(False), lit(None), COSTS))
    assert got["reward"] == pytest.approx(-0.30) and got["gated"]
    got = one(spark, reward.scores(made("pass", "pass"), made(None, None), F.lit(False), lit("reject"), COSTS))
    assert got["reward"] == pytest.approx(-0.5 * 0.30 / 0.65)


def test_evaluation_counts_missing_predictions(spark):
    gold = spark.createDataFrame([("a", "pass", "pass"), ("b", "reject", "wrong_image")], "sample_id string, decision string, violation_type string")
    said = spark.createDataFrame([("a", "pass", "pass"), ("z", "pass", "pass")], "sample_id string, p_decision string, p_violation_type string")
    pairs = evaluate.paired(gold, said)
    r = evaluate.report(pairs).first()
    assert (r["n"], r["decision_accuracy"], r["complete_accuracy"], r["miss_rate"], r["invalid_rate"]) == (2, 0.5, 0.5, 0.0, 0.5)
    f1 = {x["label"]: x["f1"] for x in evaluate.macro_f1(evaluate.confusion(pairs)).collect()}
    assert f1 == {"pass": 1.0, "reject": 0.0, "INVALID": 0.0}
    assert evaluate.report(pairs.limit(0)).first()["miss_rate"] is None


def test_risk_of_a_published_confusion(spark):
    counts = spark.createDataFrame([("reject", "reject", 153), ("reject", "pass", 22), ("pass", "pass", 21), ("pass", "reject", 4)], "decision string, predicted string, n long")
    assert evaluate.risk(counts, {"pass": 0.6, "reject": 0.4}, {("pass", "reject"): 0.75}).first()[0] == pytest.approx(0.6 * 0.16 * 0.75 + 0.4 * 22 / 175)


def test_splits_and_packing(spark):
    components = [("big", {"x": 3, "y": 1}), ("mid", {"y": 3}), ("two", {"x": 2})] + [(f"s{i:02}", {"xyz"[i % 3]: 1}) for i in range(21)]
    sizes = {"north": 13, "east": 11, "south": 6}
    rows = spark.createDataFrame(components, "component_id string, strata map<string,int>").withColumn("target", F.lit("clash"))
    got = {r["component_id"]: r["target"] for r in split.packed(rows, sizes).collect()}
    weight = {c: sum(s.values()) for c, s in components}
    assert {t: sum(weight[c] for c in got if got[c] == t) for t in sizes} == sizes and set(got) == set(weight)
    assert {r["component_id"]: r["target"] for r in split.packed(rows.repartition(5), sizes).collect()} == got
    for wrong in ({"north": 1}, {f"t{i}": 3 for i in range(10)}):
        with pytest.raises(ValueError):
            split.packed(rows, wrong)
    quotas = split.single_quotas({"x": 7, "y": 5}, {"a": 6, "b": 6}, {("x", "a"): 7.0, ("x", "b"): 0.0, ("y", "a"): 2.0, ("y", "b"): 3.0})
    assert sum(n for (k, _), n in quotas.items() if k == "x") == 7 and sum(n for (_, t), n in quotas.items() if t == "a") == 6 and min(quotas.values()) >= 0
    rows = spark.createDataFrame([(f"k{i}", "ab"[i % 3 == 0]) for i in range(30)], "k string, g string")
    assert split.capped_round_robin(rows, "g", "k", 4, 6).count() == 6
    assert split.capped_round_robin(rows, "g", "k", 4).count() == 8
    assert {r["pooled"] for r in split.pooled_category(rows, "g", 15).collect()} == {"__rare__", "a"}


def test_near_hashes_and_groups_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.getrandbits(63)) for i in range(60)]
    rows += [(100 + i, h ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(0, 7)))) for i, h in rows]
    df = spark.createDataFrame(rows + [(999, None), rows[0]], "id long, h long")
    got = {tuple(r) for r in graph.hamming_pairs(df, "id", "h").collect()}
    assert got == {(a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 4}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long")
    assert {r["group"] for r in graph.groups_of(chain).collect()} == {0, 90}


def test_checks(spark):
    rows = spark.createDataFrame([("a", "train", ["i", None]), ("a", "test", ["i", "j"]), (None, None, None)], "id string, split string, images array<string>")
    assert {tuple(r) for r in checks.repeated(rows, "id").collect()} == {("a", 2), (None, 1)}
    assert [tuple(r) for r in checks.in_several(rows, "images", "split").collect()] == [("i", 2)]
    assert checks.outside(rows, "id", "split", ["train"]).count() == 2
    with pytest.raises(checks.Violation):
        checks.strict(checks.repeated(rows, "id"), "repeated")


def test_allocation_meets_quotas(spark):
    rows = spark.createDataFrame([(f"r{i:02}", i) for i in range(40)], "k string, n int").withColumn("labels", F.lit("clash"))
    quotas = {"a": 40, "b": 9, "c": 31, "d": 40}
    can = {"b": F.col("n") < 12}
    got = {r["k"]: r["labels"] for r in synthesize.allocated(rows, "k", can, quotas).collect()}
    assert len(got) == 40 and all(len(set(x)) == 3 for x in got.values())
    assert {x: sum(x in v for v in got.values()) for x in quotas} == quotas and all(k < "r12" for k, v in got.items() if "b" in v)
    assert {r["k"]: r["labels"] for r in synthesize.allocated(rows.repartition(7), "k", can, quotas).collect()} == got
    with pytest.raises(ValueError):
        synthesize.allocated(rows, "k", can, {"a": 40, "b": 13, "c": 27, "d": 40})
    assert synthesize.adjusted_quota({"pass": 3, "x": 6}, {"x": 4}, 3) == {"pass": 5, "x": 4}
    with pytest.raises(ValueError):
        synthesize.adjusted_quota({"pass": 3}, {}, 3)


def test_compatible_donors_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("xyz"), rng.choice(["Red", "red ", "blue", "", None]), rng.choice(["oak", None, "tin"])) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, b string, color string, material string")
    plain_ = lambda v: (v or "").strip().lower()
    fits = lambda a, b: all(not plain_(p) or not plain_(q) or plain_(p) == plain_(q) for p, q in zip(a[2:], b[2:], strict=True))
    best = {a[0]: min((b[0] for b in rows if b[1] == a[1] and b[0] != a[0] and fits(a, b)), default=None) for a in rows}
    assert {r["k"]: r["donor"] for r in synthesize.compatible_donor(df, "k", "b").collect()} == best
    assert synthesize.compatible_donor(df.limit(0), "k", "b").count() == 0


@pytest.mark.parametrize("fallback", [False, True])
def test_compatible_donors_of_odd_rows_match_brute_force(spark, fallback):
    rng = random.Random(10)
    rows = [(rng.choice([None, *range(70)]), rng.choice(["x", "y", "z", None]), rng.choice(["Red", "red ", "blue", "", None]), rng.choice(["oak", None, "tin", "ash"])) for _ in range(60)] + [(99, "alone", "Red", "oak"), (None, "x", "Red", None)]
    plain_ = lambda v: (v or "").strip().lower()
    fits = lambda a, b: all(not plain_(p) or not plain_(q) or plain_(p) == plain_(q) for p, q in zip(a[2:], b[2:], strict=True))
    near = [(a, b) for a in rows for b in rows if None not in (a[0], b[0], a[1]) and a[0] != b[0] and a[1] == b[1]]
    of = lambda k, pairs: min((b[0] for a, b in pairs if a[0] == k), default=None)
    some, whole = [(a, b) for a, b in near if fits(a, b)], near if fallback else []
    best = {k: x if (x := of(k, some)) is not None else of(k, whole) for k in {a[0] for a in rows}}
    df = spark.createDataFrame(rows, "k long, b string, color string, material string")
    got = [tuple(r) for r in synthesize.compatible_donor(df, "k", "b", fallback=fallback).collect()]
    assert sorted(got, key=repr) == sorted(((a[0], best[a[0]]) for a in rows), key=repr)


@pytest.mark.parametrize("fallback", [False, True])
def test_compatible_donors_send_nothing_through_the_driver(spark, tmp_path, fallback):
    # rows whose file is far smaller than what is made of them
    spark.range(20_000).selectExpr("id AS k", "concat('b', id % 7) AS b", "concat('c', id % 5) AS color", "concat('m', id % 3) AS material").write.parquet(f"{tmp_path}/rows")
    found = synthesize.compatible_donor(spark.read.parquet(f"{tmp_path}/rows"), "k", "b", fallback=fallback)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("donor is not null and donor <> k").count() == 20_000


def test_donors(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", "x", 2), ("d", "y", 1)], "k string, t string, c int")
    assert {tuple(r) for r in synthesize.nearest_donor(rows, "k", "t", ["c"]).collect()} == {("a", "b"), ("b", "a"), ("c", "a"), ("d", None)}


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", "train", None), ("a", "train", 1)], "id string, split string, n int")
    files.write_splits(rows, str(tmp_path / "out"), "split", ["train", "test"])
    assert files.read_lines(spark, str(tmp_path / "out/split=train")).count() == 2
    assert (tmp_path / "out/split=test").exists()
    with pytest.raises(ValueError):
        files.write_splits(rows, str(tmp_path / "bad"), "split", ["test"])
    (tmp_path / "m.json").write_text('{"items": [{"ID": 1}, {"ID": 2}]}')
    read = files.read_records(spark, str(tmp_path / "m.json"))
    assert read.count() == 2 and files.column_of(read, ["sku", "id"]) == "ID"
    files.append_new(rows, str(tmp_path / "log"), "id")
    files.append_new(rows.unionByName(spark.createDataFrame([("c", "x", 1)], rows.schema)), str(tmp_path / "log"), "id")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    assert files.stable_json_hash({"b": 1, "a": "é"}) == files.stable_json_hash({"a": "é", "b": 1})
    assert files.generated_products(spark, 5, {"color": ["red", "blue"]}).count() == 5


def test_stream_of_confusions(spark, tmp_path):
    rows = spark.createDataFrame([("pass", "pass"), ("pass", "reject"), ("pass", "pass")], "decision string, predicted string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(events.confusion_into(str(tmp_path / "counts"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["decision"], r["predicted"]): r["n"] for r in events.accumulated(spark.read.parquet(str(tmp_path / "counts"))).collect()}
    assert got == {("pass", "pass"): 2, ("pass", "reject"): 1}


def test_complete_answers_need_subtype_and_place(spark):
    answer = "decision string, violation_type string, issue_subtype string, evidence string"
    gold = spark.createDataFrame(
        [("p", "pass", "pass", None, None), ("q", "reject", "image_quality", "blur", "detail:1"), ("w", "reject", "wrong_image", None, "detail:2"), ("c", "reject", "category_mismatch", None, None)], f"sample_id string, {answer}"
    )
    said = spark.createDataFrame(
        [("p", "pass", "pass", None, None), ("q", "reject", "image_quality", "low_resolution", "detail:1"), ("w", "reject", "wrong_image", None, "main"), ("c", "reject", "category_mismatch", None, None)],
        "sample_id string, p_decision string, p_violation_type string, p_issue_subtype string, p_evidence string",
    )
    pairs = evaluate.paired(gold, said)
    r = evaluate.report(pairs).first()
    assert (r["decision_accuracy"], r["type_accuracy"], r["complete_accuracy"], r["detection_rate"]) == (1.0, 1.0, 0.5, 1.0)
    assert {x["violation_type"]: x["exact"] for x in evaluate.per_class(pairs).collect()} == {"pass": 1, "image_quality": 0, "wrong_image": 0, "category_mismatch": 1}
    assert evaluate.type_macro_f1(pairs).first()[0] == 1.0
    same = gold.toDF("sample_id", "p_decision", "p_violation_type", "p_issue_subtype", "p_evidence")
    assert evaluate.report(evaluate.paired(gold, same)).first()["complete_accuracy"] == 1.0
    # a record without a place is never complete; without predictions no type is right
    assert evaluate.report(evaluate.paired(gold.drop("evidence"), same)).first()["complete_accuracy"] == 0.5
    lost = evaluate.paired(gold, same.where("sample_id = 'p'"))
    assert evaluate.type_macro_f1(lost).first()[0] == pytest.approx(1 / 5)


def test_packing_by_real_strata(spark, tmp_path):
    from lodesift.plans import catalog

    assert split.shared_out({"a": 2, "b": 1}, 3) == {"a": 2, "b": 1} and split.shared_out({"a": 2, "b": 2}, 3) == {"a": 2, "b": 1} and split.shared_out({}, 2) == {"": 2}
    rows = [(f"c{i:03}", [i], {"x" if i < 50 else "y": 1}) for i in range(100)] + [("c000", [0], {"x": 1}), ("none", [200, 201], None), ("c000", [0, 300], {"x": 2})]
    spark.createDataFrame(rows, "component_id string, member_indices array<bigint>, strata map<string,int>").write.parquet(str(tmp_path / "component.parquet"))
    got = {r["component_id"]: r["target"] for r in catalog.exact_packing(spark, str(tmp_path)).collect()}
    assert len(got) == 101
    tests = [c for c, t in got.items() if t == "test" and c != "none"]
    assert abs(sum(c < "c050" for c in tests) - sum(c >= "c050" for c in tests)) <= 2
