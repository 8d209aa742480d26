"""Curation, exports, contracts and sources on small inputs with known results."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from lodesift.functions import listing, protocol, spans, title
from lodesift.functions.text import flat_references, references_in
from lodesift.operators import checks, curate, evaluate, exports, reward, split, synthesize
from lodesift.session import lookup, numbered, ranked
from lodesift.sources import files, manifests, pictures


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, old, new, expected", [
    ("Grey wool hat, GRAY brim", "gray", "Lime", ("Lime wool hat, Lime brim", "replace_all", 2, None)),
    ("Navy-blue cap", "navy", "Tan", ("Tan cap", "replace_all", 1, None)),
    ("Sand Warm K7 brush", "K7 Warm Sand", "Tan", ("Sand Warm K7 brush", None, None, "ambiguous")),
    ("Brush", "Teal", "Tan", ("Brush", "no_mention", 0, None)),
    ("Brush", "", "Tan", ("Brush", None, None, "empty")),
    ("Brush", "Teal", None, ("Brush", None, None, "empty")),
    ("Brush", "??", "Tan", ("Brush", "no_mention", 0, None)),
])
def test_title_mutation(spark, text, old, new, expected):
    lit = lambda x: F.lit(x).cast("string")
    m = one(spark, title.mutation(lit(text), "color", lit(old), lit(new)))
    assert (m["title"], m["policy"], m["replaced_mentions"], m["error"]) == expected
    with pytest.raises(ValueError):
        title.spellings("brand", "x")


def test_eligible_titles(spark):
    ok = lambda t, v: one(spark, title.title_eligible(F.lit(t), "material", F.lit(v).cast("string")))
    assert ok("Aluminium pot", "aluminum") and ok("Clay pot", "steel") and not ok("Oak hard chair", "hard oak") and not ok("pot", None) and not ok("pot", "")
    assert one(spark, title.same_or_empty(F.lit("Red "), F.lit("red"))) and one(spark, title.same_or_empty(F.lit(""), F.lit("red"))) and not one(spark, title.same_or_empty(F.lit("tan"), F.lit("red")))


def test_localized_values(spark):
    rows = spark.createDataFrame([(1, [("en", " a "), ("en", "a"), ("de", "b")]), (2, [("en", "a"), ("en", "c")]), (3, [("de", "b"), ("de", "")]), (4, None), (5, [("de", "x" * 99), ("fr", "z")])], "k int, v array<struct<language_tag:string,value:string>>")
    got = {r["k"]: tuple(r)[1:] for r in rows.select("k", listing.unique_text("v", "en", 9), listing.title_of("v", "en", 9), listing.brand_of("v", "en", 9)).collect()}
    assert got == {1: ("a", "a", "a"), 2: (None, "a", None), 3: (None, "b", "b"), 4: (None, None, None), 5: (None, "z", "z")}
    assert one(spark, listing.product_type(None, F.lit("  "))) is None and one(spark, listing.product_type(None, F.lit(" MUG "))) == "MUG"


def test_measures(spark):
    m = lambda v, u: F.struct(F.lit(v).cast("double").alias("value"), F.lit(u).cast("string").alias("unit"))
    assert one(spark, listing.dimensions(m(1.5, "in"), m(None, "in"), m(12.0, "in"))) == "W 1.5 in x H 12 in"
    assert one(spark, listing.dimensions(m(None, "in"), m(2, None), m(2, ""))) is None
    assert one(spark, listing.weight(F.array(m(0.25, "kg")))) == "0.25 kg" and one(spark, listing.weight(F.array(m(1, "g"), m(1, "g")))) is None
    assert one(spark, listing.family_key(F.lit("mug"), F.lit("Ab"), F.lit(" X10 ")))["model"] == "x10" and one(spark, listing.family_key(F.lit("mug"), F.lit("A"), F.lit("X10"))) is None


def test_usable_pictures_and_candidates(spark):
    rows = spark.createDataFrame([("a", "t", ["p3", "p1", None, "p2", "p4"]), ("b", "", ["p1", "p2"]), ("c", "t", ["p9"]), ("d", "t", None)], "k string, title string, ids array<string>").withColumn("usable", F.lit("clash"))
    pictures = spark.createDataFrame([("p1", 9, 9), ("p2", 9, 9), ("p3", 9, 1), ("p4", 9, 9), ("p4", 9, 9), ("p9", None, 9)], "id string, width int, height int")
    found = curate.usable_pictures(rows, pictures, "k", "ids", "id", 5, 5, keep=2)
    assert {r["k"]: (r["image_ids"], r["usable"]) for r in found.collect()} == {"a": (["p1", "p2"], 3), "b": (["p1", "p2"], 2)}
    assert [r["k"] for r in curate.candidates(rows.drop("usable"), found, "k", ["title"], 2).collect()] == ["a"]


def test_joins_of_curation(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "k string, n int")
    assert sorted(map(tuple, curate.prioritized([a, b], "k").collect())) == [("x", 1), ("y", 2), ("z", 4)]
    assert sorted(map(tuple, curate.unmatched(a, b, "k").collect())) == [("left", "x"), ("right", "z")]
    with pytest.raises(checks.Violation):
        curate.correspond(a, "k", b.withColumnRenamed("n", "m"), "k")
    with pytest.raises(checks.Violation):
        curate.dependency(a.unionByName(b), "k", "n")
    assert curate.dependency(a, "k", "n").count() == 2
    names = spark.createDataFrame([("step_9",), ("step_10",), ("last",)], "name string")
    assert curate.latest(names, "name").first()["name"] == "step_10" and curate.latest(names.limit(0), "name").count() == 0
    assert {tuple(r) for r in curate.enriched(a, b.toDF("k", "m"), "k", {"m": F.lit(0)}).collect()} == {("x", 1, 0), ("y", 2, 3)}


def made(spark):
    image = lambda x: {"image_id": x}
    rows = [("p1", "pass", None, None, "a"), ("p2", "image_quality", "blur", "main", "a"), ("p3", "wrong_image", None, None, "a"), ("p4", "pass", None, None, "gone"), ("p5", "odd", None, None, "a"), (None, "pass", None, None, "a")]
    data = [(p, p, "T", "c", None, "m", {"main": image(i), "detail": [image("b"), image("c")]}, "easy", k, s, r) for p, k, s, r, i in rows]
    schema = "product_id string, source_product_id string, title string, category string, color string, material string, images struct<main:struct<image_id:string>,detail:array<struct<image_id:string>>>, difficulty string, violation_type string, issue_subtype string, target_image_ref string"
    return spark.createDataFrame(data, schema), spark.createDataFrame([(x, f"sha-{x}") for x in "abc"], "image_id string, sha256 string")


def test_export_rows(spark):
    rows, contents = made(spark)
    whole = exports.normalized(rows, contents, "sft", "train")
    assert {r["sample_id"]: r["fault"] for r in whole.collect()} == {"sft_train_p1": None, "sft_train_p2": None, "sft_train_p3": "target_image_ref", "sft_train_p4": "images", "sft_train_p5": "violation_type", None: "id"}
    good = whole.where("fault is null")
    sft = exports.sft_rows(good, "Say.")
    first = sft.orderBy("sample_id").first()
    assert first["conversations"][0]["value"].startswith("main: <image>\ndetail:1: <image>") and first["conversations"][0]["value"].endswith("color: N/A\nmaterial: m\n\nSay.")
    assert json.loads(first["conversations"][1]["value"]) == {"decision": "pass", "violation_type": "pass", "issue_subtype": None, "evidence": None}
    assert checks.sft_faults(sft, "train", "Say.").count() == 0 and checks.sft_faults(sft, "validation", "Say.").count() == 2
    assert exports.messages(sft, "Say.").where("fault is null and size(messages) = 2").count() == 2 and exports.messages(sft, "Else.").where("fault = 'prompt'").count() == 2
    rl = exports.rl_rows(good, "Say.")
    assert [r["extra_info"]["index"] for r in rl.orderBy("extra_info.sample_id").collect()] == [0, 1] and checks.rl_faults(rl, "train", "Say.").count() == 0
    assert len(rl.first()["prompt"][0]["content"]) == 7 and protocol.shown_hidden_keys(rl.select("prompt").schema) == []
    assert "extra_info.lineage" in protocol.shown_hidden_keys(rl.schema)
    for stage in exports.STAGES:
        assert exports.prepared(rows.where("product_id in ('p1', 'p2')"), contents, stage, "train", "Say.").count() == 2
    assert exports.prepared(rows.where("product_id in ('p1', 'p2')"), contents, "sft", "train", "Say.", limit=1).count() == 1
    for bad in (lambda: exports.prepared(rows, contents, "sft", "train", "Say."), lambda: exports.prepared(rows.limit(0), contents, "sft", "train", "Say."), lambda: exports.prepared(rows, contents, "else", "train", "Say."), lambda: exports.limited(rows, 99, ["product_id"]), lambda: exports.limited(rows, 0, ["product_id"])):
        with pytest.raises(checks.Violation):
            bad()
    seen = exports.evaluation_rows(rows.withColumn("evidence", F.lit("detail:2")).withColumn("decision", F.lit("reject")))
    got = {r["sample_id"]: (r["decision"], r["evidence"], r["fault"]) for r in seen.collect()}
    assert got["test_p3"] == ("reject", "detail:2", None) and got["test_p1"] == ("reject", None, None)


def test_contracts(spark):
    rows = spark.createDataFrame([("a", "sft", "train", ["p"], ["i"], "d1"), ("b", "grpo", "validation", ["p"], [None], "d2"), ("c", "test", "test", None, ["i"], "d1")], "sample_id string, dataset_stage string, split string, source_product_ids array<string>, source_image_ids array<string>, derived_image_id string")
    assert {tuple(r) for r in checks.lineage_faults(rows, line="").collect()} == {("a", "repeated_derived_image_id"), ("b", "source_image_ids"), ("c", "source_product_ids")}
    shared = checks.disjoint(rows.where("split = 'train'"), rows.where("split = 'validation'"), ("sample_id", "source_product_ids"))
    assert [tuple(r) for r in shared.collect()] == [("source_product_ids", "p")]
    assert [tuple(r) for r in checks.isolated(rows, "source_image_ids", "dataset_stage", ("sft", "grpo", "test")).collect()] == [("sft", "test", "i")]
    assert {tuple(r) for r in checks.split_output_faults(rows, "sample_id", "derived_image_id", "split", "source_image_ids").collect()} == {("component", "d1"), ("content", "i")}
    assert {r["name"]: r["right"] for r in checks.totals(rows.agg(F.count("*").alias("n")), {"n": 3}).collect()} == {"n": True}
    checks.named_for("/x/sft_train.jsonl", "train")
    with pytest.raises(checks.Violation):
        checks.named_for("/x/sft_train.jsonl", "test")


def test_perception_and_parse_rates(spark):
    rows = spark.createDataFrame(
        [("q", "image_quality", "blur", "main", "blur", "detail:1", True), ("w", "wrong_image", None, "main", None, "main", True), ("n", "image_quality", "blur", "main", None, None, False)],
        "sample_id string, violation_type string, issue_subtype string, evidence string, p_issue_subtype string, p_evidence string, p_there boolean",
    )
    r = evaluate.perception(rows).first()
    assert (r["quality_subtype_accuracy"], r["image_ref_accuracy"]) == (1.0, 0.5) and evaluate.perception(rows.limit(0)).first()[0] is None
    said = spark.createDataFrame([("q", True), ("w", False)], "sample_id string, ok boolean")
    assert evaluate.parse_rate(said, "ok").first()[0] == 0.5 and evaluate.parse_rate(said, "ok", rows).first()[0] == pytest.approx(1 / 3)
    with pytest.raises(checks.Violation):
        evaluate.parse_rate(said.unionByName(said), "ok", rows)
    with pytest.raises(checks.Violation):
        evaluate.matched(rows, said.limit(0))
    assert evaluate.matched(rows, said) == 2


def test_training_updates(spark):
    groups = spark.createDataFrame([(b, f"{b}{i}", i < n) for b, n in ((1, 1), (2, 3), (3, 0), (4, 1), (5, 2)) for i in range(4)], "b int, k string, kept boolean").withColumn("update", F.lit(9))
    got = {}
    for r in evaluate.accumulated_groups(groups.drop("update"), "b", "k", 3, 2).collect():
        got.setdefault(r["update"], []).append(r["k"])
    assert {u: sorted(k) for u, k in got.items()} == {0: ["10", "20", "21"], 1: ["40", "41", "42"]}
    assert evaluate.accumulated_groups(groups.limit(0), "b", "k", 3, 2).count() == 0


def test_value_scores_and_adapter(spark):
    lit = lambda x: F.lit(x).cast("string")
    score = lambda *a: one(spark, reward.value_score(*map(lit, a)))
    assert score("a", "b", "a", "b", "pass", "t", "u") == 1.0 and score("a", "b", "a", None, "pass", "t", "t") == 0.5
    assert score("a", None, None, None, "reject", "t", "t") == 0.3 and score("a", None, None, None, "pass", "t", "t") == 0.0
    rows = spark.createDataFrame([("x", "other")], "k string, source string").withColumn("s", F.struct(*[F.lit(1.0).alias(c) for c in (*reward.WEIGHTS, "reward")], F.lit(True).alias("gated"))).withColumn("v", F.lit(True))
    with pytest.raises(checks.Violation):
        reward.adapted(rows, "s", "source", "v")
    assert reward.adapted(rows, "s", "source", "v", "other").first()["evidence_gate_applied"] == 1.0


def test_spans_and_masks(spark):
    text = '{"decision": "reject", "violation_type": "wrong_image", "issue_subtype": null, "evidence": "main"}'
    got = {k: one(spark, spans.value_span(F.lit(text), k)) for k in protocol.KEYS}
    assert {k: text[s["begin"] : s["end"]] for k, s in got.items()} == {"decision": "reject", "violation_type": "wrong_image", "issue_subtype": "null", "evidence": "main"}
    assert one(spark, spans.value_span(F.lit("no"), "decision")) is None
    assert {k: text[b:e] for (b, e, _), k in zip(spans.spans_of(text, dict.fromkeys(protocol.KEYS, 1.0)), protocol.KEYS, strict=True)}["evidence"] == "main"
    pieces = [text[i : i + 5] for i in range(0, len(text), 5)]
    mask = spans.token_weights(pieces)
    at = lambda i: (i * 5 < got["decision"]["end"] and i * 5 + 5 > got["decision"]["begin"])
    assert all(mask[i] == 1 for i in range(len(pieces)) if at(i)) and mask[0] == 0
    assert spans.token_weights(list("nothing"), spans.FIELD_WEIGHTS) == [0.0] * 7 and max(spans.token_weights(pieces, spans.FIELD_WEIGHTS)) == 1.5
    rows = spark.createDataFrame([(1, pieces), (2, None), (3, [])], "k int, p array<string>")
    assert {r["k"]: r["weights"] if r["k"] > 1 else sum(r["weights"]) for r in spans.masked_pieces(rows, "k", "p").collect()} == {1: sum(mask), 2: None, 3: []}


def test_references(spark):
    assert references_in('[" a ", {"path": "b;c"}, 3, {"x": ["d"], "y": null}]') == ["a", "b", "c", "3", "d"]
    assert references_in("{broken") == ["{broken"] and references_in(None) == [] and references_in("  ") == []
    assert one(spark, flat_references(F.lit('["a|b"]'), deep=True)) == ["a", "b"] and one(spark, flat_references(F.lit("a; ;b"))) == ["a", "b"]


def test_manifests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/good.jsonl").write_text('{"Item_ID": 1, "Main_Image": "./A/One.JPG", "detail_images": ["x.png", "one"]}\n\n{"Item_ID": 2, "Main_Image": "a;b", "detail_images": []}\n')
    (tmp_path / "in/other.csv").write_text("id,price\n1,2\n")
    found = manifests.discover_manifest(spark, str(tmp_path / "in"))
    assert found.endswith("good.jsonl")
    (tmp_path / "in/twin.json").write_text('{"items": [{"id": 1, "cover_image": "q"}]}')
    with pytest.raises(ValueError):
        (tmp_path / "in/good2.json").write_text((tmp_path / "in/good.jsonl").read_text().split("\n")[0])
        manifests.discover_manifest(spark, str(tmp_path / "in"))
    (tmp_path / "in/good2.json").unlink()
    rows = {r["source_id"]: r for r in manifests.manifest_products(files.read_records(spark, found)).collect()}
    assert (rows["1"]["main"], rows["1"]["details"], rows["1"]["fault"]) == ("./A/One.JPG", ["x.png", "one"], None) and rows["2"]["fault"] == "main"
    paths = spark.createDataFrame([("a/one.jpg",), ("b/x.png",), ("c/x.png",), ("d/note.txt",), ("e/main_1.jpg",), ("e/2.jpg",), ("f/1.jpg",), ("f/2.jpg",)], "path string")
    index = manifests.picture_index(paths)
    refs = spark.createDataFrame([("./A/One.JPG",), ("x.png",), ("one",), ("b\\x.png",), ("nothing",)], "ref string")
    assert {r["ref"]: r["resolved"] for r in manifests.resolved(refs, "ref", index, paths).collect()} == {"./A/One.JPG": "a/one.jpg", "x.png": None, "one": "a/one.jpg", "b\\x.png": "b/x.png", "nothing": None}
    folders = {r["source_id"]: (r["main"], r["details"], r["fault"]) for r in manifests.folder_products(paths).collect()}
    assert folders["a"] == ("a/one.jpg", [], None) and folders["e"] == ("e/main_1.jpg", ["e/2.jpg"], None) and folders["f"] == (None, None, "main") and "d" not in folders
    with pytest.raises(ValueError):
        files.read_records(spark, str(tmp_path / "x.txt"))
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert manifests.load_config(str(tmp_path / "c.json")) == {"a": 1}
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(ValueError):
        manifests.load_config(str(tmp_path / "c.json"))


def test_archives(spark, tmp_path):
    import gzip

    with tarfile.open(tmp_path / "a.tar", "w") as archive:
        for name, data in (("l/one.json.gz", gzip.compress(b'{"id": "a"}\n\n{"id": "b"}\n')), ("l/two.json", b'{"id": "c"}'), ("readme.txt", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    assert manifests.read_archive(spark, str(tmp_path / "a.tar")).count() == 3
    wanted = spark.createDataFrame([("b",), ("c",)], "id string")
    assert {json.loads(r["line"])["id"] for r in manifests.read_archive(spark, str(tmp_path / "a.tar"), wanted=wanted, key="id").collect()} == {"b", "c"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    with pytest.raises(FileExistsError):
        files.publish(spark, str(tmp_path), rows.write.parquet)

    def broken(folder):
        rows.write.parquet(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        files.publish(spark, str(tmp_path / "out"), broken)
    assert not (tmp_path / "out").exists() and not list(tmp_path.glob("out.*"))
    with pytest.raises(ValueError):
        files.publish(spark, str(tmp_path / "new"), rows.write.parquet, source=str(tmp_path / "new/in"))
    files.publish(spark, str(tmp_path / "out"), rows.write.parquet)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(checks.Violation):
        files.read_wanted(rows, "k", spark.createDataFrame([("z",)], "k string"))
    files.write_report(rows.agg(F.count("*").alias("n")), str(tmp_path / "report"))
    assert files.read_lines(spark, str(tmp_path / "report")).first()["n"] == 2
    (tmp_path / "splits/s=train").mkdir(parents=True)
    (tmp_path / "splits/s=train/x.json").write_text('{"s": "test"}')
    with pytest.raises(checks.Violation):
        files.read_splits(spark, str(tmp_path / "splits"), "s", ["train"])
    assert rows.select(files.canonical_hash("n", "k").alias("h")).where("k = 'a'").first()["h"] == files.stable_json_hash({"k": "a", "n": 1})


def test_numbers_and_ranks(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    assert {r["k"]: r["i"] for r in numbered(rows, ["k"], "i").collect()} == {k: k for k in range(1000)}
    got = [(r["g"], r["r"]) for r in ranked(rows, ["g"], "k", "r").collect()]
    assert sorted(got) == [(g, i) for g in range(3) for i in range(334 if g == 0 else 333)]


def test_hot_lookup(spark):
    rows = spark.range(150_000).select(F.when(F.col("id") < 60_000, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.lit("r").alias("v"))
    found = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("f", F.col("k") + 1)
    out = lookup(rows, found, "k", "n")
    assert out.count() == 150_000 and out.where("f <> k + 1").count() == 0
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def test_caps_and_turns(spark):
    rows = spark.createDataFrame([(f"k{i}", "ab"[i % 2]) for i in range(10)], "k string, g string")
    with pytest.raises(ValueError):
        split.capped_round_robin(rows, "g", "k", 2, 5)
    places = rows.select("k", synthesize.turn([F.col("k")], ("x", "y"), [], apart=2).alias("t")).orderBy("k").collect()
    assert [r["t"] for r in places][:4] == ["x", "x", "y", "y"]


def png(width, height):
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1) * height)) + chunk(b"IEND", b"")


def test_picture_files(spark, tmp_path):
    whole = png(20, 10)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x07\x00\x09\x01\x01\x11\x00\xff\xda\x00\x02xx\xff\xd9"
    assert pictures.picture_facts(whole) == ("png", 20, 10, True) and pictures.picture_facts(whole[:-6])[3] is False
    assert pictures.picture_facts(jpeg) == ("jpeg", 9, 7, True) and pictures.picture_facts(jpeg[:-2])[3] is False
    assert pictures.picture_facts(None) == pictures.picture_facts(b"text") == (None, None, None, False)
    for name, data in (("a.png", whole), ("b.png", whole[:40]), ("c.png", png(3, 3))):
        (tmp_path / name).write_bytes(data)
    facts = pictures.read_facts(spark, str(tmp_path)).withColumn("path", F.substring_index("path", "/", -1))
    named = spark.createDataFrame([("s1", "a.png"), ("s2", "a.png"), ("s3", "b.png"), ("s4", "gone.png"), ("s5", "c.png"), ("s6", None)], "sample_id string, path string")
    known = spark.createDataFrame([("a.png", 20, 10), ("c.png", 4, 3)], "path string, width int, height int")
    assert {tuple(r) for r in pictures.picture_faults(named, facts, "sample_id", "path", known).collect()} == {("s3", "b.png", "broken"), ("s4", "gone.png", "missing"), ("s5", "c.png", "size")}


def test_limits_and_losses(spark):
    rows = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "xxxxx")], "k string, t string")
    assert [r["k"] for r in exports.short_enough(rows, F.length("t"), 3).collect()] == ["a"]
    with pytest.raises(checks.Violation):
        exports.short_enough(rows, F.length("t"), 3, drop=False)
    with pytest.raises(ValueError):
        split.first_by(rows, ["k"], 4, exact=True)
    tokens = spark.createDataFrame([("a", 1, 1, -2.0), ("a", 2, 0, -4.0), ("b", 1, 0, -1.0)], "k string, n int, m int, lp double")
    losses = reward.shifted_losses(tokens, "k", ["n"], "m", "lp")
    assert {tuple(r) for r in losses.collect()} == {("a", 3.0, 4.0), ("b", 1.0, None)}
    with pytest.raises(checks.Violation):
        reward.whole_losses(losses, "k")
