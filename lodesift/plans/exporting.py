"""Queries of exports over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodesift.functions import protocol
from lodesift.functions.hashing import fraction
from lodesift.functions.text import plain
from lodesift.operators import exports
from lodesift.plans.registry import HASH, PLAIN, query
from lodesift.session import table

ASK = "Judge the record."
FIELDS = ("title", "category", "color", "material")


def labelled(spark, d):
    """The labelled rows of all_product, once each, with plain labels."""
    rows = table(spark, d, "all_product")
    kept = ("product_id", "source_product_id", *FIELDS, "images", "dataset", "difficulty", "changed_field")
    return rows.select(*kept, *[plain(c).alias(c) for c in ("violation_type", "issue_subtype", "target_image_ref")]).distinct()


def picture_contents(spark, d):
    return table(spark, d, "asset").where("sha256 is not null").groupBy("image_id").agg(F.min("sha256").alias("sha256"))


def samples(spark, d):
    return exports.normalized(labelled(spark, d), picture_contents(spark, d), "sft", "train")


IN = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
RULES = f"""WHEN kind IS NULL THEN 'decision' WHEN kind NOT IN {IN(protocol.TYPES)} THEN 'violation_type'
WHEN kind = 'image_quality' AND coalesce(sub NOT IN {IN(protocol.SUBTYPES)}, true) THEN 'issue_subtype'"""
#: The samples: n(sample_id, ...), with their answers as JSON.
SAMPLES = f"""l AS (SELECT DISTINCT product_id, source_product_id, title, category, color, material, images.main.image_id AS m, images.detail[1].image_id AS d1, images.detail[2].image_id AS d2, len(images.detail) AS nd, dataset, difficulty, changed_field,
{PLAIN.format('violation_type')} AS kind, {PLAIN.format('issue_subtype')} AS sub, {PLAIN.format('target_image_ref')} AS place FROM all_product),
k AS (SELECT image_id, min(sha256) AS sha FROM asset WHERE sha256 IS NOT NULL GROUP BY image_id),
n0 AS (SELECT l.*, coalesce(nullif(dataset, ''), 'sft_train') || '_' || product_id AS sample_id, a.sha AS s1, b.sha AS s2, c.sha AS s3 FROM l LEFT JOIN k a ON a.image_id = m LEFT JOIN k b ON b.image_id = d1 LEFT JOIN k c ON c.image_id = d2),
n AS (SELECT *, CASE WHEN kind = 'pass' THEN 'pass' WHEN kind IS NOT NULL THEN 'reject' END AS decision, CASE WHEN kind IN {IN(protocol.WITH_EVIDENCE)} THEN place END AS evidence, CASE WHEN kind = 'image_quality' THEN sub END AS subtype,
CASE WHEN nd <> 2 OR s1 IS NULL OR s2 IS NULL OR s3 IS NULL THEN 'images' WHEN kind IN {IN(protocol.WITH_EVIDENCE)} AND coalesce(place NOT IN {IN(protocol.PLACES)}, true) THEN 'target_image_ref' {RULES} END AS fault FROM n0),
j AS (SELECT *, '{{"decision":"' || decision || '","violation_type":"' || kind || '","issue_subtype":' || coalesce('"' || subtype || '"', 'null') || ',"evidence":' || coalesce('"' || evidence || '"', 'null') || '}}' AS answer,
'title: ' || coalesce(title, 'N/A') || chr(10) || 'category: ' || coalesce(category, 'N/A') || chr(10) || 'color: ' || coalesce(color, 'N/A') || chr(10) || 'material: ' || coalesce(material, 'N/A') || chr(10) || chr(10) || '{ASK}' AS said FROM n WHERE fault IS NULL)"""
PICTURES_FIRST = "'main: <image>' || chr(10) || 'detail:1: <image>' || chr(10) || 'detail:2: <image>' || chr(10)"


@query(f"""WITH {SAMPLES} SELECT sample_id, m || ',' || d1 || ',' || d2 AS images, decision, kind AS violation_type, subtype AS issue_subtype, evidence, coalesce(nullif(source_product_id, ''), product_id) AS source,
CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL AND s3 IS NOT NULL THEN 'sha256:' || s1 || ',sha256:' || s2 || ',sha256:' || s3 END AS contents, 'sample:' || sample_id AS derived, changed_field, fault FROM n""")
def normalized_samples(spark, d):
    rows = samples(spark, d)
    contents = F.when(F.size("source_image_ids") == 3, F.array_join("source_image_ids", ","))
    return rows.select(
        "sample_id", F.array_join("images", ",").alias("images"), "decision", "violation_type", "issue_subtype", "evidence", F.get("lineage.source_product_ids", F.lit(0)).alias("source"),
        contents.alias("contents"), F.col("lineage.derived_image_id").alias("derived"), F.col("lineage.audit.changed_field").alias("changed_field"), "fault",
    )


def supervised(spark, d):
    return exports.sft_rows(samples(spark, d).where("fault is null"), ASK)


@query(f"WITH {SAMPLES} SELECT sample_id, {PICTURES_FIRST} || said AS human, answer AS gpt FROM j")
def sft_rows(spark, d):
    turn = lambda n: F.get("conversations", F.lit(n))["value"]
    return supervised(spark, d).select("sample_id", turn(0).alias("human"), turn(1).alias("gpt"))


@query(f"""WITH {SAMPLES} SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS place, 'main: [' || m || ']' || chr(10) || 'detail:1: [' || d1 || ']' || chr(10) || 'detail:2: [' || d2 || ']' || chr(10) || said AS prompt, answer, 'product_audit' AS ability FROM j""")
def rl_rows(spark, d):
    rows = exports.rl_rows(samples(spark, d).where("fault is null"), ASK)
    parts = F.transform(F.get("prompt", F.lit(0))["content"], lambda p: F.coalesce(p["text"], F.concat(F.lit("["), p["image"], F.lit("]"))))
    return rows.select("extra_info.sample_id", F.col("extra_info.index").alias("place"), F.array_join(parts, "").alias("prompt"), F.col("reward_model.ground_truth").alias("answer"), "ability")


def altered(spark, d):
    """Supervised rows of which some are broken, by the hash of their id."""
    u = fraction(F.concat(F.lit("break:"), "sample_id"))
    rows = supervised(spark, d)
    user, reply = F.get("conversations", F.lit(0)), F.get("conversations", F.lit(1))
    turn = lambda who, value: F.struct(who.alias("from"), value.alias("value"))
    said = F.when(u < 0.05, F.lit("not json")).when(u < 0.1, F.concat(reply["value"], F.lit(" and more"))).otherwise(reply["value"])
    asked = F.when((u >= 0.1) & (u < 0.15), F.replace(user["value"], F.lit("<image>"), F.lit("image"))).when((u >= 0.15) & (u < 0.2), F.concat(user["value"], F.lit("!"))).otherwise(user["value"])
    turns = F.when((u >= 0.2) & (u < 0.25), F.array(turn(user["from"], asked))).otherwise(F.array(turn(F.when((u >= 0.25) & (u < 0.3), F.lit("system")).otherwise(user["from"]), asked), turn(reply["from"], said)))
    lineage = F.when((u >= 0.3) & (u < 0.35), F.col("lineage").withField("source_product_ids", F.array().cast("array<string>"))).otherwise(F.col("lineage"))
    stage = F.when((u >= 0.35) & (u < 0.4), F.lit("grpo")).otherwise(F.col("dataset_stage"))
    split = F.when((u >= 0.4) & (u < 0.45), F.lit("test")).otherwise(F.col("split"))
    images = F.when((u >= 0.45) & (u < 0.5), F.slice("images", 1, 2)).otherwise(F.col("images"))
    return rows.withColumns({"conversations": turns, "lineage": lineage, "dataset_stage": stage, "split": split, "images": images})


BREAK = f"b AS (SELECT *, {HASH.format(chr(39) + 'break:' + chr(39) + ' || sample_id')} AS u FROM j)"


@query(f"""WITH {SAMPLES}, {BREAK} SELECT CASE WHEN u < 0.1 THEN 'answer' WHEN u < 0.2 THEN 'prompt' WHEN u < 0.25 THEN 'turns' WHEN u < 0.3 THEN 'prompt' WHEN u >= 0.45 AND u < 0.5 THEN 'images' END AS fault,
count(*) AS n, sum(CASE WHEN u >= 0.5 OR u BETWEEN 0.3 AND 0.45 THEN length(answer) END)::BIGINT AS answered FROM b GROUP BY 1""")
def messages(spark, d):
    rows = exports.messages(altered(spark, d), ASK)
    return rows.groupBy("fault").agg(F.count("*").alias("n"), F.sum(F.length(F.get("messages", F.lit(1))["content"])).alias("answered"))


@query(f"""WITH {SAMPLES}, e AS (SELECT *, CASE WHEN kind IN {IN(protocol.WITH_EVIDENCE)} AND place IN {IN(protocol.PLACES)} THEN place END AS w FROM n0)
SELECT coalesce(dataset, 'test') || '_' || product_id AS sample_id, CASE WHEN kind = 'pass' THEN 'pass' WHEN kind IS NOT NULL THEN 'reject' END AS decision, w AS evidence,
CASE WHEN kind IN {IN(protocol.WITH_EVIDENCE)} THEN w ELSE place END AS target_image_ref, CASE WHEN kind IN {IN(protocol.WITH_EVIDENCE)} AND w IS NULL THEN 'target_image_ref' {RULES} END AS fault FROM e""")
def evaluation_samples(spark, d):
    return exports.evaluation_rows(labelled(spark, d)).select("sample_id", "decision", "evidence", "target_image_ref", "fault")


HIDDEN_SQL = ", ".join(f"CASE WHEN regexp_matches(text, '(?m)^\\s*{k}\\s*:') THEN '{k}' END" for k in protocol.HIDDEN_KEYS)


@query(f"""WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN chr(10) || ' split : x' WHEN 1 THEN chr(10) || 'lineage:' ELSE ' split: no' END AS text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_filter([{HIDDEN_SQL}], lambda x: x IS NOT NULL), ',') AS keys FROM t""")
def hidden_keys(spark, d):
    more = F.when(F.col("doc_id") % 3 == 0, F.lit("\n split : x")).when(F.col("doc_id") % 3 == 1, F.lit("\nlineage:")).otherwise(F.lit(" split: no"))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat("text", more).alias("text"))
    return rows.select("doc_id", F.array_join(protocol.hidden_keys_in("text"), ",").alias("keys"))


@query(f"""WITH {SAMPLES}, {BREAK} SELECT sample_id, CASE WHEN u >= 0.1 AND u < 0.15 THEN 'images' WHEN u >= 0.15 AND u < 0.2 THEN 'instruction' ELSE '' END AS faults FROM b""")
def prompt_faults(spark, d):
    text = F.get("conversations", F.lit(0))["value"]
    return altered(spark, d).select("sample_id", F.array_join(protocol.prompt_faults(text, ASK, 3), ",").alias("faults"))


@query("""SELECT sample_id, export_batch, coalesce(len(list_filter(source_product_ids, lambda x: x IS NOT NULL)) > 0 AND len(list_filter(source_image_ids, lambda x: x IS NOT NULL)) > 0 AND derived_image_id <> '', false) AS whole FROM export_ids""")
def lineages(spark, d):
    return table(spark, d, "export_ids").select("sample_id", "export_batch", exports.lineage().isNotNull().alias("whole"))


@query("""WITH p AS (SELECT DISTINCT product_id, title FROM all_product) SELECT product_id FROM p WHERE length(title) <= 100""")
def short_prompts(spark, d):
    return exports.short_enough(table(spark, d, "all_product").select("product_id", "title").distinct(), F.length("title"), 100).select("product_id")


@query("""SELECT DISTINCT product_id, title, 'set/' || images.main.image_id AS main, 'set/' || images.detail[1].image_id AS first_detail, 'set/' || images.detail[2].image_id AS second_detail FROM all_product""")
def base_rows(spark, d):
    role = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("high_resolution_path"))
    detail = lambda n: F.get("images.detail", F.lit(n))["image_id"]
    pictures = F.array(role("detail:1", detail(0)), role("main", F.col("images.main.image_id")), role("detail:2", detail(1)))
    rows = table(spark, d, "all_product").withColumn("pictures", pictures).withColumn("paths", exports.asset_paths("pictures", "set/"))
    made = rows.select(*exports.base_row())
    return made.select("product_id", "title", F.col("images.main.image_id").alias("main"), F.get("images.detail", F.lit(0))["image_id"].alias("first_detail"), F.get("images.detail", F.lit(1))["image_id"].alias("second_detail")).distinct()
