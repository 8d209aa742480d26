"""Queries of contracts over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodesift.functions.text import plain
from lodesift.operators import checks, exports
from lodesift.plans.exporting import ASK, BREAK, SAMPLES, altered, samples
from lodesift.plans.registry import PLAIN, query
from lodesift.session import table

SPACES = ("sample_id", "source_product_ids", "source_image_ids", "derived_image_id")
IDS = """i AS (SELECT lower(trim(split)) AS split, 'sample_id' AS space, sample_id AS id FROM export_ids UNION ALL SELECT lower(trim(split)), 'source_product_ids', unnest(source_product_ids) FROM export_ids
UNION ALL SELECT lower(trim(split)), 'source_image_ids', unnest(source_image_ids) FROM export_ids UNION ALL SELECT lower(trim(split)), 'derived_image_id', derived_image_id FROM export_ids)"""


@query(f"WITH {IDS} SELECT space, id FROM i WHERE split = 'train' AND id IS NOT NULL INTERSECT SELECT space, id FROM i WHERE split IN ('validation', 'valid', 'val') AND id IS NOT NULL")
def disjoint_exports(spark, d):
    rows = table(spark, d, "export_ids").withColumn("split", plain("split"))
    return checks.disjoint(rows.where("split = 'train'"), rows.where("split in ('validation', 'valid', 'val')"), SPACES)


@query("""WITH i AS (SELECT DISTINCT dataset_stage AS s, unnest(source_image_ids) AS id FROM export_ids), j AS (SELECT * FROM i WHERE id IS NOT NULL), o(l, r) AS (VALUES ('sft', 'grpo'), ('sft', 'test'), ('grpo', 'test'))
SELECT l AS "left", r AS "right", a.id AS source_image_ids FROM o JOIN j a ON a.s = l JOIN j b ON b.s = r AND b.id = a.id""")
def stage_overlaps(spark, d):
    return checks.isolated(table(spark, d, "export_ids"), "source_image_ids", "dataset_stage", exports.STAGES)


@query("""SELECT p AS source_product_ids, count(DISTINCT dataset_stage) AS homes FROM (SELECT dataset_stage, unnest(source_product_ids) AS p FROM export_ids) WHERE p IS NOT NULL AND dataset_stage IS NOT NULL GROUP BY p HAVING count(DISTINCT dataset_stage) > 1""")
def product_homes(spark, d):
    return checks.in_several(table(spark, d, "export_ids"), "source_product_ids", "dataset_stage")


@query(f"""WITH h AS (SELECT DISTINCT i, dataset_stage, split FROM (SELECT dataset_stage, {PLAIN.format('split')} AS split, unnest(source_image_ids) AS i FROM export_ids) WHERE i IS NOT NULL AND dataset_stage IS NOT NULL AND split IS NOT NULL)
SELECT i AS source_image_ids, count(*) AS homes FROM h GROUP BY i HAVING count(*) > 1""")
def picture_homes(spark, d):
    return checks.in_several(table(spark, d, "export_ids").withColumn("split", plain("split")), "source_image_ids", ["dataset_stage", "split"])


@query("""WITH o AS (SELECT derived_image_id AS g FROM export_ids WHERE derived_image_id <> '' GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT sample_id, CASE WHEN NOT coalesce(len(list_filter(source_product_ids, lambda x: x IS NOT NULL)) > 0, false) THEN 'source_product_ids' WHEN NOT coalesce(len(list_filter(source_image_ids, lambda x: x IS NOT NULL)) > 0, false) THEN 'source_image_ids'
WHEN NOT coalesce(derived_image_id <> '', false) THEN 'derived_image_id' WHEN g IS NOT NULL THEN 'repeated_derived_image_id' END AS fault FROM export_ids LEFT JOIN o ON g = derived_image_id) SELECT sample_id, fault FROM f WHERE fault IS NOT NULL""")
def lineage_faults(spark, d):
    return checks.lineage_faults(table(spark, d, "export_ids"), line="")


@query("SELECT sample_id, split FROM export_ids WHERE split IS NULL OR split NOT IN ('train', 'validation', 'test')")
def outside_splits(spark, d):
    return checks.outside(table(spark, d, "export_ids"), "sample_id", "split", ["train", "validation", "test"])


@query(f"""WITH {SAMPLES}, {BREAK}, f AS (SELECT sample_id, CASE WHEN u < 0.1 THEN 'answer' WHEN u < 0.2 THEN 'prompt' WHEN u < 0.25 THEN 'conversations' WHEN u < 0.3 THEN 'prompt' WHEN u < 0.35 THEN 'source_product_ids' WHEN u < 0.4 THEN 'dataset_stage'
WHEN u < 0.45 THEN 'split' WHEN u < 0.5 THEN 'images' END AS fault FROM b) SELECT * FROM f WHERE fault IS NOT NULL""")
def sft_contract(spark, d):
    return checks.sft_faults(altered(spark, d), "train", ASK)


@query(f"""WITH {SAMPLES}, {BREAK}, f AS (SELECT sample_id, CASE WHEN u < 0.1 THEN 'data_source' WHEN u < 0.2 THEN 'prompt_images' WHEN u < 0.3 THEN 'answer' WHEN u < 0.4 THEN 'source_image_ids' END AS fault FROM b) SELECT * FROM f WHERE fault IS NOT NULL""")
def rl_contract(spark, d):
    from lodesift.functions.hashing import fraction

    rows = exports.rl_rows(samples(spark, d).where("fault is null"), ASK)
    u = fraction(F.concat(F.lit("break:"), F.col("extra_info.sample_id")))
    within = lambda a, b: (u >= a) & (u < b)
    line = F.col("extra_info.lineage").withField("source_image_ids", F.array().cast("array<string>"))
    rows = rows.withColumns({
        "data_source": F.when(within(0, 0.1), F.lit("other")).otherwise(F.col("data_source")), "images": F.when(within(0.1, 0.2), F.reverse("images")).otherwise(F.col("images")),
        "reward_model": F.when(within(0.2, 0.3), F.col("reward_model").withField("ground_truth", F.lit("{}"))).otherwise(F.col("reward_model")),
        "extra_info": F.when(within(0.3, 0.4), F.col("extra_info").withField("lineage", line)).otherwise(F.col("extra_info")),
    })
    return checks.rl_faults(rows, "train", ASK)


@query(f"""WITH e AS (SELECT sample_id, source_product_ids[1] AS component, {PLAIN.format('split')} AS target, source_image_ids AS c FROM export_ids)
SELECT 'product' AS fault, sample_id AS id FROM e GROUP BY sample_id HAVING count(*) > 1 OR sample_id IS NULL
UNION ALL SELECT 'component', component FROM e WHERE component IS NOT NULL AND target IS NOT NULL GROUP BY component HAVING count(DISTINCT target) > 1
UNION ALL SELECT 'content', c FROM (SELECT target, unnest(c) AS c FROM e) WHERE c IS NOT NULL AND target IS NOT NULL GROUP BY c HAVING count(DISTINCT target) > 1""")
def split_output_faults(spark, d):
    rows = table(spark, d, "export_ids").select("sample_id", F.get("source_product_ids", F.lit(0)).alias("component"), plain("split").alias("target"), F.col("source_image_ids").alias("contents"))
    return checks.split_output_faults(rows, "sample_id", "component", "target", "contents")


@query("""WITH f AS (SELECT count(DISTINCT product_id) AS products, count(*) AS samples, count(DISTINCT dataset) AS datasets FROM all_product) SELECT 'products' AS name, 3000::BIGINT AS expected, products AS found, products = 3000 AS right FROM f
UNION ALL SELECT 'samples', 3000, samples, samples = 3000 FROM f UNION ALL SELECT 'datasets', 5, datasets, datasets = 5 FROM f""")
def expected_totals(spark, d):
    found = table(spark, d, "all_product").agg(F.count_distinct("product_id").alias("products"), F.count("*").alias("samples"), F.count_distinct("dataset").alias("datasets"))
    return checks.totals(found, {"products": 3000, "samples": 3000, "datasets": 5})


@query(f"""WITH r AS (SELECT dataset, {PLAIN.format('violation_type')} AS kind, product_id, [images.main.image_id] || list_transform(images.detail, lambda x: x.image_id) AS ids FROM all_product),
i AS (SELECT dataset, kind, count(DISTINCT id) AS images FROM (SELECT dataset, kind, unnest(ids) AS id FROM r) GROUP BY ALL) SELECT r.dataset, r.kind, count(*) AS n_rows, count(DISTINCT product_id) AS samples, any_value(images) AS images
FROM r LEFT JOIN i ON i.dataset IS NOT DISTINCT FROM r.dataset AND i.kind IS NOT DISTINCT FROM r.kind GROUP BY r.dataset, r.kind""")
def input_audit(spark, d):
    ids = F.concat(F.array("images.main.image_id"), F.transform("images.detail", lambda x: x["image_id"]))
    rows = table(spark, d, "all_product").select("dataset", plain("violation_type").alias("kind"), "product_id", ids.alias("ids"))
    return checks.audit(rows, ["dataset", "kind"], "product_id", "ids").withColumnsRenamed({"rows": "n_rows", "ids": "samples", "values": "images"})
