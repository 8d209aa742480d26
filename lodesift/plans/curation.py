"""Queries of the curation of listings over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodesift.functions import listing
from lodesift.functions.text import plain
from lodesift.operators import checks, curate, graph
from lodesift.plans.registry import PLAIN, SPACE, query
from lodesift.session import table

FIT = "length(t) BETWEEN 1 AND 95"
ONCE = "SELECT DISTINCT product_id, title, category, color, material, [images.main.image_id] || list_transform(images.detail, lambda x: x.image_id) AS ids FROM all_product"


def once(spark, d):
    """The columns of a listing, once each."""
    ids = F.concat(F.array("images.main.image_id"), F.transform("images.detail", lambda x: x["image_id"]))
    return table(spark, d, "all_product").select("product_id", "title", "category", "color", "material", ids.alias("ids")).distinct()


@query(f"""WITH v AS (SELECT DISTINCT source_product_id, split_part(product_id, ':', 2) AS tag, title, {SPACE.format('title')} AS t FROM all_product WHERE title IS NOT NULL)
SELECT source_product_id, CASE WHEN count(DISTINCT t) FILTER ({FIT} AND tag = 'mk00') = 1 THEN min(t) FILTER ({FIT} AND tag = 'mk00') END AS only_one,
(list(t ORDER BY tag, title) FILTER ({FIT} AND tag = 'mk00'))[1] AS first_one,
coalesce(CASE WHEN count(DISTINCT t) FILTER ({FIT} AND tag = 'mk00') = 1 THEN min(t) FILTER ({FIT} AND tag = 'mk00') END, (list(t ORDER BY tag, title) FILTER ({FIT} AND tag = 'mk00'))[1], (list(t ORDER BY tag, title) FILTER ({FIT}))[1]) AS title,
coalesce(CASE WHEN count(DISTINCT t) FILTER ({FIT} AND tag = 'mk00') = 1 THEN min(t) FILTER ({FIT} AND tag = 'mk00') END, CASE WHEN count(DISTINCT t) FILTER ({FIT}) = 1 THEN min(t) FILTER ({FIT}) END) AS sure
FROM v GROUP BY source_product_id""")
def listing_texts(spark, d):
    rows = table(spark, d, "all_product").where("title is not null")
    value = F.struct(F.get(F.split("product_id", ":"), F.lit(1)).alias("language_tag"), F.col("title").alias("value"))
    each = rows.groupBy("source_product_id").agg(F.array_sort(F.collect_set(value)).alias("v"))
    return each.select(
        "source_product_id", listing.unique_text("v", "mk00", 95).alias("only_one"), listing.first_text("v", "mk00", 95).alias("first_one"),
        listing.title_of("v", "mk00", 95).alias("title"), listing.brand_of("v", "mk00", 95).alias("sure"),
    )


@query(f"""WITH p AS ({ONCE}), f AS (SELECT product_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM p),
l AS (SELECT DISTINCT image_id FROM asset WHERE width >= 700 AND height >= 700), u AS (SELECT product_id, id, row_number() OVER (PARTITION BY product_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY product_id) AS n FROM f JOIN l ON image_id = id WHERE id <> ''),
g AS (SELECT product_id, string_agg(id, ',' ORDER BY k) AS image_ids FROM u WHERE n >= 2 AND k <= 2 GROUP BY product_id),
a AS (SELECT *, nullif(regexp_extract(title, 'M[0-9A-Z]{{7}}'), '') AS model, nullif(split_part(title, ' ', 1), '') AS brand FROM p WHERE title <> '' AND category <> '')
SELECT product_id, image_ids, CASE WHEN model IS NOT NULL THEN 'model' WHEN color IS NOT NULL THEN 'color' WHEN material IS NOT NULL THEN 'material' WHEN brand IS NOT NULL THEN 'brand' END AS judged,
(model IS NOT NULL)::INT + (color IS NOT NULL)::INT + (material IS NOT NULL)::INT + (brand IS NOT NULL)::INT AS attributes FROM a JOIN g USING (product_id)""")
def product_candidates(spark, d):
    rows = once(spark, d)
    usable = curate.usable_pictures(rows, table(spark, d, "asset"), "product_id", "ids", "image_id", 700, 700, keep=2)
    null = F.lit(None).cast("string")
    model, brand = F.nullif(F.regexp_extract("title", "(M[0-9A-Z]{7})", 1), F.lit("")), F.nullif(F.substring_index("title", " ", 1), F.lit(""))
    attributes = F.struct(model.alias("model"), "color", "material", null.alias("dimensions"), null.alias("weight"), brand.alias("brand"))
    chosen = curate.candidates(rows, usable, "product_id", ["title", "category"], least=2).withColumn("a", attributes)
    return chosen.select("product_id", F.array_join("image_ids", ",").alias("image_ids"), listing.judged_field("a").alias("judged"), listing.attribute_count("a").alias("attributes"))


@query("""WITH m AS (SELECT p_partkey, 'W ' || format('{:g}', p_size * 0.25) || ' in' AS w, CASE WHEN p_size % 3 <> 0 THEN 'L ' || format('{:g}', p_retailprice / 100) || ' cm' END AS l, CASE WHEN p_size % 2 = 1 THEN format('{:g}', p_size * 1.5) || ' g' END AS g FROM part)
SELECT p_partkey, w || coalesce(' x ' || l, '') AS dimensions, g AS weight FROM m""")
def measures(spark, d):
    value = lambda v, unit: F.struct(v.cast("double").alias("value"), unit.alias("unit"))
    nothing = value(F.lit(None), F.lit("in"))
    unit = F.when(F.col("p_size") % 3 != 0, F.lit("cm")).otherwise(F.lit(""))
    one = value(F.col("p_size") * 1.5, F.lit("g"))
    weights = F.when(F.col("p_size") % 2 == 1, F.array(one)).otherwise(F.array(one, one))
    rows = table(spark, d, "part")
    return rows.select("p_partkey", listing.dimensions(value(F.col("p_size") * 0.25, F.lit("in")), value(F.col("p_retailprice") / 100, unit), nothing).alias("dimensions"), listing.weight(weights).alias("weight"))


@query(f"""WITH p AS ({ONCE}), k AS (SELECT {PLAIN.format('category')} AS kind, {PLAIN.format("split_part(title, ' ', 1)")} AS brand, lower(regexp_extract(title, 'M[0-9A-Z]{{7}}')) AS model FROM p)
SELECT kind, brand, model, count(*) AS n FROM k WHERE length(model) >= 3 AND length(brand) >= 2 GROUP BY ALL""")
def family_keys(spark, d):
    key = listing.family_key(plain("category"), F.substring_index("title", " ", 1), F.regexp_extract("title", "(M[0-9A-Z]{7})", 1))
    rows = once(spark, d).select(key.alias("k")).where("k is not null")
    return rows.groupBy("k.kind", "k.brand", "k.model").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT image_id, max(bytes) AS bytes FROM asset GROUP BY image_id), p AS (SELECT DISTINCT product_id, images.main.image_id AS image_id FROM all_product)
SELECT product_id, image_id, bytes FROM p JOIN k USING (image_id)""")
def picture_correspondence(spark, d):
    known = table(spark, d, "asset").groupBy("image_id").agg(F.max("bytes").alias("bytes"))
    rows = table(spark, d, "all_product").select("product_id", F.col("images.main.image_id").alias("image_id")).distinct()
    return curate.correspond(rows, "image_id", known, "image_id").select("product_id", "image_id", "bytes")


@query("""WITH a AS (SELECT source_product_id, min(title) AS title, 'manifest' AS source FROM all_product WHERE sample_index = 1 GROUP BY source_product_id),
b AS (SELECT source_product_id, min(title) AS title, 'archive' AS source FROM all_product WHERE sample_index = 2 AND source_product_id NOT IN (SELECT source_product_id FROM a WHERE source_product_id IS NOT NULL) GROUP BY source_product_id),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), s AS (SELECT DISTINCT source_product_id FROM asset)
SELECT s.source_product_id, coalesce(title, 'N/A') AS title, source FROM s LEFT JOIN u ON s.source_product_id = u.source_product_id""")
def text_sources(spark, d):
    rows = table(spark, d, "all_product").where("source_product_id is not null")
    part = lambda n, name: rows.where(F.col("sample_index") == n).groupBy("source_product_id").agg(F.min("title").alias("title")).withColumn("source", F.lit(name))
    texts = curate.prioritized([part(1, "manifest"), part(2, "archive")], "source_product_id")
    return curate.enriched(table(spark, d, "asset").select("source_product_id").distinct(), texts, "source_product_id", {"title": F.lit("N/A")})


@query("SELECT source_product_id, min(object_path) AS object_path FROM asset WHERE source_product_id IS NOT NULL GROUP BY source_product_id")
def first_paths(spark, d):
    return curate.first_name(table(spark, d, "asset"), "source_product_id", "object_path")


@query("SELECT DISTINCT image_id, source_product_id FROM asset")
def source_of_picture(spark, d):
    return curate.dependency(table(spark, d, "asset"), "image_id", "source_product_id")


@query("""SELECT 'left' AS side, doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) UNION ALL SELECT 'right', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def unmatched_labels(spark, d):
    return curate.unmatched(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id")


@query("""SELECT sample_id, export_batch, array_to_string(list_filter(source_image_ids, lambda e, i: e IS NOT NULL AND list_position(source_image_ids, e) = i), '|') AS ids FROM export_ids""")
def distinct_references(spark, d):
    return table(spark, d, "export_ids").select("sample_id", "export_batch", F.array_join(curate.first_seen("source_image_ids"), "|").alias("ids"))


@query("""WITH g AS (SELECT DISTINCT source_product_id, image_id FROM asset) SELECT source_product_id AS "group", 'source:' || substr(sha256('[' || string_agg('"' || image_id || '"', ',' ORDER BY image_id) || ']'), 1, 20) AS name, count(*) AS members
FROM g WHERE source_product_id IS NOT NULL GROUP BY source_product_id""")
def component_names(spark, d):
    rows = table(spark, d, "asset").where("source_product_id is not null").select(F.col("source_product_id").alias("group"), F.col("image_id").alias("id")).distinct()
    return graph.group_names(rows, "source:").select("group", "name", F.col("members").cast("bigint").alias("members"))


@query("SELECT 'step_' || max(o_orderkey) AS name, max(o_orderkey) AS number FROM orders")
def latest_checkpoint(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("step_"), F.col("o_orderkey").cast("string")).alias("name"))
    return curate.latest(rows.unionByName(spark.createDataFrame([("step_last",)], "name string")), "name")


@query("""SELECT doc_id, NULL::VARCHAR AS kind, source FROM documents UNION ALL SELECT doc_id, kind, NULL FROM labels""")
def joined_parts(spark, d):
    return curate.joined([table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id", "kind")])


@query(f"""WITH v AS (SELECT source_product_id, {SPACE.format('category')} AS t FROM (SELECT DISTINCT source_product_id, category FROM all_product))
SELECT source_product_id, CASE WHEN count(DISTINCT coalesce(t, '')) = 1 THEN nullif(min(coalesce(t, '')), '') END AS kind FROM v GROUP BY source_product_id""")
def product_types(spark, d):
    rows = table(spark, d, "all_product").groupBy("source_product_id").agg(F.collect_set(F.struct(F.lit("en").alias("language_tag"), F.col("category").alias("value"))).alias("v"))
    return rows.select("source_product_id", F.nullif(listing.product_type("v"), F.lit("")).alias("kind"))


@query("SELECT product_id, count(DISTINCT material) AS n FROM all_product GROUP BY product_id HAVING count(DISTINCT material) > 1")
def conflicting_materials(spark, d):
    return checks.conflicting(table(spark, d, "all_product"), "product_id", "material")
