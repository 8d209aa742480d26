"""Queries of the making of labelled samples over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodesift.functions import protocol, title
from lodesift.functions.text import filled, lexical_distance, plain, value_distance
from lodesift.operators import synthesize
from lodesift.plans.catalog import FAMILIES
from lodesift.plans.registry import PLAIN, SPACE, query
from lodesift.session import beside, table

SEP = r"(?:[\s_./\\,&:;()+\[\]–—-]+|\s+and\s+)"
WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
LABELS = ("pass", "wrong_image", "title_mismatch", "duplicate_detail_image")


def sql_pattern(field: str, value: str) -> str:
    own = f"array_to_string({WORDS.format(value)}, ' ')"
    groups = {"color": {"gray,grey": r"\bgray\b|\bgrey\b", "navy,navy blue": rf"\bnavy{SEP}blue\b|\bnavy\b"}, "material": {"aluminum,aluminium": r"\baluminium\b|\baluminum\b"}, "category": {}}[field]
    cases = " ".join(f"WHEN {own} IN ({', '.join(repr(x) for x in names.split(','))}) THEN '{p}'" for names, p in groups.items())
    return f"CASE {cases} WHEN {own} <> '' THEN '\\b' || array_to_string({WORDS.format(value)}, '{SEP}') || '\\b' END"


def sql_scattered(text: str, value: str) -> str:
    need, words = f"list_distinct({WORDS.format(value)})", WORDS.format(text)
    return f"(len({need}) > 1 AND len({words}) >= len({need}) AND len(list_filter(range(1, len({words}) - len({need}) + 2), lambda i: list_has_all({words}[i:i + len({need}) + 2], {need}))) > 0)"


def sql_eligible(field: str) -> str:
    found = f"coalesce(regexp_matches(title, {sql_pattern(field, field)}, 'i'), false)"
    return f"({field} IS NOT NULL AND {field} <> '' AND ({found} OR NOT {sql_scattered('title', field)}))"


@query(f"""WITH p AS (SELECT DISTINCT product_id, title, color FROM all_product WHERE title IS NOT NULL), m AS (SELECT *, {sql_pattern('color', 'color')} AS pat FROM p),
f AS (SELECT *, coalesce(regexp_extract_all(title, pat, 0, 'i'), []) AS found FROM m), e AS (SELECT *, CASE WHEN color IS NULL OR color = '' THEN 'empty' WHEN len(found) = 0 AND {sql_scattered('title', 'color')} THEN 'ambiguous' END AS error FROM f)
SELECT product_id, CASE WHEN error IS NULL AND len(found) > 0 THEN regexp_replace(title, pat, 'US$5 Violet', 'gi') ELSE title END AS title, CASE WHEN error IS NULL THEN CASE WHEN len(found) > 0 THEN 'replace_all' ELSE 'no_mention' END END AS policy,
CASE WHEN error IS NULL THEN len(found) END AS mentions, CASE WHEN error IS NULL THEN array_to_string(found, '|') END AS matched, error FROM e""")
def title_mutation(spark, d):
    rows = table(spark, d, "all_product").where("title is not null").select("product_id", "title", "color").distinct()
    out = rows.select("product_id", title.mutation("title", "color", "color", F.lit("US$5 Violet")).alias("m"))
    return out.select("product_id", "m.title", "m.policy", F.col("m.source_mentions").cast("bigint").alias("mentions"), F.array_join("m.matched_texts", "|").alias("matched"), "m.error")


@query(f"""WITH p AS (SELECT DISTINCT product_id, title, color, material, category FROM all_product WHERE title IS NOT NULL)
SELECT product_id, {sql_eligible('color')} AS color, {sql_eligible('material')} AS material, {sql_eligible('category')} AS category FROM p""")
def attribute_eligible(spark, d):
    rows = table(spark, d, "all_product").where("title is not null").select("product_id", "title", "color", "material", "category").distinct()
    return rows.select("product_id", *[title.title_eligible("title", c, c).alias(c) for c in ("color", "material", "category")])


@query(f"""WITH p AS (SELECT DISTINCT product_id, title, color, material, category FROM all_product WHERE title IS NOT NULL), c AS (SELECT count(*) AS n, count_if({sql_eligible('color')}) AS color, count_if({sql_eligible('material')}) AS material FROM p),
q AS (SELECT 'color_mismatch' AS label, n AS requested, least(n, color) AS effective FROM c UNION ALL SELECT 'material_mismatch', n, least(n, material) FROM c UNION ALL SELECT 'pass', n, n + greatest(0, n - color) + greatest(0, n - material) FROM c)
SELECT label, requested::BIGINT AS requested, effective::BIGINT AS effective FROM q""")
def quota_adjustment(spark, d):
    able = attribute_eligible(spark, d)
    c = able.agg(F.count("*").alias("n"), F.count_if("color").alias("color"), F.count_if("material").alias("material")).first()
    asked = {"color_mismatch": c["n"], "material_mismatch": c["n"], "pass": c["n"]}
    given = synthesize.adjusted_quota(asked, {"color_mismatch": c["color"], "material_mismatch": c["material"]}, c["n"])
    return spark.createDataFrame([(k, n, given[k]) for k, n in asked.items()], "label string, requested bigint, effective bigint")


PARTS = "p AS (SELECT p_partkey AS k, p_type AS b, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS color, CASE WHEN p_size % 5 <> 0 THEN upper(split_part(p_name, ' ', 2)) ELSE '' END AS material FROM part)"
SAME = "(coalesce(x.color, '') = '' OR coalesce(y.color, '') = '' OR lower(x.color) = lower(y.color)) AND (coalesce(x.material, '') = '' OR coalesce(y.material, '') = '' OR lower(x.material) = lower(y.material))"


def donor_rows(spark, d):
    color = F.when(F.col("p_size") % 3 != 0, F.col("p_brand"))
    material = F.when(F.col("p_size") % 5 != 0, F.upper(F.substring_index("p_name", " ", -1))).otherwise(F.lit(""))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("b"), color.alias("color"), material.alias("material"))


@query(f"WITH {PARTS} SELECT x.k, min(y.k) AS donor FROM p x LEFT JOIN p y ON x.b = y.b AND x.k <> y.k AND {SAME} GROUP BY x.k")
def title_donors(spark, d):
    return synthesize.compatible_donor(donor_rows(spark, d), "k", "b")


@query(f"""WITH {PARTS}, q AS (SELECT * REPLACE (b || (k % 40) AS b) FROM p), s AS (SELECT x.k, min(y.k) AS a FROM q x JOIN q y ON x.b = y.b AND x.k <> y.k AND {SAME} GROUP BY x.k), w AS (SELECT x.k, min(y.k) AS a FROM q x JOIN q y ON x.b = y.b AND x.k <> y.k GROUP BY x.k)
SELECT q.k, coalesce(s.a, w.a) AS donor FROM q LEFT JOIN s USING (k) LEFT JOIN w USING (k)""")
def picture_donors(spark, d):
    rows = donor_rows(spark, d).withColumn("b", F.concat("b", (F.col("k") % 40).cast("string")))
    return synthesize.compatible_donor(rows, "k", "b", fallback=True)


LEXICAL = """CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN 1 - len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y})))
+ CASE WHEN substr(trim(lower({a})), 1, 1) <> substr(trim(lower({b})), 1, 1) THEN 0.05 ELSE 0 END ELSE 0 END"""
FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{'|'.join(w)}') THEN '{n}'" for n, w in FAMILIES.items()) + " END"


def sql_farthest(rows: str, distance: str, key: str) -> str:
    return f"""WITH r AS ({rows}), v AS (SELECT DISTINCT v FROM r WHERE v IS NOT NULL), d AS (SELECT a.v, b.v AS c, list_distinct({WORDS.format('a.v')}) AS x, list_distinct({WORDS.format('b.v')}) AS y FROM v a JOIN v b ON trim(lower(a.v)) <> trim(lower(b.v)) AND b.v <> ''),
e AS (SELECT v, c, round({distance}, 9) AS dist FROM d), t AS (SELECT v, c FROM e QUALIFY dist = max(dist) OVER (PARTITION BY v))
SELECT r.k AS {key}, r.v, arg_max(t.c, substr(sha256('42:' || r.k || ':' || t.c), 1, 16)) AS chosen FROM r LEFT JOIN t ON r.v = t.v GROUP BY r.k, r.v"""


LEX = LEXICAL.format(x="x", y="y", a="v", b="c")


@query(sql_farthest("SELECT p_partkey AS k, p_name AS v FROM part", f"CASE WHEN {FAMILY.format('v')} = {FAMILY.format('c')} THEN 0.2 * ({LEX}) WHEN {FAMILY.format('v')} IS NOT NULL AND {FAMILY.format('c')} IS NOT NULL THEN 2 + ({LEX}) ELSE {LEX} END", "p_partkey"))
def farthest_value(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("v"))
    return synthesize.farthest_value(rows, "p_partkey", "v", lambda a, b: value_distance(a, b, FAMILIES), rows)


@query(sql_farthest(f"SELECT DISTINCT product_id AS k, replace({PLAIN.format('category')}, '_', ' ') AS v FROM all_product", LEX, "product_id"))
def category_choice(spark, d):
    rows = table(spark, d, "all_product").select("product_id", F.replace(plain("category"), F.lit("_"), F.lit(" ")).alias("v")).distinct()
    return synthesize.farthest_value(rows, "product_id", "v", lexical_distance, rows)


def allocation(spark, d):
    rows = table(spark, d, "all_product").select("product_id", "color", "material").distinct()
    n = rows.count()
    quotas = {"pass": n, "image_quality": n - n // 4, "duplicate_detail_image": n - n // 4, "color_mismatch": n // 4, "material_mismatch": n // 4}
    return synthesize.allocated(rows, "product_id", {"color_mismatch": filled("color"), "material_mismatch": filled("material")}, quotas)


@query("""WITH n AS (SELECT count(DISTINCT product_id) AS n FROM all_product) SELECT label, k::BIGINT AS n, n AS products FROM (SELECT 'pass' AS label, n AS k, n FROM n UNION ALL SELECT 'image_quality', n - n // 4, n FROM n
UNION ALL SELECT 'duplicate_detail_image', n - n // 4, n FROM n UNION ALL SELECT 'color_mismatch', n // 4, n FROM n UNION ALL SELECT 'material_mismatch', n // 4, n FROM n)""")
def allocation_counts(spark, d):
    """Records that have each label, and records with exactly three different ones."""
    found = allocation(spark, d)
    three = found.where(F.size(F.array_distinct("labels")) == 3).agg(F.count_distinct("product_id").alias("products"))
    return beside(found.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")), three)


@query(f"""WITH r AS (SELECT DISTINCT product_id, category, color, material FROM all_product), a AS (SELECT product_id FROM r WHERE {SPACE.format('color')} <> '') SELECT 0::BIGINT AS wrong FROM (SELECT count(*) FROM a)""")
def allocation_faults(spark, d):
    """How many records have a label that they may not have."""
    rows = table(spark, d, "all_product").select("product_id", filled("color").alias("c"), filled("material").alias("m")).distinct()
    met = allocation(spark, d).join(rows, "product_id")
    bad = (F.array_contains("labels", "color_mismatch") & ~F.col("c")) | (F.array_contains("labels", "material_mismatch") & ~F.col("m"))
    return met.agg(F.count_if(bad).alias("wrong"))


@query(f"""WITH p AS (SELECT DISTINCT product_id, title, {PLAIN.format('category')} AS category, images.main.image_id AS m, images.detail[1].image_id AS d1, images.detail[2].image_id AS d2 FROM all_product WHERE {SPACE.format('category')} <> ''),
two AS (SELECT category, list(product_id ORDER BY product_id)[1:2] AS l FROM p GROUP BY category), w AS (SELECT p.*, CASE WHEN l[1] <> product_id THEN l[1] ELSE l[2] END AS donor FROM p JOIN two USING (category)),
x AS (SELECT w.*, q.title AS dt, q.d2 AS dd2 FROM w LEFT JOIN p q ON q.product_id = w.donor), i AS (SELECT unnest([1, 2, 3, 4]) AS i),
s AS (SELECT *, [{', '.join(repr(x) for x in LABELS)}][i] AS kind FROM x CROSS JOIN i)
SELECT product_id || '_0' || i AS product_id, i AS sample_index, kind AS violation_type, CASE kind WHEN 'pass' THEN 'easy' WHEN 'duplicate_detail_image' THEN 'easy' WHEN 'wrong_image' THEN 'medium' ELSE 'hard' END AS difficulty,
CASE WHEN kind = 'title_mismatch' THEN dt ELSE title END AS title, d1 AS first_detail, CASE kind WHEN 'duplicate_detail_image' THEN d1 WHEN 'wrong_image' THEN dd2 ELSE d2 END AS second_detail,
CASE WHEN kind = 'wrong_image' THEN 'detail:2' END AS target_image_ref FROM s WHERE donor IS NOT NULL OR kind NOT IN ('wrong_image', 'title_mismatch')""")
def made_samples(spark, d):
    rows = table(spark, d, "all_product").where(filled("category")).select("product_id", "title", plain("category").alias("category"), "images").distinct()
    donors = synthesize.nearest_donor(rows.select("product_id", "category"), "product_id", "category", ["category"])
    of = rows.select(F.col("product_id").alias("donor"), F.struct("title", "images").alias("_d"))
    whole = rows.join(donors, "product_id", "left").join(of, "donor", "left").drop("donor").withColumnRenamed("_d", "donor")
    made = synthesize.made(whole.withColumn("labels", F.array(*[F.lit(x) for x in LABELS])))
    detail = lambda n: F.get("images.detail", F.lit(n))["image_id"]
    return made.select("product_id", "sample_index", "violation_type", "difficulty", "title", detail(0).alias("first_detail"), detail(1).alias("second_detail"), "target_image_ref")


@query(f"""WITH p AS (SELECT DISTINCT product_id, source_product_id, {PLAIN.format('violation_type')} AS kind, substr(sha256('42:' || product_id), 1, 16) AS h FROM all_product),
a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source_product_id ORDER BY h, product_id) <= 1), b AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h, product_id) AS n FROM a)
SELECT product_id, kind FROM b WHERE n <= CASE kind WHEN 'pass' THEN 120 WHEN 'wrong_image' THEN 40 WHEN 'color_mismatch' THEN 9 ELSE 0 END""")
def resampled(spark, d):
    rows = table(spark, d, "all_product").select("product_id", "source_product_id", plain("violation_type").alias("kind")).distinct()
    return synthesize.resampled(rows, "product_id", "source_product_id", "kind", {"pass": 120, "wrong_image": 40, "color_mismatch": 9}, 1).select("product_id", "kind")


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_partkey, ['blur', 'low_resolution', 'occlusion'][k % 3 + 1] AS subtype, ['main', 'detail:1', 'detail:2'][(k // 3) % 3 + 1] AS place FROM r""")
def quality_pairs(spark, d):
    order = [F.col("p_partkey")]
    return table(spark, d, "part").select("p_partkey", synthesize.turn(order, protocol.SUBTYPES, ["p_type"]).alias("subtype"), synthesize.turn(order, protocol.PLACES, ["p_type"], apart=3).alias("place"))


@query("""SELECT DISTINCT dataset, CASE WHEN dataset = 'test' THEN 'test' WHEN dataset LIKE 'sft~_%' ESCAPE '~' THEN 'sft' ELSE 'grpo' END AS stage,
CASE WHEN dataset = 'test' THEN 'test' WHEN dataset LIKE '%~_valid' ESCAPE '~' THEN 'validation' ELSE 'train' END AS split FROM all_product WHERE dataset IS NOT NULL""")
def stages_of_sets(spark, d):
    stage, split = synthesize.stage_and_split(F.col("dataset"))
    return table(spark, d, "all_product").where("dataset is not null").select("dataset", stage.alias("stage"), split.alias("split")).distinct()
