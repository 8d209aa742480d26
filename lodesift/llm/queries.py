"""The queries of the training-data problems, p1 to p10, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodesift.llm import canonical, components, encode, leakage, near, overlap, proportions, quality, splits, stable_sample


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.product_groups(spark, sf_dir).toDF("product_index", "group_index")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportions.product_sample(spark, sf_dir)[1].where("exhausted").select("target_id")


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportions.product_sample(spark, sf_dir)[0].withColumnRenamed("id", "product_id")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportions.product_sample(spark, sf_dir)[1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_sample": p2_sample,
    "p2_report": p2_report,
    "p3_found": canonical.product_values,
    "p3_entries": canonical.product_entries,
    "p4_found": overlap.overlap_pairs,
    "p4_counts": overlap.overlap_counts,
    "p5_found": near.product_pairs,
    "p5_groups": near.product_groups,
    "p6_found": splits.parted_samples,
    "p6_splits": splits.export_splits,
    "p6_forest": splits.export_forest,
    "p6_report": splits.split_report,
    "p7_sample": stable_sample.export_sample,
    "p7_components": stable_sample.component_sample,
    "p7_at_once": stable_sample.whole_sample,
    "p8_ids": encode.document_ids,
    "p8_bytes": encode.byte_counts,
    "p8_tokens": encode.token_counts,
    "p9_found": leakage.benchmark_leaks,
    "p10_found": quality.poor_documents,
    "p10_passages": quality.document_passages,
    "p10_statistics": quality.document_statistics,
}

PLAIN = r"lower(regexp_replace({0}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'))"
FRACTION = "('0x' || substr(sha256({0}), 1, 13))::BIGINT / 4503599627370496.0"
SPLIT = f"CASE {PLAIN.format('split')} WHEN 'valid' THEN 'validation' WHEN 'val' THEN 'validation' WHEN '' THEN NULL ELSE {PLAIN.format('split')} END"

#: Products linked directly or indirectly: r1(x, y).
LINKED = """v AS (SELECT DISTINCT product_index AS i FROM all_product WHERE product_index IS NOT NULL),
m AS (SELECT DISTINCT k, i FROM (SELECT coalesce('id:' || component_id, 'row:' || rn) AS k, unnest(member_indices) AS i FROM (SELECT *, row_number() OVER () AS rn FROM component)) WHERE i IN (SELECT i FROM v)),
e1 AS (SELECT left_index AS a, right_index AS b FROM match_pair WHERE left_index <> right_index AND left_index IN (SELECT i FROM v) AND right_index IN (SELECT i FROM v)
  UNION SELECT s.a, m.i FROM m JOIN (SELECT k, min(i) AS a FROM m GROUP BY k) s USING (k) WHERE s.a <> m.i),
e2 AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1),
r1(x, y) AS (SELECT a, b FROM e2 UNION SELECT r1.x, e2.b FROM r1 JOIN e2 ON r1.y = e2.a)"""
#: Pictures named by each sample: pics(sample_id, picture, image_id, phash).
PICTURES = """t AS (SELECT DISTINCT sample_id, unnest(regexp_extract_all(upper(e), '[A-Z0-9]+')) AS w FROM (SELECT sample_id, unnest(source_image_ids) AS e FROM export_ids)),
pics AS (SELECT DISTINCT t.sample_id, coalesce(upper(a.sha256), a.image_id) AS picture, a.phash FROM t JOIN asset a ON t.w = upper(a.image_id)
  UNION SELECT DISTINCT t.sample_id, upper(a.sha256), a.phash FROM t JOIN asset a ON t.w = upper(a.sha256))"""
TARGETS = f"""p AS (SELECT DISTINCT product_id, {PLAIN.format('violation_type')} AS v, {PLAIN.format('difficulty')} AS d, {PLAIN.format('category')} AS c FROM all_product WHERE product_id IS NOT NULL),
n AS (SELECT count(DISTINCT product_id) // 5 AS n FROM p),
q AS (SELECT t.target_set, t.target_id, greatest(t.min_rows, (t.share_bp * (SELECT n FROM n) + 9999) // 10000)::BIGINT AS need,
  (SELECT count(DISTINCT product_id) FROM p WHERE (t.violation_type IS NULL OR v = {PLAIN.format('t.violation_type')}) AND (t.difficulty IS NULL OR d = {PLAIN.format('t.difficulty')})
    AND (t.category IS NULL OR c = {PLAIN.format('t.category')})) AS available FROM sample_target t)"""

PRIORITY = "('0x' || substr(sha256('7:' || product_id), 1, 13))::BIGINT"
SQL: dict[str, str] = {
    "p2_sample": f"""WITH {TARGETS}, m AS (SELECT DISTINCT t.target_set, t.target_id, p.product_id, q.need FROM p JOIN sample_target t ON (t.violation_type IS NULL OR v = {PLAIN.format('t.violation_type')}) AND (t.difficulty IS NULL OR d = {PLAIN.format('t.difficulty')})
  AND (t.category IS NULL OR c = {PLAIN.format('t.category')}) JOIN q ON q.target_id = t.target_id)
SELECT target_set, target_id, product_id FROM m QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY {PRIORITY}, product_id) <= need""",
    "p1_found": f"WITH RECURSIVE {LINKED} SELECT x AS product_index, min(y) AS group_index FROM r1 GROUP BY x",
    "p2_found": f"WITH {TARGETS} SELECT target_id FROM q WHERE available < need",
    "p2_report": f"WITH {TARGETS} SELECT target_set, target_id, need, available, least(need, available) AS taken, available < need AS exhausted FROM q",
    "p4_found": f"""WITH {PICTURES}, s AS (SELECT DISTINCT sample_id, {SPLIT} AS split FROM export_ids WHERE sample_id IS NOT NULL),
k AS (SELECT sample_id, upper(regexp_extract(sample_id, '([^_]+)_([0-9]+)$', 1)) || '_' || regexp_extract(sample_id, '([^_]+)_([0-9]+)$', 2)::INT AS k FROM s WHERE regexp_matches(sample_id, '[^_]+_[0-9]+$')),
h AS (SELECT sample_id, ('0x' || phash)::UBIGINT AS b FROM pics WHERE phash IS NOT NULL),
hb AS (SELECT sample_id, b, unnest([{{'i': 0, 'v': b & 8191}}, {{'i': 1, 'v': (b >> 13) & 8191}}, {{'i': 2, 'v': (b >> 26) & 8191}}, {{'i': 3, 'v': (b >> 39) & 8191}}, {{'i': 4, 'v': (b >> 52) & 4095}}]) AS s FROM h),
pairs AS (SELECT x.sample_id AS x, y.sample_id AS y FROM k x JOIN k y USING (k) UNION SELECT x.sample_id, y.sample_id FROM pics x JOIN pics y USING (picture)
  UNION SELECT x.sample_id, y.sample_id FROM hb x JOIN hb y ON x.s = y.s AND bit_count(xor(x.b, y.b)) <= 4)
SELECT DISTINCT least(x, y) AS sample_id_a, greatest(x, y) AS sample_id_b FROM pairs JOIN s a ON a.sample_id = x AND a.split = 'train' JOIN s b ON b.sample_id = y AND b.split IN ('validation', 'test')""",
    "p5_found": f"""WITH f AS (SELECT DISTINCT product_id, {PLAIN.format('category')} AS c,
list_distinct(list_concat(regexp_extract_all(lower(title), '[a-z0-9]+'), list_filter(list_concat([images.main.image_id], list_transform(images.detail, lambda x: x.image_id)), lambda x: x IS NOT NULL))) AS f
FROM all_product WHERE category IS NOT NULL AND title IS NOT NULL AND {PLAIN.format('title')} <> '')
SELECT DISTINCT x.product_id AS product_id_a, y.product_id AS product_id_b FROM f x JOIN f y ON x.c = y.c AND x.product_id < y.product_id
WHERE 10 * len(list_intersect(x.f, y.f)) >= 6 * (len(x.f) + len(y.f) - len(list_intersect(x.f, y.f)))""",
    "p5_groups": f"""WITH RECURSIVE f AS (SELECT DISTINCT product_id, {PLAIN.format('category')} AS c,
list_sort(list_distinct(list_concat(regexp_extract_all(lower(title), '[a-z0-9]+'), list_filter(list_concat([images.main.image_id], list_transform(images.detail, lambda x: x.image_id)), lambda x: x IS NOT NULL)))) AS f
FROM all_product WHERE category IS NOT NULL AND title IS NOT NULL AND {PLAIN.format('title')} <> ''), k AS (SELECT c, f, min(product_id) AS name, count(*) AS n FROM f WHERE len(f) > 0 GROUP BY c, f),
e AS (SELECT x.name AS a, y.name AS b FROM k x JOIN k y ON x.c = y.c AND x.name <> y.name WHERE 10 * len(list_intersect(x.f, y.f)) >= 6 * (len(x.f) + len(y.f) - len(list_intersect(x.f, y.f)))),
r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a), g AS (SELECT x, least(x, min(y)) AS g FROM r GROUP BY x), l AS (SELECT a, count(*) AS l FROM e GROUP BY a)
SELECT product_id, coalesce(g, name) AS group_id, coalesce(l, 0)::BIGINT AS links FROM f JOIN k USING (c, f) LEFT JOIN g ON g.x = name LEFT JOIN l ON l.a = name WHERE g IS NOT NULL OR n > 1""",
    "p8_bytes": "SELECT lang, count(*) AS n_docs, sum(coalesce(strlen(text), 0))::BIGINT AS n_bytes FROM documents GROUP BY lang",
    "p6_found": f"""WITH RECURSIVE {LINKED}, {PICTURES}, g AS (SELECT x AS i, min(y) AS g FROM r1 GROUP BY x),
o AS (SELECT DISTINCT sample_id, unnest(source_product_ids) AS p FROM export_ids WHERE sample_id IS NOT NULL),
keys AS (SELECT sample_id, 'p' || p AS k FROM o WHERE p IS NOT NULL UNION SELECT sample_id, 's' || picture FROM pics
  UNION SELECT o.sample_id, 'g' || g.g FROM o JOIN all_product a ON a.source_product_id = o.p JOIN g ON g.i = a.product_index),
e3 AS (SELECT DISTINCT s.a, keys.sample_id AS b FROM keys JOIN (SELECT k, min(sample_id) AS a FROM keys GROUP BY k) s USING (k) WHERE s.a <> keys.sample_id),
e4 AS (SELECT a, b FROM e3 UNION SELECT b, a FROM e3), r2(x, y) AS (SELECT a, b FROM e4 UNION SELECT r2.x, e4.b FROM r2 JOIN e4 ON r2.y = e4.a),
gr AS (SELECT x AS sample_id, min(y) AS group_id FROM r2 GROUP BY x), sp AS (SELECT DISTINCT sample_id, {SPLIT} AS split FROM export_ids),
many AS (SELECT group_id FROM gr JOIN sp USING (sample_id) GROUP BY group_id HAVING count(DISTINCT split) > 1)
SELECT sample_id, group_id FROM gr WHERE group_id IN (SELECT group_id FROM many)""",
    "p7_sample": f"""WITH w AS (SELECT sample_id, max(greatest(1, coalesce(len(list_distinct(source_image_ids)), 1)))::BIGINT AS weight FROM export_ids WHERE sample_id IS NOT NULL GROUP BY sample_id)
SELECT sample_id, weight FROM w WHERE {FRACTION.format("'sample:' || sample_id")} < weight * 0.05::DOUBLE""",
    "p7_components": f"""WITH c AS (SELECT component_id, list_distinct(member_indices) AS m FROM component WHERE component_id IS NOT NULL),
w AS (SELECT component_id, max(coalesce(len(m), 0)) AS weight FROM c GROUP BY component_id), s AS (SELECT component_id FROM w WHERE {FRACTION.format("'component:' || component_id")} < weight * 0.05::DOUBLE)
SELECT DISTINCT component_id, product_index FROM (SELECT component_id, unnest(m) AS product_index FROM c WHERE component_id IN (SELECT component_id FROM s))""",
}
#: Bringing the deliveries in one by one gives the sample of all of them.
SQL["p7_at_once"] = SQL["p7_sample"]
