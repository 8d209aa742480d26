"""The registered queries of the core operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodesift.functions import protocol
from lodesift.functions.hashing import bits64, fraction, hex16
from lodesift.functions.text import family, filled, lexical_distance, mentions, one_value, plain, replace_phrase, token_set
from lodesift.operators import checks, evaluate, graph, reward, split, synthesize
from lodesift.plans.registry import HASH, PLAIN, QUERIES, SPACE, SQL, query, rounded
from lodesift.session import beside, table
from lodesift.streaming.events import windowed

#: Cost of a wrong decision and share of each decision in use.
COSTS = {("pass", "reject"): 0.75, ("reject", "pass"): 1.0}
NONE = "~"
PRIORS = {"pass": 0.6, "reject": 0.4}
STAGES = (("sft", 0.4), ("grpo", 0.4), ("test", 0.2))
FAMILIES = {"dark": ("black", "navy", "charcoal"), "warm": ("red", "orange", "yellow", "gold", "brown"), "cool": ("blue", "green", "teal", "cyan")}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled records of all_product, once each, with a made answer of each that is wrong for some hashes."""
    rows = table(spark, sf_dir, "all_product").where(filled("violation_type"))
    rows = rows.select("product_id", *[plain(c).alias(c) for c in ("violation_type", "category", "issue_subtype", "target_image_ref")])
    # subtype and place are those of a row that has the record's type; NONE sorts behind all of them
    known = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(NONE)).alias(c) for c in ("issue_subtype", "target_image_ref")]
    rows = rows.groupBy("product_id").agg(F.min("violation_type").alias("violation_type"), F.min("category").alias("category"), F.min(F.struct("violation_type", *known)).alias("r"))
    u = fraction("product_id")
    said = F.when(u < 0.7, F.col("violation_type")).when(u < 0.8, F.lit("pass")).when(u < 0.95, F.lit("wrong_image"))
    decide = lambda kind: F.when(kind == "pass", F.lit("pass")).when(kind.isNotNull(), F.lit("reject"))
    rows = rows.select(
        "product_id", "category", "violation_type", decide(F.col("violation_type")).alias("decision"), said.alias("p_violation_type"), decide(said).alias("p_decision"),
        F.when((F.col("violation_type") == "image_quality") & (F.col("r.issue_subtype") != NONE), F.col("r.issue_subtype")).alias("issue_subtype"),
        F.when(F.col("violation_type").isin(*protocol.WITH_EVIDENCE) & F.col("r.target_image_ref").isin(*protocol.PLACES), F.col("r.target_image_ref")).alias("evidence"),
    )
    subtype = F.when(fraction(F.concat(F.lit("subtype:"), "product_id")) < 0.7, F.col("issue_subtype")).otherwise(F.lit("blur"))
    place = F.when(fraction(F.concat(F.lit("place:"), "product_id")) < 0.7, F.coalesce("evidence", F.lit("main"))).otherwise(F.lit("main"))
    return rows.withColumns({
        "p_issue_subtype": F.when(F.col("p_violation_type") == "image_quality", subtype),
        "p_evidence": F.when(F.col("p_violation_type").isin(*protocol.WITH_EVIDENCE), place),
    })


RECORDS = f"""r0 AS (SELECT product_id, min({PLAIN.format('violation_type')}) AS violation_type, min({PLAIN.format('category')}) AS category
  FROM all_product WHERE {SPACE.format('violation_type')} <> '' GROUP BY product_id),
r1 AS (SELECT *, {HASH.format('product_id')} AS u FROM r0),
r2 AS (SELECT product_id, category, violation_type, CASE WHEN violation_type = 'pass' THEN 'pass' ELSE 'reject' END AS decision,
  CASE WHEN u < 0.7 THEN violation_type WHEN u < 0.8 THEN 'pass' WHEN u < 0.95 THEN 'wrong_image' END AS p_violation_type FROM r1),
r AS (SELECT *, CASE WHEN p_violation_type = 'pass' THEN 'pass' WHEN p_violation_type IS NOT NULL THEN 'reject' END AS p_decision FROM r2)"""
#: The records with subtypes and places: rd, after RECORDS; x has which parts of the answer are right.
DETAILED = f"""g0 AS (SELECT product_id, {PLAIN.format('violation_type')} AS kind, nullif({PLAIN.format('issue_subtype')}, '') AS s, nullif({PLAIN.format('target_image_ref')}, '') AS t FROM all_product WHERE {SPACE.format('violation_type')} <> ''),
g AS (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY kind, s NULLS LAST, t NULLS LAST) = 1),
rd0 AS (SELECT r.*, CASE WHEN kind = 'image_quality' THEN s END AS issue_subtype, CASE WHEN kind IN ('image_quality', 'wrong_image') AND t IN ('main', 'detail:1', 'detail:2') THEN t END AS evidence
  FROM r JOIN g ON r.product_id IS NOT DISTINCT FROM g.product_id),
rd AS (SELECT *, CASE WHEN p_violation_type = 'image_quality' THEN CASE WHEN {HASH.format("'subtype:' || product_id")} < 0.7 THEN issue_subtype ELSE 'blur' END END AS p_issue_subtype,
  CASE WHEN p_violation_type IN ('image_quality', 'wrong_image') THEN CASE WHEN {HASH.format("'place:' || product_id")} < 0.7 THEN coalesce(evidence, 'main') ELSE 'main' END END AS p_evidence FROM rd0),
x AS (SELECT *, coalesce(p_decision, 'INVALID') AS said, coalesce(violation_type = p_violation_type, false) AS typed, coalesce(evidence = p_evidence, false) AS placed,
  issue_subtype IS NOT DISTINCT FROM p_issue_subtype AS subtyped, evidence IS NOT DISTINCT FROM p_evidence AS same_place FROM rd),
y AS (SELECT *, said = decision AND typed AND (violation_type NOT IN ('image_quality', 'wrong_image') OR placed) AND (violation_type <> 'image_quality' OR subtyped) AS complete FROM x)"""
CONFUSION = "c AS (SELECT decision, coalesce(p_decision, 'INVALID') AS predicted, count(*) AS n FROM r GROUP BY ALL)"


@query(f"WITH {RECORDS}, {CONFUSION} SELECT * FROM c")
def eval_confusion(spark, d):
    return evaluate.confusion(records(spark, d))


@query(f"""WITH {RECORDS}, {CONFUSION}, l AS (SELECT decision AS label FROM c UNION SELECT predicted FROM c),
f AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM c WHERE decision = label AND predicted = label) AS hit,
  (SELECT coalesce(sum(n), 0) FROM c WHERE decision = label) + (SELECT coalesce(sum(n), 0) FROM c WHERE predicted = label) AS b FROM l)
SELECT label, round(CASE WHEN b = 0 THEN 0 ELSE 2.0::DOUBLE * hit / b END, 9) AS f1 FROM f""")
def macro_f1(spark, d):
    return rounded(evaluate.macro_f1(evaluate.confusion(records(spark, d))))


@query(f"""WITH {RECORDS}, s AS (SELECT *, coalesce(p_decision, 'INVALID') AS said, coalesce(violation_type = p_violation_type, false) AS typed FROM r)
SELECT count(*) AS n, round(avg((said = decision)::INT), 9) AS decision_accuracy, round(avg(typed::INT), 9) AS type_accuracy,
round(avg((said = decision AND typed)::INT), 9) AS complete_accuracy,
round(avg((said = 'reject')::INT) FILTER (decision = 'reject'), 9) AS detection_rate, round(avg((said = 'pass')::INT) FILTER (decision = 'reject'), 9) AS miss_rate,
round(avg((said = 'reject')::INT) FILTER (decision = 'pass'), 9) AS false_reject_rate, round(avg((said = 'INVALID')::INT), 9) AS invalid_rate FROM s""")
def eval_report(spark, d):
    return rounded(evaluate.report(records(spark, d), detail=False))


@query(f"""WITH {RECORDS}, {DETAILED} SELECT count(*) AS n, round(avg((said = decision)::INT), 9) AS decision_accuracy, round(avg(typed::INT), 9) AS type_accuracy,
round(avg(complete::INT), 9) AS complete_accuracy,
round(avg((said = 'reject')::INT) FILTER (decision = 'reject'), 9) AS detection_rate, round(avg((said = 'pass')::INT) FILTER (decision = 'reject'), 9) AS miss_rate,
round(avg((said = 'reject')::INT) FILTER (decision = 'pass'), 9) AS false_reject_rate, round(avg((said = 'INVALID')::INT), 9) AS invalid_rate FROM y""")
def eval_report_complete(spark, d):
    return rounded(evaluate.report(records(spark, d)))


@query(f"""WITH {RECORDS}, s AS (SELECT violation_type AS a, coalesce(p_violation_type, 'INVALID') AS b FROM r), l AS (SELECT a AS label FROM s UNION SELECT b FROM s),
f AS (SELECT label, (SELECT count(*) FROM s WHERE a = label AND b = label) AS hit, (SELECT count(*) FROM s WHERE a = label) + (SELECT count(*) FROM s WHERE b = label) AS n FROM l)
SELECT round(avg(2.0::DOUBLE * hit / n), 9) AS macro_f1 FROM f""")
def type_macro_f1(spark, d):
    return rounded(evaluate.type_macro_f1(records(spark, d)))


@query(f"""WITH {RECORDS}, {CONFUSION}, e AS (SELECT decision, sum(n * CASE WHEN decision = predicted THEN 0.0 WHEN decision = 'pass' AND predicted = 'reject' THEN 0.75 ELSE 1.0 END)::DOUBLE AS cost,
sum(n) AS n FROM c GROUP BY decision) SELECT round(sum(cost / n * CASE decision WHEN 'pass' THEN 0.6 ELSE 0.4 END), 9) AS risk FROM e""")
def expected_cost(spark, d):
    return rounded(evaluate.risk(evaluate.confusion(records(spark, d)), PRIORS, COSTS))


@query(f"""WITH {RECORDS}, x AS (SELECT violation_type, (decision IS NOT DISTINCT FROM p_decision AND violation_type IS NOT DISTINCT FROM p_violation_type)::INT AS e FROM r)
SELECT violation_type, count(*) AS n, sum(e)::BIGINT AS exact, round(avg(e), 9) AS accuracy FROM x GROUP BY violation_type""")
def eval_per_class(spark, d):
    return rounded(evaluate.per_class(records(spark, d), detail=False))


@query(f"""WITH {RECORDS}, {DETAILED}, z AS (SELECT violation_type, (complete AND subtyped AND same_place)::INT AS e FROM y)
SELECT violation_type, count(*) AS n, sum(e)::BIGINT AS exact, round(avg(e), 9) AS accuracy FROM z GROUP BY violation_type""")
def eval_per_class_exact(spark, d):
    return rounded(evaluate.per_class(records(spark, d)))


@query(f"""WITH {RECORDS}, s AS (SELECT 'category' AS slice, category AS value, coalesce(decision = p_decision, false)::INT AS ok FROM r
UNION ALL SELECT 'violation_type', violation_type, coalesce(decision = p_decision, false)::INT FROM r)
SELECT slice, value, count(*) AS n, round(avg(ok), 9) AS accuracy FROM s WHERE value IS NOT NULL GROUP BY ALL""")
def eval_slices(spark, d):
    return rounded(evaluate.slices(records(spark, d), ("category", "violation_type")))


@query(f"""WITH {RECORDS}, s AS (SELECT product_id, violation_type IN ('image_quality', 'wrong_image') AS ev, violation_type = 'image_quality' AS su,
CASE WHEN decision = p_decision THEN 1.0 WHEN decision = 'pass' AND p_decision = 'reject' THEN -0.5 ELSE -1.0 END AS a, coalesce(violation_type = p_violation_type, false)::INT AS t FROM r),
w AS (SELECT product_id, ev, (0.30 * a + 0.35 * t) / (0.65 + CASE WHEN ev THEN 0.20 ELSE 0 END + CASE WHEN su THEN 0.15 ELSE 0 END) AS b FROM s)
SELECT product_id, round(b::DOUBLE, 9) AS before, round((CASE WHEN ev AND b > 0 THEN b * 0.70 ELSE b END)::DOUBLE, 9) AS reward FROM w""")
def reward_components(spark, d):
    rows = records(spark, d)
    null = F.lit(None).cast("string")
    target = F.struct("decision", "violation_type", null.alias("issue_subtype"), null.alias("evidence"))
    data = F.struct(F.col("p_decision").alias("decision"), F.col("p_violation_type").alias("violation_type"), null.alias("issue_subtype"), null.alias("evidence"))
    scored = rows.select("product_id", reward.scores(target, data, F.col("p_decision").isNotNull(), F.col("p_decision"), COSTS).alias("s"))
    return rounded(scored.select("product_id", "s.before", "s.reward"))


@query(f"""WITH {RECORDS}, {DETAILED}, s AS (SELECT product_id, violation_type IN ('image_quality', 'wrong_image') AS ev, violation_type = 'image_quality' AS su,
CASE WHEN decision = p_decision THEN 1.0 WHEN decision = 'pass' AND p_decision = 'reject' THEN -0.5 ELSE -1.0 END AS a, typed::INT AS t, (typed AND placed)::INT AS e, (typed AND coalesce(issue_subtype = p_issue_subtype, false))::INT AS i FROM x),
w AS (SELECT product_id, ev AND e = 0 AS gated, (0.30 * a + 0.35 * t + CASE WHEN ev THEN 0.20 * e ELSE 0 END + CASE WHEN su THEN 0.15 * i ELSE 0 END) / (0.65 + CASE WHEN ev THEN 0.20 ELSE 0 END + CASE WHEN su THEN 0.15 ELSE 0 END) AS b FROM s)
SELECT product_id, round(b::DOUBLE, 9) AS before, round((CASE WHEN gated AND b > 0 THEN b * 0.70 ELSE b END)::DOUBLE, 9) AS reward FROM w""")
def reward_components_placed(spark, d):
    fields = lambda prefix: F.struct(*[F.col(prefix + c).alias(c) for c in protocol.KEYS])
    scored = records(spark, d).select("product_id", reward.scores(fields(""), fields("p_"), F.col("p_decision").isNotNull(), F.col("p_decision"), COSTS).alias("s"))
    return rounded(scored.select("product_id", "s.before", "s.reward"))


@query("""SELECT user_id, ts::DATE AS day, count(*) AS n, round(avg((event_type = 'purchase')::INT), 9) AS mean,
(stddev_pop((event_type = 'purchase')::INT) > 1e-8 OR count(*) = 1) AS kept FROM events GROUP BY ALL""")
def zero_variance_groups(spark, d):
    rows = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), (F.col("event_type") == "purchase").cast("int").alias("x"))
    return rounded(evaluate.zero_variance_groups(rows, ["user_id", "day"], "x"))


@query(f"""WITH f AS (SELECT doc_id, {HASH.format("'42:dataset-stage:' || doc_id::VARCHAR")} AS u FROM documents),
s AS (SELECT doc_id, CASE WHEN u < 0.4 THEN 'sft' WHEN u < 0.8 THEN 'grpo' ELSE 'test' END AS stage FROM f)
SELECT doc_id, stage, CASE WHEN stage = 'test' THEN 'test' WHEN {HASH.format("'42:' || stage || '-split:' || doc_id::VARCHAR")} < 0.1 THEN 'validation' ELSE 'train' END AS split FROM s""")
def stage_split(spark, d):
    key = F.col("doc_id").cast("string")
    rows = table(spark, d, "documents").select("doc_id", split.stage(42, key, STAGES).alias("stage"))
    return rows.select("doc_id", "stage", split.train_or_validation(42, F.col("stage"), key, 0.1).alias("split"))


@query(f"""WITH s AS (SELECT source, CASE WHEN {HASH.format("'7:' || doc_id::VARCHAR")} < 0.8 THEN 'train' ELSE 'test' END AS split FROM documents WHERE source IS NOT NULL),
c AS (SELECT split, source, count(*) AS n FROM s GROUP BY ALL), z AS (SELECT split, sum(n) AS size FROM c GROUP BY split), t AS (SELECT source, sum(n) AS all_n FROM c GROUP BY source)
SELECT z.split, round(sum(abs(coalesce(c.n, 0)::DOUBLE / z.size - t.all_n::DOUBLE / (SELECT count(*) FROM s))) / 2, 9) AS distance
FROM z CROSS JOIN t LEFT JOIN c ON c.split = z.split AND c.source = t.source GROUP BY z.split""")
def split_distance(spark, d):
    rows = table(spark, d, "documents").where("source is not null").select("source", split.by_fraction(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), (("train", 0.8), ("test", 0.2))).alias("split"))
    return rounded(evaluate.variation_distance(rows, "source", "split"))


@query("""WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY substr(sha256('42:' || p_partkey::VARCHAR), 1, 16), p_partkey) AS turn FROM part)
SELECT p_partkey, p_type, turn FROM r WHERE turn <= 25""")
def capped_round_robin(spark, d):
    return split.capped_round_robin(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "p_partkey", 25)


@query(f"""WITH r AS (SELECT product_index, {PLAIN.format('category')} AS category FROM all_product), c AS (SELECT category, count(*) AS n FROM r GROUP BY category)
SELECT product_index, CASE WHEN coalesce(n, 0) < 20 THEN '__rare__' ELSE r.category END AS pooled FROM r LEFT JOIN c ON r.category = c.category""")
def rare_pooling(spark, d):
    rows = table(spark, d, "all_product").select("product_index", plain("category").alias("category"))
    return split.pooled_category(rows, "category", 20).select("product_index", "pooled")


@query("""WITH r AS (SELECT source_product_id, image_id, coalesce(bytes, 0) AS bytes, row_number() OVER (PARTITION BY source_product_id ORDER BY coalesce(bytes, 0) DESC, substr(sha256(image_id), 1, 16), image_id) AS n FROM asset)
SELECT source_product_id, image_id, bytes FROM r WHERE n = 1""")
def component_representatives(spark, d):
    rows = table(spark, d, "asset").select("source_product_id", "image_id", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return split.representatives(rows, "source_product_id", F.col("bytes"), "image_id")


@query("""SELECT sha256(text) AS sha, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1""")
def exact_copies(spark, d):
    return checks.copies(table(spark, d, "documents"), "doc_id", "text").toDF("sha", "first_id", "copies")


@query("""WITH h AS (SELECT DISTINCT image_id, phash, ('0x' || phash)::UBIGINT AS b FROM asset WHERE regexp_full_match(phash, '[0-9a-fA-F]{16}')),
s AS (SELECT image_id, b, unnest([{'i': 0, 'v': b & 8191}, {'i': 1, 'v': (b >> 13) & 8191}, {'i': 2, 'v': (b >> 26) & 8191}, {'i': 3, 'v': (b >> 39) & 8191}, {'i': 4, 'v': (b >> 52) & 4095}]) AS s FROM h)
SELECT DISTINCT x.image_id AS a, y.image_id AS b, bit_count(xor(x.b, y.b))::INT AS distance FROM s x JOIN s y ON x.s = y.s AND x.image_id < y.image_id WHERE bit_count(xor(x.b, y.b)) <= 4""")
def hamming_pairs(spark, d):
    return graph.hamming_pairs(table(spark, d, "asset").select("image_id", bits64("phash").alias("bits")), "image_id", "bits", 4)


NEAR_HASHES = """h AS (SELECT DISTINCT image_id, sha256, CASE WHEN regexp_full_match(phash, '[0-9a-fA-F]{16}') THEN ('0x' || phash)::UBIGINT END AS b FROM asset),
s AS (SELECT image_id, b, unnest([{'i': 0, 'v': b & 8191}, {'i': 1, 'v': (b >> 13) & 8191}, {'i': 2, 'v': (b >> 26) & 8191}, {'i': 3, 'v': (b >> 39) & 8191}, {'i': 4, 'v': (b >> 52) & 4095}]) AS s FROM h WHERE b IS NOT NULL)"""


@query(f"""WITH RECURSIVE {NEAR_HASHES}, e AS (SELECT x.image_id AS a, y.image_id AS b FROM s x JOIN s y ON x.s = y.s AND x.image_id <> y.image_id WHERE bit_count(xor(x.b, y.b)) <= 4
UNION SELECT x.image_id, y.image_id FROM h x JOIN h y ON x.sha256 = y.sha256 AND x.image_id <> y.image_id),
r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a) SELECT x AS image_id, min(y) AS group_id FROM r GROUP BY x""")
def hash_components(spark, d):
    rows = table(spark, d, "asset").select("image_id", "sha256", bits64("phash").alias("bits"))
    near = graph.hamming_pairs(rows, "image_id", "bits", 4).select("a", "b")
    return graph.groups_of(near.unionByName(graph.relation_links(rows, "image_id", ["sha256"]))).toDF("image_id", "group_id")


@query("""WITH r AS (SELECT DISTINCT product_id, title, category FROM all_product WHERE title IS NOT NULL AND category IS NOT NULL),
t AS (SELECT *, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS x, list_distinct(regexp_extract_all(lower(category), '[a-z0-9]+')) AS y FROM r)
SELECT product_id, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN 1 - len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y)))
+ CASE WHEN substr(trim(lower(title)), 1, 1) <> substr(trim(lower(category)), 1, 1) THEN 0.05 ELSE 0 END ELSE 0 END, 9) AS distance FROM t""")
def title_distance(spark, d):
    rows = table(spark, d, "all_product").where("title is not null and category is not null").select("product_id", "title", "category").distinct()
    return rounded(rows.select("product_id", lexical_distance("title", "category").alias("distance")))


@query(r"""SELECT p_partkey, regexp_replace(p_name, '\b' || split_part(p_name, ' ', 1) || '\b', 'US$5 blue', 'gi') AS title,
len(regexp_extract_all(p_name, '\b' || split_part(p_name, ' ', 1) || '\b', 0, 'i')) AS found FROM part""")
def title_rewrite(spark, d):
    old = F.substring_index("p_name", " ", 1)
    rows = table(spark, d, "part")
    return rows.select("p_partkey", replace_phrase("p_name", old, F.lit("US$5 blue")).alias("title"), mentions("p_name", old).cast("bigint").alias("found"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'black|navy|charcoal') THEN 'dark' WHEN regexp_matches(lower(p_name), 'red|orange|yellow|gold|brown') THEN 'warm'
WHEN regexp_matches(lower(p_name), 'blue|green|teal|cyan') THEN 'cool' END AS family FROM part""")
def word_family(spark, d):
    return table(spark, d, "part").select("p_partkey", family("p_name", FAMILIES).alias("family"))


@query("""WITH s AS (SELECT p_partkey, (SELECT min(q.p_partkey) FROM part q WHERE q.p_type = p.p_type AND q.p_size = p.p_size AND q.p_brand = p.p_brand AND q.p_partkey <> p.p_partkey) AS a,
(SELECT min(q.p_partkey) FROM part q WHERE q.p_type = p.p_type AND q.p_partkey <> p.p_partkey) AS b FROM part p) SELECT p_partkey, coalesce(a, b) AS donor FROM s""")
def donor_choice(spark, d):
    return synthesize.nearest_donor(table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_brand"), "p_partkey", "p_type", ["p_size", "p_brand"])


@query("""WITH r AS (SELECT p_partkey, p_type, (row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) % 3 AS k FROM part)
SELECT p_partkey, ['blur', 'low_resolution', 'occlusion'][k + 1] AS subtype FROM r""")
def quality_turns(spark, d):
    return table(spark, d, "part").select("p_partkey", synthesize.turn([F.col("p_partkey")], protocol.SUBTYPES, ["p_type"]).alias("subtype"))


@query("""SELECT e AS source_image_ids, count(DISTINCT dataset_stage) AS homes FROM (SELECT dataset_stage, unnest(source_image_ids) AS e FROM export_ids)
WHERE e IS NOT NULL AND dataset_stage IS NOT NULL GROUP BY e HAVING count(DISTINCT dataset_stage) > 1""")
def stage_isolation(spark, d):
    return checks.in_several(table(spark, d, "export_ids"), "source_image_ids", "dataset_stage")


@query("SELECT sample_id, count(*) AS n FROM export_ids GROUP BY sample_id HAVING count(*) > 1 OR sample_id IS NULL")
def repeated_ids(spark, d):
    return checks.repeated(table(spark, d, "export_ids"), "sample_id")


@query("""SELECT DISTINCT i AS image_id FROM (SELECT images.main.image_id AS i FROM all_product UNION ALL SELECT unnest(images.detail).image_id FROM all_product
UNION ALL SELECT unnest(source_image_ids) FROM export_ids) WHERE i IS NULL OR i NOT IN (SELECT image_id FROM asset WHERE image_id IS NOT NULL)""")
def missing_assets(spark, d):
    shown = F.concat(F.array("images.main.image_id"), F.transform("images.detail", lambda x: x["image_id"]))
    named = table(spark, d, "all_product").select(F.explode(shown).alias("image_id")).unionByName(table(spark, d, "export_ids").select(F.explode("source_image_ids").alias("image_id")))
    return checks.missing(named, "image_id", table(spark, d, "asset"))


@query("""SELECT image_id, count(DISTINCT sha256) AS n FROM asset GROUP BY image_id HAVING count(DISTINCT sha256) > 1""")
def conflicting_hashes(spark, d):
    return checks.conflicting(table(spark, d, "asset"), "image_id", "sha256")


@query("""SELECT sha256, count(DISTINCT image_id) AS n FROM asset GROUP BY sha256 HAVING count(DISTINCT image_id) > 1""")
def copied_contents(spark, d):
    return checks.conflicting(table(spark, d, "asset"), "sha256", "image_id")


@query("""SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS only_lang FROM
(SELECT source, trim(lang) AS lang FROM documents WHERE length(trim(lang)) BETWEEN 1 AND 5 UNION ALL SELECT source, NULL FROM documents) GROUP BY source""")
def one_language(spark, d):
    rows = table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return rows.select("source", one_value("langs", 5).alias("only_lang"))


@query("""WITH p AS (SELECT DISTINCT product_id, coalesce(title, 'N/A') AS t, coalesce(category, 'N/A') AS c, coalesce(color, 'N/A') AS k, coalesce(material, 'N/A') AS m FROM all_product)
SELECT product_id, 'title: ' || t || chr(10) || 'category: ' || c || chr(10) || 'color: ' || k || chr(10) || 'material: ' || m || chr(10) || chr(10) || 'Judge the record.' AS prompt FROM p""")
def prompts(spark, d):
    rows = table(spark, d, "all_product").select("product_id", "title", "category", "color", "material").distinct()
    return rows.select("product_id", protocol.prompt("Judge the record.").alias("prompt"))


@query("""SELECT event_id, (json_keys(props) = ['k']) AS exact FROM events""")
def json_contract(spark, d):
    return table(spark, d, "events").select("event_id", (F.json_object_keys("props") == F.array(F.lit("k"))).alias("exact"))


@query("""SELECT sample_id, max_by(split, export_batch) AS split, max(export_batch) AS export_batch FROM export_ids GROUP BY sample_id""")
def last_delivery(spark, d):
    rows = table(spark, d, "export_ids").select("sample_id", "export_batch", "split")
    return evaluate.last_predictions(rows, "sample_id", "export_batch").select("sample_id", "split", "export_batch")


@query("""WITH n AS (SELECT source_product_id, count(DISTINCT product_id) AS n FROM all_product GROUP BY ALL) SELECT n AS samples, count(*) AS products FROM n GROUP BY n""")
def samples_per_product(spark, d):
    return evaluate.size_histogram(table(spark, d, "all_product"), "source_product_id", "product_id").toDF("samples", "products")


@query("""SELECT source_product_id, count(DISTINCT image_id) AS images, string_agg(DISTINCT image_id, ',' ORDER BY image_id) AS image_ids FROM asset GROUP BY source_product_id""")
def picture_rollup(spark, d):
    each = evaluate.members_per_group(table(spark, d, "asset"), "source_product_id", "image_id")
    return each.select("source_product_id", F.col("n").alias("images"), F.when(F.col("n") > 0, F.array_join("members", ",")).alias("image_ids"))


@query("""SELECT p_partkey, 'product_' || lpad(row_number() OVER (ORDER BY p_partkey)::VARCHAR, 4, '0') AS name FROM part ORDER BY p_partkey LIMIT 100""")
def first_products(spark, d):
    top = split.first_by(table(spark, d, "part").select("p_partkey"), ["p_partkey"], 100)
    return top.select("p_partkey", F.concat(F.lit("product_"), F.lpad(F.col("number").cast("string"), 4, "0")).alias("name"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begin, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def hourly_events(spark, d):
    return rounded(windowed(table(spark, d, "events"), "ts", "event_type", "value"), 6)


@query(f"""SELECT image_id, round({HASH.format("image_id")}, 12) AS u, substr(sha256(image_id), 1, 16) AS h FROM (SELECT DISTINCT image_id FROM asset)""")
def stable_hashes(spark, d):
    return table(spark, d, "asset").select("image_id").distinct().select("image_id", F.round(fraction("image_id"), 12).alias("u"), hex16("image_id").alias("h"))


@query("""SELECT product_id, len(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))) AS words FROM (SELECT DISTINCT product_id, title FROM all_product WHERE title IS NOT NULL)""")
def title_words(spark, d):
    rows = table(spark, d, "all_product").where("title is not null").select("product_id", "title").distinct()
    return rows.select("product_id", F.size(token_set("title")).cast("bigint").alias("words"))


@query("""SELECT user_id, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events""")
def shifted_mask(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


def packing_components(spark, d):
    """(component_id, n, strata): a component's strata are the sums over its different rows; n is its number of different members."""
    rows = table(spark, d, "component").where("component_id is not null and member_indices is not null")
    flat = rows.select("component_id", F.explode("member_indices").alias("m")).where("m is not null")
    sizes = flat.groupBy("component_id").agg(F.count_distinct("m").alias("n"))
    once = rows.select("component_id", "strata", F.array_sort(F.array_distinct("member_indices")).alias("m")).select("component_id", F.array_sort(F.map_entries("strata")).alias("e"), "m").distinct()
    each = once.select("component_id", F.explode("e").alias("e")).where("e.value > 0").groupBy("component_id", "e.key").agg(F.sum("e.value").alias("value"))
    counts = each.groupBy("component_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("strata"))
    return sizes.join(counts, "component_id", "left").select("component_id", "n", "strata")


@query()
def exact_packing(spark, d):
    counts = packing_components(spark, d)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return split.packed(counts, {"train": total - total // 5, "test": total // 5})


@query("""WITH c AS (SELECT component_id, count(DISTINCT m) AS n FROM (SELECT component_id, unnest(member_indices) AS m FROM component WHERE component_id IS NOT NULL) WHERE m IS NOT NULL GROUP BY component_id),
t AS (SELECT sum(n)::BIGINT AS t, count(*) AS c FROM c) SELECT 'train' AS target, t - t // 5 AS members, c AS components FROM t UNION ALL SELECT 'test', t // 5, c FROM t""")
def packing_sizes(spark, d):
    """Members of each target of the packing, which must be exact, and all components that it placed."""
    placed = exact_packing(spark, d).join(packing_components(spark, d).select("component_id", "n"), "component_id")
    sizes = placed.groupBy("target").agg(F.sum("n").alias("members"))
    return beside(sizes, placed.agg(F.count_distinct("component_id").alias("components")))
