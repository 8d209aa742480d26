"""Queries of evaluation and rewards over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodesift.functions import protocol, spans
from lodesift.functions.hashing import fraction
from lodesift.functions.text import normal_value
from lodesift.operators import checks, evaluate, reward, split
from lodesift.plans.catalog import COSTS, DETAILED, PRIORS, RECORDS, records
from lodesift.plans.exporting import IN
from lodesift.plans.registry import HASH, query, rounded
from lodesift.session import beside, table


def answered(spark, d):
    """The records with the text of their answers, some unreadable and some missing, and what is read from it."""
    u = fraction(F.concat(F.lit("answer:"), "product_id"))
    rows = records(spark, d)
    said = protocol.answer_text(F.struct(*[F.col(f"p_{k}").alias(k) for k in protocol.KEYS]))
    text = F.when(u < 0.05, F.lit("not json")).when(u < 0.1, F.concat(said, F.lit(" x"))).when(u >= 0.12, said)
    rows = rows.withColumn("text", text).withColumn("read", protocol.read_answer("text"))
    return rows.withColumn("valid", F.coalesce("read.valid", F.lit(False)))


def answered_pairs(spark, d):
    """The records with what their valid answers say; all other answers say nothing."""
    rows = answered(spark, d).withColumns({f"p_{k}": F.when(F.col("valid"), F.col(f"read.data.{k}")) for k in protocol.KEYS})
    return rows.withColumn("p_there", F.col("text").isNotNull()).withColumnRenamed("valid", "p_valid")


LITERAL = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
ANSWERS = f"""{RECORDS}, {DETAILED}, a0 AS (SELECT *, {HASH.format("'answer:' || product_id")} AS w, '{{"decision":' || {LITERAL('p_decision')} || ',"violation_type":' || {LITERAL('p_violation_type')} || ',"issue_subtype":' || {LITERAL('p_issue_subtype')} || ',"evidence":' || {LITERAL('p_evidence')} || '}}' AS json FROM rd),
a AS (SELECT *, CASE WHEN w < 0.05 THEN 'not json' WHEN w < 0.1 THEN json || ' x' WHEN w >= 0.12 THEN json END AS text,
CASE WHEN p_violation_type IS NULL THEN 'decision' WHEN p_violation_type NOT IN {IN(protocol.TYPES)} THEN 'violation_type' WHEN p_violation_type = 'image_quality' AND coalesce(p_issue_subtype NOT IN {IN(protocol.SUBTYPES)}, true) THEN 'issue_subtype' END AS rule FROM a0),
v AS (SELECT *, w >= 0.12 AND rule IS NULL AS valid FROM a),
z AS (SELECT product_id, category, violation_type, decision, issue_subtype, evidence, text IS NOT NULL AS there, valid, CASE WHEN valid THEN p_decision END AS p_decision, CASE WHEN valid THEN p_violation_type END AS p_violation_type,
CASE WHEN valid THEN p_issue_subtype END AS p_issue_subtype, CASE WHEN valid THEN p_evidence END AS p_evidence FROM v),
zx AS (SELECT *, coalesce(p_decision, 'INVALID') AS said, coalesce(violation_type = p_violation_type, false) AS typed, coalesce(evidence = p_evidence, false) AS placed, issue_subtype IS NOT DISTINCT FROM p_issue_subtype AS subtyped FROM z),
zy AS (SELECT *, said = decision AND typed AND (violation_type NOT IN ('image_quality', 'wrong_image') OR placed) AND (violation_type <> 'image_quality' OR subtyped) AS complete FROM zx)"""


@query(f"WITH {ANSWERS} SELECT product_id, valid, CASE WHEN w >= 0.12 THEN rule WHEN w < 0.1 THEN 'decision' ELSE 'decision' END AS fault FROM v")
def answer_faults(spark, d):
    return answered(spark, d).select("product_id", "valid", protocol.answer_fault(F.col("read.data")).alias("fault"))


@query(f"""WITH {ANSWERS}, t AS (SELECT violation_type AS a, coalesce(p_violation_type, 'INVALID') AS b FROM zy), l AS (SELECT a AS label FROM t UNION SELECT b FROM t),
f AS (SELECT avg(2.0::DOUBLE * (SELECT count(*) FROM t WHERE a = label AND b = label) / ((SELECT count(*) FROM t WHERE a = label) + (SELECT count(*) FROM t WHERE b = label))) AS f1 FROM l),
e AS (SELECT decision, avg(CASE WHEN said = decision THEN 0.0 WHEN decision = 'pass' AND said = 'reject' THEN 0.75 ELSE 1.0 END) * CASE decision WHEN 'pass' THEN 0.6 ELSE 0.4 END AS risk FROM zy GROUP BY decision)
SELECT count(*) AS n, round(avg((said = decision)::INT), 9) AS decision_accuracy, round(avg(typed::INT), 9) AS type_accuracy, round(avg(complete::INT), 9) AS complete_accuracy, round(avg((said = 'reject')::INT) FILTER (decision = 'reject'), 9) AS detection_rate,
round(avg((said = 'pass')::INT) FILTER (decision = 'reject'), 9) AS miss_rate, round(avg((said = 'reject')::INT) FILTER (decision = 'pass'), 9) AS false_reject_rate, round(avg((said = 'INVALID')::INT), 9) AS invalid_rate,
round((SELECT f1 FROM f), 9) AS macro_f1, round((SELECT sum(risk) FROM e)::DOUBLE, 9) AS risk, round(avg(subtyped::INT) FILTER (there AND violation_type = 'image_quality'), 9) AS quality_subtype_accuracy,
round(avg(placed::INT) FILTER (there AND violation_type IN ('image_quality', 'wrong_image')), 9) AS image_ref_accuracy, round(avg(placed::INT) FILTER (there AND violation_type IN ('image_quality', 'wrong_image')), 9) AS evidence_mean_score,
round(avg(placed::INT) FILTER (there AND violation_type IN ('image_quality', 'wrong_image')), 9) AS evidence_recall_at_0_5, round(avg(valid::INT), 9) AS parse_rate,
round(avg((valid AND complete AND subtyped AND evidence IS NOT DISTINCT FROM p_evidence)::INT), 9) AS exact_protocol_accuracy FROM zy""")
def whole_report(spark, d):
    return rounded(evaluate.whole_report(answered_pairs(spark, d), PRIORS, COSTS))


@query(f"""WITH {ANSWERS} SELECT round(avg(valid::INT) FILTER (text IS NOT NULL), 9) AS of_rows, round(avg(valid::INT), 9) AS of_samples, count(*) FILTER (text IS NOT NULL) AS matched FROM v""")
def parse_rates(spark, d):
    rows = answered(spark, d).select("product_id", "text", "valid")
    given = rows.where("text is not null")
    of_rows = evaluate.parse_rate(given, "valid").toDF("of_rows")
    of_samples = evaluate.parse_rate(given, "valid", rows, "product_id").toDF("of_samples")
    n = evaluate.matched(rows, given, "product_id")
    return rounded(beside(of_rows, of_samples).withColumn("matched", F.lit(n).cast("bigint")))


@query(f"""WITH {RECORDS} SELECT 'category' AS slice, category AS value, count(*) AS n FROM r WHERE category IS NOT NULL GROUP BY category UNION ALL SELECT 'violation_type', violation_type, count(*) FROM r GROUP BY violation_type""")
def slice_counts(spark, d):
    return evaluate.counts_by(records(spark, d), ("category", "violation_type"))


@query("""WITH m AS (SELECT DISTINCT component_id, m FROM (SELECT component_id, unnest(member_indices) AS m FROM component) WHERE m IS NOT NULL), s AS (SELECT component_id, count(*) AS size FROM m GROUP BY component_id)
SELECT size, count(*) AS "groups" FROM s GROUP BY size""")
def size_histogram(spark, d):
    rows = table(spark, d, "component").select("component_id", F.explode("member_indices").alias("m")).where("m is not null")
    return evaluate.size_histogram(rows, "component_id", "m")


@query("""SELECT round(avg(l_quantity), 6) AS train_quantity, round(avg(l_discount), 6) AS train_rates_discount, round(avg(l_tax), 6) AS train_rates_tax, round(avg(l_linenumber), 6) AS line FROM lineitem""")
def metric_means(spark, d):
    rates = F.struct(F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_shipdate").alias("day"))
    rows = table(spark, d, "lineitem").select(F.struct(F.col("l_quantity").alias("quantity"), rates.alias("rates")).alias("train"), F.col("l_linenumber").alias("line"), "l_returnflag")
    return rounded(evaluate.metric_means(rows), 6)


@query(f"""WITH {RECORDS}, {DETAILED}, s AS (SELECT product_id, violation_type IN ('image_quality', 'wrong_image') AS ev, violation_type = 'image_quality' AS su,
CASE WHEN decision = p_decision THEN 1.0 WHEN decision = 'pass' AND p_decision = 'reject' THEN -0.5 ELSE -1.0 END AS a, typed::INT AS t, (typed AND placed)::INT AS e, (typed AND coalesce(issue_subtype = p_issue_subtype, false))::INT AS i, p_decision FROM x),
w AS (SELECT *, ev AND e = 0 AS gated, (0.30 * a + 0.35 * t + CASE WHEN ev THEN 0.20 * e ELSE 0 END + CASE WHEN su THEN 0.15 * i ELSE 0 END) / (0.65 + CASE WHEN ev THEN 0.20 ELSE 0 END + CASE WHEN su THEN 0.15 ELSE 0 END) AS b FROM s)
SELECT product_id, round((CASE WHEN gated AND b > 0 THEN b * 0.70 ELSE b END)::DOUBLE, 9) AS score, round(a::DOUBLE, 9) AS reward_action, t::DOUBLE AS reward_type, CASE WHEN ev THEN e::DOUBLE END AS reward_evidence, CASE WHEN su THEN i::DOUBLE END AS reward_subtype,
gated::INT::DOUBLE AS evidence_gate_applied, (p_decision IS NOT NULL)::INT::DOUBLE AS protocol_valid FROM w""")
def rl_scores(spark, d):
    fields = lambda prefix: F.struct(*[F.col(prefix + c).alias(c) for c in protocol.KEYS])
    valid = F.col("p_decision").isNotNull()
    rows = records(spark, d).select("product_id", reward.scores(fields(""), fields("p_"), valid, F.col("p_decision"), COSTS).alias("s"), valid.alias("v"), F.lit("vlm_product_audit").alias("source"))
    return rounded(reward.adapted(rows, "s", "source", "v"))


BARE = r"regexp_replace(lower(trim({0})), '[\s_-]', '', 'g')"


@query(f"""WITH p AS (SELECT p_partkey AS k, p_brand AS a, p_name AS b, CASE WHEN p_partkey % 3 = 0 THEN upper(replace(p_brand, '#', '# ')) ELSE p_type END AS pa, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') ELSE p_type END AS pb,
CASE WHEN p_partkey % 5 = 0 THEN 'pass' ELSE 'reject' END AS pd, p_size % 2 = 0 AS same FROM part), s AS (SELECT *, ({BARE.format('a')} = {BARE.format('pa')})::INT + ({BARE.format('b')} = {BARE.format('pb')})::INT AS n FROM p)
SELECT k AS p_partkey, (CASE n WHEN 2 THEN 1.0 WHEN 1 THEN 0.5 ELSE CASE WHEN pd = 'reject' AND same THEN 0.3 ELSE 0.0 END END)::DOUBLE AS score FROM s""")
def value_scores(spark, d):
    said = F.when(F.col("p_partkey") % 3 == 0, F.upper(F.replace("p_brand", F.lit("#"), F.lit("# ")))).otherwise(F.col("p_type"))
    seen = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_type"))
    decision = F.when(F.col("p_partkey") % 5 == 0, F.lit("pass")).otherwise(F.lit("reject"))
    kind = F.when(F.col("p_size") % 2 == 0, F.lit("a")).otherwise(F.lit("b"))
    score = reward.value_score(normal_value("p_brand"), normal_value("p_name"), normal_value(said), normal_value(seen), decision, F.lit("a"), kind)
    return table(spark, d, "part").select("p_partkey", score.alias("score"))


def variance_groups(spark, d):
    rows = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), (F.col("event_type") == "purchase").cast("int").alias("x"))
    return evaluate.zero_variance_groups(rows, ["user_id", "day"], "x")


@query("""WITH g AS (SELECT user_id, ts::DATE AS day, avg((event_type = 'purchase')::INT) AS mean, (stddev_pop((event_type = 'purchase')::INT) > 1e-8 OR count(*) = 1) AS kept FROM events GROUP BY ALL)
SELECT count(*) AS "generated", count_if(kept)::BIGINT AS kept, count_if(NOT kept)::BIGINT AS filtered, round(avg(mean) FILTER (NOT kept), 9) AS filtered_mean FROM g""")
def group_tally(spark, d):
    return rounded(evaluate.group_tally(variance_groups(spark, d)))


@query("""WITH RECURSIVE g AS (SELECT user_id, ts::DATE AS day, (stddev_pop((event_type = 'purchase')::INT) > 1e-8 OR count(*) = 1) AS kept FROM events GROUP BY ALL),
c AS (SELECT day, count_if(kept) AS n, row_number() OVER (ORDER BY day) AS i FROM g GROUP BY day),
w(i, update, first, held, done, enough) AS (SELECT 1::BIGINT, 0, 1::BIGINT, n, n >= 150 OR 2 <= 1, n >= 150 FROM c WHERE i = 1
UNION ALL SELECT c.i, CASE WHEN done THEN update + 1 ELSE update END, CASE WHEN done THEN c.i ELSE first END, CASE WHEN done THEN n ELSE held + n END,
  CASE WHEN done THEN n >= 150 ELSE true END, CASE WHEN done THEN n >= 150 ELSE held + n >= 150 END FROM w JOIN c ON c.i = w.i + 1),
u AS (SELECT update, CASE WHEN enough THEN first ELSE i END AS first, i AS last, enough FROM w WHERE done),
m AS (SELECT update, g.user_id, g.day, row_number() OVER (PARTITION BY update ORDER BY g.day, g.user_id) AS r FROM u JOIN c ON c.i BETWEEN u.first AND u.last JOIN g ON g.day = c.day AND (g.kept OR NOT u.enough))
SELECT update, count(*) AS n, sum(user_id)::BIGINT AS users FROM m WHERE r <= 150 GROUP BY update""")
def training_updates(spark, d):
    rows = evaluate.accumulated_groups(variance_groups(spark, d), "day", "user_id", 150, 2)
    return rows.groupBy("update").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'aborted')")
def failed_rollouts(spark, d):
    return checks.failed(table(spark, d, "events"), "event_id", "event_type")


@query("""WITH t AS (SELECT user_id, -value / 100 AS lp, coalesce(lag((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS m FROM events)
SELECT user_id, round(avg(-lp), 9) AS loss, round(sum(m * -lp) / nullif(sum(m), 0), 9) AS masked_loss FROM t GROUP BY user_id""")
def token_losses(spark, d):
    tokens = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").cast("int").alias("m"), (-F.col("value") / 100).alias("lp"))
    return rounded(reward.shifted_losses(tokens, "user_id", ["ts", "event_id"], "m", "lp"))


SPAN = ", ".join(
    f"instr(json, '\"{k}\":') - 1 + {len(k) + 3} + (p_{k} IS NOT NULL)::INT AS {k}_begin, instr(json, '\"{k}\":') - 1 + {len(k) + 3} + (p_{k} IS NOT NULL)::INT + length(coalesce(p_{k}, 'null')) AS {k}_end" for k in protocol.KEYS
)


@query(f"WITH {ANSWERS} SELECT product_id, {SPAN} FROM v")
def answer_spans(spark, d):
    rows = records(spark, d).withColumn("json", protocol.answer_text(F.struct(*[F.col(f"p_{k}").alias(k) for k in protocol.KEYS])))
    held = rows.select("product_id", *[spans.value_span("json", k).alias(k) for k in protocol.KEYS])
    return held.select("product_id", *[F.col(f"{k}.{e}").cast("bigint").alias(f"{k}_{e}") for k in protocol.KEYS for e in ("begin", "end")])


@query(f"""WITH {ANSWERS} SELECT product_id, (length({LITERAL('p_decision')}) + 1.5::DOUBLE * length({LITERAL('p_violation_type')}) + 1.5::DOUBLE * length({LITERAL('p_issue_subtype')}))::DOUBLE AS weighted,
(length(coalesce(p_decision, 'null')) + length(coalesce(p_violation_type, 'null')) + length(coalesce(p_issue_subtype, 'null')) + length(coalesce(p_evidence, 'null')))::DOUBLE AS masked FROM v""")
def token_masks(spark, d):
    """Sums of the weighted and the plain mask over an answer's tokens, here its characters."""
    rows = records(spark, d).select("product_id", F.split(protocol.answer_text(F.struct(*[F.col(f"p_{k}").alias(k) for k in protocol.KEYS])), "").alias("pieces"))
    total = lambda name, fields: spans.masked_pieces(rows, "product_id", "pieces", fields).select("product_id", F.aggregate("weights", F.lit(0.0), lambda a, b: a + b).alias(name))
    return total("weighted", spans.FIELD_WEIGHTS).join(total("masked", None), "product_id")


@query("""SELECT count(*) AS n_rows, count(DISTINCT image_id) AS images, count(*) - count(DISTINCT image_id) AS repeated, count_if(sha256 IS NULL)::BIGINT AS without_hash, count_if(coalesce(width <= 0 OR height <= 0, true))::BIGINT AS odd_sizes, sum(bytes)::BIGINT AS bytes FROM asset""")
def asset_audit(spark, d):
    odd = F.coalesce((F.col("width") <= 0) | (F.col("height") <= 0), F.lit(True))
    return table(spark, d, "asset").agg(
        F.count("*").alias("n_rows"), F.count_distinct("image_id").alias("images"), (F.count("*") - F.count_distinct("image_id")).alias("repeated"), F.count_if(F.col("sha256").isNull()).alias("without_hash"),
        F.count_if(odd).alias("odd_sizes"), F.sum("bytes").alias("bytes"),
    )


@query("""WITH f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id) SELECT user_id, first, row_number() OVER (ORDER BY first, user_id) - 1 AS place FROM f""")
def group_order(spark, d):
    return split.first_seen_groups(table(spark, d, "events"), "user_id", "event_id")


@query(f"""SELECT DISTINCT source_product_id, CASE WHEN {HASH.format("'42:' || source_product_id")} < 0.8 THEN 'train' WHEN {HASH.format("'42:' || source_product_id")} < 0.9 THEN 'validation' ELSE 'test' END AS split FROM all_product WHERE source_product_id IS NOT NULL""")
def family_split(spark, d):
    rows = table(spark, d, "all_product").where("source_product_id is not null").select("source_product_id").distinct()
    return rows.select("source_product_id", split.family_split(42, F.col("source_product_id"), (("train", 0.8), ("validation", 0.1), ("test", 0.1))).alias("split"))
