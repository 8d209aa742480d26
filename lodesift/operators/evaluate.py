"""Scores of predictions against labelled records.

``pairs`` always has sample_id, decision, violation_type and p_decision, p_violation_type, where a missing or
unreadable prediction has p_decision null and counts as INVALID.  issue_subtype, evidence (the picture reference) and
p_issue_subtype, p_evidence count as null where ``pairs`` lacks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodesift.functions.protocol import PLACES, WITH_EVIDENCE
from lodesift.operators.checks import Violation, repeated, strict
from lodesift.session import beside

INVALID = "INVALID"
DETAILS = ("issue_subtype", "evidence", "p_issue_subtype", "p_evidence")


def paired(gold: DataFrame, predictions: DataFrame, key: str = "sample_id") -> DataFrame:
    """Every labelled record with its prediction; ids of no record are left out."""
    return gold.join(predictions, key, "left")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("decision", F.coalesce("p_decision", F.lit(INVALID)).alias("predicted")).agg(F.count("*").alias("n"))


def macro_f1(counts: DataFrame) -> DataFrame:
    """(label, f1) over all labels expected or predicted, INVALID included; 0 where nothing was right."""
    sides = F.array(
        F.struct(F.col("decision").alias("label"), F.col("n").alias("true_n"), F.lit(0).cast("bigint").alias("pred_n")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("true_n"), F.col("n").alias("pred_n")),
    )
    hit = F.when(F.col("decision") == F.col("predicted"), F.col("n")).otherwise(0)
    each = counts.select(hit.alias("hit"), F.explode(sides).alias("s")).groupBy("s.label").agg((F.sum("hit") / 2).alias("hit"), F.sum(F.col("s.true_n") + F.col("s.pred_n")).alias("both"))
    return each.select("label", F.coalesce(F.try_divide(2 * F.col("hit"), F.col("both")), F.lit(0.0)).alias("f1"))


def type_macro_f1(pairs: DataFrame) -> DataFrame:
    """One row, macro_f1: the mean F1 over all violation types expected or predicted, INVALID included."""
    counts = pairs.groupBy(F.col("violation_type").alias("decision"), F.coalesce("p_violation_type", F.lit(INVALID)).alias("predicted")).agg(F.count("*").alias("n"))
    return macro_f1(counts).agg(F.avg("f1").alias("macro_f1"))


def with_details(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({c: F.lit(None).cast("string") for c in DETAILS if c not in pairs.columns})


def complete() -> Column:
    """Decision and type are right; so is the place of image_quality and wrong_image, and the subtype of image_quality."""
    kind = F.col("violation_type")
    typed = (F.col("decision") == F.col("p_decision")) & (kind == F.col("p_violation_type"))
    placed = F.col("evidence").isin(*PLACES) & (F.col("evidence") == F.col("p_evidence"))
    subtyped = F.col("issue_subtype").eqNullSafe(F.col("p_issue_subtype"))
    return F.coalesce(typed & (~kind.isin(*WITH_EVIDENCE) | F.coalesce(placed, F.lit(False))) & ((kind != "image_quality") | subtyped), F.lit(False))


def exact() -> Column:
    """All four fields of the answer are those of the record."""
    return complete() & F.col("issue_subtype").eqNullSafe(F.col("p_issue_subtype")) & F.col("evidence").eqNullSafe(F.col("p_evidence"))


def rate(hit: Column, of: Column) -> Column:
    """Aggregate: share of the rows that count for which ``hit`` holds; null if none counts."""
    return F.try_divide(F.count_if(of & hit), F.count_if(of))


def report_columns(detail: bool = True) -> list[Column]:
    reject, passed = F.col("decision") == "reject", F.col("decision") == "pass"
    said = F.coalesce("p_decision", F.lit(INVALID))
    right = said == F.col("decision")
    typed = F.coalesce(F.col("violation_type") == F.col("p_violation_type"), F.lit(False))
    every = F.lit(True)
    return [
        F.count("*").alias("n"),
        rate(right, every).alias("decision_accuracy"),
        rate(typed, every).alias("type_accuracy"),
        rate(complete() if detail else right & typed, every).alias("complete_accuracy"),
        rate(said == "reject", reject).alias("detection_rate"),
        rate(said == "pass", reject).alias("miss_rate"),
        rate(said == "reject", passed).alias("false_reject_rate"),
        rate(said == INVALID, every).alias("invalid_rate"),
    ]


def report(pairs: DataFrame, detail: bool = True) -> DataFrame:
    """One row of rates; a rate without a denominator is null.  Without detail, complete is decision and type only."""
    return with_details(pairs).agg(*report_columns(detail))


def risk(counts: DataFrame, priors: dict[str, float], costs: dict[tuple[str, str], float]) -> DataFrame:
    """Expected cost: prior x share of each answer x cost; unlisted answers cost 1, right ones nothing."""
    prior, cost = F.lit(None).cast("double"), F.when(F.col("decision") == F.col("predicted"), 0.0).otherwise(1.0)
    for label, p in priors.items():
        prior = F.when(F.col("decision") == label, p).otherwise(prior)
    for (true, said), c in costs.items():
        cost = F.when((F.col("decision") == true) & (F.col("predicted") == said), c).otherwise(cost)
    each = counts.groupBy("decision").agg(F.sum(F.col("n") * cost).alias("cost"), F.sum("n").alias("n"))
    return each.agg(F.sum(F.col("cost") / F.col("n") * prior).alias("risk"))


def per_class(pairs: DataFrame, by: str = "violation_type", detail: bool = True) -> DataFrame:
    """(by, n, exact, accuracy): answers right in all four fields, without detail in decision and type only."""
    right = exact() if detail else F.col("decision").eqNullSafe(F.col("p_decision")) & F.col("violation_type").eqNullSafe(F.col("p_violation_type"))
    return with_details(pairs).groupBy(by).agg(F.count("*").alias("n"), F.count_if(right).alias("exact"), F.avg(right.cast("int")).alias("accuracy"))


def perception_columns(there: str = "p_there") -> list[Column]:
    seen, kind = F.col(there), F.col("violation_type")
    subtyped = F.col("issue_subtype").eqNullSafe(F.col("p_issue_subtype"))
    placed = F.coalesce(F.col("evidence").isin(*PLACES) & (F.col("evidence") == F.col("p_evidence")), F.lit(False))
    place = rate(placed, seen & kind.isin(*WITH_EVIDENCE))
    names = ("image_ref_accuracy", "evidence_mean_score", "evidence_recall_at_0_5")
    return [rate(subtyped, seen & (kind == "image_quality")).alias("quality_subtype_accuracy"), *[place.alias(n) for n in names]]


def perception(pairs: DataFrame, there: str = "p_there") -> DataFrame:
    """One row: subtype accuracy over image_quality, place accuracy over the types with a place; rows without any prediction do not count.

    there: whether the row has a prediction entry at all; the mean and the recall at one half of a place score of 0 or 1 are its accuracy.
    """
    return with_details(pairs).agg(*perception_columns(there))


def parse_rate(predictions: DataFrame, valid: str, samples: DataFrame | None = None, key: str = "sample_id") -> DataFrame:
    """One row, parse_rate: valid answers of all prediction rows, or of all samples if they are given.

    With samples a prediction id that repeats is an error (one answer a sample).
    """
    if samples is None:
        return predictions.agg(F.coalesce(F.avg(F.coalesce(F.col(valid), F.lit(False)).cast("int")), F.lit(0.0)).alias("parse_rate"))
    strict(repeated(predictions, key), "repeated prediction ids")
    held = samples.select(key).join(predictions.select(key, valid), key, "left")
    return held.agg(F.coalesce(F.avg(F.coalesce(F.col(valid), F.lit(False)).cast("int")), F.lit(0.0)).alias("parse_rate"))


def matched(gold: DataFrame, predictions: DataFrame, key: str = "sample_id") -> int:
    """How many labelled records have a prediction; none at all is an error."""
    n = gold.join(predictions.select(key).distinct(), key, "left_semi").count()
    if not n:
        raise Violation("no prediction belongs to a labelled record")
    return n


def whole_report(pairs: DataFrame, priors: dict[str, float], costs: dict[tuple[str, str], float], valid: str = "p_valid", there: str = "p_there") -> DataFrame:
    """One row with everything: rates, macro-F1 over types, expected cost, perception, parse rate and share of exact answers of all samples."""
    rest = [
        F.avg(F.coalesce(F.col(valid), F.lit(False)).cast("int")).alias("parse_rate"), F.avg((F.coalesce(F.col(valid), F.lit(False)) & exact()).cast("int")).alias("exact_protocol_accuracy"),
    ]
    # one pass for all rates; the counts by type and by decision are passes of their own
    rates = with_details(pairs).agg(*report_columns(), *perception_columns(there), *rest)
    return beside(rates, type_macro_f1(pairs), risk(confusion(pairs), priors, costs))


def counts_by(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(slice, value, n) for each column by itself; null values are left out."""
    parts = F.array(*[F.struct(F.lit(b).alias("slice"), F.col(b).cast("string").alias("value")) for b in by])
    return rows.select(F.explode(parts).alias("s")).where("s.value is not null").groupBy("s.slice", "s.value").agg(F.count("*").alias("n"))


def size_histogram(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(size, groups): how many groups have how many different members."""
    return rows.groupBy(group).agg(F.count_distinct(member).alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def members_per_group(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(group, n, members): number and sorted list of the different members of each group, null ones left out."""
    each = rows.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return each.select(group, F.size("members").cast("bigint").alias("n"), "members")


def metric_means(rows: DataFrame) -> DataFrame:
    """One row with the mean of every number of the rows, at any depth of structs, under its joined names."""

    def leaves(kind, path: str) -> list[str]:
        if kind.typeName() == "struct":
            return [leaf for f in kind.fields for leaf in leaves(f.dataType, f"{path}.{f.name}".lstrip("."))]
        return [path] if kind.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") else []

    return rows.agg(*[F.avg(leaf).alias(leaf.replace(".", "_")) for leaf in leaves(rows.schema, "")])


def slices(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(slice, value, n, accuracy) for each column by itself; null values are left out."""
    right = F.coalesce(F.col("decision") == F.col("p_decision"), F.lit(False)).cast("int")
    parts = F.array(*[F.struct(F.lit(b).alias("slice"), F.col(b).cast("string").alias("value")) for b in by])
    return pairs.select(right.alias("right"), F.explode(parts).alias("s")).where("s.value is not null").groupBy("s.slice", "s.value").agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"))


def last_predictions(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Of repeated predictions of an id the last one by position."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), position).alias("r")).select(key, "r.*")


def variation_distance(rows: DataFrame, category: str, split: str) -> DataFrame:
    """(split, distance): half the sum of differences of the split's shares of categories from those of all rows."""
    cells = rows.groupBy(split, category).agg(F.count("*").alias("n"))
    total = cells.groupBy(category).agg(F.sum("n").alias("all_n"))
    sizes = cells.groupBy(split).agg(F.sum("n").alias("size"))
    whole = rows.count()
    # sum |p - q| over present cells, and q of the categories that the split lacks
    met = cells.join(total, category).join(sizes, split)
    p, q = F.col("n") / F.col("size"), F.col("all_n") / F.lit(whole)
    return met.groupBy(split).agg(((F.sum(F.abs(p - q)) + 1 - F.sum(q)) / 2).alias("distance"))


def zero_variance_groups(rows: DataFrame, group: list[str], metric: str, least: float = 1e-8) -> DataFrame:
    """(group, n, mean, kept): a group is kept if its values differ or it has a single one."""
    each = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"))
    return each.select(*group, "n", "mean", ((F.col("sd") > least) | (F.col("n") == 1)).alias("kept"))


def group_tally(groups: DataFrame) -> DataFrame:
    """One row: groups generated, kept and filtered, and the mean of the filtered groups' means."""
    return groups.agg(F.count("*").alias("generated"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("filtered"), F.avg(F.when(~F.col("kept"), F.col("mean"))).alias("filtered_mean"))


def accumulated_groups(groups: DataFrame, batch: str, key: str, size: int, most: int) -> DataFrame:
    """(update, key): the groups of each training update, collected from batch after batch until ``size`` are kept.

    An update takes the first ``size`` kept groups in the order of batch and key; what is left over is dropped, and the next update begins with the
    next batch.  After ``most`` batches without enough of them an update takes the groups of the last batch, kept or not, ``size`` of them at most.
    groups: batch, key and kept.  Only a count for each batch is looked at one after the other.
    """
    counts = sorted((r[0], r[1]) for r in groups.groupBy(batch).agg(F.count_if("kept").alias("n")).collect())
    chosen, open_, held, update = [], [], 0, 0
    for b, n in counts:
        open_.append(b)
        held += n
        if held >= size or len(open_) >= most:
            chosen += [(o, update, True) for o in open_] if held >= size else [(b, update, False)]
            open_, held, update = [], 0, update + 1
    kind = groups.schema[batch].dataType.simpleString()
    of = groups.sparkSession.createDataFrame(chosen, f"{batch} {kind}, update int, _filtered boolean")
    met = groups.select(batch, key, "kept").join(of, batch).where(F.col("kept") | ~F.col("_filtered"))
    rank = F.row_number().over(Window.partitionBy("update").orderBy(batch, key))
    return met.withColumn("_rank", rank).where(F.col("_rank") <= size).select("update", key)
