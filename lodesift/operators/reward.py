"""Row-wise scores of answers against targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodesift.operators.checks import strict

#: Weight of each part of a reward, and the gate of answers that should name a place.
WEIGHTS = {"action": 0.30, "type": 0.35, "evidence": 0.20, "subtype": 0.15}
GATE, GATED = 0.3, 0.70


def action_score(true: Column, said: Column, costs: dict[tuple[str, str], float]) -> Column:
    """1 - 2 cost; an unlisted wrong decision costs 1, one that is none scores -1 like it."""
    out = F.when(true == said, 1.0).otherwise(-1.0)
    for (t, s), c in costs.items():
        if not 0 <= c <= 1:
            raise ValueError(f"cost {c} is outside [0, 1]")
        out = F.when((true == t) & (said == s), 1 - 2 * c).otherwise(out)
    return F.coalesce(out, F.lit(-1.0))


def scores(target: Column, data: Column, valid: Column, raw_decision: Column, costs: dict[tuple[str, str], float]) -> Column:
    """Struct of the parts, the weighted mean over those that apply, the gate and the final reward.

    The action is read from the raw decision; the other parts need a valid answer, evidence and subtype also the
    right type.  An answer that should name a place but does not reach GATE there keeps GATED of a positive score.
    """
    kind = target["violation_type"]
    typed = F.coalesce(valid & (data["violation_type"] == kind), F.lit(False))
    place, subtype = F.coalesce(kind.isin("image_quality", "wrong_image"), F.lit(False)), F.coalesce(kind == "image_quality", F.lit(False))
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    parts = {
        "action": (F.lit(True), action_score(target["decision"], raw_decision, costs)),
        "type": (F.lit(True), number(typed)),
        "evidence": (place, number(typed & (data["evidence"] == target["evidence"]))),
        "subtype": (subtype, number(typed & (data["issue_subtype"] == target["issue_subtype"]))),
    }
    weighted, total = F.lit(0.0), F.lit(0.0)
    for name, (applies, score) in parts.items():
        weighted = weighted + F.when(applies, score * WEIGHTS[name]).otherwise(0.0)
        total = total + F.when(applies, F.lit(WEIGHTS[name])).otherwise(0.0)
    before = weighted / total
    gated = place & (parts["evidence"][1] < GATE)
    reward = F.when(gated & (before > 0), before * GATED).otherwise(before)
    return F.struct(*[F.when(a, s).alias(n) for n, (a, s) in parts.items()], before.alias("before"), gated.alias("gated"), reward.alias("reward"))


def value_score(listed: Column, observed: Column, p_listed: Column, p_observed: Column, p_decision: Column, kind: Column, p_kind: Column) -> Column:
    """1 if both values are right, a half for one, 0.3 if only the type of a rejected or reviewed answer is; values in their normal form."""
    right = lambda a, b: F.coalesce(a == b, F.lit(False))
    both = right(listed, p_listed).cast("int") + right(observed, p_observed).cast("int")
    typed = F.coalesce(p_decision.isin("review", "reject"), F.lit(False)) & kind.eqNullSafe(p_kind)
    return F.when(both == 2, 1.0).when(both == 1, 0.5).when(typed, 0.3).otherwise(0.0)


def adapted(rows: DataFrame, scored: str, source: str, valid: str, name: str = "vlm_product_audit") -> DataFrame:
    """The flat floats that a trainer asks for: score, reward_*, evidence_gate_applied, protocol_valid; another source is an error."""
    strict(rows.where(~F.coalesce(F.col(source) == name, F.lit(False))).select(source).distinct(), "unsupported data source")
    parts = [F.col(f"{scored}.{p}").alias(f"reward_{p}") for p in WEIGHTS]
    flags = [F.col(f"{scored}.gated").cast("double").alias("evidence_gate_applied"), F.col(valid).cast("double").alias("protocol_valid")]
    others = [c for c in rows.columns if c not in (scored, source, valid)]
    return rows.select(*others, F.col(f"{scored}.reward").alias("score"), *parts, *flags)


def shifted_losses(tokens: DataFrame, by: str, order: list[str], mask: str, log_probability: str) -> DataFrame:
    """(by, loss, masked_loss): mean loss over all tokens of a sequence, and over those whose predecessor's mask is set; null for an empty mask."""
    kept = F.coalesce(F.lag(mask).over(Window.partitionBy(by).orderBy(*order)), F.lit(0))
    rows = tokens.withColumn("_kept", kept)
    return rows.groupBy(by).agg(F.avg(-F.col(log_probability)).alias("loss"), masked_loss(F.col("_kept"), F.col(log_probability)).alias("masked_loss"))


def whole_losses(losses: DataFrame, by: str) -> DataFrame:
    """The losses of shifted_losses; a sequence whose mask keeps no token is an error."""
    strict(losses.where("masked_loss is null").select(by), "no token is kept")
    return losses


def masked_loss(weight: Column, log_probability: Column) -> Column:
    """Aggregate: mean loss over the tokens that the mask keeps; null for an empty mask."""
    return F.try_divide(F.sum(weight * -log_probability), F.sum(weight))
