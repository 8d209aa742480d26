"""Deterministic splits, selections and exact-size packing."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodesift.functions.hashing import fraction, hex16
from lodesift.session import Scratch, numbered, ranked


def by_fraction(key: Column, shares: Sequence[tuple[str, float]]) -> Column:
    """The name in whose part of [0, 1) the key's hash falls; the last name takes the rest."""
    if abs(sum(s for _, s in shares) - 1) > 1e-9:
        raise ValueError("the shares must sum to 1")
    value, out, edge = fraction(key), F.lit(shares[-1][0]), 1.0
    for name, share in reversed(shares[:-1]):
        edge = sum(s for _, s in shares[: [n for n, _ in shares].index(name) + 1])
        out = F.when(value < edge, F.lit(name)).otherwise(out)
    return out


def stage(seed: int, component: Column, shares: Sequence[tuple[str, float]]) -> Column:
    return by_fraction(F.concat(F.lit(f"{seed}:dataset-stage:"), component), shares)


def train_or_validation(seed: int, stage_name: Column, component: Column, ratio: float) -> Column:
    value = fraction(F.concat(F.lit(f"{seed}:"), stage_name, F.lit("-split:"), component))
    return F.when(stage_name == "test", F.lit("test")).when(value < ratio, F.lit("validation")).otherwise(F.lit("train"))


def capped_round_robin(rows: DataFrame, group: str, key: str, cap: int, target: int | None = None, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows a group in hash order, taken in turns of the groups, ``target`` of them at most."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(hex16(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    out = rows.withColumn("turn", rank).where(F.col("turn") <= cap)
    if target is None:
        return out
    if out.count() < target:
        raise ValueError(f"fewer than {target} rows within the cap")
    return out.orderBy("turn", hex16(F.concat(F.lit(f"{seed}:"), F.col(group))), group).limit(target)


def pooled_category(rows: DataFrame, category: str, least: int, name: str = "__rare__") -> DataFrame:
    """Column ``pooled``: the category, or ``name`` where fewer than ``least`` rows have it."""
    counts = rows.groupBy(category).agg(F.count("*").alias("_n"))
    return rows.join(counts, category, "left").withColumn("pooled", F.when(F.coalesce("_n", F.lit(0)) < least, F.lit(name)).otherwise(F.col(category))).drop("_n")


def representatives(rows: DataFrame, component: str, size: Column, key: str) -> DataFrame:
    """The row of each component with the largest size, then the smallest key hash; by aggregation, not a window."""
    order = F.struct((-size).alias("s"), hex16(F.col(key).cast("string")).alias("h"), F.col(key).alias("k"))
    return rows.groupBy(component).agg(F.min_by(F.struct(*[c for c in rows.columns if c != component]), order).alias("r")).select(component, "r.*")


def first_seen_groups(rows: DataFrame, group: str, position: str) -> DataFrame:
    """(group, first, place): each group once, with its first position and its place, from 0, among the groups in that order."""
    first = rows.groupBy(group).agg(F.min(position).alias("first"))
    return numbered(first, ["first", group], "place").select(group, "first", "place")


def family_split(seed: int, family: Column, shares: Sequence[tuple[str, float]]) -> Column:
    """The split of a record by its family, which is its component."""
    return by_fraction(F.concat(F.lit(f"{seed}:"), family.cast("string")), shares)


def first_by(rows: DataFrame, order: Sequence[str], n: int, exact: bool = False) -> DataFrame:
    """The first n rows, numbered from 1; with ``exact`` fewer rows are an error."""
    top = rows.orderBy(*order).limit(n)
    if exact and top.count() < n:
        raise ValueError(f"fewer than {n} rows")
    return top.withColumn("number", F.row_number().over(Window.orderBy(*order)))


def shared_out(counts: dict[str, int], n: int, rest: str = "") -> dict[str, int]:
    """n members in the proportions of counts, by largest remainders; all of ``rest`` where there are no counts."""
    counts = {k: c for k, c in counts.items() if c and c > 0}
    total = sum(counts.values())
    if not total:
        return {rest: n}
    out = {k: n * c // total for k, c in counts.items()}
    for k in sorted(counts, key=lambda k: (-(n * counts[k] % total), k))[: n - sum(out.values())]:
        out[k] += 1
    return {k: c for k, c in out.items() if c}


def pack_multiple(components: Sequence[tuple[str, dict[str, int]]], overall: dict[str, int], sizes: dict[str, int], seed: int = 42, attempts: int = 128) -> dict[str, str]:
    """Assigns components of several members whole, the larger ones first, to the target that lacks their strata most among those with room.

    overall: members of each stratum, single ones included, which fill what is left.  Raises if no attempt finds room for all.
    """
    total = sum(sizes.values())
    goal = {t: {k: n * sizes[t] / total for k, n in overall.items()} for t in sizes}
    weight = {c: sum(s.values()) for c, s in components}
    strata = dict(components)
    draw = lambda attempt, *parts: int(hashlib.sha256(":".join([str(seed + attempt), *parts]).encode()).hexdigest()[:12], 16)
    for attempt in range(attempts):
        left = dict(sizes)
        held = {t: dict.fromkeys(overall, 0) for t in sizes}
        out: dict[str, str] = {}
        for c in sorted(strata, key=lambda c: (-weight[c], draw(attempt, "multi-order", c))):
            room = [t for t in sizes if left[t] >= weight[c]]
            if not room:
                break
            need = {t: sum(n * (goal[t][k] - held[t][k]) / (goal[t][k] + 1) for k, n in strata[c].items()) / weight[c] for t in room}
            best = max(room, key=lambda t: (need[t], left[t] / sizes[t], draw(attempt, "multi-target", c, t)))
            out[c] = best
            left[best] -= weight[c]
            for k, n in strata[c].items():
                held[best][k] += n
        if len(out) == len(strata):
            return out
    raise ValueError(f"no exact packing in {attempts} attempts")


def single_quotas(singles: dict[str, int], left: dict[str, int], goals: dict[tuple[str, str], float]) -> dict[tuple[str, str], int]:
    """How many single members of each stratum go to each target: as its goals say, and every target is filled exactly."""
    out, want = {}, {}
    for k, n in sorted(singles.items()):
        share = {t: max(0.0, goals.get((k, t), 0.0)) for t in left}
        if not sum(share.values()):
            share = {t: float(m) for t, m in left.items()}
        whole = sum(share.values())
        want |= {(k, t): n * x / whole for t, x in share.items()}
        out |= {(k, t): int(want[k, t]) for t in share}
        for t in sorted(share, key=lambda t: (out[k, t] - want[k, t], t))[: n - sum(out[k, t] for t in share)]:
            out[k, t] += 1
    over = {t: sum(out[k, t] for k in singles) - m for t, m in left.items()}
    for full in sorted(t for t in over if over[t] > 0):
        for short in sorted(t for t in over if over[t] < 0):
            for k in sorted(singles, key=lambda k: (out[k, full] - want[k, full]) - (out[k, short] - want[k, short]), reverse=True):
                n = max(0, min(over[full], -over[short], out[k, full]))
                out[k, full], out[k, short] = out[k, full] - n, out[k, short] + n
                over[full], over[short] = over[full] - n, over[short] + n
    return out


def packed(components: DataFrame, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """(component_id, target): whole components in targets of exact sizes that keep the strata's shares.

    components: component_id, strata (map of counts) and, where the strata are to be brought to it, n members.  Components of several members are
    packed one after the other by one task, as each choice depends on those before; single members, however many, are dealt to what is left by quotas
    for each stratum.  A total that differs from the sizes', or a component larger than every target, is an error.
    """
    rows = components.select("component_id", "strata", (F.col("n") if "n" in components.columns else F.aggregate(F.map_values("strata"), F.lit(0), lambda a, b: a + b)).cast("bigint").alias("n"))
    scratch = Scratch(components.sparkSession, "packed")
    rows = scratch.write(rows.where("n > 0"), "components")

    def brought(batch: pd.DataFrame) -> pd.DataFrame:
        strata = [shared_out({k: int(v) for k, v in dict(s or {}).items()}, int(n)) for s, n in zip(batch["strata"], batch["n"], strict=True)]
        return batch.assign(strata=strata)

    rows = scratch.write(rows.mapInPandas(lambda batches: map(brought, batches), rows.schema), "brought")
    counts = rows.select(F.explode("strata").alias("k", "m"), (F.col("n") == 1).alias("single")).groupBy("k").agg(F.sum("m").alias("m"), F.sum(F.when(F.col("single"), F.col("m")).otherwise(0)).alias("s")).collect()
    overall, singles = {r["k"]: r["m"] for r in counts}, {r["k"]: r["s"] for r in counts if r["s"]}
    most = rows.agg(F.max("n")).first()[0] or 0
    if sum(overall.values()) != sum(sizes.values()) or most > max(sizes.values()):
        raise ValueError("the components do not fit the sizes")

    def solve(several: pd.DataFrame) -> pd.DataFrame:
        found = pack_multiple([(r.component_id, {k: int(n) for k, n in dict(r.strata).items()}) for r in several.itertuples()], overall, sizes, seed)
        return pd.DataFrame(sorted(found.items()), columns=["component_id", "target"])

    several = rows.where("n > 1")
    placed = scratch.write(several.select("component_id", "strata").groupBy().applyInPandas(solve, "component_id string, target string"), "several")
    held = placed.join(several, "component_id").select("target", F.explode("strata").alias("k", "m")).groupBy("target", "k").agg(F.sum("m").alias("m")).collect()
    left, goals = dict(sizes), {(k, t): n * sizes[t] / max(1, sum(sizes.values())) for k, n in overall.items() for t in sizes}
    for r in held:
        left[r["target"]] -= r["m"]
        goals[r["k"], r["target"]] -= r["m"]
    quotas = single_quotas(singles, left, goals)
    bounds = []
    for k in singles:
        at, edges = 0, []
        for t in sizes:
            at += quotas[k, t]
            edges.append(at)
        bounds.append((k, edges))
    of = components.sparkSession.createDataFrame(bounds, "_k string, _edges array<bigint>")
    ones = ranked(rows.where("n = 1").select("component_id", F.get(F.map_keys("strata"), F.lit(0)).alias("_k")), ["_k"], "component_id", "_rank", seed)
    names = F.array(*[F.lit(t) for t in sizes])
    dealt = ones.join(of, "_k").select("component_id", F.get(names, F.size(F.filter("_edges", lambda e: e <= F.col("_rank")))).alias("target"))
    return placed.unionByName(dealt)
