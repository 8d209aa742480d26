"""Contracts of record sets; every check returns the rows that break it."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions import protocol


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that several rows have; a null key counts as broken too."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def flat(rows: DataFrame, value: str, *others: str) -> DataFrame:
    """A row for each value of an array column; a scalar column stays as it is."""
    is_array = rows.schema[value].dataType.typeName() == "array"
    return rows.select(*others, F.explode(value).alias(value)) if is_array else rows.select(*others, value)


def in_several(rows: DataFrame, value: str, home: str | list[str]) -> DataFrame:
    """(value, homes): values of an array or scalar column that stand in several homes, such as splits or stages and splits."""
    homes = [home] if isinstance(home, str) else home
    known = F.col(value).isNotNull()
    for h in homes:
        known = known & F.col(h).isNotNull()
    return flat(rows, value, *homes).where(known).groupBy(value).agg(F.count_distinct(*homes).alias("homes")).where("homes > 1")


def outside(rows: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    """(key, column) of rows whose value is not allowed; null is not."""
    return rows.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).select(key, column)


def missing(rows: DataFrame, key: str, there: DataFrame) -> DataFrame:
    """Keys of rows that ``there`` lacks."""
    return rows.select(key).distinct().join(there.select(key), key, "left_anti")


def conflicting(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n) of keys with several values."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def copies(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(sha, first, n): contents that several rows hold, text or bytes, by their SHA-256; null content is none."""
    held = rows.where(F.col(content).isNotNull()).groupBy(F.sha2(content, 256).alias("sha"))
    return held.agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")


def disjoint(left: DataFrame, right: DataFrame, spaces: tuple[str, ...]) -> DataFrame:
    """(space, id): ids that both sides have, in each space of ids (array or scalar columns)."""
    ids = lambda rows, s: flat(rows, s).where(F.col(s).isNotNull()).select(F.lit(s).alias("space"), F.col(s).cast("string").alias("id"))
    every = lambda rows: [ids(rows, s) for s in spaces]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(every(left)).join(union(every(right)), ["space", "id"], "left_semi").distinct()


def isolated(rows: DataFrame, value: str, home: str, homes: tuple[str, ...]) -> DataFrame:
    """(left, right, value): values that stand in both of two homes, for every two of ``homes`` in their order."""
    held = flat(rows, value, home).where(F.col(value).isNotNull() & F.col(home).isin(*homes)).groupBy(value).agg(F.collect_set(home).alias("_in"))
    pairs = F.array(*[F.when(F.array_contains("_in", a) & F.array_contains("_in", b), F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"))) for a, b in combinations(homes, 2)])
    return held.where(F.size("_in") > 1).select(F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p"), value).select("p.left", "p.right", value)


def named_for(path: str, split: str) -> None:
    """An export's name must end with its split."""
    if not path.rstrip("/").rsplit("/", 1)[-1].split(".")[0].endswith(f"_{split}"):
        raise Violation(f"the name of {path} must end with _{split}")


def no(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def lineage_fault(line: str = "lineage") -> Column:
    """What the lineage of a row lacks; null if nothing."""
    c = lambda n: F.col(f"{line}.{n}" if line else n)
    some = lambda n: no(F.size(F.filter(c(n), lambda x: x.isNotNull())) > 0)
    return F.when(some("source_product_ids"), F.lit("source_product_ids")).when(some("source_image_ids"), F.lit("source_image_ids")).when(no(c("derived_image_id") != ""), F.lit("derived_image_id"))


def lineage_faults(rows: DataFrame, key: str = "sample_id", line: str = "lineage") -> DataFrame:
    """(key, fault) of rows whose lineage lacks a part or repeats the derived picture of another row."""
    derived = F.col(f"{line}.derived_image_id" if line else "derived_image_id")
    own = rows.select(key, lineage_fault(line).alias("fault"), derived.alias("_derived"))
    often = own.where(F.coalesce(F.col("_derived") != "", F.lit(False))).groupBy("_derived").agg(F.count("*").alias("_n")).where("_n > 1")
    out = own.join(often, "_derived", "left").select(key, F.coalesce("fault", F.when(F.col("_n") > 1, F.lit("repeated_derived_image_id"))).alias("fault"))
    return out.where("fault is not null")


def sft_faults(rows: DataFrame, split: str, instruction: str) -> DataFrame:
    """(sample_id, fault): the first rule of supervised rows that each faulty row breaks, besides repeated ids."""
    turns = F.col("conversations")
    user, reply = F.get(turns, F.lit(0)), F.get(turns, F.lit(1))
    fault = (
        F.when(no(F.col("sample_id") != ""), F.lit("sample_id")).when(no(F.col("dataset_stage") == "sft"), F.lit("dataset_stage")).when(no(F.col("split") == split), F.lit("split"))
        .when(no((F.size("images") == 3) & ~F.exists("images", lambda x: x.isNull())), F.lit("images")).when(no(F.size(turns) == 2), F.lit("conversations"))
        .when(no(user["from"] == "human") | no(F.size(protocol.prompt_faults(user["value"], instruction, 3)) == 0), F.lit("prompt"))
        .when(no(reply["from"] == "gpt") | no(protocol.read_answer(reply["value"])["valid"]), F.lit("answer")).otherwise(lineage_fault())
    )
    return rows.select("sample_id", fault.alias("fault")).where("fault is not null")


def rl_faults(rows: DataFrame, split: str, instruction: str) -> DataFrame:
    """(sample_id, fault): the first rule of rows for reinforcement that each faulty row breaks, besides repeated ids."""
    info = F.col("extra_info")
    text = F.get(F.get("prompt", F.lit(0))["content"], F.lit(6))["text"]
    fault = (
        F.when(no(info["sample_id"] != ""), F.lit("sample_id")).when(no(info["dataset_stage"] == "grpo"), F.lit("dataset_stage"))
        .when(no(F.col("data_source") == "vlm_product_audit"), F.lit("data_source")).when(no(info["split"] == split), F.lit("split"))
        .when(no(F.size(protocol.structured_faults(F.col("prompt"), F.col("images"))) == 0), F.lit("prompt_images"))
        .when(no(F.size(protocol.prompt_faults(text, instruction, 0)) == 0), F.lit("prompt"))
        .when(no(protocol.read_answer(F.col("reward_model")["ground_truth"])["valid"]), F.lit("answer")).otherwise(lineage_fault("extra_info.lineage"))
    )
    return rows.select(info["sample_id"].alias("sample_id"), fault.alias("fault")).where("fault is not null")


def split_output_faults(rows: DataFrame, product: str, component: str, target: str, contents: str) -> DataFrame:
    """(fault, id): products in several rows, components and picture contents (an array) in several targets."""
    twice = repeated(rows, product).select(F.lit("product").alias("fault"), F.col(product).cast("string").alias("id"))
    crossed = lambda c, name: in_several(rows, c, target).select(F.lit(name).alias("fault"), F.col(c).cast("string").alias("id"))
    return twice.unionByName(crossed(component, "component")).unionByName(crossed(contents, "content"))


def totals(found: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(name, expected, found, right): numbers of a one-row table against the expected ones."""
    each = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(n).cast("bigint").alias("expected"), F.col(k).cast("bigint").alias("found")) for k, n in expected.items()])
    return found.select(F.explode(each).alias("x")).select("x.*").withColumn("right", F.col("expected").eqNullSafe(F.col("found")))


def audit(rows: DataFrame, by: list[str], key: str, values: str) -> DataFrame:
    """(by, rows, ids, values): rows, different keys and different values of an array column of each group."""
    named = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids"))
    held = rows.select(*by, F.explode(values).alias("_v")).groupBy(*by).agg(F.count_distinct("_v").alias("_values"))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in by]
    return named.alias("n").join(held.alias("h"), same, "left").select(*[f"n.{c}" for c in by], "rows", F.col("n.ids").alias("ids"), F.coalesce("_values", F.lit(0)).alias("values"))


def failed(rows: DataFrame, key: str, reason: str, bad: tuple[str, ...] = ("error", "aborted")) -> DataFrame:
    """(key, reason) of rows that stopped for a bad reason, whatever else they hold."""
    return rows.where(F.col(reason).isin(*bad)).select(key, reason)


class Violation(ValueError):
    """A contract is broken; the message names the first rows."""


def strict(broken: DataFrame, what: str, most: int = 5) -> None:
    """Raises with the first broken rows, at most ``most``."""
    first = broken.limit(most).collect()
    if first:
        raise Violation(f"{what}: {[tuple(r) for r in first]}")
