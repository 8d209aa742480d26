"""Rows for training and evaluation made of labelled records, and the reading of such rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions import protocol
from lodesift.operators.checks import Violation, strict
from lodesift.session import numbered

STAGES = ("sft", "grpo", "test")
#: Where a row of a reinforcement export comes from and what it trains.
DATA_SOURCE, ABILITY = "vlm_product_audit", "product_audit"
AUDIT = ("changed_field", "title_audit", "wrong_image_audit")


def optional(rows: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def normalized(rows: DataFrame, contents: DataFrame, stage: str, split: str) -> DataFrame:
    """The common form of labelled rows, with the column ``fault`` for what is wrong with a row.

    rows: product_id, images, violation_type and, if there, sample_id, dataset, source_product_id, target_image_ref, issue_subtype,
    title, category, color, material, difficulty and the audit columns.  contents: (image_id, sha256), one row a picture.
    fault: id (neither id), images (not three known pictures), target_image_ref (a type that needs a place lacks one), or the
    answer's own fault; null where nothing is wrong.
    """
    kind = F.col("violation_type")
    place = optional(rows, "target_image_ref")
    name = protocol.sample_name(stage, split, "sample_id" if "sample_id" in rows.columns else None, dataset="dataset" if "dataset" in rows.columns else None)
    out = rows.withColumn("_sample", name).withColumn("_images", protocol.three_images())
    flat = out.select("_sample", F.posexplode("_images").alias("_pos", "image_id")).join(contents, "image_id")
    held = flat.groupBy("_sample").agg(F.array_sort(F.collect_set(F.struct("_pos", F.concat(F.lit("sha256:"), "sha256").alias("id")))).alias("_all"))
    out = out.join(held, "_sample", "left")
    ids = F.transform("_all", lambda x: x["id"])
    source = F.coalesce(F.nullif(optional(rows, "source_product_id"), F.lit("")), F.nullif(F.col("product_id"), F.lit("")), F.col("_sample"))
    evidence = F.when(kind.isin(*protocol.WITH_EVIDENCE), place)
    answer = protocol.target(kind, optional(rows, "issue_subtype"), evidence)
    fault = (
        F.when(F.col("_sample").isNull(), F.lit("id"))
        .when(~F.coalesce(F.size(ids) == 3, F.lit(False)), F.lit("images"))
        .when(kind.isin(*protocol.WITH_EVIDENCE) & ~F.coalesce(place.isin(*protocol.PLACES), F.lit(False)), F.lit("target_image_ref"))
        .otherwise(protocol.answer_fault(answer))
    )
    audit = [c for c in AUDIT if c in rows.columns]
    derived = F.concat(F.lit("sample:"), "_sample")
    lineage = [F.lit(stage).alias("dataset_stage"), F.array(source).alias("source_product_ids"), ids.alias("source_image_ids"), derived.alias("derived_image_id")]
    if audit:
        lineage.append(F.struct(*audit).alias("audit"))
    return out.select(
        F.col("_sample").alias("sample_id"), F.col("_images").alias("images"), derived.alias("derived_image_id"), F.array(source).alias("source_product_ids"), ids.alias("source_image_ids"),
        F.lit(stage).alias("dataset_stage"), F.lit(split).alias("split"), answer["decision"].alias("decision"), kind, answer["issue_subtype"].alias("issue_subtype"),
        evidence.alias("evidence"), place.alias("target_image_ref"), *[optional(rows, c).alias(c) for c in ("title", "category", "color", "material", "difficulty")],
        *audit, F.struct(*lineage).alias("lineage"), answer.alias("answer"), fault.alias("fault"),
    )


def evaluation_rows(rows: DataFrame, split: str = "test") -> DataFrame:
    """Rows to be scored: an explicit decision wins, a missing place is taken from evidence, ids begin with the data set or "test"."""
    kind = F.col("violation_type")
    place, said = optional(rows, "target_image_ref"), optional(rows, "evidence")
    where = F.when(kind.isin(*protocol.WITH_EVIDENCE), F.coalesce(F.when(place.isin(*protocol.PLACES), place), F.when(said.isin(*protocol.PLACES), said)))
    own = F.nullif(optional(rows, "sample_id"), F.lit(""))
    name = F.coalesce(own, F.when(F.col("product_id") != "", F.concat_ws("_", F.coalesce(optional(rows, "dataset"), F.lit("test")), "product_id")))
    answer = protocol.target(kind, optional(rows, "issue_subtype"), where)
    fault = F.when(name.isNull(), F.lit("id")).when(kind.isin(*protocol.WITH_EVIDENCE) & where.isNull(), F.lit("target_image_ref")).otherwise(protocol.answer_fault(answer))
    return rows.select(
        name.alias("sample_id"), F.lit(split).alias("split"), F.coalesce(F.nullif(optional(rows, "decision"), F.lit("")), answer["decision"]).alias("decision"), kind,
        answer["issue_subtype"].alias("issue_subtype"), where.alias("evidence"), F.when(kind.isin(*protocol.WITH_EVIDENCE), where).otherwise(place).alias("target_image_ref"),
        *[optional(rows, c).alias(c) for c in ("title", "category", "color", "material", "difficulty")], fault.alias("fault"),
    )


def prompt_of(instruction: str, images: int) -> Column:
    return protocol.prompt(instruction, images=images)


def sft_rows(samples: DataFrame, instruction: str) -> DataFrame:
    """Supervised rows: a prompt with picture places and the answer as JSON."""
    turns = protocol.chat(prompt_of(instruction, 3), F.col("answer"), ("human", "gpt"), ("from", "value"))
    return samples.select("sample_id", F.lit("sft").alias("dataset_stage"), "split", "images", "lineage", turns.alias("conversations"))


def rl_rows(samples: DataFrame, instruction: str, order: list[str] | None = None) -> DataFrame:
    """Rows for reinforcement with a structured prompt; index is the place in the order, by sample_id unless given."""
    placed = numbered(samples, order or ["sample_id"], "index")
    extra = F.struct(F.lit("grpo").alias("dataset_stage"), F.lit("grpo").alias("training_stage"), F.col("split"), F.col("index"), F.col("sample_id"), F.col("lineage"))
    return placed.select(
        F.lit(DATA_SOURCE).alias("data_source"), protocol.structured_prompt(F.col("images"), prompt_of(instruction, 0)).alias("prompt"), "images", F.lit(ABILITY).alias("ability"),
        F.struct(F.lit("rule").alias("style"), protocol.answer_text(F.col("answer")).alias("ground_truth")).alias("reward_model"), extra.alias("extra_info"),
    )


def messages(rows: DataFrame, instruction: str) -> DataFrame:
    """(messages, images, fault) of supervised rows, checked again; a row with a fault has no messages."""
    turns = F.col("conversations")
    user, reply = F.get(turns, F.lit(0)), F.get(turns, F.lit(1))
    read = protocol.read_answer(reply["value"])
    no = lambda c: ~F.coalesce(c, F.lit(False))
    fault = (
        F.when(no(F.size(turns) == 2), F.lit("turns")).when(no(user["from"] == "human"), F.lit("prompt"))
        .when(no(F.size(protocol.prompt_faults(user["value"], instruction, 3)) == 0), F.lit("prompt"))
        .when(no(reply["from"] == "gpt"), F.lit("answer")).when(no(read["valid"]), F.lit("answer"))
        .when(no((F.size("images") == 3) & ~F.exists("images", lambda x: x.isNull())), F.lit("images"))
    )
    out = rows.withColumn("fault", fault)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    both = F.array(turn("user", user["value"]), turn("assistant", protocol.answer_text(read["data"])))
    return out.select(F.when(F.col("fault").isNull(), both).alias("messages"), "images", "fault")


def limited(rows: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """The first n rows by the order; n must lie between 1 and the number of rows."""
    if n is None:
        return rows
    if n < 1:
        raise Violation("the limit must be positive")
    out = rows.orderBy(*order).limit(n)
    if out.count() < n:
        raise Violation(f"there are fewer than {n} rows")
    return out


def prepared(rows: DataFrame, contents: DataFrame, stage: str, split: str, instruction: str, limit: int | None = None) -> DataFrame:
    """The export of a stage: supervised rows for sft, rows for reinforcement for grpo, rows to be scored for test.

    A row with a fault, and an empty input, is an error.
    """
    if stage not in STAGES:
        raise Violation(f"no stage {stage!r}")
    if rows.isEmpty():
        raise Violation("no rows to export")
    rows = limited(rows, limit, ["product_id"])
    if stage == "test":
        out = evaluation_rows(rows, split)
        strict(out.where("fault is not null").select("sample_id", "fault"), "rows with faults")
        return out.drop("fault")
    out = normalized(rows, contents, stage, split)
    strict(out.where("fault is not null").select("sample_id", "fault"), "rows with faults")
    return sft_rows(out, instruction) if stage == "sft" else rl_rows(out, instruction)


def lineage(stage: str = "dataset_stage", products: str = "source_product_ids", images: str = "source_image_ids", derived: str = "derived_image_id") -> Column:
    """Where a sample comes from; null where it names no product, no picture or no derived picture."""
    there = (F.size(F.filter(products, lambda x: x.isNotNull())) > 0) & (F.size(F.filter(images, lambda x: x.isNotNull())) > 0) & (F.col(derived) != "")
    return F.when(F.coalesce(there, F.lit(False)), F.struct(F.col(stage).alias("dataset_stage"), F.col(products).alias("source_product_ids"), F.col(images).alias("source_image_ids"), F.col(derived).alias("derived_image_id")))


def short_enough(rows: DataFrame, size: Column, most: int, drop: bool = True) -> DataFrame:
    """Rows whose prompt is of ``most`` tokens (or characters) at most; with drop=False a longer one is an error instead."""
    long = ~F.coalesce(size <= most, F.lit(False))
    if not drop:
        strict(rows.where(long).select(size.alias("size")), f"prompts longer than {most}")
        return rows
    return rows.where(~long)


def asset_paths(pictures: str, folder: str, role: str = "role", path: str = "high_resolution_path") -> Column:
    """Map of role to path under the folder, of an array of pictures; of a role given twice the last one."""
    entry = F.transform(pictures, lambda p: F.struct(p[role].alias("key"), F.concat(F.lit(f"{folder.rstrip('/')}/"), p[path]).alias("value")))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def base_row(paths: str = "paths") -> list[Column]:
    """The columns that every sample made of a record begins with."""
    at = lambda r: F.struct(F.col(paths)[r].alias("image_id"))
    images = F.struct(at("main").alias("main"), F.array(at("detail:1"), at("detail:2")).alias("detail"))
    return [F.col("product_id").cast("string").alias("product_id"), *[F.col(c) for c in ("title", "category", "color", "material")], images.alias("images")]
