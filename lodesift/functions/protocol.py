"""Prompts, strict answers and targets of judged records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.text import once

#: Fixed values of the answer format.
KEYS = ("decision", "violation_type", "issue_subtype", "evidence")
DECISIONS = ("pass", "reject")
TYPES = ("pass", "duplicate_detail_image", "image_quality", "category_mismatch", "wrong_image", "color_mismatch", "title_mismatch", "material_mismatch")
SUBTYPES = ("blur", "low_resolution", "occlusion")
PLACES = ("main", "detail:1", "detail:2")
WITH_EVIDENCE = ("image_quality", "wrong_image")
ANSWER = ", ".join(f"{k} string" for k in KEYS)
MEMBER = r'"(?:[^"\\]|\\.)*"\s*:\s*(?:"(?:[^"\\]|\\.)*"|null)'
FLAT_OBJECT = rf"^\s*\{{\s*(?:{MEMBER}(?:\s*,\s*{MEMBER})*)?\s*\}}\s*$"


def prompt(instruction: str, fields: tuple[str, ...] = ("title", "category", "color", "material"), images: int = 0) -> Column:
    """Image places, a "key: value" line of each field with N/A for null, an empty line and the instruction."""
    places = [F.lit(f"{p}: <image>") for p in PLACES[:images]]
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit("N/A"))) for f in fields]
    return F.concat_ws("\n", *places, *lines, F.lit(""), F.lit(instruction))


def prompt_faults(text: Column, instruction: str, images: int, fields: tuple[str, ...] = ("title", "category", "color", "material")) -> Column:
    """What a prompt lacks, as an array of names."""
    checks = [F.when(~text.rlike(rf"(?m)^{f}: "), F.lit(f)) for f in fields]
    checks.append(F.when(F.regexp_count(text, F.lit("<image>")) != images, F.lit("images")))
    checks.append(F.when(~text.endswith(instruction), F.lit("instruction")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def answer_fault(a: Column) -> Column:
    """The first rule that an answer struct breaks; null if it breaks none."""
    kind, place = a["violation_type"], a["evidence"]
    return (
        F.when(~F.coalesce(a["decision"].isin(*DECISIONS), F.lit(False)), F.lit("decision"))
        .when(~F.coalesce(kind.isin(*TYPES), F.lit(False)), F.lit("violation_type"))
        .when((a["decision"] == "pass") != (kind == "pass"), F.lit("decision_type"))
        .when(F.when(kind == "image_quality", ~F.coalesce(a["issue_subtype"].isin(*SUBTYPES), F.lit(False))).otherwise(a["issue_subtype"].isNotNull()), F.lit("issue_subtype"))
        .when(F.when(kind.isin(*WITH_EVIDENCE), ~F.coalesce(place.isin(*PLACES), F.lit(False))).otherwise(place.isNotNull()), F.lit("evidence"))
    )


def read_answer(text: str | Column) -> Column:
    """Struct (data, valid) of a strict JSON answer, natively: exactly the four keys, strings or null, all rules kept."""
    t = F.col(text) if isinstance(text, str) else text
    names = F.array(*[F.lit(k) for k in sorted(KEYS)])
    parsed = lambda x: F.struct(F.from_json(x, ANSWER).alias("data"), F.array_sort(F.json_object_keys(x)).alias("keys"))
    judged = lambda p: F.struct(p["data"].alias("data"), (F.coalesce(p["keys"] == names, F.lit(False)) & answer_fault(p["data"]).isNull()).alias("valid"))
    # a text that is no flat object has neither data nor keys
    return once(F.when(F.coalesce(t.rlike(FLAT_OBJECT), F.lit(False)), t), lambda x: once(parsed(x), judged))


def raw_decisions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, is_object, decision) of answers by full JSON parsing, for those the native pattern rejects."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for t in batch[text]:
                try:
                    x = json.loads(t)
                except (TypeError, ValueError):
                    x = None
                d = x.get("decision") if isinstance(x, dict) else None
                found.append((isinstance(x, dict), d if isinstance(d, str) else None))
            yield pd.DataFrame({key: batch[key], "is_object": [a for a, _ in found], "decision": [b for _, b in found]})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, is_object boolean, decision string")


def target(violation_type: str | Column = "violation_type", subtype: str | Column = "issue_subtype", place: str | Column = "target_image_ref", evidence: str | Column | None = None) -> Column:
    """The right answer of a labelled record; a place that is none is taken from ``evidence`` if that is one."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    kind = F.lower(F.trim(c(violation_type)))
    where = c(place)
    if evidence is not None:
        where = F.coalesce(F.when(where.isin(*PLACES), where), F.when(c(evidence).isin(*PLACES), c(evidence)))
    return F.struct(
        F.when(kind == "pass", F.lit("pass")).when(kind.isNotNull(), F.lit("reject")).alias("decision"),
        kind.alias("violation_type"),
        F.when(kind == "image_quality", c(subtype)).alias("issue_subtype"),
        F.when(kind.isin(*WITH_EVIDENCE), where).alias("evidence"),
    )


def answer_text(answer: Column) -> Column:
    """The answer as JSON with all its keys, without spaces."""
    return F.to_json(answer, {"ignoreNullFields": "false"})


def chat(user: Column, answer: Column, roles: tuple[str, str] = ("user", "assistant"), names: tuple[str, str] = ("role", "content")) -> Column:
    """Two turns: the prompt and the answer as JSON with all its keys."""
    turn = lambda role, text: F.struct(F.lit(role).alias(names[0]), text.alias(names[1]))
    return F.array(turn(roles[0], user), turn(roles[1], answer_text(answer)))


#: What stands before each picture of a structured prompt.
PICTURE_LABELS = ("main: ", "\ndetail:1: ", "\ndetail:2: ")


def structured_prompt(images: Column, text: Column) -> Column:
    """One user turn of seven parts: a label and a picture three times, then the prompt."""
    null = F.lit(None).cast("string")
    part = lambda kind, words, image: F.struct(F.lit(kind).alias("type"), words.alias("text"), image.alias("image"))
    parts = []
    for n, label in enumerate(PICTURE_LABELS):
        parts += [part("text", F.lit(label), null), part("image", null, F.get(images, F.lit(n)))]
    return F.array(F.struct(F.lit("user").alias("role"), F.array(*parts, part("text", F.concat(F.lit("\n"), text), null)).alias("content")))


def structured_faults(prompt_: Column, images: Column) -> Column:
    """What a structured prompt lacks, as an array of names: turns, parts, labels, pictures."""
    content = F.get(prompt_, F.lit(0))["content"]
    labels = F.array(*[F.lit(x) for x in PICTURE_LABELS])
    said = F.array(*[F.get(content, F.lit(2 * n))["text"] for n in range(3)])
    shown = F.array(*[F.get(content, F.lit(2 * n + 1))["image"] for n in range(3)])
    checks = [
        F.when(~F.coalesce((F.size(prompt_) == 1) & (F.get(prompt_, F.lit(0))["role"] == "user"), F.lit(False)), F.lit("turns")),
        F.when(~F.coalesce(F.size(content) == 7, F.lit(False)), F.lit("parts")),
        F.when(~F.coalesce(said == labels, F.lit(False)), F.lit("labels")),
        F.when(~F.coalesce((F.size(images) == 3) & (shown == images) & ~F.exists(images, lambda x: x.isNull()), F.lit(False)), F.lit("pictures")),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


#: Keys that no text or structure shown to a model may have.
HIDDEN_KEYS = (
    "sample_id", "source_product_ids", "source_image_ids", "derived_image_id", "lineage", "transform", "transform_params", "changed_fields",
    "reward_model", "ground_truth", "dataset_stage", "split",
)


def shown_hidden_keys(schema, path: str = "") -> list[str]:
    """Paths of a structure's members, at any depth, that have a hidden key."""
    out, kind = [], schema
    while hasattr(kind, "elementType"):
        kind = kind.elementType
    for f in getattr(kind, "fields", []):
        here = f"{path}.{f.name}".lstrip(".")
        out += ([here] if f.name in HIDDEN_KEYS else []) + shown_hidden_keys(f.dataType, here)
    return out


def hidden_keys_in(text: str | Column) -> Column:
    """The hidden keys that begin a line of the text, as "key:"."""
    t = F.col(text) if isinstance(text, str) else text
    found = [F.when(t.rlike(rf"(?m)^\s*{k}\s*:"), F.lit(k)) for k in HIDDEN_KEYS]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def sample_name(stage: str, split: str, sample_id: str | None = "sample_id", product_id: str = "product_id", dataset: str | None = "dataset") -> Column:
    """sample_id, else data set (or stage_split) and product id joined by _; null where both ids lack."""
    own = F.nullif(F.col(sample_id), F.lit("")) if sample_id else F.lit(None).cast("string")
    home = F.coalesce(F.nullif(F.col(dataset), F.lit("")), F.lit(f"{stage}_{split}")) if dataset else F.lit(f"{stage}_{split}")
    return F.coalesce(own, F.when(F.col(product_id) != "", F.concat_ws("_", home, F.col(product_id))))


def three_images(images: str = "images") -> Column:
    """Main and two details of a struct of pictures as an array; null unless there are exactly three."""
    main, detail = F.col(f"{images}.main.image_id"), F.transform(F.col(f"{images}.detail"), lambda d: d["image_id"])
    all_ = F.concat(F.array(main), detail)
    return F.when((F.size(all_) == 3) & ~F.exists(all_, lambda x: x.isNull()), all_)
