"""Finding and reading loosely described product folders: manifests, archives, picture folders."""

from __future__ import annotations

import io
import json
import os
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions.text import flat_references, trimmed
from lodesift.sources.files import column_of, read_records

#: Names that columns of a manifest may have, and what a file's name says of its picture.
PRODUCT = ("product_id", "item_id", "listing_id", "source_record_id", "id")
MAIN = ("main_image", "main_image_path", "main_image_id", "primary_image", "primary_image_path", "primary_image_id", "cover_image")
DETAIL = ("detail_images", "detail_image_paths", "detail_image_ids", "other_images", "other_image_paths", "other_image_id", "gallery_images", "additional_images")
PICTURES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
MAIN_NAME = r"(?i)(?:^|[_\-.])(main|primary|cover)(?:$|[_\-.])"
RECORDS = (".csv", ".json", ".jsonl")


def load_config(path: str) -> dict:
    """A JSON or, where a reader for it is installed, YAML document that is a mapping."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        value = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML reader is installed") from e
        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} is not a mapping")
    return value


def columns_score(columns: list[str]) -> int:
    """How well the columns describe products: id 1, main picture 3, details 2."""
    low = {c.lower() for c in columns}
    return sum(points for points, names in ((1, PRODUCT), (3, MAIN), (2, DETAIL)) if low & set(names))


def discover_manifest(spark: SparkSession, folder: str) -> str | None:
    """The one file under a local folder that describes products best, with 4 points at least; a tie is an error."""
    scores: dict[str, int] = {}
    for at, _, names in os.walk(folder):
        for name in sorted(names):
            if name.lower().removesuffix(".gz").endswith(RECORDS):
                path = os.path.join(at, name)
                try:
                    scores[path] = columns_score(read_records(spark, path).columns)
                except Exception:  # noqa: BLE001  an unreadable file is no manifest
                    continue
    best = max(scores.values(), default=0)
    if best < 4:
        return None
    tied = sorted(p for p, s in scores.items() if s == best)
    if len(tied) > 1:
        raise ValueError(f"several manifests are as good: {tied[:10]}")
    return tied[0]


def picture_index(paths: DataFrame, path: str = "path") -> DataFrame:
    """(key, path): every picture by its lower-case path, name and stem; a key that several pictures have names none."""
    p = F.lower(path)
    name = F.substring_index(p, "/", -1)
    keys = F.array_distinct(F.array(p, name, F.regexp_replace(name, r"\.[^.]*$", "")))
    ok = F.lit(False)
    for suffix in PICTURES:
        ok = ok | p.endswith(suffix)
    flat = paths.where(ok).select(F.explode(keys).alias("key"), F.col(path).alias("path")).distinct()
    return flat.groupBy("key").agg(F.min("path").alias("path"), F.count("*").alias("_n")).where("_n = 1").drop("_n")


def clean_reference(ref: str | Column) -> Column:
    """Trimmed, with slashes, without the dots and slashes it begins with."""
    return F.regexp_replace(F.replace(trimmed(ref), F.lit("\\"), F.lit("/")), r"^[./]+", "")


def resolved(references: DataFrame, ref: str, index: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """The references with ``resolved``: the picture of that very path, else of that path, name or stem in any letter case; null for none."""
    clean = references.withColumn("_ref", clean_reference(ref))
    name = F.substring_index(F.lower("_ref"), "/", -1)
    wanted = F.array(F.struct(F.lit(1).alias("p"), F.lower("_ref").alias("key")), F.struct(F.lit(2).alias("p"), name.alias("key")), F.struct(F.lit(3).alias("p"), F.regexp_replace(name, r"\.[^.]*$", "").alias("key")))
    asked = clean.select("_ref").distinct()
    direct = asked.join(paths.select(F.col(path).alias("_ref")).distinct(), "_ref", "left_semi").select("_ref", F.struct(F.lit(0).alias("p"), F.col("_ref").alias("path")).alias("hit"))
    indexed = asked.select("_ref", F.explode(wanted).alias("w")).select("_ref", "w.p", "w.key").join(index, "key").select("_ref", F.struct("p", "path").alias("hit"))
    best = direct.unionByName(indexed).groupBy("_ref").agg(F.min("hit")["path"].alias("resolved"))
    return clean.join(best, "_ref", "left").drop("_ref")


def manifest_products(rows: DataFrame) -> DataFrame:
    """(source_id, main, details, fault) of a manifest's records: fault where the main picture is absent or not the only one."""
    id_, main, detail = (column_of(rows, list(n)) for n in (PRODUCT, MAIN, DETAIL))
    refs = lambda c: flat_references(F.col(c) if rows.schema[c].dataType.typeName() == "string" else F.to_json(F.col(c)), deep=True) if c else F.array().cast("array<string>")
    out = rows.select(trimmed(F.col(id_).cast("string")).alias("source_id") if id_ else F.lit(None).cast("string").alias("source_id"), refs(main).alias("_main"), refs(detail).alias("details"))
    only = F.coalesce(F.size("_main") == 1, F.lit(False))
    return out.select("source_id", F.when(only, F.get("_main", F.lit(0))).alias("main"), F.coalesce("details", F.array().cast("array<string>")).alias("details"), F.when(~only, F.lit("main")).alias("fault"))


def folder_products(paths: DataFrame, root: str = "", path: str = "path") -> DataFrame:
    """(source_id, main, details, fault): one product for each folder under the root, from the pictures' paths.

    The only picture is the main one, else the only one whose name says so; otherwise fault is "main".
    """
    rest = F.substring(F.col(path), len(root) + 1, 1 << 20)
    ok = F.lit(False)
    for suffix in PICTURES:
        ok = ok | F.lower(path).endswith(suffix)
    rows = paths.where(ok & F.col(path).startswith(root) & rest.contains("/")).select(F.substring_index(rest, "/", 1).alias("source_id"), F.col(path).alias("_path")).distinct()
    stem = F.regexp_replace(F.substring_index("_path", "/", -1), r"\.[^.]*$", "")
    rows = rows.withColumn("_main", stem.rlike(MAIN_NAME))
    each = rows.groupBy("source_id").agg(F.count("*").alias("_n"), F.count_if("_main").alias("_m"), F.min(F.struct((~F.col("_main")).alias("later"), "_path"))["_path"].alias("_first"), F.array_sort(F.collect_list("_path")).alias("_all"))
    sure = (F.col("_n") == 1) | (F.col("_m") == 1)
    main = F.when(sure, F.col("_first"))
    return each.select("source_id", main.alias("main"), F.when(sure, F.array_except("_all", F.array("_first"))).alias("details"), F.when(~sure, F.lit("main")).alias("fault"))


def read_archive(spark: SparkSession, path: str, pattern: str = ".json", wanted: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """(member, line): the lines of the members of tar archives, gzipped or not, whose names hold ``pattern``; blank lines are left out.

    wanted: with a JSON member ``key``, only lines whose key it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for content in batch.column("content").to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for member in archive:
                        if not member.isfile() or pattern not in member.name:
                            continue
                        data = archive.extractfile(member).read()
                        text = (gzip.decompress(data) if member.name.endswith(".gz") else data).decode("utf-8-sig")
                        lines = [x for x in text.splitlines() if x.strip()]
                        yield pa.RecordBatch.from_arrays([pa.array([member.name] * len(lines), pa.string()), pa.array(lines, pa.string())], ["member", "line"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "member string, line string")
    if wanted is not None:
        rows = rows.withColumn("_key", F.get_json_object("line", f"$.{key}")).join(wanted.select(F.col(key).cast("string").alias("_key")).distinct(), "_key", "left_semi").drop("_key")
    return rows
