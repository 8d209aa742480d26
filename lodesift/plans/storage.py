"""Queries that go through files and folders in the scratch folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodesift.functions.text import safe_file_name
from lodesift.plans.registry import query
from lodesift.session import Scratch, table
from lodesift.sources import files, manifests

PART = "p_partkey bigint, p_name string, p_size int"
SELECT = "SELECT p_partkey, p_name, p_size FROM part"


def part(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size")


def place(spark, name: str) -> str:
    return f"{Scratch(spark, name).root}/out"


@query(SELECT)
def json_lines(spark, d):
    """Written with sorted keys and read back."""
    path = place(spark, "lines")
    files.write_lines(part(spark, d), path)
    return files.read_lines(spark, path, PART)


@query(SELECT)
def plain_lines(spark, d):
    path = place(spark, "lines")
    files.write_lines(part(spark, d), path, ordered=False)
    return files.read_lines(spark, path, PART)


@query("SELECT p_partkey, p_name, CASE WHEN p_size < 20 THEN 'train' ELSE 'validation' END AS split FROM part")
def split_folders(spark, d):
    """Written to a folder for each split, the test split staying empty, and read back."""
    path = place(spark, "splits")
    split = F.when(F.col("p_size") < 20, F.lit("train")).otherwise(F.lit("validation"))
    names = ["train", "validation", "test"]
    files.write_splits(part(spark, d).select("p_partkey", "p_name", split.alias("split")), path, "split", names)
    return files.read_splits(spark, path, "split", names, "p_partkey bigint, p_name string, split string")


@query(SELECT)
def csv_table(spark, d):
    path = place(spark, "csv")
    part(spark, d).write.option("header", True).option("compression", "gzip").csv(path)
    return files.read_table(spark, path, PART)


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 20")
def wanted_rows(spark, d):
    return files.read_wanted(part(spark, d), "p_partkey", part(spark, d).where("p_size < 20"))


@query(SELECT)
def appended_rows(spark, d):
    """Two overlapping batches appended; every key is there once."""
    path = place(spark, "log")
    rows = part(spark, d)
    files.append_new(rows.where("p_size < 30"), path, "p_partkey")
    files.append_new(rows.where("p_size > 10").unionByName(rows.where("p_size > 40")), path, "p_partkey")
    return spark.read.schema(rows.schema).parquet(path)


@query(SELECT)
def refreshed_table(spark, d):
    """Written once; the second call finds its source unchanged and leaves other rows unwritten."""
    path, source = place(spark, "table"), place(spark, "source")
    part(spark, d).write.parquet(source)
    first = files.write_parquet_if_changed(part(spark, d), path, source)
    second = files.write_parquet_if_changed(part(spark, d).limit(0), path, source)
    return spark.read.schema(part(spark, d).schema).parquet(path).where(F.lit(first and not second))


@query(SELECT)
def published_folder(spark, d):
    path = place(spark, "published")
    files.publish(spark, path, lambda folder: part(spark, d).write.parquet(folder))
    return spark.read.schema(part(spark, d).schema).parquet(path)


@query("SELECT p_partkey, sha256('{\"p_name\":\"' || p_name || '\",\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || '}') AS hash FROM part")
def canonical_hashes(spark, d):
    return part(spark, d).select("p_partkey", files.canonical_hash("p_size", "p_name", "p_partkey").alias("hash"))


@query(r"""SELECT image_id, CASE WHEN regexp_matches(object_path, '[^A-Za-z0-9._+-]') THEN regexp_replace(object_path, '[^A-Za-z0-9._+-]', '_', 'g') || '__' || substr(sha256(object_path), 1, 8) ELSE object_path END AS name FROM (SELECT DISTINCT image_id, object_path FROM asset)""")
def file_names(spark, d):
    return table(spark, d, "asset").select("image_id", "object_path").distinct().select("image_id", safe_file_name("object_path").alias("name"))


INDEX = r"""a AS (SELECT DISTINCT object_path AS path, lower(object_path) AS low, regexp_extract(lower(object_path), '[^/]*$') AS name FROM asset WHERE regexp_matches(lower(object_path), '\.(jpg|jpeg|png|webp|bmp|tif|tiff)$')),
k AS (SELECT DISTINCT path, key FROM (SELECT path, low AS key FROM a UNION ALL SELECT path, name FROM a UNION ALL SELECT path, regexp_replace(name, '\.[^.]*$', '') FROM a)), i AS (SELECT key, min(path) AS path FROM k GROUP BY key HAVING count(*) = 1)"""


@query(rf"""WITH {INDEX}, r AS (SELECT DISTINCT sample_id, e AS ref, regexp_replace(replace(trim(e), chr(92), '/'), '^[./]+', '') AS c FROM (SELECT sample_id, unnest(source_image_ids) AS e FROM export_ids) WHERE e IS NOT NULL),
n AS (SELECT *, regexp_extract(lower(c), '[^/]*$') AS nm FROM r) SELECT sample_id, ref, coalesce((SELECT min(path) FROM a WHERE path = c), (SELECT path FROM i WHERE key = lower(c)), (SELECT path FROM i WHERE key = nm), (SELECT path FROM i WHERE key = regexp_replace(nm, '\.[^.]*$', ''))) AS resolved FROM n""")
def resolved_pictures(spark, d):
    paths = table(spark, d, "asset").select(F.col("object_path").alias("path"))
    refs = table(spark, d, "export_ids").select("sample_id", F.explode("source_image_ids").alias("ref")).where("ref is not null").distinct()
    return manifests.resolved(refs, "ref", manifests.picture_index(paths), paths)


@query(r"""WITH a AS (SELECT DISTINCT object_path AS p, split_part(object_path, '/', 1) AS f FROM asset WHERE contains(object_path, '/') AND regexp_matches(lower(object_path), '\.(jpg|jpeg|png|webp|bmp|tif|tiff)$')), b AS (SELECT f, count(*) AS n FROM a GROUP BY f)
SELECT f AS source_id, CASE WHEN n = 1 THEN (SELECT min(p) FROM a WHERE a.f = b.f) END AS main, CASE WHEN n = 1 THEN 0 END AS details, CASE WHEN n > 1 THEN 'main' END AS fault FROM b""")
def folder_products(spark, d):
    rows = manifests.folder_products(table(spark, d, "asset").select(F.col("object_path").alias("path")))
    return rows.select("source_id", "main", F.when(F.col("details").isNotNull(), F.size("details")).alias("details"), "fault")


@query("""SELECT 'product_' || lpad((i + 1)::VARCHAR, 4, '0') AS product_id, ['red', 'blue', 'green'][i % 3 + 1] AS color, ['oak', 'tin'][i % 2 + 1] AS material, i // 3 AS cycle FROM range(50) t(i)""")
def generated_products(spark, d):
    return files.generated_products(spark, 50, {"color": ["red", "blue", "green"], "material": ["oak", "tin"]}).drop("generation_seed")
