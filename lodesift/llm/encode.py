"""Encoding of texts with a public byte-level tokenizer.

Arrow batches go through tiktoken with a local rank file.  Long texts are cut where the pre-splitting pattern
always starts a new piece, before white space that follows a visible character, so the parts' ids joined are the
ids of the whole.  Ids decode to raw bytes, so texts come back exactly, including pieces cut inside a character.

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text; a repeated
row is encoded again; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.session import table

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pre-splitting pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which a text is cut, and of a part.
LONG, PART = 200_000, 50_000
BOUNDARY = re.compile(r"(?<=\S)(?=\s)")

_encodings: dict = {}


def encoding(ranks: bytes):
    """The tokenizer of a rank file's content; one a worker."""
    import tiktoken

    key = hash(ranks)
    if key not in _encodings:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _encodings[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table_, special_tokens={})
    return _encodings[key]


def parts(text: str, long: int = LONG, part: int = PART) -> Iterator[str]:
    """The text, or parts of at least ``part`` characters that end at safe boundaries."""
    if len(text) <= long:
        yield text
        return
    at = 0
    while at < len(text):
        found = BOUNDARY.search(text, at + part) if len(text) - at > part else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def encode(enc, text: str | None, long: int = LONG, part: int = PART) -> list[int]:
    if not text:
        return []
    if len(text) <= long:
        return enc.encode_ordinary(text)
    return [i for p in parts(text, long, part) for i in enc.encode_ordinary(p)]


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids): the token ids of each row's text.  The rank file, under 2 MB, is broadcast."""
    with open(f"{tokenizers}/{name}.tiktoken", "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for batch in batches:
            ids = [encode(enc, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_ids(rows: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, raw): the bytes that the ids stand for; null ids give null."""
    with open(f"{tokenizers}/{name}.tiktoken", "rb") as f:
        ranks = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for batch in batches:
            raw = [None if x is None else enc.decode_bytes(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [key, "raw"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, ids).mapInArrow(run, f"{key} {kind}, raw binary")


def document_ids(spark, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def byte_counts(spark, sf_dir: str) -> DataFrame:
    """Documents and bytes of each language label, the bytes being those that the ids decode to."""
    docs = table(spark, sf_dir, "documents").withColumn("key", F.to_json(F.struct("doc_id", "lang"), {"ignoreNullFields": "false"}))
    back = decode_ids(encode_texts(docs, "key"), "key").select("key", F.octet_length("raw").cast("bigint").alias("n_bytes"))
    lang = F.get_json_object("key", "$.lang").alias("lang")
    return back.groupBy(lang).agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))


def token_counts(spark, sf_dir: str) -> DataFrame:
    """Documents and tokens of each language label."""
    docs = table(spark, sf_dir, "documents").withColumn("key", F.to_json(F.struct("doc_id", "lang"), {"ignoreNullFields": "false"}))
    ids = encode_texts(docs, "key").select("key", F.size("ids").alias("n"))
    return ids.groupBy(F.get_json_object("key", "$.lang").alias("lang")).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))
