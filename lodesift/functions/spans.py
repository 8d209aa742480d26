"""Places of the values in a JSON answer, and token masks that follow from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.protocol import KEYS

#: Weight of a field's tokens in a weighted mask; the fields and the form of their values are those of the answer format.
FIELD_WEIGHTS = {"decision": 1.0, "violation_type": 1.5, "issue_subtype": 1.5}


def value_span(text: str | Column, field: str, quoted: bool = False) -> Column:
    """Struct (begin, end) of the first value of the field in the text, from 0, end exclusive; with its quotes if ``quoted``."""
    t = F.col(text) if isinstance(text, str) else text
    value = r'("(?:\\[\s\S]|[^"\\])*"|null)'
    head = F.regexp_extract(t, rf'([\s\S]*?"{field}"\s*:\s*){value}', 1)
    held = F.regexp_extract(t, rf'"{field}"\s*:\s*{value}', 1)
    inner = F.when((held != "null") & (not quoted), F.lit(1)).otherwise(F.lit(0))
    # the shortest head that the field's first match may have
    first = F.regexp_instr(t, F.lit(rf'"{field}"\s*:\s*{value}'))
    begin = F.length(head)
    return F.when(first > 0, F.struct((begin + inner).alias("begin"), (begin + F.length(held) - inner).alias("end")))


def spans_of(text: str, fields: dict[str, float], quoted: bool = False) -> list[tuple[int, int, float]]:
    """(begin, end, weight) of every field's first value."""
    out = []
    for field, weight in fields.items():
        found = re.search(rf'"{field}"\s*:\s*(?:("(?:\\.|[^"\\])*")|null)', text, re.DOTALL)
        if found:
            end = found.end()
            begin = found.start(1) if found.group(1) is not None else end - 4
            inner = 1 if found.group(1) is not None and not quoted else 0
            out.append((begin + inner, end - inner, weight))
    return out


def token_weights(pieces: list[str], fields: dict[str, float] | None = None) -> list[float]:
    """The largest weight of a value that each piece of the text overlaps, 0 for none; without fields a plain mask."""
    spans = spans_of("".join(pieces), fields or dict.fromkeys(KEYS, 1.0), quoted=fields is not None)
    out, at = [], 0
    for p in pieces:
        end = at + len(p)
        out.append(max((w for b, e, w in spans if at < e and end > b), default=0.0))
        at = end
    return out


def masked_pieces(rows: DataFrame, key: str, pieces: str, fields: dict[str, float] | None = None) -> DataFrame:
    """(key, weights): the mask of each row's text, given as the array of its tokens' texts; nulls give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if p is None else token_weights(["" if x is None else x for x in p], fields) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "weights"])

    return rows.select(key, pieces).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, weights array<double>")
