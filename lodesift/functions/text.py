"""Column expressions on text, and the words of a text for Arrow functions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Outer white space in the sense of Unicode.
OUTER_SPACE = r"(?U)^\s+|\s+$"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it: an expression that is only named is computed at every place."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trimmed(x: str | Column) -> Column:
    """Without outer white space of any kind; null stays null."""
    return F.regexp_replace(col(x), OUTER_SPACE, "")


def plain(x: str | Column) -> Column:
    """Trimmed and in lower case."""
    return F.lower(trimmed(x))


def filled(x: str | Column) -> Column:
    """True where the text is neither null nor blank."""
    return F.coalesce(trimmed(x) != "", F.lit(False))


WORD = re.compile(r"[^\W_]+")
#: Every ASCII character but letters and digits becomes a space.
TO_SPACE = {c: " " for c in range(128) if not chr(c).isalnum()}


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    if not text:
        return []
    low = text.lower()
    return low.translate(TO_SPACE).split() if low.isascii() else WORD.findall(low)


def normalized(x: str | Column) -> Column:
    """Trimmed, folded (sharp s, long s, final sigma and micro sign too) and with single spaces."""
    return F.regexp_replace(F.replace(F.translate(plain(x), "ſςµ", "sσμ"), F.lit("ß"), F.lit("ss")), r"\s+", " ")


def token_set(x: str | Column) -> Column:
    """Distinct runs of a-z and 0-9."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(x)), F.lit("([a-z0-9]+)")))


def lexical_distance(a: str | Column, b: str | Column) -> Column:
    """1 less the share of common tokens, 0.05 more if the first characters differ; 0 if a side has no token."""

    def of(t: Column) -> Column:
        x, y = t["x"], t["y"]
        share = F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))
        first = F.when(t["a"] != t["b"], 0.05).otherwise(0.0)
        return F.when((F.size(x) > 0) & (F.size(y) > 0), 1 - share + first).otherwise(F.lit(0.0))

    first = lambda v: F.substring(normalized(v), 1, 1)
    return once(F.struct(token_set(a).alias("x"), token_set(b).alias("y"), first(a).alias("a"), first(b).alias("b")), of)


def family(x: str | Column, families: dict[str, tuple[str, ...]]) -> Column:
    """The first family, in the given order, one of whose words the text holds."""
    text, out = normalized(x), F.lit(None).cast("string")
    for name, words in reversed(families.items()):
        out = F.when(text.rlike("|".join(map(re.escape, words))), F.lit(name)).otherwise(out)
    return out


def value_distance(a: str | Column, b: str | Column, families: dict[str, tuple[str, ...]]) -> Column:
    """Lexical distance, 2 more for values of different families, a fifth of it for values of the same."""
    parts = F.struct(lexical_distance(a, b).alias("d"), family(a, families).alias("x"), family(b, families).alias("y"))
    return once(parts, lambda p: F.when(p["x"] == p["y"], p["d"] * 0.2).when(p["x"].isNotNull() & p["y"].isNotNull(), p["d"] + 2.0).otherwise(p["d"]))


#: What may stand between the words of a phrase.
BETWEEN = r"(?:[\s_./\\,&:;()+\[\]–—-]+|\s+and\s+)"


def phrase_words(phrase: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(phrase).cast("string")), F.lit("([a-z0-9]+)"))


def phrase_pattern(phrase: str | Column) -> Column:
    """Pattern of the phrase's words, joined by separators or "and", with word bounds, in any letter case."""
    return F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])"), F.array_join(phrase_words(phrase), BETWEEN), F.lit(r"(?![A-Za-z0-9])"))


def literal_replacement(x: str | Column) -> Column:
    """The text as a replacement that stands for itself in regexp_replace."""
    return F.replace(F.replace(col(x), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def replace_phrase(text: str | Column, old: str | Column, new: str | Column) -> Column:
    """Every mention of the phrase replaced; unchanged where the phrase has no words or the new one is the same."""
    has = (F.size(phrase_words(old)) > 0) & (normalized(old) != normalized(new))
    return F.when(has, F.regexp_replace(col(text), phrase_pattern(old), literal_replacement(new))).otherwise(col(text))


def mentions(text: str | Column, phrase: str | Column) -> Column:
    return F.when(F.size(token_set(phrase)) > 0, F.regexp_count(col(text), phrase_pattern(phrase))).otherwise(F.lit(0))


def scattered_mention(text: str | Column, phrase: str | Column, slack: int = 3) -> Column:
    """Whether all words of the phrase stand, in any order, in a window of ``slack`` words more than it has."""

    def of(t: Column) -> Column:
        words, need = t["words"], t["need"]
        n = F.size(need)
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1))
        return (n > 1) & (F.size(words) >= n) & F.exists(starts, lambda i: F.size(F.array_except(need, F.slice(words, i, n + slack))) == 0)

    words = F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z0-9]+)"))
    return once(F.struct(words.alias("words"), token_set(phrase).alias("need")), of)


def one_value(values: str | Column, most: int) -> Column:
    """The only distinct trimmed value of 1 to ``most`` characters; null if there are none or several."""
    fit = F.array_distinct(F.filter(F.transform(col(values), trimmed), lambda x: (F.length(x) > 0) & (F.length(x) <= most)))
    return F.when(F.size(fit) == 1, F.get(fit, F.lit(0)))


def first_value(values: str | Column, most: int) -> Column:
    """The first trimmed value of 1 to ``most`` characters."""
    return F.get(F.filter(F.transform(col(values), trimmed), lambda x: (F.length(x) > 0) & (F.length(x) <= most)), F.lit(0))


def general_number(x: str | Column) -> Column:
    """Six significant digits without trailing zeros, plain between 1e-4 and 1e6."""
    v = col(x).cast("double")
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.abs(v)))).cast("int")
    text = F.format_string("%.10f", F.round(v * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits))
    short = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(v == 0, F.lit("0")).when((F.abs(v) >= 1e-4) & (F.abs(v) < 1e6), short).otherwise(F.format_string("%.5e", v))


def safe_file_name(x: str | Column) -> Column:
    """Characters other than letters, digits, . _ + - replaced by _, with eight hash digits added if any was."""
    safe = F.regexp_replace(col(x), "[^A-Za-z0-9._+-]", "_")
    return F.when(safe == col(x), safe).otherwise(F.concat(safe, F.lit("__"), F.substring(F.sha2(col(x), 256), 1, 8)))


#: Members of a JSON object that hold its reference, in this order.
REFERENCE_KEYS = ("path", "file", "filename", "image_path", "image_id", "id", "value")


def references_in(value: object) -> list[str]:
    """The references that a text, number, list or object holds, at any depth, JSON inside texts included."""
    out: list[str] = []
    waiting = [value]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            x = x.strip()
            if x[:1] in ("[", "{"):
                try:
                    waiting.append(json.loads(x))
                    continue
                except ValueError:
                    pass
            out += [part for part in map(str.strip, re.split("[;|]", x)) if part]
        elif isinstance(x, dict):
            named = next((k for k in REFERENCE_KEYS if k in x), None)
            waiting += [x[named]] if named else reversed(x.values())
        elif isinstance(x, (list, tuple)):
            waiting += reversed(x)
        elif isinstance(x, (int, float)):
            out.append(str(x))
    return out


@F.pandas_udf(ArrayType(StringType()))
def deep_references(x: pd.Series) -> pd.Series:
    return x.map(references_in)


def flat_references(x: str | Column, deep: bool = False) -> Column:
    """Trimmed, non-empty parts of a text delimited by semicolons or pipes; deep also reads JSON lists and objects."""
    if deep:
        return deep_references(col(x))
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), "[;|]"), trimmed), lambda p: p != "")


MEASURE = re.compile(r"([0-9]+(?:\.[0-9]+)?)\s*(mm|cm|m)")


def normal_text(t: str | None) -> str | None:
    """Compatibility form of Unicode, lower case, without separators; a length in centimetres."""
    if t is None:
        return None
    t = (t if t.isascii() else unicodedata.normalize("NFKC", t)).strip().lower()
    length = MEASURE.fullmatch(t)
    if not length:
        return re.sub(r"[\s_\-]+", "", t)
    n, unit = float(length[1]), length[2]
    return f"{n / 10 if unit == 'mm' else n * 100 if unit == 'm' else n:g}cm"


@F.pandas_udf(StringType())
def normal_texts(x: pd.Series) -> pd.Series:
    return x.map(normal_text, na_action="ignore")


def normal_value(x: str | Column, aliases: dict[str, str] | None = None) -> Column:
    """A value for comparison: compatibility form, no separators, lengths in centimetres, aliases replaced.

    Spark has no compatibility form, so this step runs in Arrow batches.
    """
    bare = normal_texts(col(x))
    out = bare
    for short, full in (aliases or {}).items():
        out = F.when(bare == short, F.lit(full)).otherwise(out)
    return out
