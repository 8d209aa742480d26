"""Rewriting the mentions of an attribute in a title, with an account of what was done."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodesift.functions.text import BETWEEN, col, literal_replacement, normalized, once, phrase_words, scattered_mention, trimmed

#: Names of one and the same value.
ALIASES = {"category": (), "color": (("gray", "grey"), ("navy", "navy blue")), "material": (("aluminum", "aluminium"), ("stainless steel", "stainless-steel"))}


def spellings(field: str, value: str | Column) -> Column:
    """The value and the aliases of its group as arrays of words, those of more words first, then the longer ones."""
    if field not in ALIASES:
        raise ValueError(f"no title attribute: {field}")
    text = trimmed(col(value).cast("string"))
    own = F.array_join(phrase_words(text), " ")
    out = F.when(F.size(phrase_words(text)) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    for group in ALIASES[field]:
        same = own.isin(*{" ".join(g.replace("-", " ").split()) for g in group})
        out = F.when(same, F.array_union(out, F.array(*[F.lit(g) for g in group]))).otherwise(out)
    order = F.array_sort(F.transform(out, lambda s: F.struct((-F.size(phrase_words(s))).alias("n"), (-F.length(s)).alias("m"), F.lower(s).alias("s"))))
    return F.array_distinct(F.transform(order, lambda s: phrase_words(s["s"])))


def attribute_pattern(field: str, value: str | Column) -> Column:
    """Pattern of every spelling with word bounds; null where the value has no words."""
    each = F.transform(spellings(field, value), lambda w: F.concat(F.lit("(?:(?<![A-Za-z0-9])"), F.array_join(w, BETWEEN), F.lit("(?![A-Za-z0-9]))")))
    return F.when(F.size(each) > 0, F.concat(F.lit("(?i)"), F.array_join(each, "|")))


def given(x: str | Column) -> Column:
    return F.coalesce(col(x).cast("string") != "", F.lit(False))


def mutation(title: str | Column, field: str, old: str | Column, new: str | Column) -> Column:
    """Struct: title with every mention of the old value replaced, and how.

    policy is replace_all or no_mention, null with an error: "empty" where a value lacks, "ambiguous" where the old value's
    words stand only in another order.  source_mentions, replaced_mentions and matched_texts account for the mentions.
    """
    empty = F.array().cast("array<string>")

    def of(v: Column) -> Column:
        found, error = v["found"], F.when(v["lacks"], F.lit("empty")).when((F.size(v["found"]) == 0) & v["scattered"], F.lit("ambiguous"))
        policy = F.when(error.isNull(), F.when(F.size(found) > 0, F.lit("replace_all")).otherwise(F.lit("no_mention")))
        n = F.when(error.isNull(), F.size(found))
        changed = F.when(policy == "replace_all", F.regexp_replace(v["t"], v["pattern"], literal_replacement(v["new"]))).otherwise(v["t"])
        return F.struct(
            changed.alias("title"), F.lit(field).alias("field"), v["old"].alias("original"), v["new"].alias("modified"), policy.alias("policy"), n.alias("source_mentions"),
            n.alias("replaced_mentions"), F.when(error.isNull(), found).alias("matched_texts"), error.alias("error"),
        )

    def with_found(v: Column) -> Column:
        found = F.coalesce(F.regexp_extract_all(v["t"], v["pattern"], F.lit(0)), empty)
        names = ("t", "old", "new", "pattern", "lacks", "scattered")
        return once(F.struct(*[v[k].alias(k) for k in names], found.alias("found")), of)

    lacks = ~given(old) | ~given(new)
    parts = [col(title).alias("t"), col(old).cast("string").alias("old"), col(new).cast("string").alias("new"), attribute_pattern(field, old).alias("pattern"), lacks.alias("lacks")]
    return once(F.struct(*parts, F.coalesce(scattered_mention(title, old), F.lit(False)).alias("scattered")), with_found)


def title_eligible(title: str | Column, field: str, value: str | Column) -> Column:
    """Whether the title can take part in a mutation: it mentions the value as it is, or not at all."""
    found = F.coalesce(F.regexp_count(col(title), attribute_pattern(field, value)) > 0, F.lit(False))
    return given(value) & (found | ~F.coalesce(scattered_mention(title, value), F.lit(False)))


def same_or_empty(a: str | Column, b: str | Column) -> Column:
    """Whether two values agree or one of them is null or empty."""
    return ~given(a) | ~given(b) | F.coalesce(normalized(a) == normalized(b), F.lit(False))
