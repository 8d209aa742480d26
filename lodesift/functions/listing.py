"""Columns of raw listings: localized values, measures, precedence and family keys.

A localized value is an array of structs (language_tag, value).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodesift.functions.text import col, general_number, plain, trimmed


def fitting(values: str | Column, locale: str | None, most: int) -> Column:
    """The trimmed values of a language, of 1 to ``most`` characters, in their order."""
    own = F.filter(col(values), lambda v: v["language_tag"] == locale) if locale else col(values)
    return F.filter(F.transform(own, lambda v: trimmed(v["value"])), lambda x: (F.length(x) > 0) & (F.length(x) <= most))


def unique_text(values: str | Column, locale: str | None = None, most: int = 240) -> Column:
    """The only distinct fitting value; null if there are none or several."""
    fit = F.array_distinct(fitting(values, locale, most))
    return F.when(F.size(fit) == 1, F.get(fit, F.lit(0)))


def first_text(values: str | Column, locale: str | None = None, most: int = 240) -> Column:
    return F.get(fitting(values, locale, most), F.lit(0))


def title_of(values: str | Column, locale: str, most: int = 240) -> Column:
    """The only title of the language, else its first, else the first of all."""
    return F.coalesce(unique_text(values, locale, most), first_text(values, locale, most), first_text(values, None, most))


def brand_of(values: str | Column, locale: str, most: int = 80, lenient: bool = False) -> Column:
    """The only brand of the language, else the only one at all; lenient: else the first of the language, then of all."""
    if lenient:
        return title_of(values, locale, most)
    return F.coalesce(unique_text(values, locale, most), unique_text(values, None, most))


def product_type(values: str | Column | None, scalar: str | Column | None = None) -> Column:
    """The only distinct value of a list (array of structs with value), else the trimmed scalar; blank is null."""
    from_list = F.lit(None).cast("string")
    if values is not None:
        own = F.array_distinct(F.transform(col(values), lambda v: trimmed(F.coalesce(v["value"], F.lit("")))))
        from_list = F.when(F.size(own) == 1, F.get(own, F.lit(0)))
        if scalar is None:
            return from_list
        return F.when(col(values).isNotNull(), from_list).otherwise(F.nullif(trimmed(scalar), F.lit("")))
    return F.nullif(trimmed(scalar), F.lit(""))


def measure(value: Column, unit: Column) -> Column:
    """"0.25 in"; null unless both are there."""
    return F.when(value.isNotNull() & (unit != ""), F.concat_ws(" ", general_number(value), unit))


def dimensions(width: Column, length: Column, height: Column) -> Column:
    """Each a struct (value, unit): "W 1 in x L 2 in x H 3 in" without those that are incomplete; null if all are."""
    parts = [F.concat(F.lit(f"{letter} "), measure(m["value"], m["unit"])) for letter, m in (("W", width), ("L", length), ("H", height))]
    text = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), " x ")
    return F.nullif(text, F.lit(""))


def weight(values: str | Column) -> Column:
    """Of an array of structs (value, unit) the only one; null if there are several."""
    only = F.get(col(values), F.lit(0))
    return F.when(F.size(col(values)) == 1, measure(only["value"], only["unit"]))


#: Attributes in the order in which one is taken to be judged.
JUDGED = ("model", "color", "material", "dimensions", "weight", "brand")


def judged_field(attributes: str, names: tuple[str, ...] = JUDGED) -> Column:
    """Name of the first attribute of the struct that is there."""
    return F.coalesce(*[F.when(F.col(f"{attributes}.{n}").isNotNull(), F.lit(n)) for n in names])


def attribute_count(attributes: str, names: tuple[str, ...] = JUDGED) -> Column:
    return F.size(F.filter(F.array(*[F.col(f"{attributes}.{n}").cast("string") for n in names]), lambda x: x.isNotNull()))


def family_key(kind: Column, brand: Column, model: Column, fallback: Column | None = None) -> Column:
    """Struct (kind, brand, model) of a product family; null for models under three and brands under two characters."""
    b, m = plain(brand), plain(model)
    kind = F.coalesce(F.nullif(kind, F.lit("")), fallback) if fallback is not None else kind
    return F.when((F.length(m) >= 3) & (F.length(b) >= 2), F.struct(kind.alias("kind"), b.alias("brand"), m.alias("model")))
