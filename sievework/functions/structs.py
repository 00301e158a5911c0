"""Column functions over JSON, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def widest_json(text: Column) -> Column:
    """The widest {...} span of the text, a code fence stripped; null if there is none."""
    bare = F.regexp_replace(text, r"(?m)^```\w*\s*$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def repaired_ranking(raw: Column, labels: Column) -> Column:
    """Upper-cased first letters, valid ones once each, then the missing labels in order."""
    said = F.transform(raw, lambda x: F.substring(F.upper(F.trim(x)), 1, 1))
    return F.array_union(F.array_intersect(F.array_distinct(said), labels), labels)


def clamped_score(raw: Column, low: int = 0, high: int = 2, default: int = 0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(raw.try_cast("int"), F.lit(default))))


def clamped_grade(raw: Column, low: float = 0.0, high: float = 10.0) -> Column:
    """A grade within bounds; null if it is no number."""
    number = raw.try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), number)))


def renamed_keys(values: Column, names: Column) -> Column:
    """A map with each key replaced by names[key]; keys without a name go."""
    pairs = F.filter(F.map_entries(values), lambda e: F.element_at(names, e["key"]).isNotNull())
    return F.map_from_entries(F.transform(pairs, lambda e: F.struct(F.element_at(names, e["key"]).alias("key"), e["value"].alias("value"))))


def value_or(values: Column, key: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.element_at(values, key), F.lit(default))


def string_list(raw: Column) -> Column:
    """A JSON string or list of strings as a list: trimmed, blanks dropped."""
    many = F.from_json(raw, "array<string>")
    return F.filter(F.transform(F.coalesce(many, F.array(F.trim(raw, F.lit('"')))), lambda x: F.trim(x)), lambda x: x != "")


VERDICT = "truthful boolean, is_truthful boolean, flagged array<struct<claim:string,reason:string>>, violations array<struct<claim:string,reason:string>>"


def verdict(reply: Column) -> Column:
    """struct(truthful, n_flagged, inconclusive) of a judge's reply; failing closed.

    The flagged list is the truth if it is there; else the boolean; without either, or without JSON, it is inconclusive.
    """
    j = F.from_json(widest_json(reply), VERDICT)
    flagged = F.coalesce(j["flagged"], j["violations"])
    said = F.coalesce(j["truthful"], j["is_truthful"])
    inconclusive = flagged.isNull() & said.isNull()
    truthful = F.when(inconclusive, False).when(flagged.isNotNull(), F.size(flagged) == 0).otherwise(said)
    return F.struct(truthful.alias("truthful"), F.coalesce(F.size(flagged), F.lit(0)).alias("n_flagged"), inconclusive.alias("inconclusive"))


def nested_strings(document: Column, paths: tuple[str, ...] = ("$.fen", "$.teacher_input.fen")) -> Column:
    """Strings found at any of the paths of a JSON document, distinct."""
    return F.array_distinct(F.filter(F.array(*[F.get_json_object(document, p) for p in paths]), lambda x: x.isNotNull()))


def aliased(*columns: Column) -> Column:
    """The first alias that is there."""
    return F.coalesce(*columns)
