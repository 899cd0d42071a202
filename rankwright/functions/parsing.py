"""Scalar functions on names, ids and arrays written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _from_json_list(value: Column) -> Column:
    return F.from_json(value, "array<string>", {"allowSingleQuotes": "true"})


def names_from_text(value: Column) -> Column:
    """A list written as JSON, as a Python literal, or with commas; a single name is a list of one; empty ones go."""
    text = F.trim(value)
    listed = F.when(text.startswith("["), F.coalesce(_from_json_list(text), F.array().cast("array<string>")))
    parts = F.coalesce(listed, F.split(text, r"\s*,\s*"))
    return F.coalesce(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def list_or_nothing(value: Column) -> Column:
    """As ``names_from_text`` for text in brackets, an empty list for anything else."""
    text = F.trim(value)
    return F.when(text.startswith("["), names_from_text(value)).otherwise(F.array().cast("array<string>"))


def dict_from_text(value: Column) -> Column:
    """A JSON object as a map of strings, an empty map for anything else."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(F.from_json(value, "map<string,string>", {"allowSingleQuotes": "true"}), empty)


def set_key(features: Column) -> Column:
    """The sorted distinct names."""
    return F.array_sort(F.array_distinct(features))


def variable_number(name: Column) -> Column:
    """7 of var_7; an error for any other name."""
    number = F.regexp_extract(name, r"^var_(\d+)$", 1)
    return F.when(number != "", number.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no variable name: "), name)).cast("int"))


def variable_order(name: Column) -> Column:
    """Sort key: numbers of variables first, then other names."""
    number = F.regexp_extract(name, r"^var_(\d+)$", 1)
    return F.struct(F.when(number != "", number.try_cast("int")).otherwise(1_000_000_000).alias("n"), name.alias("name"))


def paid_sources(features: Column, sources: Column) -> Column:
    """Distinct originals of derived features, in numeric order; ``sources`` maps a derived feature to its originals."""
    found = F.flatten(F.transform(features, lambda f: F.coalesce(F.try_element_at(sources, f), F.array(f))))
    keyed = F.array_sort(F.transform(F.array_distinct(found), variable_order))
    return F.transform(keyed, lambda x: x["name"])


def config_id(prescreen: Column, size: Column, model: Column) -> Column:
    return F.format_string("%s__k_%03d__%s", prescreen, size, model)


def prescreen_of(recipe: Column) -> Column:
    """What stands before the first __k_ of a recipe id."""
    return F.split_part(recipe, F.lit("__k_"), F.lit(1))


def set_name_parts(name: Column) -> Column:
    """struct<base, size> of names like mi_top05; null size for others."""
    base, size = F.regexp_extract(name, r"^(.*)_top(\d+)$", 1), F.regexp_extract(name, r"^(.*)_top(\d+)$", 2)
    return F.struct(F.when(size != "", base).otherwise(name).alias("base"), F.when(size != "", size.try_cast("int")).alias("size"))


def safe_name(name: Column, length: int = 120) -> Column:
    """A file name: runs of other characters become one underscore, none at the ends."""
    return F.left(F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_")), F.lit(length))


def missing_when_empty(value: Column) -> Column:
    """Null for an empty string, else the value."""
    return F.nullif(value, F.lit(""))
