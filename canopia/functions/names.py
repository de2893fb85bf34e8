"""What model files tell by their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def run_name(file: Column) -> dict[str, Column]:
    """``tree`` (prefix), ``tree_number``, ``parameters`` and ``iteration`` of ``<prefix>_<tree>-<parameters>-<iteration>.<ext>``; null where a name has no such part."""
    stem = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[A-Za-z]+$", "")
    part = lambda pattern: F.nullif(F.regexp_extract(stem, pattern, 1), F.lit(""))
    return {
        "tree": F.substring_index(stem, "-", 1), "tree_number": part(r"_([0-9]+)-").cast("long"), "parameters": part(r"^[^-]*-(.*)-[^-]*$"),
        "iteration": part(r"-([0-9]+)$").cast("int"),
    }


def tree_number(file: Column) -> Column:
    """Third part of a cloud's file name ``<a>_<b>_<tree>.<ext>``."""
    return F.get(F.split(F.substring_index(F.element_at(F.split(file, "/"), -1), ".", 1), "_"), F.lit(2))


def seconds_of_day(clock: Column) -> Column:
    """``HH:MM:SS`` as seconds; null if it is no such text."""
    p = F.split(clock, ":")
    return F.try_to_number(F.get(p, F.lit(0)), F.lit("99")).cast("long") * 3600 + F.try_to_number(F.get(p, F.lit(1)), F.lit("99")).cast("long") * 60 + F.try_to_number(F.get(p, F.lit(2)), F.lit("99")).cast("long")


def minutes_seconds(seconds: Column) -> tuple[Column, Column]:
    return F.floor(seconds / 60).cast("long"), seconds - F.floor(seconds / 60) * 60


def without_suffix(file: Column, suffix: str | None = None) -> Column:
    """A name without ``suffix``, or without its last ``.ending`` if none is given; other names stay."""
    return F.regexp_replace(file, r"\.[^./]*$", "") if suffix is None else F.when(F.endswith(file, F.lit(suffix)), F.substr(file, F.lit(1), F.length(file) - len(suffix))).otherwise(file)


def with_suffix(file: Column, suffix: str) -> Column:
    """A name that ends in ``suffix``, once."""
    return F.when(F.endswith(file, F.lit(suffix)), file).otherwise(F.concat(file, F.lit(suffix)))
