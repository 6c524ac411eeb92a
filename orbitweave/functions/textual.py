"""File names, numbers in text, and time parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased, with the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1))


def relative_to(path: Column, root: str) -> Column:
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)


def metres(text: Column) -> Column:
    """A number such as ``0.31m``; null if it is none."""
    return F.trim(F.replace(text, F.lit("m"), F.lit(""))).try_cast("double")


def iso(ts: Column) -> Column:
    """ISO form; the fraction is left out if it is zero."""
    micro = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(""))


def decimal_hour(ts: Column) -> Column:
    """Hours and minutes; seconds don't count."""
    return F.hour(ts) + F.minute(ts) / 60.0
