"""Text of records: clean-up, list fields, and the lines that text-pair scorers read."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it, not only ASCII.
_SPACES = r"(?U)\s+"


def sanitize(value: Column) -> Column:
    """Null and exactly "nan" become empty; white-space runs become one blank; blanks at the ends go."""
    v = value.cast("string")
    return F.when(v.isNull() | (v == "nan"), F.lit("")).otherwise(F.trim(F.regexp_replace(v, _SPACES, " ")))


def strip(value: Column) -> Column:
    """White space of all kinds taken off both ends (``trim`` alone takes blanks only)."""
    return F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")


def list_items(value: Column, separator: str = ",") -> Column:
    """Items of a list in a text field: split, stripped, empty ones dropped; null gives none."""
    parts = F.split(F.coalesce(value.cast("string"), F.lit("")), re.escape(separator))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def record_text(columns: list[str], prefix: str = "", style: str = "training", clean: bool = True) -> Column:
    """A record as one line. ``training``: COL name VAL value, joined by blanks. ``inference``: name : "value", joined by commas, nulls left out."""
    out = []
    for c in columns:
        v = F.col(f"{prefix}{c}")
        v = sanitize(v) if clean else v.cast("string")
        out.append(F.concat(F.lit(f"COL {c} VAL "), v) if style == "training" else F.concat(F.lit(f'{c} : "'), v, F.lit('"')))
    return F.concat_ws(" " if style == "training" else " , ", *out)


def pair_line(left: Column, right: Column, label: Column) -> Column:
    """left TAB right TAB label."""
    return F.concat_ws("\t", left, right, label.cast("string"))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), _SPACES), lambda x: x != ""))
