"""Text functions: material keys, thread designations, exchange-file numbers, size estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def material_key(raw: Column) -> Column:
    """Lower case, brackets and punctuation as blanks, trimmed, runs of blanks, - and _ as one _."""
    plain = F.regexp_replace(F.lower(raw), r"[()\[\]{}/\\.,;:]+", " ")
    return F.regexp_replace(F.trim(plain), r"[\s\-_]+", "_")


def thread_size(designation: Column) -> Column:
    return F.nullif(F.regexp_extract(designation, r"^M(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def thread_pitch(designation: Column) -> Column:
    return F.nullif(F.regexp_extract(designation, r"^M\d+(?:\.\d+)?x(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def step_number(v: Column) -> Column:
    """Six decimals at most, no trailing zeros, always a point, no negative zero; 0. where not finite."""
    safe = F.when(F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull(), F.lit(0.0)).otherwise(v)
    text = F.regexp_replace(F.format_string("%.6f", safe), "0+$", "")
    return F.when(text == "-0.", "0.").otherwise(text)


def tokens_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.2).cast("long")


def statements(text: Column) -> Column:
    """An exchange file's statements: comments dropped, split at ; outside quotes (a doubled quote is two
    quoted pieces side by side). The pattern takes long runs whole, so long statements need no deep stack."""
    bare = F.regexp_replace(text, r"/\*(?s:.*?)\*/", " ")
    return F.regexp_extract_all(bare, F.lit(r"((?:[^;']+|'[^']*')+);"), 1)


def references(rhs: Column) -> Column:
    return F.regexp_extract_all(rhs, F.lit(r"(#[0-9A-Za-z_]+)"), 1)
