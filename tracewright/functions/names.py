"""Names of maps, recordings and archives."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def _nfkc(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in x.to_pylist()], pa.string())


def normalize_name(name: Column, compatible: bool = False, lower: bool = False) -> Column:
    """Trimmed, with runs of white space as one space; ``compatible`` applies NFKC first."""
    text = _nfkc(name) if compatible else name
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.lower(text) if lower else text


def display_alias(name: Column) -> Column:
    """A name without a trailing author mark like ``-by-x``."""
    return F.trim(F.regexp_replace(name, r"(?i)[\s_-]*by[-_ ].*$", ""))


def name_is_usable(name: Column) -> Column:
    """Whether something other than question marks and blanks is left."""
    return F.length(F.translate(F.coalesce(name, F.lit("")), "? \t", "")) > 0


def filename_time(path: Column) -> Column:
    """The time of 14 digits in a file name, or NULL."""
    return F.try_to_timestamp(F.regexp_extract(path, r"(\d{14})[^/\\]*$", 1), F.lit("yyyyMMddHHmmss"))


def filename_hint(path: Column) -> Column:
    """The part of a file name before its time stamp or extension."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(base, r"\.[^.]*$", ""), r"[\s_-]*\d{14}.*$", ""))


def archive_rank(name: Column) -> Column:
    """Rank of an archive: n for ``data<n>.vfs``, 0 for ``data.vfs``, else -1."""
    digits = F.regexp_extract(F.lower(name), r"^data(\d*)\.vfs$", 1)
    return F.when(F.lower(name).rlike(r"^data\d*\.vfs$"), F.coalesce(digits.try_cast("int"), F.lit(0))).otherwise(-1)


def positive_ids(values: Column) -> Column:
    """The whole numbers above 0 in an array of texts."""
    return F.filter(F.transform(values, lambda v: F.trim(v).try_cast("long")), lambda v: v > 0)
