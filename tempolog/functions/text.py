"""Text, number and JSON helpers as column expressions; Arrow functions only where Spark has none."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .binding import once
from .timestamps import blank_to_null

COLOUR_TAG = r"(?i)</?color(?:=[^>]*)?>"
URL = r"(?i)https?://[^\s\"'<>]+"
#: A duration that a source writes for "unknown".
NO_DURATION = 114514.0
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def strip(value: Column) -> Column:
    """Without Unicode white space around it."""
    return F.regexp_replace(value, f"^{_SPACE}|{_SPACE}$", "")


def without_colour_tags(value: Column) -> Column:
    return F.regexp_replace(value, COLOUR_TAG, "")


def clean_name(value: Column) -> Column:
    """A display name without space and quotes around it; null if nothing is left."""
    return blank_to_null(F.regexp_replace(strip(value), "^[\"']+|[\"']+$", ""))


def clean_url(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(value), "^[\"']+|[\"']+$", ""), r"[.,);\]}]+$", "")


def text_or_null(value: Column) -> Column:
    return blank_to_null(strip(value.cast("string")))


def required_text(value: Column, name: str) -> Column:
    """The text, or an error if it is blank."""
    return F.when(text_or_null(value).isNull(), F.raise_error(F.lit(f"{name} must not be empty"))).otherwise(text_or_null(value))


def to_int(value: Column, default: int | None = None) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(default).cast("bigint"))


def to_float(value: Column, default: float | None = None) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default).cast("double"))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def real_duration(seconds: Column) -> Column:
    return F.nullif(seconds, F.lit(NO_DURATION))


def title_parts(value: Column) -> Column:
    """struct(id, name, marker) of a title such as ``12. Name (requester)``: leading number, rest, trailing bracket."""
    def of_rest(rest: Column, marker: Column) -> Column:
        numbered = rest.rlike(r"^\$?\d+(?:\.\s*|\s*:\s*)")
        number = F.when(numbered, F.regexp_extract(rest, r"^\$?(\d+)", 1))
        name = F.when(numbered, strip(F.regexp_replace(rest, r"^\$?\d+(?:\.\s*|\s*:\s*)", ""))).otherwise(rest)
        return F.struct(number.alias("id"), once(name, blank_to_null).alias("name"), marker.alias("marker"))

    def of_text(text: Column) -> Column:
        marked = text.rlike(r"\([^()]*\)\s*$")
        marker = F.when(marked, clean_name(F.regexp_extract(text, r"\(([^()]*)\)\s*$", 1)))
        rest = F.when(marked, strip(F.regexp_replace(text, r"\([^()]*\)\s*$", ""))).otherwise(text)
        return once(rest, lambda r: of_rest(r, marker))

    return once(F.coalesce(clean_name(value), F.lit("")), of_text)


def marker_fields(value: Column) -> Column:
    """struct(id, name) by the other tool's rule: what stands before the first colon, and after it."""
    colon = F.instr(value, ":")
    return F.struct(
        F.when(colon > 0, strip(F.substring_index(value, ":", 1))).alias("id"),
        blank_to_null(F.when(colon > 0, strip(F.substr(value, colon + 1))).otherwise(strip(value))).alias("name"),
    )


def urls_in(value: Column) -> Column:
    """All URLs of a text, cleaned, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(value, F.lit(f"({URL})"), F.lit(1)), clean_url), lambda u: u != ""))


def warning_kind(value: Column) -> Column:
    """Category of a warning of the identity stage."""
    low = F.lower(value)
    return (
        F.when(low.contains("no active room"), "missing-room-context").when(low.contains("after grace window"), "expired-deferred-backfill")
        .when(low.contains("at session end"), "expired-session-end-backfill").when(low.contains("expired mapping"), "expired-lookup")
        .when(low.contains("unpaired"), "unpaired-player-left").otherwise("other")
    )


def overlay_title(title: Column) -> Column:
    """struct(title, series) of ``title | series``."""
    cut = F.split(title, r"\|", 2)
    return F.struct(strip(F.element_at(cut, 1)).alias("title"), blank_to_null(strip(F.try_element_at(cut, F.lit(2)))).alias("series"))


def minutes_seconds(seconds: Column) -> Column:
    """``m:ss``; null and negative values have none."""
    whole = F.floor(seconds)
    return F.when(seconds >= 0, F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0")))


@F.pandas_udf(StringType())
def folded_text(values: pd.Series) -> pd.Series:
    """Compatibility-normalized, case-folded, single-spaced: the key by which music texts are equal."""
    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))


def search_artist(artist: Column) -> Column:
    """The first artist of a list."""
    return strip(F.element_at(F.split(artist, r"(?i)\s*(?:,|/|&|、|;|\bfeat\.?\b|\bft\.?\b)\s*"), 1))


def search_title(title: Column) -> Column:
    """A title for searching: without brackets and what stands in them, single-spaced."""
    bare = F.regexp_replace(title, r"[\(\[（【][^\)\]）】]*[\)\]）】]", " ")
    return strip(F.regexp_replace(bare, r"\s+", " "))
