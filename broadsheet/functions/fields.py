"""Field helpers: defaults, flags, and flat text for nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import constants as C


def or_unknown(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(C.UNKNOWN))


def entities_text(entities: Column) -> Column:
    """``name (LABEL), name (LABEL)``; nothing for a missing list."""
    each = F.transform(
        entities,
        lambda e: F.concat(e["text"], F.lit(" ("), e["label"], F.lit(")")))
    return F.coalesce(F.array_join(each, ", "), F.lit(""))


def list_text(items: Column) -> Column:
    """Comma text of a list; nothing for a missing list."""
    return F.coalesce(F.array_join(items.cast("array<string>"), ", "), F.lit(""))


def terms_text(terms: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(terms)), ", ")


def biased_text(biased: Column) -> Column:
    """``sentence [term, term] | …`` of the biased-sentence list."""
    return F.array_join(
        F.transform(biased, lambda b: F.concat(
            b["sentence"], F.lit(" ["),
            F.array_join(b["detected_terms"], ", "), F.lit("]"))), " | ")


def json_text(nested: Column) -> Column:
    """Nested column as JSON text, letters outside ASCII kept."""
    return F.coalesce(F.to_json(nested), F.lit("[]"))


def file_stem(title: Column) -> Column:
    name = F.coalesce(title, F.lit(C.EXPORT_FILE_TITLE))
    return F.concat(F.lit("analysis_"), F.replace(name, F.lit(" "), F.lit("_")))


# What file systems refuse in a name; and the characters kept of a name too long for them.
REFUSED = r'[\x00-\x1F\x7F/\\:*?"<>|]'
MOST_BYTES, KEPT_CHARS = 200, 40


def safe_file_name(stem: Column) -> Column:
    """``stem`` as part of a path: refused characters become ``_``; a name that is too
    long keeps its start and a hash of the whole."""
    clean = F.regexp_replace(stem, REFUSED, "_")
    short = F.concat(F.left(clean, F.lit(KEPT_CHARS)), F.lit("-"),
                     F.lower(F.hex(F.xxhash64(stem))))
    return F.when(F.octet_length(clean) <= MOST_BYTES, clean).otherwise(short)


def has_items(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))
