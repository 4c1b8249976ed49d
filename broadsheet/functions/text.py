"""Text functions: fold, split, tokenise, normalise, count."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\u000b"
SENTENCE_BREAK = r"(?<=[.!?])\s+"
TOKEN = r"[\p{L}\p{N}_]+"
NON_ASCII = r"[^\x00-\x7F]"
VISIBLE_ASCII = r"[\x00-\x7F&&[^ \t\n\r\f\x0B]]"

# Plural endings and what replaces them, tried in this order.
SUFFIX_RULES = (("sses", "ss"), ("ies", "y"), ("ss", "ss"), ("us", "us"),
                ("is", "is"), ("s", ""))


def text_of(column: Column) -> Column:
    """Any column as text; a missing value is the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def strip_text(column: Column) -> Column:
    return F.btrim(column, F.lit(WHITESPACE))


@functools.lru_cache(maxsize=1)
def _compatibility_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters with an ASCII remainder after NFKD: to one, to many letters."""
    one, many = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        rest = unicodedata.normalize("NFKD", char)
        rest = rest.encode("ascii", "ignore").decode("ascii")
        if len(rest) == 1:
            one[char] = rest
        elif rest:
            many[char] = rest
    return one, many


def ascii_fold(column: Column) -> Column:
    """NFKD, then drop whatever is not ASCII, in JVM expressions only.

    Decomposition works letter by letter and the marks it splits off are not
    ASCII, so a letter table gives the same text as normalising the whole.
    Letters with a one-letter remainder go through ``translate``; the few that
    grow (ligatures, fractions, ellipsis) are replaced one distinct letter at a
    time, only in texts that have them.
    """
    one, many = _compatibility_forms()
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    growing = F.map_keys(table)
    present = F.array_intersect(
        F.array_distinct(
            F.regexp_extract_all(column, F.lit(NON_ASCII), F.lit(0))), growing)
    widened = F.aggregate(
        present, column,
        lambda text, char: F.replace(text, char, F.element_at(table, char)))
    narrowed = F.translate(widened, "".join(one), "".join(one.values()))
    return (F.when(~column.rlike(NON_ASCII), column)
            .otherwise(F.regexp_replace(narrowed, NON_ASCII, "")))


def has_folded_text(column: Column) -> Column:
    """Whether anything but white space is left after the fold.

    One visible ASCII letter settles it, so nearly no text is folded for this.
    """
    return F.when(column.rlike(VISIBLE_ASCII), True).otherwise(
        strip_text(ascii_fold(column)) != "")


def sentences_of(column: Column) -> Column:
    """Stripped, non-blank sentences in order.

    A sentence ends at white space that follows ``.``, ``!`` or ``?``. The
    split consumes that white space, so stripping the text once is enough.
    """
    stripped = strip_text(column)
    return (F.when(stripped == "", F.array().cast("array<string>"))
            .otherwise(F.split(stripped, SENTENCE_BREAK)))


def tokens_of(column: Column) -> Column:
    """Lower-case tokens in order, repeats kept."""
    return F.regexp_extract_all(F.lower(column), F.lit(TOKEN), F.lit(0))


def token_set(column: Column) -> Column:
    return F.array_distinct(tokens_of(column))


def sql_list(terms) -> str:
    """Terms as a SQL value list. One parse, where a column per term is slow."""
    escaped = (t.replace("\\", "\\\\").replace("'", "\\'") for t in sorted(set(terms)))
    return ", ".join(f"'{term}'" for term in escaped) or "NULL"


def kept_sql(tokens: str, terms) -> str:
    """SQL text: the tokens among ``terms``, found by hash set per token."""
    return f"filter({tokens}, t -> t IN ({sql_list(terms)}))"


def dropped_sql(tokens: str, terms) -> str:
    """SQL text: the tokens not among ``terms``."""
    return f"filter({tokens}, t -> coalesce(t NOT IN ({sql_list(terms)}), true))"


def tokens_sql(text: str) -> str:
    """SQL text of ``tokens_of``, for use inside SQL lambdas."""
    pattern = TOKEN.replace("\\", "\\\\")
    return f"regexp_extract_all(lower({text}), '{pattern}', 0)"


def lemma_by_suffix(token: str) -> str:
    """SQL text: singular by the suffix table; up to three letters stay."""
    cases = " ".join(
        f"WHEN endswith({token}, '{end}') THEN "
        f"concat(left({token}, length({token}) - {len(end)}), '{new}')"
        for end, new in SUFFIX_RULES)
    return f"CASE WHEN length({token}) <= 3 THEN {token} {cases} ELSE {token} END"


def normalized_tokens(text: str, stop_words, lemma=lemma_by_suffix) -> Column:
    """Tokens of column ``text`` without stop words, each as its lemma, in order."""
    kept = dropped_sql(tokens_sql(f"coalesce({text}, '')"), stop_words)
    return F.expr(f"transform({kept}, w -> {lemma('w')})" if lemma else kept)


def word_groups(tokens: Column, longest: int) -> Column:
    """Runs of 1..``longest`` neighbouring tokens as ``array<struct<pos,n,text>>``.

    ``tokens`` should be a plain column, as it is used more than once.
    """
    def runs(n: int) -> Column:
        starts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda token, i: F.struct(
            i.alias("pos"), F.lit(n).alias("n"),
            F.concat_ws(" ", token, *[F.get(tokens, i + k) for k in range(1, n)])
            .alias("text")))
    return F.flatten(F.array(*[runs(n) for n in range(1, longest + 1)]))
