"""Technique names found in article text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.functions import text as X
from broadsheet.functions.fields import has_items
from broadsheet.functions.text import text_of
from broadsheet.operators.entities import found_phrases

# Bytes of patterns in one automaton. A built one takes some hundred times as much.
AUTOMATON_BYTES = 1 << 20


def usable_techniques(names) -> list[str]:
    return [name for name in names if name.lower() != C.EXCLUDED_TECHNIQUE]


def _present(names, test) -> Column:
    """The names whose test holds, in list order, as one array column.

    A CASE per name inside one array stays in generated code and shares the
    lower-cased text; a lambda over the list would lower it once per name.
    """
    found = [F.when(test(name), F.lit(name)) for name in names]
    if not found:
        return F.array().cast("array<string>")
    return F.array_except(F.array(*found), F.array(F.lit(None).cast("string")))


def detect_techniques(articles: DataFrame, names, text: str = "content",
                      output: str = "detected_techniques") -> DataFrame:
    """Names that occur anywhere in the text, whatever the case. No shuffle."""
    low = F.lower(text_of(F.col(text)))
    found = _present(usable_techniques(names),
                     lambda name: F.contains(low, F.lit(name.lower())))
    return articles.withColumn(output, found)


def detect_whole_techniques(articles: DataFrame, names, text: str = "content",
                            output: str = "detected_techniques") -> DataFrame:
    """Like ``detect_techniques``, but a name must stand between non-letters.

    Used as a stricter second opinion when judging labels.
    """
    spaced = F.concat(F.lit(" "), F.regexp_replace(
        F.lower(text_of(F.col(text))), r"[^\p{L}\p{N}_]", " "), F.lit(" "))
    found = _present(usable_techniques(names),
                     lambda name: F.contains(spaced, F.lit(f" {name.lower()} ")))
    return articles.withColumn(output, found)


def detect_listed_techniques(articles: DataFrame, names: DataFrame,
                             text: str = "content") -> DataFrame:
    """``article_id, technique`` for names that are a table of any length.

    ``names`` has ``technique``. A name is found where its words stand side by
    side, whatever the case and the marks between them. The runs of neighbouring
    words of an article are joined on the name, so nothing is written into the
    plan and no text moves; runs are as long as the longest name.
    """
    words = X.tokens_of(F.col("technique"))
    wanted = names.select("technique", F.array_join(words, " ").alias("text"),
                          F.size(words).alias("words")).where("words > 0")
    wanted = wanted.where(F.lower("technique") != C.EXCLUDED_TECHNIQUE)
    longest = wanted.agg(F.max("words")).first()[0] or 1
    return found_phrases(articles, wanted, longest, text).select(
        "article_id", "technique").distinct()


def _automata(texts: list[tuple[str, list[str]]]):
    """A map from texts to the names they hold, each text read once."""
    def run(batches):
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for pattern, names in texts:
            automaton.add_word(pattern, (len(pattern), names))
        automaton.make_automaton()
        for batch in batches:
            ids, held = [], []
            for row, text in enumerate(batch.column("low").to_pylist()):
                found = {name for _, (_, names) in automaton.iter(text) for name in names}
                ids += [row] * len(found)
                held += sorted(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("article_id").take(pa.array(ids, pa.int64())),
                 pa.array(held, pa.string())], ["article_id", "technique"])
    return run


def detect_substring_techniques(articles: DataFrame, names: DataFrame, text: str = "content",
                                block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``article_id, technique`` for names of a table that occur anywhere, inside words too.

    ``names`` has ``technique`` and any length. Case is folded on both sides; NULL, the
    empty name and the excluded one are in no text. The names go into automata of at
    most ``block_bytes`` of patterns, sent to the tasks one after the other; each reads a
    text once whatever the number of its names. Nothing is shuffled but the names.
    """
    wanted = names.select("technique", F.lower("technique").alias("low")).where(
        (F.col("low") != C.EXCLUDED_TECHNIQUE) & (F.col("low") != ""))
    wanted = wanted.groupBy("low").agg(F.collect_set("technique").alias("names"))
    size = wanted.agg(F.sum(F.octet_length("low"))).first()[0] or 0
    blocks = 1 if size <= block_bytes else -(-2 * size // block_bytes)
    rows = articles.select("article_id", F.lower(text_of(F.col(text))).alias("low"))
    kind = rows.schema["article_id"].dataType.simpleString()
    found = articles.sparkSession.createDataFrame([], f"article_id {kind}, technique string")
    for block in range(blocks):
        held = wanted.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == block).collect()
        if held:
            found = found.unionByName(rows.mapInArrow(
                _automata(sorted((r.low, sorted(r.names)) for r in held)),
                f"article_id {kind}, technique string"))
    return found


def flag_propaganda(articles: DataFrame,
                    techniques: str = "detected_techniques") -> DataFrame:
    """``is_propaganda``: at least one technique; ``techniques`` as the label."""
    return articles.withColumns({
        "is_propaganda": has_items(F.col(techniques)),
        "techniques": F.col(techniques),
    })

