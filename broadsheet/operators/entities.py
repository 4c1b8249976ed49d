"""Named entities from a gazetteer and from patterns."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as X
from broadsheet.operators.lookup import Lookup, in_bits
from broadsheet.operators.unnest import unnest

# Fixed patterns, written for both Java and RE2.
RULES = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "URL": r"https?://[^\s<>()]+",
    "DATE": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "MONEY": r"[$€£][0-9]+(?:[.,][0-9]+)*",
    "PERCENT": r"\b[0-9]+(?:\.[0-9]+)?%",
    "LONG_NUMBER": r"\b[0-9]{6,}\b",
}


# One article in so many is counted to find the phrases that stand in most places.
COMMON_SAMPLE = 64
# Of those that are sent, 16 added for each.
COMMON_BYTES = 8 << 20
COMMON_BLOCKS = 1 << 12


def _lookups(names: DataFrame) -> tuple[Lookup, Lookup]:
    """Of the first words of ``names(text)``, and of the names."""
    # made once for both lookups, which read them more than once each
    names = names.persist(StorageLevel.DISK_ONLY)
    try:
        return (Lookup.of(names.select(F.substring_index("text", " ", 1).alias("term"))),
                Lookup.of(names.select(F.col("text").alias("term"))))
    finally:
        names.unpersist()


def _phrases(articles: DataFrame, first: Lookup, longest: int, text: str) -> DataFrame:
    """``article_id, pos, text``: the phrases whose first word may start a name."""
    tokens = articles.select(
        "article_id", X.tokens_of(X.text_of(F.col(text))).alias("tokens"))
    # each word with those that follow it, NULL beyond the end of the text
    spans = F.arrays_zip(F.col("tokens").alias("w0"), *[
        F.slice("tokens", F.lit(n + 1), F.greatest(F.size("tokens") - n, F.lit(0)))
        .alias(f"w{n}") for n in range(1, longest)])
    places = unnest(tokens, spans, "article_id", value="at", pos="pos").where(
        first.may_hold(F.col("at.w0")))
    phrases = [F.col("at.w0")]
    for n in range(1, longest):
        phrases.append(F.concat(phrases[-1], F.lit(" "), F.col(f"at.w{n}")))
    return unnest(places, F.array(*phrases), "article_id", "pos", value="text")


def listed_phrases(articles: DataFrame, names: DataFrame, longest: int,
                   text: str = "content") -> tuple[DataFrame, Lookup]:
    """``article_id, pos, text``: the phrases that may be in ``names(text)``, and its lookup.

    Only words that start some name open phrases, and only phrases that may be names are
    kept. Words become rows inside the task, where both tests are compiled code; tests in
    a list are not.
    """
    first, whole = _lookups(names)
    return whole.thin(_phrases(articles, first, longest, text), names, "text"), whole


def found_phrases(articles: DataFrame, names: DataFrame, longest: int,
                  text: str = "content") -> DataFrame:
    """``article_id, pos, text`` of the phrases that are in ``names(text)``, with its columns.

    A list that can be sent is. Of a longer one the names that stand in most places are
    sent, and only places of the others are shuffled. A sample of the articles tells which
    names these are; it decides how a name is looked up, not whether. The texts are then
    read twice, as their words are much more than the rows of a shuffle.
    """
    listed = names.distinct()
    first, whole = _lookups(names)
    phrases = _phrases(articles, first, longest, text)
    if whole.small:
        return whole.join(whole.thin(phrases, listed, "text"), listed, "text")
    chosen = F.pmod(F.xxhash64("article_id"), F.lit(COMMON_SAMPLE)) == 0
    common = _common(_phrases(articles.where(chosen), first, longest, text))
    # by shuffle, as the others are then in place for their join
    marked = listed.where(F.col("text").isNotNull()).join(
        common.withColumn("_common", F.lit(True)).hint("shuffle_hash"), "text", "left")
    own = listed.columns
    sent = marked.where("_common").select(*own)
    others = marked.where("_common IS NULL").select(*own)
    return in_bits(phrases, sent, "text", COMMON_BLOCKS).join(
        F.broadcast(sent), "text").unionByName(
        whole.join(whole.thin(phrases, others, "text"), others, "text"))


def _common(phrases: DataFrame) -> DataFrame:
    """``text``: the most frequent phrases, of some ``COMMON_BYTES`` in all.

    Only the bytes of the phrases of each frequency come to the driver. Of equally frequent
    ones a part is taken by hash, so these are the same ones whenever they are made.
    """
    counts = phrases.groupBy("text").agg(F.least(F.count("*"), F.lit(1000)).alias("n"))
    sizes = counts.groupBy("n").agg(
        F.sum(F.octet_length("text") + 16).alias("bytes")).collect()
    room, least, share = COMMON_BYTES, 0, 0
    for n, size in sorted(sizes, reverse=True):
        if size > room:
            least, share = n, 1024 * room // size
            break
        room -= size
    part = (F.col("n") == least) & (F.pmod(F.xxhash64("text"), F.lit(1024)) < share)
    return counts.where((F.col("n") > least) | part).select("text")


def gazetteer_entities(articles: DataFrame, gazetteer: DataFrame,
                       longest: int = 3, text: str = "content") -> DataFrame:
    """Gazetteer names in the text, word by word, whatever the case.

    ``gazetteer`` has ``name, label`` and may be large. Phrases that can't be names are
    dropped inside the task; the gazetteer is sent to the others up to a counted size.
    Beyond, its most frequent names are sent and the others joined by shuffle. The words
    of a text never move.
    """
    names = gazetteer.select(F.lower("name").alias("text"), "label")
    return found_phrases(articles, names, longest, text).select(
        "article_id", "pos", "text", "label")


def pattern_entities(articles: DataFrame, text: str = "content",
                     rules: dict[str, str] = RULES) -> DataFrame:
    """``article_id, label, nth, text`` for every match of every rule. No shuffle."""
    body = X.text_of(F.col(text))
    found = F.array(*[
        F.struct(F.lit(label).alias("label"),
                 F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("texts"))
        for label, pattern in rules.items()])
    return (articles.select("article_id", F.explode(found).alias("rule"))
            .select("article_id", F.col("rule.label"),
                    F.posexplode("rule.texts").alias("nth", "text")))


def entity_lists(entities: DataFrame, *order: str) -> DataFrame:
    """Entities back to one list per article, in the given order.

    Bounded by the article's own words.
    """
    item = F.struct(*order, F.struct("text", "label").alias("entity"))
    return entities.groupBy("article_id").agg(
        F.array_sort(F.collect_list(item)).alias("items")).select(
            "article_id", F.col("items.entity").alias("entities"))


def inline_entities(articles: DataFrame, gazetteer: dict[str, str],
                    text: str = "content", output: str = "entities") -> DataFrame:
    """Adds the entity list of a short gazetteer inside the row. No shuffle.

    Only places whose word starts some name are looked at further. Order is by
    place, then shorter phrase first.
    """
    labels = {name.lower(): label for name, label in gazetteer.items()}
    if not labels:
        return articles.withColumn(
            output, F.expr("cast(array() AS array<struct<text:string,label:string>>)"))
    longest = max(len(name.split()) for name in labels)
    starts = X.sql_list(name.split()[0] for name in labels)
    table = "map(" + ", ".join(
        f"{X.sql_list([name])}, {X.sql_list([label])}"
        for name, label in labels.items()) + ")"
    phrases = ", ".join(
        f"concat_ws(' ', slice(_tokens, p.pos + 1, {n}))" for n in range(1, longest + 1))
    return (articles
            .withColumn("_tokens", X.tokens_of(X.text_of(F.col(text))))
            .withColumn("_places", F.expr(
                "filter(transform(_tokens, (w, i) -> named_struct('pos', i, 'word', w)), "
                f"p -> p.word IN ({starts}))"))
            .withColumn("_found", F.expr(
                f"flatten(transform(_places, p -> filter(array_distinct(array({phrases})), "
                f"t -> t IN ({X.sql_list(labels)}))))"))
            .withColumn(output, F.expr(
                "transform(_found, t -> named_struct('text', t, "
                f"'label', element_at({table}, t)))"))
            .drop("_tokens", "_places", "_found"))
