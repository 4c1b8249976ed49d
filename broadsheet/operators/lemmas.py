"""Lemma rules: endings learnt from a table of lemmas, for the words it lacks."""

from __future__ import annotations

import os
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as X
from broadsheet.operators.unnest import unnest

# Endings have at most so many letters. A rule needs so many words, must hold for so many of
# a hundred words with its ending, and must explain one in so many of all words; the last
# rule bounds the table by LONGEST * MOST rules and one, whatever the corpus.
LONGEST, LEAST, PERCENT, MOST = 5, 3, 60, 1_000


def corpus_lemmas(stats: DataFrame) -> DataFrame:
    """``term, lemma`` from the terms of a corpus alone, without repeats.

    A term goes to its singular by the suffix table where the corpus has that word too, else
    to itself. Each term is sent once as itself and once under its singular, so the terms
    are read once; a word gathers itself and one term for each suffix at most.
    """
    single = F.expr(X.lemma_by_suffix("term"))
    sent = F.array(F.struct(F.col("term").alias("word"), F.lit(None).cast("string").alias("of")),
                   F.struct(single.alias("word"), F.col("term").alias("of")))
    words = (unnest(stats.select("term").where("term IS NOT NULL"), sent, value="s")
             .groupBy(F.col("s.word").alias("word"))
             .agg(F.max(F.col("s.of").isNull()).alias("known"),
                  F.collect_set("s.of").alias("terms")))
    return unnest(words, "terms", "word", "known", value="term").select(
        "term", F.when(F.col("known"), F.col("word")).otherwise(F.col("term")).alias("lemma"))


def lemma_table(lemmas: DataFrame) -> DataFrame:
    """One lemma per term, the least of several; rows without either are dropped."""
    return (lemmas.where("term IS NOT NULL AND lemma IS NOT NULL AND term <> ''")
            .groupBy("term").agg(F.min("lemma").alias("lemma")))


def ending_rules(lemmas: DataFrame, longest: int = LONGEST, least: int = LEAST,
                 percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """``ending, replacement, support, words``: how lemmas of a table differ from their terms.

    Each term votes once for each of its endings up to ``longest`` letters: for the
    replacement that makes its lemma, or for none where the lemma changes earlier letters.
    The most frequent replacement of an ending, the least of equal ones, becomes its rule if
    it meets the bounds. Votes are summed per task, so the empty ending is no hot key.
    """
    table = lemma_table(lemmas)
    count = table.agg(F.count("*").alias("n")).scalar()
    votes = F.expr(
        f"transform(sequence(0, least({int(longest)}, length(term))), k -> named_struct("
        "'ending', right(term, k), 'replacement', "
        "CASE WHEN startswith(lemma, left(term, length(term) - k)) "
        "THEN substring(lemma, length(term) - k + 1) END))")
    counted = (unnest(table, votes, value="v")
               .groupBy(F.col("v.ending").alias("ending"),
                        F.col("v.replacement").alias("replacement"))
               .agg(F.count("*").alias("n")))
    best = F.min(F.when(F.col("replacement").isNotNull(),
                        F.struct((-F.col("n")).alias("less"), "replacement")))
    return (counted.groupBy("ending").agg(best.alias("best"), F.sum("n").alias("words"))
            .select("ending", F.col("best.replacement").alias("replacement"),
                    (-F.col("best.less")).alias("support"), "words")
            .where((F.col("support") >= least) & (F.col("support") * most >= count)
                   & (F.col("support") * 100 >= F.col("words") * percent)))


@dataclass(frozen=True)
class LemmaRules:
    """Rules by ending, applied inside a row: the longest ending with a rule decides."""

    rules: dict[str, str]

    @classmethod
    def learn(cls, lemmas: DataFrame, **bounds) -> LemmaRules:
        """Only the rules come to the driver, a bounded number."""
        found = ending_rules(lemmas, **bounds).select("ending", "replacement").collect()
        return cls({row.ending: row.replacement for row in found})

    def sql(self, token: str) -> str:
        """SQL text: the lemma of ``token``; without a rule it stays.

        Endings of one length that lose as many letters and get the same ones are one hash
        set, so a word costs a few look-ups and not one test per rule.
        """
        alike = defaultdict(list)
        for ending, replacement in self.rules.items():
            same = len(os.path.commonprefix([ending, replacement]))
            alike[len(ending), len(ending) - same, replacement[same:]].append(ending)
        cases = "".join(
            f" WHEN right({token}, {n}) IN ({X.sql_list(endings)}) "
            f"THEN concat(left({token}, length({token}) - {lost}), {X.sql_list([new])})"
            for (n, lost, new), endings in sorted(
                alike.items(), key=lambda rule: (-rule[0][0], rule[0])))
        return f"CASE{cases} ELSE {token} END" if cases else token


def lemmatized(terms: DataFrame, lemmas: DataFrame, rules: LemmaRules) -> DataFrame:
    """Rows with ``term`` get ``lemma``: by the table, else by the rules; NULL stays NULL.

    The table may have any size; the optimiser picks the join and splits frequent words.
    """
    known = lemma_table(lemmas).withColumnRenamed("lemma", "_lemma")
    return terms.join(known, "term", "left").withColumn(
        "lemma", F.coalesce("_lemma", F.expr(rules.sql("term")))).drop("_lemma")
