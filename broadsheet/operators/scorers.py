"""Sentence scorers.

A scorer turns the sentence list of an article into a list of
``struct<label,score>`` of the same length, so scoring stays inside the row and
moves nothing. Two kinds share that contract: word-list scorers made of
expressions, and any Python model run on Arrow batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet import schemas
from broadsheet.functions import text as X


def _count(hits: str, terms) -> str:
    return f"size({X.kept_sql(hits, terms)})"


@dataclass(frozen=True)
class ValenceStars:
    """Star label from word lists: 3, plus positive, less negative terms."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]

    @property
    def vocabulary(self) -> set[str]:
        return {*self.positive, *self.negative}

    def score(self, hits: str) -> str:
        """SQL text: label of a sentence from its distinct vocabulary terms."""
        labels = ", ".join(f"'{label}'" for label in C.STAR_LABELS)
        stars = (f"{C.NEUTRAL_STARS} + {_count(hits, self.positive)}"
                 f" - {_count(hits, self.negative)}")
        return (f"named_struct('label', element_at(array({labels}), "
                f"greatest(1, least(5, {stars}))), 'score', cast(NULL AS double))")


@dataclass(frozen=True)
class TermPropaganda:
    """Score ``h / (h + 0.1)`` for ``h`` distinct terms of the list."""

    terms: tuple[str, ...]

    @property
    def vocabulary(self) -> set[str]:
        return set(self.terms)

    def score(self, hits: str) -> str:
        h = _count(hits, self.terms)
        # the one-item list names the count, so that it is made once
        return (f"transform(array({h}), n -> named_struct("
                "'label', if(n > 0, 'Propaganda', 'Non-Propaganda'), "
                "'score', n / (n + 0.1D)))[0]")


ScoreBatch = Callable[[Sequence[str]], Sequence[tuple[str, float]]]

# Models of this worker process; the oldest goes when a fifth comes.
_LOADED: dict[str, ScoreBatch] = {}


def _loaded(key: str, load: Callable[[], ScoreBatch]) -> ScoreBatch:
    if key not in _LOADED:
        if len(_LOADED) >= 4:
            del _LOADED[next(iter(_LOADED))]
        _LOADED[key] = load()
    return _LOADED[key]


def score_batches(model: ScoreBatch, sentences: Sequence[str],
                  size: int) -> list[tuple[str, float]]:
    """Results of ``model`` in the order of ``sentences``.

    Mini-batches hold sentences of like length, so a model that pads does little in vain.
    A batch answered with any other number of results than it has sentences is an error:
    all later labels would move to the wrong sentence.
    """
    order = sorted(range(len(sentences)), key=lambda i: len(sentences[i]))
    results: list[tuple[str, float]] = [("", 0.0)] * len(sentences)
    for start in range(0, len(order), size):
        places = order[start:start + size]
        answers = list(model([sentences[i] for i in places]))
        if len(answers) != len(places):
            raise ValueError(f"the model gave {len(answers)} results for {len(places)} sentences")
        for i, answer in zip(places, answers):
            results[i] = answer
    return results


@dataclass(frozen=True)
class ModelScorer:
    """A Python model as a scorer.

    ``load`` is called once per worker process and returns a function from a
    list of sentences to a list of ``(label, score)``. It sees whole sentences in
    mini-batches of ``batch_size``, filled across article borders and ordered by
    length; cutting to its own input limit is the model's part, as it alone knows its tokens.
    """

    load: Callable[[], ScoreBatch]
    batch_size: int = C.PROPAGANDA_BATCH

    def score_list(self, sentences: Column) -> Column:
        load, size = self.load, self.batch_size
        key = uuid.uuid4().hex

        @F.pandas_udf(f"array<{schemas.SENTENCE_SCORE.simpleString()}>")
        def run(lists: pd.Series) -> pd.Series:
            flat = [sentence for items in lists for sentence in items]
            scored = iter(score_batches(_loaded(key, load), flat, size))
            return pd.Series([
                [dict(zip(("label", "score"), next(scored))) for _ in items]
                for items in lists])

        return run(sentences)


def word_model(positive: Sequence[str], negative: Sequence[str]) -> Callable[[], ScoreBatch]:
    """Loader of a plain Python star model; stands in for a trained network."""
    def load() -> ScoreBatch:
        import re

        token = re.compile(r"\w+")
        good, bad = set(positive), set(negative)
        labels = C.STAR_LABELS

        def score(batch: Sequence[str]) -> list[tuple[str, float]]:
            results = []
            for sentence in batch:
                words = set(token.findall(sentence.lower()))
                stars = 3 + len(words & good) - len(words & bad)
                results.append((labels[min(5, max(1, stars)) - 1], 1.0))
            return results

        return score

    return load


def sentence_scores(sentences: DataFrame, scorer) -> DataFrame:
    """``label`` and ``score`` for a table with one sentence per row."""
    if isinstance(scorer, ModelScorer):
        scored = F.get(scorer.score_list(F.array("sentence")), F.lit(0))
    else:
        hits = X.kept_sql(X.tokens_sql("sentence"), scorer.vocabulary)
        sentences = sentences.withColumn("hits", F.expr(f"array_distinct({hits})"))
        scored = F.expr(scorer.score("hits"))
    return (sentences.withColumn("scored", scored)
            .withColumns({"label": F.col("scored.label"),
                          "score": F.col("scored.score")})
            .drop("scored", "hits"))
