"""Every operator as a query over the given tables, with its SQL counterpart."""

from broadsheet.catalog import (  # noqa: F401  (registers on import)
    analysis_queries,
    corpus_queries,
    feature_queries,
    history_queries,
    lexicon_queries,
    model_queries,
    text_queries,
)
from broadsheet.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
