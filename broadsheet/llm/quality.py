"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes a vector of term frequencies: trigrams of character classes, hashed words,
and how often words come back. Frequencies are damped, weighted by inverse document
frequency, projected on the leading singular directions of a bounded labelled sample and
normalised. That sample's vectors are broadcast; every document is compared with all of
them, in blocks of exact cosine products, and its nearest neighbours vote with their
similarity as weight. Labels are the only thing learnt from; no label, language, source
or id enters a score.

The sample is bounded by ``SAMPLE`` rows for each label, a documented parameter, so the
model has the same size on any corpus. The term weights are counted over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import shingles as S
from broadsheet.llm.storage import give_back

SAMPLE = 1500
NEIGHBOURS = 15
DIRECTIONS = 48
THRESHOLD = 0.7
POWER = 8
POWER_STEPS = 6
BLOCK = 512
FOLDS, HELD_OUT = 4, 2

CLASSES = 12
TRIGRAMS = CLASSES ** 3
WORD_BINS = 512
WORD_WEIGHT = 0.3
RETURNS = (1, 2, 3, 4)
WIDTH = TRIGRAMS + WORD_BINS + len(RETURNS) + 2


def _classes() -> np.ndarray:
    kind = np.full(256, 11, np.int64)
    kind[0x80:] = 0                       # letters of other alphabets, as lower case
    kind[ord("a"):ord("z") + 1] = 0
    kind[ord("A"):ord("Z") + 1] = 1
    kind[ord("0"):ord("9") + 1] = 2
    for place, chars in enumerate((" \t", "\n\r", ".", ",;:", "!?", "'\"()-", "|<>/\\{}[]_=+~^",
                                   "#$%&*@"), 3):
        kind[[ord(c) for c in chars]] = place
    return kind


KIND = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """One row of term frequencies per text; zeros for a text without bytes."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, data, offsets in S.text_slices(texts):
        words, starts = S.word_hashes(data, offsets)
        kinds = KIND[data]
        codes = np.zeros(len(data), np.int64)
        if len(data) > 2:
            codes[:-2] = (kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:]
        bins = (words % np.uint64(WORD_BINS)).astype(np.int64)
        for i in range(len(offsets) - 1):
            a, b = offsets[i], offsets[i + 1]
            mine = out[row + i]
            if b - a > 2:
                mine[:TRIGRAMS] = np.sqrt(np.bincount(
                    codes[a:b - 2], minlength=TRIGRAMS) / (b - a - 2))
            own = words[starts[i]:starts[i + 1]]
            if not len(own):
                continue
            mine[TRIGRAMS:TRIGRAMS + WORD_BINS] = WORD_WEIGHT * np.sqrt(np.bincount(
                bins[starts[i]:starts[i + 1]], minlength=WORD_BINS) / len(own))
            for k, back in enumerate(RETURNS):
                if len(own) > back:
                    mine[TRIGRAMS + WORD_BINS + k] = np.mean(own[back:] == own[:-back])
            # Distinct share among the first words of runs of 64, so that length has no say.
            runs = [len(np.unique(own[k:k + 64])) / len(own[k:k + 64])
                    for k in range(0, len(own), 64)]
            mine[-2] = 1 - np.mean(runs)
            mine[-1] = 1 / np.sqrt(1 + len(own))
    return out


@dataclass
class Model:
    idf: np.ndarray
    directions: np.ndarray      # WIDTH x DIRECTIONS
    vectors: np.ndarray         # sample x DIRECTIONS, normalised
    labels: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = (rows * self.idf) @ self.directions
        size = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.divide(latent, size, out=np.zeros_like(latent), where=size > 0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest neighbours of each row."""
        out = np.empty(len(rows))
        many = min(NEIGHBOURS, len(self.labels))
        for first in range(0, len(rows), BLOCK):
            cosine = self.project(rows[first:first + BLOCK]) @ self.vectors.T
            near = nearest(cosine, many)
            weight = np.clip(np.take_along_axis(cosine, near, 1), 0, 1) ** POWER + 1e-9
            out[first:first + BLOCK] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def nearest(cosine: np.ndarray, many: int) -> np.ndarray:
    """Places of the ``many`` greatest values of each row; of equal ones the first count."""
    least = np.partition(cosine, cosine.shape[1] - many, axis=1)[:, [cosine.shape[1] - many]]
    above, equal = cosine > least, cosine == least
    room = many - above.sum(axis=1, keepdims=True)
    picked = above | (equal & (np.cumsum(equal, axis=1) <= room))
    return np.nonzero(picked)[1].reshape(len(cosine), many)


def inverse_frequencies(documents: int, held: np.ndarray) -> np.ndarray:
    """Weights of the terms from the number of documents that hold each."""
    return np.log((1 + documents) / (1 + held)).astype(np.float32) + 1


def fit(rows: np.ndarray, labels: np.ndarray, idf: np.ndarray) -> Model:
    """A model of the sample under the corpus' term weights; deterministic."""
    weighted = rows * idf
    # Leading right singular vectors by subspace iteration from a fixed start.
    basis = np.random.default_rng(5).standard_normal((WIDTH, DIRECTIONS + 16))
    for _ in range(POWER_STEPS):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, turned = np.linalg.svd(weighted @ basis, full_matrices=False)
    directions = (basis @ turned.T)[:, :DIRECTIONS].astype(np.float32)
    model = Model(idf, directions, np.zeros((0, DIRECTIONS), np.float32),
                  labels.astype(np.float64))
    model.vectors = model.project(rows)
    return model


def is_held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == HELD_OUT,
                      F.lit(False))


def _featurize(batches):
    for batch in batches:
        for first in range(0, len(batch), BLOCK):
            part = batch.slice(first, BLOCK)
            rows = features(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("quality"), part.column("doc_id"),
                 pa.array([r.tobytes() for r in rows], pa.binary())],
                ["quality", "doc_id", "row"])


def _document_frequencies(batches):
    """Each task's documents (term -1) and, of each term, the documents that hold it."""
    held, documents = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        for first in range(0, len(batch), BLOCK):
            part = batch.slice(first, BLOCK)
            held += (features(part.column("text")) > 0).sum(axis=0)
            documents += len(part)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(-1, WIDTH)), pa.array(np.concatenate([[documents], held]))],
        ["term", "held"])


def corpus_weights(documents: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all documents; one row per term reaches the driver."""
    counts = documents.select("text").mapInArrow(
        _document_frequencies, "term long, held long").groupBy("term").agg(F.sum("held"))
    total = dict(counts.collect())
    return inverse_frequencies(total.get(-1, 0), np.array(
        [total.get(i, 0) for i in range(WIDTH)], np.int64))


def train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on up to ``SAMPLE`` labelled rows of each label, picked by a hash of the id.

    Labels of ids that no document has are left out before the sample is taken. Term
    weights are those of all documents.

    Only ids of the sample (a bounded number) are sent to the scan, and only its rows
    come back. Rows without id, label or document, and the held-out fold, are left out;
    of contradicting labels of one id the lesser counts. None without any label.
    """
    usable = (labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
              .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)
                     & ~is_held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .join(documents.select("doc_id"), "doc_id", "left_semi")
              .withColumn("_turn", F.xxhash64("doc_id")))
    picked = None
    for label in (0, 1):
        some = usable.where(F.col("quality") == label).orderBy("_turn", "doc_id").limit(SAMPLE)
        picked = some if picked is None else picked.union(some)
    chosen = [(r.doc_id, r.quality) for r in picked.collect()]
    if not chosen:
        return None
    spark = documents.sparkSession
    small = F.broadcast(spark.createDataFrame(chosen, "doc_id long, quality int"))
    rows = (documents.select("doc_id", "text").join(small, "doc_id")
            .mapInArrow(_featurize, "quality int, doc_id long, row binary"))
    # Repeats of an id count once: the least row.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("row", "quality")).alias("r"))
    held = sorted((r.doc_id, r.r.quality, bytes(r.r.row)) for r in rows.collect())
    if not held:
        return None
    return fit(np.stack([np.frombuffer(r[2], np.float32) for r in held]),
               np.array([r[1] for r in held]), corpus_weights(documents))


def _scores(model):
    def run(batches):
        known = model.value
        for batch in batches:
            for first in range(0, len(batch), BLOCK):
                part = batch.slice(first, BLOCK)
                rows = features(part.column("text"))
                score = np.full(len(rows), 0.5) if known is None else known.score(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in part.schema.names if c != "text"),
                     pa.array(score, pa.float64())],
                    [*(c for c in part.schema.names if c != "text"), "score"])
    return run


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, doc, score) with ``doc`` a hash of the text; a map over rows.

    Null and empty texts have the zero vector, for which all neighbours are equally far:
    they get the mean label of the first ones. So it is with every tie: the earlier row of
    the sample, in the order of its ids, counts. Without a model every score is 0.5.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    keyed = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc"),
                             "text")
    return keyed.mapInArrow(_scores(shared), "doc_id long, doc long, score double")


def quality_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it is held out, its score, and the verdict at the threshold."""
    scored = score(documents, train(documents, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    model = train(documents, labels)
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality_score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate(
                [shared.value.score(features(texts.slice(first, BLOCK)))
                 for first in range(0, len(texts), BLOCK)] or [np.zeros(0)]), pa.float64())
            give_back()
    # Only the text goes to Python and only the score comes back.
    return documents.where(quality_score(F.col("text")) >= THRESHOLD)
