"""Operator 6: quality classifier by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms: its words in lower case (hashed) and the shapes of
its words, such as `Aa.` or `aa***`, and words that repeat the word before.
Terms are weighted by log frequency and inverse document frequency, and a
truncated singular value decomposition of the labelled sample gives the latent
space.  The vectors of the sample, at most SAMPLE rows, are broadcast; each
document is compared with all of them in blocks, exactly, and its nearest
neighbours vote with their labels, weighted by cosine similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Most labelled rows that the classifier is fitted on (those whose ids hash lowest), and so most vectors broadcast.
SAMPLE = 2048
WORD_TERMS = 4096
SHAPE_TERMS = 1024
REPEAT = WORD_TERMS + SHAPE_TERMS
TERMS = REPEAT + 1
#: Weight of shapes against words.
SHAPE_WEIGHT = 3.0
DIMENSIONS = 48
NEIGHBOURS = 15
THRESHOLD = 0.7
ROWS = 256

_RUNS = re.compile(r"(.)\1+", re.S)
_SHAPE = {c: "A" for c in range(65, 91)} | {c: "a" for c in range(97, 123)} | {c: "0" for c in range(48, 58)}


def shape(word: str) -> str:
    if word.isascii():
        s = word.translate(_SHAPE)
    else:
        s = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1\1", s)


class Terms(dict):
    """word -> its term in words and its term in shapes as one number; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        code = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_TERMS * 65536 + zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % SHAPE_TERMS
        if len(word) <= 40:
            self[word] = code
        return code


_terms = Terms()


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a text and how often each occurs."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    codes = np.fromiter(map(_terms.__getitem__, words), np.int64, len(words))
    terms = np.concatenate([codes >> 16, (codes & 65535) + WORD_TERMS])
    found, n = np.unique(terms, return_counts=True)
    repeats = int((codes[1:] == codes[:-1]).sum())
    if repeats:
        found, n = np.append(found, REPEAT), np.append(n, repeats)
    return found, n.astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray  # of each term
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows, of length 1 or 0
    labels: np.ndarray
    prior: float

    def rows(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Latent vectors, of length 1 (0 for a text without terms)."""
        out = np.zeros((len(counted), self.axes.shape[1]), np.float32)
        for k, (terms, n) in enumerate(counted):
            if len(terms):
                w = weights(terms, n, self.idf)
                out[k] = w @ self.axes[terms]
        return unit(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        rows = self.rows([term_counts(x) for x in texts])
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts), ROWS):
            cosine = rows[a : a + ROWS] @ self.vectors.T
            near = nearest(cosine, k)
            w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 4
            # A pinch of the prior decides where no neighbour is similar at all.
            out[a : a + ROWS] = ((w * self.labels[near]).sum(axis=1) + 1e-3 * self.prior) / (w.sum(axis=1) + 1e-3)
        return out.clip(0, 1)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest numbers of each row, in no order; of equal ones the first columns."""
    least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    above, equal = cosine > least, cosine == least
    take = above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))
    return np.nonzero(take)[1].reshape(len(cosine), k)


def weights(terms: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted terms: words and shapes have a length of their own each, so that neither drowns the other."""
    w = np.log1p(n) * idf[terms]
    word = terms < WORD_TERMS
    for part, weight in ((word, 1.0), (~word, SHAPE_WEIGHT)):
        length = np.sqrt((w[part] ** 2).sum())
        if length:
            w[part] *= weight / length
    return w.astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def fit(counted: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Model:
    labels_ = np.array(labels, np.float64)
    prior = float(labels_.mean()) if len(labels_) else 0.5
    seen = np.zeros(TERMS)
    for terms, _ in counted:
        seen[terms] += 1
    idf = (np.log((1 + len(counted)) / (1 + seen)) + 1).astype(np.float32)
    x = np.zeros((len(counted), TERMS), np.float32)
    for k, (terms, n) in enumerate(counted):
        if len(terms):
            x[k, terms] = weights(terms, n, idf)
    size = min(DIMENSIONS, *x.shape) if len(counted) else 0
    if not size:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels_, prior)
    # Randomised range finder with power steps; the seed is fixed.
    probe = np.random.default_rng(7).standard_normal((TERMS, size + 16)).astype(np.float32)
    q = np.linalg.qr(x @ probe)[0]
    for _ in range(3):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:size].T.astype(np.float32)
    return Model(idf, axes, unit(x @ axes), labels_, prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, where=None) -> DataFrame:
    """(doc_id, text, quality) of at most `sample` labelled rows of docs: those whose ids hash lowest, so the choice is spread and repeatable.

    An id that is labelled more than once has its best label; of an id's texts
    the least is taken.  Only ids are compared before the choice, and only the
    texts chosen are moved.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    if where is not None:
        known = known.where(where)
    there = docs.where("text is not null").select("doc_id")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where("text is not null").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, where=None) -> Model:
    """Fit on labelled rows of docs; only their term counts come to the driver, for `sample` rows at most."""
    common.short_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("terms", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.nonempty(batches):
            counted = [term_counts(x) for x in common.strings(batch.column(1))]
            yield common.record(schema, [batch.column(0), batch.column(2), [t.astype("i4") for t, _ in counted], [n for _, n in counted]])

    rows = labelled_sample(docs, labels, sample, where).select(F.col("doc_id").cast("long"), "text", "quality").mapInArrow(run, "doc_id long, quality int, terms array<int>, n array<float>")
    found = sorted(rows.collect(), key=lambda r: r["doc_id"])
    return fit([(np.array(r["terms"], np.int64), np.array(r["n"], np.float32)) for r in found], [r["quality"] for r in found])


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score and predicted, under these names; columns of these names in docs are replaced.

    Null and empty texts have the share of good rows among the labelled ones as
    score; neighbours that are as near as the last one vote if their ids are
    smaller; equal texts have equal scores; an empty table gives no row.
    """
    spark = docs.sparkSession
    common.short_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most SAMPLE x DIMENSIONS and TERMS x DIMENSIONS numbers
    docs = docs.drop(*names)
    at = docs.columns.index("text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.nonempty(batches):
            score = shared.value.scores(common.strings(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, *names])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))


def learnable():
    """Rows that may teach: crc32(doc_id as text) mod 4 is not 2."""
    return common.crc_of_id() % 4 != 2


def op6_quality_knn(spark, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, x) for x in ("documents", "labels"))
    model = fit_quality(docs, labels, where=learnable())
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", (~learnable()).alias("held_out"), "score", "predicted")
