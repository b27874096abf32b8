"""Operator 3: quality rules by line sequence labelling.

Each line of a document that has a word is an item of a sequence; a
linear-chain conditional random field labels it content or boilerplate by
Viterbi decoding, and the share of characters in content lines decides whether
the document stays.  Plain counts of the document come with it.

The field is fitted here on a bounded sample of labelled documents.  There are
no labels of lines.  So lines are first told apart on their own, each with its
document's label: of a rejected document's lines some are content, and since
such lines are far more frequent in accepted documents, this step calls them
so.  Its verdicts on the lines of rejected documents (all lines of accepted
ones are content) are the labels that the field is then fitted on.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .quality_knn import labelled_sample

#: Most labelled documents that the field is fitted on.
SAMPLE = 2048
#: A document stays if at least this share of its lines' characters is content.
CONTENT_SHARE = 0.5
MIN_WORDS = 50
REPEAT_WINDOW = 3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
FEATURES = ("bias", "capitals", "symbols", "bars", "exclamations", "digits", "no_end", "few_words", "very_few_words", "again", "word_again", "poor_words", "long_words")

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at 20 and 09-0D only
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    n, repeated = len(words), 0
    if n > REPEAT_WINDOW:
        number: dict[bytes, int] = {}
        codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        key = codes[: n - REPEAT_WINDOW + 1]
        for k in range(1, REPEAT_WINDOW):
            if k > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(number) + codes[k : n - REPEAT_WINDOW + 1 + k]
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[place] > 1)
        covered = np.zeros(n, bool)
        for k in range(REPEAT_WINDOW):
            covered[at + k] = True
        repeated = int(covered.sum())
    return n, chars, symbols, again, repeated


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths (code points) of the lines that have a word."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        if not line.strip(SPACES):
            continue
        b = line.encode("utf-8", "surrogatepass")
        words = b.split()
        n, chars = len(words), len(b)
        upper, lower = chars - len(b.translate(None, _UPPER)), chars - len(b.translate(None, _LOWER))
        repeat = sum(map(operator.eq, words[1:], words))
        rows.append((
            1.0,
            upper / (upper + lower) if upper + lower else 0.0,
            min(1.0, 4 * (chars - len(b.translate(None, b"#*$%&<>"))) / chars),
            min(1.0, 4 * b.count(b"|") / n),
            min(1.0, 2 * b.count(b"!") / n),
            (chars - len(b.translate(None, _DIGIT))) / chars,
            float(b.rstrip()[-1:] not in (b".", b"!", b"?", b":", b'"')),
            float(n < 5),
            float(n < 2),
            float(line in seen),
            repeat / n,
            max(0.0, 1.0 - len(set(words)) / n**0.8),  # long lines repeat common words anyway
            min(1.0, max(0.0, chars / n - 10) / 20),
        ))
        sizes.append(len(line))
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


@dataclass
class Field:
    """Scores of label 1 (boilerplate) against label 0 (content), and of one label after another."""

    weights: np.ndarray  # of features
    moves: np.ndarray  # 2 x 2

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best sequence of labels of lines with features x; ties are content."""
        score = (x @ self.weights).tolist()
        (a, b), (c, d) = self.moves.tolist()
        s0 = s1 = 0.0
        back = []
        for k, y in enumerate(score):
            if k:
                f0, f1 = s1 + c > s0 + a, s1 + d > s0 + b
                s0, s1 = (s1 + c if f0 else s0 + a), (s1 + d if f1 else s0 + b)
                back.append((f0, f1))
            s1 += y
        labels = [s1 > s0] if score else []
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return np.array(labels[::-1], bool)


def fit_field(documents: list[tuple[np.ndarray, int]]) -> Field:
    """Fit on documents, each the features of its lines and 1 if it is rejected, else 0."""
    documents = [d for d in documents if len(d[0])]
    if len({y for _, y in documents}) < 2:
        return Field(np.zeros(len(FEATURES)), np.zeros((2, 2)))
    alone = maximum_likelihood([(x, np.full(len(x), y)) for x, y in documents], chained=False)
    return maximum_likelihood([(x, (x @ alone.weights > 0) & (y == 1)) for x, y in documents])


def maximum_likelihood(sequences: list[tuple[np.ndarray, np.ndarray]], chained: bool = True, rounds: int = 150, decay: float = 1e-4) -> Field:
    """Gradient steps (Adam) with forward-backward over all sequences at once; not chained: without moves."""
    sequences = sorted(sequences, key=lambda s: -len(s[0]))
    lengths = np.array([len(x) for x, _ in sequences])
    x = np.concatenate([x for x, _ in sequences])
    y = np.concatenate([y for _, y in sequences]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    steps = [first[: np.searchsorted(-lengths, -t, side="left")] + t for t in range(lengths[0])]  # rows at place t, longest sequences first
    pairs = [(before[: len(now)], now) for before, now in zip(steps, steps[1:])]
    own_moves = np.zeros((2, 2))
    for before, now in pairs:
        np.add.at(own_moves, (y[before], y[now]), 1)
    theta, m, v = np.zeros(len(FEATURES) + 4), 0.0, 0.0
    for k in range(1, rounds + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        emit = np.stack([np.zeros(len(x)), x @ w], axis=1)
        if chained:
            alpha, beta = emit.copy(), np.zeros_like(emit)
            for before, now in pairs:
                alpha[now] += np.logaddexp(alpha[before, 0, None] + moves[0], alpha[before, 1, None] + moves[1])
            for before, now in reversed(pairs):
                after = beta[now] + emit[now]
                beta[before] = np.logaddexp(after[:, 0, None] + moves[:, 0], after[:, 1, None] + moves[:, 1])
            last = first + lengths - 1
            z = np.repeat(np.logaddexp(alpha[last, 0], alpha[last, 1]), lengths)
            share, expected = np.exp(alpha[:, 1] + beta[:, 1] - z), np.zeros((2, 2))
            for before, now in pairs:
                joint = alpha[before][:, :, None] + moves + (emit[now] + beta[now])[:, None, :]
                expected += np.exp(joint - z[now][:, None, None]).sum(axis=0)
            move_gradient = (own_moves - expected).ravel()
        else:
            share, move_gradient = 1 / (1 + np.exp(-emit[:, 1])), np.zeros(4)
        gradient = np.concatenate([x.T @ (y - share), move_gradient]) / len(x) - decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on labelled rows of docs; the features of their lines come to the driver, of `sample` documents at most.

    Without labelled rows of both kinds every line is content, and the counts alone decide.
    """
    common.short_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.nonempty(batches):
            yield common.record(schema, [batch.column(0), batch.column(2), [line_features(x)[0].astype("<f4").tobytes() for x in common.strings(batch.column(1))]])

    rows = labelled_sample(docs, labels, sample).select(F.col("doc_id").cast("long"), "text", "quality").mapInArrow(run, "doc_id long, quality int, x binary").collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return fit_field([(np.frombuffer(r["x"], "<f4").reshape(-1, len(FEATURES)).astype(np.float64), 1 - r["quality"]) for r in rows])


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_lines", "n_boilerplate_lines")


def apply_rules(docs: DataFrame, field: Field, content_share: float = CONTENT_SHARE, prefix: str = "") -> DataFrame:
    """docs with the counts, base_failed, kept, content_share, n_lines and n_boilerplate_lines.

    Null texts have no words. A text without lines has content share 0. prefix goes before these names.
    Columns of these names in docs are replaced.
    """
    common.short_batches(docs.sparkSession)
    results = [prefix + n for n in RESULTS]
    docs = docs.drop(*results)
    at = docs.columns.index("text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.nonempty(batches):
            out = []
            for text in common.strings(batch.column(at)):
                counts = base_counts(text)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > 50 * counts[0]
                x, sizes = line_features(text)
                boilerplate = field.viterbi(x)
                share = float(sizes[~boilerplate].sum() / sizes.sum()) if len(sizes) else 0.0
                out.append((*counts, failed, not failed and share >= content_share, share, len(sizes), int(boilerplate.sum())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in zip(*out))], names=[*batch.schema.names, *results])

    kinds = [T.LongType()] * 5 + [T.BooleanType()] * 2 + [T.DoubleType()] + [T.LongType()] * 2
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(results, kinds))]))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, x) for x in ("documents", "labels"))
    return apply_rules(docs.select("doc_id", "text"), fit_rules(docs, labels)).drop("text")
