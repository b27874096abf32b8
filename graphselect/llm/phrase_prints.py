"""Operator 9: document fingerprints by locally consistent parsing.

A text is parsed bottom up.  On each level, runs of one symbol become one
symbol of their own; then deterministic coin tossing gives each symbol a label
from its own name and its left neighbour's (the lowest bit in which they
differ, and its value), again and again until six labels are left; local maxima
of the labels start phrases, and a phrase's name, a hash of its symbols, is a
symbol of the next level.  Where a phrase starts depends on few symbols around
it, so equal substrings are parsed alike inside, wherever they stand.

The fingerprint is the name of the whole text and a sketch of the names of its
phrases: for each of BINS ranges of a hash the least value.  The share of equal
values among two sketches estimates the share of phrases in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BINS = 64
#: Levels whose phrases are sketched: about 15 to 100 characters long.
LEVELS = (2, 3)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Code points parsed at once: what a processor keeps close.
CHUNK = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _step(x: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(x) * n & 0xFFFFFFFFFFFFFFFF)


def _toss(bits: int) -> np.ndarray:
    """table[a, b]: label of b after a, for labels of so many bits: twice the lowest differing bit's place, plus its value in b."""
    n = 1 << bits
    a, b = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    low = (a ^ b) & -(a ^ b)
    place = np.zeros_like(low)
    for k in range(bits):
        place[low == 1 << k] = k
    return (2 * place + ((b >> place) & 1)).astype(np.uint8)


_TOSS7, _TOSS4, _TOSS3 = _toss(7).ravel(), _toss(4).ravel(), _toss(3).ravel()


def _parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of all texts one after another, and where each text starts -> the same of the next level."""
    n = len(names)
    starts = np.zeros(n, bool)
    starts[first] = True
    # Runs: a symbol and how often it stands there.
    new = np.ones(n, bool)
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new |= starts
    if not new.all():
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, n)).astype(np.uint64)
        names = np.where(length > 1, _mix(names[at] + length * _A), names[at])
        starts = starts[at]
        n = len(names)
    # Labels; the first symbol of a text has no left neighbour, and stands after zero.
    left = np.empty_like(names)
    left[0], left[1:] = 0, names[:-1]
    left[starts] = 0
    differ = names ^ left
    low = differ & (~differ + np.uint64(1))
    place = np.bitwise_count(low - np.uint64(1)).astype(np.uint64) & np.uint64(63)
    label = (place * np.uint64(2) + ((names >> place) & np.uint64(1))).astype(np.int64)  # under 128
    for table, bits in ((_TOSS7, 7), (_TOSS4, 4), (_TOSS3, 3), (_TOSS3, 3)):  # under 14, 8, 6, 6
        before = np.empty_like(label)
        before[0], before[1:] = 0, label[:-1]
        before[starts] = 0
        label = table[(before << bits) | label].astype(np.int64)
    # A phrase starts at a text's start and at local maxima after its second symbol, but not at its last one; so
    # a phrase has two symbols at least, and nothing depends on the texts beside it.
    cut = starts.copy()
    if n > 2:
        peak = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
        cut[1:-1] |= peak & ~starts[:-2] & ~starts[1:-1] & ~starts[2:]
    at = np.flatnonzero(cut)
    place_in = (np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(names + place_in * _A), at)), np.flatnonzero(starts[at])


def fingerprints(texts: list[str], bins: int = BINS, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(names of whole texts as uint64, sketches as uint16 of shape texts x bins; 65535: an empty bin)."""
    whole = np.zeros(len(texts), np.uint64)
    sketch = np.full((len(texts), bins), 65535, np.uint16)
    group, size = [], 0
    for k, text in enumerate(texts):
        group.append(k)
        size += len(text)
        if size >= CHUNK or k + 1 == len(texts):
            _fingerprint_group(group, texts, whole, sketch, bins, levels)
            group, size = [], 0
    return whole, sketch


def _fingerprint_group(group: list[int], texts: list[str], whole: np.ndarray, sketch: np.ndarray, bins: int, levels: tuple[int, ...]) -> None:
    alive = np.array([k for k in group if texts[k]], np.int64)
    for k in group:
        if not texts[k]:
            whole[k] = _A
    if not len(alive):
        return
    points = np.frombuffer("".join([texts[k] for k in alive.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(texts[k]) for k in alive.tolist()], np.int64)
    names, first, level = _mix(points.astype(np.uint64) + _A), np.cumsum(lengths) - lengths, 0
    while True:
        count = np.diff(np.append(first, len(names)))
        done = count == 1
        if level in levels or (level < max(levels) and done.any()):
            # Texts that end on a lower level sketch their one name, so that short texts are comparable too.
            use = np.full(len(names), level in levels)
            if level < max(levels):
                use[first[done]] = True
            value = _mix(names[use] + _step(_C, level))
            owner = np.repeat(alive, count)[use]
            place = owner * bins + ((value >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)
            np.minimum.at(sketch.reshape(-1), place, np.minimum(value & np.uint64(0xFFFF), np.uint64(65534)).astype(np.uint16))
        whole[alive[done]] = _mix(names[first[done]] + _step(_A, level + 1))
        if done.all():
            return
        keep = np.repeat(~done, count)
        names, alive, count = names[keep], alive[~done], count[~done]
        names, first = _parse(names, np.cumsum(count) - count)
        level += 1


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of phrases in common, as estimated by sketches (rows of a against rows of b)."""
    used = (a != 65535) | (b != 65535)
    n = used.sum(axis=1)
    return np.where(n > 0, ((a == b) & used).sum(axis=1) / np.maximum(n, 1), 1.0)


def as_strings(whole: np.ndarray, sketch: np.ndarray) -> list[str]:
    return [f"{w:016x}{s.astype('>u2').tobytes().hex()}" for w, s in zip(whole.tolist(), sketch)]


def near(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[16:]), ">u2").astype(np.uint16)[None] for s in (a, b))
    return float(likeness(x, y)[0])


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) for each row of docs; null texts count as empty; no shuffle."""
    common.short_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.nonempty(batches):
            texts = common.strings(batch.column(1))
            yield common.record(schema, [batch.column(0), [len(x) for x in texts], as_strings(*fingerprints(texts))])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_TYPES = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_COLUMNS = [x.split()[0] for x in _TYPES.split(", ")]
_SCHEMA = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for c, t in (x.split() for x in _TYPES.split(", "))])
#: Rows of a task's output: a result, and its first and its last text, which stand beside those of other tasks.
RESULT, FIRST, LAST = 0, 1, 2


def _compared(ids: list, texts: list[str], afters: list[str]) -> list:
    """Columns of the result for texts and what comes after each."""
    m = len(texts)
    edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, afters, strict=True)]
    follows = all(a is b for a, b in zip(texts[1:], afters))
    every = texts + afters[-1:] + edited if follows else texts + afters + edited
    whole, sketch = fingerprints(every)
    prints = as_strings(whole, sketch)
    after = slice(1, m + 1) if follows else slice(m, 2 * m)
    edit = slice(len(every) - m, len(every))
    near_edited, near_next = (np.where(whole[:m] == whole[x], 1.0, likeness(sketch[:m], sketch[x])) for x in (edit, after))
    sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]
    return [ids, [len(x) for x in texts], sha, prints[:m], prints[edit], near_edited, near_next]


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document: one row for each row of docs.

    The edited text has the last half of its code points replaced by the first
    as many of the next document, in ascending order of ids; null ids come
    first, equal ids in the order of their texts' hashes, and after the last
    document comes the first.  Null texts count as empty, and two empty texts
    are alike; an empty table gives no row.

    Texts are moved once, by ranges that split even rows that are all equal.
    What stands at the ends of the ranges, two texts for each, meets by a join.
    """
    spark = docs.sparkSession
    common.short_batches(spark)
    rows = common.in_id_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    schema = pa.schema([*_SCHEMA, pa.field("kind", pa.int32()), pa.field("part", pa.int64()), pa.field("text", pa.string())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def edge(kind: int) -> pa.RecordBatch:
            return common.record(schema, [ids[-1:], *([None] for _ in _COLUMNS[1:]), [kind], [part], texts[-1:]])

        ids: list = []
        texts: list[str] = []
        begun = False
        for batch in common.nonempty(batches):
            for name, text in zip(batch.column(0).to_pylist(), common.strings(batch.column(1))):
                ids.append(name)
                texts.append(text)
                if not begun:
                    begun = True
                    yield edge(FIRST)
            if len(texts) > 1:
                m = len(texts) - 1
                yield common.record(schema, [*_compared(ids[:-1], texts[:-1], texts[1:]), [RESULT] * m, [part] * m, [None] * m])
                ids, texts = ids[-1:], texts[-1:]  # it still waits for what comes after it
        if texts:
            yield edge(LAST)

    held = common.written(rows.mapInArrow(run, _TYPES + ", kind int, part long, text string"), "prints", "zstd")
    parts = sorted(r["part"] for r in held.where(F.col("kind") == FIRST).select("part").collect())  # one number for each range
    plan = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, after long")
    firsts = held.where(F.col("kind") == FIRST).select(F.col("part").alias("after"), F.col("text").alias("next"))
    ends = held.where(F.col("kind") == LAST).select("part", "doc_id", "text").join(F.broadcast(plan), "part").join(firsts, "after").select("doc_id", "text", "next")

    def meet(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.nonempty(batches):
            yield common.record(_SCHEMA, _compared(batch.column(0).to_pylist(), common.strings(batch.column(1)), common.strings(batch.column(2))))

    return held.where(F.col("kind") == RESULT).select(*_COLUMNS).union(ends.mapInArrow(meet, _TYPES))


def op9_phrase_prints(spark, sf_dir: str) -> DataFrame:
    return compare_edited(common.table(spark, sf_dir, "documents"))
