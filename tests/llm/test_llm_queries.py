"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphselect.llm import backoff_lm, common, components, html_density, licenses, line_crf, packing, phrase_prints, quality_knn, sentencepiece_codec, simhash, token_files

RNG = random.Random(4)
GOOD = " ".join("".join(RNG.choices("ba ce di fo gu ha je ki lo mu na pe".split(), k=RNG.randint(1, 4))) + ("." if k % 9 == 0 else "") for k in range(120)) + "."
BAD = " ".join(f"CHEAP{k}!! ***" for k in range(60))
ROWS = [
    (1, GOOD, "en", "s", 5, "x"), (2, GOOD, None, None, None, None), (3, "", "en", "s", 0, "x"), (4, None, None, "s", 0, "x"), (5, BAD, "en", "s", 1, "x"), (6, BAD + " end", "en", "s", 1, "x"),
    (7, GOOD + "\nOne more line.", "en", "s", 1, "x"), (7, GOOD + "\nOne more line.", "en", "s", 1, "x"), (None, GOOD, "en", "s", 1, "x"), (8, "tie " * 5000, "en", "s", 1, "x"), (9, "Short one.", "en", "s", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(2).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 0, 0), (6, 0, 0), (None, 1, 1), (7, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "sentencepiece": lambda d, lab: sentencepiece_codec.encode_documents(d),
    "packing": lambda d, lab: packing.pack_documents(d, with_ids=True),
    "rules": lambda d, lab: line_crf.apply_rules(d, line_crf.fit_rules(d, lab)),
    "quality": lambda d, lab: quality_knn.score_quality(d, quality_knn.fit_quality(d, lab)),
    "licenses": lambda d, lab: licenses.scan_licenses(d),
    "simhash": lambda d, lab: simhash.near_duplicates(d),
    "prints": lambda d, lab: phrase_prints.compare_edited(d),
    "lm": lambda d, lab: backoff_lm.score_texts(d, F.col("doc_id") % 2 == 1),
    "pages": lambda d, lab: html_density.extract_pages(d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(docs, labels, name):
    run = OPERATORS[name]
    found = run(docs, labels).collect()
    if name not in ("packing", "licenses"):
        assert len(found) == len(ROWS)
    assert run(docs.limit(0), labels.limit(0)).collect() == []


def test_token_files(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path, segment_tokens=50)
    found = token_files.read_token_files(spark, path).orderBy("start", "n_tokens").collect()
    assert len(found) == len(ROWS) and found[0]["doc_id"] is None
    at = 0
    for r in found:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        at += r["n_tokens"]
    assert token_files.export_files(spark, path, str(tmp_path / "plain")) == spark.read.parquet(path).count()
    empty = f"file://{tmp_path}/none"
    token_files.write_token_files(docs.limit(0), empty)
    assert token_files.read_token_files(spark, empty).collect() == []


def test_near_duplicates(docs):
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (None, 1), (3, 3), (4, 3)} <= found
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert None not in ids and len(ids) == len(set(ids)) == len({c for _, c in found})


@pytest.mark.parametrize("shape", ["path", "star", "none"])
def test_components(spark, shape):
    pairs = {"path": [(k, k + 1) for k in range(40)] + [(100, 101)], "star": [(7, k) for k in range(30)], "none": [(1, 1)]}[shape]
    found = components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["node"])
    want = {"path": [set(range(41)), {100, 101}], "star": [set(range(30))], "none": []}[shape]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def language_model(train):
    """(base, score) by the formulas of the module's docstring, with dictionaries."""
    c = Counter(w for x in train for w in x)
    n, v, (k1, k2) = sum(c.values()), len(c), backoff_lm.MASS
    pairs, triples = Counter(), Counter()
    for x in train:
        x = ["<s>", *x]
        pairs.update(zip(x, x[1:]))
        triples.update(zip(x, x[1:], x[2:]))
    c["<s>"] = len(train)
    p1 = lambda w: ((c[w] if w != "<s>" else 0) + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda u, w: (pairs[u, w] + k1 * p1(w)) / (c[u] + k1)
    p3 = lambda t, u, w: (triples[t, u, w] + k2 * p2(u, w)) / (pairs[t, u] + k2)

    def score(x):
        x = ["<s>", *x]
        return math.log10(p2(x[0], x[1])) + sum(math.log10(p3(*x[k : k + 3])) for k in range(len(x) - 2))

    return c, n, (lambda x: sum(math.log10(p1(w)) for w in x)), score


@pytest.mark.parametrize("fan", [2, 4096])
def test_language_model(docs, fan):
    rows = [(i, tokens_of(t)) for i, t, *_ in ROWS]
    teaches = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    _, n, base, score = language_model([x for i, x in rows if teaches(i)])
    found = backoff_lm.score_texts(docs, (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0), block_chars=300, fan=fan).collect()
    key = lambda i, x, a, b: (i or -1, x, round(a, 6), round(b, 6))
    got = sorted(key(r["doc_id"], r["n_tokens"], r["base_score"], r["score"]) for r in found)
    assert got == sorted(key(i, len(x), base(x), score(x)) for i, x in rows)
    assert {r["train_tokens"] for r in found} == {n}


@pytest.mark.parametrize("which", ["ids", "all", "one"])
def test_next_document(spark, docs, which):
    given = {"ids": docs.where("doc_id is not null").dropDuplicates(["doc_id"]), "all": docs, "one": docs.where("doc_id = 1")}[which]
    rows = [(r["doc_id"], r["text"] or "") for r in given.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()]
    want = []
    for k, (i, text) in enumerate(rows):
        after, h = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        a, b, c = phrase_prints.as_strings(*phrase_prints.fingerprints([text, edited, after]))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, phrase_prints.near(a, b), phrase_prints.near(a, c)))
    key = lambda r: (r[0] is not None, *(str(x) for x in r))
    assert sorted(map(tuple, phrase_prints.compare_edited(given).collect()), key=key) == sorted(want, key=key)


def test_ranges_split_what_repeats(spark):
    """Half of the rows share an id and a text, a quarter has no id; no range has much more than its share."""
    rows = [(1, "same") if k % 2 else (None, f"t{k % 7}") if k % 4 else (k, f"text {k}") for k in range(4000)]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        sizes = [r["count"] for r in common.in_id_order(given).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
        assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) < 1000
        blocks = backoff_lm._blocks(given, F.lit(True), "doc_id", "text", 1 << 20).groupBy("task").count().collect()
        assert len(blocks) == 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pipeline(spark, docs, labels, tmp_path):
    sf = f"file://{tmp_path}"
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, sf)
        assert kept.columns == docs.columns and kept.exceptAll(before).isEmpty()
    ids = {r["doc_id"] for r in kept.collect()}
    assert 1 in ids and not ids & {2, 3, 4, 5, 6, 9, None}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == ids
