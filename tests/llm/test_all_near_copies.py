"""Near copies of the pipeline: no alike pair is left out, whatever the SimHashes say."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from graphselect.llm import shingle_sets
from test_shingle_sets import five_words, given, groups


@pytest.mark.parametrize("seed", [7, 8])
def test_stage_keeps_exactly_one_of_each_group(spark, seed):
    """The texts are short, at the limit and share passages: SimHashes alone leave pairs of theirs out."""
    texts = given(seed)
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(groups(texts)[1])


def test_prefixes_alone_find_all_pairs(spark):
    """Without any link so far, rest_of_pairs proposes every pair of distinct alike sets; with all links, none."""
    texts = given()
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    name = [shingle_sets.set_name(x) for x in texts]
    want = {(min(name[a], name[b]), max(name[a], name[b])) for a, b in groups(texts)[0] if name[a] != name[b]}
    own = spark.createDataFrame([(x, x) for x in set(name)], "fp long, root long")
    got = {tuple(r) for r in shingle_sets.rest_of_pairs(docs, own).collect()}
    assert want <= got and len(want) > 100
    one = spark.createDataFrame([(x, 0) for x in set(name)], "fp long, root long")
    assert shingle_sets.rest_of_pairs(docs, one).isEmpty()


def test_prefix_length():
    for n in range(1, 200):
        least = min(a for a in range(n + 1) if 5 * a >= 4 * n)  # members in common with the smallest alike set
        assert shingle_sets.prefix_length(n) == n - least + 1
    assert shingle_sets.prefix_length(0) == 0


def test_pairs_of_a_token_met_in_blocks():
    rng = np.random.default_rng(3)
    sizes, roots = rng.integers(5, 400, 700), rng.integers(0, 200, 700)
    place = rng.integers(0, 3, 700)
    got = set()
    for u, v in shingle_sets.apart_pairs(np.zeros(700, np.uint64), np.arange(700), place, np.arange(700), roots, sizes):
        got |= set(zip(u.tolist(), v.tolist()))
    left = (sizes - place).tolist()
    want = {(a, b) for a, b in itertools.combinations(range(700), 2) if roots[a] != roots[b] and 9 * min(left[a], left[b]) >= 4 * int(sizes[a] + sizes[b])}
    assert got == want
    assert five_words("a b c d e f") == {("a", "b", "c", "d", "e"), ("b", "c", "d", "e", "f")}
