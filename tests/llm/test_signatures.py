"""Signatures of shingle sets: they lose no alike pair, and rule out families that are nearly alike."""

import itertools

import numpy as np

from graphselect.llm import shingle_sets


def test_signatures_differ_in_no_more_than_sets_do():
    rng = np.random.default_rng(5)
    for n in (1, 2, 15, 31, 32, 33, 127, 128, 500, 3000):
        base = np.unique(rng.integers(0, 1 << 63, n + n // 3 + 2).astype(np.uint64))
        sets = [np.unique(rng.choice(base, rng.integers(max(1, n - n // 5), n + 1), replace=False)) for _ in range(12)]
        i, j = np.triu_indices(len(sets), 1)
        got = shingle_sets.differing([shingle_sets.signature(x) for x in sets], i, j)
        apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
        assert (got <= apart).all() and ((apart - got) % 2 == 0).all()  # what falls together goes in twos
        for a, b, differ in zip(i, j, got):
            both = len(np.intersect1d(sets[a], sets[b]))
            if shingle_sets.alike(both, len(sets[a]), len(sets[b])):
                assert shingle_sets.maybe_alike(differ, len(sets[a]), len(sets[b]))
    assert len(shingle_sets.signature(np.zeros(0, np.uint64))) == 1


def test_members_of_pairs_are_those_of_apart_pairs():
    rng = np.random.default_rng(4)
    sizes, roots = rng.integers(5, 60, 300), rng.integers(0, 40, 300)
    at, tokens = np.repeat(np.arange(300), 4), rng.integers(0, 90, 1200).astype(np.uint64)
    _, first = np.unique(np.stack([at, tokens.astype(np.int64)]), axis=1, return_index=True)
    at, tokens = at[first], tokens[first]
    place = rng.integers(0, 4, len(at))
    got = shingle_sets.apart_members(tokens, at, place, roots, sizes)
    want = set()
    for token in np.unique(tokens):
        some = np.flatnonzero(tokens == token)
        for u, v in shingle_sets.apart_pairs(tokens[some], at[some], place[some], np.arange(300), roots, sizes):
            want |= {(int(token), x) for x in (*u.tolist(), *v.tolist())}
    assert {(int(tokens[k]), int(at[k])) for k in got} == want and len(got) == len(want)


def test_a_family_that_is_not_alike_makes_no_pairs(spark):
    """66 texts of one base and two of 12 passages, which come first in their prefixes: 660 pairs share a passage and have a similarity of 0.75; only 3 copies with one other word are proposed."""
    base, passages = [f"c{k}" for k in range(300)], [[f"p{x}w{k}" for k in range(60)] for x in range(12)]
    texts = [" ".join([*base, *a, *b]) for a, b in itertools.combinations(passages, 2)]
    near = [t.rsplit(" ", 1)[0] + " other" for t in texts[:3]]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    name = [shingle_sets.set_name(x) for x in texts + near]
    own = spark.createDataFrame([(x, x) for x in name], "fp long, root long")
    got = {tuple(r) for r in shingle_sets.rest_of_pairs(docs, own).collect()}
    want = {(min(a, b), max(a, b)) for a, b in zip(name[:3], name[66:])}
    assert want <= got and len(got) <= 20
