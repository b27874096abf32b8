"""Near copies of the pipeline against all pairs of texts."""

import itertools
import random

import numpy as np

import corpus_pipeline
from graphselect.llm import shingle_sets, simhash


def five_words(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def edited(words, rng, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = "x" + words[k]
    return words


def given(seed=7):
    """Texts with copies of all degrees, chains, one large group, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage, out = [word() for _ in range(40)], []
    for _ in range(40):
        words = [word() for _ in range(rng.choice([3, 8, 30, 90, 200]))] + rng.choice([[], passage])
        out.append(words)
        for n in rng.sample(range(8), 3):
            out.append(edited(words, rng, min(n, len(words))))
            out.append(edited(out[-1], rng, 1))
    large = [word() for _ in range(120)]
    out += [edited(large, rng, rng.randint(1, 3)) for _ in range(60)]
    rng.shuffle(out)
    return [" ".join(x) for x in out] + ["", " ", "One", "one "]


def groups(texts):
    sets = [five_words(x) for x in texts]
    root = list(range(len(texts)))
    pairs = set()
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            pairs.add((a, b))
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    return pairs, root


def test_stage_keeps_one_of_each_group(spark):
    """Nothing goes that is in no group of near copies; most of what has a copy goes, though these texts are short, at the limit and share passages."""
    texts = given()
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    exact = set(groups(texts)[1])
    assert exact <= kept and len(texts) - len(kept) >= 0.8 * (len(texts) - len(exact))


def test_confirmed_pairs_are_alike(spark):
    texts = given()
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    name = {k: shingle_sets.set_name(x) for k, x in enumerate(texts)}
    some = sorted({(name[a], name[b]) for a, b in itertools.combinations(range(0, len(texts), 3), 2) if name[a] != name[b]})
    want = {(name[a], name[b]) for a, b in groups(texts)[0]} | {(name[b], name[a]) for a, b in groups(texts)[0]}
    found = shingle_sets.confirmed(docs, spark.createDataFrame(some, "u long, v long")).collect()
    assert {tuple(r) for r in found} == want & set(some)


def test_closest_links_span_what_is_near():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for x in base for _ in range(20)]
    fps += fps[:50]  # fingerprints may repeat
    names = np.arange(len(fps)) * 7
    signed = np.array(fps, np.uint64).view(np.int64)
    for parts in (None, 300):
        u, v = simhash.closest_links((signed[:parts], names[:parts]), None if parts is None else (signed[parts:], names[parts:]), 10, most=500)
        pairs = itertools.combinations(range(len(fps)), 2) if parts is None else itertools.product(range(300), range(300, len(fps)))
        forest, weight = simhash.Forest(len(fps)), 0
        for d, a, b in sorted(((fps[a] ^ fps[b]).bit_count(), a, b) for a, b in pairs):  # Kruskal's least forest
            a, b = forest.find(np.array([a])), forest.find(np.array([b]))
            if d <= 10 and a[0] != b[0]:
                forest.link(a, b)
                weight += d
        got = simhash.Forest(len(fps))
        got.link(u // 7, v // 7)
        every = np.arange(len(fps))
        assert got.find(every).tolist() == forest.find(every).tolist()
        assert sum((fps[a] ^ fps[b]).bit_count() for a, b in zip((u // 7).tolist(), (v // 7).tolist())) == weight


def test_every_component_keeps_a_row_where_ids_repeat(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (6, b), (7, c), (7, d), (7, d), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in (simhash.one_of_each_group, shingle_sets.one_of_each_close_copy):
        assert {tuple(r) for r in keep(docs).collect()} == {(1, a), (5, b), (7, c), (7, d)}
        assert keep(docs).count() == 4
