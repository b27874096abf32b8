"""Parts of the operators that need no session, against brute force."""

import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from graphselect.llm import backoff_lm, html_density, licenses, line_crf, packing, phrase_prints, quality_knn, simhash, token_files
from graphselect.llm.chunk_tokens import chunk_tokens
from graphselect.llm.sentencepiece_codec import encoder

ALPHABET = [*"ab  e the\n\t▁é😀ﬁ\x00​漢字hello  0123'sn<ñ﻿\x1c\x85\xa0İК.,!*", "<|endoftext|>", "́", "don't"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(n)] + ["", " ", "  ", "a" * 3000, " " * 200, "the" * 500, "x. y,\n\nz  ."]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_sentencepiece_is_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), encoder("piece_bpe_32k.model")
    given = texts()
    for ids, want in zip(own.encode(given), library.encode(given)):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == want
        assert own.decode(np.concatenate([[1], ids, [2]])) == library.decode([1, *want, 2])
    rng = random.Random(1)
    for _ in range(500):
        ids = [rng.choice([0, 1, 2, 13, rng.randint(3, 258), rng.randint(259, 31999), 28705]) for _ in range(rng.randint(0, 8))]
        assert own.decode(np.array(ids, "u4")) == library.decode(ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_are_the_library(name):
    given = texts()
    library = Tokenizer.from_file(public_tokenizers.path(name))
    assert [x.tolist() for x in chunk_tokens(name).ids(given)] == [x.ids for x in library.encode_batch(given, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [8, 16])
def test_directly_addressable_codes(bits):
    rng = np.random.default_rng(0)
    lengths = [0, 1, 700, 3, 2000, 0]
    ids = np.concatenate([rng.integers(0, 1 << rng.integers(1, 31), n) for n in lengths]).astype("u4")
    s = token_files.Segment(token_files.encode_segment(ids, [5, None, 7, 8, 9, -1], lengths, bits))
    assert s.doc_ids == [5, None, 7, 8, 9, -1] and s.n_tokens == len(ids)
    assert [s.token(i) for i in range(len(ids))] == ids.tolist()
    for a, b in [(0, 0), (0, len(ids)), (511, 513), (3, 1200), (1999, 2001)]:
        assert s.tokens(a, b).tolist() == ids[a:b].tolist()
    assert s.document(2).tolist() == ids[1:701].tolist()
    with pytest.raises(IndexError):
        s.token(len(ids))
    with pytest.raises(ValueError):
        token_files.Segment(b"nothing")


@pytest.mark.parametrize("seed", range(6))
def test_packing_loses_nothing_and_pads_nothing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 5, 64, 65, 700, 2048, 2049, 9000, rng.randint(1, 3000)]) for _ in range(rng.choice([0, 1, 2, 60]))]
    windows = packing.pack(lengths)
    seen = {d: [] for d in range(len(lengths))}
    for size, pieces in windows:
        assert sum(n for _, _, n in pieces) == size and size & (size - 1) == 0 and size <= 2048
        for d, s, n in pieces:
            seen[d].append((s, n))
    for d, total in enumerate(lengths):
        at = 0
        for s, n in sorted(seen[d]):
            assert s == at and n > 0
            at += n
        assert at == total
    groups = packing.step_groups(windows)
    for g in set(groups):
        own = [s for (s, _), k in zip(windows, groups) if k == g]
        assert len(set(own)) == 1 and sum(own) <= packing.STEP_WINDOWS * 2048


def test_short_gaps_are_filled():
    assert [(size, len(pieces)) for size, pieces in packing.pack([2040, 5, 3])] == [(2048, 3)]
    assert [(size, len(pieces)) for size, pieces in packing.pack([1] * 64)] == [(64, 64)]
    assert [(size, len(pieces)) for size, pieces in packing.pack([60, 3, 1, 2047, 1])] == [(2048, 2), (64, 3)]


def test_simhash_of_a_text():
    for text in texts(60):
        words = WORDS.findall(lower(text))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) & 0xFFFFFFFFFFFFFFFF == want


@pytest.mark.parametrize("alone", [True, False])
def test_tiles_connect_what_links_connect(alone):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for x in base for _ in range(12)}
    fps = sorted(near)
    rng.shuffle(fps)
    a, b = (fps, []) if alone else (fps[:200], fps[200:])
    signed = lambda x: np.array(x, np.uint64).view(np.int64)
    u, v = simhash.tile_links(signed(a), None if alone else signed(b))
    pairs = itertools.combinations(a, 2) if alone else itertools.product(a, b)

    def classes(links):
        parent = {x: x for x in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in links:
            parent[max(find(x), find(y))] = min(find(x), find(y))
        return {x: find(x) for x in fps}

    assert classes(zip(u.view(np.uint64).tolist(), v.view(np.uint64).tolist())) == classes(p for p in pairs if (p[0] ^ p[1]).bit_count() <= 4)


def test_counts_of_rules():
    for text in [*texts(80), "a b c a b c\n\n x \n x \na b c a b c", "one two three " * 30]:
        words = WORDS.findall(text)
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered))
        assert line_crf.base_counts(text) == want


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    field = line_crf.Field(rng.normal(size=len(line_crf.FEATURES)), rng.normal(size=(2, 2)))
    for n in range(7):
        x = rng.normal(size=(n, len(line_crf.FEATURES)))
        score = lambda y: sum(x[k] @ field.weights * y[k] for k in range(n)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert field.viterbi(x).tolist() == [bool(v) for v in best]


def test_field_learns_from_documents():
    good, bad = "A plain sentence ends like this. And one more of them here.", "buy | now | cheap | *** | &&&"
    fit = [(line_crf.line_features("\n".join([good] * 3))[0], 0) for _ in range(30)] + [(line_crf.line_features("\n".join([good, bad, bad + "!"]))[0], 1) for _ in range(10)]
    labels = line_crf.fit_field(fit).viterbi(line_crf.line_features("\n".join([good, bad, bad + "?"]))[0])
    assert labels.tolist() == [False, True, True]
    assert not line_crf.fit_field([]).viterbi(line_crf.line_features(bad)[0]).any()


def test_neighbours_vote():
    rng = random.Random(0)
    word = lambda: "".join(rng.choices("abcde", k=5))
    good = [" ".join(word() for _ in range(30)) + "." for _ in range(60)]
    bad = [" ".join(word().upper() + "!!" for _ in range(30)) for _ in range(60)]
    model = quality_knn.fit([quality_knn.term_counts(x) for x in good[:50] + bad[:50]], [1] * 50 + [0] * 50)
    s = model.scores(good[50:] + bad[50:] + [""])
    assert (s[:10] > 0.8).all() and (s[10:20] < 0.2).all() and 0 <= s[20] <= 1
    empty = quality_knn.fit([], [])
    assert empty.scores(["x", ""]).tolist() == [0.5, 0.5]


def test_votes_are_those_of_plain_loops():
    rng = np.random.default_rng(9)
    words = ["Good.", "fine", "BAD!!", "###", "text,", "x1", "Ü."]
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(70)]
    labels = rng.integers(0, 2, 50).tolist()
    model = quality_knn.fit([quality_knn.term_counts(x) for x in texts[:50]], labels)
    rows = model.rows([quality_knn.term_counts(x) for x in texts])
    for text, row, score in zip(texts, rows, model.scores(texts)):
        cosine = rows[:0] @ model.vectors.T if not len(row) else (row[None] @ model.vectors.T)[0]
        near = sorted(range(50), key=lambda k: (-cosine[k], k))[: quality_knn.NEIGHBOURS]
        votes = [(max(0.0, float(cosine[k])) ** 4, labels[k]) for k in near]
        want = (sum(w * y for w, y in votes) + 1e-3 * model.prior) / (sum(w for w, _ in votes) + 1e-3)
        assert abs(score - want) < 1e-5
    ties = np.array([[1.0, 2.0, 1.0, 1.0, 0.0], [3.0, 3.0, 3.0, 3.0, 3.0]])
    assert quality_knn.nearest(ties, 3).tolist() == [[0, 1, 2], [0, 1, 2]]


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header><nav><a href=x>one</a></nav>
    <div class="cookie-notice">We use cookies on this site, and you agree to it all.</div><article><h1>Title &amp; more</h1><p><b>First<br><p>Second  line of
    text, &eacute;.<ul><li>item</ul></article><aside><p>Side text that is quite long as well.</p></aside><section id="comments"><p>Nice post!</p></section>
    <form>Search <input></form><script>var t = "</p>";</script><footer>&copy; foot</footer></body></html>"""
    assert html_density.extract(page) == "Title & more\nFirst\nSecond line of text, é.\nitem"
    assert html_density.extract("") == "" and html_density.extract("<nav><a>x</a></nav>") == "" and html_density.extract("a<br>b") == "a\nb"
    assert html_density.extract("<div>" * 3000 + "deep") == "deep"


def test_licenses():
    index = licenses.Index()
    grant = licenses.TEMPLATES["mit-grant"]
    text = "Some é words. " + grant.replace("any person", "any nice person").replace("without limitation ", "") + " Released under the MIT license. end"
    found = index.scan(text)
    assert [m[0] for m in found] == ["mit-grant", "mit-notice"] and found[0][1] > 0.9
    assert text[found[0][3] : found[0][4]].startswith("Permission is") and text[found[1][3] : found[1][4]] == "Released under the MIT license"
    assert index.scan("") == [] and index.scan("the software is fine " * 20) == []
    for name, template in licenses.TEMPLATES.items():
        assert [(m[0], m[1]) for m in index.scan(f"Before it. {template} After it.")] == [(name, 1.0)]


@pytest.mark.parametrize("name", ["mit-notice", "cc-by-nc-4.0", "apache-2.0-short", "gpl-3-notice", "mpl-2.0", "spdx:Zlib"])
@pytest.mark.parametrize("apart", [0, 1, 2, 3, 4, 5, 8, 13, 20])
def test_repeated_notices_are_all_found(name, apart):
    text = (licenses.TEMPLATES[name] + " " + "filler " * apart) * 7
    assert [(m[0], m[1]) for m in licenses.Index().scan(text)] == [(name, 1.0)] * 7
    if apart == 0:
        assert len(licenses.Index().scan(text * 100)) == 700


def plain_matches(index, words, t):
    """Word counts of the best local alignments of all of words and a template, one after another, what is spanned being masked."""
    codes, template = [index.code_of.get(w, 0) for w in words], index.templates[t].tolist()
    out = []
    while True:
        n, m = len(codes), len(template)
        score, best = [[0] * (m + 1) for _ in range(n + 1)], (0, 0, 0)
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                score[i][j] = max(0, score[i - 1][j - 1] + (2 if codes[i - 1] == template[j - 1] else -2), score[i - 1][j] - 1, score[i][j - 1] - 1)
                best = max(best, (score[i][j], -j, -i))
        i, j, equal, last = -best[2], -best[1], 0, -best[2]
        while score[i][j]:
            if score[i][j] == score[i - 1][j - 1] + (2 if codes[i - 1] == template[j - 1] else -2):
                equal += codes[i - 1] == template[j - 1]
                i, j = i - 1, j - 1
            elif score[i][j] == score[i][j - 1] - 1:
                j -= 1
            else:
                i -= 1
        if equal < index.coverage * m:
            return sorted(out)
        out.append(equal)
        codes[i:last] = [0] * (last - i)


def test_alignments_are_those_of_plain_local_alignment():
    rng = random.Random(6)
    for name in ("gpl-3-notice", "cc-by-4.0-notice", "mit-notice"):
        index = licenses.Index({name: licenses.TEMPLATES[name]})
        for _ in range(12):
            words = []
            for _ in range(rng.randint(1, 4)):
                copy = licenses.WORD.findall(licenses.lowered(licenses.TEMPLATES[name]))
                if rng.random() < 0.6:  # an edit that leaves a run of four words in place
                    copy[rng.randrange(len(copy)) if len(copy) > 8 else -1] = "other"
                words += copy + ["filler"] * rng.choice([0, 0, 1, 3, 7, 20])
            assert sorted(m[2] for m in index.scan(" ".join(words))) == plain_matches(index, words, 0)


def test_phrases_depend_on_the_text_only():
    given = texts(60)
    whole, sketch = phrase_prints.fingerprints(given)
    again, _ = phrase_prints.fingerprints(given[::-1])
    assert whole.tolist() == again.tolist()[::-1]
    for (a, x), (b, y) in itertools.combinations(zip(given, whole), 2):
        assert (a == b) == (x == y)
    rng = random.Random(1)
    a, b, c = ("".join(rng.choices("abcdefgh ", k=4000)) for _ in range(3))
    p = phrase_prints.as_strings(*phrase_prints.fingerprints([a, a, "zz" + a, b, a[:2000] + c[:2000]]))
    assert phrase_prints.near(p[0], p[1]) == 1 and phrase_prints.near(p[0], p[2]) > 0.9 and phrase_prints.near(p[0], p[3]) < 0.05
    assert 0.2 < phrase_prints.near(p[0], p[4]) < 0.5


def automaton(docs, train=None):
    block = backoff_lm.Block.of(docs)
    counts = block.counts(np.ones(len(docs), bool) if train is None else np.array(train))
    words = counts[: len(block.words)]
    starts = len(docs) if train is None else sum(train)
    return block, backoff_lm.BackoffAutomaton(block, counts, int(words.sum()), int((words > 0).sum()), starts), words


def test_weights_out_of_a_state_sum_to_one():
    block, model, words = automaton(["a b a c", "a b", "b b c", "d a b"], [True, True, True, False])
    n, v = int(words.sum()), int((words > 0).sum())
    unknown = backoff_lm.ADD / (n + backoff_lm.ADD * (v + 1))
    seen = np.flatnonzero(words > 0)
    for state in sorted({0, model.start_state, *model.arc_target.tolist(), *model.root_target.tolist()}):
        weights, _ = model.step(np.full(len(seen), state), seen)
        share, at = unknown, state
        while at:
            share *= 10 ** model.fail_weight[at]
            at = model.fail_state[at]
        assert abs((10**weights).sum() + share - 1) < 1e-9


def test_lanes_do_not_change_scores():
    rng = random.Random(8)
    docs = [" ".join(rng.choices("abcdef", k=rng.choice([0, 1, 2, 3, 50, 400]))) for _ in range(40)]
    block, model, _ = automaton(docs, [k % 3 > 0 for k in range(40)])
    want = model.traverse(block, 1 << 20)
    for lane in (1, 2, 3, 7, 64):
        assert np.allclose(model.traverse(block, lane), want)


def test_keys_of_ngrams_are_packed():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        keys = np.sort(rng.integers(0, 1 << 56, n, dtype=np.uint64))
        assert backoff_lm.unpack_keys(backoff_lm.pack_keys(keys)).tolist() == keys.tolist()
        counts = rng.integers(0, 1 << rng.integers(1, 40), n)
        assert backoff_lm._unsmall(backoff_lm._small(counts)).tolist() == counts.tolist()
