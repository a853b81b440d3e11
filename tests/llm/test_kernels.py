"""Kernels without Spark: words, hashes, packing, search, FM-index, EM, trigram queries."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from threatquery.llm import _text, decontaminate, jaccard, lm, packing, secrets, topk

TEXTS = ["", None, "One  two\tthree\n", "ä É x-1", "a" * 700 + " b", "日本 語", " \x0b\x0c ", "trailing "]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize(("alphabet", "pattern"), [(_text.SPACED, r"[^\x20\x09-\x0D]+"), (_text.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(alphabet, pattern):
    data, offsets = _text.column(pa.array(TEXTS))
    found = _text.words(data, offsets, alphabet)
    spans = [found.low[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends, strict=True)]
    for k, text in enumerate(TEXTS):
        assert spans[found.first[k] : found.first[k + 1]] == re.findall(pattern, (text or "").translate(LOW))
    h = dict(zip(spans, found.hashes(), strict=True))
    assert len(set(h.values())) == len(h)
    alone = _text.words(*_text.column(pa.array([spans[-1]])), alphabet)
    assert alone.hashes()[0] == h[spans[-1]]  # the same whatever surrounds it


def test_sliced_arrays_and_slices():
    array = pa.array(["zero", "one two", None, "three"]).slice(1)
    data, offsets = _text.column(array)
    assert data.tobytes() == b"one twothree" and offsets.tolist() == [0, 7, 7, 12]
    assert list(_text.slices(offsets, 6)) == [(0, 1), (1, 3)]
    assert list(_text.slices(np.array([0]), 6)) == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=20))
def test_patterns_hold_every_piece_once(counts):
    found = packing.patterns(counts, 64)
    held: dict[int, int] = {}
    for bin_, times in found:
        assert sum(bin_) <= 64 and times > 0
        for x in bin_:
            held[x] = held.get(x, 0) + times
    assert held == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in found) >= -(-total // 64)


def test_second_step_fills_the_gap():
    # greedily 60 + 30 leave 10 of 100; 20 + 20 fill the gap that 30 leaves
    assert sorted(packing.patterns({60: 1, 30: 1, 20: 2}, 100)[0][0]) == [20, 20, 60]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1, max_size=25), st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=25), min_size=1, max_size=12), st.integers(1, 20))
def test_search_finds_all_that_reach_the_overlap(query, records, need):
    pack = lambda s: np.array(sorted(s), np.uint64)
    lists = jaccard.Lists([pack(r) for r in records])
    want = [(k, len(query & r)) for k, r in enumerate(records) if len(query & r) >= need]
    for most in (1, 1 << 12):  # merged by numpy, and by the heap
        jaccard.HEAP, held = most, jaccard.HEAP
        ids, times = lists.at_least(pack(query), need)
        jaccard.HEAP = held
        assert list(zip(ids.tolist(), times.tolist(), strict=True)) == want
    links = [k for k, r in enumerate(records) if 100 * len(query & r) >= 75 * len(query | r)]
    assert lists.search(pack(query)).tolist() == links


def test_search_without_a_near_record():
    """No record is in enough short lists, so that no long list is probed."""
    query = np.arange(40, dtype=np.uint64)
    lists = jaccard.Lists([np.arange(k, k + 40, dtype=np.uint64) for k in (20, 25, 30)] + [np.arange(100, 140, dtype=np.uint64)])
    for need in range(1, 60):
        assert lists.at_least(query, need)[0].tolist() == [k for k, n in enumerate((20, 15, 10, 0)) if n >= need]


@given(st.integers(1, 4000), st.integers(1, 4000))
def test_overlap_is_the_rule(n, m):
    t = jaccard.overlap(n, m)
    assert 100 * t >= 75 * (n + m - t) and 100 * (t - 1) < 75 * (n + m - t + 1)


@settings(max_examples=40, deadline=None)
@given(st.integers(4, 40), st.integers(0, 10**6))
def test_half_sets_of_links_share_enough(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.choice(10**6, n, replace=False)
    edits = rng.integers(0, n // 7 + 1)
    b = np.r_[a[edits:], rng.choice(np.arange(10**6, 2 * 10**6), rng.integers(0, edits + 1), replace=False)]
    shared = len(set(a) & set(b))
    if 100 * shared < 75 * (len(a) + len(b) - shared):
        return
    half = lambda s: set(sorted(s)[: (len(s) + 1) // 2])
    for x, y in ((a, b), (b, a)):
        assert len(half(x) & half(y)) >= jaccard.least_shared(np.array([len(x)]))[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=5))
def test_fm_index_locates_every_occurrence(runs, phrase):
    text = np.array([x for r in runs for x in [*r, 0]], np.int64)
    index = decontaminate.FMIndex(text, 4)
    low, high = index.search(np.array([phrase], np.int64))
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    k = len(phrase)
    assert found == [i for i in range(len(text) - k + 1) if text[i : i + k].tolist() == phrase]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 5), min_size=3, max_size=3), min_size=1, max_size=40), st.lists(st.integers(-5, 5), min_size=3, max_size=3), st.integers(1, 6))
def test_threshold_algorithm_is_exact_with_ties(vectors, query, k):
    ids = np.arange(len(vectors))[::-1] * 2
    lists = topk.Lists(ids, ids, np.array(vectors, np.int64))
    rows, scores = lists.top(int(ids[0]), np.array(query, np.int64), k)
    want = sorted(((-int(np.dot(v, query)), int(i)) for i, v in zip(ids, vectors, strict=True) if i != ids[0]))[:k]
    assert [(-int(s), int(lists.ids[r])) for r, s in zip(rows, scores, strict=True)] == want


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(1)
    vectors = np.zeros((5000, 4), np.int64)
    vectors[:, 0] = rng.permutation(5000)
    lists = topk.Lists(np.arange(5000), np.arange(5000), vectors)
    read = []
    lists.order = type("Spy", (), {"__getitem__": lambda s, key, o=lists.order: read.append(key[1]) or o[key]})()
    rows, _ = lists.top(-1, np.array([3, 0, 0, 0]), 5)
    assert lists.vectors[rows, 0].tolist() == [4999, 4998, 4997, 4996, 4995]
    assert max((s.stop or 0) - (s.start or 0) for s in read) < 200


def test_scores_that_may_not_fit_64_bits():
    vectors = np.array([[1 << 40, 1 << 40], [-(1 << 40), 1 << 40], [3, -4]], np.int64)
    lists = topk.Lists(np.arange(3), np.arange(3), vectors)
    rows, scores = lists.top(0, vectors[0], 2)
    assert rows.tolist() == [1, 2] and scores.tolist() == [0, -(1 << 40)]
    with pytest.raises(OverflowError):
        lists.top(2, vectors[0], 2)
    with pytest.raises(OverflowError):
        topk.quantised(pa.array([[1e300]]))


@given(st.integers(1, 10**6), st.integers(1, 10**7), st.integers(1, 300))
def test_sides_of_the_grid(queries, candidates, tasks):
    q, c = topk.sides(queries, candidates, tasks)
    assert q * c >= tasks and queries <= q * topk.QUERIES and candidates <= c * topk.CANDIDATES


def test_em_gains_on_its_own_data():
    rows = np.array([(3, -1000, 8, 0, 50), (3, -1000, -1000, 4, 30), (3, -1000, -1000, -1000, 20), (lm.LEVELS + 2, 10, 8, 4, 10), (lm.LEVELS + 2, -1000, 2, 4, 5)])
    w = lm.mixture(rows)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[0, 1] == 0 and not w[: lm.LEVELS, 0].any()

    def likelihood(weights):
        total = 0.0
        for level, *octaves, n in rows:
            p = np.array([2.0**x if x > -1000 else 0 for x in octaves] + [1.0])
            total += n * np.log(weights[level] @ p)
        return total

    assert likelihood(w) > likelihood(np.tile(lm.PRIOR, (2 * lm.LEVELS, 1)))
    assert np.allclose(lm.mixture(np.zeros((0, 5), int))[lm.LEVELS + 1], lm.PRIOR)


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_trigram_queries_hold_for_every_match(rule):
    samples = {
        "assign": ["api_key: abc", "APIKEY='x'", 'Password"  = y', "passwd=1", "ToKen:z", "SECRET : q"],
        "access": ["AKIA1"],
        "hex": ["0123456789abcdef"],
        "github": ["ghp_" + "a" * 36],
        "slack": ["xoxb-" + "1" * 10],
        "google": ["AIza" + "x" * 35],
        "stripe": ["sk_live_" + "9" * 16, "rk_live_" + "9" * 16],
        "jwt": ["eyJ" + "a" * 8 + ".eyJ" + "b" * 8 + "." + "c" * 8],
        "pem": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"],
    }[rule.kind]
    query = secrets.derive(rule.regex)
    assert bool(query) == (rule.kind != "hex")
    for text in samples:
        match = re.search(rule.regex, text)
        assert match
        low = match[0].lower()
        have = {low[k : k + 3] for k in range(len(low) - 2)}
        assert all(any(s <= have for s in clause) for clause in query)


def test_trigrams_are_those_of_the_shortest_strings():
    assert secrets.trigrams({"abcd", "abcde", "bcd"}) == [frozenset({"bcd"})]
    assert secrets.derive("(password|passwd)[0-9]+x") == [[frozenset({"ass", "pas"})]]


def test_token_ids_agree_with_tokenizers():
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    assert packing.same_ids(path)
    fast, slow = packing.encoder(path, True), packing.encoder(path, False)
    for text in ["", "a", " \n\n  x\t", "naïve “q” 🙂🙂 漢字 don't I'LL", "0123456789" * 50, "<|endoftext|>", "  z", " " * 300]:
        assert fast(text) == slow(text)


def test_added_tokens_in_a_text():
    """As by the contract's call of tokenizers on the file as it is."""
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    for quick in (True, False):
        for text in ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  <|endoftext|>\n", "<|endoftext|", "plain"]:
            assert packing.encoder(path, quick)(text) == whole.encode(text, add_special_tokens=False).ids
    assert len(packing.encoder(path, True)("a <|endoftext|> b")) == 4


def test_bigrams_are_told_apart_by_whole_hashes(monkeypatch):
    """Two hashes of one bucket that agree in the low 40 bits of what the bucket leaves are counted apart."""

    class Frame:
        def groupBy(self, _):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

        applyInArrow = mapInArrow

    class Chunk:
        kind, train = 0, np.ones(3, bool)

        def __init__(self, row):
            pass

        def bigrams(self):
            return np.array([3 + 8 * 5, 3 + 8 * (5 + (1 << 40))], np.uint64), np.array([0, 1, 1])

    monkeypatch.setattr(lm, "Chunk", Chunk)
    sent = list(lm.posts(Frame(), "bigram", 8).run([pa.RecordBatch.from_pylist([{"chunk": 1}])]))
    (row,) = lm.totals(Frame(), "bigram").run(pa.Table.from_batches(sent)).to_pylist()
    assert lm.grow(row["trained"], np.uint32).tolist() == [1, 2] and row["v"] == 2
