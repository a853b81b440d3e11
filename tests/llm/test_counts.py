"""Resampling, line dedup and collocations against plain versions, with the edge cases of their docstrings."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from threatquery.llm import _store, collocations, lines, resample

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, row string, kept string"


def prose(seed, n, words=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.zipf(1.3, n) % words)


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and ids, and columns named as the operators' own."""
    long = "\n".join(prose(k, 300) for k in range(100))
    texts = [None, "", " \t\n", "One two, ONE two", "One two, ONE two", long, long + "\nTail", "é ñ 漢字\r\n  É ", "a\x00b\x1fc", prose(5, 25)]
    return [(k, t, ("en", None, "de")[k % 3], "a", None) for k, t in enumerate(texts)] + [(3, "One two, ONE two", "en", "a", None), (None, prose(6, 30), None, "a", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain_resample(docs, target, percent, least, longest, buckets, seed=2024):
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(x.encode()) % buckets for x in runs]

    rows = [(i, *found(t)) for i, t in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for x in target for b in found(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    out = []
    for i, n, own in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return sorted(((r[0], r[2], r[3], r[4], drawn.index(r) + 1 if r in drawn else None) for r in out), key=str)


@pytest.mark.parametrize(("percent", "least", "longest", "buckets"), [(10, 20, 1, 10_000), (50, 0, 3, 97), (100, 5, 2, 1000)])
def test_resample_against_plain(spark, percent, least, longest, buckets):
    docs = [(k, prose(k, k % 70)) for k in range(300)] + [(None, prose(1, 30)), (400, None)]
    target = [prose(k, 40, 10).upper() for k in range(20)] + [None, ""]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = resample.resample(left, spark.createDataFrame([(t,) for t in target], "text string"), percent, least, longest, buckets)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(docs, target, percent, least, longest, buckets)


def test_matrix_rows_are_the_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "a")], "doc_id long, text string").coalesce(1)
    (block,) = resample.matrix(docs, buckets=50).collect()
    a, b = zlib.crc32(b"a") % 50, zlib.crc32(b"b") % 50
    assert (block.doc_ids, block.words, block.starts) == ([1, 2, 3], [3, 0, 1], [0, 2, 2, 3])
    assert sorted(zip(block.buckets[:2], block.counts[:2])) == sorted([(a, 1), (b, 2)]) and (block.buckets[2], block.counts[2]) == (a, 1)
    monkeypatch.setattr(resample, "KNOWN", 1)  # what is remembered of words changes nothing
    assert resample.column_sums(resample.matrix(docs, buckets=50), 50)[[a, b]].tolist() == [2, 2]


def test_matrix_is_read_a_few_blocks_at_a_time(spark):
    docs = spark.createDataFrame([(k, prose(k, 20)) for k in range(30)], "doc_id long, text string").coalesce(1)
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "1")  # a text is a block
    try:
        tables = _store.Tables(spark, "matrix")
        assert resample.written(tables, resample.matrix(docs), "m").count() == 30
    finally:
        conf.set(name, before)
    (file,) = Path(tables.root.removeprefix("file:"), "m").glob("*.parquet")
    groups = pq.read_metadata(file)
    assert max(groups.row_group(k).num_rows for k in range(groups.num_row_groups)) <= resample.ROW_GROUP < 30


def test_resample_edges(odd, none):
    got = resample.resample(odd, none.select("text"), least=0, percent=100).collect()
    assert len(got) == 12 and {r.weight for r in got if r.doc_id in (0, 1, 2)} == {0} and sorted(r["rank"] for r in got) == list(range(1, 13))
    same = [r for r in got if r.doc_id == 3]
    assert len(same) == 2 and same[0].score == same[1].score and abs(same[0]["rank"] - same[1]["rank"]) == 1
    assert resample.resample(none, odd.select("text")).count() == 0
    assert resample.resample(odd, odd).where("rank is not null").count() == 0  # a tenth of five


def plain_lines(rows, least_docs, least_chars):
    held = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    counts = Counter(k for _, t in rows for k in {held(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if len(k := held(x)) < least_chars or counts[k] < least_docs]
        out.append((i, "\n".join(stay), len(own), len(own) - len(stay)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(200):
        own = [f"line {k} {j}" for j in range(int(rng.integers(0, 5)))]
        own += [("  Shared %d \t" % x).upper() if x % 2 else f"shared {x}" for x in rng.integers(0, 30, int(rng.integers(0, 6)))]
        own += ["", "é", "Everywhere"] if k % 2 else ["ab"]
        rng.shuffle(own)
        rows.append((k, "\n".join(own)))
    return rows + [(7, "Everywhere\nshared 1"), (None, "everywhere\r\nx"), (900, None), (901, ""), (902, "\n")]


@pytest.mark.parametrize(("least_docs", "least_chars"), [(10, 1), (2, 2), (3, 8), (1, 0)])
def test_lines_against_plain(spark, texts, monkeypatch, least_docs, least_chars):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = plain_lines(texts, least_docs, least_chars)
    assert sorted((tuple(r) for r in lines.report(docs, least_docs, least_chars).collect()), key=str) == want
    monkeypatch.setattr(lines, "SHARD", 7)
    assert sorted((tuple(r) for r in lines.report(docs, least_docs, least_chars).collect()), key=str) == want
    monkeypatch.setattr(lines, "BROADCAST", -1)  # as with an index that is too large for every task
    monkeypatch.setattr(lines, "PROBES", 5)
    assert sorted((tuple(r) for r in lines.report(docs, least_docs, least_chars).collect()), key=str) == want


def test_lines_edges(odd, none, monkeypatch):
    for limit in (lines.BROADCAST, -1):
        monkeypatch.setattr(lines, "BROADCAST", limit)
        got = lines.drop_common(odd, 2)
        assert got.columns == odd.columns and got.count() == 12 and got.where("row = 'a'").count() == 12 and got.where("kept = 'b'").count() == 1
        by = {r.doc_id: r.text for r in got.collect()}
        assert (by[0], by[1], by[3], by[5], by[6]) == ("", "", "", "", "Tail")
        assert lines.drop_common(none).count() == 0 and lines.report(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_index_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    high, low = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    high[: n // 3] = 5  # hashes that agree in one half
    counts = np.arange(10, 10 + n)
    ix = lines.Index.unpacked(lines.Index.build(high, low, counts).packed())
    assert sorted(ix.slots(high, low).tolist()) == list(range(n)) and ix.count(high, low).tolist() == counts.tolist()
    other = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert not ix.count(other, other).any()
    assert n < 1000 or 8 * ix.bits.nbytes < 4.5 * n


def plain_collocations(rows, top, least, longest, share):
    by, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            by.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in by.items():
        frequent, own = {p: c for p, c in f.items() if len(p) > 1 and c >= least}, []
        inside = {}
        for p, c in frequent.items():
            for k in range(2, len(p)):
                for s in range(len(p) - k + 1):
                    inside[p[s : s + k]] = max(inside.get(p[s : s + k], 0), c)
        for p, a in frequent.items():
            if p in inside and 100 * inside[p] >= share * a:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "share", "top"), [(100, 5, 100, 2000), (8, 5, 90, 40), (4, 3, 100, 2000), (3, 2, 100, 5)])
def test_collocations_against_plain(spark, monkeypatch, least, longest, share, top):
    rows = []
    for k in range(150):
        text = prose(k, 120, 40).replace(" w7 ", ", ").replace(" w3 ", ". W3 ")
        rows.append((("en", "de", None)[k % 3], text + " new york city\tnew york city" * (k % 4) + "\nha ha ha ha ha" * (k % 3)))
    rows += [("en", None), ("fr", ""), ("fr", " . , "), ("en", rows[0][1]), ("en", "naïve Ärger naïve Ärger " * 30)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = plain_collocations(rows, top, least, longest, share)
    assert want
    run = lambda: sorted(tuple(r) for r in collocations.collocations(docs, top, least, longest, share).collect())
    assert run() == want
    for name, value in (("BLOCK", 500), ("BUCKET", 300), ("HEAVY", 50), ("BROADCAST", -1), ("PAIRS", -1)):  # many blocks and buckets, frequent pivots dealt out, a vocabulary too large for every task
        monkeypatch.setattr(collocations, name, value)
    assert run() == want


def test_each_phrase_has_one_owner():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 6, 4000)
    left, right = collocations.extents(ids, 5)
    at = np.flatnonzero((left > 0) | (right > 0))
    words = np.concatenate([np.delete(ids[p - left[p] : p + right[p] + 1], left[p]) for p in at])
    got = Counter()
    for phrases, times in collocations.mined(ids[at], (left[at] << 4) | right[at], words, 1, 5):
        for p, n in zip(phrases.tolist(), times.tolist(), strict=True):
            assert tuple(p) not in got
            got[tuple(p)] = n
    assert got == Counter(tuple(x) for k in range(2, 6) for i in range(len(ids) - k + 1) if 0 not in (x := ids[i : i + k].tolist()))


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts as of a very large corpus, scored exactly."""
    a, l, r, n = 9 * 10**11, 10**12 + 7, 10**12 + 9, 9 * 10**14
    tables = _store.Tables(spark, "t")
    found = tables.write(spark.createDataFrame([([1, 2], a)], "ids array<bigint>, a bigint"), "p")
    words = tables.write(spark.createDataFrame([("en", "x", l, 1), ("en", "y", r, 2)], "lang string, word string, f bigint, id bigint"), "v")
    sizes = tables.write(spark.createDataFrame([("en", n)], "lang string, n bigint"), "n")
    monkeypatch.setattr(collocations, "phrases", lambda *_: (found, words, sizes))
    (row,) = collocations.collocations(spark.range(1).select(F.lit("").alias("text"))).collect()
    assert tuple(row) == ("en", 1, "x y", a, l, r, n, 1000 * a * n // (l * r))


def test_collocations_edges(odd, none):
    assert collocations.collocations(none).count() == 0 and collocations.collocations(odd, least=100_000).count() == 0
    got = {r.phrase: r for r in collocations.collocations(odd, least=2).where("lang = 'en'").collect()}
    assert (got["one two"].a, got["one two"].l, got["one two"].r) == (4, 4, 4)
    with pytest.raises(ValueError, match="2 to 15"):
        collocations.collocations(odd, longest=16)
