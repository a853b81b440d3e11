import datetime
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from threatquery.functions import hashing
from threatquery.operators import activity, dedup, features_ml, metrics, profile, quality, registry as reg, scan, splits
from threatquery.plans import catalogue
from threatquery.sources import readers, sinks

URL_ROWS = [
    (1, "http://kite-prizes.example/win", "phishing"), (2, "https://tides.example/", "1"), (3, "http://free-ferry.example/a", "0"), (4, "HTTP://Kite-Prizes.example:80/win", "0"),
    (5, "http://free-ferry.example/a", "Malicious"), (6, " ", "0"), (7, "https://harbour.example/", "safe"), (8, "https://no-label.example", None), (9, "https://odd.example/", "maybe"), (10, "http://third.example/", "threat"),
]


def test_url_seeding(spark):
    rows = spark.createDataFrame(URL_ROWS, "row long, url string, label string")
    found = reg.classified(rows, "url", "label", "row", hashing.url_fingerprint, reg.URL)
    s = reg.statistics(found, reg.URL).first()
    assert (s.total_records, s.threat_records, s.benign_records, s.invalid_records) == (10, 5, 2, 3)
    assert (s.unique_threat_hashes, s.raw_duplicate_records, s.canonical_duplicate_records, s.url_threats) == (3, 1, 2, 3)
    for limit, rows, benign in ((1, 1, 0), (2, 3, 1), (3, 10, 2), (9, 10, 2), (0, 1, 0)):  # seeding stops at the last record that the limit allows
        s = reg.statistics(found, reg.URL, limit).first()
        assert (s.total_records, s.benign_records, s.unique_threat_hashes) == (rows, benign, min(max(limit, 1), 3))
    out = reg.export(reg.seeds(found, reg.URL))
    assert out.columns == ["threatHash", "threatType", "threatTypeInt", "verdict", "confidence"]
    assert [r.source_row for r in reg.seeds(found, reg.URL, limit=1).collect()] == [1]


def test_message_seeding(spark):
    rows = [(1, "Claim the kite prize! Ring 0999", "spam"), (2, "FERRY refund at http://f.example", "smishing"), (3, "claim   the kite  prize! ring 0999", "spam"), (4, "Low tide at six", "ham"), (5, "Back by noon", "ham"), (6, "", "spam"), (7, "who knows", "")]
    df = spark.createDataFrame(rows, "row long, m string, label string")
    s = reg.statistics(reg.classified(df, "m", "label", "row", hashing.message_fingerprint, reg.MESSAGE), reg.MESSAGE).first()
    assert (s.threat_records, s.benign_records, s.unique_threat_hashes, s.canonical_duplicate_records, s.invalid_records, s.raw_duplicate_records) == (3, 2, 2, 1, 2, 0)


def test_guards(spark):
    known = spark.createDataFrame([("k", 1, 1, 1)], "threat_hash string, threat_type int, verdict int, confidence int")
    rows = [(1, "a", 1, 100, "me"), (2, "a", 1, 1, "me"), (3, reg.ZERO_HASH, 1, 1, "me"), (4, "k", 9, 999, "me"), (5, "b", 2, 1, "me"), (6, "c", 0, 101, "me"), (7, "d", 0, 0, "me"), (8, "e", 1, 1, "you")]
    batch = spark.createDataFrame(rows, "seq int, threat_hash string, verdict int, confidence int, submitter string")
    got = {r.seq: r.reason for r in reg.guarded_insert(known, batch, "me").collect()}
    assert got == {1: None, 2: "DuplicateHash", 3: "ZeroHash", 4: "DuplicateHash", 5: "InvalidVerdict", 6: "ConfidenceOutOfRange", 7: None, 8: "NotOwner"}
    odd = batch.select("*", *[F.lit(x).alias(x) for x in ("known", "static", "first", "place", "row", "_known", "reason", "a.b")])
    out = reg.guarded_insert(known, odd, "me")
    assert sorted(out.columns) == sorted(odd.columns) and {r.seq: r.reason for r in out.collect()} == got
    assert out.select("known", "static", "first", "place", "row", "_known", "`a.b`").distinct().collect() == [("known", "static", "first", "place", "row", "_known", "a.b")]


@pytest.mark.parametrize(("raw", "row"), [("ï»¿Class, Message \nham,hello world\n", ("hello world", "ham")), ("﻿Class,Message\nspam,win money\n", ("win money", "spam"))])
def test_message_headers(spark, tmp_path, raw, row):
    path = tmp_path / "m.csv"
    path.write_text(raw, encoding="utf-8")
    df = readers.read_messages(spark, str(path))
    assert df.columns == ["text", "label"] and [tuple(r) for r in df.collect()] == [row]


def test_readers(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_urls(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        readers.message_columns(["a", "b"])
    assert readers.seed_columns(["k", "Urls", "class", "target"]) == ("Urls", "class", reg.URL)  # the first candidate wins, not the first column
    assert readers.seed_columns(["target", "class", "body", "sms"]) == ("sms", "class", reg.MESSAGE)
    with pytest.raises(ValueError):
        readers.seed_columns(["one", "two"])
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    rows, content, label, kind = readers.read_seed_rows(spark, str(empty))
    assert set(reg.statistics(reg.classified(rows, content, label, "source_row", hashing.url_fingerprint, kind), kind).first()) == {0}
    path = tmp_path / "s.csv"
    path.write_text("URL,label\nhttp://a/,0\nhttp://b/\n,1\n")
    rows, content, label, kind = readers.read_seed_rows(spark, str(path))
    s = reg.statistics(reg.classified(rows, content, label, "source_row", hashing.url_fingerprint, kind), kind).first()
    assert (s.total_records, s.threat_records, s.invalid_records) == (3, 1, 2)
    log = tmp_path / "log.txt"
    log.write_text("COMMIT|||s|||Ann|||2026-09-04|||first\n3\t1\tf\n-\t-\tbin\nCOMMIT|||t|||Bob|||2026-09-12|||second|||x\n5\t0\tg\n")
    parsed = activity.parse_log(readers.read_git_log(spark, str(log))).withColumnRenamed("date", "day")
    got = {r.author: (r.commits, r.added, r.deleted, r.net, r.active_days) for r in activity.contributions(parsed, []).collect()}
    assert got == {"Ann": (1, 3, 1, 2, 1), "Bob": (1, 5, 0, 5, 1)}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    a, b = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3,)], "c int")
    assert [sinks.append_or_replace(x, path) for x in (a, a, b)] == ["overwrite", "append", "overwrite"]
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert [tuple(r) for r in sinks.upsert(old, spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), "k").collect()] == [(1, "x"), (2, "z"), (3, "w")]
    rows = spark.createDataFrame([("train", "1", 0), ("train", "Infinity", 1), ("test", "x", 0)], "split string, x string, label int")
    sinks.write_splits(rows, str(tmp_path / "s"))
    features, label = readers.read_split(spark, str(tmp_path / "s"), ["x"])
    assert features.columns == ["x"] and sorted(r.x or 0 for r in features.collect()) == [0, 0, 1.0] and label.count() == 3
    for name, bad, message in (("empty", rows.limit(0), "empty"), ("two", rows.withColumn("label", F.lit(2)), "0 or 1"), ("null", rows.withColumn("label", F.lit(None).cast("int")), "missing or no")):
        sinks.write_splits(bad, str(tmp_path / name))
        if name != "empty":
            with pytest.raises(ValueError, match=message):
                readers.read_split(spark, str(tmp_path / name), ["x"])
    rows.limit(0).write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="empty"):
        readers.read_split(spark, str(tmp_path / "none"), ["x"])
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_split(spark, str(tmp_path / "s"), ["y"])
    with pytest.raises(FileNotFoundError):
        readers.read_split(spark, str(tmp_path / "nowhere"), ["x"])
    typed = spark.createDataFrame([("1", 2)], "a string, b int")
    assert sinks.append_or_replace(typed, path) == "overwrite" and sinks.append_or_replace(a, path) == "overwrite"
    assert sinks.markdown(a).splitlines()[0] == "| a | b |"


@pytest.mark.parametrize(("window", "piece", "before"), [(5, 64, 3), (200, 64, 3), (5, 2, 1), (3, 1, 0), (5, 4, 2), (8, 1, 1)])
def test_near_mask_is_the_sequential_one(spark, monkeypatch, window, piece, before):
    """Also where pieces are short, so that chains cross them."""
    import random

    monkeypatch.setattr(dedup, "PIECE", piece)
    monkeypatch.setattr(dedup, "BEFORE", before)

    rng = random.Random(5)
    base = ["".join(rng.choice("abcde fgh") for _ in range(rng.randint(20, 60))) for _ in range(25)]
    rows = []
    for i in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i * 3, "".join(t)))
    kept, want = [], {}
    for i, t in rows:
        want[i] = not any(dedup.indel_ratio(t, u) >= 92 for u in kept[-window:])
        if want[i]:
            kept.append(t)
    got = {r[0]: r[1] for r in dedup.near_mask(spark.createDataFrame(rows, "id long, t string"), "id", "t", 92, window).collect()}
    assert got == want


def test_near_mask_of_copies(spark, monkeypatch):
    """Three quarters of the rows are one text, in a run and strewn; the window reaches far back over them."""
    texts = [f"{k:04d} text of its own {k * 7919 % 1000}" for k in range(300)]
    rows = [t for k, t in enumerate(texts) for t in [t, *["one and the same"] * (3 if k % 2 else 0)]]
    rows = rows[:500] + ["one and the same"] * 600 + rows[500:] + texts[-3:] * 2
    kept, want = [], []
    for t in rows:
        want.append(not any(t == u or dedup.indel_ratio(t, u) >= 92 for u in kept[-20:]))
        if want[-1]:
            kept.append(t)
    for piece, most in ((32, 1 << 20), (1, 0)):
        monkeypatch.setattr(dedup, "PIECE", piece)
        monkeypatch.setattr(dedup, "BROADCAST", most)
        got = dedup.near_mask(spark.createDataFrame(list(enumerate(rows)), "id long, t string"), "id", "t", 92, 20).orderBy("id").collect()
        assert [r.kept for r in got] == want


def test_near_is_the_plain_ratio():
    """Counts, grams and the first parts of two texts rule out only what the whole texts do."""
    import random

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            corner = 0
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
        return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0

    rng, seen = random.Random(3), set()
    for _ in range(1500):
        a = "".join(rng.choice("abcé\U0001f600 ") for _ in range(rng.choice([0, 1, 4, 30, 90])))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        b = "".join(b)
        ratio = plain(a, b)
        assert dedup.indel_ratio(a, b) == pytest.approx(ratio)
        near = dedup.Near(3, 92)
        near.add(7, dedup.Profile(a))
        assert near.find(10, dedup.Profile(b)) == near.find(10, dedup.Profile(b), first=True) == [7] * (ratio >= 92)
        seen.add(ratio >= 92)
        near.add(10, dedup.Profile(b))  # takes the place of 7
        assert list(near.known) == [10]
    assert seen == {True, False}


def test_near_mask_of_odd_texts(spark):
    """Nulls are near nothing; empty texts are near each other; a whole table of copies keeps one row."""
    rows = spark.createDataFrame([(1, None), (2, ""), (3, None), (4, ""), (5, "a" * 20_000), (6, "a" * 20_001)], "id long, t string")
    got = {r[0]: r[1] for r in dedup.near_mask(rows, "id", "t").collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False}
    assert dedup.near_mask(rows.where("id > 9"), "id", "t").count() == 0


def test_indel_ratio():
    assert dedup.indel_ratio("", "") == 100 and dedup.indel_ratio("abc", "abc") == 100 and dedup.indel_ratio("abc", "xyz") == 0
    assert round(dedup.indel_ratio("kitten", "sitting"), 4) == round(200 * 4 / 13, 4)


def test_splits(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("s"))
    out = splits.stratified(rows, "s", "id")
    counts = {(r.s, r.split): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert counts == {("a", "train"): 70, ("a", "val"): 15, ("a", "test"): 15, ("b", "train"): 630, ("b", "val"): 135, ("b", "test"): 135}
    assert sorted(r["count"] for r in splits.stratified_folds(rows, "s", "id").groupBy("s", "fold").count().collect()) == [20] * 5 + [180] * 5
    folds = splits.greedy_folds(rows.select((F.col("id") % 17).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y")), "g", "y")
    assert folds.count() == 17 and folds.select("fold").distinct().count() == 5


def test_metrics_on_known_values(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(rows, F.col("y") == 1, "s").first()[0] == pytest.approx(0.875)
    assert metrics.average_precision(rows, F.col("y") == 1, "s").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    one = rows.where("y = 1")
    assert metrics.roc_auc(one, F.col("y") == 1, "s").first()[0] is None
    assert metrics.per_class(spark.createDataFrame([("a", "b")], "t string, p string"), "t", "p").orderBy("class").select("f1").collect()[0][0] == 0.0


def test_quality(spark):
    df = spark.createDataFrame([("1",), ("x",), ("NaN",), ("-Infinity",), (None,)], "v string")
    r = quality.coercion(df, F.col("v")).first()
    assert (r.n_rows, r.n_numbers, r.n_coerced, r.total) == (5, 1, 3, 1.0)
    with pytest.raises(Exception, match="bad"):
        quality.require(df, F.col("v").isNotNull(), "bad").collect()
    assert features_ml.tfidf(spark.createDataFrame([(1, "aa bb aa"), (2, None)], "id int, t string"), "id", "t").count() == 4


def test_tfidf_shuffles_no_row(spark):
    texts = ["win a free prize now now", "free prize prize", None, "", "see you at lunch, see you", "x", "Free lunch"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = features_ml.tfidf(df, "id", "t", 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    frequencies = features_ml.term_frequencies(df, "id", "t")
    want = features_ml.tfidf(df, "id", "t", vocab=features_ml.vocabulary(frequencies, 7, 7))
    own, plain = ({(r.id, r.term): r.weight for r in x.collect()} for x in (got, want))
    assert own.keys() == plain.keys() and all(own[k] == pytest.approx(plain[k], abs=1e-12) for k in own) and len(own) > 7
    again = df.union(spark.createDataFrame([(0, "free lunch")], df.schema))  # rows of one key are one document
    weights = {r.term: r.weight for r in features_ml.tfidf(again, "id", "t").where("id = 0").collect()}
    assert sum(w * w for w in weights.values()) == pytest.approx(1) and {"free lunch", "free prize"} <= weights.keys()
    assert features_ml.tfidf(df.where("t is null"), "id", "t").count() == 0


def test_weeks(spark):
    days = {datetime.date(2026, 9, 3): None, datetime.date(2026, 9, 4): 1, datetime.date(2026, 9, 10): 1, datetime.date(2026, 9, 11): 2}
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert {r[0]: r[1] for r in df.select("d", activity.week_number(F.col("d"), "2026-09-04")).collect()} == days
    names = spark.createDataFrame([("  ANN  Lee ",), ("Bob ",), (None,)], "n string")
    assert [r[0] for r in names.select(activity.author(F.col("n"), {"ann lee": "Ann Lee"})).collect()] == ["Ann Lee", "Bob", None]


def _edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row = row, [i]
        for j, d in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def test_candidates_are_pairs_of_whole_texts(spark, tmp_path):
    texts = ["", "", "größe der straße", "grosse der strasse", "большой дом у реки", "большой дом у моря", "漢字仮名交じり文", "漢字仮名交り文章", "漢", "a", "🙂🙂🙂", "🙂🙃🙂", "one naïve text", "one naive text", None, "x" * 23, "x" * 27]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = set()
    for a, x in rows:
        for b, y in rows:
            if a < b and x is not None and y is not None and 100 * abs(len(x) - len(y)) <= 8 * (len(x) + len(y)) and 10 * _edits(x, y) <= 7 * max(len(x), len(y)):
                want.add((a, b, _edits(x, y)))
    got = catalogue.QUERIES["near_dup_candidates"](spark, str(tmp_path)).collect()
    assert (0, 1, 0) in want and (6, 7, 2) in want and sorted(tuple(r) for r in got) == sorted(want)
    con = pytest.importorskip("duckdb").connect()
    con.sql(f"create view benchmark as select * from read_parquet('{tmp_path}/benchmark.parquet/*.parquet') where text is not null")
    assert sorted(con.sql(catalogue.ORACLES["near_dup_candidates"]).fetchall()) == sorted(want)


def test_message_operators_over_documents(spark, tmp_path):
    import math

    texts = ["win a free prize now by phone", "see you at lunch on monday then", "win a free prize now by phones", "see you at lunch on monday them", "nothing alike here"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id: r.kept for r in catalogue.QUERIES["near_dup_mask_documents"](spark, str(tmp_path)).collect()}
    assert kept == {0: True, 1: True, 2: False, 3: False, 4: True}
    found = {r.term: r for r in catalogue.QUERIES["tfidf_top_terms_documents"](spark, str(tmp_path)).collect()}
    here = 1 / math.sqrt(5)  # three words and two pairs, each of this document alone
    assert found["alike"].n_docs == 1 and found["alike"].total_weight == pytest.approx(here, abs=1e-6) and found["free prize"].n_docs == 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 40), st.integers(1, 60)), min_size=1, max_size=8), st.integers(1, 6))
def test_dealing_in_rounds_is_dealing_one_by_one(kinds, folds):
    kinds = sorted({(n, min(ones, n)): m for n, ones, m in kinds}.items(), reverse=True)
    have, want = [[0, 0] for _ in range(folds)], {}
    for (n, ones), many in kinds:
        own = (n - ones, ones)
        for k in range(many):

            def spread(f, own=own):
                after = [[h[c] + (own[c] if j == f else 0) for c in (0, 1)] for j, h in enumerate(have)]
                mean = [Fraction(sum(h[c] for h in after), folds) for c in (0, 1)]
                return sum((h[c] - mean[c]) ** 2 for h in after for c in (0, 1)), sum(have[f])

            f = min(range(folds), key=spread)
            have[f][0] += own[0]
            have[f][1] += own[1]
            want[n, ones, k] = f
    runs = splits.deal([(n, ones, m) for (n, ones), m in kinds], folds)
    assert {(n, ones, k): taken[(k - first) % len(taken)] for n, ones, first, end, taken in runs for k in range(first, end)} == want


def test_many_small_groups_are_dealt_in_few_runs():
    runs = splits.deal([(10**6, 0, 1), (3, 1, 10**6), (1, 0, 10**9)], 5)
    assert len(runs) < 300 and sum(end - first for _, _, first, end, _ in runs) == 1 + 10**6 + 10**9


def test_columns_of_any_name(spark):
    names = ["row", "place", "total", "order", "salt", "rank", "before", "n", "_rank", "_salt", "_order", "part", "own", "found", "verdict", "threat_type", "confidence", "domain", "path", "_ok", "_hash", "_url"]
    rows = spark.range(30).select("id", (F.col("id") % 2).alias("s"), *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in names])
    registry = spark.createDataFrame([("h3", 1, 1, 90)], "threat_hash string, threat_type int, verdict int, confidence int")
    scanned = scan.scan(rows.withColumn("url", F.lit("http://a.example/x")), registry, F.concat(F.lit("h"), F.col("id").cast("string")))
    for out in (splits.stratified(rows, "s", "id"), splits.stratified_folds(rows, "s", "id"), sinks.numbered(rows, "number"), scanned):
        kept = [c for c in names if c not in scan.RESPONSE]
        assert out.count() == 30 and all(r[c] == f"{c}{r.id}" for r in out.collect() for c in kept)
    assert [r.id for r in scanned.where("blockchain_found").collect()] == [3]


def test_cumulated_and_quantiles(spark):
    rng = np.random.default_rng(3)
    values = [(k % 3 or None, float(x)) for k, x in enumerate(rng.choice([0.5, 0.50001, 0.50002, 7.0, -3.0, 1e6], 500))] + [(1, None)]
    rows = spark.createDataFrame(values, "g int, x double")
    found = {r["class"]: (r.a, r.b) for r in profile.quantiles(rows, ["x"], {"a": 0.25, "b": 0.9}, F.col("g")).collect()}
    for g in (None, 1, 2):
        own = [x for c, x in values if c == g and x is not None]
        assert found[g] == pytest.approx(tuple(np.quantile(own, [0.25, 0.9])))
    counts = rows.where("x is not null").groupBy("g", "x").agg(F.count("*").alias("n"))
    for r in sinks.cumulated(counts, ["g"], "x", ["n"], descending=True).collect():
        assert r.n_to == sum(c == r.g and x is not None and x >= r.x for c, x in values)
    assert profile.quantiles(rows.limit(0), ["x"], {"a": 0.5}).count() == 0
    close = spark.createDataFrame([(k % 2, 0.5 + k * 1e-9) for k in range(200)] + [(1, 1e9)], "y int, s double")
    want = sum((a > b) + (a == b) / 2 for y, a in close.collect() if y for z, b in close.collect() if not z) / (101 * 100)
    assert metrics.roc_auc(close, F.col("y") == 1, "s").first()[0] == pytest.approx(want)
    assert sinks.discard(spark) > 0 and sinks.discard(spark) == 0


def test_registry_get_and_events(spark):
    registry = spark.createDataFrame([("a", 1, 1, 90)], "threat_hash string, threat_type int, verdict int, confidence int")
    rows = spark.createDataFrame([(1, "a"), (2, "a")], "k int, threat_hash string")
    assert [tuple(r) for r in reg.get(rows, registry).orderBy("k").select("k", "confidence").collect()] == [(1, 90), (2, 90)]
    for bad in ("b", None):
        with pytest.raises(Exception, match="ThreatNotFound"):
            reg.get(spark.createDataFrame([(1, "a"), (2, bad)], "k int, threat_hash string"), registry).collect()
    batch = spark.createDataFrame([(1, "a", 1, 1, 5, "me"), (2, "b", 1, 1, 5, "me"), (3, "b", 1, 0, 6, "me"), (4, "c", 0, 2, 5, "me")], "seq int, threat_hash string, threat_type int, verdict int, confidence int, submitter string")
    log = reg.events(reg.guarded_insert(registry, batch, "me"), F.col("seq")).collect()
    assert [tuple(r) for r in log] == [("ThreatSubmitted", "b", 1, 1, 5, 2, "me")]


def test_url_cleaning(spark):
    rows = [(1, "f1", "http://a/", 1.0, " a "), (2, "f2", " http://a/", 0.0, "a"), (3, "f3", "http://a/", 0.0, "a"), (4, "f4", None, 1.0, "b"), (5, "f5", "http://c/", None, "c")]
    df = spark.createDataFrame(rows, "row int, FILENAME string, URL string, label double, Domain string")
    out = quality.clean_urls(df, "row")
    assert out.columns == ["row", "URL", "label", "Domain"] and sorted(tuple(r) for r in out.collect()) == [(1, "http://a/", 1, "a"), (2, "http://a/", 0, "a")]
    assert quality.clean_urls(df.drop("FILENAME", "Domain"), "row").columns == ["row", "URL", "label"]
    with pytest.raises(Exception, match="neither 0 nor 1"):
        quality.clean_urls(df.withColumn("label", F.lit(2)), "row").collect()
    assert quality.clean_urls(df.limit(0), "row").count() == 0


def test_days_to_date(spark):
    d = lambda k: datetime.date(2026, 9, k)
    rows = [("a", 1, d(4)), ("a", 1, d(4)), ("a", 2, d(11)), ("b", 2, d(12)), ("a", 4, d(25)), ("a", 4, d(26))]
    df = spark.createDataFrame([(*r, 2, 1, True) for r in rows], "author string, week int, day date, added int, deleted int, is_commit boolean")
    got = {(r.author, r.week): (r.commits, r.active_days, r.net) for r in activity.cumulative_contributions(df).collect()}
    assert got == {("a", 1): (2, 1, 2), ("a", 2): (3, 2, 3), ("b", 2): (1, 1, 1), ("a", 4): (5, 4, 5)}


def test_remaining_readers_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x, \"y\"", None), (2, "line\nbreak", 0.5)], "k int, t string, v double")
    sinks.write_csv(rows, str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in back.collect()) == [("1", 'x, "y"', None), ("2", "line\nbreak", "0.5")] and readers.header(spark, str(tmp_path / "c")) == ["k", "t", "v"]
    assert {f.dataType.simpleString() for f in readers.read_experiments(spark, str(tmp_path / "c")).schema} == {"int", "string", "double"}
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).orderBy("k").select("t").first()[0] == 'x, "y"'
    scans = scan.scan(spark.createDataFrame([("http://a.example/login",)], "url string"), None).withColumn("n", F.lit(1))
    kept = scan.history(scans, "n").drop("id")
    for _ in range(2):
        sinks.append_scans(kept, str(tmp_path / "h"))
    stored = readers.read_history(spark, str(tmp_path / "h"))
    assert stored.select("id").distinct().count() == 2 and stored.first().findings[0] == "URL is not using HTTPS"
    path = str(tmp_path / "r")
    rows.write.parquet(path)
    sinks.replace_table(sinks.upsert(spark.read.parquet(path), rows.where("k = 2").withColumn("v", F.lit(9.0)), "k"), path)
    assert [r.v for r in spark.read.parquet(path).orderBy("k").collect()] == [None, 9.0]
    assert quality.numeric_columns(rows) == ["k", "v"] and quality.type_histogram(rows) == {"int": 1, "string": 1, "double": 1}
    log = tmp_path / "long.txt"
    log.write_text("\r\n".join(f"line {k}" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = readers.read_git_log(spark, str(log))
        assert lines.count() == 5000 and lines.where("line <> concat('line ', line_no)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("place", ["ml.scored", "profile.labelled"])
def test_labelled_numbers_are_taken_before_the_join(spark, place):
    """Before, texts went through the join and were shuffled wherever the labels weren't broadcast."""
    from threatquery.plans import ml, profile as plans

    made = {"ml.scored": ml.scored, "profile.labelled": plans.labelled}[place](spark, "/root/testdata/sf0.001")
    join = made.select("doc_id", *[c for c in ("n_text", "n_words", "n_marks", "is_en") if c in made.columns])._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().head()
    assert "n_text" in (carried := join.left().output().mkString(" ")) and "text#" not in carried.replace("n_text#", "")
