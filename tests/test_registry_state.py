"""Ownership, numbers, versions, early stops and guards against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatquery.functions import urls
from threatquery.operators import activity, ownership, profile, registry as reg
from threatquery.sources import sinks
from threatquery.sources.versions import Versioned
from threatquery.streaming import scan_stream as stream

CALL = "seq long, kind string, caller string, new_owner string"
BATCH = "seq long, threat_hash string, threat_type int, verdict int, confidence int, submitter string"


def plain_owners(calls, owner):
    out = []
    for seq, kind, caller, new in sorted(calls):
        reason = "NotOwner" if caller != owner else "ZeroAddress" if kind == "transfer" and new in (None, ownership.ZERO_ADDRESS) else None
        out.append((seq, owner, reason))
        if kind == "transfer" and reason is None:
            owner = new
    return out


def made_calls(n, seed):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "c", "d", None]
    return [(int(k), str(rng.choice(["insert", "transfer"])), names[rng.integers(5)], [*names, ownership.ZERO_ADDRESS][rng.integers(6)]) for k in rng.permutation(n)]


@pytest.mark.parametrize("seed", range(3))
def test_owners_are_the_sequential_ones(spark, seed):
    calls = made_calls(400, seed)
    got = ownership.owners(spark.createDataFrame(calls, CALL).repartition(3), "a").collect()
    assert sorted(tuple(r) for r in got) == plain_owners(calls, "a") and len({r.owner for r in got}) == 4
    log = ownership.transfers(spark.createDataFrame([tuple(r) for r in got], "seq long, owner string, reason string"), spark.createDataFrame(calls, CALL)).collect()
    kinds = {c[0]: c for c in calls}
    assert sorted((r.seq, r.previous_owner, r.new_owner) for r in log) == [(s, o, kinds[s][3]) for s, o, why in plain_owners(calls, "a") if why is None and kinds[s][1] == "transfer"]


def test_a_range_maps_owners():
    rng = np.random.default_rng(2)
    for _ in range(300):
        calls = [(None if rng.random() < 0.1 else "abcdef"[rng.integers(6)], ["a", "b", "c", "d", "e", "f", None, ownership.ZERO_ADDRESS][rng.integers(8)]) for _ in range(int(rng.integers(0, 15)))]
        found = ownership.moved(calls)
        for start in "abcdefg":
            owner = start
            for caller, new in calls:
                if caller == owner and new not in (None, ownership.ZERO_ADDRESS):
                    owner = new
            assert found.get(start, start) == owner


def test_ownership_edges(spark):
    none = spark.createDataFrame([], CALL)
    assert ownership.owners(none, "a").count() == 0
    batch = spark.createDataFrame([(1, "h1", 1, 1, 5, "a"), (3, "h2", 1, 1, 5, "a"), (5, "h3", 1, 1, 5, "b"), (6, "h4", 1, 1, 5, None)], BATCH)
    calls = spark.createDataFrame([(2, "transfer", "a", "b"), (4, "transfer", "b", ownership.ZERO_ADDRESS)], CALL)
    got = {r.seq: r.reason for r in ownership.guarded_insert(none.selectExpr("caller as threat_hash"), batch, calls, "a").collect()}
    assert got == {1: None, 3: "NotOwner", 5: None, 6: "NotOwner"}


def test_guards_take_no_nulls(spark):
    rows = [(1, "a", 1, 1, 5, None), (2, None, 1, 1, 5, "me"), (3, "b", 1, None, 5, "me"), (4, "c", 1, 1, None, "me"), (5, "d", 1, 0, 100, "me"), (6, "d", 1, None, 1, "me"), (7, None, None, None, None, None)]
    out = reg.guarded_insert(spark.createDataFrame([(None,)], "threat_hash string"), spark.createDataFrame(rows, BATCH), "me")
    assert {r.seq: r.reason for r in out.collect()} == {1: "NotOwner", 2: "ZeroHash", 3: "InvalidVerdict", 4: "ConfidenceOutOfRange", 5: None, 6: "DuplicateHash", 7: "NotOwner"}


def test_lookup_keeps_one_row(spark):
    registry = spark.createDataFrame([("a", 1, 1, 50), ("a", 0, 1, 99), ("a", 1, 1, 50), (None, 1, 1, 1)], "threat_hash string, threat_type int, verdict int, confidence int")
    got = reg.lookup(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, threat_hash string"), registry).collect()
    assert sorted((r.k, r.found, r.confidence) for r in got) == [(1, True, 99), (2, False, None), (3, False, None)]


def test_seeding_with_a_limit_reads_no_further(spark, monkeypatch):
    monkeypatch.setattr(reg, "FIRST_RANGE", 2)
    rows = spark.range(1000).select("id", F.concat(F.lit("u"), F.floor(F.col("id") / 3).cast("string")).alias("url"), F.when(F.col("id") % 4 == 1, "legitimate").otherwise("phishing").alias("label"))

    def hashed(c):
        late = F.regexp_extract(c, "[0-9]+", 0).cast("int") > 30
        return F.when(late, F.raise_error("hashed too late").cast("string")).otherwise(F.md5(c.cast("binary")))

    some = reg.classified(rows, "url", "label", "id", hashed, reg.URL, limit=5)
    found = reg.seeds(some, reg.URL, 5).select("source_row").collect()
    assert [r[0] for r in found] == [0, 3, 6, 10, 12]
    assert reg.statistics(some, reg.URL, 5).first().total_records == 13
    whole = reg.classified(rows.where("id < 40"), "url", "label", "id", hashed, reg.URL)
    assert reg.statistics(whole, reg.URL, 5).first() == reg.statistics(some, reg.URL, 5).first()
    few = reg.classified(rows.where("id < 7"), "url", "label", "id", hashed, reg.URL, limit=50)
    assert reg.seeds(few, reg.URL, 50).count() == 3
    assert reg.seeds(reg.classified(rows.limit(0), "url", "label", "id", hashed, reg.URL, limit=5), reg.URL, 5).count() == 0


def test_a_break_before_the_swap_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    table = Versioned(spark, str(tmp_path / "t"))
    assert table.read() is None
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert table.replace(old) == 0 and table.upsert(spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), "k") == 1
    rows = lambda: sorted(tuple(r) for r in table.read().collect())
    assert rows() == [(1, "x"), (2, "z"), (3, "w")]
    monkeypatch.setattr(Versioned, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        table.replace(old.where("k = 1"))
    assert rows() == [(1, "x"), (2, "z"), (3, "w")]
    monkeypatch.undo()
    other = Versioned(spark, table.path)
    name = other._write(old)
    table.replace(old.where("k = 1"))
    with pytest.raises(Exception, match="(?i)exist"):
        other._commit(name, 2)  # the other writer was first
    assert rows() == [(1, "x")] and table.versions() == [1, 2]
    assert table.append_or_replace(old.where("k = 2")) == "append" and rows() == [(1, "x"), (2, "y")]
    assert table.append_or_replace(old.select("v")) == "overwrite" and table.read().columns == ["v"]


def test_numbers_have_no_gap_and_no_repeat(spark, tmp_path):
    def put(k, rows):
        spark.createDataFrame(rows, BATCH).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))

    def run(checkpoint="c", wait=True):
        batches = spark.readStream.schema(BATCH).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stream.numbered_inserts(batches, str(tmp_path / "out"), str(tmp_path / checkpoint), "me").awaitTermination()
        return sorted((r.nonce, r.threat_hash, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(0, [(2, "b", 1, 1, 5, "me"), (1, "a", 1, 1, 5, "me"), (3, "a", 1, 1, 5, "me"), (4, "c", 1, 1, 5, "eve")])
    assert run() == [(0, "a", 1), (1, "b", 2)]
    put(1, [(6, "c", 1, 1, 5, "me"), (5, "b", 1, 1, 5, "me"), (7, "d", 1, 1, 5, "me")])
    want = [(0, "a", 1), (1, "b", 2), (2, "c", 6), (3, "d", 7)]
    assert run() == want
    commit = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commit.unlink()  # the last batch was written, but its commit was lost: it runs again
    (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
    assert run() == want
    put(2, [(8, "e", 1, 1, 5, "me")])
    assert run() == [*want, (4, "e", 8)]


def test_owners_pass_from_batch_to_batch(spark, tmp_path):
    calls = made_calls(60, 9)
    for k in range(3):
        own = [c for c in calls if c[0] // 20 == k]
        spark.createDataFrame(own, CALL).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        live = spark.readStream.schema(CALL).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stream.owned_inserts(live, str(tmp_path / "out"), str(tmp_path / "c"), "a").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "decided")).select("seq", "owner", "reason").collect()
    assert sorted(tuple(r) for r in got) == plain_owners(calls, "a")


@pytest.mark.parametrize("bins", [40, 7])
def test_histogram_is_the_usual_one(spark, bins):
    rng = np.random.default_rng(1)
    groups = {"a": rng.integers(0, 300, 500) / 10, "b": np.array([3.0, 3.0]), "c": np.arange(41) * 0.1, "d": rng.normal(size=200) * 1e6}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("e", None), (None, 1.0), ("a", float("nan"))]
    got = {}
    for r in profile.histogram(spark.createDataFrame(rows, "g string, x double"), "g", "x", bins).orderBy("g", "bin").collect():
        got.setdefault(r.g, []).append(r)
    assert set(got) == set(groups)
    for g, v in groups.items():
        n, edges = np.histogram(v, bins)
        assert [r.n for r in got[g]] == n.tolist() and [r.bin for r in got[g]] == list(range(bins))
        assert [r.low for r in got[g]] + [got[g][-1].high] == pytest.approx(edges.tolist())


def test_url_features_need_the_column(spark):
    df = spark.createDataFrame([("http://bit.ly/a/b", 1), ("https://x.example/login", 2)], "URL string, label int")
    got = urls.with_engineered(df).orderBy("label").collect()
    assert [(r.IsURLShortener, r.URLDepth, r.HasSuspiciousKeyword) for r in got] == [(1, 2, 0), (0, 1, 1)] and got[0].URL == "http://bit.ly/a/b"
    with pytest.raises(ValueError, match="URL"):
        urls.with_engineered(df.withColumnRenamed("URL", "link"))


def test_scratch_goes(spark):
    with sinks.Scratch(spark, "gone") as scratch:
        assert scratch.write(spark.range(3), "x").count() == 3 and sinks.exists(spark, scratch.root)
    assert not sinks.exists(spark, scratch.root)


def test_weeks_without_rows_are_there(spark):
    rows = spark.createDataFrame([("2024-01-05",), ("2024-01-11",), ("2024-01-26",), (None,)], "d string").select(F.to_date("d").alias("d"))
    got = [(r.week, str(r.week_start), str(r.week_end), r.n) for r in activity.weeks_of(rows, "d").orderBy("week").collect()]
    assert got == [(1, "2024-01-05", "2024-01-11", 2), (2, "2024-01-12", "2024-01-18", 0), (3, "2024-01-19", "2024-01-25", 0), (4, "2024-01-26", "2024-02-01", 1)]
    assert activity.weeks_of(rows.where("d is null"), "d").count() == 0
