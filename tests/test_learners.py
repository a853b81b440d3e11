"""Second-order boosting and the text machine against plain forms."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatquery.operators import boosting, features_ml, lemmas, models, text_margin
from threatquery.plans import catalogue

NAMES = ["a", "b", "c"]


def table(spark, x, y, w=None):
    rows = [(float(t), float(1 if w is None else w[k]), *[None if np.isnan(u) else float(u) for u in v]) for k, (t, v) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "label double, w double, a double, b double, c double")


def plain_boosting(x, y, w, keys, rounds, depth, step, row_share, column_share, reg):
    """Trees by recursion over sorted values, in doubles."""
    margin, d = np.zeros(len(y)), x.shape[1]
    for turn in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * w, p * (1 - p) * w
        features = boosting.chosen(turn, d, column_share, boosting.SEED)
        add = np.zeros(len(y))

        def node(sample, every, level):
            best = (boosting.LEAST_GAIN, None, None)
            whole = g[sample].sum(), h[sample].sum()
            for f in features if level < depth else []:
                for cut in np.unique(x[:, f])[:-1]:
                    left = sample[x[sample, f] <= cut]
                    a, b = g[left].sum(), h[left].sum()
                    if b >= 1 and whole[1] - b >= 1:
                        gain = a**2 / (b + reg) + (whole[0] - a) ** 2 / (whole[1] - b + reg) - whole[0] ** 2 / (whole[1] + reg)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
            if best[1] is None:
                add[every] = -step * whole[0] / (whole[1] + reg)
                return
            _, f, cut = best
            for side in (lambda v: v <= cut, lambda v: v > cut):
                node(sample[side(x[sample, f])], every[side(x[every, f])], level + 1)

        node(np.flatnonzero(boosting.sampled(keys, turn, row_share)), np.arange(len(y)), 0)
        margin = margin + add
    return margin


@pytest.mark.parametrize("refresh", [boosting.REFRESH, 2])
def test_boosting_against_a_plain_form(spark, monkeypatch, refresh):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=200), rng.integers(0, 9, 200), rng.normal(size=200) * 100])
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 4)).astype(float)
    w = rng.choice([1.0, 2.0], 200)
    x[::17, 0] = np.nan
    train = table(spark, x, y, w)
    monkeypatch.setattr(boosting, "REFRESH", refresh)
    monkeypatch.setattr(boosting, "BLOCK", 64 if refresh == 2 else 1 << 14)  # several tasks and blocks
    model = boosting.fit(train, NAMES, weight="w", rounds=7)
    full = x.copy()
    full[np.isnan(full[:, 0]), 0] = np.nanmedian(x[:, 0])
    keyed = spark.createDataFrame([(*map(float, (y[k], w[k])), *map(float, full[k])) for k in range(200)], "y double, weight double, x0 double, x1 double, x2 double")
    keys = np.array([r[0] for r in keyed.select(F.xxhash64(F.lit(boosting.SEED), "y", "weight", "x0", "x1", "x2")).collect()], np.int64)
    want = plain_boosting(full, y, w, keys, 7, 6, 0.1, 0.8, 0.8, 1.0)
    assert np.abs(model.margins(full) - want).max() < 1e-9
    out = model.transform(train).select("margin", "probability", "prediction", "label").collect()
    assert sorted(r.margin for r in out) == pytest.approx(sorted(want), abs=1e-9)
    assert np.mean([r.prediction == r.label for r in out]) > 0.9 and all(r.probability == pytest.approx(1 / (1 + math.exp(-r.margin))) for r in out)


def test_boosting_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(150, 3)).round(1), rng.integers(0, 2, 150)
    train = table(spark, x, y)
    one, two = (boosting.fit(df, NAMES, rounds=4) for df in (train.coalesce(1), train.repartition(7)))
    for a, b in zip(one.trees, two.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.value == b.value).all()


def test_a_round_is_one_job_and_gives_the_same_trees(spark, monkeypatch):
    """However many batches, rows of one block are one block; of several, no level needs a job of its own."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(300, 3)).round(1), rng.integers(0, 2, 300)
    train = table(spark, x, y)
    many, count = boosting.totals, []
    monkeypatch.setattr(boosting, "totals", lambda *a: count.append(1) or many(*a))
    monkeypatch.setattr(boosting, "BLOCK", 64)
    cells = boosting.fit(train, NAMES, rounds=5)
    assert len(count) == 5
    monkeypatch.setattr(boosting, "CELLS", 0)
    levels = boosting.fit(train, NAMES, rounds=5)
    assert len(count) > 15
    monkeypatch.setattr(boosting, "BLOCK", 1 << 14)
    monkeypatch.setattr(boosting, "totals", None)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "70")
    try:
        one = boosting.fit(train, NAMES, rounds=5)
    finally:
        spark.conf.set(name, before)
    for a, b, c in zip(cells.trees, levels.trees, one.trees, strict=True):
        assert all((getattr(a, k) == getattr(t, k)).all() for t in (b, c) for k in ("feature", "cut", "value"))


def test_boosting_edges(spark):
    x, y = np.array([[1.0, 2, np.nan]] * 6), np.array([1.0] * 6)
    model = boosting.fit(table(spark, x, y), NAMES, rounds=2)
    assert [int((t.feature >= 0).sum()) for t in model.trees] == [0, 0] and model.margins(np.zeros((1, 3)))[0] > 0
    empty = boosting.fit(table(spark, x, y).limit(0), NAMES, rounds=2)
    assert empty.transform(table(spark, x, y)).agg(F.max("margin")).first()[0] == 0
    many = boosting.edges(spark.range(5000).select(F.col("id").cast("double").alias("v"), F.lit(1.0).alias("u")), ["v", "u"], 16)
    assert len(many[0]) <= 16 and len(many[1]) == 0 and np.abs(np.diff(many[0]) - 312.5).max() < 5


def test_queries_fit_the_whole_models(spark, monkeypatch):
    seen = {}

    def record(name):
        def stop(train, *_, **settings):
            seen[name] = settings
            raise RuntimeError

        return stop

    monkeypatch.setattr(boosting, "fit", record("boosting"))
    monkeypatch.setattr(text_margin, "fit", record("text"))
    for name in ("boosted_predictions", "text_svc_predictions"):
        with pytest.raises(RuntimeError):
            catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == {"boosting": {}, "text": {}} and boosting.ROUNDS == 300


def test_texts_are_gone_over_few_times(spark):
    """Not once for each of the steps of a fit."""
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    look = F.udf(look, "string").asNondeterministic()
    rows = spark.createDataFrame([(k, f"word{k % 5} cars car alerts", "ab"[k % 2]) for k in range(40)], "id long, t string, c string").withColumn("t", look("t"))
    models.fit_text(rows, "t", "c", models.logistic(40, 3))
    assert 0 < seen.value <= 80
    seen.value = 0
    assert lemmas.lemmatized(rows.select("id", F.split("t", " ").alias("w")), "id", "w").count() == 40
    assert 0 < seen.value <= 40
    seen.value = 0
    numbers = rows.select("id", (F.col("id") % 2).cast("double").alias("label"), F.length("t").cast("double").alias("a"))
    assert models.cross_validate(numbers, ["a"], lambda n: models.logistic(n, 2), "id", folds=2, scaled=True).count() == 1
    assert 0 < seen.value <= 80


TOPICS = {"pay": "verify your account payment card bank", "prize": "win a free prize claim now winner", "parcel": "your parcel is waiting customs fee", "chat": "see you at lunch tomorrow dear", "work": "remote job offer salary apply today"}


def messages(seed=2, n=160):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        c = list(TOPICS)[min(int(rng.integers(0, 8)), 4)]
        words = list(rng.choice(TOPICS[c].split(), 6)) + list(rng.choice(" ".join(TOPICS.values()).split(), 4))
        rows.append((k, " ".join(words) + (" http://bit.ly/x URGENT $5" if rng.random() < 0.2 else ""), c))
    return [*rows, (n, None, "chat"), (n + 1, "", "pay"), (n + 2, "unlabelled words", None)]


@pytest.mark.parametrize(("classes", "most"), [(5, None), (5, 40), (2, 25)])
def test_text_machine_is_at_its_least(spark, monkeypatch, classes, most):
    monkeypatch.setattr(text_margin, "BLOCK", 32)
    rows = [r for r in messages() if r[2] in [*list(TOPICS)[:classes], None]]
    df = spark.createDataFrame(rows, "id long, t string, c string").repartition(3)
    model = text_margin.fit(df, "t", "c", most)
    known = [r for r in rows if r[2]]
    terms = []
    for _, t, _ in known:
        w = re.findall(r"\w\w+", (t or "").lower())
        terms.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    total, df_of = sum(terms, Counter()), Counter(x for t in terms for x in t)
    vocabulary = sorted(sorted(total, key=lambda x: (-total[x], x))[:most])
    assert list(model.vectors.place) == vocabulary
    x = np.array([[t[v] * (math.log((1 + len(known)) / (1 + df_of[v])) + 1) for v in vocabulary] for t in terms])
    x = x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300)
    from threatquery.functions.text import handcrafted

    hand = {r.id: r.h for r in df.select("id", handcrafted(F.col("t")).alias("h")).collect()}
    hand = np.array([hand[r[0]] for r in known])
    x = np.column_stack([x, hand / np.where(hand.max(0) > 0, hand.max(0), 1), np.ones(len(known))])
    names = sorted({r[2] for r in known})
    y = np.array([names.index(r[2]) for r in known])
    for k in range(len(names)):
        sign = np.where(y == k, 1, -1)
        own = np.array([len(y) / (len(names) * (y == j).sum()) for j in y]) if classes == 2 else np.where(y == k, len(y) / (len(names) * (y == k).sum()), 1)
        slack = np.maximum(0, 1 - sign * (x @ model.weights[k]))
        assert np.abs(model.weights[k] - 2 * (x * (own * sign * slack)[:, None]).sum(0)).max() < 1e-5  # the gradient
    out = {r.id: r.predicted for r in model.transform(df, "t").collect()}
    assert len(out) == len(rows) and [out[r[0]] for r in known] == [names[k] for k in np.argmax(x @ model.weights.T, 1)]
    assert np.mean([out[r[0]] == r[2] for r in known]) > 0.8


def test_text_machine_steps_in_tasks_and_in_jobs(spark, monkeypatch):
    """A class with few rows inside the margin is one task, not a job for each product; both ways give the same steps."""
    monkeypatch.setattr(text_margin, "BLOCK", 32)
    df = spark.createDataFrame(messages(n=90), "id long, t string, c string")
    products, own = [], text_margin.curvature

    def seen(active, way):
        products.append(int(way.any(1).sum()))
        return own(active, way)

    monkeypatch.setattr(text_margin, "curvature", seen)
    inner = text_margin.fit(df, "t", "c", 15, tolerance=1e-2)
    assert not products
    monkeypatch.setattr(text_margin, "HELD", 0)
    outer = text_margin.fit(df, "t", "c", 15, tolerance=1e-2)
    assert products
    assert np.abs(inner.weights - outer.weights).max() < 1e-8
    found = df.select(*text_margin.inputs(F.col("t")), "id", "c")
    again = text_margin.fit(found, None, "c", 15, tolerance=1e-2)
    assert np.abs(inner.weights - again.weights).max() < 1e-8
    a, b = ({r.id: r.predicted for r in x.collect()} for x in (inner.transform(df, "t"), again.transform(found, None)))
    assert a == b and len(a) == 93


def test_terms_are_counted_by_batch(spark):
    rows = [["a b", "a b", "c"], [], ["c", "d"], None, ["c"]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "id int, t array<string>").repartition(2)
    found = {r.term: (r.df, r.total) for r in features_ml.totals(df, "t").collect()}
    assert found == {"a b": (1, 2), "c": (3, 3), "d": (1, 1)}


def test_frequent_terms_are_those_of_all_totals(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, [f"w{x}" for x in rng.zipf(1.3, 30) % (40 + 60 * (k // 50))]) for k in range(200)]  # parts differ
    spark.createDataFrame([*rows, (-1, []), (-2, None)], "id int, t array<string>").repartitionByRange(6, "id").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    own = sorted(((-r.total, r.term, r.df) for r in features_ml.totals(df, "t").collect()))
    for most in (1, 7, 50, 1000):
        assert [(-r.total, r.term, r.df) for r in features_ml.frequent(df, "t", most).collect()] == own[:most]


def test_text_machine_edges(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x")], "id long, t string, c string")
    assert {r.predicted for r in text_margin.fit(df, "t", "c").transform(df, "t").collect()} == {"x"}
    with pytest.raises(ValueError, match="no labelled rows"):
        text_margin.fit(df.where("c is null"), "t", "c")
