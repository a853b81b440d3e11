from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from threatquery.operators import attribution, margin, models, text_margin
from threatquery.plans import catalogue


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    return spark.range(120).select(k, (k % 2).cast("double").alias("label"), F.when(k % 10 != 0, (k % 2) * 3.0 + (k % 7) / 10).alias("x"), (k % 5).cast("double").alias("y"))


@pytest.mark.parametrize(("estimator", "scaled"), [(lambda n: models.logistic(n, 50), True), (lambda n: models.linear_svc(n, 20), True), (lambda n: models.random_forest(5), False), (lambda n: models.boosted(3), False)])
def test_classifiers_beat_the_majority(rows, estimator, scaled):
    out = models.fit(rows, ["x", "y"], estimator(120), scaled).transform(rows)
    assert out.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.85
    by = {r.label: r.s for r in out.withColumn("s", models.score(out)).groupBy("label").agg(F.avg("s").alias("s")).collect()}
    assert by[0.0] > by[1.0]


def test_save_and_load(rows, tmp_path):
    model = models.fit(rows, ["x"], models.logistic(120, 20), True)
    models.save(model, str(tmp_path / "m"))
    a, b = (m.transform(rows).orderBy("id").select("prediction").collect() for m in (model, models.load(str(tmp_path / "m"))))
    assert a == b


def test_text_model(spark):
    texts = [(k, "win a free prize now" if k % 3 == 0 else "see you at lunch" if k % 3 == 1 else "verify the account", ["prize", "none", "pay"][k % 3]) for k in range(60)]
    df = spark.createDataFrame(texts, "id long, t string, c string")
    out = models.fit_text(df, "t", "c", models.logistic(60, 20)).transform(models.text_columns(df, "t"))
    assert out.where("predicted = c").count() == 60


def test_text_model_of_written_inputs(spark):
    """The same model from the columns that the queries write once, so that fit and predictions don't go over the texts again."""
    texts = [(k, ["win a free prize now", "see you at lunch", "verify the account"][k % 3], ["prize", "none", "pay"][k % 3]) for k in range(30)]
    df = spark.createDataFrame(texts, "id long, t string, c string")
    found = df.select("id", "c", *text_margin.inputs(F.col("t")))
    out = models.fit_text(found, None, "c", models.logistic(30, 20)).transform(models.text_columns(found, None))
    assert out.where("predicted = c").count() == 30


def test_linear_shap_adds_up(rows):
    found = {r.feature: r for r in models.linear_shap(rows.na.fill(0.0), ["x", "y"], {"x": 2.0, "y": 0.0}, {"x": 1.0, "y": 2.0}).collect()}
    assert found["y"].mean_abs == 0 and found["x"].signed == pytest.approx(2 * (rows.na.fill(0.0).agg(F.avg("x")).first()[0] - 1))


class _Fitted(Exception):
    pass


@pytest.mark.parametrize(
    ("name", "fit", "setting", "value"),
    [("rf_predictions", "fit", "numTrees", 300), ("gbt_predictions", "fit", "maxIter", 300), ("lr_predictions", "fit", "maxIter", 1000), ("text_lr_predictions", "fit_text", "maxIter", 5000), ("cv_scores", "fit", "maxIter", 1000)],
)
def test_queries_fit_the_whole_model(spark, monkeypatch, name, fit, setting, value):
    """The sizes and iterations of the reference reach the fit."""

    def record(train, columns, *rest, **_):
        estimator = next(x for x in rest if hasattr(x, "fit"))
        raise _Fitted(estimator.getOrDefault(setting))

    monkeypatch.setattr(models, fit, record)
    with pytest.raises(_Fitted) as found:
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.value.args == (value,)


def test_linear_shap_of_a_fitted_model(spark, rows):
    model = models.fit(rows, ["x", "y"], models.logistic(120, 50), True)
    weights, means = models.linear_terms(model, ["x", "y"])
    out = model.transform(rows)
    filled = out.select(*[F.col(f"{c}_filled").alias(c) for c in ("x", "y")])
    found = models.linear_shap(filled, ["x", "y"], weights, means).agg(F.sum("signed")).first()[0]
    margin = out.agg(F.avg(vector_to_array("rawPrediction")[0])).first()[0]
    assert found == pytest.approx(margin + model.stages[-1].intercept, abs=1e-6) and weights["x"] < 0
    ranked = catalogue.QUERIES["linear_shap_ranking_fitted"](spark, "/root/testdata/sf0.001").collect()
    assert len(ranked) == 3 and ranked[0].mean_abs >= ranked[1].mean_abs >= ranked[2].mean_abs > 0


def test_squared_hinge_is_at_its_least(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2)) * [1, 50] + [0, 400]
    y = (x[:, 0] + (x[:, 1] - 400) / 100 + rng.normal(size=300) * 0.7 > 0.6).astype(float)
    rows = [(float(b), float(a[0]), float(a[1]) if k % 9 else None) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    model = margin.fit(spark.createDataFrame(rows, "label double, a double, b double"), ["a", "b"])
    b = np.array([r[2] if r[2] is not None else np.nan for r in rows])
    b[np.isnan(b)] = np.nanmedian(b)
    z = np.column_stack([(v - v.mean()) / v.std() for v in (x[:, 0], b)] + [np.ones(300)])
    scale, middle = np.array([x[:, 0].std(), b.std()]), np.array([x[:, 0].mean(), b.mean()])
    own = np.array([model.weights["a"], model.weights["b"]])
    w = np.append(own * scale, model.bias + own @ middle)
    sign, weight = 2 * y - 1, np.where(y == 1, 150 / y.sum(), 150 / (300 - y.sum()))
    slack = np.maximum(0, 1 - sign * (z @ w))
    assert np.abs(w - 2 * (z * (weight * sign * slack)[:, None]).sum(0)).max() < 1e-5  # the gradient
    out = model.transform(spark.createDataFrame(rows, "label double, a double, b double"))
    assert out.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.7
    assert out.select(models.score(out)).first()[0] == -out.first().margin


def test_scaling_is_by_the_population(rows):
    out = models.fit(rows, ["x", "y"], models.logistic(120, 20), True).transform(rows).select(vector_to_array("features").alias("f"))
    got = out.agg(*[F.stddev_pop(F.col("f")[k]) for k in (0, 1)]).first()
    assert tuple(got) == (pytest.approx(1), pytest.approx(1))


def test_tree_attributions_are_shapley_values(spark):
    """Against the definition, over all coalitions, with MLlib's own margins."""
    rng = np.random.default_rng(6)
    names = ["a", "b", "c"]
    x = rng.integers(0, 8, (160, 3)).astype(float)
    y = ((x[:, 0] > 3) ^ (x[:, 1] > 4)).astype(float)
    frame = lambda values: spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(values)], "id long, a double, b double, c double")
    train = spark.createDataFrame([(float(t), *map(float, v)) for t, v in zip(y, x, strict=True)], "label double, a double, b double, c double")
    gbt = models.fit(train, names, models.boosted(4)).stages[-1]
    some, behind = x[:6], x[100:107]
    got = {r.id: r for r in attribution.tree_shap(frame(some), frame(behind), gbt, names, "id").collect()}
    sets = [s for n in range(4) for s in combinations(range(3), n)]
    made = np.array([[v[f] if f in s else z[f] for f in range(3)] for v in some for s in sets for z in behind])
    from pyspark.ml.feature import VectorAssembler

    scored = gbt.transform(VectorAssembler(inputCols=names, outputCol="features").transform(frame(made))).select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()
    value = np.array([r.m for r in sorted(scored, key=lambda r: r.id)]).reshape(len(some), len(sets), len(behind)).mean(2)
    for k in range(len(some)):
        v = dict(zip(sets, value[k], strict=True))
        for f, name in enumerate(names):
            rest = [s for s in sets if f not in s]
            phi = sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (v[tuple(sorted({*s, f}))] - v[s]) for s in rest)
            assert got[k][name] == pytest.approx(-phi, abs=1e-9)
        assert got[k].margin == pytest.approx(v[0, 1, 2])


def test_one_against_the_rest(spark):
    rows = spark.createDataFrame([(float(k % 3), float(k % 3 == 0) * 4 + k % 5 / 9, float(k % 3 == 1) * 4 + k % 7 / 9) for k in range(120)], "label double, x double, y double")
    out = models.fit(rows, ["x", "y"], models.one_vs_rest(models.logistic(120, 50)), True).transform(rows)
    assert out.where("prediction = label").count() > 110


def test_attributions_answer_to_the_model(spark):
    """A tree that is read wrongly fails, as does a line that isn't known."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(k, float(k % 2), float(k % 2) + float(x)) for k, x in enumerate(rng.normal(size=80))], "id long, label double, a double")
    gbt = models.fit(rows, ["a"], models.boosted(2)).stages[-1]
    background = rows.limit(20)
    assert attribution.tree_shap(rows, background, gbt, ["a"], "id").count() == 80
    with pytest.raises(ValueError, match="isn't known"):
        attribution.leaves_of("Tree\n If (feature 0 in {0.0,2.0})\n  Predict: 1.0\n Else (feature 0 not in {0.0,2.0})\n  Predict: 2.0", 1.0)
    with pytest.raises(ValueError, match="at most"):
        attribution.shares(attribution.PATH + 1)
    whole = attribution.leaves_of
    try:
        attribution.leaves_of = lambda text, weight: whole(text, weight)[:-1]
        with pytest.raises(Exception, match="add up"):
            attribution.tree_shap(rows, background, gbt, ["a"], "id").collect()
    finally:
        attribution.leaves_of = whole
