import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array

from threatquery.operators import attribution, cells, models

_COMMON = dict(featuresCol="features", labelCol="label", weightCol="weight", seed=7)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 900, 700), rng.integers(0, 12, 700), rng.exponential(3, 700).round(2) * (rng.random(700) < 0.4)]).astype(float)
    y = ((x[:, 0] > 400) ^ (x[:, 1] > 7)) + rng.random(700) * 1.2
    y = y > np.median(y)  # classes of one size weigh 1, so sums are exact and ties fall alike
    return spark.createDataFrame([(k, float(t), *map(float, v)) for k, (t, v) in enumerate(zip(y, x, strict=True))], "id long, label double, a double, b double, c double").cache()


def told(model, rows):
    out = model.transform(rows).orderBy("id").select(vector_to_array("rawPrediction").alias("r"), vector_to_array("probability").alias("p"), "prediction")
    return np.array([[*r.r, *r.p, r.prediction] for r in out.collect()])


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("depth", [4, 30])
def test_a_forest_without_draws_is_that_of_mllib(rows, depth):
    setting = dict(numTrees=1, bootstrap=False, maxDepth=depth)
    one, other = (models.fit(rows, ["a", "b", "c"], kind(**_COMMON, **setting)) for kind in (RandomForestClassifier, cells.CellForest))
    assert isinstance(other.stages[-1], cells.ForestModel)
    assert np.allclose(told(one, rows), told(other, rows), atol=1e-9)


def test_a_forest_grows_from_counts(spark, rows):
    """Copies of the rows, dealt in another way, make no more to grow from; a count draws as its rows do together."""
    prepared = models.fit(rows, ["a", "b", "c"], models.random_forest(1))
    wide = PipelineModel(prepared.stages[:-1]).transform(models.balanced(rows)).cache()
    est = models.random_forest(1)
    _, counts = cells.counted(est, wide)
    _, more = cells.counted(est, wide.union(wide).union(wide).repartition(5))
    assert more.num_rows == counts.num_rows <= 700 and sum(counts.column("n").to_pylist()) == 700 and sum(more.column("n").to_pylist()) == 2100
    one, other = (told(models.fit(r, ["a", "b", "c"], models.random_forest(8)), rows) for r in (rows, rows.repartition(6)))
    assert np.array_equal(one, other)


def test_a_forest_bootstraps_as_mllib(rows):
    """Means over many trees agree, though draws differ."""
    one, other = (told(models.fit(rows, ["a", "b", "c"], kind(**_COMMON, numTrees=60, maxDepth=30)), rows) for kind in (RandomForestClassifier, cells.CellForest))
    assert np.abs(one[:, 2] - other[:, 2]).mean() < 0.05 and abs(one[:, 2].mean() - other[:, 2].mean()) < 0.01


def test_mllib_fits_what_has_too_many_cells(rows, monkeypatch):
    monkeypatch.setattr(cells, "CELLS", 100)
    assert type(models.fit(rows, ["a", "b", "c"], models.random_forest(2)).stages[-1]).__name__ == "RandomForestClassificationModel"
    monkeypatch.undo()
    monkeypatch.setattr(cells, "COUNTS", 100)
    assert type(models.fit(rows, ["a", "b", "c"], models.random_forest(2)).stages[-1]).__name__ == "RandomForestClassificationModel"
    monkeypatch.undo()
    other = RandomForestClassifier(**_COMMON, numTrees=2, minInstancesPerNode=9)
    mine = cells.CellForest(**_COMMON, numTrees=2, minInstancesPerNode=9)
    assert np.array_equal(*(told(models.fit(rows, ["a", "b", "c"], e), rows) for e in (other, mine)))


def test_a_forest_of_three_classes_is_saved(spark, rows, tmp_path):
    three = rows.selectExpr("id", "cast(case when a > 600 then 2 when b > 5 then 1 else 0 end as double) AS label", "a", "b", "c")
    model = models.fit(three, ["a", "b", "c"], models.random_forest(6))
    models.save(model, str(tmp_path / "m"))
    found = told(model, three)
    assert np.array_equal(found, told(models.load(str(tmp_path / "m")), three))
    assert (found[:, -1] == [r.label for r in three.orderBy("id").collect()]).mean() > 0.95 and np.allclose(found[:, 3:6].sum(1), 1)


def test_one_value_makes_one_leaf(spark):
    rows = spark.createDataFrame([(k, float(k % 4 == 0), 1.0) for k in range(40)], "id long, label double, a double")
    for e in (models.random_forest(3), models.boosted(3)):
        assert len(set(map(tuple, told(models.fit(rows, ["a"], e), rows)))) == 1


def test_boosted_trees_without_draws_are_those_of_mllib(rows):
    one, other = (models.fit(rows, ["a", "b", "c"], kind(**_COMMON, maxIter=3, maxDepth=6, stepSize=0.1)) for kind in (GBTClassifier, cells.CellBoosting))
    assert isinstance(other.stages[-1], cells.BoostedModel) and other.stages[-1].treeWeights == one.stages[-1].treeWeights
    assert np.allclose(told(one, rows), told(other, rows), atol=1e-9)


def test_boosted_trees_take_few_jobs(spark, rows, tmp_path):
    """Before, each level of each round was a job."""
    held = []
    assert jobs_of(spark, "boosted", lambda: held.append(models.fit(rows, ["a", "b", "c"], models.boosted(20)))) < 50
    models.save(held[0], str(tmp_path / "m"))
    assert np.array_equal(told(held[0], rows), told(models.load(str(tmp_path / "m")), rows))


def test_attributions_read_trees_over_cells(rows):
    """They equal those of MLlib's own trees where nothing is drawn."""
    found = []
    for kind in (GBTClassifier, cells.CellBoosting):
        gbt = models.fit(rows, ["a", "b", "c"], kind(**_COMMON, maxIter=2, maxDepth=4)).stages[-1]
        out = attribution.tree_shap(rows.where("id % 20 = 0"), rows.where("id < 30"), gbt, ["a", "b", "c"], "id")
        found.append(np.array([tuple(r) for r in out.orderBy("id").collect()]))
    assert isinstance(gbt, cells.BoostedModel) and np.allclose(*found, atol=1e-9)


def test_attributions_are_made_once_a_cell(spark, rows, monkeypatch):
    """Before, each row went through all leaves. Copies of rows bring no cells and get what the rows get, also where cells are too many to broadcast."""
    held, write, names = [], attribution.materialise, ["a", "b", "c"]
    monkeypatch.setattr(attribution, "materialise", lambda df, name: held.append(write(df, name)) or held[-1])
    gbt = models.fit(rows, names, models.boosted(2)).stages[-1]
    some = rows.where("id % 2 = 0")
    copies = some.crossJoin(spark.range(3).toDF("k")).selectExpr("id + 1000 * k AS id", *names).repartition(7)
    told = lambda r: {x.id: tuple(x)[1:] for x in attribution.tree_shap(r, rows.where("id < 30"), gbt, names, "id").collect()}
    one, three = told(some), told(copies)
    assert held[0].count() == held[1].count() < len(one) == 350
    assert len(three) == 1050 and all(v == one[k % 1000] for k, v in three.items())
    monkeypatch.setattr(attribution, "CELLS", 1)
    assert told(some) == one


def test_a_row_stays_in_its_cell():
    x = np.array([[1.0, 5.0], [1.5, -np.inf], [2.0, 0.0], [np.nextafter(2.0, 3.0), np.inf]])
    assert attribution.moved(x, [np.array([1.0, 2.0]), np.array([])]).tolist() == [[1.0, np.inf], [2.0, np.inf], [2.0, np.inf], [np.inf, np.inf]]
    leaves = attribution.leaves_of("Tree\n If (feature 1 <= 2.5)\n  Predict: 1.0\n Else (feature 1 > 2.5)\n  If (feature 1 <= 4.0)\n   Predict: 2.0\n  Else (feature 1 > 4.0)\n   Predict: 3.0", 1.0)
    assert [c.tolist() for c in attribution.cuts_of(leaves, 2)] == [[], [2.5, 4.0]]


def test_a_ranking_answers_to_the_model(rows, monkeypatch):
    """Its means don't read the margin, which is compared all the same."""
    gbt, whole = models.fit(rows, ["a", "b", "c"], models.boosted(2)).stages[-1], attribution.leaves_of
    monkeypatch.setattr(attribution, "leaves_of", lambda text, weight: whole(text, weight)[:-1])
    with pytest.raises(Exception, match="add up"):
        attribution.ranking(attribution.tree_shap(rows, rows.where("id < 30"), gbt, ["a", "b", "c"], "id"), ["a", "b", "c"]).collect()
