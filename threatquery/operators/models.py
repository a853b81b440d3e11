"""Classifiers on MLlib, in pipelines that are fitted on training rows only."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, IndexToString, MaxAbsScaler, Normalizer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatquery.functions.text import handcrafted
from threatquery.operators import metrics, splits
from threatquery.operators.cells import CellBoosting, CellForest
from threatquery.operators.features_ml import frequent, grams, medians, totals
from threatquery.sources.sinks import materialise

# The settings of the models.
SEED = 42
TREES, BOOST_ROUNDS, BOOST_DEPTH, BOOST_STEP, BOOST_SHARE = 300, 300, 6, 0.1, 0.8


def balanced(train: DataFrame, label: str = "label") -> DataFrame:
    """``train`` with weight n / (k * n_c); the counts of the classes are a few rows."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    total, k = sum(counts.values()), max(len(counts), 1)
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, F.lit(total / (k * n))).otherwise(weight)
    return train.withColumn("weight", weight)


def features(columns: list[str], scaled: bool, n_rows: int) -> list:
    """One vector; scaled by the mean and the population deviation of ``n_rows`` rows, where MLlib divides by the sample's."""
    if not scaled:
        return [VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")]
    ratio = (n_rows / (n_rows - 1)) ** 0.5 if n_rows > 1 else 1.0
    return [
        VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="sampled", withMean=True, withStd=True),
        ElementwiseProduct(inputCol="sampled", outputCol="features", scalingVec=Vectors.dense([ratio] * len(columns))),
    ]


def imputer(train: DataFrame, columns: list[str]) -> SQLTransformer:
    """Adds <column>_filled: the exact median of ``train`` for a null or a NaN, 0 where there is no median."""
    fitted = medians(train, columns)
    filled = ", ".join(f"coalesce(nanvl(cast(`{c}` as double), cast(null as double)), {fitted.get(c, 0.0)!r}D) AS `{c}_filled`" for c in columns)
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


def logistic(n_rows: int, max_iter: int = 1000, c: float = 1.0) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter, regParam=1.0 / (c * max(n_rows, 1)), standardization=False)


def linear_svc(n_rows: int, max_iter: int = 1000, c: float = 1.0) -> LinearSVC:
    return LinearSVC(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter, regParam=1.0 / (c * max(n_rows, 1)), standardization=False)


def random_forest(trees: int = TREES) -> CellForest:
    return CellForest(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=30, seed=SEED, maxMemoryInMB=512)


def boosted(rounds: int = BOOST_ROUNDS) -> CellBoosting:
    return CellBoosting(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=BOOST_DEPTH, stepSize=BOOST_STEP, subsamplingRate=BOOST_SHARE, featureSubsetStrategy=str(BOOST_SHARE), seed=SEED)


def one_vs_rest(classifier) -> OneVsRest:
    return OneVsRest(classifier=classifier, featuresCol="features", labelCol="label", weightCol="weight")


def fit(train: DataFrame, columns: list[str], estimator, scaled: bool = False) -> PipelineModel:
    """Median imputation, scaling where asked for, the model; classes weigh the same."""
    filled = [f"{c}_filled" for c in columns]
    return Pipeline(stages=[imputer(train, columns), *features(filled, scaled, train.count() if scaled else 0), estimator]).fit(balanced(train))


def index_labels(column: str, output: str = "label") -> StringIndexer:
    """Ids by sorted distinct label."""
    return StringIndexer(inputCol=column, outputCol=output, stringOrderType="alphabetAsc")


def score(scored: DataFrame, positive: int = 0) -> Column:
    """The probability of the positive class, or its margin where the model has no probability."""
    if "margin" in scored.columns:
        return F.col("margin") if positive == 1 else -F.col("margin")
    if "probability" in scored.columns:
        return vector_to_array("probability")[positive]
    return vector_to_array("rawPrediction")[positive]


def linear_shap(scored: DataFrame, columns: list[str], weights: dict[str, float], means: dict[str, float]) -> DataFrame:
    """Exact Shapley values of a linear model: w (x - mean), ranked by mean absolute value."""
    one = scored.agg(*[f(F.lit(weights[c]) * (F.col(c) - F.lit(means[c]))).alias(f"{c}__{n}") for c in columns for n, f in (("mean_abs", lambda x: F.avg(F.abs(x))), ("signed", F.avg))])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}__mean_abs`").alias("mean_abs"), F.col(f"`{c}__signed`").alias("signed")) for c in columns]
    return one.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def linear_terms(model: PipelineModel, columns: list[str], positive: int = 0) -> tuple[dict[str, float], dict[str, float]]:
    """Weights and means in the units of ``columns`` of a scaled linear pipeline of ``fit``; of the margin of the positive class."""
    scaler, ratio, linear = model.stages[-3:]
    sign = 1 if positive == 1 else -1
    terms = zip(linear.coefficients.toArray().tolist(), scaler.std.toArray().tolist(), ratio.getScalingVec().toArray().tolist(), strict=True)
    weights = [sign * w * r / d if d else 0.0 for w, d, r in terms]
    return dict(zip(columns, weights, strict=True)), dict(zip(columns, scaler.mean.toArray().tolist(), strict=True))


def text_columns(rows: DataFrame, text: str | None) -> DataFrame:
    """The inputs of the text model: uni- and bigrams, and the seven handcrafted features; without ``text`` the rows have both, as arrays."""
    if text is None:
        return rows.withColumn("hand", array_to_vector("hand"))
    return rows.withColumns({"terms": grams(F.col(text)), "hand": array_to_vector(handcrafted(F.col(text)))})


def fit_text(train: DataFrame, text: str | None, label: str, estimator, max_features: int = 5000) -> PipelineModel:
    """TF-IDF of unit length beside scaled handcrafted features, then the classifier; all fitted on ``train``.

    ``text`` is None where ``train`` is a written table that has terms and hand already.
    Applies to rows with ``text_columns``; adds predicted, the label's name.
    """
    rows = text_columns(train, text).withColumn("_class", F.col(label))
    words = frequent(rows, "terms", max_features) if text is None else totals(rows, "terms").orderBy(F.col("total").desc(), "term").limit(max_features)
    vectors = CountVectorizerModel.from_vocabulary([r.term for r in words.select("term").collect()] or [""], inputCol="terms", outputCol="tf")
    # counts are written once, as all that follows would go over the texts again
    rows = materialise(vectors.transform(rows).select("_class", "tf", "hand"), "counts")
    index = StringIndexer(inputCol="_class", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    idf = IDF(inputCol="tf", outputCol="_").fit(rows).idf
    weigh = ElementwiseProduct(inputCol="tf", outputCol="weighted", scalingVec=Vectors.dense(idf.toArray() + 1.0))
    unit = Normalizer(inputCol="weighted", outputCol="tfidf", p=2.0)
    scale = MaxAbsScaler(inputCol="hand", outputCol="scaled").fit(rows)
    both = VectorAssembler(inputCols=["tfidf", "scaled"], outputCol="features")
    prepared = PipelineModel([index, weigh, unit, scale, both]).transform(rows)
    model = estimator.fit(balanced(prepared))
    name = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return PipelineModel([vectors, weigh, unit, scale, both, model, name])


def cross_validate(rows: DataFrame, columns: list[str], estimator, key: str, folds: int = 5, scaled: bool = False) -> DataFrame:
    """One row: mean and population deviation of accuracy and macro F1 over stratified folds."""
    # written once, as each fold reads it many times
    placed = materialise(splits.stratified_folds(rows, "label", key, folds).select(key, "label", "fold", *columns), "folds")
    scores = None
    for k in range(folds):
        train = placed.where(F.col("fold") != k)
        model = fit(train, columns, estimator(train.count()), scaled)
        one = metrics.summary(model.transform(placed.where(F.col("fold") == k)), "label", "prediction")
        scores = one if scores is None else scores.unionByName(one)
    return scores.agg(*[f(c).alias(f"{c}_{n}") for c in ("accuracy", "macro_f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
