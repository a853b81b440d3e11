"""Feature scaling, metric and model queries over ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatquery.operators import attribution, boosting, features_ml as feat, margin, metrics as met, models, splits, text_margin
from threatquery.plans.catalogue import query
from threatquery.plans.profile import labelled, rounded
from threatquery.sources import sinks

# Every labelled row with a truth, a score from its words and a prediction; quality 0 is the threat, as with URLs.
_BASE = """SELECT d.doc_id, d.lang, l.quality AS truth, l.toxic, length(d.text) AS n_text, len(string_split(d.text, ' ')) AS n_words, len(regexp_extract_all(d.text, '[|$%&#*!]')) AS n_marks,
  round(len(regexp_extract_all(d.text, '[|$%&#*!]')) / (len(string_split(d.text, ' ')) + 1.0), 3) AS score FROM documents d JOIN labels l USING (doc_id)"""
_SCORED = f"SELECT *, CASE WHEN score >= 0.2 THEN 0 ELSE 1 END AS predicted FROM ({_BASE})"


def scored(spark, sf_dir):
    words, marks = F.size(F.split("text", " ")), F.regexp_count("text", F.lit("[|$%&#*!]"))
    rows = labelled(spark, sf_dir, n_words=words, n_marks=marks).withColumnRenamed("quality", "truth")
    rows = rows.withColumn("score", F.round(F.col("n_marks") / (F.col("n_words") + F.lit(1.0)), 3))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.2, 0).otherwise(1))


_COLUMNS = ["n_text", "n_words", "n_marks"]


@query(
    f"""WITH b AS (SELECT doc_id, truth, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_text::DOUBLE END AS x FROM ({_BASE})), m AS (SELECT quantile_cont(x, 0.5) AS m FROM b WHERE doc_id % 10 < 7)
SELECT doc_id, coalesce(x, m) AS x FROM b, m"""
)
def median_impute(spark, sf_dir):
    """Fitted on the training rows, applied to all."""
    rows = scored(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("n_text").cast("double")).alias("x"))
    return feat.impute(rows, feat.medians(rows.where("doc_id % 10 < 7"), ["x"]))


@query(
    f"""WITH b AS ({_BASE}), m AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _COLUMNS)} FROM b WHERE doc_id % 10 < 7)
SELECT doc_id, {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _COLUMNS)} FROM b, m"""
)
def standard_scale(spark, sf_dir):
    rows = scored(spark, sf_dir).select("doc_id", *_COLUMNS)
    return rounded(feat.standardise(rows, feat.standard_moments(rows.where("doc_id % 10 < 7"), _COLUMNS)), *_COLUMNS)


@query(f"WITH b AS ({_BASE}), m AS (SELECT {', '.join(f'max(abs({c})) AS m_{c}' for c in _COLUMNS)} FROM b) SELECT doc_id, {', '.join(f'round({c} / m_{c}, 6) AS {c}' for c in _COLUMNS)} FROM b, m")
def maxabs_scale(spark, sf_dir):
    rows = scored(spark, sf_dir).select("doc_id", *_COLUMNS)
    return rounded(feat.max_abs_scale(rows, feat.maxima(rows, _COLUMNS)), *_COLUMNS)


@query(f"WITH s AS ({_SCORED}), k AS (SELECT unnest([0, 0, 1, 1]) AS truth, unnest([0, 1, 0, 1]) AS predicted) SELECT k.truth, k.predicted, count(s.doc_id) AS n FROM k LEFT JOIN s ON s.truth = k.truth AND s.predicted = k.predicted GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return met.confusion(scored(spark, sf_dir), "truth", "predicted")


def _classes_sql(truth, predicted, source):
    return f"""c AS (SELECT {truth} AS t, {predicted} AS p FROM {source}), k AS (SELECT t AS class FROM c UNION SELECT p FROM c),
n AS (SELECT class, (SELECT count(*) FROM c WHERE t = class) AS support, (SELECT count(*) FROM c WHERE p = class) AS pred, (SELECT count(*) FROM c WHERE t = class AND p = class) AS hits FROM k),
r AS (SELECT class, support, CASE WHEN pred = 0 THEN 0 ELSE hits / pred END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM n),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)"""


@query(f"WITH s AS ({_SCORED}), {_classes_sql('truth', 'predicted', 's')} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def prf_per_class(spark, sf_dir):
    return rounded(met.per_class(scored(spark, sf_dir), "truth", "predicted"), "precision", "recall", "f1")


_LANG_GUESS = "CASE WHEN n_marks > 20 THEN 'other' WHEN n_words % 3 = 0 THEN 'de' ELSE 'en' END"


@query(
    f"""WITH s AS (SELECT *, {_LANG_GUESS} AS guess FROM ({_BASE})), {_classes_sql('lang', 'guess', 's')}
SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f"""
)
def macro_weighted_f1(spark, sf_dir):
    guess = F.when(F.col("n_marks") > 20, "other").when(F.col("n_words") % 3 == 0, "de").otherwise("en")
    return rounded(met.summary(scored(spark, sf_dir).withColumn("guess", guess), "lang", "guess"), "accuracy", "macro_f1", "weighted_f1")


@query(
    f"""WITH s AS ({_SCORED}), r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rank FROM s)
SELECT round((sum(rank) FILTER (WHERE truth = 0) - count_if(truth = 0) * (count_if(truth = 0) + 1) / 2) / (count_if(truth = 0) * count_if(truth = 1)), 6) AS roc_auc FROM r"""
)
def roc_auc(spark, sf_dir):
    return rounded(met.roc_auc(scored(spark, sf_dir), F.col("truth") == 0, "score"), "roc_auc")


@query(
    f"""WITH s AS ({_SCORED}), g AS (SELECT score, count_if(truth = 0) AS p, count(*) AS n FROM s GROUP BY score),
c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM g)
SELECT round(sum(p * tp / seen) / sum(p), 6) AS average_precision FROM c"""
)
def pr_auc_ap(spark, sf_dir):
    return rounded(met.average_precision(scored(spark, sf_dir), F.col("truth") == 0, "score"), "average_precision")


def _binary_sql(t, p):
    return f"""SELECT round(count_if(({t}) = ({p})) / count(*), 6) AS accuracy, round(count_if(({t}) AND ({p})) / count_if({p}), 6) AS precision, round(count_if(({t}) AND ({p})) / count_if({t}), 6) AS recall,
  round(2 * count_if(({t}) AND ({p})) / (count_if({p}) + count_if({t})), 6) AS f1"""


_NOT_EN = ("lang <> 'en'", "guess <> 'en'")


@query(f"{_binary_sql(*_NOT_EN)} FROM (SELECT *, {_LANG_GUESS} AS guess FROM ({_BASE}))")
def binary_collapse_metrics(spark, sf_dir):
    """Several classes collapsed to one against the rest."""
    guess = F.when(F.col("n_marks") > 20, "other").when(F.col("n_words") % 3 == 0, "de").otherwise("en")
    rows = scored(spark, sf_dir).withColumn("guess", guess)
    return rounded(met.binary(rows, F.col("lang") != "en", F.col("guess") != "en"), "accuracy", "precision", "recall", "f1")


_CUTS = [0.1, 0.2, 0.5]


@query(f"WITH b AS ({_BASE}) " + " UNION ALL ".join(f"{_binary_sql('truth = 0', f'score >= {c}')}, 'cut {c}' AS model FROM b" for c in _CUTS))
def model_comparison(spark, sf_dir):
    rows = scored(spark, sf_dir)
    out = met.compare({f"cut {c}": met.binary(rows, F.col("truth") == 0, F.col("score") >= c) for c in _CUTS})
    return rounded(out, "accuracy", "precision", "recall", "f1").orderBy(F.col("f1").desc())


_WEIGHTS = {"n_text": -0.001, "n_words": 0.01, "n_marks": 0.5}


@query(
    f"WITH b AS ({_BASE}), m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in _COLUMNS)} FROM b WHERE doc_id % 10 < 7) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(abs({w} * ({c} - m_{c}))), 6) AS mean_abs, round(avg({w} * ({c} - m_{c})), 6) AS signed FROM b, m" for c, w in _WEIGHTS.items())
)
def linear_shap_ranking(spark, sf_dir):
    rows = scored(spark, sf_dir)
    means = {c: m for c, (m, _) in feat.standard_moments(rows.where("doc_id % 10 < 7"), _COLUMNS).items()}
    return rounded(models.linear_shap(rows, _COLUMNS, _WEIGHTS, means), "mean_abs", "signed").orderBy(F.col("mean_abs").desc())


def _labelled(spark, sf_dir):
    """Numbers of the labelled rows, written once, as a fit reads them many times and each time would go over all texts."""
    rows = scored(spark, sf_dir).select("doc_id", F.col("truth").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in _COLUMNS])
    return sinks.materialise(rows, "labelled")


@query()
def linear_shap_ranking_fitted(spark, sf_dir):
    """With the weights of the fitted logistic regression, towards the threat."""
    rows = _labelled(spark, sf_dir)
    train = rows.where("doc_id % 10 < 7")
    model = models.fit(train, _COLUMNS, models.logistic(train.count()), True)
    filled = model.transform(rows).select(*[F.col(f"{c}_filled").alias(c) for c in _COLUMNS])
    return rounded(models.linear_shap(filled, _COLUMNS, *models.linear_terms(model, _COLUMNS)), "mean_abs", "signed").orderBy(F.col("mean_abs").desc())


def _predictions(spark, sf_dir, fit):
    rows = _labelled(spark, sf_dir)
    out = fit(rows.where("doc_id % 10 < 7")).transform(rows)
    return out.select("doc_id", F.col("prediction").cast("int").alias("prediction"), F.round(models.score(out), 6).alias("phishing_score"))


@query()
def lr_predictions(spark, sf_dir):
    return _predictions(spark, sf_dir, lambda train: models.fit(train, _COLUMNS, models.logistic(train.count()), True))


@query()
def svc_predictions(spark, sf_dir):
    """Squared hinge."""
    return _predictions(spark, sf_dir, lambda train: margin.fit(train, _COLUMNS))


@query()
def rf_predictions(spark, sf_dir):
    return _predictions(spark, sf_dir, lambda train: models.fit(train, _COLUMNS, models.random_forest()))


@query()
def gbt_predictions(spark, sf_dir):
    return _predictions(spark, sf_dir, lambda train: models.fit(train, _COLUMNS, models.boosted()))


@query()
def boosted_predictions(spark, sf_dir):
    """Second-order boosting with a regularised gain."""
    rows = _labelled(spark, sf_dir)
    out = boosting.fit(rows.where("doc_id % 10 < 7"), _COLUMNS).transform(rows)
    return out.select("doc_id", F.col("prediction").cast("int").alias("prediction"), F.round(1 - F.col("probability"), 6).alias("phishing_score"))


@query()
def tree_shap_ranking(spark, sf_dir):
    """Of the boosted model, over all rows that it wasn't fitted on, against a hundred rows that it was."""
    rows = _labelled(spark, sf_dir)
    train = rows.where("doc_id % 10 < 7")
    model = models.fit(train, _COLUMNS, models.boosted())
    filled = model.stages[0].transform(rows).select("doc_id", *[F.col(f"{c}_filled").alias(c) for c in _COLUMNS])
    background = splits.sample(filled.where("doc_id % 10 < 7"), "doc_id", attribution.BACKGROUND)
    explained = attribution.tree_shap(filled.where("doc_id % 10 >= 7"), background, model.stages[-1], _COLUMNS, "doc_id")
    return rounded(attribution.ranking(explained, _COLUMNS), "mean_abs", "signed").orderBy(F.col("mean_abs").desc())


def _categorised(spark, sf_dir):
    """Messages with their scam category and what the text models read of them, and those of the training split."""
    from threatquery.functions import lexicons as lex, text as tx
    from threatquery.plans.text import messages

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")  # lists of terms reach Python, and are long
    rows = messages(spark, sf_dir).withColumn("category", tx.category(F.col("text"), F.col("label"), lex.DATA_CATEGORIES)).drop("label")
    with sinks.Scratch(spark, "messages") as scratch:
        rows = scratch.write(rows, "messages")
        train = splits.stratified(rows.select("doc_id", "category"), "category", "doc_id").where("split = 'train'").select("doc_id").distinct()
        rows = rows.join(train.withColumn("known", F.lit(True)), "doc_id", "left")
        # written once, as a fit and its predictions would go over the texts again
        rows = sinks.materialise(rows.select("doc_id", "category", "known", *text_margin.inputs(F.col("text"))), "inputs")
    return rows, rows.where("known")


@query()
def text_svc_predictions(spark, sf_dir):
    """The same by the squared hinge over uni- and bigrams and the seven features, one category against the rest."""
    rows, known = _categorised(spark, sf_dir)
    return text_margin.fit(known, None, "category").transform(rows, None).select("doc_id", "category", "predicted")


@query()
def text_lr_predictions(spark, sf_dir):
    """Scam categories of messages from their text; fitted on the rows of the training split."""
    rows, known = _categorised(spark, sf_dir)
    model = models.fit_text(known, None, "category", models.logistic(known.count(), max_iter=5000))
    return model.transform(models.text_columns(rows, None)).select("doc_id", "category", "predicted")


@query()
def cv_scores(spark, sf_dir):
    """Five stratified folds of the logistic regression."""
    return models.cross_validate(_labelled(spark, sf_dir), _COLUMNS, models.logistic, "doc_id", scaled=True)
