"""Features for the models: TF-IDF, imputation and scaling, fitted by aggregates on the training rows only."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"(?U)(\w\w+)"


def grams(text: Column) -> Column:
    """Unigrams of two characters or more, then bigrams."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))

    def both(w: Column) -> Column:
        rest = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, F.lit(1), rest), F.slice(w, F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b)))

    # one element: the words are extracted once, however often they are used
    return F.transform(F.array(w), both)[0]


def term_frequencies(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.col(key), F.explode(grams(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(frequencies: DataFrame, n_rows: int, max_features: int | None) -> DataFrame:
    """term, idf: smooth inverse document frequency of the most frequent terms, ties by term."""
    df = frequencies.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if max_features is not None:
        df = df.orderBy(F.col("total").desc(), "term").limit(max_features)
    return df.select("term", (F.log((F.lit(1.0) + n_rows) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))


def counted(terms: Column) -> Column:
    """Of a row's terms: term, n for each occurrence and d once for each different one."""
    one = lambda n, d: lambda t: F.struct(t.alias("term"), F.lit(n).alias("n"), F.lit(d).alias("d"))
    return F.transform(F.array(terms), lambda t: F.concat(F.transform(t, one(1, 0)), F.transform(F.array_distinct(t), one(0, 1))))[0]


_TOTALS = "term string, df bigint, total bigint"


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """term, df, total of the lists of terms in a batch."""
    lists = batch.column(0)
    held = pc.list_flatten(lists).dictionary_encode()
    codes, n = held.indices.to_numpy().astype(np.int64), len(held.dictionary)
    of = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    df = np.bincount(np.unique(of * n + codes) % n, minlength=n) if n else codes
    return pa.table({"term": held.dictionary.cast(pa.string()), "df": pa.array(df, pa.int64()), "total": pa.array(np.bincount(codes, minlength=n), pa.int64())})


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def totals(rows: DataFrame, terms: str) -> DataFrame:
    """term, df (rows that hold it), total (how often they do); each batch counts its own terms, so only different ones are shuffled."""

    def run(batches):
        for batch in batches:
            yield from _counted(batch).to_batches()

    return _summed(rows.select(terms).mapInArrow(run, _TOTALS))


def frequent(rows: DataFrame, terms: str, most: int) -> DataFrame:
    """The ``most`` most frequent terms of ``totals``, ties by term, without a shuffle of the others.

    ``rows`` is a written table, which is read three times. The ``most`` first
    terms of each part give a total that ``most`` terms reach; a term that
    reaches it has its share of it in one part at least, and only those terms,
    which the driver holds, are counted in all.
    """
    rows = rows.select(terms)
    parts = max(rows.rdd.getNumPartitions(), 1)

    def counts(pick) -> DataFrame:
        def run(batches):
            found = [_counted(batch) for batch in batches]
            if found:
                own = pa.concat_tables(found).group_by("term").aggregate([("df", "sum"), ("total", "sum")])
                own = pa.table({"term": own["term"], "df": own["df_sum"], "total": own["total_sum"]})
                yield from pick(own).to_batches()

        return rows.mapInArrow(run, _TOTALS)

    first = _summed(counts(lambda own: own.sort_by([("total", "descending")]).slice(0, most)))
    n, least = first.orderBy(F.col("total").desc()).limit(most).agg(F.count("*"), F.min("total")).first()
    reach = least if n == most else 0
    some = counts(lambda own: own.filter(pc.greater_equal(pc.multiply(own["total"], parts), reach))).select("term").distinct().toArrow()
    held = rows.sparkSession.sparkContext.broadcast(some["term"].combine_chunks().cast(pa.string()))
    found = _summed(counts(lambda own: own.filter(pc.is_in(own["term"], value_set=held.value))))
    return found.orderBy(F.col("total").desc(), "term").limit(most)


def tfidf(rows: DataFrame, key: str, text: str, max_features: int | None = 5000, vocab: DataFrame | None = None) -> DataFrame:
    """key, term, weight with unit length per row. ``vocab``: a fitted one, for rows other than those of training.

    Where no key repeats and the vocabulary is bounded, it reaches the driver
    and each row is weighed where it is; only different terms are shuffled.
    Elsewhere (key, term) pairs are.
    """
    if vocab is None and max_features is not None and rows.groupBy(key).count().where("count > 1").isEmpty():
        return _weighed(rows, key, text, max_features)
    frequencies = term_frequencies(rows, key, text)
    if vocab is None:
        vocab = vocabulary(frequencies, rows.count(), max_features)
    raw = frequencies.join(vocab, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("weight") / norm).alias("weight"))


def _weighed(rows: DataFrame, key: str, text: str, max_features: int) -> DataFrame:
    terms = rows.select(key, grams(F.col(text)).alias("_terms"))
    totals = terms.select(F.explode(counted(F.col("_terms"))).alias("x")).groupBy("x.term").agg(F.sum("x.d").alias("df"), F.sum("x.n").alias("total"))
    totals = totals.orderBy(F.col("total").desc(), "term").limit(max_features)
    idf = F.log((F.lit(1.0) + rows.count()) / (F.lit(1.0) + F.col("df"))) + 1
    held = totals.select("term", idf.alias("idf")).orderBy("term").collect()
    if not held:
        return terms.select(key, F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    vectors = CountVectorizerModel.from_vocabulary([r.term for r in held], inputCol="_terms", outputCol="_tf")
    weigh = ElementwiseProduct(inputCol="_tf", outputCol="_raw", scalingVec=Vectors.dense([r.idf for r in held]))
    unit = Normalizer(inputCol="_raw", outputCol="_unit", p=2.0)
    made = unit.transform(weigh.transform(vectors.transform(terms))).select(key, F.unwrap_udt("_unit").alias("v"))
    made = made.select(key, F.explode(F.arrays_zip("v.indices", "v.values")).alias("x"))
    places = rows.sparkSession.createDataFrame([(k, r.term) for k, r in enumerate(held)], "indices int, term string")
    return made.select(key, "x.indices", F.col("x.values").alias("weight")).join(F.broadcast(places), "indices").select(key, "term", "weight")


def clean_number(c: Column) -> Column:
    """A double; what isn't a finite number is null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def medians(train: DataFrame, columns: Iterable[str]) -> dict[str, float]:
    """Exact medians of the training rows; a number for each column reaches the driver. NaN is no value."""
    from threatquery.operators.profile import quantiles

    columns = list(columns)
    known = train.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    return {r["column"]: r["median"] for r in quantiles(known, columns, {"median": 0.5}).collect()}


def impute(rows: DataFrame, fitted: dict[str, float]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in fitted.items()})


def standard_moments(train: DataFrame, columns: Iterable[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation."""
    columns = list(columns)
    row = train.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"{c}_m"], row[f"{c}_s"]) for c in columns}


def standardise(rows: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    """z-scores; a constant column is only centred."""
    return rows.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in moments.items() if m is not None})


def maxima(train: DataFrame, columns: Iterable[str]) -> dict[str, float]:
    columns = list(columns)
    row = train.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def max_abs_scale(rows: DataFrame, fitted: dict[str, float]) -> DataFrame:
    return rows.withColumns({c: F.col(c) / F.lit(float(m) if m else 1.0) for c, m in fitted.items()})
