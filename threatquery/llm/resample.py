"""Importance resampling of documents towards a target table, over a written sparse count matrix.

Each text is a row of a document-by-bucket matrix: how many of its features,
runs of 1 to ``longest`` words, fall into each of ``buckets`` hash buckets. The
matrix is written once as compressed sparse row blocks (a block: the rows of
some texts, with the places where they start, their buckets and counts). Its
column sums give the two distributions, and its product with the vector of
gains gives the weights, so no text is read twice. Dense vectors have one
number a bucket, a parameter, and only these reach the driver. The draw adds
Gumbel noise of a hash of the id to each weight and keeps the highest scores;
ranks come from a range sort and the counts of its partitions.

Edge cases: a null or empty text has no feature, weight 0, and is never drawn
while ``least`` is positive; an empty target leaves gains that depend on the
documents alone; a null doc_id is hashed as the empty string and sorts after
all others; rows of one doc_id are documents of their own, and rows with the
same score and doc_id rank in any order; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatquery.llm import _text
from threatquery.llm._store import Tables, numbered

BUCKETS = 10_000
SEED = 2024
#: Remembered buckets of words, at most, in each task.
KNOWN = 1 << 19
#: Blocks of a row group of the matrix. A reader holds the row group that it is at, decoded; a limit of bytes
#: is looked at after a hundred rows only, which are blocks here.
ROW_GROUP = 4
#: Separators as spaces, A-Z in lower case, all else as it is.
_TABLE = bytes(int(_text.LOWER[b]) if _text.ALNUM[_text.LOWER[b]] else 32 for b in range(256))
_BLOCKS = "block bigint, doc_ids array<bigint>, words array<bigint>, features array<bigint>, starts array<bigint>, buckets array<int>, counts array<int>"


class _Buckets(dict):
    """The bucket of a feature, computed once."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = out = zlib.crc32(feature) % self.buckets
        return out


def features(words: list[bytes], longest: int) -> list[bytes]:
    return words + [b" ".join(words[i : i + n]) for n in range(2, longest + 1) for i in range(len(words) - n + 1)]


def matrix(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """CSR blocks of (doc_id, text) rows; the rows of a block start at ``starts``, which has one entry more than rows."""

    def run(batches):
        part, k, known = TaskContext.get().partitionId(), 0, _Buckets(buckets)
        for batch in _text.parts(batches):
            data, offsets = _text.column(batch.column("text"))
            held, ends = data.tobytes(), offsets.tolist()
            words, own, cells = [], [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                found = held[a:b].translate(_TABLE).split()
                words.append(len(found))
                found = features(found, longest)
                own.append(len(found))
                cells.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
            rows = np.repeat(np.arange(len(own)), own)
            cells, times = np.unique(rows * buckets + (np.concatenate(cells) if cells else np.zeros(0, np.int64)), return_counts=True)
            starts = np.searchsorted(cells, np.arange(len(own) + 1) * buckets)
            k += 1
            lists = (words, own, starts, (cells % buckets).astype(np.int32), times.astype(np.int32))
            names = ("words", "features", "starts", "buckets", "counts")
            cols = {"block": pa.array([(part << 32) + k], pa.int64()), "doc_ids": _one(batch.column("doc_id").cast(pa.int64()))}
            cols |= {c: _one(pa.array(x, pa.int32() if c in ("buckets", "counts") else pa.int64())) for c, x in zip(names, lists, strict=True)}
            yield pa.RecordBatch.from_pydict(cols)

    return texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _BLOCKS)


def written(tables: Tables, blocks: DataFrame, name: str) -> DataFrame:
    return tables.write(blocks, name, {"parquet.block.row.count.limit": str(ROW_GROUP)})


def _one(values: pa.Array) -> pa.Array:
    """A list array of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _rows(batch: pa.RecordBatch, name: str):
    """The values of a list column, as one array for each block."""
    for x in batch.column(name):
        yield x.values.to_numpy(zero_copy_only=False)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket the sum of its column; a task sends one number a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, counts in zip(_rows(batch, "buckets"), _rows(batch, "counts"), strict=True):
                np.add.at(total, at, counts)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "n": pa.array(total[full], pa.int64())})

    found = blocks.select("buckets", "counts").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln) of the ratio of the smoothed shares of each bucket, target over source."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b))
    return np.array([math.floor(scale * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def product(blocks: DataFrame, vector: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the matrix by the vector."""

    def run(batches):
        for batch in batches:
            for k, (at, counts, starts) in enumerate(zip(_rows(batch, "buckets"), _rows(batch, "counts"), _rows(batch, "starts"), strict=True)):
                weight = _text.sums(vector[at] * counts, starts)
                own = {c: batch.column(c)[k].values for c in ("doc_ids", "words", "features")}
                yield pa.RecordBatch.from_arrays([*own.values(), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    wanted = blocks.select("doc_ids", "words", "features", "starts", "buckets", "counts")
    return wanted.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int = SEED, scale: int = 1000):
    """floor(scale * Gumbel noise) of a hash of the seed and doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank.

    Of those with ``least`` words, floor(percent / 100) are drawn, by score; the
    others have no rank. ``target`` needs only a column ``text``.
    """
    tables = Tables(docs.sparkSession, "resample")
    blocks = written(tables, matrix(docs, longest, buckets), "documents")
    other = written(tables, matrix(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), longest, buckets), "target")
    vector = gains(column_sums(blocks, buckets), column_sums(other, buckets))
    scored = product(blocks, vector).withColumn("score", F.col("weight") + noise(seed))
    scored = tables.write(scored.select("*", (F.col("n_words") >= least).alias("fit"), F.monotonically_increasing_id().alias("row")), "scored")
    tables.drop("documents", "target")
    drawn = percent * scored.where("fit").count() // 100
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranked = numbered(tables, scored.orderBy(*order), "rank", "ranked")
    rank = F.when(F.col("fit") & (F.col("rank") <= drawn), F.col("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
