"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are quantised once and written in blocks. Groups of query blocks meet
groups of candidate blocks (the stated query set against all rows, in blocks)
in a grid whose sides follow the counts, one task a cell. A cell keeps, for each
dimension, its candidates sorted by that component. A query walks all lists in
step from the end that its own component favours, scores each new row in full,
and stops once the threshold, which is the score of a row that had the
components at the present depth, is below its kth score. What cells return, k
rows a query, is cut to k by a group limit before and after the shuffle. Ties go
to the smaller vec_id, so the walk only stops where the threshold is below, not
at, the kth score.

Edge cases: vectors that are null or hold a null or non-finite component take
no part; a shorter vector counts as filled up with zeros; rows that repeat a
vec_id are rows of their own: each is asked, and each is a candidate of every
row but itself; with fewer than k candidates all are returned; a component or a
score beyond 64 bits fails the query; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatquery.llm._store import Tables, numbered

SCALE = 64
#: Vectors of a block; of the queries and of the candidates of a cell, about.
BLOCK, QUERIES, CANDIDATES = 2048, 32768, 65536
#: Entries of each list that are read at first; the depth doubles.
DEPTH = 16
_PACKED = "row bigint, n int, asked int, dim int, size int, ids binary, vectors binary"


def quantised(array: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of all components in a row, and the ends of the vectors."""
    flat = np.floor(SCALE * np.asarray(array.flatten().cast(pa.float64())))
    if len(flat) and np.abs(flat).max() >= 2.0**63:
        raise OverflowError("a component is beyond 64 bits")
    ends = np.concatenate([[0], np.cumsum(np.asarray(array.value_lengths().fill_null(0), dtype=np.int64))])
    return flat.astype(np.int64), ends


def matrix(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = np.diff(ends)
    dim = int(size.max(initial=0))
    out = np.zeros((len(size), dim), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(ends[:-1], size)] = flat
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The smallest signed integers that hold all of ``x``."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    return x.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(k).max))


def packed(vectors: DataFrame, modulus: int) -> DataFrame:
    """Blocks of up to BLOCK vectors; ``row`` numbers the first one, and the others follow it."""

    def run(batches):
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                own = narrow(matrix(*quantised(part.column("embedding"))))
                ids = np.asarray(part.column("vec_id"), dtype=np.int64)
                numbers = (at, len(ids), int((ids % modulus == 0).sum()), own.shape[1], own.itemsize)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.int64() if not k else pa.int32()) for k, x in enumerate(numbers)] + [pa.array([ids.tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary())],
                    names=["row", "n", "asked", "dim", "size", "ids", "vectors"],
                )
                at += len(ids)

    return vectors.select("vec_id", "embedding").mapInArrow(run, _PACKED)


def unpacked(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, numbers of rows, vectors."""
    ids = np.frombuffer(block["ids"], np.int64)
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[block["size"]]
    return ids, block["row"] + np.arange(len(ids)), np.frombuffer(block["vectors"], kind).reshape(len(ids), block["dim"]).astype(np.int64)


class Lists:
    """A block of candidates with its sorted lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")  # of equal scores the first is then the smaller id
        self.ids, self.rows, self.vectors = ids[by], rows[by], np.ascontiguousarray(vectors[by])
        self.exact = self.vectors.astype(np.float64)
        self.order = np.argsort(self.vectors.T, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.vectors.T, self.order.astype(np.int64), axis=1)
        self.widest = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best candidates but the row numbered ``own``."""
        n, dim = self.vectors.shape
        live = np.flatnonzero(query)
        widest = max(int(query.max(initial=0)), -int(query.min(initial=0))) * self.widest * max(dim, 1)
        small = widest < 1 << 52
        if widest >= 1 << 63:
            return self.wide(own, query, k)
        weight = query.astype(np.float64) if small else query
        table = self.exact if small else self.vectors
        new = np.ones(n, bool)
        new[self.rows == own] = False
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, depth = 0, DEPTH
        up, down = live[query[live] < 0], live[query[live] > 0]
        while at < n and new.any():
            end = min(n, depth) if len(live) else n
            seen = np.zeros(n, bool)
            seen[self.order[up, at:end]] = True
            seen[self.order[down, n - end : n - at]] = True
            if not len(live):
                seen[:] = True
            fresh = np.flatnonzero(seen & new)
            new[fresh] = False
            own_scores = table[fresh] @ weight
            rows = np.concatenate([rows, fresh])
            scores = np.concatenate([scores, own_scores.astype(np.int64)])
            if len(rows) > k:
                keep = np.lexsort((rows, -scores))[:k] if len(rows) < 256 else self._best(rows, scores, k)
                rows, scores = rows[keep], scores[keep]
            if len(rows) >= k and len(live):
                bound = int(self.sorted[up, end - 1] @ query[up]) + int(self.sorted[down, n - end] @ query[down])
                if bound < scores.min():
                    break
            at, depth = end, end * 2
        by = np.lexsort((rows, -scores))
        return rows[by], scores[by]

    def wide(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same where a sum might not fit 64 bits: in whole numbers of any size, row by row."""
        scores = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in self.vectors]
        best = sorted((x for x in range(len(scores)) if self.rows[x] != own), key=lambda x: (-scores[x], x))[:k]
        if any(not -(1 << 63) <= scores[x] < 1 << 63 for x in best):
            raise OverflowError("a score is beyond 64 bits")
        return np.array(best, np.int64), np.array([scores[x] for x in best], np.int64)

    @staticmethod
    def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((rows[near], -scores[near]))[:k]]


def sides(queries: int, candidates: int, tasks: int) -> tuple[int, int]:
    """Groups of queries and of candidates: as many as their sizes ask for, and a square grid of ``tasks`` cells at least."""
    q, c = max(1, -(-queries // QUERIES)), max(1, -(-candidates // CANDIDATES))
    while q * c < tasks:
        q, c = (q + 1, c) if q <= c else (q, c + 1)
    return q, c


def placed(blocks: DataFrame, q: int, c: int, asking: bool) -> DataFrame:
    """``blocks`` with the cells that each goes to: a row of the grid for queries, a column for candidates.

    Blocks are dealt by ``place``, their number over all partitions, so that
    groups differ by one block at most, whatever the sides of the grid.
    """
    own = F.pmod("place", F.lit(q if asking else c))
    cells = F.transform(F.sequence(F.lit(0), F.lit(c - 1)), lambda x: own * c + x) if asking else F.transform(F.sequence(F.lit(0), F.lit(q - 1)), lambda x: x * c + own)
    return blocks.withColumn("cell", F.explode(cells))


def search(vectors: DataFrame, modulus: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by ``modulus``."""
    spark = vectors.sparkSession
    sound = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and abs(x) < double('infinity'))")
    held = numbered(Tables(spark, "topk"), packed(sound, modulus), "place", "blocks")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = held.agg(F.sum("n"), F.sum("asked"), F.count("*")).first()
    if not many[1]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    q, c = sides(many[1], many[0], min(tasks, 4 * many[2]))

    def asked(batches):
        """The queries of each block, as a block of their own with its row numbers."""
        for batch in batches:
            for block in batch.to_pylist():
                ids, rows, own = unpacked(block)
                pick = ids % modulus == 0
                block |= {"ids": ids[pick].tobytes(), "vectors": narrow(own[pick]).tobytes(), "size": narrow(own[pick]).itemsize, "rows": rows[pick].tobytes()}
                yield pa.RecordBatch.from_pylist([block], schema=pa.schema([*batch.schema, pa.field("rows", pa.binary())]))

    left = placed(held.where("asked > 0").mapInArrow(asked, _PACKED + ", place bigint, rows binary"), q, c, True)
    right = placed(held.withColumn("rows", F.lit(None).cast("binary")), q, c, False)
    parts = min(q * c, 64 * tasks)
    cells = right.unionByName(left).repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", F.col("rows").isNotNull())

    def answer(batches):
        cell, waiting, lists = None, [], None
        for batch in batches:
            for block in batch.to_pylist():
                if block["cell"] != cell:
                    cell, waiting, lists = block["cell"], [], None
                if block["rows"] is None:  # the candidates of a cell come before its queries
                    waiting.append(unpacked(block))
                    continue
                if lists is None and waiting:
                    dim = max(x.shape[1] for _, _, x in waiting)
                    lists = Lists(np.concatenate([x[0] for x in waiting]), np.concatenate([x[1] for x in waiting]), np.concatenate([np.pad(x[2], ((0, 0), (0, dim - x[2].shape[1]))) for x in waiting]))
                    waiting = []
                if lists is None:
                    continue
                ids, _, own = unpacked(block)
                dim = lists.vectors.shape[1]  # what a query has beyond it meets zeros
                own = np.pad(own, ((0, 0), (0, max(0, dim - own.shape[1]))))[:, :dim]
                rows = np.frombuffer(block["rows"], np.int64)
                found = [lists.top(r, v, k) for r, v in zip(rows, own, strict=True)]
                size = [len(x[0]) for x in found]
                at, scores = (np.concatenate([x[y] for x in found]) for y in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, size)), pa.array(np.repeat(ids, size)), pa.array(lists.ids[at.astype(np.int64)]), pa.array(scores)], names=["query", "query_id", "vec_id", "score"])

    found = cells.mapInArrow(answer, "query bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
