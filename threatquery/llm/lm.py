"""Language-model scoring by deleted interpolation of trigrams, bigrams, unigrams and a uniform share.

P(w | u v) = a f(w | u v) + b f(w | v) + c f(w) + d / (V + 1), with
maximum-likelihood f and mixture weights of a bucket: by the frequency of u v
where it was seen, else by that of v. A text begins with an end as v, and its
first word has no u. The weights are learned
by expectation-maximisation: a slice of the training documents is deleted from
the counts, and its tokens are the held-out data. The final counts are those of
all training documents.

Counts are exact and never meet in one place. Documents are written once as
chunks of token numbers with a dictionary of hashed words. A chunk sends each
of its distinct words, bigrams or trigrams, once to the bucket of its hash, with its
counts; the bucket adds up and sends the totals back in the same order. So a
frequent word costs one entry a chunk, and neither the vocabulary nor a count
table is ever broadcast. For EM, held-out tokens are summed in a histogram of
bounded size over (bucket, the three ratios in octaves): some 400,000 cells for a
million words, of which most are empty.

Edge cases: a null text has the end token alone; a word before any training is
unknown and takes the uniform share; with no training documents every
probability is 1; with no held-out tokens in a bucket its weights are the
prior's; rows without doc_id are scored, not learned from; repeated rows count
each; an empty table gives no rows; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatquery.llm import _text
from threatquery.llm._store import Tables, remainder
from threatquery.llm.jaccard import planes, unplanes

#: Tokens of a chunk, and of those whose counts a bucket adds up, about.
CHUNK, BUCKET = 1 << 19, 1 << 21
#: One of so many training documents is deleted from the counts for EM.
DELETED = 12
#: Buckets of a context's frequency, 0, then by octave: of the word before, then as many of the two words before.
LEVELS = 24
EM_ROUNDS = 60
#: Shares of trigrams, bigrams, words and the uniform before any data.
PRIOR = np.array([0.3, 0.3, 0.35, 0.05])
END = np.uint64(0x8C5F1E0B7A3D9246)
_FIRST, _SECOND, _THIRD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
WHAT = ("word", "bigram", "trigram")
_CHUNKS = "chunk bigint, kind int, n bigint, doc_ids array<bigint>, train binary, sizes binary, words binary, tokens binary"


def shrink(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.Codec("zstd").compress(planes(x), asbytes=True)


def grow(b: bytes, kind) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, kind)
    return unplanes(pa.Codec("zstd").decompress(b[8:], n * np.dtype(kind).itemsize, asbytes=True), kind)


def tokens(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in a row, each text's with its end, and the number of each text's tokens."""
    data, offsets = _text.column(array)
    found = _text.words(data, offsets, _text.SPACED)
    n = np.diff(found.first)
    out = np.full(len(found) + len(n), END, np.uint64)
    out[_text.spread(found.first[:-1] + np.arange(len(n)), n)] = found.hashes()
    return out, n + 1


def chunked(docs: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """Packed documents. kind 0: counted; 1: deleted for EM. Test documents are of kind 0 with no part in training."""

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        waiting: dict[int, list] = {0: [], 1: []}

        def flush(kind):
            nonlocal k
            own, waiting[kind] = waiting[kind], []
            h = np.concatenate([x[0] for x in own])
            words, of, times = np.unique(h, return_inverse=True, return_counts=True)
            by = np.argsort(-times, kind="stable")  # frequent words have small numbers
            place = np.empty(len(words), np.uint32)
            place[by] = np.arange(len(words), dtype=np.uint32)
            k += 1
            ids = pa.array([[i for x in own for i in x[2]]], pa.list_(pa.int64()))
            cols = [pa.array([(part << 32) + k], pa.int64()), pa.array([kind], pa.int32()), pa.array([len(h)], pa.int64()), ids]
            cols.append(pa.array([np.concatenate([x[3] for x in own]).astype(np.uint8).tobytes()], pa.binary()))
            cols += [pa.array([shrink(x)], pa.binary()) for x in (np.concatenate([x[1] for x in own]).astype(np.uint32), words[by], place[of])]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "kind", "n", "doc_ids", "train", "sizes", "words", "tokens"])

        for batch in _text.parts(batches):
            h, n = tokens(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(n)])
            role = np.asarray(batch.column("role"))
            for kind in (0, 1):
                own = np.flatnonzero((role == 1) == bool(kind))
                if not len(own):
                    continue
                pick = _text.spread(ends[own], n[own])
                waiting[kind].append((h[pick], n[own], batch.column("doc_id").take(pa.array(own)).to_pylist(), role[own] != 2))
                if sum(len(x[0]) for x in waiting[kind]) >= CHUNK:
                    yield flush(kind)
        for kind in (0, 1):
            if waiting[kind]:
                yield flush(kind)

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    role = F.when((crc % modulus == held_out) | F.col("doc_id").isNull(), 2).when(F.floor(crc / modulus) % DELETED == 0, 1).otherwise(0)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", role.cast("int").alias("role")).mapInArrow(run, _CHUNKS)


class Chunk:
    """A chunk unpacked; ``context`` and ``tokens`` are dictionary numbers (the end comes before a first word)."""

    def __init__(self, row: dict):
        self.kind, self.ids = row["kind"], row["doc_ids"]
        self.sizes = grow(row["sizes"], np.uint32).astype(np.int64)
        self.words = grow(row["words"], np.uint64)
        self.tokens = grow(row["tokens"], np.uint32).astype(np.int64)
        self.train = np.repeat(np.frombuffer(row["train"], np.uint8).astype(bool), self.sizes)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.end = int(np.flatnonzero(self.words == END)[0])
        self.context = np.concatenate([[self.end], self.tokens[:-1]])
        self.context[self.first] = self.end

    def pairs(self) -> np.ndarray:
        return _text.mix(self.words[self.context] * _FIRST + self.words[self.tokens] * _SECOND)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of bigrams, and which one each token is."""
        return np.unique(self.pairs(), return_inverse=True)

    def inner(self) -> np.ndarray:
        """Whether a token has a token before it in its text."""
        out = np.ones(len(self.tokens), bool)
        out[self.first] = False
        return out

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of trigrams, and which one each inner token is: its own pair after the pair before it."""
        pairs, inner = self.pairs(), np.flatnonzero(self.inner())
        return np.unique(_text.mix(pairs[inner - 1] * _THIRD + self.words[self.tokens[inner]] * _FIRST), return_inverse=True)


def _post(chunk: int, keys: np.ndarray, counts: np.ndarray, kind: int, buckets: int):
    """Batches (bucket, chunk, kind, keys, counts): what a chunk sends to each bucket."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    for a, b in _text.runs(bucket[by]):
        own = by[a:b]
        packed = planes(keys[own])
        yield {"bucket": int(bucket[own[0]]), "chunk": chunk, "kind": kind, "keys": packed, "counts": planes(counts[own].astype(np.uint32))}


_POSTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_POSTS_SQL = "bucket int, chunk bigint, kind int, keys binary, counts binary"
_TOTALS = "chunk bigint, what string, bucket int, counted binary, trained binary, n bigint, v bigint"


def posts(chunks: DataFrame, what: str, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                if what == "word":
                    keys = chunk.words
                    counts = np.bincount(chunk.tokens[chunk.train], minlength=len(keys))
                else:
                    keys, of = chunk.bigrams() if what == "bigram" else chunk.trigrams()
                    train = chunk.train if what == "bigram" else chunk.train[chunk.inner()]
                    counts = np.bincount(of[train], minlength=len(keys))
                yield pa.RecordBatch.from_pylist(list(_post(row["chunk"], keys, counts, chunk.kind, buckets)), schema=_POSTS)

    return chunks.mapInArrow(run, _POSTS_SQL)


def totals(sent: DataFrame, what: str) -> DataFrame:
    """Back to the chunks: counts of all training (trained) and without the deleted slice (counted), in the order sent."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = []
        for r in rows:
            keys.append(unplanes(r["keys"], np.uint64))
        sizes = [len(k) for k in keys]
        counts = np.concatenate([unplanes(r["counts"], np.uint32) for r in rows]).astype(np.float64)
        deleted = np.repeat([r["kind"] == 1 for r in rows], sizes)
        keys = np.concatenate(keys)
        by = np.argsort(keys, kind="stable")
        new = np.concatenate([[0], np.cumsum(keys[by][1:] != keys[by][:-1])])
        of = np.empty(len(keys), np.int64)
        of[by] = new
        trained = np.bincount(of, counts)
        counted = trained - np.bincount(of, counts * deleted)
        cuts = np.cumsum(sizes)[:-1]
        back = [[shrink(p) for p in np.split(x[of].astype(np.uint32), cuts)] for x in (counted, trained)]
        n = len(rows)
        first = [int(trained.sum())] + [0] * (n - 1), [int((trained > 0).sum())] + [0] * (n - 1)
        # without the deleted slice only the chunks of that slice need counts
        counted = [x if r["kind"] == 1 else b"" for x, r in zip(back[0], rows, strict=True)]
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "what": pa.array([what] * n),
                "bucket": table.column("bucket"),
                "counted": pa.array(counted, pa.binary()),
                "trained": pa.array(back[1], pa.binary()),
                "n": pa.array(first[0], pa.int64()),
                "v": pa.array(first[1], pa.int64()),
            }
        )

    return sent.groupBy("bucket").applyInArrow(add, _TOTALS)


def _gathered(chunk: Chunk, right: pa.Table, which: str, buckets: int) -> dict[str, np.ndarray]:
    """word: the count of each dictionary word; bigram, trigram: those of each token's bigram and trigram (0 for a first token)."""
    pairs, of_pair = chunk.bigrams()
    triples, of_triple = chunk.trigrams()
    keys = dict(zip(WHAT, (chunk.words, pairs, triples), strict=True))
    out = {k: np.zeros(len(x)) for k, x in keys.items()}
    bucket = {k: x % np.uint64(buckets) for k, x in keys.items()}
    order = {k: np.argsort(b, kind="stable") for k, b in bucket.items()}
    cuts = {k: np.searchsorted(bucket[k][order[k]], np.arange(buckets + 1, dtype=np.uint64)) for k in bucket}
    for r in right.to_pylist():
        at = order[r["what"]][cuts[r["what"]][r["bucket"]] : cuts[r["what"]][r["bucket"] + 1]]
        out[r["what"]][at] = grow(r[which], np.uint32)
    triple = np.zeros(len(chunk.tokens))
    triple[chunk.inner()] = out["trigram"][of_triple]
    return {"word": out["word"], "bigram": out["bigram"][of_pair], "trigram": triple}


def parts(chunk: Chunk, found: dict[str, np.ndarray], n: float, v: float) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Of every token: the bucket of its context, and the shares that trigrams, bigrams and words give it; the uniform share."""
    one = found["word"][chunk.context]
    two = np.where(chunk.inner(), np.concatenate([[0], found["bigram"][:-1]]), 0)  # how often the two tokens before occur

    def octave(count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64).clip(0, LEVELS - 1)

    level = np.where(two > 0, LEVELS + octave(two), octave(one))
    return level, [found["trigram"] / np.maximum(two, 1), found["bigram"] / np.maximum(one, 1), found["word"][chunk.tokens] / max(n, 1)], 1 / (v + 1)


def _octave(ratio: np.ndarray) -> np.ndarray:
    """Octaves above the uniform share; -1000 for a share of 0."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.round(np.log2(np.maximum(ratio, 1e-300))), -1000).astype(np.int64)


def mixture(rows: np.ndarray) -> np.ndarray:
    """Weights of each bucket by EM over rows of (bucket, octaves of trigrams, bigrams and words, tokens)."""
    weights = np.tile(PRIOR, (2 * LEVELS, 1))
    if len(rows):
        level, times = rows[:, 0], rows[:, 4]
        share = np.column_stack([np.where(rows[:, k] > -1000, 2.0 ** rows[:, k].astype(float), 0) for k in (1, 2, 3)] + [np.ones(len(rows))])
        for _ in range(EM_ROUNDS):
            part = weights[level] * share
            part *= (times / part.sum(1))[:, None]
            for k in range(4):
                weights[:, k] = np.bincount(level, part[:, k], 2 * LEVELS) + 0.5 * PRIOR[k]
            weights /= weights.sum(1, keepdims=True)
    # a context that was never seen has no share to give
    weights[:LEVELS, 0] = 0.0
    weights[0, 1] = 0.0
    return weights / weights.sum(1, keepdims=True)


def score(docs: DataFrame, modulus: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    tables = Tables(spark, "lm")
    chunks = tables.write(chunked(docs, modulus, held_out), "chunks")
    whole, deleted_tokens = (int(x or 0) for x in chunks.agg(F.sum("n"), F.sum(F.when(F.col("kind") == 1, F.col("n")))).first())
    # A bucket is held whole by a task, so their number follows the tokens.
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // BUCKET))
    counts = [tables.write(totals(posts(chunks, what, buckets), what), what) for what in WHAT]
    n, v = (int(x or 0) for x in counts[0].agg(F.sum("n"), F.sum("v")).first())
    back = counts[0].unionByName(counts[1]).unionByName(counts[2])
    deleted = chunks.where("kind = 1")
    counted = n - deleted_tokens

    def tally(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            chunk = Chunk(row)
            level, shares, uniform = parts(chunk, _gathered(chunk, right, "counted", buckets), counted, v)
            cells, times = np.unique(np.column_stack([level, *(_octave(x / uniform) for x in shares)]), axis=0, return_counts=True)
            rows.append(np.column_stack([cells, times]))
        cells = np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)
        return pa.table({c: cells[:, k] for k, c in enumerate((*cell, "times"))})

    cell = ["level", "three", "two", "one"]
    held = deleted.groupBy("chunk").cogroup(back.where("length(counted) > 0").groupBy("chunk")).applyInArrow(tally, "level bigint, three bigint, two bigint, one bigint, times bigint")
    # Cells of a fixed grid, buckets by octaves, of which most are empty, whatever the input.
    grid = held.groupBy(*cell).agg(F.sum("times").alias("times")).orderBy(*cell).toArrow()
    weights = mixture(np.column_stack([np.asarray(grid.column(c).combine_chunks(), dtype=np.int64) for c in (*cell, "times")]))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_tokens", "n_known", "base_score", "score")}
        for row in left.to_pylist():
            chunk = Chunk(row)
            found = _gathered(chunk, right, "trained", buckets)
            level, shares, uniform = parts(chunk, found, n, v)
            w, word = weights[level], found["word"]
            log = np.log10(sum(w[:, k] * x for k, x in enumerate(shares)) + w[:, 3] * uniform) if n else np.zeros(len(level))
            base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))[chunk.tokens]
            out["doc_id"] += chunk.ids
            out["n_tokens"].append(chunk.sizes)
            out["n_known"].append(np.add.reduceat((word[chunk.tokens] > 0).astype(np.int64), chunk.first))
            out["base_score"].append(np.add.reduceat(base, chunk.first))
            out["score"].append(np.add.reduceat(log, chunk.first))
        columns = {"doc_id": pa.array(out.pop("doc_id"), pa.int64())}
        columns |= {c: np.concatenate(x) if x else np.zeros(0, np.int64 if c.startswith("n_") else np.float64) for c, x in out.items()}
        return pa.table(columns)

    found = chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(finish, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return found.select("doc_id", (remainder("doc_id", modulus) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
