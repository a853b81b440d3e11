"""Removal of lines that many documents share, by a sharded minimal perfect hash.

A line's key is the line without white space at its ends and with A-Z in lower
case; it is known by a hash of 128 bits. Documents send each key that they hold
once, summed within a batch, and Spark adds up how many documents hold it. The
distinct hashes of keys that ``least_docs`` documents hold go into the index:
shards by hash, each with a minimal perfect hash, an array of fingerprints and
an array of counts, a slot for each hash. All other keys decide nothing, and a
probe for one meets another's fingerprint (64 bits, beside the slot that the
whole hash gives) or no slot.

Documents probe the arrays, no line is joined. An index of at most BROADCAST
bytes, counted before, goes to every task, and documents are read straight
through. Beyond that, hashes alone are routed to the shard that they belong to,
a busy shard being copied as often as its probes need, and what was found goes
back to the documents by number.

Edge cases: a null or empty text is one empty line, and its kept text is empty;
keys shorter than ``least_chars`` code points stay however frequent; a text
that loses all lines becomes empty; rows of one doc_id are documents of their
own; an empty table gives no rows; columns of any name pass through.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from threatquery.llm import _text
from threatquery.llm._store import Tables

#: Hashes of a shard, and probes that one copy of a shard answers, about.
SHARD, PROBES = 1 << 17, 1 << 21
#: Largest index, in bytes, that goes to every task.
BROADCAST = 32 << 20
#: Bits of a level for each hash that is left.
GAMMA = 2
_LOWER = bytes(int(x) for x in _text.LOWER)
U64 = np.uint64


def key(line: bytes) -> bytes:
    return line.translate(_LOWER).strip(b"\t\n\x0b\x0c\r ")


def long_enough(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (least_chars <= 1 or len(key.decode("utf-8", "replace")) >= least_chars)


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), U64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class Index:
    """A minimal perfect hash of distinct 128-bit hashes, with a fingerprint and a count in each slot.

    Level by level each hash left picks a bit; where only one picks it, the bit
    is set and the hash done. A hash's slot is the number of set bits before its
    own.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.bits, self.prints, self.counts = sizes, bits, prints, counts
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_text.mix(high ^ _text.mix(low + U64(level))) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> Index:
        sizes, levels, h, w = [], [], high, low
        while len(h):
            size = 64 * max(1, -(-GAMMA * len(h) // 64))
            at = cls.places(h, w, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(U64))
            sizes.append(size)
            left = ~alone[at]
            h, w = h[left], w[left]
        width = np.min_scalar_type(int(counts.max()) if len(counts) else 0)
        out = cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, U64), np.zeros(len(high), U64), np.zeros(len(high), width))
        slot = out.slots(high, low)
        out.prints[slot], out.counts[slot] = low, counts
        return out

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each hash of the index; of any other hash some slot, or -1."""
        out, live, first = np.full(len(high), -1, np.int64), np.arange(len(high)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = self.places(high[live], low[live], level, size)
            word, bit = first + (at >> 6), (at & 63).astype(U64)
            held = self.bits[word]
            hit = (held >> bit) & U64(1) == 1
            below = np.bitwise_count(held[hit] & ((U64(1) << bit[hit]) - U64(1)))
            out[live[hit]] = self.rank[word[hit]] + below
            live, first = live[~hit], first + (size >> 6)
            if not len(live):
                break
        return out

    def count(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Documents that hold each hash, 0 for a hash that isn't in the index."""
        slot = self.slots(high, low)
        out, some = np.zeros(len(high), np.int64), np.flatnonzero(slot >= 0)
        same = some[self.prints[slot[some]] == low[some]]
        out[same] = self.counts[slot[same]]
        return out

    def packed(self) -> dict[str, bytes]:
        return {"sizes": self.sizes.tobytes(), "bits": self.bits.tobytes(), "prints": self.prints.tobytes(), "counts": self.counts.tobytes(), "width": str(self.counts.dtype)}

    @classmethod
    def unpacked(cls, row) -> Index:
        return cls(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], U64), np.frombuffer(row["prints"], U64), np.frombuffer(row["counts"], np.dtype(row["width"])))


_SHARDS = "shard bigint, sizes binary, bits binary, prints binary, counts binary, width string"


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    data, offsets = _text.column(batch.column("text"))
    held, ends = data.tobytes(), offsets.tolist()
    return [held[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def held(docs: DataFrame, least_chars: int) -> DataFrame:
    """high, low, n: how many documents hold each key, from every batch."""

    def run(batches):
        for batch in _text.parts(batches):
            times: dict[bytes, int] = {}
            for text in _texts(batch):
                for k in {key(line) for line in text.split(b"\n")}:
                    times[k] = times.get(k, 0) + 1
            keys = [k for k in times if long_enough(k, least_chars)]
            high, low = halves([digest(k) for k in keys])
            yield pa.RecordBatch.from_pydict({"high": pa.array(high.view(np.int64)), "low": pa.array(low.view(np.int64)), "n": pa.array([times[k] for k in keys], pa.int64())})

    return docs.select("text").mapInArrow(run, "high bigint, low bigint, n bigint")


def index(docs: DataFrame, tables: Tables, least_docs: int = 10, least_chars: int = 1) -> tuple[DataFrame, int]:
    """The shards over the distinct hashes of keys that ``least_docs`` documents hold, and how many shards there are."""
    counted = held(docs, least_chars).groupBy("high", "low").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs)
    counted = tables.write(counted, "counted")
    shards = max(1, -(-counted.count() // SHARD))

    def build(table: pa.Table) -> pa.Table:
        high, low, n = (table.column(c).to_numpy() for c in ("high", "low", "n"))
        packed = Index.build(high.view(U64), low.view(U64), n).packed()
        return pa.table({"shard": table.column("shard")[:1], **{c: pa.array([x]) for c, x in packed.items()}})

    built = counted.select(_shard(shards), "high", "low", "n").groupBy("shard").applyInArrow(build, _SHARDS)
    return tables.write(built, "shards"), shards


def _shard(shards: int):
    return F.pmod(F.col("high"), F.lit(shards)).alias("shard")


def _shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return high.view(np.int64) % shards


def _kept(text: bytes, drop: set[bytes]) -> tuple[str, int, int]:
    lines = text.split(b"\n")
    stay = [x for x in lines if key(x) not in drop]
    return b"\n".join(stay).decode("utf-8", "replace"), len(lines), len(lines) - len(stay)


def _finished(batch: pa.RecordBatch, texts: list[bytes], drops: list[set[bytes]]) -> pa.RecordBatch:
    kept = [_kept(t, d) for t, d in zip(texts, drops, strict=True)]
    cols = [batch.column("row"), *[pa.array([x[k] for x in kept], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]]
    return pa.RecordBatch.from_arrays(cols, names=["row", "kept", "n_lines", "n_dropped"])


def straight(rows: DataFrame, shards: DataFrame, n_shards: int, schema: StructType, least_chars: int) -> DataFrame:
    """Every task probes the whole index, whose size was checked."""
    sent = rows.sparkSession.sparkContext.broadcast([r.asDict() for r in shards.collect()])

    def run(batches):
        own = {r["shard"]: Index.unpacked(r) for r in sent.value}
        for batch in _text.parts(batches):
            texts = _texts(batch)
            keys = [{k for line in t.split(b"\n") if long_enough(k := key(line), least_chars)} for t in texts]
            every = list(set().union(*keys))
            high, low = halves([digest(k) for k in every])
            shard, found = _shard_of(high, n_shards), np.zeros(len(every), np.int64)
            for s, ix in own.items():
                at = np.flatnonzero(shard == s)
                found[at] = ix.count(high[at], low[at])
            common = {every[k] for k in np.flatnonzero(found)}
            yield _finished(batch, texts, [k & common for k in keys])

    return rows.mapInArrow(run, schema)


def routed(rows: DataFrame, shards: DataFrame, n_shards: int, schema: StructType, least_chars: int, tables: Tables) -> DataFrame:
    """Hashes go to the shards; those found go back to their documents by number."""
    rows = tables.write(rows.withColumn("id", F.monotonically_increasing_id()), "rows")

    def ask(batches):
        for batch in _text.parts(batches):
            ids, digests = [], []
            for i, text in zip(batch.column("id").to_pylist(), _texts(batch), strict=True):
                own = {digest(k) for line in text.split(b"\n") if long_enough(k := key(line), least_chars)}
                ids += [i] * len(own)
                digests += own
            high, low = halves(digests)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "high": pa.array(high.view(np.int64)), "low": pa.array(low.view(np.int64))})

    asked = tables.write(rows.select("id", "text").mapInArrow(ask, "id bigint, high bigint, low bigint").select("*", _shard(n_shards)), "asked")
    copies = tables.write(asked.groupBy("shard").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("copies")), "copies")
    asked = asked.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int"))
    there = shards.join(copies.select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")), "shard")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = left.select(["id", "high", "low"])
        if not len(left) or not len(right):
            return asked.slice(0, 0)
        high, low = (left.column(c).to_numpy().view(U64) for c in ("high", "low"))
        return asked.take(pa.array(np.flatnonzero(Index.unpacked(right.to_pylist()[0]).count(high, low))))

    hits = asked.groupBy("shard", "copy").cogroup(there.groupBy("shard", "copy")).applyInArrow(answer, "id bigint, high bigint, low bigint")
    back = hits.groupBy("id").agg(F.collect_list(F.struct("high", "low")).alias("hits"))

    def run(batches):
        for batch in _text.parts(batches):
            texts, drops = _texts(batch), []
            for text, found in zip(texts, batch.column("hits").to_pylist(), strict=True):
                drop = {np.array([x["high"], x["low"]], np.int64).tobytes() for x in found or ()}
                drops.append({k for line in text.split(b"\n") if long_enough(k := key(line), least_chars) and digest(k) in drop} if drop else set())
            yield _finished(batch, texts, drops)

    return rows.join(back, "id", "left").select("row", "text", "hits").mapInArrow(run, schema)


def _found(docs: DataFrame, columns: list[str], least_docs: int, least_chars: int) -> DataFrame:
    """row (the struct of ``columns``), kept, n_lines, n_dropped."""
    tables = Tables(docs.sparkSession, "lines")
    shards, n = index(docs, tables, least_docs, least_chars)
    size = shards.agg(F.sum(sum(F.length(c) for c in ("sizes", "bits", "prints", "counts")))).first()[0] or 0
    rows = docs.select(F.struct(*([F.col(f"`{c}`") for c in columns] or [F.lit(0).alias("none")])).alias("row"), "text")
    schema = StructType([rows.schema["row"], StructField("kept", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return straight(rows, shards, n, schema, least_chars) if size <= BROADCAST else routed(rows, shards, n, schema, least_chars, tables)


def report(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """Every document's doc_id, kept text, n_lines before dropping and n_dropped."""
    return _found(docs, ["doc_id"], least_docs, least_chars).select("row.doc_id", "kept", "n_lines", "n_dropped")


def drop_common(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """``docs`` with the lines that ``least_docs`` documents share taken out of their texts."""
    others = [c for c in docs.columns if c != "text"]
    found = _found(docs, others, least_docs, least_chars)
    return found.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
