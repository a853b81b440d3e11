"""Best-fit packing of token pieces into sequences by best-two-fit.

A document's tokens end with id 0; only a document longer than a sequence is
cut, into full pieces and a shorter first one. Bins depend on lengths alone, so
packing works on the histogram of lengths, which has at most CAPACITY entries
at any size of the input: a bin is filled greedily with the longest pieces that
fit, then its smallest piece gives way to two unpacked ones that fill the
expanded gap more tightly, and the resulting pattern is taken as often as the
counts allow. Pieces of one length are interchangeable: each is numbered within
its length, by salted counts so that a frequent length isn't ranked in one
task, and its number determines its sequence and offset.

Edge cases: a null or empty text is the single token 0; repeated rows are
packed each; an empty table gives no rows; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatquery.llm._store import Tables

CAPACITY = 2048
END = 0
#: Parts in which the pieces of one length are numbered, at most.
SALTS = 1024
#: The split pattern of the byte-level BPE family, for vocabularies that name it only as "ByteLevel".
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBE = "It's  a test,\n\n\twith 123 numbers — naïve “quotes”, ünïcode 漢字 🙂 and   spaces \n"


def _byte_of() -> dict[str, int]:
    """The visible character of each byte in byte-level vocabularies, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _plain(path: str):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: slow.encode(text, add_special_tokens=False).ids


def _fast(path: str):
    """tiktoken over the file's own vocabulary, or None if the file isn't a plain byte-level BPE."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        return None
    byte_of, special = _byte_of(), {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _added(path: str) -> list[str]:
    """The strings that the file takes out of a text as one token each."""
    with open(path, encoding="utf-8") as file:
        return [x["content"] for x in json.load(file).get("added_tokens", [])]


def same_ids(path: str) -> bool:
    """Whether tiktoken, in a quarter of the time, gives the ids that tokenizers gives."""
    fast = _fast(path)
    return fast is not None and fast(_PROBE) == _plain(path)(_PROBE)


@lru_cache(maxsize=4)
def encoder(path: str, quick: bool):
    """text -> ids as of tokenizers, with none added at the ends; the string of an added token in a text is that token."""
    if not quick:
        return _plain(path)
    fast, added = _fast(path), _added(path)

    def encode(text: str) -> list[int]:
        if any(x in text for x in added):  # tiktoken would cut the string into ordinary pieces
            return encoder(path, False)(text)
        try:
            return fast(text)
        except BaseException as e:  # the Rust side gives up on some very long runs of blanks
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return encoder(path, False)(text)

    return encode


def pieces(docs: DataFrame, path: str, with_ids: bool = False, rows: int = 256) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, packed uint32) of every piece."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    quick = same_ids(path)

    def run(batches):
        encode = encoder(path, quick)
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                owner, out = [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), END], "<u4")
                    cut = (len(ids) - 1) % CAPACITY + 1
                    ends = [0, *range(cut, len(ids) + 1, CAPACITY)]
                    for p, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                        own = ids[x:y].tobytes()
                        owner.append(k)
                        out.append((p, x, y - x, zlib.crc32(own), own))
                cols = [part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array([x[0] for x in out], pa.int32())]
                cols += [pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3)]
                if with_ids:
                    cols.append(pa.array([x[4] for x in out], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins) that hold all pieces of the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    every = np.arange(capacity + 1)
    out = []
    while (open_ := np.flatnonzero(left)).size:
        bin_ = [int(open_[-1])]
        left[bin_[0]] -= 1
        gap = capacity - bin_[0]
        fits = np.maximum.accumulate(np.where(left > 0, every, 0))
        while gap and (best := int(fits[gap])):
            take = min(int(left[best]), gap // best)
            bin_ += [best] * take
            left[best] -= take
            gap -= best * take
            if gap:
                fits = np.maximum.accumulate(np.where(left > 0, every, 0))
        while gap and len(bin_) > 1:
            small = bin_[-1]
            room = gap + small
            one = np.flatnonzero(left[: room + 1])
            fits = np.maximum.accumulate(np.where(left > 0, every, 0))
            two = fits[np.minimum(room - one, one)]
            alone = (two == one) & (left[one] < 2)
            below = fits[np.maximum(one - 1, 0)]
            two = np.where(alone, np.minimum(below, fits[np.minimum(room - one, np.maximum(one - 1, 0))]), two)
            total = np.where(two > 0, one + two, 0)
            if not total.size or total.max() <= small:
                break
            k = int(total.argmax())
            left[small] += 1
            pair = sorted((int(one[k]), int(two[k])), reverse=True)
            for x in pair:
                left[x] -= 1
            bin_ = sorted([*bin_[:-1], *pair], reverse=True)
            gap = room - sum(pair)
        lengths, used = np.unique(bin_, return_counts=True)
        times = 1 + int((left[lengths] // used).min())
        left[lengths] -= used * (times - 1)
        out.append((bin_, times))
    return out


def slots(found: list[tuple[list[int], int]], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length rows of (first number, sequence of that number, offset), by number."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    first = 0
    for bin_, times in found:
        offset = 0
        for length in bin_:
            at = taken.get(length, 0)
            out.setdefault(length, []).append((at, first, offset))
            taken[length] = at + times
            offset += length
        first += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(found: DataFrame) -> DataFrame:
    """``pieces`` with sequence_id and offset: gapless from 0 within a sequence, CAPACITY at most."""
    spark = found.sparkSession
    tables = Tables(spark, "packing")
    salts = min(SALTS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = ["doc_id", "piece", "ids_crc32"]
    salted = tables.write(found.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")), "pieces")
    many = tables.write(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "counts")
    counts = {r[0]: r[1] for r in many.groupBy("length").agg(F.sum("_n")).collect()}  # CAPACITY rows at most
    places = spark.sparkContext.broadcast(slots(patterns(counts)))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    before = many.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))
    # The pieces are dealt and sorted by length and salt already; the counts (CAPACITY * SALTS rows at most) come to them.
    ranked = salted.withColumn("_number", number).join(before.hint("merge"), ["length", "_salt"]).withColumn("_number", F.col("_number") - 1 + F.col("_before"))

    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)), dtype=np.int64) for c in ("length", "_number"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = length == k
                table = places.value[int(k)]
                at = np.searchsorted(table[:, 0], rank[own], "right") - 1
                sequence[own] = table[at, 1] + rank[own] - table[at, 0]
                offset[own] = table[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in found_names), pa.array(sequence), pa.array(offset)], names=[*found_names, "sequence_id", "offset"])

    found_names = found.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return ranked.select(*found_names, "_number").mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids (packed uint32) of whole sequences; ``placed``: packed pieces with their ids."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", F.expr("aggregate(own, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
