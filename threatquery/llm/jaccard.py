"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is the set of its distinct shingles of five words; two documents
link when 100 * |x & y| >= 75 * |x | y|. The join runs over an inverted index
from shingles to documents:

1. Documents with the same set form one class, and only its least id goes on.
2. ``sieve``: half of each set (the least hashes) is indexed. A document of
   which too few of these shingles lie in a list with another document cannot
   reach the required overlap T with any, and leaves. A hash is sent once for
   each batch, however many of its documents hold it, so hot lists stay short.
3. The rest are indexed whole with the lengths of their lists. T - 1 of a
   document's lists may be set aside as long ones; it must meet each partner in
   one of the remaining short lists.
4. Each document meets the least one of each of its short lists (a star, as many
   pairs as postings). Documents that a link has connected need not meet again.
5. Lists that still hold several components are searched: those of few members
   pair by pair, the others in blocks. A block has the members of like size and
   like place, which is how many shorter lists a member has before this one. Only
   blocks meet whose sizes are near and whose places leave room for the overlap,
   and lists with the same members are searched once. So of the documents that
   share a list, those whose own shingles before it are too many to link cost a
   row each.
6. All of these meetings are cells of bounded size: records, of which inverted
   lists are made, and queries. ``Lists.search`` finds the records of a query by
   DivideSkip: its short lists are merged by a heap, its long ones probed by
   binary search, and the counts decide.
7. Links and classes give components by min-label rounds.

Edge cases: a text with fewer words than five is one shingle; a null text or
one without words has no shingles and links with nothing; rows without doc_id
take no part and have no component; rows that repeat a doc_id share its
component; an empty table gives no rows; other columns, whatever their names,
are not read, and pass through ``keep_one`` untouched.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatquery.llm import _text
from threatquery.llm._components import components
from threatquery.llm._store import Tables

SIZE = 5
#: Two documents link when PER * overlap >= LEAST * union.
LEAST, PER = 75, 100
#: Shingles of a row of the second index.
CHUNK = 1 << 20
#: Documents whose counts are summed together, and shingles whose lists are counted together.
GROUP, POSTS = 1 << 14, 1 << 21
#: Shingles and documents of either side of a cell, about; members of a list that meet pair by pair.
CELL, MEMBERS, PAIRS = 1 << 20, 256, 64
#: Blocks of a list: sizes between two powers of STEP, places between two of so many parts of those that short lists reach.
STEP, SHARES = 1.08, 7
#: Entries that a heap merges, and probes that are made at once, at most.
HEAP, PROBES = 1 << 12, 1 << 20
_FACTORS = [_text.U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(array: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data, offsets = _text.column(array)
    out = []
    for a, b in _text.slices(offsets):
        found = _text.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _text.SPACED)
        h = found.hashes()
        total = np.zeros(max(len(h) - SIZE + 1, 0), np.uint64)
        for k in range(SIZE):
            total += h[k : len(h) - SIZE + 1 + k] * _FACTORS[k]
        total = _text.mix(total)
        for x, y in zip(found.first[:-1], found.first[1:], strict=True):
            if y - x >= SIZE:
                out.append(np.unique(total[x : y - SIZE + 1]))
            elif y > x:
                short = np.array([y - x], np.uint64)
                for k in range(x, y):
                    short = short + h[k : k + 1] * _FACTORS[k - x]
                out.append(_text.mix(short))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def overlap(n, m):
    """The least overlap of two linked sets of n and m shingles."""
    return -(-(LEAST * (n + m)) // (PER + LEAST))


def least_shared(n: np.ndarray) -> np.ndarray:
    """A bound from below on the shared ones among the (n + 1) // 2 least hashes of a set that links.

    With the lesser of the two cut points at this set, the overlap less what
    lies beyond the cut is in both halves; else the same holds for the partner.
    """
    small, big = -(-LEAST * n // PER), PER * n // LEAST
    own = overlap(n, small) - n + (n + 1) // 2
    other = overlap(n, big) - big + (big + 1) // 2
    return np.maximum(np.minimum(own, other) - 1, 1)


def planes(x: np.ndarray) -> bytes:
    """Bytes by significance, so that the shuffle's compression finds the constant ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("doc_id"), dtype=np.int64)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and a 128-bit print of each document's set."""

    def run(batches):
        for batch in _text.parts(batches):
            found = shingles(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([_text.mix(s).sum(dtype=np.uint64).astype(np.int64) for s in found], pa.int64()),
                    pa.array([_text.mix(s ^ _FACTORS[0]).sum(dtype=np.uint64).astype(np.int64) for s in found], pa.int64()),
                ],
                names=["doc_id", "n_shingles", "p", "q"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, p bigint, q bigint")


_POSTS = "bucket int, hashes binary, ids binary, n binary"


def sieve(docs: DataFrame, buckets: int, groups: int) -> DataFrame:
    """doc_ids whose shared half-set is large enough for a link. Counts are summed by group of documents."""

    def send(batches):
        for batch in _text.parts(batches):
            ids = _ids(batch)
            found = shingles(batch.column("text"))
            sizes = np.array([len(s) for s in found], np.int64)
            half = (sizes + 1) // 2
            if not half.sum():
                continue
            h = np.concatenate([s[:k] for s, k in zip(found, half, strict=True)])
            owner = np.repeat(np.arange(len(ids)), half)
            by = np.argsort(h, kind="stable")
            h, owner = h[by], owner[by]
            cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            many = np.diff(np.r_[cuts, len(h)])
            known = np.bincount(owner[np.repeat(many > 1, many)], minlength=len(ids))
            id_of = np.where(many > 1, np.int64(-1), ids[owner[cuts]])
            h = h[cuts]
            bucket = ((h >> _text.U64(32)) & _text.U64(0xFFFFFF)).astype(np.int64) % buckets
            rest = (h & _text.U64(0xFFFFFFFF)).astype(np.uint32)
            by = np.lexsort((rest, bucket))
            bucket, rest, id_of = bucket[by], rest[by], id_of[by]
            live = sizes > 0
            rows = [(int(bucket[a]), planes(rest[a:b]), planes(id_of[a:b]), b"") for a, b in _text.runs(bucket)]
            # what this batch knows already: the documents, their sizes and locally shared shingles
            rows.append((int(bucket[0]), planes(known[live].astype(np.uint32)), planes(ids[live]), planes(sizes[live].astype(np.uint32))))
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "hashes", "ids", "n"), r, strict=True)) for r in rows], schema=pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("n", pa.binary())]))

    def count(table: pa.Table) -> pa.Table:
        h, ids, out = [], [], []
        for a, b, n in zip(table.column("hashes").to_pylist(), table.column("ids").to_pylist(), table.column("n").to_pylist(), strict=True):
            if n:
                out.append((unplanes(b, np.int64), unplanes(n, np.uint32).astype(np.int64), unplanes(a, np.uint32).astype(np.int64)))
            else:
                h.append(unplanes(a, np.uint32))
                ids.append(unplanes(b, np.int64))
        if h:
            h, ids = np.concatenate(h), np.concatenate(ids)
            by = np.argsort(h, kind="stable")
            h, ids = h[by], ids[by]
            same = h[1:] == h[:-1]
            shared = np.r_[False, same] | np.r_[same, False]
            one, times = np.unique(ids[shared & (ids != -1)], return_counts=True)
            out.append((one, np.zeros(len(one), np.int64), times))
        ids, n, shared = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))
        group = (_text.mix(ids.view(np.uint64)) % _text.U64(groups)).astype(np.int32)
        by = np.lexsort((ids, group))
        group, ids, n, shared = group[by], ids[by], n[by].astype(np.uint32), shared[by].astype(np.uint32)
        rows = [{"own": int(group[x]), "ids": planes(ids[x:y]), "n": planes(n[x:y]), "shared": planes(shared[x:y])} for x, y in _text.runs(group)]
        return pa.Table.from_pylist(rows, schema=pa.schema([("own", pa.int32()), ("ids", pa.binary()), ("n", pa.binary()), ("shared", pa.binary())]))

    def passed(table: pa.Table) -> pa.Table:
        ids, n, shared = (np.concatenate([unplanes(b, kind) for b in table.column(c).to_pylist()]) for c, kind in (("ids", np.int64), ("n", np.uint32), ("shared", np.uint32)))
        one, of = np.unique(ids, return_inverse=True)
        most = np.zeros(len(one), np.int64)
        np.maximum.at(most, of, n.astype(np.int64))
        return pa.table({"doc_id": one[np.bincount(of, shared, len(one)) >= least_shared(most)]})

    posts = docs.select("doc_id", "text").mapInArrow(send, _POSTS)
    counts = posts.groupBy("bucket").applyInArrow(count, "own int, ids binary, n binary, shared binary")
    return counts.groupBy("own").applyInArrow(passed, "doc_id bigint")


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of packed sets; ``chunk`` is the id of the first document, and so different in each row."""

    def run(batches):
        for batch in _text.parts(batches):
            ids, found = _ids(batch), shingles(batch.column("text"))
            ends = np.cumsum([0] + [len(s) for s in found])
            for a, b in _text.slices(ends, CHUNK):
                own = np.concatenate(found[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(ids[a])], pa.int64()), pa.array([ids[a:b].tobytes()], pa.binary()), pa.array([np.diff(ends[a : b + 1]).astype(np.int64).tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary())],
                    names=["chunk", "ids", "sizes", "hashes"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "chunk bigint, ids binary, sizes binary, hashes binary")


def lengths(chunks: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket and the list lengths of the chunk's distinct hashes of that bucket, in their order."""

    def send(batches):
        for batch in batches:
            for chunk, b in zip(batch.column("chunk").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                h, times = np.unique(np.frombuffer(b, np.uint64), return_counts=True)
                bucket = (h & _text.U64(0xFFFFFFFF)).astype(np.int64) % buckets
                for k in np.unique(bucket):
                    own = bucket == k
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([chunk], pa.int64()), pa.array([planes(h[own])], pa.binary()), pa.array([planes(times[own].astype(np.uint32))], pa.binary())],
                        names=["bucket", "chunk", "hashes", "times"],
                    )

    def total(table: pa.Table) -> pa.Table:
        keys = [unplanes(b, np.uint64) for b in table.column("hashes").to_pylist()]
        times = [unplanes(b, np.uint32) for b in table.column("times").to_pylist()]
        _, of = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(of, np.concatenate(times))[of].astype(np.uint32)
        parts = np.split(sums, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "df": pa.array([planes(p) for p in parts], pa.binary())})

    posts = chunks.select("chunk", "hashes").mapInArrow(send, "bucket int, chunk bigint, hashes binary, times binary")
    return posts.groupBy("bucket").applyInArrow(total, "chunk bigint, bucket int, df binary")


def short_lists(chunks: DataFrame, buckets: int) -> DataFrame:
    """Postings (h, doc_id, n, place) of every document's short lists, rarest first; place counts the lists before it."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"h": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "place": np.zeros(0, np.int64)}
        if not left.num_rows:
            return pa.table(empty)
        ids = np.frombuffer(left.column("ids")[0].as_py(), np.int64)
        sizes = np.frombuffer(left.column("sizes")[0].as_py(), np.int64)
        h = np.frombuffer(left.column("hashes")[0].as_py(), np.uint64)
        one, of = np.unique(h, return_inverse=True)
        bucket = (one & _text.U64(0xFFFFFFFF)).astype(np.int64) % buckets
        df = np.zeros(len(one), np.int64)
        for k, b in zip(right.column("bucket").to_pylist(), right.column("df").to_pylist(), strict=True):
            df[bucket == k] = unplanes(b, np.uint32)
        df = df[of]
        owner = np.repeat(np.arange(len(ids)), sizes)
        by = np.lexsort((h, df, owner))
        place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        n = sizes[owner]
        keep = (place <= n - -(-LEAST * n // PER)) & (df[by] > 1)
        return pa.table({"h": h[by][keep].view(np.int64), "doc_id": ids[owner[keep]], "n": n[keep], "place": place[keep]})

    found = lengths(chunks, buckets)
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(cut, "h bigint, doc_id bigint, n bigint, place bigint")


class Lists:
    """The inverted lists of some records (sorted sets)."""

    def __init__(self, records: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in records], np.int64)
        flat, owner = np.concatenate(records), np.repeat(np.arange(len(records)), self.sizes)
        by = np.argsort(flat, kind="stable")
        flat, self.owners = flat[by], owner[by]
        self.first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        self.keys = flat[self.first]
        self.lengths = np.diff(np.r_[self.first, len(flat)])
        # (list, record) of every entry, in order: one array to probe for all lists
        self.entries = np.repeat(np.arange(len(self.keys)), self.lengths) * len(records) + self.owners

    def at_least(self, query: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Records that hold ``need`` or more of the query's shingles, and how many, by DivideSkip."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        lists = at[self.keys[at] == query]
        if not 0 < need <= len(lists):
            return none
        lists = lists[np.argsort(self.lengths[lists], kind="stable")]
        aside = min(need - 1, int(need / (0.01 * np.log2(int(self.lengths[lists[-1]]) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        ids, times = self.merged(short)
        near = times >= need - aside
        ids, times = ids[near], times[near]
        if not len(ids):
            return none
        for a in range(0, len(long), step := max(1, PROBES // len(ids))):
            probes = (long[a : a + step, None] * len(self.sizes) + ids).ravel()
            place = np.minimum(np.searchsorted(self.entries, probes), len(self.entries) - 1)
            times = times + (self.entries[place] == probes).reshape(-1, len(ids)).sum(0)
        enough = times >= need
        return ids[enough], times[enough]

    def merged(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The records of some lists and how often each occurs. Numpy counts what would take a heap in Python too long."""
        if int(self.lengths[lists].sum()) > HEAP:
            times = np.bincount(self.owners[_text.spread(self.first[lists], self.lengths[lists])], minlength=len(self.sizes))
            ids = np.flatnonzero(times)
            return ids, times[ids]
        found = [(k, sum(1 for _ in g)) for k, g in groupby(heapq.merge(*(self.owners[self.first[x] : self.first[x] + self.lengths[x]].tolist() for x in lists)))]
        ids, times = np.array(found, np.int64).reshape(-1, 2).T
        return ids, times

    def search(self, query: np.ndarray) -> np.ndarray:
        """Records that link with the query."""
        n = len(query)
        band = self.sizes[(PER * self.sizes >= LEAST * n) & (LEAST * self.sizes <= PER * n)]
        if not len(band):
            return np.zeros(0, np.int64)
        ids, both = self.at_least(query, int(overlap(n, band.min())))
        return ids[PER * both >= LEAST * (n + self.sizes[ids] - both)]


def searched(cells: DataFrame, members: DataFrame) -> DataFrame:
    """The links (u, v) within cells. ``cells``: cell, query (whether the row asks or is a record), doc_id, label; documents of one label need no link. ``members``: doc_id, own (packed sorted set)."""
    rows = cells.join(members, "doc_id").repartition("cell").sortWithinPartitions("cell", "query")

    def run(batches):
        cell, records, lists, ids, labels = None, [], None, [], []
        for batch in batches:
            u, v = [], []
            for c, asks, doc, label, own in zip(*(batch.column(k).to_pylist() for k in ("cell", "query", "doc_id", "label", "own")), strict=True):
                if c != cell:
                    cell, records, lists, ids, labels = c, [], None, [], []
                if not asks:  # the records of a cell come before its queries
                    records.append(np.frombuffer(own, np.uint64))
                    ids.append(doc)
                    labels.append(label)
                elif records:
                    lists = lists or Lists(records)
                    for k in lists.search(np.frombuffer(own, np.uint64)).tolist():
                        if ids[k] != doc and labels[k] != label:
                            u.append(doc)
                            v.append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.select("cell", "query", "doc_id", "label", "own").mapInArrow(run, "u bigint, v bigint")


def cells_of_pairs(pairs: DataFrame) -> DataFrame:
    """Cells of the pairs (u, v, m: the shingles of v; x, y: their labels): u asks, its partners are records, in cells of about CELL shingles and MEMBERS records."""
    wide = pairs.groupBy("u").agg(F.greatest(F.ceil(F.sum("m") / CELL), F.ceil(F.count("*") / MEMBERS)).alias("parts")).where("parts > 1")
    placed = pairs.join(wide, "u", "left").withColumn("cell", F.xxhash64("u", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1)))))
    asks = placed.select("cell", F.lit(True).alias("query"), F.col("u").alias("doc_id"), F.col("x").alias("label")).distinct()
    return asks.unionByName(placed.select("cell", F.lit(False).alias("query"), F.col("v").alias("doc_id"), F.col("y").alias("label")))


def meets(x: Column, y: Column) -> Column:
    """Whether documents of two blocks (step of the size, share of the place) of a list may link there.

    At their first common list all that two documents share comes from it on, so
    of n and m shingles each must have LEAST / (PER + LEAST) * (n + m) left. The
    sizes of a block lie between two powers of STEP; a little is added for the
    rounding of logarithms.
    """
    ratio = F.pow(F.lit(STEP), y["step"] - x["step"] - 1) * 0.999999  # m / n is no less
    most = F.lit(PER / LEAST + 1) * (1 - x["share"] / (4 * SHARES)) - 1
    return (ratio <= most) & (ratio <= PER / LEAST)


def cells_of_lists(named: DataFrame) -> DataFrame:
    """Cells of whole lists (h, doc_id, n, place, label, outside): every two blocks of which one is outside and that may hold linked documents, by their sizes and places.

    So documents that share boilerplate, but hold too much of their own before
    it, meet no one there, however many they are.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(STEP))).cast("int")
    share = F.floor(4 * SHARES * F.col("place") / F.col("n")).cast("int")  # short lists end at a quarter
    prints = [F.sum(F.xxhash64("doc_id", "outside", F.lit(k)).cast("decimal(38,0)")).alias(f"print{k}") for k in (0, 1)]
    # Of lists with the same documents the first counts, as hashes are ordered without a sign.
    first = F.min(F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).bitwiseXOR(F.lit(-(1 << 63))).alias("h")
    alike = named.groupBy("h").agg(F.count("*").alias("many"), *prints).groupBy("many", "print0", "print1").agg(first).select("h")
    rows = named.join(alike, "h", "left_semi").select("h", "doc_id", "n", "label", "outside", step.alias("step"), share.alias("share"))
    key = ["h", "outside", "step", "share"]
    whole = rows.groupBy(*key).agg(F.greatest(F.ceil(F.sum("n") / CELL), F.ceil(F.count("*") / MEMBERS)).cast("int").alias("parts"))
    rows = rows.join(whole, key).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    x = whole.where("outside").select("h", "parts", F.struct("step", "share").alias("x"))
    y = whole.select("h", F.col("outside").alias("far"), F.col("parts").alias("others"), F.struct("step", "share").alias("y"))
    # whole blocks meet first, and only those that may link are cut into parts
    meet = x.join(y, "h").where(meets(F.col("x"), F.col("y")) & meets(F.col("y"), F.col("x")) & F.expr("not far or x <= y"))
    meet = meet.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    meet = meet.where("not far or x < y or i <= j").withColumn("cell", F.xxhash64("h", "far", "x", "y", "i", "j"))
    asks = meet.select("h", F.lit(True).alias("outside"), F.col("x.step").alias("step"), F.col("x.share").alias("share"), F.col("i").alias("part"), "cell", F.lit(True).alias("query"))
    held = meet.select("h", F.col("far").alias("outside"), F.col("y.step").alias("step"), F.col("y.share").alias("share"), F.col("j").alias("part"), "cell", F.lit(False).alias("query"))
    return rows.join(asks.unionByName(held), [*key, "part"]).select("cell", "query", "doc_id", "label")


def unpacked(chunks: DataFrame) -> DataFrame:
    """doc_id and its packed set."""

    def run(batches):
        for batch in batches:
            for a, b, c in zip(*(batch.column(k).to_pylist() for k in ("ids", "sizes", "hashes")), strict=True):
                ends = np.cumsum(np.r_[0, np.frombuffer(b, np.int64)]) * 8
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array([c[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["doc_id", "own"])

    return chunks.mapInArrow(run, "doc_id bigint, own binary")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    spark = docs.sparkSession
    tables = Tables(spark, "jaccard")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    every = tables.write(sets(docs), "sets")
    known = every.where("doc_id is not null and n_shingles > 0")
    reps = tables.write(known.groupBy("n_shingles", "p", "q").agg(F.min("doc_id").alias("rep")), "reps")
    many, total = (int(x or 0) for x in every.agg(F.count("*"), F.sum("n_shingles")).first())
    # A bucket is held whole by a task, so their number follows the shingles.
    left = sieve(docs.where("doc_id is not null"), max(tasks, -(-total // (2 * POSTS))), max(tasks, -(-many // GROUP))).join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    left = tables.write(left.distinct(), "left")
    chunks = tables.write(chunked(docs.join(left, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])), "chunks")
    total = int(chunks.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // 8
    short = tables.write(short_lists(chunks, max(tasks, -(-total // POSTS))).distinct(), "short")
    members = tables.write(unpacked(chunks), "members")
    tables.drop("left", "chunks")

    hubs = short.groupBy("h").agg(F.min(F.struct("doc_id", "n")).alias("hub"), F.count("*").alias("many")).where("many > 1")
    near = f"{PER} * n >= {LEAST} * m and {PER} * m >= {LEAST} * n"
    stars = short.join(hubs.select("h", F.col("hub.doc_id").alias("u"), F.col("hub.n").alias("m")), "h")
    stars = stars.where(f"doc_id <> u and {near}").select("u", F.col("doc_id").alias("v"), F.col("n").alias("m"), F.col("u").alias("x"), F.col("doc_id").alias("y")).distinct()
    first = tables.write(searched(cells_of_pairs(tables.write(stars, "stars")), members), "star-links")
    label = components(first, tables, "star")

    named = short.join(label.select(F.col("u").alias("doc_id"), F.col("v").alias("label")), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    # Every pair across labels has a member outside the label that the list's star has gathered.
    open_ = named.groupBy("h").agg(F.min(F.struct("doc_id", "label")).alias("hub"), F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("many"))
    open_ = open_.where("x <> y").select("h", F.col("hub.label").alias("inner"), (F.col("many") > PAIRS).alias("wide"))
    named = tables.write(named.join(open_, "h").withColumn("outside", F.expr("label <> inner")), "open")
    few = named.where("not wide")
    other = few.select("h", F.col("doc_id").alias("v"), F.col("n").alias("m"), F.col("place").alias("there"), F.col("label").alias("y"), F.col("outside").alias("far"))
    need = f"ceil({LEAST} * (n + m) / {PER + LEAST})"
    pairs = few.where("outside").withColumnsRenamed({"doc_id": "u", "label": "x"}).join(other, "h")
    pairs = pairs.where(f"(u < v or not far) and x <> y and {near} and n - place >= {need} and m - there >= {need}").select("u", "v", "m", "x", "y").distinct()
    cells = cells_of_pairs(tables.write(pairs, "pairs")).unionByName(cells_of_lists(named.where("wide")))
    second = tables.write(searched(cells, members), "cross-links")
    tables.drop("open", "members", "short", "stars", "pairs")
    label = components(label.unionByName(second), tables, "all")

    least = reps.join(label.select(F.col("u").alias("rep"), F.col("v").alias("least")), "rep", "left").select("n_shingles", "p", "q", F.coalesce("least", "rep").alias("component_id"))
    # Written first, so that the join may split the rows of a class with very many copies.
    out = every.join(tables.write(least, "least"), ["n_shingles", "p", "q"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those whose component has a smaller doc_id, with all their columns."""
    gone = classes(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
