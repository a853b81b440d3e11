"""Benchmark decontamination with an FM-index per training shard.

Benchmark items give windows of 13 consecutive words (an item of fewer words is
one window). A shard is an Arrow batch of documents. Its index covers every
place where a window can occur: the runs of words of the benchmark's
vocabulary, in order, that are no shorter than the shortest window. Over these
words it keeps the Burrows-Wheeler transform in a wavelet matrix, and samples
of the suffix array. All windows are searched backwards at once by ranks, their
occurrences are located by walking to sampled positions, and the words that
they cover are merged into removal spans.

The windows go to the tasks in blocks of at most BLOCK_WORDS, with the words that
occur in them. A benchmark of one block is searched in one step over the
documents, and nothing is shuffled. With more, documents are written once with
numbers, each block is searched in a step of its own over all of them, so that a
task holds one block whatever the benchmark's size, and what the steps found is
merged by number.

Edge cases: a null text or one without words has no words and no hits; items
that are null, without an id or without words take no part; items that repeat
an id count once; equal rows get equal results; an empty table gives no rows;
other columns, whatever their names, pass through ``keep_clean`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatquery.llm import _text
from threatquery.llm._store import Tables

WINDOW = 13
#: Windows of a block of the benchmark; its broadcast takes some 70 bytes a window.
BLOCK_WORDS = 1_000_000
#: Every so many positions the suffix array is sampled.
SAMPLE = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for k in range(bits - 1, -1, -1):
            bit = (sequence >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(sequence) - bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place, plus the place where its block starts."""
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            before = self.ones[level][at]
            at = np.where((symbol >> k) & 1, self.zeros[level] + before, at - before)
        return at

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank as ``rank`` gives it."""
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            before = self.ones[level][at]
            bit = self.ones[level][at + 1] - before
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[level] + before, at - before)
        return symbol, at


class FMIndex:
    """Over runs of symbols (1 and more) that are each ended by a 0."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        n = len(sequence)
        self.n = n
        ends = sequence == 0
        # Each end is a symbol of its own below all others, so no comparison goes past it.
        rank = np.where(ends, np.cumsum(ends) - 1, sequence.astype(np.int64) + int(ends.sum()))
        order, width = np.argsort(rank, kind="stable"), 1
        while True:
            key = rank[order] if width == 1 else key[order]
            fresh = np.r_[0, np.cumsum(key[1:] != key[:-1])]
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            key = rank * (n + 1) + after
            order, width = np.argsort(key, kind="stable"), width * 2
        before = np.where(order > 0, sequence[order - 1], 0)
        self.bits = max(1, int(symbols).bit_length())
        self.tree = WaveletMatrix(before.astype(np.int64), self.bits)
        counts = np.bincount(sequence, minlength=symbols + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])[: symbols + 2]
        # rank() also holds the start of the symbol's block at the last level; this takes it off.
        every = np.arange(symbols + 2)
        self.base = self.tree.rank(every & ((1 << self.bits) - 1), np.zeros(symbols + 2, np.int64))
        starts = np.r_[True, ends[:-1]]
        sampled = starts[order] | (order % SAMPLE == 0)
        self.sampled, self.place = sampled, np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffix array that start with each row of ``phrases``."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            shift = self.first[c] - self.base[c]
            low[live] = self.tree.rank(c, low[live]) + shift
            high[live] = self.tree.rank(c, high[live]) + shift
            live = live[low[live] < high[live]]
            if not len(live):
                break
        dead = np.ones(len(phrases), bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking backwards to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[at])
        while len(walking):
            symbol, place = self.tree.step(at[walking])
            at[walking] = place + self.first[symbol] - self.base[symbol]
            steps[walking] += 1
            walking = walking[~self.sampled[at[walking]]]
        return self.samples[self.place[at]] + steps


@dataclass
class Block:
    """Windows by length, as numbers of words (from 1), with their items."""

    windows: list[np.ndarray]
    owners: list[tuple[np.ndarray, np.ndarray]]
    items: list[str]

    def parts(self, most: int) -> Iterator[Block]:
        """The block in blocks of at most ``most`` windows, of one length each where it is cut."""
        if sum(map(len, self.windows)) <= most:
            yield self
            return
        for windows, (heads, owner) in zip(self.windows, self.owners, strict=True):
            for a in range(0, len(windows), most):
                own = heads[a : a + most + 1]
                yield Block([windows[a : a + most]], [(own - own[0], owner[own[0] : own[-1]])], self.items)


def numbers(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of each word in a sorted vocabulary, from 1; 0 for a word that isn't in it."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 1, 0)


def phrases(rows: list[tuple[str, str]], known: np.ndarray) -> Block:
    """Windows of (item_id, text) rows; equal windows are one, with all their items."""
    rows = sorted(set(rows))
    items = sorted({r[0] for r in rows})
    number = {x: k for k, x in enumerate(items)}
    data, offsets = _text.column(pa.array([r[1] for r in rows], pa.large_string()))
    found = _text.words(data, offsets, _text.ALNUM)
    of = numbers(known, found.hashes()).astype(np.int32) if len(found) else np.zeros(0, np.int32)
    by_length: dict[int, dict[bytes, set[int]]] = {}
    for k, (a, b) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)):
        own, item = of[a:b], number[rows[k][0]]
        size = min(WINDOW, b - a)
        for x in range(b - a - size + 1) if size else []:
            by_length.setdefault(int(size), {}).setdefault(own[x : x + size].tobytes(), set()).add(item)
    windows, owners = [], []
    for size, held in sorted(by_length.items()):
        windows.append(np.frombuffer(b"".join(held), np.int32).reshape(-1, size))
        many = [len(x) for x in held.values()]
        owners.append((np.concatenate([[0], np.cumsum(many)]), np.array([i for x in held.values() for i in sorted(x)], np.int64)))
    return Block(windows, owners, items)


def hits(array: pa.Array, known: np.ndarray, shortest: int, blocks: Iterable[Block]) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """For each text: its number of words, merged word spans (start, end) that windows cover, and the items found, sorted."""
    data, offsets = _text.column(array)
    n = len(offsets) - 1
    count = np.zeros(n, np.int64)
    spans, items = [np.zeros((0, 2), np.int64) for _ in range(n)], [[] for _ in range(n)]
    symbols, docs, places = [], [], []
    for a, b in _text.slices(offsets):
        found = _text.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _text.ALNUM)
        count[a:b] = np.diff(found.first)
        if not len(known) or not len(found):
            continue
        number = numbers(known, found.hashes())
        inside = number > 0
        # a run ends where a word is unknown or a text ends
        last = np.zeros(len(number), bool)
        last[found.first[1:][np.diff(found.first) > 0] - 1] = True
        heads = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | last[:-1]])
        tails = np.flatnonzero(inside & (last | np.r_[~inside[1:], True])) + 1
        long = tails - heads >= shortest
        heads, tails = heads[long], tails[long]
        if not len(heads):
            continue
        width = tails - heads + 1
        index = _text.spread(heads, width)
        end = np.cumsum(width) - 1
        own = number[np.minimum(index, len(number) - 1)]
        own[end] = 0
        doc = np.searchsorted(found.first, heads, "right") - 1
        symbols.append(own)
        docs.append(np.repeat(doc + a, width))
        places.append(index - np.repeat(found.first[doc], width))
    if not symbols:
        return count, spans, items
    symbols, docs, places = (np.concatenate(x) for x in (symbols, docs, places))
    index = FMIndex(symbols, len(known))
    cover = np.zeros(len(symbols) + 1, np.int64)
    for block in blocks:
        for windows, (heads, owner) in zip(block.windows, block.owners, strict=True):
            low, high = index.search(windows)
            many = high - low
            which = np.repeat(np.arange(len(windows)), many)
            at = index.locate(_text.spread(low, many))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + windows.shape[1], -1)
            hit = np.unique(docs[at] * len(windows) + which) if len(at) else np.zeros(0, np.int64)
            doc, which = hit // len(windows), hit % len(windows)
            many = heads[which + 1] - heads[which]
            for p in np.unique(np.repeat(doc, many) * len(block.items) + owner[_text.spread(heads[which], many)]):
                items[p // len(block.items)].append(block.items[p % len(block.items)])
    items = [sorted(set(x)) if x else x for x in items]
    covered = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
    if len(covered):
        doc, place = docs[covered], places[covered]
        cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)])
        stop = np.r_[cut[1:], len(covered)] - 1
        merged = np.stack([place[cut], place[stop] + 1], 1)
        bounds = np.flatnonzero(np.r_[True, np.diff(doc[cut]) != 0])
        for a, b in zip(bounds, np.r_[bounds[1:], len(cut)], strict=True):
            spans[doc[cut[a]]] = merged[a:b]
    return count, spans, items


def _known(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")


def vocabulary(texts: list[str]) -> np.ndarray:
    """Sorted hashes of the words."""
    return np.unique(_text.words(*_text.column(pa.array(texts, pa.large_string())), _text.ALNUM).hashes())


def blocks(benchmark: DataFrame) -> Iterator[tuple[np.ndarray, Block]]:
    """The windows in blocks, each with the words of its items. The items reach the driver a partition at a time, and it holds one block."""
    rows, size = [], 0

    def packed():
        known = vocabulary([r[1] for r in rows])
        return ((known, x) for x in phrases(rows, known).parts(BLOCK_WORDS))

    for r in _known(benchmark).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1])
        if size >= 2 * BLOCK_WORDS:  # a word and its gap take two characters at least
            yield from packed()
            rows, size = [], 0
    if rows:
        yield from packed()


_NOTHING = (np.zeros(0, np.uint64), None)
_SPAN = "array<struct<start:bigint,end:bigint>>"


def _searched(docs: DataFrame, known: np.ndarray, block: Block | None, finish, schema) -> tuple[DataFrame, Broadcast]:
    """``finish`` of every batch with its words, spans and items; and what was broadcast for it."""
    sent = docs.sparkSession.sparkContext.broadcast((known, block))

    def run(batches):
        known, block = sent.value
        shortest = min((w.shape[1] for w in block.windows), default=WINDOW) if block else WINDOW
        for batch in batches:
            count, spans, items = hits(batch.column(batch.schema.names.index("text")), known, shortest, [block] if block else [])
            yield finish(batch, count, spans, items)

    return docs.mapInArrow(run, schema), sent


def verdict(count: np.ndarray, spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hit words, and whether they are a twentieth of all or more."""
    hit = np.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], np.int64)
    return hit, (hit > 0) & (20 * hit >= count)


def _listed(spans: list[np.ndarray]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"start": int(a), "end": int(b)} for a, b in s] for s in spans], kind)


def merged(spans: list[dict]) -> np.ndarray:
    """Spans of several searches as disjoint ones in order."""
    out: list[list[int]] = []
    for x in sorted((r["start"], r["end"]) for r in spans or ()):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return np.array(out, np.int64).reshape(-1, 2)


def _by_blocks(docs: DataFrame, found: Iterator[tuple[np.ndarray, Block]], columns: list[str]) -> DataFrame:
    """row (the struct of ``columns``), n_words, n_hit, items, spans and contaminated of every row, a step for each block."""
    tables = Tables(docs.sparkSession, "decontaminate")
    rows = tables.write(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text", F.monotonically_increasing_id().alias("id")), "rows")

    def some(batch, count, spans, items):
        """Rows with a hit, but of the first block all rows, for their words."""
        out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count), pa.array(items, pa.list_(pa.string())), _listed(spans)], names=["id", "n_words", "items", "spans"])
        return out if first else out.filter(pa.array([len(x) > 0 for x in spans]))

    parts = []
    for k, (known, block) in enumerate(found):
        first = not k
        step, sent = _searched(rows.select("id", "text"), known, block, some, f"id bigint, n_words bigint, items array<string>, spans {_SPAN}")
        parts.append(tables.write(step, f"found{k}"))
        sent.destroy()
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    every = every.groupBy("id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def finish(batches):
        for batch in batches:
            spans = [merged(x) for x in batch.column("spans").to_pylist()]
            hit, bad = verdict(np.asarray(batch.column("n_words"), np.int64), spans)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(hit), batch.column("items"), _listed(spans), pa.array(bad)], names=["id", "n_words", "n_hit", "items", "spans", "contaminated"])

    done = every.mapInArrow(finish, f"id bigint, n_words bigint, n_hit bigint, items array<string>, spans {_SPAN}, contaminated boolean")
    return rows.select("id", "row").join(done, "id").drop("id")


def _first_two(benchmark: DataFrame) -> tuple[list, Iterator]:
    found = blocks(benchmark)
    head = list(islice(found, 2))
    return head, chain(head, found)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), spans (merged word spans) and contaminated of every row."""
    head, every = _first_two(benchmark)
    if len(head) > 1:
        return _by_blocks(docs, every, ["doc_id"]).select("row.doc_id", "n_words", "n_hit", "items", "spans", "contaminated")

    def finish(batch, count, spans, items):
        hit, bad = verdict(count, spans)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), pa.array(hit), pa.array(items, pa.list_(pa.string())), _listed(spans), pa.array(bad)], names=["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _searched(docs.select("doc_id", "text"), *(head or [_NOTHING])[0], finish, f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>, spans {_SPAN}, contaminated boolean")[0]


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns and whole texts."""
    head, every = _first_two(benchmark)
    if len(head) > 1:
        found = _by_blocks(docs, every, docs.columns).where("NOT contaminated")
        return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return _searched(docs, *(head or [_NOTHING])[0], lambda batch, count, spans, items: batch.filter(pa.array(~verdict(count, spans)[1])), docs.schema)[0]
