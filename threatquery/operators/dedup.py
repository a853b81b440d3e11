"""Exact and near duplicates, and set checks between tables."""

from __future__ import annotations

from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatquery.sources.sinks import Scratch, materialise

#: A text is a near copy of an earlier kept one at this similarity, among so many last kept ones.
RATIO, WINDOW = 92, 200
#: Rows that are decided together, and rows before them that are decided only to begin with, in windows.
PIECE, BEFORE = 32, 3
#: Bytes of pieces and of ranks in windows, as counted, that go to every task.
BROADCAST = 16 << 20
#: Buckets of code points; code points of a gram, and bits of its hash.
LETTERS, GRAM, GRAM_BITS = 64, 5, 18


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by a distinct ``order``.

    The least order of a key is summed up before the shuffle, and rows meet it
    by their own order, so a key with very many rows is never in one task.
    """
    least = rows.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return rows.join(least, order, "left_semi")


def duplicate_counts(rows: DataFrame, /, **keys: list[str]) -> DataFrame:
    """name -> rows beyond the first of each key."""
    out = None
    for name, columns in keys.items():
        one = rows.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.lit(name).alias("what"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
        out = one if out is None else out.unionByName(one)
    return out


def _places(points: np.ndarray) -> dict[int, int]:
    """The places of each code point of a text, as bits."""
    return {c: int.from_bytes(np.packbits(points == c, bitorder="little").tobytes(), "little") for c in np.unique(points).tolist()}


def _common(places: dict[int, int], width: int, points: np.ndarray) -> int:
    """Bits, of which the first j that are 0 count the longest common subsequence of the first j code points (j up to ``width``) and ``points``."""
    row = full = (1 << width) - 1
    places = {c: places.get(c, 0) & full for c in np.unique(points).tolist()}
    for k in range(0, len(points), 64):
        for hit in map(places.__getitem__, points[k : k + 64].tolist()):
            hit &= row
            row = row + hit | row - hit
        row &= full  # carries beyond the width, which touch nothing below it
    return row


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / total length, by bit-parallel rows."""
    if a == b:
        return 100.0
    x, y = _points(a), _points(b)
    return 200.0 * (len(x) - _common(_places(x), len(x), y).bit_count()) / (len(x) + len(y))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Profile:
    """A text with its code points and its grams counted, both by hash."""

    def __init__(self, text: str):
        points = _points(text)
        self.text, self.size, self.bits = text, len(points), None
        self.letters = np.bincount(points % LETTERS, minlength=LETTERS)
        h = np.zeros(max(self.size - GRAM + 1, 0), np.uint32)
        for k in range(GRAM):
            h = (h ^ points[k : k + len(h)]) * np.uint32(0x9E3779B1)
        self.grams, self.times = np.unique(h >> np.uint32(32 - GRAM_BITS), return_counts=True)
        self.times = self.times.astype(np.int32)

    def places(self) -> dict[int, int]:
        if self.bits is None:
            self.bits = _places(_points(self.text))
        return self.bits

    def near(self, other: Profile, least: float) -> bool:
        """Whether ``indel_ratio`` is ``least`` or more.

        Before all of ``other`` is read, the most that its first fifth and
        third can have in common with each beginning of this text, and all of
        the rests, decides most cases.
        """
        if self.text == other.text:
            return True
        n, m, y = self.size, other.size, _points(other.text)
        for i in (m // 5, m // 3):
            width = min(n, i + int((100 - least) / 100 * (n + m)) + 1)  # beyond it there are too many edits
            row = np.frombuffer(_common(self.places(), width, y[:i]).to_bytes(width // 8 + 1, "little"), np.uint8)
            both = np.cumsum(1 - np.unpackbits(row, count=width, bitorder="little").astype(np.int64))
            rest = np.minimum(n - 1 - np.arange(width), m - i)
            if 200.0 * max((both + rest).max(initial=0), min(n, m - i)) < least * (n + m) - 1e-6:
                return False
        return 200.0 * (n - _common(self.places(), n, y).bit_count()) / (n + m) >= least


class Near:
    """Texts of the last ``reach`` ranks; finds those near the next one.

    An edit changes one code point and at most 2 * GRAM - 1 grams, so texts
    whose counts differ by more than the edits that a ratio allows are not near.
    Hashes that meet only bring counts closer. What is left is compared whole.
    """

    def __init__(self, reach: int, least: float):
        self.reach, self.least = reach, least
        self.ranks, self.sizes = np.full(reach, np.iinfo(np.int64).min), np.zeros(reach, np.int64)
        self.letters = np.zeros((reach, LETTERS), np.int64)
        self.table = np.zeros(1 << GRAM_BITS, np.int32)
        self.known: dict[int, Profile] = {}

    def add(self, rank: int, own: Profile) -> None:
        at = rank % self.reach
        self.known.pop(int(self.ranks[at]), None)
        self.known[rank] = own
        self.ranks[at], self.sizes[at], self.letters[at] = rank, own.size, own.letters

    def find(self, rank: int, own: Profile, first: bool = False) -> list[int]:
        """Ranks of the held texts that are near, of those at most ``reach`` before; with ``first`` one of them, the likeliest tried first."""
        most = (100 - self.least) / 100 * (self.sizes + own.size) + 1e-6
        at = np.flatnonzero((self.ranks >= rank - self.reach) & (abs(self.sizes - own.size) <= most))
        at = at[abs(self.letters[at] - own.letters).sum(1) <= most[at]]
        if not len(at):
            return []
        tried = []
        self.table[own.grams] = own.times
        for k in at.tolist():
            other = self.known[int(self.ranks[k])]
            shared = np.minimum(self.table[other.grams], other.times).sum()
            apart = max(own.size - GRAM + 1, 0) + max(other.size - GRAM + 1, 0) - 2 * shared
            if apart <= (2 * GRAM - 1) * most[k]:
                tried.append((apart / most[k], k, other))
        self.table[own.grams] = 0
        out = []
        for _, k, other in sorted(tried, key=lambda x: x[:2]) if first else tried:
            if other.near(own, self.least):
                out.append(int(self.ranks[k]))
                if first:
                    break
        return out


class Window:
    """The last ``size`` kept rows: their ranks, and their texts for comparison."""

    def __init__(self, size: int, least: float):
        self.near, self.ranks, self.texts, self.held, self.n = Near(size, least), deque(maxlen=size), deque(maxlen=size), Counter(), 0

    def add(self, rank: int, text: str, profile: Profile | None = None) -> None:
        if len(self.texts) == self.texts.maxlen:
            self.held[self.texts[0]] -= 1
            self.held += Counter()
        self.ranks.append(rank)
        self.texts.append(text)
        self.held[text] += 1
        self.near.add(self.n, profile or Profile(text))
        self.n += 1

    def decide(self, rank: int, text: str) -> bool:
        """Whether the row is kept, which makes it one of the window."""
        if text in self.held:
            return False
        profile = Profile(text)
        if self.near.find(self.n, profile, first=True):
            return False
        self.add(rank, text, profile)
        return True


#: What a row of a piece is for: a rank of the window that the piece began with before, a kept row that it begins with now, a row to decide.
OLD, GIVEN, OWN = 0, 1, 2
_DECIDED = "piece bigint, rank bigint, kept boolean, began array<bigint>, ended array<bigint>"


def decided(sent: DataFrame, size: int, window: int, least: float) -> DataFrame:
    """The decisions of pieces of ``size`` ranks, and of each piece the windows that it began and ended with, in a row without a rank.

    ``sent``: piece, role, rank, t, old, sorted so within each piece. Where the
    window comes to be what it was in an earlier run, the rest of the piece is
    as it was then (``old``).
    """

    def run(batches):
        piece, live, was, began, same = None, None, None, None, False
        out: list[tuple] = []

        def end():
            if began is not None:  # beyond the last rank there is nothing to decide
                out.append((piece, None, None, began, list(live.ranks)))

        for batch in batches:
            for p, role, rank, text, old in zip(*(batch.column(c).to_pylist() for c in ("piece", "role", "rank", "t", "old")), strict=True):
                if p != piece:
                    if piece is not None:
                        end()
                    piece, live, was, began, same = p, Window(window, least), None, None, False
                if role == OLD:
                    was = deque(maxlen=window) if was is None else was
                    if rank is not None:
                        was.append(rank)
                    continue
                if role == GIVEN:
                    live.add(rank, text)
                    continue
                own = (rank - 1) // size == p
                if own and began is None:
                    began = list(live.ranks)
                same = same or (own and was is not None and was == live.ranks)
                if same:
                    kept = old
                    if kept:
                        live.ranks.append(rank)
                else:
                    kept = live.decide(rank, text)
                if was is not None and old and not same:
                    was.append(rank)
                if own:
                    out.append((p, rank, kept, None, None))
            yield _batch(out)
            out = []
        if piece is not None:
            end()
            yield _batch(out)

    return sent.mapInArrow(run, _DECIDED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["piece", "rank", "kept", "began", "ended"])


def _dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.select("piece", "role", "rank", "t", "old").repartitionById(parts, F.pmod("piece", F.lit(parts)).cast("int"))
    return out.sortWithinPartitions("piece", "role", "rank")


def placed(rows: DataFrame, order: str, text: str) -> DataFrame:
    """id, t and rank from 1, by a distinct ``order``, of the rows with a text that isn't that of the row before; the others have no rank.

    A row with the text of the one before it is always dropped, as the window is
    the same, so runs of copies take no ranks. Ranks are running counts of sorted
    ranges, shifted by the counts of the ranges before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.select(F.col(order).alias("id"), F.col(text).alias("t")).repartitionByRange(parts, "id").sortWithinPartitions("id")

    def count(batches):
        part, before, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            own = []
            for x in batch.column("t").to_pylist():
                ranked = x is not None and x != before
                n, before = n + ranked, x
                own.append(n if ranked else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(own, pa.int64()), pa.array([part] * len(own), pa.int64())], names=["id", "t", "own", "part"])

    kind = ranges.schema["id"].dataType.simpleString()
    held = materialise(ranges.mapInArrow(count, f"id {kind}, t string, own bigint, part bigint"), "placed")
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    shift = held.groupBy("part").agg(F.max("own").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each partition
    return held.join(F.broadcast(shift), "part").select("id", "t", (F.col("before") + F.col("own")).alias("rank"))


def near_mask(rows: DataFrame, order: str, text: str, least: float = RATIO, window: int = WINDOW) -> DataFrame:
    """``order`` and kept: whether no kept text among the last ``window`` kept ones before it is near.

    A null text is near nothing and takes no place in the window. The decision
    is sequential, but all that a row needs of those before it is the window.
    Rows are cut into pieces by rank, which are decided at once, each from some
    rows before it; where the window that a piece so began with isn't the one
    that the piece before it ended with, it is decided again from that one, as
    far as the difference reaches, until all agree: mostly after one more turn,
    and after one for each piece of a stretch that keeps less than a window.
    """
    whole = placed(rows, order, text)
    ranked = whole.where("rank is not null").select("rank", "t")
    size = PIECE * window
    own = F.floor((F.col("rank") - 1) / size)
    late = F.col("rank") > (own + 1) * size - BEFORE * window
    to = F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("piece")
    none = F.lit(None).cast("boolean").alias("old")
    with Scratch(rows.sparkSession, "near") as scratch:
        found = scratch.write(decided(_dealt(ranked.select(to, F.lit(OWN).alias("role"), "rank", "t", none)), size, window, least), "decided0")
        for turn in range(1, 1 << 30):
            ends = found.where("rank is null")
            before = ends.select((F.col("piece") + 1).alias("piece"), F.col("ended").alias("given"))
            wrong = scratch.write(ends.join(before, "piece").where("began <> given").select("piece", "given", "began"), f"wrong{turn}")
            if not (n := wrong.count()):
                break
            small = lambda df, each: F.broadcast(df) if n * each <= BROADCAST else df  # noqa: B023, E731
            pieces = small(wrong.select("piece"), 8)
            flags = found.where("rank is not null").join(pieces, "piece", "left_semi").select("rank", F.col("kept").alias("old"))
            again = ranked.withColumn("piece", own).join(pieces, "piece", "left_semi").join(flags, "rank").select("piece", F.lit(OWN).alias("role"), "rank", "t", "old")
            given = ranked.join(small(wrong.select("piece", F.explode("given").alias("rank")), 16 * window), "rank").select("piece", F.lit(GIVEN).alias("role"), "rank", "t", none)
            old = wrong.select("piece", F.lit(OLD).alias("role"), F.explode_outer("began").alias("rank"), F.lit(None).cast("string").alias("t"), none)
            anew = scratch.write(decided(_dealt(again.unionByName(given).unionByName(old)), size, window, least), f"anew{turn}")
            found = scratch.write(found.join(wrong.select("piece"), "piece", "left_anti").unionByName(anew), f"decided{turn}")
        kept = materialise(found.where("rank is not null").select("rank", "kept"), "near")
    out = whole.select("id", "rank", F.col("t").isNull().alias("blank")).join(kept, "rank", "left")  # without the texts
    return out.select(F.col("id").alias(order), F.coalesce("kept", "blank").alias("kept"))


def overlaps(rows: DataFrame, split: str, key: Column) -> DataFrame:
    """Keys that occur in more than one split, with how many."""
    return rows.groupBy(key.alias("key")).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def coverage(whole: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Row counts, keys missing from the parts or extra in them, and keys that the parts repeat."""
    a = whole.groupBy(key).agg(F.count("*").alias("a"))
    b = parts.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full").na.fill(0, ["a", "b"])
    return both.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_whole"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_parts"),
        F.count_if(F.col("b") == 0).alias("missing"),
        F.count_if(F.col("a") == 0).alias("extra"),
        F.count_if(F.col("b") > 1).alias("repeated"),
    )
