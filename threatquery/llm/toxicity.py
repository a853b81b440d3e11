"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is bounded by ``<`` and ``>`` and stands for its byte n-grams and for
itself; each of these has a hashed vector. A document is the average of the
vectors of the subwords of its distinct words (and of a few empty ones, so that
a short text doesn't swing), times the root of their number, so that a long text
doesn't thin out the few words that tell. A softmax over that gives the score.
Vectors and softmax are trained together in numpy, so that a misspelling that
was never seen still shares most of its n-grams with words that were.

Where the threshold stands and how steep the score is comes from the training
labels too: each half of the sample is scored by a model of the other one, and
the cut with the best F1 there among the precise ones, classes weighted as in
all labels, becomes the threshold.

Edge cases: a null or empty text has an empty bag, and its score is that of
the bias alone; repeated rows and ties get equal scores; with no labelled rows
of either class the score is the smoothed share of the class; an id that repeats
is fitted once; an empty table gives no rows; other columns, whatever their
names, pass through untouched.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threatquery.llm import _store, _text

#: Labelled rows of each class that are fitted at most.
PER_CLASS = 1500
BUCKETS = 1 << 16
DIM = 8
SIZES = (3, 4, 5, 6)
#: Passes over the sample, more where it is small.
EPOCHS = 8
LEAST_STEPS = 600
#: Sampled documents in which a bucket must occur; the others get no weight.
LEAST_DOCS = 6
BATCH = 50
SCALE = 30.0
RATE = 1.2
#: Pull of the vectors towards 0 in each step.
DECAY = 5e-3
THRESHOLD = 0.7
#: Empty subwords that every average holds; subwords of a text of which the average counts once.
EMPTY, TYPICAL = 600, 3000
#: Parts of the sample for the threshold, and rows of each class from which there is one.
PARTS, LEAST_ROWS = 2, 12
PRECISION = 0.9


def subwords(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of the bounded words and of the words themselves."""
    lengths = ends - starts
    heads = np.cumsum(lengths + 2) - (lengths + 2)
    text = np.full(int((lengths + 2).sum()), ord(">"), np.uint8)
    text[heads] = ord("<")
    text[_text.spread(heads + 1, lengths)] = low[_text.spread(starts, lengths)]
    at = _text.loads(text)
    buckets, owners = [_text.span_hashes(text, heads, heads + lengths + 2)], [np.arange(len(starts))]
    for n in SIZES:
        many = np.maximum(lengths + 3 - n, 0)
        buckets.append(_text.mix((at[_text.spread(heads, many)] & _text._MASK[n]) ^ _text.U64(n << 56)))
        owners.append(np.repeat(np.arange(len(starts)), many))
    return (np.concatenate(buckets) & _text.U64(BUCKETS - 1)).astype(np.int32), np.concatenate(owners)


def distinct_words(found: _text.Words) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct word, the distinct word of every word)."""
    _, one, of = np.unique(found.hashes(), return_index=True, return_inverse=True)
    return one, of


def bags(array: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text's distinct words, and how often each occurs."""
    data, offsets = _text.column(array)
    out = []
    for a, b in _text.slices(offsets):
        part = offsets[a : b + 1] - offsets[a]
        found = _text.words(data[offsets[a] : offsets[b]], part, _text.ALNUM)
        hashes = found.hashes()
        for k in range(b - a):
            own = found.first[k] + np.unique(hashes[found.first[k] : found.first[k + 1]], return_index=True)[1]
            bucket, _ = subwords(found.low, found.starts[own], found.ends[own])
            ids, times = np.unique(bucket, return_counts=True)
            out.append((ids.astype(np.uint16), np.minimum(times, 65535).astype(np.uint16)))
    return out


@dataclass
class Model:
    """``weight[g]`` is the difference of the two logits that the vector of bucket g adds."""

    weight: np.ndarray
    bias: float


def whole(n):
    """What a sum over ``n`` subwords is divided by."""
    return np.sqrt(float(TYPICAL) * (n + EMPTY))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7, least_steps: int = LEAST_STEPS) -> Model:
    """Joint training of the vectors and the softmax by Adagrad. rows: label, buckets, how often each occurs; they are used up."""
    labels = np.array([r[0] for r in rows], int)
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((ones + 1) / (len(labels) - ones + 1))))
    docs_of = np.zeros(BUCKETS, np.int32)
    for _, ids, _ in rows:
        docs_of[ids] += 1
    seen = docs_of >= LEAST_DOCS
    rng = np.random.default_rng(seed)
    table = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    head = (rng.standard_normal((DIM, 2)) * 0.3).astype(np.float32)
    bias = np.zeros(2, np.float32)
    square = [np.full(x.shape, 1e-6, np.float32) for x in (table, head, bias)]
    order = rng.permutation(len(rows))
    # Four bytes an entry, and each row goes as its batch is made; what a step needs besides is made when it is taken.
    batches = []
    for a in range(0, len(rows), BATCH):
        own = [(y, ids[seen[ids]], times[seen[ids]], whole(times.sum(dtype=np.int64))) for y, ids, times in (rows[k] for k in order[a : a + BATCH])]
        for k in order[a : a + BATCH]:
            rows[k] = None
        if sum(len(r[1]) for r in own):
            ids, times = (np.concatenate([r[k] for r in own]) for k in (1, 2))
            by = np.argsort(ids, kind="stable")  # once, not in each pass
            doc = np.repeat(np.arange(len(own), dtype=np.uint8), [len(r[1]) for r in own])[by]
            batches.append((ids[by], times[by], doc, np.array([r[3] for r in own]), np.array([r[0] for r in own])))

    def step(x, g, s, rate):
        s += g * g
        x -= rate * g / np.sqrt(s)

    epochs = max(EPOCHS, least_steps // max(len(batches), 1))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 0.01
        for k in rng.permutation(len(batches)):
            ids, times, doc, size, y = batches[k]
            n = len(y)
            w = (SCALE * times / size[doc]).astype(np.float32)
            cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            touched = ids[cuts]
            vectors = table[ids] * w[:, None]
            mean = np.stack([np.bincount(doc, vectors[:, d], n) for d in range(DIM)], 1).astype(np.float32)
            logit = mean @ head + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y] -= 1
            p /= n
            back = (p @ head.T).astype(np.float32)
            grad = np.add.reduceat(back[doc] * w[:, None], cuts, axis=0)
            sq = square[0][touched] + grad * grad
            square[0][touched] = sq
            table[touched] -= rate * (grad / np.sqrt(sq) + DECAY * table[touched])
            step(head, mean.T @ p, square[1], rate * 0.3)
            step(bias, p.sum(0), square[2], rate * 0.3)
    table[~seen] = 0
    return Model((SCALE * (table @ (head[:, 1] - head[:, 0]))).astype(np.float32), float(bias[1] - bias[0]))


def logits(rows: list[tuple[int, np.ndarray, np.ndarray]], model: Model) -> np.ndarray:
    return np.array([model.bias + (model.weight[ids] * times).sum() / whole(times.sum(dtype=np.int64)) for _, ids, times in rows])


def calibration(labels: np.ndarray, logit: np.ndarray, counts: dict[int, int]) -> tuple[float, float]:
    """(cut, slope): a logit, halfway to the next, and the steepness of a logistic curve; classes weigh as in ``counts``.

    The cut has the best F1 of those with a precision of PRECISION at least, or
    where there is none the best precision.
    """
    ones = labels == 1
    weight = np.where(ones, counts[1] / ones.sum(), counts[0] / (~ones).sum())
    by = np.argsort(-logit, kind="stable")
    hit, taken = np.cumsum((weight * ones)[by]), np.cumsum(weight[by])
    edge = np.r_[logit[by][1:] < logit[by][:-1], True]
    precise = hit / taken
    goal = np.where(precise >= PRECISION, 1 + 2 * hit / (taken + (weight * ones).sum()), precise)
    best = int(np.argmax(np.where(edge, goal, -1)))
    cut = float(logit[by][best : best + 2].mean())
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a mild prior at slope 1
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -50, 50)))
        g = np.array([(weight * (p - ones) * logit).sum() + (a - 1), (weight * (p - ones)).sum()])
        v = weight * p * (1 - p)
        h = np.array([[(v * logit**2).sum() + 1, (v * logit).sum()], [(v * logit).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return cut, float(np.clip(a, 0.2, 5))


def fit_calibrated(rows: list[tuple[int, np.ndarray, np.ndarray]], counts: dict[int, int]) -> Model:
    """A model whose score at the cut is THRESHOLD; with too few rows of a class the plain one. ``rows`` are used up."""
    labels = np.array([r[0] for r in rows], int)
    if len(rows) == 0 or min(labels.sum(), len(rows) - labels.sum()) < LEAST_ROWS:
        return fit(rows)
    part, logit = np.arange(len(rows)) % PARTS, np.zeros(len(rows))  # rows are sorted by label
    for k in range(PARTS):
        model = fit([rows[i] for i in np.flatnonzero(part != k)], least_steps=LEAST_STEPS // 2)
        logit[part == k] = logits([rows[i] for i in np.flatnonzero(part == k)], model)
    cut, slope = calibration(labels, logit, counts)
    model = fit(rows)
    return Model((slope * model.weight).astype(np.float32), slope * (model.bias - cut) + float(np.log(THRESHOLD / (1 - THRESHOLD))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` rows of each class, none of which is held out."""
    known, counts = _store.labelled(docs, labels, label, ["text"], modulus, held_out, per_class)

    def extract(batches):
        for batch in batches:
            found = bags(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([x[0].tobytes() for x in found], pa.binary()), pa.array([x[1].tobytes() for x in found], pa.binary())],
                names=["label", "ids", "times"],
            )

    # A partition at a time, so that the driver holds the entries once.
    found = known.select("label", "text").mapInArrow(lambda it: extract(it), "label int, ids binary, times binary").toLocalIterator(prefetchPartitions=True)
    rows = [(r[0], np.frombuffer(r[1], np.uint16), np.frombuffer(r[2], np.uint16)) for r in found]
    rows.sort(key=lambda r: (r[0], len(r[1]), zlib.crc32(r[1]), zlib.crc32(r[2])))
    return fit_calibrated(rows, counts)


def score_texts(array: pa.Array, model: Model) -> np.ndarray:
    """Probability of class 1 for each text."""
    data, offsets = _text.column(array)
    out = np.empty(len(offsets) - 1)
    for a, b in _text.slices(offsets):
        found = _text.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _text.ALNUM)
        one, of = distinct_words(found)
        bucket, owner = subwords(found.low, found.starts[one], found.ends[one])
        weight = np.bincount(owner, model.weight[bucket], len(one))
        many = np.bincount(owner, minlength=len(one))
        pair = np.unique(found.text_of() * max(len(one), 1) + of)
        text, word = pair // max(len(one), 1), pair % max(len(one), 1)
        total, n = np.bincount(text, weight[word], b - a), np.bincount(text, many[word], b - a)
        out[a:b] = 1 / (1 + np.exp(-np.clip(model.bias + total / whole(n), -50, 50)))
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = score_texts(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_texts(batch.column(batch.schema.get_field_index("text")), shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
