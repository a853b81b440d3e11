"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise
sum is taken in linear time as half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2,
summed over the factors. Words are hashed with their punctuation and scaled to
unit length within a document; the structure statistics and the metadata (the
row's n_chars, where the table has it) are standardised over the sample. The
machine is trained in numpy by Adagrad on a bounded sample.

Edge cases: a null or empty text has no words and the statistics of an empty
text, and gets a score like any other; a null n_chars, or a table without it,
counts as the length of the text; repeated rows and ties get equal scores; with
labels of one class only the score is the smoothed share of class 1; an id that
repeats is fitted once; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threatquery.llm import _store, _text

#: Labelled rows of each class that are fitted at most.
PER_CLASS = 2500
WORDS = 1 << 14
FACTORS = 8
EPOCHS = 8
LEAST_STEPS = 400
BATCH = 50
THRESHOLD = 0.7

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CLASSES = {"upper": _UPPER, "digit": _DIGIT}
for _name, _chars in {"mark": ".,;:!?'\"()-", "bang": "!", "bar": "|", "symbol": "#$%&*+/<=>@[\\]^_`{}~", "line": "\n", "space": " \t\r"}.items():
    _CLASSES[_name] = np.isin(np.arange(256), [ord(c) for c in _chars])
STATISTICS = [*_CLASSES, "log_bytes", "word_size", "distinct", "long_words", "tail_mark", "line_size", "n_chars"]


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed word, value) of all words, sorted by document, and the statistics of each document."""
    names = batch.schema.names
    data, offsets = _text.column(batch.column(names.index("text")))
    found = _text.words(data, offsets, _text.SPACED)
    n, size = batch.num_rows, np.diff(offsets)
    bucket = (found.hashes() & _text.U64(WORDS - 1)).astype(np.int64)
    doc = found.text_of()
    pair, times = np.unique(doc * WORDS + bucket, return_counts=True)
    doc_of, word = pair // WORDS, pair % WORDS
    norm = np.sqrt(np.bincount(doc_of, times.astype(float) ** 2, n))
    value = times / norm[doc_of]
    many = np.diff(found.first)
    stats = np.zeros((n, len(STATISTICS)))
    for k, table in enumerate(_CLASSES.values()):
        stats[:, k] = _text.sums(table[data].astype(np.int8), offsets) / np.maximum(size, 1)
    length = found.ends - found.starts
    k = len(_CLASSES)
    last = found.low[found.ends - 1] if len(found) else np.zeros(0, np.uint8)
    stats[:, k] = np.log1p(size)
    stats[:, k + 1] = _text.sums(length, found.first) / np.maximum(many, 1)
    stats[:, k + 2] = np.bincount(doc_of, minlength=n) / np.maximum(many, 1)
    stats[:, k + 3] = _text.sums((length > 12).astype(np.int8), found.first) / np.maximum(many, 1)
    stats[:, k + 4] = _text.sums((~_text.ALNUM[last]).astype(np.int8), found.first) / np.maximum(many, 1)
    stats[:, k + 5] = np.log1p(size / (1 + stats[:, list(_CLASSES).index("line")] * size))
    chars = _text.sums(((data & 0xC0) != 0x80).astype(np.int8), offsets)
    if "n_chars" in names:
        given = batch.column(names.index("n_chars"))
        chars = np.where(np.asarray(given.is_valid()), np.asarray(given.fill_null(0), dtype=np.float64), chars)
    stats[:, k + 6] = np.log1p(np.maximum(chars, 0))
    return doc_of, word, value, stats


@dataclass
class Model:
    """Weights and factors of the words, then of the statistics; ``middle`` and ``scale`` standardise these."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    middle: np.ndarray
    scale: np.ndarray


def standard(stats: np.ndarray, model: Model) -> np.ndarray:
    return np.clip((stats - model.middle) / model.scale, -4, 4) * 0.5


def logits(doc: np.ndarray, index: np.ndarray, value: np.ndarray, n: int, model: Model) -> np.ndarray:
    """Linear time: each feature is seen once for each factor."""
    out = model.bias + np.bincount(doc, model.weight[index] * value, n)
    for f in range(model.factor.shape[1]):
        term = model.factor[index, f] * value
        out += 0.5 * (np.bincount(doc, term, n) ** 2 - np.bincount(doc, term * term, n))
    return out


def joined(doc, word, value, stats, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and standardised statistics as one list of features."""
    n, d = stats.shape
    return np.concatenate([doc, np.repeat(np.arange(n), d)]), np.concatenate([word, np.tile(np.arange(WORDS, WORDS + d), n)]), np.concatenate([value, standard(stats, model).ravel()])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], prior: float, seed: int = 11) -> Model:
    """rows: label, words, values, statistics. ``prior``: log odds of class 1 among all labelled rows of training."""
    y = np.array([r[0] for r in rows], float)
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(WORDS + d), rng.standard_normal((WORDS + d, FACTORS)) * 0.02, np.zeros(d), np.ones(d))
    if not len(y) or not 0 < y.sum() < len(y):
        model.factor[:] = 0
        model.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return model
    stats = np.stack([r[3] for r in rows])
    model.middle, model.scale = stats.mean(0), stats.std(0) + 1e-6
    order = rng.permutation(len(rows))
    batches = []
    for a in range(0, len(rows), BATCH):
        own = [rows[k] for k in order[a : a + BATCH]]
        doc = np.repeat(np.arange(len(own)), [len(r[1]) for r in own])
        batches.append((*joined(doc, np.concatenate([r[1] for r in own]).astype(np.int64), np.concatenate([r[2] for r in own]).astype(float), np.stack([r[3] for r in own]), model), y[order[a : a + BATCH]]))
    sum_w, sum_v, sum_b = np.full(WORDS + d, 1e-6), np.full((WORDS + d, FACTORS), 1e-6), 1e-6
    epochs = max(EPOCHS, LEAST_STEPS // len(batches))
    for epoch in range(epochs):
        rate = 0.1 * (1 - epoch / epochs) + 0.005
        for k in rng.permutation(len(batches)):
            doc, index, value, target = batches[k]
            n = len(target)
            wrong = (1 / (1 + np.exp(-np.clip(logits(doc, index, value, n, model), -40, 40))) - target) / n
            touched, at = np.unique(index, return_inverse=True)
            g = np.bincount(at, wrong[doc] * value, len(touched)) + 1e-5 * model.weight[touched]
            sum_w[touched] += g * g
            step = rate * g / np.sqrt(sum_w[touched])
            for f in range(FACTORS):
                own = model.factor[index, f]
                total = np.bincount(doc, own * value, n)
                gv = np.bincount(at, wrong[doc] * value * (total[doc] - own * value), len(touched)) + 1e-5 * model.factor[touched, f]
                sum_v[touched, f] += gv * gv
                model.factor[touched, f] -= 0.3 * rate * gv / np.sqrt(sum_v[touched, f])
            model.weight[touched] -= step
            sum_b += float(wrong.sum()) ** 2
            model.bias -= rate * float(wrong.sum()) / np.sqrt(sum_b)
    # the sample holds as many of each class as it may; this gives back the odds of all labelled rows
    model.bias += prior - float(np.log(y.sum() / (len(y) - y.sum())))
    return model


def _inputs(docs: DataFrame) -> list[str]:
    return ["text", *(["n_chars"] if "n_chars" in docs.columns else [])]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` rows of each class, none of which is held out."""
    known, counts = _store.labelled(docs, labels, label, _inputs(docs), modulus, held_out, per_class)
    prior = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))

    def extract(batches):
        for batch in _text.parts(batches):
            doc, word, value, stats = features(batch)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            cols = [pa.array([word[a:b].astype(np.uint16).tobytes() for a, b in spans], pa.binary()), pa.array([value[a:b].astype(np.float32).tobytes() for a, b in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array([s.tobytes() for s in stats], pa.binary())], names=["label", "words", "shares", "stats"])

    rows = known.select("label", *_inputs(docs)).mapInArrow(extract, "label int, words binary, shares binary, stats binary").collect()
    rows.sort(key=lambda r: tuple(map(bytes, r[1:])))
    return fit([(r[0], np.frombuffer(r[1], np.uint16), np.frombuffer(r[2], np.float32), np.frombuffer(r[3])) for r in rows], prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in _text.parts(batches):
            doc, word, value, stats = features(batch)
            x = logits(*joined(doc, word, value, stats, shared.value), batch.num_rows, shared.value)
            p = 1 / (1 + np.exp(-np.clip(x, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *_inputs(docs)).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
