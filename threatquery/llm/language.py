"""Language identification by hierarchical discrimination.

The features of a text are the shares of hashed byte n-grams of its bounded
words. Linear support vector machines first decide on the family (one against
the rest), then, among the languages of that family, one-versus-one machines
vote. All are linear in the shares, so a text is scored in one pass over its
words, and every distinct word of a slice is weighed once.

Edge cases: a text that is null or has no letter is ``und`` with score 0; with
no learned language every text is ``und``, with one that language; a lang is
told by its code of two or three letters, before any `-` or `_` and in either
case, and one that isn't listed is a family of its own; a family of one language
needs no second step; a model of more than MODEL_BYTES is refused, not cut; of languages with equal votes and belief the
first by name is taken; equal rows get equal results; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatquery.llm import _store, _text
from threatquery.llm.toxicity import distinct_words

#: Rows of each language that are fitted at most.
PER_LANGUAGE = 300
BUCKETS = 1 << 12
SIZES = (1, 2, 3)
ROUNDS = 100
UNKNOWN = "und"
# Families of ISO 639-1 codes; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa ur",
    "celtic": "br cy ga gd",
}


# ISO 639-2 codes of these languages, by their two letters.
THREE = (
    "af afr am amh ar ara az aze be bel bg bul bn ben br bre bs bos ca cat cs ces cs cze cy cym cy wel da dan de deu de ger en eng es spa et est fi fin fr fra fr fre fy fry ga gle gd gla gl glg gu guj he heb hi hin hr hrv hu hun "
    "is isl is ice it ita kk kaz ky kir la lat lb ltz mk mkd mk mac mr mar mt mlt nb nob ne nep nl nld nl dut nn nno no nor oc oci pa pan pl pol pt por ro ron ro rum ru rus sk slk sk slo sl slv sr srp sv swe tr tur uk ukr ur urd uz uzb yi yid"
)
_TWO = dict(zip(THREE.split()[1::2], THREE.split()[::2], strict=True))
#: Rows of a sample whose ids, of some 20 bytes, go to every task.
SAMPLED = 1 << 20
#: Bytes of the weights of all machines, at most.
MODEL_BYTES = 256 << 20


def family_of(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    code = _TWO.get(code, code)
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), f"own:{language}")


def machines(languages: list[str]) -> int:
    """One for each family, and one for each pair of languages in a family."""
    sizes = Counter(family_of(x) for x in languages)
    return len(sizes) + sum(n * (n - 1) // 2 for n in sizes.values())


def grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the n-grams of the words between spaces."""
    lengths = ends - starts
    heads = np.cumsum(lengths + 2) - (lengths + 2)
    text = np.full(int((lengths + 2).sum()), 32, np.uint8)
    text[_text.spread(heads + 1, lengths)] = low[_text.spread(starts, lengths)]
    at = _text.loads(text)
    buckets, owners = [], []
    for n in SIZES:
        many = np.maximum(lengths + 3 - n, 0) - (2 if n == 1 else 0)
        buckets.append(_text.mix((at[_text.spread(heads + (n == 1), many)] & _text._MASK[n]) ^ _text.U64(n << 56)))
        owners.append(np.repeat(np.arange(len(starts)), many))
    return (np.concatenate(buckets) & _text.U64(BUCKETS - 1)).astype(np.int32), np.concatenate(owners)


class Shares:
    """Rows of shares of which most are 0: the buckets and values of the others."""

    def __init__(self, ids: list[np.ndarray], values: list[np.ndarray]):
        self.sizes = np.array([len(i) for i in ids], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.ids = np.concatenate(ids).astype(np.int32)
        self.values = np.concatenate(values).astype(np.float32)
        self.owner = np.repeat(np.arange(len(ids), dtype=np.int32), self.sizes)

    def deviation(self) -> np.ndarray:
        """Of each bucket over all rows."""
        n, times = len(self.sizes), np.bincount(self.ids, minlength=BUCKETS)
        mean = np.bincount(self.ids, self.values, BUCKETS) / n
        return np.sqrt((np.bincount(self.ids, (self.values - mean[self.ids]) ** 2, BUCKETS) + (n - times) * mean**2) / n).astype(np.float32)

    def rows(self, some: np.ndarray) -> Shares:
        cuts = [slice(a, a + k) for a, k in zip(self.first[some], self.sizes[some], strict=True)]
        return Shares([self.ids[c] for c in cuts], [self.values[c] for c in cuts])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.values * w[self.ids], len(self.sizes)).astype(np.float32)

    def summed(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, self.values * g[self.owner], BUCKETS).astype(np.float32)


def svm(x: Shares, y: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine for y of -1 and 1: squared hinge, accelerated gradient; classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = 1 / (2 * float((weight * np.bincount(x.owner, x.values**2, len(y))).sum() + 1) + penalty)
    w, b, last_w, last_b = np.zeros(BUCKETS, np.float32), 0.0, np.zeros(BUCKETS, np.float32), 0.0
    for k in range(ROUNDS):
        pull = k / (k + 3)
        ahead_w, ahead_b = w + pull * (w - last_w), b + pull * (b - last_b)
        slack = np.maximum(0, 1 - y * (x.times(ahead_w) + ahead_b))
        g = (-2 * weight * y * slack).astype(np.float32)
        last_w, last_b = w, b
        w = ahead_w - step * (x.summed(g) + penalty * ahead_w)
        b = ahead_b - step * float(g.sum())
    return w, b


@dataclass
class Model:
    """Columns of ``weight`` are machines: one for each family, then the pairs within families."""

    languages: list[str]
    families: list[str]
    weight: np.ndarray
    bias: np.ndarray
    pairs: list[tuple[str, str]] = field(default_factory=list)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    if not rows:
        return Model([], [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    languages = sorted({r[0] for r in rows})
    families = sorted({family_of(x) for x in languages})
    x = Shares([r[1] for r in rows], [r[2] for r in rows])
    scale = (1 / (x.deviation() + 1e-4) / np.sqrt(BUCKETS)).astype(np.float32)
    x.values *= scale[x.ids]
    own = np.array([r[0] for r in rows])
    kin = np.array([family_of(r[0]) for r in rows])
    columns, bias, pairs = [], [], []
    for f in families if len(families) > 1 else []:
        w, b = svm(x, np.where(kin == f, 1, -1).astype(np.float32))
        columns.append(w * scale)
        bias.append(b)
    for f in families:
        kind = [s for s in languages if family_of(s) == f]
        for i, s in enumerate(kind):
            for t in kind[i + 1 :]:
                some = np.flatnonzero((own == s) | (own == t))
                w, b = svm(x.rows(some), np.where(own[some] == s, 1, -1).astype(np.float32))
                columns.append(w * scale)
                bias.append(b)
                pairs.append((s, t))
    weight = np.stack(columns, 1).astype(np.float32) if columns else np.zeros((BUCKETS, 0), np.float32)
    return Model(languages, families, weight, np.array(bias), pairs)


def sample(docs: DataFrame, modulus: int, held_out: int, most: int, languages: int) -> DataFrame:
    """lang and text of at most ``most`` rows of each language, by a hash that thins common ones before they are ranked.

    ``languages``: how many there are at most. While the sample has at most
    SAMPLED rows, its ids go to every task; beyond that they are joined.
    """
    sent = F.broadcast if languages * most <= SAMPLED else (lambda df: df)
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (_store.remainder("doc_id", modulus) != held_out))
    many = known.groupBy("lang").agg(F.count("*").alias("_n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    # Rows are thinned before they are ranked, so a common language isn't one task.
    some = known.select("doc_id", "lang", place.alias("_place")).join(sent(many), "lang").where(F.col("_place") < 2.0 * most / F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_place", "doc_id"))
    some = some.withColumn("_rank", rank).where(F.col("_rank") <= most).select("doc_id", "lang").distinct()
    # an id that repeats counts once for each of its languages, by the least text
    return known.select("doc_id", "lang", "text").join(sent(some), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def train(docs: DataFrame, modulus: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` rows of each language, none of which is held out."""

    def extract(batches):
        for batch in batches:
            data, offsets = _text.column(batch.column("text"))
            found = _text.words(data, offsets, _text.ALNUM)
            ids, shares = [], []
            for a, b in zip(found.first[:-1], found.first[1:], strict=True):
                bucket, _ = grams(found.low, found.starts[a:b], found.ends[a:b])
                one, times = np.unique(bucket, return_counts=True)
                ids.append(one.astype(np.uint16).tobytes())
                shares.append((times / max(len(bucket), 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], names=["lang", "ids", "shares"])

    languages = [r[0] for r in docs.where("lang is not null").select("lang").distinct().limit(MODEL_BYTES // (4 * BUCKETS) + 2).collect()]
    if 4 * BUCKETS * machines(languages) > MODEL_BYTES:
        raise ValueError(f"{len(languages)} values of lang need {machines(languages)} machines or more, of which {MODEL_BYTES // (4 * BUCKETS)} are allowed")
    known = sample(docs, modulus, held_out, per_language, len(languages)).select("lang", "text")
    rows = known.mapInArrow(lambda it: extract(_text.parts(it)), "lang string, ids binary, shares binary").collect()
    rows = [(r[0], np.frombuffer(r[1], np.uint16), np.frombuffer(r[2], np.float32)) for r in rows]
    return fit(sorted((r for r in rows if len(r[1])), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes())))


def _lettered(found: _text.Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    plain = (found.low >= 97) & (found.low <= 122)
    has = _text.sums(plain.astype(np.int8), offsets) > 0
    for k in np.flatnonzero(~has):
        has[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return has


def _decide(margin: np.ndarray, model: Model) -> tuple[list[str], np.ndarray]:
    """Languages and scores from the machines' margins of each text."""
    n, k = len(margin), len(model.families) if len(model.families) > 1 else 0
    sure = 1 / (1 + np.exp(-np.clip(3 * margin, -40, 40)))
    family = margin[:, :k].argmax(1) if k else np.zeros(n, int)
    first = sure[np.arange(n), family] if k else np.ones(n)
    out, score = np.full(n, UNKNOWN, object), np.zeros(n)
    for f, name in enumerate(model.families):
        rows = np.flatnonzero(family == f)
        kind = [x for x in model.languages if family_of(x) == name]
        votes, belief = np.zeros((len(rows), len(kind))), np.zeros((len(rows), len(kind)))
        for p, (s, t) in enumerate(model.pairs):
            if s in kind:
                for x, side in ((s, sure[rows, k + p]), (t, 1 - sure[rows, k + p])):
                    votes[:, kind.index(x)] += side > 0.5
                    belief[:, kind.index(x)] += side / max(len(kind) - 1, 1)
        best = (votes + 0.5 * belief).argmax(1)
        out[rows] = np.array(kind, object)[best]
        score[rows] = first[rows] * (belief[np.arange(len(rows)), best] if len(kind) > 1 else 1)
    return list(out), score


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in _text.parts(batches, most=2 * _text.SLICE):
            data, offsets = _text.column(batch.column("text"))
            found = _text.words(data, offsets, _text.ALNUM)
            one, of = distinct_words(found)
            bucket, owner = grams(found.low, found.starts[one], found.ends[one])
            total = _text.sums(np.bincount(owner, minlength=len(one))[of], found.first)
            margin = np.empty((batch.num_rows, own.weight.shape[1]))
            for k in range(own.weight.shape[1]):
                weight = np.bincount(owner, own.weight[bucket, k], len(one))
                margin[:, k] = _text.sums(weight[of], found.first) / np.maximum(total, 1) + own.bias[k]
            language, score = _decide(margin, own) if own.languages else ([UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows))
            known = _lettered(found, data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x if y else UNKNOWN for x, y in zip(language, known, strict=True)], pa.string()), pa.array(np.where(known, score, 0.0))],
                names=["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
