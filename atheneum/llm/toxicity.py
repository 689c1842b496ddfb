"""Toxic passages by maximum-scoring segments.

Words score the log-odds of their documents being toxic, smoothed by Dirichlet priors that chain from the base
rate over a word's beginnings (of LEVELS letters, of longer words only) to the word itself, less a drift, so that
ordinary text scores below zero. One linear scan over a text finds all its maximal segments (Ruzzo and Tompa 1999).
Their scores are made comparable by extreme-value statistics (Karlin and Altschul 1990, 1993): lambda solves
E[exp(lambda * score)] = 1 over clean words, K fits the Gumbel law of the best segments of clean texts, and a
document's evidence sums the normalised scores of all segments that exceed it. A logistic curve over the evidence's
logarithm, fitted to documents that did not count themselves, gives a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atheneum.llm.common import apart, raw, table, written

LEVELS = (3, 4, 5, 6, 7, 8)
#: Weight of a prior in documents, what each word costs, documents that a word or beginning needs to count.
PRIOR, DRIFT, LEAST_DOCS = 1.0, 2.0, 2
#: Labelled documents that are learnt from, at most so many of each label, picked by a hash of their id.
SAMPLE_DOCS = 8000
#: Passages are reported up to this expected number in a clean text of the same length.
E_VALUE = 0.01
LIMIT = 0.7
_BIN = 0.05
_WORD = regex.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[str]:
    return _WORD.findall((text or b"").decode("utf-8", "replace").lower())


def nodes(word: str) -> list[str]:
    """The beginnings of a word from short to long, then the word with an end mark."""
    return [word[:k] for k in LEVELS if k < len(word)] + [word + "|"]


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first, last), in linear time; only positive scores are visited."""
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[float, float, int, int]] = []
    for k in np.flatnonzero(scores > 0).tolist():
        left, right, first = float(upto[k]), float(upto[k + 1]), k
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= right:
                found.append((left, right, first, k))
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
    return [(r - a, x, y) for a, r, x, y in found]


@dataclass
class Lexicon:
    """How many toxic and other documents each node was seen in, out of `toxic` and `clean` documents."""

    seen: dict[str, tuple[int, int]]
    toxic: int
    clean: int

    def score(self, word: str, own: int | None = None) -> float:
        """The log-odds of a word less the drift; own is the label of a document that is not to count itself."""
        base = (self.toxic + 1) / (self.toxic + self.clean + 2)
        rate = base
        for node in nodes(word):
            a, b = self.seen.get(node, (0, 0))
            if own is not None:
                a, b = a - (own == 1), b - (own == 0)
            if a + b >= LEAST_DOCS:
                rate = (a + PRIOR * rate) / (a + b + PRIOR)
        rate = min(1 - 1e-6, max(1e-6, rate))
        return math.log(rate / (1 - rate)) - math.log(base / (1 - base)) - DRIFT


class Scorer:
    """Scores of whole texts; the words met are remembered, a million at a time."""

    def __init__(self, lexicon: Lexicon, own: int | None = None) -> None:
        self.lexicon, self.own, self.known = lexicon, own, {}

    def scores(self, words: list[str]) -> np.ndarray:
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.lexicon.score(w, self.own)
        out = np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))
        again = np.fromiter(map(eq, words, words[1:]), dtype=bool, count=max(0, len(words) - 1))
        out[1:][again & (out[1:] > 0)] = 0.0  # a word that is said again at once is no further evidence
        if len(known) > 1_000_000:
            known.clear()
        return out


@dataclass
class Model:
    lexicon: Lexicon
    scale: float  # lambda
    log_k: float
    slope: float
    offset: float

    def evidence(self, found: list[float], n_words: int) -> float:
        """The largest sum of the best segments' scores in nats, each less what the best one of a clean text of that
        length has: minus the logarithm of the product of their expected numbers. 0 where none stands out."""
        room, total = self.log_k + math.log(n_words + 1), 0.0
        for s in sorted(found, reverse=True):
            if self.scale * s <= room:
                break
            total += self.scale * s - room
        return total

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.offset + self.slope * math.log1p(evidence)))))


def _sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """(doc_id, text, toxic) of at most about 1.5 * sample_docs labelled documents of each label.

    A document with several labels is toxic if one says so; of several texts with one id the least is taken. Only
    picked ids meet the documents, by a broadcast of as many ids."""
    given = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    given = written(given, "labels")
    counts = {r.toxic: r["count"] for r in given.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 40)) / (1 << 40)
    part = F.when(F.col("toxic") == 1, min(1.0, sample_docs / max(1, counts.get(1, 0)))).otherwise(min(1.0, sample_docs / max(1, counts.get(0, 0))))
    picked = given.where(place < part)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def _lexicon(sample: DataFrame) -> Lexicon:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for y, c in enumerate(counts):
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([v * y for v in c.values()], pa.int64()), pa.array([v * (1 - y) for v in c.values()], pa.int64())], names=["node", "toxic", "clean"])
                c.clear()

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                counts[y].update({n for w in set(words_of(t)) for n in nodes(w)})
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield from out()
        yield from out()

    by = sample.select("toxic", "text").mapInArrow(run, "node string, toxic long, clean long").groupBy("node").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Bounded by the sample, not by the corpus.
    kept = by.where(F.col("toxic") + F.col("clean") >= LEAST_DOCS).toArrow()
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    seen = dict(zip(kept.column(0).to_pylist(), zip(kept.column(1).to_pylist(), kept.column(2).to_pylist(), strict=True), strict=True))
    return Lexicon(seen, n.get(1, 0), n.get(0, 0))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model of docs (doc_id, text) and labels (doc_id, toxic), or None without both labels.

    Documents of the sample are scored as if they had not been counted, so the calibration is not flattered."""
    sample = written(_sample(docs, labels, sample_docs), "sample")
    lexicon = _lexicon(sample)
    if not lexicon.toxic or not lexicon.clean:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    shape = "toxic int, n_words long, found array<double>, bins array<int>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(sent.value, y) for y in (0, 1)]
        for b in batches:
            rows = []
            for y, t in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                scores = scorers[y].scores(words_of(t))
                bins, counts = np.unique(np.round(scores / _BIN).astype(np.int32), return_counts=True)
                rows.append((y, len(scores), [s for s, _, _ in segments(scores)], bins.tolist() if not y else [], counts.tolist() if not y else []))
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["toxic", "n_words", "found", "bins", "counts"])

    scored = written(sample.select("toxic", "text").mapInArrow(run, shape), "scored")
    spread = scored.select(F.explode(F.arrays_zip("bins", "counts")).alias("x")).groupBy("x.bins").agg(F.sum("x.counts").alias("n")).collect()
    rows = scored.select("toxic", "n_words", "found").collect()  # a row for each document of the sample
    model = Model(lexicon, _scale(spread), 0.0, 1.0, 0.0)
    tops = [model.scale * max(r.found, default=0.0) - math.log(r.n_words + 1) for r in rows if not r.toxic]
    model.log_k = sum(tops) / len(tops) - 0.5772156649
    x = np.log1p([model.evidence(r.found, r.n_words) for r in rows])
    model.slope, model.offset = _logistic(x, np.array([r.toxic for r in rows], dtype=np.float64))
    return model


def _scale(spread: list) -> float:
    """The positive root of E[exp(lambda * score)] = 1, by halving; 1 where no score is positive."""
    at, n = np.array([r.bins * _BIN for r in spread]), np.array([r.n for r in spread], dtype=np.float64)
    if not len(at) or at.max() <= 0 or (at * n).sum() >= 0:
        return 1.0
    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (np.exp(mid * at) * n).sum() > n.sum() else (mid, high)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, held back a little by a penalty; the slope is never negative."""
    size = max(1.0, float(x.std()))
    a = np.stack([x / size, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    hold = np.diag([0.1, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + hold, a.T @ (y - p) - hold @ w)
        w += np.clip(step, -2, 2)
    return max(0.0, float(w[0] / size)), float(w[1])


PASSAGE = "start int, end int, words int, score double, e_value double"


def score_texts(docs: DataFrame, model: Model | None, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """docs with score (0 to 1), predicted (1 from limit up) and passages (start and end in characters, words, score, e_value).

    Null and empty texts have no passage and the score of no evidence; without a model all scores are 0. A column with
    an added one's name has `_in` behind it; rows that repeat are scored alike; an empty table gives no rows."""
    text = apart(docs, "score", "predicted", "passages").columns[docs.columns.index(text)]
    docs = apart(docs, "score", "predicted", "passages")
    shape = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.from_json(F.lit("[]"), f"array<struct<{PASSAGE.replace(' ', ':').replace(',:', ',')}>>").alias("passages")).schema
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "passages": F.array().cast(shape["passages"].dataType)})
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = Scorer(model.lexicon)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                got, shown = [], []
                for t in raw(part.column(names.index(text))):
                    words = words_of(t)
                    found = segments(scorer.scores(words))
                    got.append(model.probability(model.evidence([s for s, _, _ in found], len(words))))
                    room = math.log(len(words) + 1) + model.log_k
                    known = [(s, a, b, math.exp(room - model.scale * s)) for s, a, b in found if room - model.scale * s <= math.log(E_VALUE)]
                    spans = [m.span() for m in _WORD.finditer(t.decode("utf-8", "replace"))] if known else []
                    # Lower-casing can lengthen a word, but makes no word and ends none.
                    shown.append([{"start": spans[a][0], "end": spans[b][1], "words": b - a + 1, "score": s, "e_value": e} for s, a, b, e in known] if not spans or len(spans) == len(words) else [])
                more = [pa.array(got, pa.float64()), pa.array([int(g >= limit) for g in got], pa.int32()), pa.array(shown, passage)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*names, "score", "predicted", "passages"])

    return docs.mapInArrow(run, shape)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(3)) == 1


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    found = score_texts(docs, train(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "passages")
