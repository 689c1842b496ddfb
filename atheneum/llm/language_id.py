"""Language identification with a byte convolutional network in numpy.

Filters of several widths run over the bytes of fixed-length windows; each filter's maximum over a
window feeds a softmax. A filter's response is a sum of table entries, one for each byte it covers, so
scoring adds rows looked up by byte or by pair of bytes. A document's classes are the mean of its
windows' probabilities, weighted by their letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atheneum.llm.common import apart, raw, table

UND = "und"
LENGTH = 256
#: At most so many training documents of a language, picked by a hash of their id.
SAMPLE_DOCS = 600
WINDOWS_A_DOC = 3
_LETTER = regex.compile(r"\p{L}")
#: Bytes that letters are made of: ASCII letters and all bytes of other characters.
_LETTERS = np.array([c >= 0x80 or chr(c).isalpha() for c in range(256)])


@dataclass
class ByteCNN:
    langs: list[str]
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    tables: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteCNN:
        """Adam on the cross-entropy; rows of windows are bytes, labels are numbers into langs."""
        rng = np.random.default_rng(seed)
        n, f = len(self.langs), self.filters
        params = [rng.normal(0, 0.3, (w, 256, f)).astype(np.float32) for w in self.widths]
        params += [np.zeros((len(self.widths), f), np.float32), rng.normal(0, 0.1, (len(self.widths) * f, n)).astype(np.float32), np.zeros(n, np.float32)]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            turn = rng.permutation(len(windows))
            lr = rate * (1 - epoch / epochs) + 1e-4
            for k in range(0, len(turn), batch):
                x, y = windows[turn[k : k + batch]], labels[turn[k : k + batch]]
                rows, pooled, where = np.arange(len(x))[:, None], [], []
                for w, t, b in zip(self.widths, params, params[-3], strict=False):
                    span = x.shape[1] - w + 1
                    z = t[0][x[:, :span]]
                    for j in range(1, w):
                        z += t[j][x[:, j : j + span]]
                    at = z.argmax(axis=1)
                    where.append(at)
                    pooled.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + b)
                h = np.concatenate(pooled, axis=1)
                a = np.maximum(h, 0)
                p = _softmax(a @ params[-2] + params[-1])
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                grads = [np.zeros_like(q) for q in params]
                grads[-1], grads[-2] = p.sum(axis=0), a.T @ p
                back = (p @ params[-2].T) * (h > 0)
                for i, (w, at) in enumerate(zip(self.widths, where, strict=True)):
                    g = back[:, i * f : (i + 1) * f]
                    grads[-3][i] = g.sum(axis=0)
                    for j in range(w):
                        np.add.at(grads[i][j], (x[rows, at + j], np.arange(f)[None, :]), g)
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.tables, (self.bias, self.out, self.out_bias) = params[:-3], params[-3:]
        self.prepare()
        return self

    def prepare(self) -> None:
        """Joins the tables of neighbouring bytes into tables of byte pairs."""
        self.pairs = [[(j, (t[j][:, None] + t[j + 1][None, :]).reshape(65536, -1)) if j + 1 < len(t) else (j, t[j]) for j in range(0, len(t), 2)] for t in self.tables]

    def predict(self, windows: np.ndarray, block: int = 128) -> np.ndarray:
        """Probabilities, a row for each window."""
        out = np.zeros((len(windows), len(self.langs)), np.float32)
        for k in range(0, len(windows), block):
            x = windows[k : k + block]
            pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
            pooled = []
            for w, parts in zip(self.widths, self.pairs, strict=True):
                span = x.shape[1] - w + 1
                z = None
                for j, t in parts:
                    ids = pair[:, j : j + span] if len(t) > 256 else x[:, j : j + span]
                    got = t.take(ids, axis=0)
                    z = got if z is None else np.add(z, got, out=z)
                pooled.append(z.max(axis=1))
            h = np.maximum(np.concatenate(pooled, axis=1) + self.bias.reshape(-1), 0)
            out[k : k + block] = _softmax(h @ self.out + self.out_bias)
        return out

    def classify(self, texts: list[bytes | None], length: int = LENGTH) -> list[tuple[str, float]]:
        """Language and score of whole texts; und and 0 without a letter."""
        ready = [t is not None and _LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts]
        results: list[tuple[str, float]] = [(UND, 0.0)] * len(texts)
        todo = [k for k, r in enumerate(ready) if r]
        while todo:
            part, size = [], 0
            while todo and (not part or size + len(texts[todo[-1]]) <= 1 << 21):
                part.append(todo.pop())
                size += len(texts[part[-1]])
            for k, r in zip(part, self._classify([texts[k] for k in part], length), strict=True):
                results[k] = r
        return results

    def _classify(self, texts: list[bytes], length: int) -> list[tuple[str, float]]:
        counts = [-(-len(t) // length) for t in texts]
        data = b"".join(t.lower().ljust(c * length, b" ") for t, c in zip(texts, counts, strict=True))
        windows = np.frombuffer(data, dtype=np.uint8).reshape(-1, length)
        weight = _LETTERS[windows].sum(axis=1).astype(np.float64)
        probs = self.predict(windows) * weight[:, None]
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(probs, first, axis=0) / np.add.reduceat(weight, first)[:, None]
        best = mean.argmax(axis=1)
        return [(self.langs[b], min(1.0, float(m[b]))) for b, m in zip(best, mean, strict=True)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, windows_a_doc: int = WINDOWS_A_DOC, length: int = LENGTH) -> ByteCNN | None:
    """A network fitted to a bounded sample of labelled (doc_id, text, lang): sample_docs documents of each
    language, by a hash of doc_id, and windows_a_doc windows of each, at hashed places of its whole text.
    None if no row has both a text with a letter and a language."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1 << 40)) / (1 << 40)
    size = F.length("text")
    cut = [F.substring("text", (1 + F.pmod(F.xxhash64("doc_id", "text", F.lit(k + 2)), F.greatest(size - length, F.lit(1)))).cast("int"), F.lit(length)) for k in range(windows_a_doc)]
    firsts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.struct(place.alias("place"), F.array(*cut).alias("windows"))).alias("least")).collect()
    counts = {r.lang: r.n for r in firsts}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * sample_docs / n))))
    # Rows that repeat share a place; they are taken once.
    picked = rows.where(place < share[F.col("lang")]).select("lang", place.alias("place"), F.array(*cut).alias("windows")).dropDuplicates(["lang", "place"])
    texts: list[bytes] = []
    labels: list[int] = []
    langs = sorted(counts)
    for k, lang in enumerate(langs):
        for r in picked.where(F.col("lang") == lang).orderBy("place").limit(sample_docs).collect() if len(langs) > 64 else []:
            texts += [w.encode()[:length] for w in r.windows]
            labels += [k] * windows_a_doc
    if len(langs) <= 64:  # at most 1.5 * sample_docs rows a language in expectation
        seen = dict.fromkeys(langs, 0)
        for r in sorted(picked.collect(), key=lambda r: r.place):
            if seen[r.lang] < sample_docs:
                seen[r.lang] += 1
                texts += [w.encode()[:length] for w in r.windows]
                labels += [langs.index(r.lang)] * windows_a_doc
    for r in firsts:  # a language of which no row was picked has its first one
        if langs.index(r.lang) not in set(labels):
            texts += [w.encode()[:length] for w in r.least.windows]
            labels += [langs.index(r.lang)] * windows_a_doc
    windows = np.frombuffer(b"".join(t.lower().ljust(length, b" ") for t in texts), dtype=np.uint8).reshape(-1, length)
    return ByteCNN(langs).fit(windows, np.array(labels))


def identify(docs: DataFrame, model: ByteCNN | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score: `und` and 0 for null texts, texts without a letter, or no model.

    Every byte of a text is looked at. Further columns pass through, one with an added column's name
    with `_in` behind it; an empty table gives no rows.
    """
    text_col = apart(docs, "lang_pred", "score").columns[docs.columns.index(text_col)]
    docs = apart(docs, "lang_pred", "score")
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UND)).withColumn("score", F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.widths, model.tables, model.bias, model.out, model.out_bias))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, widths, tables, bias, out, out_bias = sent.value
        net = ByteCNN(langs, widths, tables=tables, bias=bias, out=out, out_bias=out_bias)
        net.prepare()
        for b in batches:
            got = net.classify(raw(b.column(names.index(text_col))))
            more = [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*names, "lang_pred", "score"])

    shape = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(run, shape)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = train(docs.where(~held_out))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
