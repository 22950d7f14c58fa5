"""Quality classifier by attention over a document's passages.

A document is a bag of passages of ``passage_words`` words; only the document has a label.
Every passage is described by its hashed words and by measures of its own text, a learned
encoder layer maps them to a vector, gated attention weighs the passages (a tanh and a sigmoid branch, multiplied), and
the score is a logistic regression on the weighted mean of the vectors.  All weights are
learned together from document labels.  Training takes whole bags of a bounded sample of
labelled documents; scoring goes over all passages of all documents, in tasks.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import read, text_or_empty, written

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ENDS = tuple(".,;:!?")
BUCKETS = 12
WORDS = 128
MEASURES = 16 + BUCKETS + WORDS


def _delete(*ranges) -> bytes:
    return bytes(b for low, high in ranges for b in range(low, high + 1))


# classes of bytes whose share is measured: those left when the others are deleted
_ALL = bytes(range(256))
_CLASSES = [bytes(b for b in _ALL if b not in keep) for keep in (
    _delete((65, 90)), _delete((97, 122)), _delete((48, 57)), _delete((128, 255)), b".,;:!?'\"-()", b"#$%&*+/<=>@[\\]^_`{|}~", b"!",
    b"\t\n\v\f\r")]


def passages(text: str, passage_words: int) -> list[list[str]]:
    """Runs of words; an empty text is one passage without words."""
    words = _WORD.findall(text)
    return [words[i:i + passage_words] for i in range(0, len(words), passage_words)] or [[]]


def describe(words: list[str]) -> list[float]:
    """Measures of one passage: shares of character classes, repetition, word shapes,
    hashed word endings, and hashed words (square roots of their shares)."""
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (MEASURES - 1)
    joined = "".join(words).encode()
    size = len(joined)
    shares = [len(joined.translate(None, drop)) / size for drop in _CLASSES]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    longest = max(map(len, words))
    ends = [0.0] * BUCKETS
    for w in words:
        ends[zlib.crc32(w[-2:].encode()) % BUCKETS] += 1 / n
    hashed = [0] * WORDS
    for w in words:
        hashed[zlib.crc32(w.encode()) % WORDS] += 1
    return [0.0, *shares, distinct / n, pairs, min(size / n, 40) / 10, min(longest, 200) / 50, np.log1p(n) / 5,
            sum(w.endswith(_ENDS) for w in words) / n, sum(w[0].isalnum() for w in words) / n, *ends,
            *((k / n) ** 0.5 if k else 0.0 for k in hashed)]


class AttentionModel:
    """Encoder, gated attention and score; ``fit`` is full-batch Adam on the log loss."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.w = {"E": rng.normal(0, MEASURES ** -0.5, (MEASURES, hidden)), "e": np.zeros(hidden),
                  "V": rng.normal(0, hidden ** -0.5, (hidden, gate)), "U": rng.normal(0, hidden ** -0.5, (hidden, gate)),
                  "a": np.zeros(gate), "c": np.zeros(hidden), "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(MEASURES), np.ones(MEASURES)

    def _forward(self, x, starts):
        w = self.w
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = np.clip((t * g) @ w["a"], -30, 30)
        sizes = np.diff(np.append(starts, len(x)))
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        alpha = s / np.repeat(np.add.reduceat(s, starts), sizes)
        z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
        return h, t, g, alpha, z, p, sizes

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of label 1 for the documents whose passages begin at ``starts``."""
        return self._forward((x - self.mean) / self.scale, starts)[5]

    def fit(self, x, starts, y, steps: int = 400, rate: float = 0.03, decay: float = 1e-4):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        w, m1, m2 = self.w, {}, {}
        for step in range(1, steps + 1):
            h, t, g, alpha, z, p, sizes = self._forward(x, starts)
            d = (p - y) / len(y)
            grad = {"c": z.T @ d, "b": d.sum(keepdims=True)}
            dz = np.repeat(d[:, None] * w["c"], sizes, axis=0)
            dalpha = (dz * h).sum(1)
            inner = np.repeat(np.add.reduceat(alpha * dalpha, starts), sizes)
            ds = alpha * (dalpha - inner)
            grad["a"] = (t * g).T @ ds
            dtg = ds[:, None] * w["a"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            grad["V"], grad["U"] = h.T @ dt, h.T @ dg
            dh = (alpha[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
            grad["E"], grad["e"] = x.T @ dh, dh.sum(0)
            for k, v in grad.items():
                v = v + decay * w[k]
                m1[k] = 0.9 * m1.get(k, 0) + 0.1 * v
                m2[k] = 0.999 * m2.get(k, 0) + 0.001 * v * v
                w[k] = w[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def _described(passage_words: int, most: int):
    """Whole bags of training documents; a document of more than ``most`` passages is none."""
    def run(batches):
        for b in batches:
            bags = (passages(t, passage_words) for t in b.column(1).to_pylist())
            out = [np.array([describe(p) for p in own], np.float32).tobytes() if len(own) <= most else None for own in bags]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], ["doc_id", "y", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_documents: int = 4000, passage_words: int = 100,
          most_passages: int = 40_000) -> AttentionModel | None:
    """Fit on a bounded sample of labelled documents: those whose ids hash lowest, at most
    ``most_documents``, as far as their passages are ``most_passages`` together.  A sampled
    document comes with every passage.  Where an id stands in several rows or with several
    labels, one of them is taken (the least of its measures and label).  None if there is no
    labelled document, or no label differs; null ids and labels are left out."""
    sample = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
              .select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
              .orderBy(F.xxhash64(F.lit(9), "_id"), "_id", "_y").limit(most_documents))
    rows = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
            .join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # most_documents rows
            .select("doc_id", "text", "_y").mapInArrow(_described(passage_words, most_passages), "doc_id long, y int, x binary"))
    bags = written(rows.where("x is not null").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("one")), "bags")
    size = F.octet_length("one.x") / (4 * MEASURES)
    upto = F.sum(size).over(Window.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id"))  # of most_documents rows
    rows = (bags.withColumn("upto", upto).where(F.col("upto") <= most_passages)
            .select("doc_id", "one.y", "one.x").orderBy("doc_id").collect())
    y = np.array([r.y for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, MEASURES).astype(float) for r in rows]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    return AttentionModel().fit(np.concatenate(bags), starts, y)


def _scored(model, passage_words: int, field: str | None, rows_at_once: int = 200):
    """``doc`` and its score; the text is a field of ``doc``, else the second column."""
    def run(batches):
        for b in batches:
            out = np.full(len(b), 0.5)
            column = pc.struct_field(b.column(0), field) if field else b.column(1)
            for at in range(0, len(b) if model is not None else 0, rows_at_once):
                texts = [t or "" for t in column.slice(at, rows_at_once).to_pylist()]
                bags = [np.array([describe(p) for p in passages(t, passage_words)], np.float32) for t in texts]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in bags])[:-1]]).astype(int)
                out[at:at + rows_at_once] = model.score(np.concatenate(bags).astype(float), starts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc", "score"])

    return run


def score(docs: DataFrame, model: AttentionModel | None, passage_words: int = 100) -> DataFrame:
    """(doc, score): each row of ``docs`` as it is, and its score.

    Without a model every score is 0.5.  Every passage of a text counts, however long it is.
    Null and empty texts are scored as one passage without
    words; nulls, repeated rows and other columns pass through; an empty table gives no row.
    """
    own = docs.select(docs["text"]).schema[0]
    field = own.name if own.dataType == StringType() else None  # a text that needs no cast is moved once
    rows = docs.select(F.struct("*").alias("doc"), *([] if field else [text_or_empty(docs).alias("text")]))
    return rows.mapInArrow(_scored(model, passage_words, field), rows.select("doc", F.lit(0.0).alias("score")).schema)


def held_out(doc_id):
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def op9_attention_quality(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(labels["doc_id"])))
    return score(docs.select("doc_id", "text"), model).select(
        "doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
