"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Subwords are the runs of 2 to 5 UTF-8 bytes of a lowered text that lie in one word, its edges counted; each is
hashed to a row of an embedding. A text is the mean of its rows, and a linear layer with softmax gives the classes.
Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled texts and on short cuts of
them. A temperature and a rejection threshold are then fitted on rows that training left out.

As mean and layer are linear, prediction adds up one precomputed row of class scores for each subword of the whole
text, without a word list or a loop over words.

Defined results: a null text, or one without a letter, is 'und' with score 0 and rejected; without labelled rows
every text is 'und'; ties go to the first class by name. Rows are judged one by one, so repeated rows agree. Extra
columns pass through, one named like the result as input_<name>. A letter is a code point of a Unicode category L.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import apart, bounded_batches

SIZES = (2, 3, 4, 5)
BUCKETS = 1 << 16
DIM = 16
EPOCHS = 4
#: Labelled rows a fit may take, in the order of a hash of doc_id.
MAX_ROWS = 4000
#: Bytes of text a fit may take: rows beyond it, in that order, are left out.
MAX_BYTES = 64 << 20
#: Share of the calibration rows that the threshold may reject although they are right.
REJECTED_RIGHT = 0.005
_PIECE = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold(text: str) -> bytes:
    return b" " + text.lower().encode().translate(_FOLD) + b" "


def buckets(text: bytes) -> list[np.ndarray]:
    """For each size, the hashed rows of the subwords of a folded text; -1 where a space lies inside."""
    a = np.frombuffer(text, np.uint8)
    space = np.r_[0, np.cumsum(a == 32, dtype=np.int64)]
    b = a.astype(np.uint32)
    out, h = [], b.copy()
    for n in range(2, max(SIZES) + 1):
        if len(a) < n:
            break
        h = h[: len(a) - n + 1] * np.uint32(0x01000193) ^ b[n - 1 :]
        if n in SIZES:
            mixed = h * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            row = (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
            i = np.arange(len(row))
            inner = space[i + n - 1] - space[i + 1]
            both = (a[: len(row)] == 32) & (a[n - 1 :] == 32)
            row[(inner > 0) | both & (n == 2)] = -1
            out.append(row)
    return out


def pieces(text: bytes) -> list[bytes]:
    """A folded text cut at spaces, so that no subword is lost; a space is in both pieces."""
    out, at = [], 0
    while len(text) - at > _PIECE:
        cut = text.rfind(b" ", at + 1, at + _PIECE)
        cut = cut if cut > at else at + _PIECE
        out.append(text[at : cut + 1])
        at = cut
    return [*out, text[at:]]


@dataclass(frozen=True)
class Model:
    """Class scores of each hashed row; score = softmax(mean / temperature)."""

    classes: tuple[str, ...]
    rows: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.classes)), 0
        for piece in pieces(fold(text)):
            for row in buckets(piece):
                row = row[row >= 0]
                total += self.rows[row].sum(axis=0, dtype=np.float64)
                n += len(row)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.classes or not _LETTER.search(text):
            return "und", 0.0, True
        p = softmax(self.logits(text) / self.temperature)
        k = int(np.argmax(p))
        return self.classes[k], float(p[k]), bool(p[k] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    rows = [r[r >= 0] for p in pieces(fold(text)) for r in buckets(p)]
    ids, n = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]), return_counts=True)
    return ids, (n / max(n.sum(), 1)).astype(np.float32)


def train(texts: list[str], langs: list[str], *, dim: int = DIM, epochs: int = EPOCHS, rate: float = 0.5, seed: int = 3) -> Model:
    """Fit by gradient descent; every fifth row calibrates."""
    classes = tuple(sorted(set(langs)))
    rng = np.random.default_rng(seed)
    number = {c: i for i, c in enumerate(classes)}
    order = rng.permutation(len(texts))
    held = set(order[::5].tolist()) if len(texts) >= 20 else set()
    bags, ys = [], []
    for i in order.tolist():
        if i in held or not _LETTER.search(texts[i]):
            continue
        words = texts[i].split()
        at = int(rng.integers(len(words)))
        cut = " ".join(words[at : at + int(rng.integers(1, 25))])
        for t in (texts[i], cut):
            ids, w = _bag(t)
            if len(ids):
                bags.append((ids, w))
                ys.append(number[langs[i]])
    e = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((len(classes), dim), np.float32), np.zeros(len(classes), np.float32)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)).tolist():
            ids, w = bags[k]
            x = w @ e[ids]
            g = softmax(layer @ x + bias)
            g[ys[k]] -= 1
            step = rate * (1 - done / steps)
            back = layer.T @ g
            layer -= step * np.outer(g, x)
            bias -= step * 0.01 * g
            e[ids] -= np.float32(step * 20) * np.outer(w, back)  # a text's rows share its gradient by their weights
            done += 1
    model = Model(classes, (e @ layer.T).astype(np.float32), bias.astype(np.float64))
    known = [(i, model.logits(texts[i])) for i in sorted(held) if _LETTER.search(texts[i])]
    if not known:
        return model
    logits, y = np.array([x for _, x in known]), np.array([number[langs[i]] for i, _ in known])
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    best = min(np.geomspace(0.05, 20, 80), key=loss)
    p = softmax(logits / best)
    right = p.argmax(axis=1) == y
    least = float(np.quantile(p.max(axis=1)[right], REJECTED_RIGHT)) if right.any() else 0.0
    return Model(classes, model.rows, model.bias, float(best), least)


def held_out(id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Learn from whole texts of rows with a language that are not held out; max_rows and max_bytes bound the rows taken."""
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    taken = own.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_rows)
    near = own.join(F.broadcast(taken), "id", "left_semi").where("text is not null").withColumn("order", F.struct(F.xxhash64("id"), F.col("id").cast("string"), F.xxhash64("text"), F.col("lang")))
    sizes = near.select("order", F.octet_length("text").alias("n")).orderBy("order").limit(max_rows).collect()
    total, last = 0, None
    for r in sizes:
        total += r.n
        if total > max_bytes and last is not None:
            break
        last = r.order
    if last is None:
        return train([], [])
    bound = F.struct(*(F.lit(v) for v in last))
    rows = near.where(F.col("order") <= bound).orderBy("order").limit(max_rows).collect()
    return train([r.text for r in rows], [r.lang for r in rows])


SCHEMA = "struct<lang:string,score:double,rejected:boolean>"
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def predict(docs: DataFrame, model: Model, *, text: str = "text", to: str = "language") -> DataFrame:
    """docs with a struct of the language, its calibrated probability, and whether it is below the threshold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def of(column: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("lang", "score", "rejected"), sent.value.predict(x), strict=True)) for x in column.to_pylist()], _ARROW)

    return apart(docs, to).withColumn(to, F.arrow_udf(of, SCHEMA).asNondeterministic()(F.col(text)))
