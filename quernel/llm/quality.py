"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a small network under the non-negative unbiased
risk pi R_p(+) + max(0, R_u(-) - pi R_p(-)); where the bracket turns negative on a mini-batch the step
climbs instead, as the published estimator does. The class prior pi is estimated from the same two samples
by the best-bin method: a positive-versus-unlabelled classifier is trained on one half, and on the other
half pi is the least ratio of the unlabelled to the positive share above a threshold, with a confidence
margin. Labels of value 0 are never used.

Inputs of a score are statistics of the whole text alone. Fitting uses bounded samples (`max_rows` of each
kind, those of the smallest hash); scoring covers every row.

Defined results: a null or empty text gets the statistics of an empty one and so a score; rows without a
doc_id are scored, count as not held out and are never used for fitting; repeated rows get equal scores; texts of any
length are taken whole; further columns of either table, whatever their names, are not looked at; without positives, or with an
empty table, the model falls back to the constant prior `no_labels_score`.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_map

_SYMBOLS = b"#$%&*+<=>@\\^_`{|}~"
_CLASS = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 white, 5 . , ; : ' -, 6 symbols, 7 ! ?, 8 UTF-8 lead, 9 UTF-8 continuation
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\n\r\x0b\x0c", 4), (b".,;:'-", 5), (_SYMBOLS, 6), (b"!?", 7)):
    _CLASS[list(_chars)] = _k
_CLASS[192:], _CLASS[128:192] = 8, 9
FEATURES = 19


def text_features(text: str | None) -> list[float]:
    """Statistics of a whole text: lengths, repetition of words and lines, and shares of character classes."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n, size = len(words), len(b)
    by_byte = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    c = np.bincount(_CLASS, by_byte, minlength=10)
    letters, chars = c[1] + c[2] + c[8], max(1.0, size - c[9])
    lines = [x for x in b.split(b"\n") if x.strip()]
    distinct = len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    return [
        np.log1p(n), np.log1p(size), (size - c[4]) / max(1, n), distinct / max(1, n), np.log1p(distinct) / max(1.0, np.log1p(n)), repeats / max(1, n), np.log1p(repeats),
        c[2] / max(1.0, letters), c[3] / chars, c[5] / max(1, n), c[6] / max(1, n), c[7] / max(1, n), c[8] / chars, (c[0] + c[6]) / chars,
        len(lines) / max(1, n), len(set(lines)) / max(1, len(lines)), by_byte[ord("|")] / max(1, n), np.log1p(c[6]), np.log1p(c[7]),
    ]


@dataclass
class Net:
    """A one-layer network over standardised statistics."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z, np.tanh(z @ self.w1 + self.b1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[1] @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int, hidden: int, epochs: int, batch: int, rate: float, decay: float) -> Net:
    """Adam on the non-negative risk under `prior`; without one, on plain positive-versus-unlabelled logistic loss."""
    rng = np.random.default_rng(seed)
    both = np.vstack([pos, unl])
    net = Net(both.mean(0), both.std(0) + 1e-6, rng.normal(0, 1 / np.sqrt(both.shape[1]), (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), 0.0)
    theta = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in theta], [np.zeros_like(a) for a in theta], 0
    steps = max(1, max(len(pos), len(unl)) // batch)
    for _ in range(epochs):
        pi_, ui = rng.permutation(len(pos)), rng.permutation(len(unl))
        for k in range(steps):
            p = pos[np.take(pi_, np.arange(k * batch, (k + 1) * batch), mode="wrap")]
            u = unl[np.take(ui, np.arange(k * batch, (k + 1) * batch), mode="wrap")]
            x = np.vstack([p, u])
            z, h = net.hidden(x)
            g = np.clip(h @ net.w2 + net.b2, -30, 30)
            s, is_p = 1 / (1 + np.exp(-g)), np.arange(len(x)) < len(p)
            if prior is None:
                d = np.where(is_p, (s - 1) / len(p), s / len(u))
            else:
                # logistic losses: l(+) = softplus(-g), l(-) = softplus(g)
                negative = np.logaddexp(0, g[len(p) :]).mean() - prior * np.logaddexp(0, g[: len(p)]).mean()
                d_neg = np.where(is_p, -prior * s / len(p), s / len(u))
                d = np.where(is_p, prior * (s - 1) / len(p), 0) + d_neg if negative >= 0 else -d_neg
            back = np.outer(d, net.w2) * (1 - h * h)
            grads = [z.T @ back + decay * net.w1, back.sum(0), h.T @ d + decay * net.w2, np.array([d.sum()])]
            t += 1
            for i, gr in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * gr, 0.999 * v[i] + 0.001 * gr * gr
                theta[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
            net.w1, net.b1, net.w2, net.b2 = theta[0], theta[1], theta[2], float(theta[3][0])
    return net


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 11, least_share: float = 0.2) -> float:
    """Best-bin estimate of the positives' share among the unlabelled."""
    rng = np.random.default_rng(seed)
    p, u = rng.permutation(pos), rng.permutation(unl)
    hp, hu = len(p) // 2, len(u) // 2
    if min(hp, hu) < 20:
        return 0.5
    net = _fit(p[:hp], u[:hu], None, seed, 16, 20, 256, 5e-3, 1e-4)
    sp, su = np.sort(net.logit(p[hp:])), np.sort(net.logit(u[hu:]))
    cuts = np.quantile(sp, np.linspace(0, 1 - least_share, 200))
    above = lambda s: 1 - np.searchsorted(s, cuts, side="left") / len(s)
    qp, qu = above(sp), above(su)
    margin = np.sqrt(np.log(20) / 2 / len(su)) + np.sqrt(np.log(20) / 2 / len(sp))
    best = np.argmin((qu + margin) / qp)
    return float(np.clip(qu[best] / qp[best], 0.02, 0.98))


@dataclass
class QualityModel:
    """A fitted network, the prior it was fitted under, and what is scored without a fit."""

    net: Net | None
    prior: float
    no_labels_score: float = 0.5

    def transform(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
        """doc_id, held_out, score and predicted of every row; held_out: crc32 of the id as text is a multiple of 5."""
        net, constant = self.net, self.no_labels_score

        def go(t: pa.Table):
            x = np.array([text_features(s) for s in t.column(2).to_pylist()], np.float64).reshape(-1, FEATURES)
            s = net.score(x) if net is not None else np.full(len(x), constant)
            yield pa.table({"doc_id": t.column(0), "held_out": t.column(1), "score": s, "predicted": (s >= threshold).astype(np.int32)})

        return arrow_map(docs.select(F.col(doc_id).cast("long"), held_out(doc_id).alias("held_out"), F.col(text)), go, "doc_id long, held_out boolean, score double, predicted int")


    def keep(self, docs: DataFrame, text: str = "text", threshold: float = 0.3) -> DataFrame:
        """The rows of docs whose score is threshold or more, as they are; no shuffle."""
        net, constant, where = self.net, self.no_labels_score, docs.columns.index(text)

        def go(t: pa.Table):
            x = np.array([text_features(s) for s in t.column(where).to_pylist()], np.float64).reshape(-1, FEATURES)
            yield t.filter(pa.array(net.score(x) >= threshold if net is not None else np.full(len(x), constant >= threshold)))

        return arrow_map(docs, go, docs.schema)


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", epochs: int = 40, seed: int = 5) -> QualityModel:
    """Fits on at most max_rows positives and max_rows unlabelled documents, none of them held out.

    The labels' table gives the positives' ids only; unlabelled are all documents whatever their label. Samples are the
    rows of the least hashes, ties by their statistics, so repeated ids don't make them larger.
    """
    rank = lambda c: F.xxhash64(c, F.lit(seed))
    train = lambda df: df.where(F.col(doc_id).isNotNull() & ~held_out(doc_id)).withColumnRenamed(doc_id, "doc_id")
    positive = train(labels.select(doc_id, F.col(quality).alias("q"))).where("q = 1").select(F.col("doc_id").cast("long").alias("i")).distinct().orderBy(rank("i")).limit(max_rows).withColumn("positive", F.lit(True))
    unlabelled = train(docs.select(doc_id)).select(F.col("doc_id").cast("long").alias("i")).orderBy(rank(F.col("i") + 1)).limit(max_rows).distinct().withColumn("positive", F.lit(False))
    # both sides of the union are at most max_rows ids
    chosen = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).join(F.broadcast(positive.unionByName(unlabelled)), "i").select("i", "positive", "t")

    def go(t: pa.Table):
        yield pa.table({"i": t.column(0), "positive": t.column(1), "x": pa.array([text_features(s) for s in t.column(2).to_pylist()], pa.list_(pa.float64()))})

    first = F.row_number().over(Window.partitionBy("positive").orderBy(rank(F.col("i") + F.when(F.col("positive"), 0).otherwise(1)), "i", "x"))
    rows = arrow_map(chosen, go, "i long, positive boolean, x array<double>").withColumn("first", first).where(F.col("first") <= max_rows).drop("first").toArrow()
    p = rows.column("positive").to_numpy().astype(bool)
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    order = np.lexsort((*x.T, p, rows.column("i").to_numpy()))  # rows come in any order
    x, p = x[order], p[order]
    if not p.any() or p.all():
        return QualityModel(None, 0.5)
    prior = estimate_prior(x[p], x[~p])
    return QualityModel(_fit(x[p], x[~p], prior, seed, 24, epochs, 256, 3e-3, 1e-4), prior)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """Fits and scores: doc_id, held_out, score, predicted of every row of docs."""
    return fit(docs, labels, **fitting).transform(docs, threshold=threshold)
