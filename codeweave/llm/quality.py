"""Quality by a weak-label model.

Nine overlapping heuristics vote good (1), bad (-1) or abstain (0) on every
document. Expectation-maximisation over the counts of vote patterns (at most
3^9 rows, counted over all documents) estimates how each labeller votes
given the class, the labellers taken as independent within a class; the
posterior of a pattern is its documents' label. These labels train a linear
scorer on hashed words and word shapes, fitted on at most FIT_PER_CLASS
documents of either side, chosen by hash (the documented bound of the fit);
the scorer then scores every document.

Hand-made quality labels are never an input; they only serve to test.

Defined cases: null or blank text votes bad on length and scores by the bias
alone; repeated rows score alike; with one class only the
scorer returns the posterior of the document's own votes; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (LOWER, SPACE, U, pieces, scan, span_hashes, text_buffers, work_dir, written)

QUERY = "op7_weak_label_quality"
ORACLE_SQL = None       # a fitted model

LABELLERS = ("symbols", "marks", "capitals", "length", "word_length", "short_words", "sentences",
             "repeats", "echoes")
BITS = 14
WIDTH = (1 << BITS) + 2
FIT_PER_CLASS = 3000
STEPS = 150
EM_STEPS = 100
KEEP = 0.5

# Byte classes of word shapes: letters lower and upper, digits, the rest as is.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = 48
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#$%&*|<>{}[]~^_=+\\/@")] = 1
_MARK = np.zeros(256, dtype=np.int64)
_MARK[list(b"!?")] = 1
_UP = np.zeros(256, dtype=np.int64)
_UP[65:91] = 1
_LETTER = np.zeros(256, dtype=np.int64)
for _lo, _hi in ((65, 91), (97, 123), (128, 256)):
    _LETTER[_lo:_hi] = 1
_STOP = np.zeros(256, dtype=np.int64)
_STOP[list(b".!?")] = 1


class Batch:
    """Scanned texts: per-text statistics and hashed features."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        lo = int(offs[0])
        buf, offs = data[lo:int(offs[-1])], offs - lo
        self.n = len(offs) - 1
        h, start, end, first = scan(LOWER[buf], offs, SPACE)
        self.first = first
        self.words = np.diff(first).astype(float)

        def total(table):
            c = np.concatenate([[0], np.cumsum(table[buf])]) if len(buf) else np.zeros(1, int)
            return (c[offs[1:]] - c[offs[:-1]]).astype(float)
        w = np.maximum(self.words, 1)
        size = np.maximum(np.diff(offs), 1)
        letters = total(_LETTER)
        same = np.zeros(len(h), dtype=bool)      # a word like the one before
        same[1:] = h[1:] == h[:-1]
        same[first[:-1][first[:-1] < len(h)]] = False
        echo = np.concatenate([[0], np.cumsum(same)])
        echo = (echo[first[1:]] - echo[first[:-1]]) / w
        short = np.concatenate([[0], np.cumsum((end - start) <= 3)])
        lines, doubled = self._lines(buf, offs)
        self.stats = np.stack([
            total(_SYMBOL) / size, total(_MARK) / w, total(_UP) / np.maximum(letters, 1),
            self.words, letters / w, (short[first[1:]] - short[first[:-1]]) / w,
            w / np.maximum(total(_STOP), 1), doubled / np.maximum(lines, 1), echo], axis=1)
        shape = span_hashes(_SHAPE[buf], start, end) if len(start) else h
        # Two features a word: itself, and its shape in runs.
        self.feature = np.concatenate([(h >> U(65 - BITS)).astype(np.int64),
                                       (shape >> U(65 - BITS)).astype(np.int64)
                                       + (1 << (BITS - 1))])
        doc = np.repeat(np.arange(self.n), np.diff(first))
        self.doc = np.concatenate([doc, doc])

    def _lines(self, buf, offs):
        sep = np.zeros(256, dtype=bool)
        sep[10] = True
        h, _, _, first = scan(buf, offs, sep)
        n = np.diff(first).astype(float)
        if not len(h):
            return n, n
        doc = np.repeat(np.arange(self.n), np.diff(first)).astype(np.uint64)
        with np.errstate(over="ignore"):
            u = np.unique(h ^ (doc * U(0x9E3779B97F4A7C15)), return_index=True)[1]
        return n, n - np.bincount(doc[u].astype(np.int64), minlength=self.n)

    def votes(self) -> np.ndarray:
        sym, mark, up, words, letters, short, sent, rep, echo = self.stats.T
        v = np.zeros((self.n, len(LABELLERS)), dtype=np.int8)

        def rule(k, bad, good):
            v[:, k] = np.where(bad, -1, np.where(good, 1, 0))
        rule(0, sym > 0.02, sym < 0.003)
        rule(1, mark > 0.02, mark < 0.005)
        # Shares say little about a text of a few words: there they abstain.
        full = words >= 20
        rule(2, full & (up > 0.12), up < 0.06)
        rule(3, words < 1, words > 30)
        rule(4, full & ((letters < 3.5) | (letters > 8)), (letters > 4) & (letters < 6.5))
        rule(5, full & ((short < 0.12) | (short > 0.45)), (short > 0.2) & (short < 0.4))
        rule(6, full & ((sent > 40) | (sent < 2)), (sent > 3) & (sent < 25))
        rule(7, rep > 0.35, rep < 0.1)
        rule(8, full & (echo > 0.2), echo < 0.05)
        return v

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, feature, share of the doc's words) of the hashed features."""
        key, n = np.unique(self.doc * (1 << BITS) + self.feature, return_counts=True)
        doc = key >> BITS
        feat, share = key & ((1 << BITS) - 1), n / np.maximum(self.words[doc], 1)
        # Shares of repeated lines and echoed words, as two more features.
        docs = np.arange(self.n)
        doc = np.concatenate([doc, docs, docs])
        feat = np.concatenate([feat, docs * 0 + (1 << BITS), docs * 0 + (1 << BITS) + 1])
        share = np.concatenate([share, self.stats[:, 7], self.stats[:, 8]])
        order = np.argsort(doc, kind="stable")
        return doc[order], feat[order], share[order]


def _batches(col: pa.Array) -> Iterator[tuple[int, int, Batch]]:
    data, offs = text_buffers(col)
    for i, j in pieces(data, offs):
        yield i, j, Batch(data, offs[i:j + 1])


def pattern_id(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [pattern_id(b.votes()) for _, _, b in _batches(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()),
             pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))],
            names=["doc_id", "pattern"])


# ------------------------------------------------- expectation-maximisation

def fit_labellers(pattern: np.ndarray, count: np.ndarray, steps: int = EM_STEPS
                  ) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, vote tables K x 2 x 3, prior)."""
    k = len(LABELLERS)
    votes = pattern[:, None] // 3 ** np.arange(k) % 3 - 1
    w = count.astype(float)
    # Start from the majority; any bad vote weighs more than a good one.
    post = 1 / (1 + np.exp(-(votes * np.where(votes < 0, 2.0, 0.5)).sum(axis=1)))
    tables, prior = np.zeros((k, 2, 3)), 0.5
    for _ in range(steps):
        tables[:, :, 1] = 0.0
        prior = float(np.clip((w * post).sum() / w.sum(), 0.01, 0.99))
        for j in range(k):
            for x in (0, 2):     # an abstention carries no evidence
                m = votes[:, j] == x - 1
                tables[j, 1, x] = (w * post)[m].sum() + 1
                tables[j, 0, x] = (w * (1 - post))[m].sum() + 1
        tables /= tables.sum(axis=2, keepdims=True)
        tables[:, :, 1] = 1.0
        z = np.log(prior / (1 - prior)) + sum(
            np.log(tables[j, 1, votes[:, j] + 1] / tables[j, 0, votes[:, j] + 1])
            for j in range(k))
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post, tables, prior


# ------------------------------------------------------------------ scorer

def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, good) -> (good, features, shares) for the fit."""
    for batch in batches:
        good = batch.column(1).to_pylist()
        f, s = [], []
        for _, _, b in _batches(batch.column(0)):
            doc, feat, share = b.counts()
            cut = np.searchsorted(doc, np.arange(1, b.n))
            f += np.split(feat, cut)
            s += np.split(share, cut)
        yield pa.RecordBatch.from_arrays(
            [pa.array(good, pa.float64()), pa.array(f, pa.list_(pa.int64())),
             pa.array(s, pa.list_(pa.float64()))], names=["good", "f", "s"])


def fit_scorer(good: np.ndarray, feats: list, shares: list) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by full-batch Adam on balanced classes."""
    doc = np.repeat(np.arange(len(feats)), [len(x) for x in feats])
    f = np.concatenate(feats).astype(np.int64) if len(feats) else np.zeros(0, np.int64)
    s = np.sqrt(np.concatenate(shares)) if len(feats) else np.zeros(0)
    n = len(good)
    share = np.clip(good.mean(), 1e-3, 1 - 1e-3)
    sw = np.where(good >= 0.5, 0.5 / share, 0.5 / (1 - share))
    w, b = np.zeros(WIDTH), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = np.bincount(doc, weights=w[f] * s, minlength=n) + b
        g = sw * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good) / n
        gw = np.bincount(f, weights=g[doc] * s, minlength=len(w)) + 1e-5 * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9 ** t, 1 - 0.99 ** t
        w -= 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def _scorer(w: np.ndarray, b: float, posterior: dict[int, float], use_votes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, posts = [], []
            for _, _, x in _batches(batch.column(1)):
                pid = pattern_id(x.votes())
                post = np.array([posterior.get(p, 0.5) for p in pid.tolist()])
                doc, feat, share = x.counts()
                z = np.bincount(doc, weights=w[feat] * np.sqrt(share), minlength=x.n) + b
                scores.append(post if use_votes else 1 / (1 + np.exp(-np.clip(z, -30, 30))))
                posts.append(post)
            z = np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()),
                 pa.array(np.concatenate(posts) if posts else z),
                 pa.array(np.concatenate(scores) if scores else z)],
                names=["doc_id", "posterior", "score"])
    return run


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP
            ) -> DataFrame:
    """(doc_id, posterior, score, kept) of every row: the weak label's
    posterior, the scorer's probability of good, and score >= ``keep``."""
    base = work_dir(docs.sparkSession, "quality")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    votes = written(src.mapInArrow(_votes, "doc_id long, pattern long"), f"{base}/votes")
    rows = votes.groupBy("pattern").count().orderBy("pattern").collect()     # <= 3^9
    pattern = np.array([r["pattern"] for r in rows], dtype=np.int64)
    posterior: dict[int, float] = {}
    if len(pattern):
        post, _, _ = fit_labellers(pattern, np.array([r["count"] for r in rows]))
        posterior = dict(zip(pattern.tolist(), post.tolist(), strict=True))
    sides = []
    for good in (True, False):
        own = [p for p, x in posterior.items() if (x >= 0.5) == good]
        sides.append(votes.filter(F.col("pattern").isin(own) & F.col("doc_id").isNotNull())
                     .dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id")
                     .limit(FIT_PER_CLASS).select(F.col("doc_id").alias("__id"), "pattern"))
    label = F.create_map(*[F.lit(x) for kv in posterior.items() for x in kv]) \
        if posterior else F.lit(None)
    # 2 * FIT_PER_CLASS rows of two numbers: a fixed bound.
    sample = src.join(F.broadcast(sides[0].unionByName(sides[1])),
                      F.col("doc_id") == F.col("__id")).select(
        "text", F.element_at(label, F.col("pattern")).cast("double").alias("good")) \
        if posterior else src.limit(0).select("text", F.lit(0.5).alias("good"))
    fit = sample.mapInArrow(_features, "good double, f array<long>, s array<double>").collect()
    good = np.array([r["good"] for r in fit])
    both = len(good) > 0 and (good >= 0.5).any() and (good < 0.5).any()
    w, b = fit_scorer(good, [np.array(r["f"]) for r in fit], [np.array(r["s"]) for r in fit]) \
        if both else (np.zeros(WIDTH), 0.0)
    out = src.mapInArrow(_scorer(w, b, posterior, not both),
                         "doc_id long, posterior double, score double")
    return out.withColumn("kept", F.col("score") >= keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's quality score."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
