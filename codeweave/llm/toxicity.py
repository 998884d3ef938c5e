"""Toxicity by a weighted finite-state pattern grammar.

Words map to the symbols insult, threat, target, negation, report, clause
end or other (lexicon: fixed seed words plus words learned from labelled
training documents). Three transducers rewrite the symbol string of a clause
and are composed into one table before use:

    negation   insult/threat within three words after a negation -> negated
    report     insult/threat after a report verb in the clause   -> reported
    target     insult/threat in a clause that names a target     -> aimed

The composed machine runs over the clauses that hold an insult or threat;
each match adds its word's weight to its class. A logistic layer on the
class sums, fitted on training documents, gives the score. A clause that
holds one insult or threat word and nothing else is a match of the plain
classes I and H: much toxic text has no more (README gives the figures), so
lone words do count, with weights of their own. Targets and reports act on
what follows them in the clause.

Learning uses at most SAMPLE_PER_CLASS labelled training rows of either
label, chosen by hash of doc_id (the documented bound of the fit): a word's
weight is the lower bound of its log odds, counted over distinct document
sketches so that copies of one document count once.

Defined cases: null or empty text scores what no match scores; no labelled
rows or only one class leaves the seed lexicon with fixed weights; repeated
rows score alike. Labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashSet, fold_latin, pieces, py_word_hash, scan, text_buffers, work_dir, written

QUERY = "op9_toxicity_grammar"
ORACLE_SQL = None       # a fitted model

THRESHOLD = 0.7
SAMPLE_PER_CLASS = 10_000
LEXICON = 5_000         # learned words kept at most
MIN_SUPPORT = 5
MIN_ODDS = 1.5

# Seed words of the lexicon, by symbol.
SEEDS = {
    "insult": "idiot moron stupid scum trash loser clown pathetic worthless disgusting imbécile "
              "crétin idiota estúpido imbécil dummkopf trottel abschaum",
    "threat": "kill hurt destroy punish murder tuer töten matar",
    "target": "you your he she him her they them we us i me tu toi vous il elle ils elles nous du "
              "dich dir ihr sie er wir ich tú usted ustedes él ella ellos nosotros yo",
    "negation": "not no never none isn't aren't don't without pas jamais aucun sans nicht kein "
                "keine nie ohne nunca sin ningún",
    "report": "said says say told reported reports wrote quoted quote claims claimed allegedly dit "
              "disait affirme selon sagte sagt schrieb laut dijo dice según",
}

# Symbols. The upper block is what the transducers emit.
O, I, H, G, N, R, E = range(7)                      # noqa: E741
NEG, REP, AIM, AIM_H = 7, 8, 9, 10
_IN = 7
_SYMBOL = {"insult": I, "threat": H, "target": G, "negation": N, "report": R}
CLASSES = (I, H, NEG, REP, AIM, AIM_H)
# Class weights before fitting.
PRIOR = {I: 1.0, H: 0.6, NEG: 0.2, REP: 0.3, AIM: 1.3, AIM_H: 1.5}
BIAS = -2.0

Table = dict[tuple[int, int], tuple[int, int]]


def _negation() -> tuple[int, Table]:
    t: Table = {}
    for s in range(4):
        for x in range(_IN):
            if x == N:
                t[s, x] = (3, x)
            elif x == E:
                t[s, x] = (0, x)
            else:
                t[s, x] = (max(0, s - 1), NEG if s and x in (I, H) else x)
    return 4, t


def _report() -> tuple[int, Table]:
    t: Table = {}
    for s in range(2):
        for x in range(8):
            nxt = 1 if x == R else 0 if x == E else s
            t[s, x] = (nxt, REP if s and x in (I, H) else x)
    return 2, t


def _target() -> tuple[int, Table]:
    t: Table = {}
    for s in range(2):
        for x in range(9):
            nxt = 1 if x == G else 0 if x == E else s
            t[s, x] = (nxt, {I: AIM, H: AIM_H}.get(x, x) if s else x)
    return 2, t


def compose(a: tuple[int, Table], b: tuple[int, Table]) -> tuple[int, Table]:
    """The transducer that feeds the output of ``a`` to ``b``."""
    (na, ta), (nb, tb) = a, b
    out: Table = {}
    for (s, x), (s2, y) in ta.items():
        for r in range(nb):
            r2, z = tb[r, y]
            out[s * nb + r, x] = (s2 * nb + r2, z)
    return na * nb, out


def grammar() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) tables of the composed grammar."""
    n, t = compose(compose(_negation(), _report()), _target())
    nxt, out = np.zeros((n, _IN), dtype=int), np.zeros((n, _IN), dtype=int)
    for (s, x), (s2, y) in t.items():
        nxt[s, x], out[s, x] = s2, y
    return nxt, out


# ------------------------------------------------------------- tokenising

_SEP = np.ones(256, dtype=bool)
_SEP[128:] = False
for _r in (range(48, 58), range(65, 91), range(97, 123), (39,)):
    _SEP[list(_r)] = False
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?;:,\n|\"()")] = True


def _scanned(col: pa.Array):
    """(text index, word hashes, clause numbers, folded bytes, starts, ends)
    per text; texts longer than a piece are scanned in whole."""
    data, offs = text_buffers(col)
    for i, j in pieces(data, offs):
        lo = int(offs[i])
        low = fold_latin(data[lo:int(offs[j])])
        h, starts, ends, first = scan(low, offs[i:j + 1] - lo, _SEP)
        clause = np.cumsum(_STOP[low])[starts] if len(starts) else starts
        for k in range(i, j):
            a, b = first[k - i], first[k - i + 1]
            yield k, h[a:b], clause[a:b], low, starts[a:b], ends[a:b]


# --------------------------------------------------------------- learning

def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (word, label, sketch): each distinct word once a text."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            labels = part.column(1).to_pylist()
            words, labs, keys = [], [], []
            for k, h, _, low, s, e in _scanned(part.column(0)):
                if not len(h):
                    continue
                u, at = np.unique(h, return_index=True)
                # The text's minimum over word pairs: copies share it.
                key = int(((h[:-1] * np.uint64(3)) ^ h[1:]).min().view(np.int64)) \
                    if len(h) > 1 else 0
                words += [low[s[x]:e[x]].tobytes() for x in at]
                labs += [labels[k]] * len(u)
                keys += [key] * len(u)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-8", "replace") for w in words], pa.string()),
                 pa.array(labs, pa.int32()), pa.array(keys, pa.int64())],
                names=["word", "toxic", "sketch"])


class Model:
    """Lexicon, class weights and bias; what the scoring tasks receive."""

    def __init__(self, learned: dict[str, float]):
        words: dict[str, tuple[int, float]] = {}
        for name, text in SEEDS.items():
            for w in text.split():
                words[w] = (_SYMBOL[name], 1.0)
        for w, odds in learned.items():
            sym = words.get(w, (I, 0))[0]
            if sym in (I, H):
                words[w] = (sym, odds)
        self.words = words
        self.hashes = np.array([py_word_hash(w.encode()) for w in words], dtype=np.uint64)
        self.symbol = np.array([s for s, _ in words.values()], dtype=np.int64)
        self.weight = np.array([w for _, w in words.values()])
        self.next, self.out = grammar()
        self.coef = np.array([PRIOR[c] for c in CLASSES])
        self.bias = BIAS

    def features(self, table: HashSet, h: np.ndarray, clause: np.ndarray) -> np.ndarray:
        """Class sums over the clauses of one text."""
        f = np.zeros(len(CLASSES))
        pos, key = table.find(h)
        sym = self.symbol[key]
        core = (sym == I) | (sym == H)
        if not core.any():
            return f
        live = np.isin(clause[pos], clause[pos[core]])
        state, last, here = 0, -1, -1
        for p, s, k in zip(pos[live].tolist(), sym[live].tolist(), key[live].tolist(),
                           strict=True):
            if clause[p] != here:
                state, here = 0, clause[p]
            else:
                for _ in range(min(3, p - last - 1)):     # words outside the lexicon
                    state = self.next[state, O]
            y = self.out[state, s]
            state, last = self.next[state, s], p
            if y in CLASSES:
                f[CLASSES.index(y)] += self.weight[k]
        return f

    def score(self, f: np.ndarray) -> np.ndarray:
        z = self.bias + np.log1p(np.maximum(f, 0)) @ self.coef
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, f: np.ndarray, y: np.ndarray) -> None:
        """Ridge-regularised logistic fit around the prior weights; weights
        stay non-negative."""
        x = np.log1p(f)
        prior = np.array([PRIOR[c] for c in CLASSES])
        coef, bias = prior.copy(), BIAS
        wpos = 0.5 / max(y.mean(), 1e-9)
        wneg = 0.5 / max(1 - y.mean(), 1e-9)
        sw = np.where(y == 1, wpos, wneg)
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(x @ coef + bias, -30, 30)))
            g = sw * (p - y)
            coef = np.maximum(0, coef - 0.5 * (x.T @ g / len(y) + 1e-3 * (coef - prior)))
            bias -= 0.5 * (g.mean() + 1e-4 * (bias - BIAS))
        self.coef, self.bias = coef, bias


def _feature_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashSet(model.hashes)
        for batch in batches:
            f = np.zeros((batch.num_rows, len(CLASSES)))
            for k, h, clause, *_ in _scanned(batch.column(0)):
                f[k] = model.features(table, h, clause)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int32())] + [pa.array(f[:, c]) for c in range(f.shape[1])],
                names=["toxic"] + [f"f{c}" for c in range(f.shape[1])])
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", train_rows=None) -> Model:
    """Fit on the labelled rows that ``train_rows(id column)`` admits."""
    base = work_dir(docs.sparkSession, "toxicity")
    lab = labels.select(F.col(id_col).cast("long").alias("__id"),
                        F.col(label_col).cast("int").alias("toxic")).filter(
        "__id is not null and toxic in (0, 1)")
    if train_rows is not None:
        lab = lab.filter(train_rows(F.col("__id")))
    pick = None
    for y in (0, 1):     # SAMPLE_PER_CLASS rows at most of each label
        part = lab.filter(F.col("toxic") == y).dropDuplicates(["__id"]).orderBy(
            F.xxhash64("__id"), "__id").limit(SAMPLE_PER_CLASS)
        pick = part if pick is None else pick.unionByName(part)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # 2 * SAMPLE_PER_CLASS rows of two numbers: a fixed bound.
    sample = written(src.join(F.broadcast(pick), F.col("doc_id") == F.col("__id")).select(
        "text", "toxic"), f"{base}/sample")
    counts = written(sample.mapInArrow(_word_counts, "word string, toxic int, sketch long")
                     .distinct().groupBy("word").agg(
        F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")), f"{base}/words")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    npos, nneg = n.get(1, 0), n.get(0, 0)
    if not npos or not nneg:
        return Model({})
    odds = (F.log((F.col("pos") + 0.5) / (npos + 1.0)) - F.log((F.col("neg") + 0.5) / (nneg + 1.0))
            - 1.64 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5)))
    top = (counts.filter(F.col("pos") >= MIN_SUPPORT).withColumn("odds", odds)
           .filter(F.col("odds") >= MIN_ODDS).orderBy(F.desc("odds"), "word").limit(LEXICON))
    model = Model({r["word"]: min(4.0, r["odds"]) for r in top.collect()})
    cols = ", ".join(f"f{c} double" for c in range(len(CLASSES)))
    rows = sample.mapInArrow(_feature_rows(model), f"toxic int, {cols}").collect()
    a = np.array([tuple(r) for r in rows], dtype=float)
    model.fit(a[:, 1:], a[:, 0])
    return model


# ---------------------------------------------------------------- scoring

def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashSet(model.hashes)
        for batch in batches:
            f = np.zeros((batch.num_rows, len(CLASSES)))
            for k, h, clause, *_ in _scanned(batch.column(1)):
                f[k] = model.features(table, h, clause)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(model.score(f))],
                names=["doc_id", "score"])
    return run


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
           ) -> DataFrame:
    """(doc_id, score) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
                       ).mapInArrow(_scorer(model), "doc_id long, score double")


def rejector(model: Model, threshold: float = THRESHOLD):
    """A pandas UDF ``text -> rejected`` for filtering whole rows."""
    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        table = HashSet(model.hashes)
        f = np.zeros((len(texts), len(CLASSES)))
        for k, h, clause, *_ in _scanned(pa.array(texts, pa.large_string(), from_pandas=True)):
            f[k] = model.features(table, h, clause)
        return pd.Series(model.score(f) >= threshold)
    return rejected


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's toxicity score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"),
                  train_rows=lambda c: ~held_out(c))
    return scores(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
