"""Benchmark decontamination by latent semantic retrieval.

1. The distinct words of the benchmark items are the vocabulary (words: runs
   of other than space and \\t-\\r, ASCII and Latin-1 letters lowered; a word
   outside it can add nothing to a match). Every document is encoded once as vocabulary ids and
   written; all later passes read that table.
2. Document frequencies over all passages (PASSAGE words each) give idf.
3. Distributed randomised SVD of the TF-IDF passage matrix A (features:
   hashed vocabulary): every task adds up its share of Z = A'(A S) for a
   sparse sign matrix S, a salted tree sums the shares, and the single-pass
   (Nystrom) form turns Z into the leading right singular vectors, scaled
   by the inverse root of the singular values so that the few directions of
   very common words don't decide the cosine.
4. Windows of 16, 32 and 64 words at steps of a quarter of their length are
   projected and compared by cosine with the items of their length class;
   an item longer than a window is compared whole and by windows of its own.
5. A candidate is confirmed by the longest common subsequence between the
   item and the window's surroundings (at least the item's length on both
   sides if it is longer than the window): a share of LCS_STRONG of the item's
   words, or LCS_WEAK when the answer (an ``answer`` column, else the item's
   last ANSWER_WORDS words) is found there too. A reordered item fails one
   subsequence over the whole; it is confirmed by its PARTS in any order, when
   their subsequences sum up to LCS_PARTS of its words.
6. Items shorter than MIN_WORDS words are found as exact runs of their words
   (cosine 1).

The benchmark is taken in blocks of at most BLOCK_ITEMS items: what is sent
to the tasks is bounded by that, whatever the size of the benchmark.

Result: one row per contaminated (doc_id, item_id). Defined cases: null or
blank texts and items match nothing; repeated rows give repeated doc_ids
only once; different texts under one id are told apart by a text hash, so
``clean`` drops the row that holds the item and no other, with or without id;
empty tables give no rows; only the columns named are read, so others never
clash (``clean`` returns them all); long texts are scanned in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (HashSet, U, fold_latin, mix, py_word_hash, scanned, text_buffers, work_dir, written)

QUERY = "op6_latent_decontamination"
ORACLE_SQL = None       # singular vectors have no SQL form

BLOCK_ITEMS = 2000      # items in one block of the benchmark
PASSAGE = 128
FEATURES = 2048
RANK, OVERSAMPLE = 128, 32
WINDOWS = (16, 32, 64)
COSINE = 0.5
LCS_STRONG, LCS_WEAK = 0.75, 0.6
LCS_PARTS = 0.8
PARTS, PART_WORDS = 4, 8    # at most so many parts, of at least so many words
ANSWER_WORDS, ANSWER_SHARE = 5, 0.8
MIN_WORDS = 8
CHUNK = 1 << 13         # words searched at once
OVERLAP = 256           # at least; else twice the longest item
COLUMNS = 1 << 12       # item vectors compared at once
FANIN = 64

_HASH = "__text_hash"     # tells texts of one id apart
RESULT_SCHEMA = "doc_id long, item_id long, cosine double, lcs int, item_words int, start long"


# --------------------------------------------------------------- benchmark

class Items:
    """One block of the benchmark, encoded; sent to the tasks."""

    def __init__(self, rows: list[tuple]):
        words: dict[bytes, int] = {}
        self.ids, self.seqs, self.answers, self.parts = [], [], [], []
        for item_id, text, answer in rows:
            seq = self._encode(text, words)
            if not seq:
                continue
            ans = self._encode(answer, words) if answer and answer.strip() else []
            self.ids.append(item_id)
            self.seqs.append(np.array(seq, dtype=np.int64))
            self.answers.append(np.array(ans or seq[-ANSWER_WORDS:], dtype=np.int64))
            n = max(1, min(PARTS, len(seq) // PART_WORDS))
            self.parts.append(np.array_split(self.seqs[-1], n))
        self.size = len(words)
        # Vocabulary ids start at 1; 0 is any other word.
        self.hashes = np.array([py_word_hash(w) for w in words], dtype=np.uint64)
        v = np.arange(self.size + 1, dtype=np.uint64)
        h = mix(v * U(0x9E3779B97F4A7C15) + U(1))
        self.feature = (h % U(FEATURES)).astype(np.int64) if self.size > FEATURES else \
            v.astype(np.int64) % FEATURES
        self.sketch_col = (mix(h) % U(RANK + OVERSAMPLE)).astype(np.int64)
        # (item, the words compared) of each window size.
        self.classes = [[] for _ in WINDOWS]
        self.short: dict[int, dict[bytes, list[int]]] = {}
        wide = WINDOWS[-1]
        for k, s in enumerate(self.seqs):
            if len(s) < MIN_WORDS:
                self.short.setdefault(len(s), {}).setdefault(s.tobytes(), []).append(k)
                continue
            members = self.classes[int(np.searchsorted(WINDOWS[:-1], len(s)))]
            members.append((k, s))
            if len(s) > wide:
                at = [*range(0, len(s) - wide, wide // 2), len(s) - wide]
                members += [(k, s[x:x + wide]) for x in at]
        self.overlap = max([OVERLAP, *(2 * len(s) for s in self.seqs)])

    @staticmethod
    def _encode(text: str | None, words: dict[bytes, int]) -> list[int]:
        b = fold_latin(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)).tobytes()
        return [words.setdefault(w, len(words) + 1) for w in b.split()]


def bench_blocks(bench: DataFrame, item_col: str, text_col: str, block: int = BLOCK_ITEMS
                 ) -> Iterator[Items]:
    """The benchmark block by block (blocks by hash; each is bounded)."""
    answer = F.col("answer").cast("string") if "answer" in bench.columns else F.lit(None)
    b = bench.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t"),
                     answer.cast("string").alias("a"))
    n = max(1, -(-b.count() * 5 // (block * 4)))
    for k in range(n):
        part = b if n == 1 else b.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        rows = [tuple(r) for r in part.orderBy("i", "t").collect()]
        if rows:
            yield Items(rows)


# ----------------------------------------------------------------- encode

def _encoder(hashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashSet(hashes)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                data, offs = text_buffers(part.column(1))
                out = []
                for i, j, h, first in scanned(data, offs, fold_latin):
                    ids = np.zeros(len(h), dtype="<u4" if len(hashes) > 65534 else "<u2")
                    pos, k = table.find(h)
                    ids[pos] = k + 1
                    out += [ids[first[x]:first[x + 1]].tobytes() for x in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(2), pa.array(out, pa.binary())],
                    names=["doc_id", _HASH, "ids"])
    return run


def _decoded(batch: pa.RecordBatch, wide: bool) -> Iterator[tuple[tuple, np.ndarray]]:
    for d, h, b in zip(*[batch.column(k).to_pylist() for k in (0, 1)], batch.column(2), strict=True):
        yield (d, h), np.frombuffer(b.as_buffer(), dtype="<u4" if wide else "<u2")


# ------------------------------------------------------------- statistics

def _frequencies(size: int, wide: bool):
    """Passages each vocabulary word occurs in, and the passage count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size + 1, dtype=np.int64), 0
        for batch in batches:
            for _, ids in _decoded(batch, wide):
                p = np.arange(len(ids)) // PASSAGE
                live = ids > 0
                key = np.unique(p[live] * (size + 1) + ids[live].astype(np.int64))
                df += np.bincount(key % (size + 1), minlength=size + 1)
                n += -(-len(ids) // PASSAGE)
        df[0] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["v", "n"])
    return run


def _sketch(items: Items, idf: np.ndarray, wide: bool):
    """Each task's share of Z = A'(A S), FEATURES x (RANK + OVERSAMPLE)."""
    width = RANK + OVERSAMPLE
    sign = np.where(mix(np.arange(items.size + 1, dtype=np.uint64) + U(77)) & U(1), 1.0, -1.0)
    feature, col = items.feature, items.sketch_col
    # S acts on features, so words that share a feature share its column.
    fcol = np.zeros(FEATURES, dtype=np.int64)
    fsign = np.ones(FEATURES)
    fcol[feature], fsign[feature] = col, sign

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        z = np.zeros((FEATURES, width))
        rows = 512
        pend_p: list[np.ndarray] = []
        pend_f: list[np.ndarray] = []
        pend_w: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal held
            if not held:
                return
            p, f, w = (np.concatenate(x) for x in (pend_p, pend_f, pend_w))
            for lo in range(0, held, rows):
                m = (p >= lo) & (p < lo + rows) if held > rows else slice(None)
                n = min(rows, held - lo)
                a = np.bincount((p[m] - lo) * FEATURES + f[m], weights=w[m],
                                minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float64)
                scale = 1.0 / np.maximum(np.sqrt(np.einsum("ij,ij->i", a, a)), 1e-12)[:, None]
                y = np.bincount((p[m] - lo) * width + fcol[f[m]], weights=w[m] * fsign[f[m]],
                                minlength=n * width).reshape(n, width).astype(np.float64)
                # Rows of A have length one: the norm enters both factors.
                z[...] += a.astype(np.float32).T @ (y * scale * scale).astype(np.float32)
            pend_p.clear(), pend_f.clear(), pend_w.clear()
            held = 0

        for batch in batches:
            for _, ids in _decoded(batch, wide):
                for lo in range(0, len(ids), rows * PASSAGE):
                    part = ids[lo:lo + rows * PASSAGE]
                    live = np.flatnonzero(part)
                    v = part[live].astype(np.int64)
                    pend_p.append(live // PASSAGE + held)
                    pend_f.append(feature[v])
                    pend_w.append(idf[v])
                    held += -(-len(part) // PASSAGE)
                    if held >= rows:
                        flush()
        flush()
        task = TaskContext.get().partitionId()
        step = 64
        for k in range(0, FEATURES, step):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k // step]), pa.array([task], pa.int64()),
                 pa.array([z[k:k + step].tobytes()], pa.binary())], names=["part", "task", "z"])
    return run


def _sum_parts(key, pdf):
    import pandas as pd
    total = 0
    for b in pdf.sort_values("task")["z"]:
        total = total + np.frombuffer(b)
    return pd.DataFrame({"part": [key[0]], "task": [key[1]], "z": [total.tobytes()]})


def latent_basis(enc: DataFrame, items: Items, idf: np.ndarray, wide: bool, base: str
                 ) -> np.ndarray:
    """Scaled right singular vectors (FEATURES x k) of the passage matrix."""
    schema = "part long, task long, z binary"
    z = written(enc.mapInArrow(_sketch(items, idf, wide), schema), f"{base}/sketch")
    tasks = z.agg(F.max("task")).first()[0] or 0
    while tasks > 0:     # at most FANIN shares meet in one group
        tasks //= FANIN
        z = written(z.withColumn("task", F.floor(F.col("task") / FANIN)).groupBy("part", "task")
                    .applyInPandas(_sum_parts, schema), f"{base}/sketch-{tasks}")
    rows = z.orderBy("part").collect()       # FEATURES x width numbers, a fixed size
    width = RANK + OVERSAMPLE
    if not rows:
        return np.zeros((FEATURES, 1))
    zm = np.concatenate([np.frombuffer(r["z"]) for r in rows]).reshape(FEATURES, width)
    sign = np.where(mix(np.arange(items.size + 1, dtype=np.uint64) + U(77)) & U(1), 1.0, -1.0)
    s = np.zeros((FEATURES, width))
    fcol, fsign = np.zeros(FEATURES, dtype=np.int64), np.ones(FEATURES)
    fcol[items.feature], fsign[items.feature] = items.sketch_col, sign
    s[np.arange(FEATURES), fcol] = fsign
    core = s.T @ zm
    val, vec = np.linalg.eigh((core + core.T) / 2)
    keep = val > max(val.max(), 1e-12) * 1e-9
    root = zm @ (vec[:, keep] / np.sqrt(val[keep]))      # A'A ~ root root'
    u, sv, _ = np.linalg.svd(root, full_matrices=False)
    live = sv[:RANK] > 0
    return u[:, :RANK][:, live] / np.sqrt(sv[:RANK][live])


# ----------------------------------------------------------------- search

def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence, bit-parallel over ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        m = masks.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def _run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` ids."""
    m = max(0, len(ids) - n + 1)
    h = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = mix(h + ids[j:j + m].astype(np.uint64) * U(0x9E3779B97F4A7C15))
    return h


class Searcher:
    def __init__(self, items: Items, idf: np.ndarray, basis: np.ndarray):
        self.items, self.table = items, np.zeros((items.size + 1, basis.shape[1]), np.float32)
        self.table[1:] = basis[items.feature[1:]] * idf[1:, None]
        self.seen = np.zeros(items.size + 1, dtype=bool)
        self.vecs = []
        for members in items.classes:
            m = np.array([self.table[part].sum(axis=0) for _, part in members],
                         dtype=np.float32).reshape(len(members), basis.shape[1])
            self.vecs.append((m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).T)
        self.runs = [(n, np.concatenate([_run_hashes(np.frombuffer(b, np.int64), n) for b in of]), of)
                     for n, of in items.short.items()]

    def documents(self, docs: list[np.ndarray]) -> list[dict[int, tuple[float, int, int]]]:
        """For each document: item index -> (cosine, lcs, start) of a
        confirmed window. Documents are laid end to end, CHUNK words at a
        time; longer ones overlap from chunk to chunk."""
        best: list[dict] = [{} for _ in docs]
        held, size = [], 0
        step = max(CHUNK, self.items.overlap)
        for d, ids in enumerate(docs):
            self._short_runs(ids, best[d])
            for lo in range(0, max(1, len(ids)), step):
                part = ids[lo:lo + step + self.items.overlap]
                if not part.any():
                    continue
                held.append((d, lo, part))
                size += len(part)
                if size >= CHUNK:
                    self._chunk(held, best)
                    held, size = [], 0
        if held:
            self._chunk(held, best)
        return best

    def _short_runs(self, ids: np.ndarray, best: dict) -> None:
        ids = ids.astype(np.int64) if self.runs else ids
        for n, keys, of in self.runs:
            for at in np.flatnonzero(np.isin(_run_hashes(ids, n), keys)).tolist():
                for k in of.get(ids[at:at + n].tobytes(), ()):
                    best.setdefault(k, (1.0, n, at))

    def _chunk(self, held: list[tuple[int, int, np.ndarray]], best: list[dict]) -> None:
        unit = WINDOWS[0] // 4
        # A text shorter than the largest window is padded to it, so that
        # windows hold one text's words but for its ragged end.
        room = np.array([max(-(-len(p) // unit), WINDOWS[-1] // unit) for _, _, p in held])
        first = np.concatenate([[0], np.cumsum(room)])
        n = int(first[-1])
        ids = np.zeros(n * unit, dtype=np.int64)
        for (_, _, p), f in zip(held, first.tolist(), strict=False):
            ids[f * unit:f * unit + len(p)] = p
        blocks = np.take(self.table, ids[::unit], axis=0)
        for k in range(1, unit):
            blocks += np.take(self.table, ids[k::unit], axis=0)
        for c, size in enumerate(WINDOWS):
            span = size // unit
            if c:        # windows of the next size from sums of two halves
                half = span // 2
                tail = np.zeros_like(sums)
                tail[:len(sums) - half] = sums[half:]
                sums = sums + tail
            else:
                sums = blocks
                for _ in range(span.bit_length() - 1):
                    half = 1 << _
                    tail = np.zeros_like(sums)
                    tail[:len(sums) - half] = sums[half:]
                    sums = sums + tail
            if not self.items.classes[c]:
                continue
            at = np.arange(0, n, size // 4 // unit)
            win = sums[at]
            norm = np.sqrt(np.einsum("ij,ij->i", win, win))
            least = COSINE * np.maximum(norm, 1e-12)[:, None]
            parts = []
            for lo in range(0, self.vecs[c].shape[1], COLUMNS):
                cos = win @ self.vecs[c][:, lo:lo + COLUMNS]
                rows, cols = np.nonzero(cos >= least)
                parts.append((rows, cols + lo, cos[rows, cols] / norm[rows]))
            rows, cols, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(rows):
                continue
            owner = np.searchsorted(first, at[rows], "right") - 1
            tried: set[tuple[int, int, int]] = set()
            for w, j, o, v in zip(at[rows].tolist(), cols.tolist(), owner.tolist(),
                                  value.tolist(), strict=True):
                d, lo, part = held[o]
                k, start = self.items.classes[c][j][0], (w - int(first[o])) * unit
                n_words = len(self.items.seqs[k])
                a, b = start - size // 2, start + size + size // 2
                if n_words > size:
                    # Hits of a long item in one stretch share one region,
                    # which holds the item's length on both sides of each.
                    half = max(size, n_words // 2)
                    block = start // half
                    if (o, k, block) in tried:
                        continue
                    tried.add((o, k, block))
                    a, b = block * half - n_words, (block + 1) * half + size + n_words
                self._confirm(part, max(0, a), b, start, k, v, lo, best[d])

    def _confirm(self, ids, a, b, start, k, cosine, lo, best) -> None:
        seq = self.items.seqs[k]
        had = best.get(k)
        if had and had[1] == len(seq):
            return
        region = ids[a:b]
        # Words in common bound the subsequence from above.
        self.seen[region] = True
        self.seen[0] = False
        common = np.count_nonzero(self.seen[seq])
        self.seen[region] = False
        if common < LCS_WEAK * len(seq):
            return
        lcs = lcs_length(seq, region)
        ok = lcs >= LCS_STRONG * len(seq)
        if not ok and lcs >= LCS_WEAK * len(seq):
            ans = self.items.answers[k]
            ok = lcs_length(ans, region) >= ANSWER_SHARE * len(ans)
        if not ok and common >= LCS_PARTS * len(np.unique(seq)):
            lcs = sum(lcs_length(part, region) for part in self.items.parts[k])
            ok = lcs >= LCS_PARTS * len(seq)
        if ok and (had is None or (lcs, cosine) > (had[1], had[0])):
            best[k] = (cosine, lcs, lo + start)


def _search(items: Items, idf: np.ndarray, basis: np.ndarray, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items, idf, basis)
        for batch in batches:
            rows = list(_decoded(batch, wide))
            out = [(*d, items.ids[k], cos, lcs, len(items.seqs[k]), start)
                   for (d, _), best in zip(rows, searcher.documents([x for _, x in rows]),
                                           strict=True)
                   for k, (cos, lcs, start) in best.items()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (
                    pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(),
                    pa.int64()), strict=True)],
                names=["doc_id", _HASH, "item_id", "cosine", "lcs", "item_words", "start"])
    return run


def _found(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str,
           item_text: str) -> DataFrame:
    """The result's columns and the hash of the text, once per text."""
    spark = docs.sparkSession
    base = work_dir(spark, "decontam")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                      F.xxhash64(text_col).alias(_HASH))
    found = None
    for b, items in enumerate(bench_blocks(bench, item_col, item_text)):
        if not items.ids:
            continue
        wide = items.size > 65534
        enc = written(src.mapInArrow(_encoder(items.hashes),
                                     f"doc_id long, {_HASH} long, ids binary"),
                      f"{base}/{b}/encoded")
        # Vocabulary-sized, so bounded by the block.
        df = {r["v"]: r["n"] for r in enc.mapInArrow(
            _frequencies(items.size, wide), "v long, n long")
            .groupBy("v").agg(F.sum("n").alias("n")).collect()}
        n = max(1, df.get(0, 0))
        idf = np.zeros(items.size + 1)
        idf[1:] = [np.log((n + 1) / (df.get(v, 0) + 1)) + 0.1 for v in range(1, items.size + 1)]
        basis = latent_basis(enc, items, idf, wide, f"{base}/{b}")
        hits = enc.mapInArrow(_search(items, idf, basis, wide),
                              RESULT_SCHEMA.replace(", ", f", {_HASH} long, ", 1))
        hits = written(_best(hits, "doc_id", _HASH, "item_id"), f"{base}/{b}/found")
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame(
        [], f"{RESULT_SCHEMA}, {_HASH} long")


def _best(hits: DataFrame, *keys: str) -> DataFrame:
    return hits.groupBy(*keys).agg(
        F.max_by(F.struct("cosine", "lcs", "item_words", "start"),
                 F.struct("lcs", "cosine")).alias("m")).select(*keys, "m.*")


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
                 ) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, item_words, start) of every document
    that holds a benchmark item, near verbatim or paraphrased."""
    return _best(_found(docs, bench, id_col, text_col, item_col, item_text), "doc_id", "item_id")


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, told by id and text."""
    bad = _found(docs, bench, id_col, text_col, item_col, item_text).select(
        F.col("doc_id").alias("__bad"), F.col(_HASH).alias("__text")).distinct()
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col("__bad"))
                     & (F.xxhash64(text_col) == F.col("__text")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the documents that leak benchmark items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
