"""Token-ID output in a word-aligned binary format (Simple-8b).

Every 64-bit word holds a 4-bit selector and 60 payload bits; the selector
says how many ids of which width follow (``SELECTORS``). Selector 1 is the
escape: the next word is one raw 64-bit value. Ids are coded in blocks of
BLOCK, each starting on its own word, and the file carries per-block word
counts, so blocks decode independently and whole arrays at a time.

File layout (little endian): MAGIC, the words, block word counts (u4), ids
per document (i8), document ids (i8), their null flags (u1), a JSON footer,
its length (u4), MAGIC.

Documents are range-partitioned by doc_id (nulls first; ties by a hash of
the text), each task tokenises and writes the files of its range, rolling at
FILE_IDS ids. A task attempt writes names of its own and reports them in the
manifest that Spark commits; files of lost attempts are never named there,
and readers go by the manifest.

Defined cases: null text is empty; every document ends with id 0; repeated
rows are written once each; an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (SPACE, U, batch_rows, make_dir, pieces, running_total, shared_uri, span_hashes,
                     text_buffers, work_dir, written)

QUERY = "op1_simple8b_tokens"
ORACLE_SQL = None       # needs the tokenizer

MAGIC = b"TOKS8B01"
# (ids per word, bits per id) by selector; selector 1 is the escape.
SELECTORS = ((240, 0), (1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
             (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 1
BLOCK = 1024
STRIDE = 1 << 18        # ids coded or decoded at once (a multiple of BLOCK)
FILE_IDS = 1 << 26
SLOT_BITS = 21          # the memo: 2M pieces
SLOTS = 1 << SLOT_BITS
POOL_IDS = 1 << 23      # their ids
RUN = 2000              # unknown pieces encoded in one call
TEXT_BYTES = 1 << 18    # text encoded at once
BATCH_ROWS = 1000       # texts a task is sent at once
END_ID = 0
_END = np.array([END_ID], dtype=np.uint32)

MANIFEST = "part long, seq long, file string, n_docs long, n_ids long"
REPORT = "doc_id long, start long, n_tokens long, ids_crc32 long"

# Selectors by growing width, the escape last.
_ORDER = [0, *range(2, 16), ESCAPE]
_LIMITS = np.array([(1 << SELECTORS[s][1]) - 1 for s in _ORDER[:-1]], dtype=np.uint64)
_COUNT = np.array([SELECTORS[s][0] for s in _ORDER], dtype=np.int64)
_NEAR = 8               # ids looked at directly; longer words come from runs
_NEAR_CLASS = _COUNT.tolist().index(_NEAR)
# Widest class that still fits j ids in one word, for j = 1.._NEAR.
_CLASS_FOR = [max(k for k in range(len(_ORDER) - 1) if _COUNT[k] >= j) for j in range(1, _NEAR + 1)]
_CLASS_OF_16 = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64)).astype(np.int8)


# ------------------------------------------------------------------ coding

def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words per block) of unsigned ids."""
    words, counts = [], []
    for lo in range(0, len(ids), STRIDE):
        w, c = _encode_stride(ids[lo:lo + STRIDE].astype(np.uint64))
        words.append(w)
        counts.append(c)
    z = np.zeros(0, np.uint64)
    return (np.concatenate(words) if words else z,
            np.concatenate(counts) if counts else z.astype(np.int64))


def _classes(v: np.ndarray) -> np.ndarray:
    """Index in _ORDER of the narrowest selector that holds each id."""
    if len(v) and v.max() >= 1 << 16:
        return np.searchsorted(_LIMITS, v).astype(np.int8)
    return _CLASS_OF_16[v.astype(np.int64)]


def _long_runs(cls: np.ndarray) -> list[np.ndarray] | None:
    """For each class of more than _NEAR ids a word: the first position at
    or after each that the class cannot hold; None where no run is long
    enough for any."""
    n = len(cls)
    idx = np.arange(n, dtype=np.int32)

    def reach(k):
        stop = np.where(cls > k, idx, np.int32(n))
        return np.minimum.accumulate(stop[::-1])[::-1]
    widest = reach(_NEAR_CLASS - 1)
    if not (widest - idx > _NEAR).any():
        return None
    return [reach(k) for k in range(_NEAR_CLASS - 1)] + [widest]


def _encode_stride(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(v)
    cls = np.concatenate([_classes(v), np.zeros(_NEAR, np.int8)])
    runs = _long_runs(cls[:n])
    at = np.arange(0, n, BLOCK, dtype=np.int64)
    end = np.minimum(at + BLOCK, n)
    pos, sel = [], []
    while len(at):       # every block takes its next word
        left = end - at
        top = cls[at]
        k = np.maximum(top, _CLASS_FOR[0])
        for j in range(1, _NEAR):
            # Past the block's end any id fits: the word stays part empty.
            top = np.maximum(top, np.where(left > j, cls[at + j], 0))
            k = np.where(top <= _CLASS_FOR[j], _CLASS_FOR[j], k)
        if runs is not None:
            for c in range(_NEAR_CLASS - 1, -1, -1):
                k = np.where(runs[c][at] >= np.minimum(at + _COUNT[c], end), c, k)
        pos.append(at)
        sel.append(k)
        at = at + _COUNT[k]
        live = at < end
        at, end = at[live], end[live]
    pos, sel = np.concatenate(pos), np.concatenate(sel)
    order = np.argsort(pos, kind="stable")
    pos, sel = pos[order], sel[order]
    width = 1 + (sel == len(_ORDER) - 1)     # an escape takes two words
    place = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), dtype=np.uint64)
    ends = np.minimum((pos // BLOCK + 1) * BLOCK, n)
    padded = np.concatenate([v, np.zeros(SELECTORS[0][0], np.uint64)])
    for k in np.unique(sel):
        s = _ORDER[k]
        m = np.flatnonzero(sel == k)
        if s == ESCAPE:
            out[place[m]] = U(ESCAPE << 60)
            out[place[m] + 1] = v[pos[m]]
            continue
        count, bits = SELECTORS[s]
        w = np.full(len(m), U(s << 60), dtype=np.uint64)
        p = pos[m]
        short = np.flatnonzero(p + count > ends[m])     # the last word of its block
        for j in range(count if bits else 0):
            x = padded[p + j]
            x[short[p[short] + j >= ends[m[short]]]] = 0
            w |= x << U(j * bits)
        out[place[m]] = w
    return out, np.bincount(pos // BLOCK, weights=width, minlength=-(-n // BLOCK)).astype(np.int64)


def decode(words: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ids of whole blocks: ``counts`` words per block, ``n`` ids in all."""
    if n == 0:
        return np.zeros(0, np.uint64)
    sel = (words >> U(60)).astype(np.int64)
    real = np.ones(len(words), dtype=bool)
    last = -2
    for i in np.flatnonzero(sel == ESCAPE).tolist():     # a raw word is no selector
        if last != i - 1:
            real[i + 1] = False
            last = i
    block = np.repeat(np.arange(len(counts)), counts)[real]
    at = np.flatnonzero(real)
    sel = sel[at]
    per = np.array([c for c, _ in SELECTORS], dtype=np.int64)[sel]
    run = np.cumsum(per) - per
    first = np.searchsorted(block, np.arange(len(counts)))
    start = run - run[first][block] + block * BLOCK
    out = np.zeros(n, dtype=np.uint64)
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(sel):
        m = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[start[m]] = words[at[m] + 1]
            continue
        count, bits = SELECTORS[s]
        if not bits:
            continue
        w, mask, p = words[at[m]], U((1 << bits) - 1), start[m]
        whole = p + count <= stop[m]
        for j in range(count):
            x = (w >> U(j * bits)) & mask
            q = p + j
            if not whole.all():
                keep = whole | (q < stop[m])
                q, x = q[keep], x[keep]
            out[q] = x
    return out


# ------------------------------------------------------------- tokenising

_MAYBE_WS_NEXT = SPACE.copy()      # ASCII space, or a lead byte of other white space
_MAYBE_WS_NEXT[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_MAYBE_WS_PREV = SPACE.copy()
_MAYBE_WS_PREV[0x1C:0x20] = True
_MAYBE_WS_PREV[0x80:] = True
_ALNUM = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _ALNUM[_lo:_hi] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[list(b".,")] = True


def cuts(buf: np.ndarray, offs: np.ndarray, added: re.Pattern | None = None) -> np.ndarray:
    """Places where the byte-level pre-tokeniser surely starts a piece, the
    start of every non-empty text included: before a space unless white
    space stands on both sides, before . or , after a letter or digit,
    before a line feed after a visible character, and after a single one.
    White space before a match of ``added`` (the added tokens) ends there as
    at a text's end, so its last character is no start, nor is the match."""
    n = len(buf)
    begin = offs[:-1][offs[:-1] < offs[1:]]
    end = offs[1:][offs[:-1] < offs[1:]] - 1
    prev = np.empty(n, np.uint8)
    prev[1:] = buf[:-1]
    prev[begin] = 0x61
    nxt = np.empty(n, np.uint8)
    nxt[:-1] = buf[1:]
    nxt[end] = 0x20
    before = np.empty(n, np.uint8)
    before[2:] = buf[:-2]
    before[:2] = 0x61
    before[begin] = 0x61
    second = begin + 1
    before[second[second < n]] = 0x61
    shut = _MAYBE_WS_PREV[prev]
    cut = (buf == 0x20) & ~(shut & _MAYBE_WS_NEXT[nxt])
    cut |= _POINT[buf] & _ALNUM[prev]
    line = buf == 0x0A
    cut |= line & ~shut
    cut |= (prev == 0x0A) & ~_MAYBE_WS_PREV[before] & ~_MAYBE_WS_PREV[buf]
    if added:
        for m in added.finditer(buf):
            cut[max(0, m.start() - 1):m.end()] = False
    cut[begin] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Whole-text encoding with a bounded memo of pieces.

    A text's ids are those of its pieces between ``cuts``. Pieces are told
    apart by a 64-bit hash; a direct-mapped table of SLOTS entries remembers
    their ids, a collision replaces the older piece. Memory is bounded by
    SLOTS and POOL_IDS."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # tasks are the parallelism
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True)))
                                .encode()) if marks else None
        # Ids whose piece starts with the (byte-level form of) a space: in a
        # run of space-led pieces they open one each.
        vocab = self.tok.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.opens[[i for w, i in vocab.items() if w.startswith("\u0120")]] = True
        self._reset()

    def _reset(self) -> None:
        self.key = np.zeros(SLOTS, dtype=np.uint64)
        self.at = np.zeros(SLOTS, dtype=np.int32)
        self.len = np.zeros(SLOTS, dtype=np.int32)
        self.pool = np.zeros(POOL_IDS, dtype=np.uint32)
        self.used = 0

    def _ids(self, texts: list[str]) -> np.ndarray:
        e = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in e]

    def _coded(self, pieces_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece) of unknown pieces, many in one call."""
        runs, alone = [], []
        for k, p in enumerate(pieces_):
            # A line feed, a second space or an added token inside keeps a
            # piece out of runs.
            (runs if p[0] == " " and len(p) > 1 and not p[1].isspace()
             and not p[-1].isspace() and " " not in p[1:]
             and not (self.added and self.added.search(p.encode())) else alone).append(k)
        parts: list[np.ndarray | None] = [None] * len(pieces_)
        for lo in range(0, len(runs), RUN):
            some = runs[lo:lo + RUN]
            ids = self._ids(["".join(pieces_[k] for k in some)])[0]
            first = np.flatnonzero(self.opens[ids])
            if len(first) != len(some):
                alone += some
                continue
            for k, part in zip(some, np.split(ids, first[1:]), strict=True):
                parts[k] = part
        for k, part in zip(alone, self._ids([pieces_[k] for k in alone]), strict=True):
            parts[k] = part
        return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int32)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids per text) for ``data[offs...]``."""
        lo = int(offs[0])
        buf, offs = data[lo:int(offs[-1])], offs - lo
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        start = cuts(buf, offs, self.added)
        h = span_hashes(buf, start, np.append(start[1:], len(buf)))
        slot = (h >> U(64 - SLOT_BITS)).astype(np.int64)
        at, count = self.at[slot], self.len[slot]
        miss = np.flatnonzero((self.key[slot] != h) | (count == 0))
        pool = self.pool
        if len(miss):
            keys, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            stop = np.append(start[1:], len(buf))
            raw = buf.tobytes()
            ids, lens = self._coded([raw[start[m]:stop[m]].decode("utf-8", "replace")
                                     for m in miss[first]])
            where = (np.cumsum(lens) - lens).astype(np.int32)
            if self.used + len(ids) > POOL_IDS:
                old = pool
                self._reset()
                if len(ids) > POOL_IDS:          # more than the memo may hold
                    pool = np.concatenate([old, ids])
                    at[miss], count[miss] = where[back] + len(old), lens[back]
                    return self._laid(pool, at, count, start, offs)
                pool = np.concatenate([old, ids])
                at[miss], count[miss] = where[back] + len(old), lens[back]
            else:
                at[miss], count[miss] = where[back] + self.used, lens[back]
            self.pool[self.used:self.used + len(ids)] = ids
            s = (keys >> U(64 - SLOT_BITS)).astype(np.int64)
            self.key[s], self.at[s], self.len[s] = keys, where + self.used, lens
            self.used += len(ids)
        return self._laid(pool, at, count, start, offs)

    @staticmethod
    def _laid(pool, at, count, start, offs) -> tuple[np.ndarray, np.ndarray]:
        total = np.cumsum(count, dtype=np.int64)
        begin = total - count
        take = np.repeat(at - begin, count) + np.arange(total[-1])
        upto = np.concatenate([[0], total])[np.searchsorted(start, offs)]
        return pool[take], np.diff(upto)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


# ------------------------------------------------------------------- files

class _File:
    def __init__(self, folder: str, part: int, seq: int):
        from pyarrow import fs
        self.fs, root = fs.FileSystem.from_uri(folder)
        self.name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:12]}.s8b"
        self.out = self.fs.open_output_stream(f"{root}/{self.name}")
        self.out.write(MAGIC)
        self.part, self.seq = part, seq
        self.pend: list[np.ndarray] = []
        self.held = self.n_ids = self.n_words = 0
        self.counts: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) + 1)
        self.pend += [ids, _END]
        self.held += len(ids) + 1
        self.n_ids += len(ids) + 1
        if self.held >= STRIDE:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pend) if self.pend else np.zeros(0, "<u4")
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        words, counts = encode(ids[:cut])
        self.out.write(words.astype("<u8").tobytes())
        self.n_words += len(words)
        self.counts.append(counts)
        self.pend, self.held = [ids[cut:]], len(ids) - cut

    def close(self) -> tuple:
        self._flush(True)
        counts = np.concatenate(self.counts)
        sections = [counts.astype("<u4"), np.array(self.sizes, "<i8"),
                    np.array([d or 0 for d in self.docs], "<i8"),
                    np.array([d is None for d in self.docs], "u1")]
        at, foot = len(MAGIC) + self.n_words * 8, {"n_words": self.n_words, "n_ids": self.n_ids,
                                                   "block": BLOCK, "sections": []}
        for s in sections:
            b = s.tobytes()
            self.out.write(b)
            foot["sections"].append([at, len(b)])
            at += len(b)
        j = json.dumps(foot).encode()
        self.out.write(j + np.array([len(j)], "<u4").tobytes() + MAGIC)
        self.out.close()
        return self.part, self.seq, self.name, len(self.docs), self.n_ids


def _writer(folder: str, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq, rows = TaskContext.get().partitionId(), 0, []
        enc, f = encoder(path), None
        for batch in batches:
            docs = batch.column(0).to_pylist()
            data, offs = text_buffers(batch.column(1))
            for i, j in pieces(data, offs, TEXT_BYTES):
                ids, counts = enc.encode(data, offs[i:j + 1])
                stop = np.cumsum(counts).tolist()
                for d, a, b in zip(docs[i:j], [0, *stop], stop, strict=False):
                    f = f or _File(folder, part, seq)
                    f.add(d, ids[a:b])
                    if f.n_ids >= FILE_IDS:
                        rows.append(f.close())
                        f, seq = None, seq + 1
        if f:
            rows.append(f.close())
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols],
                                             names=["part", "seq", "file", "n_docs", "n_ids"])
    return run


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Encode ``docs`` into token files below ``folder``; returns the
    committed manifest (also written at ``folder``/manifest)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                      F.xxhash64(text_col).alias("tie"))
    make_dir(docs.sparkSession, f"{folder}/data")
    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = src.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        return written(ranged.mapInArrow(_writer(f"{folder}/data", path or tokenizer_path()),
                                         MANIFEST), f"{folder}/manifest")


class TokenFile:
    """Reader of one file: index first, then ids stride by stride."""

    def __init__(self, path: str):
        from pyarrow import fs
        f, p = fs.FileSystem.from_uri(path)
        self.f = f.open_input_file(p)
        size = self.f.size()
        tail = self.f.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        n = int(np.frombuffer(tail[:4], "<u4")[0])
        self.foot = json.loads(self.f.read_at(n, size - 12 - n))
        part = [self.f.read_at(b, a) for a, b in self.foot["sections"]]
        self.counts = np.frombuffer(part[0], "<u4").astype(np.int64)
        self.sizes = np.frombuffer(part[1], "<i8")
        docs, null = np.frombuffer(part[2], "<i8"), np.frombuffer(part[3], "u1")
        self.docs = [None if z else d for d, z in zip(docs.tolist(), null.tolist(), strict=True)]

    def ids(self) -> Iterator[np.ndarray]:
        n, at, per = self.foot["n_ids"], len(MAGIC), STRIDE // BLOCK
        for lo in range(0, len(self.counts), per):
            c = self.counts[lo:lo + per]
            b = self.f.read_at(int(c.sum()) * 8, at)
            at += len(b)
            yield decode(np.frombuffer(b, "<u8"), c, min(n - lo * BLOCK, len(c) * BLOCK))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id's place in the file, ids) in file order."""
        held, start = np.zeros(0, "<u4"), 0
        more = self.ids()
        for d, n in zip(self.docs, self.sizes.tolist(), strict=True):
            if len(held) < n:
                parts, have = [held], len(held)
                while have < n:
                    parts.append(next(more).astype("<u4"))
                    have += len(parts[-1])
                held = np.concatenate(parts)
            yield d, start, held[:n]
            held, start = held[n:], start + n


def _reporter(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                  strict=True):
                f = TokenFile(f"{folder}/{name}")
                starts, crcs = [], []
                for _, start, ids in f.documents():
                    starts.append(base + start)
                    crcs.append(zlib.crc32(np.ascontiguousarray(ids)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.docs, pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(f.sizes.astype(np.int64)), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_report(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files named in ``manifest``: doc_id, start,
    n_tokens, ids_crc32."""
    files = manifest.count()
    based = running_total(manifest, ["part", "seq"], "n_ids", "base", f"{folder}/bases")
    return (based.select("file", "base").repartition(max(1, min(files, 20_000)))
            .mapInArrow(_reporter(f"{folder}/data"), REPORT))


def tokens_report(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    folder = shared_uri(work_dir(docs.sparkSession, "tokens"))
    return read_report(write_tokens(docs, folder, path, **kw), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's ids, as read back from the token files."""
    return tokens_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
