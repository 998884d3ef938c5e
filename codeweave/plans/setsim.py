"""Exact Jaccard set-similarity self-join by prefix filtering.

AllPairs / PPJoin (Bayardo et al. 2007; Xiao et al. 2008): order every
token set by global token frequency (rarest first). Two sets with
Jaccard >= t share a token among the first ``n - need + 1`` tokens of each
("prefix"), so the sets that meet under a prefix token hold every qualifying
pair. The larger set of a pair probes with ``need = ceil(t*n)``, the smaller
one only lies there with the overlap that sets of the probe's length class
ask for, so its prefix is shorter. A length filter, a positional filter and
parity bits of all tokens (about one bit a token) prune the pairs where they
meet; only pairs that pass are written, and verified on the whole sets.

A set's prefix is dealt to ``GROUPS`` or more groups by token hash, and a
(group, length class) is one task's work: a row holds a set's parity bits once
for all its prefix tokens of the group. The tokens of a row are told apart by
64-bit hashes, as everywhere here (the chance that two of a pair's n tokens
share one is below n*n / 2^64). The frequency order needs no join of tokens:
it goes by the counts of 2^18 hash buckets (rarer bucket first, then hash),
an order that holds for all sets alike, which is all that the filter asks for.

Identical token sets are collapsed first: every distinct set is one
*representative* (the smallest id holding it), so a corpus where a third
of the documents are copies of one text has one row for all of them, and
no pairs are generated among copies. Results are therefore reported
between representatives, plus a member table mapping each id to its
representative. Sets that occur once need no shuffle for that: a table of
marked hash slots tells them from the others.

Thresholds are compared in integers (``t = num/den``) so a pair exactly
at the threshold is never lost to float rounding.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

COPY_SLOTS = 32
HEAD = 64               # words of parity bits at the head of a row, at most
GROUPS = 8              # token groups up to GROUP_TOKENS tokens in all
GROUP_TOKENS = 1 << 28
MARKS = 1 << 18         # hash slots of ``_marked``
BUCKETS = 1 << 18       # hash buckets whose counts order the tokens
TASK_TOKENS = 1 << 19   # tokens put into rows at once
TASK_PAIRS = 1 << 20    # pairs looked at at once
SLICE_TOKENS = 1 << 20  # tokens of a (group, class) that meet at once
POS_BITS = 20           # of a token in a row; the others are its hash
TOKEN_PATTERN = r"[\p{L}]+"
ROW = ("g int, cls long, own boolean, key boolean, rep long, n long, sig binary, toks binary")
PAIR = "rep_a long, rep_b long"


def letter_tokens(text: Column) -> Column:
    """Distinct lower-cased letter runs, sorted (array<string>)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text),
                                                              F.lit(TOKEN_PATTERN), 0)))


def _set_key(toks: Column) -> Column:
    """SHA-256 of a token set (letters only, so the joined form is unique)."""
    return F.unhex(F.sha2(F.array_join(toks, " "), 256))


def _fraction(t: float) -> tuple[int, int]:
    if not 0 < t <= 1:
        raise ValueError("threshold must be in (0, 1]")
    f = Fraction(str(t)).limit_denominator(1_000_000)
    return f.numerator, f.denominator


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder. A column of token hashes
    takes the bits of its dictionary there, not 64 a token."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/sets-{uuid.uuid4().hex}"
    df.write.option("parquet.dictionary.page.size", str(8 << 20)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _slot(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(MARKS)).cast("int")


def _marked(keys: DataFrame, c: str) -> Column:
    """Whether column ``c`` may be among ``keys``: surely not if False. The
    keys' slots go through the driver, ``MARKS`` at most."""
    spark = keys.sparkSession
    table = np.zeros(MARKS, np.uint8)
    table[keys.select(_slot(keys.columns[0]).alias("s")).distinct().toArrow()["s"].to_numpy()] = 1
    held = spark.createDataFrame(pa.table({"marks": [table.tobytes()]}))
    return F.substring(held.scalar(), _slot(c) + 1, 1) == F.lit(bytearray(b"\x01"))


@dataclass
class SimilarSets:
    members: DataFrame   # (id, rep, n_tokens)
    pairs: DataFrame     # (rep_a, rep_b, score) rep_a < rep_b, between distinct sets


# ------------------------------------------------------- inside the tasks

@dataclass
class _Lengths:
    """What lengths allow at Jaccard >= num/den, on arrays of lengths.

    Length classes are geometric buckets of ratio den/num (exact lengths at
    1). A set of length n is at most n * den / num when it is the smaller of
    a pair, which spans its own class and the next. Classes are monotone in
    n, so no admissible pair is missed."""

    num: int
    den: int

    @property
    def ratio(self) -> float:
        return math.log(self.den / self.num)

    def cls(self, n):
        return n if self.num == self.den else np.floor(np.log(n) / self.ratio).astype(np.int64)

    def least(self, cls):
        """No length of the class is below this."""
        return cls if self.num == self.den else \
            np.floor(np.exp(cls * self.ratio)).astype(np.int64) - 1

    def longest(self, n):
        return n * self.den // self.num

    def overlap(self, n, m):
        """Tokens in common that sets of these lengths need."""
        return -(-(n + m) * self.num // (self.num + self.den))

    def probe(self, n):
        """Prefix of the larger set of a pair."""
        return n - -(-n * self.num // self.den) + 1

    def laid(self, n, m):
        """Prefix of the smaller set, where the larger has ``m`` tokens or more."""
        return n - self.overlap(n, np.clip(m, n, self.longest(n))) + 1

    def words(self, cls):
        """Words of parity bits of a class: a bit a token, more where a pair
        may differ so much that fewer bits would tell nothing."""
        top = cls if self.num == self.den else np.exp((cls + 1) * self.ratio)
        bits = max(1, -(-4 * (self.den - self.num) // (self.den + self.num)))
        return np.minimum(np.maximum(np.ceil(top * bits / 64).astype(np.int64), 1), HEAD)


def _parity(v: np.ndarray, row: np.ndarray, words: np.ndarray) -> pa.Array:
    """Each row's parity bits: how many of its tokens hash to each, modulo 2."""
    bits = words * 64
    at = np.cumsum(bits) - bits
    if not bits.sum():
        return pa.array([b""] * len(words), pa.binary())
    mixed = (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
    spot = at[row] + (mixed % np.maximum(bits, 1)[row].astype(np.uint64)).astype(np.int64)
    odd = np.bincount(spot, minlength=int(bits.sum())) & 1
    ends = np.concatenate([[0], np.cumsum(words * 8)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(words), [
        None, pa.py_buffer(ends.tobytes()),
        pa.py_buffer(np.packbits(odd.astype(np.uint8)).tobytes())])


def _rows(rare: np.ndarray, groups: int, lengths: _Lengths):
    """The rows (see ROW) of sets (rep, n, key, hs)."""
    def rows(reps, n, keys, v) -> Iterator[pa.RecordBatch]:
        row = np.repeat(np.arange(len(n)), n)
        v = v[np.lexsort((v, rare[(v & np.uint64(BUCKETS - 1)).astype(np.int64)], row))]
        pos = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n) + 1
        cls, last = lengths.cls(n), lengths.cls(lengths.longest(n))
        short = np.uint64(POS_BITS)
        packed = ((v >> short) << short) | np.minimum(pos, (1 << POS_BITS) - 1).astype(np.uint64)
        group = ((v >> short) % np.uint64(groups)).astype(np.int64)
        for step in range(int((last - cls).max()) + 1):     # its own class, and those above
            k = cls + step
            upto = lengths.probe(n) if step == 0 else np.where(
                k <= last, lengths.laid(n, lengths.least(k)), 0)
            some = np.flatnonzero(pos <= upto[row])
            some = some[np.lexsort((group[some], row[some]))]
            if not len(some):
                continue
            new = np.ones(len(some), bool)
            new[1:] = (np.diff(row[some]) != 0) | (np.diff(group[some]) != 0)
            begin = np.flatnonzero(new)
            of = row[some[begin]]
            ends = np.append(begin, len(some)).astype(np.int32) * 8
            yield pa.RecordBatch.from_arrays([
                pa.array(group[some[begin]], pa.int32()), pa.array(k[of], pa.int64()),
                pa.array(np.full(len(of), step == 0)), pa.array(keys[of]), pa.array(reps[of]),
                pa.array(n[of], pa.int64()), _parity(v, row, lengths.words(k)).take(pa.array(of)),
                pa.BinaryArray.from_buffers(pa.binary(), len(of), [
                    None, pa.py_buffer(ends.astype(np.int32).tobytes()),
                    pa.py_buffer(packed[some].tobytes())])],
                names=["g", "cls", "own", "key", "rep", "n", "sig", "toks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                       for c in ("rep", "n"))
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(bool)
            v = batch.column("hs").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            ends, i = np.cumsum(n), 0
            while i < len(n):
                start = int(ends[i] - n[i])
                j = max(i + 1, int(np.searchsorted(ends, start + TASK_TOKENS, "right")))
                yield from rows(reps[i:j], n[i:j], keys[i:j],
                                v[start:int(ends[j - 1])].view(np.uint64))
                i = j
    return run


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    """All bytes of a binary column as numbers, without an object per row."""
    parts = []
    for chunk in table[name].chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
        if len(chunk) and ends[-1] > ends[0]:
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0]:ends[-1]])
    joined = parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint8), *parts])
    return joined.view(kind)


def _sizes(table: pa.Table, name: str) -> np.ndarray:
    """The bytes of each value of a binary column."""
    return pa.compute.binary_length(table[name]).to_numpy().astype(np.int64)


def _near(table: pa.Table, lengths: _Lengths, keyed: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of a (group, class) that pass the filters, in batches of
    ``TASK_PAIRS`` or more; a pair may come in two of them. The tokens meet slice
    by slice (a slice holds some hashes), so that what a task holds beside the
    rows themselves does not grow with them."""
    rep, n = (table[c].to_numpy().astype(np.int64) for c in ("rep", "n"))
    own, key = (table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("own", "key"))
    ends = np.cumsum(_sizes(table, "toks") // 8)
    width = len(table["sig"][0].as_py()) // 8
    sig = _column(table, "sig", np.uint64).reshape(len(n), width)
    held = _column(table, "toks", np.uint64)
    slices = max(1, -(-len(held) // SLICE_TOKENS))

    def of_slice(s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row and position of the slice's tokens."""
        some = [np.zeros(0, np.int64)]
        for at in range(0, len(held), SLICE_TOKENS):
            part = held[at:at + SLICE_TOKENS] >> np.uint64(POS_BITS)
            # Not the lowest bits, which tell the groups apart.
            some.append(at + np.flatnonzero((part >> np.uint64(22)) % np.uint64(slices) == s))
        some = np.concatenate(some)
        row = np.searchsorted(ends, some, "right")
        return (held[some] >> np.uint64(POS_BITS), row,
                (held[some] & np.uint64((1 << POS_BITS) - 1)).astype(np.int64))

    def meet(tok, row, pos, xs: np.ndarray, ys: np.ndarray) -> Iterator[np.ndarray]:
        ys = ys[np.argsort(tok[ys], kind="stable")]
        lo = np.searchsorted(tok[ys], tok[xs], "left")
        count = np.searchsorted(tok[ys], tok[xs], "right") - lo
        xs, lo, count = xs[count > 0], lo[count > 0], count[count > 0]
        ends, a = np.cumsum(count), 0
        while a < len(xs):
            done = int(ends[a] - count[a])
            b = max(a + 1, int(np.searchsorted(ends, done + TASK_PAIRS, "right")))
            c = count[a:b]
            x = np.repeat(xs[a:b], c)
            y = ys[np.repeat(lo[a:b] - (ends[a:b] - c), c) + done + np.arange(int(c.sum()))]
            a, i, j = b, row[x], row[y]
            ok = (n[j] < n[i]) | ((n[j] == n[i]) & (rep[j] < rep[i]))
            ok &= n[j] * lengths.den >= n[i] * lengths.num
            # the rest of both sets after this token can still supply the overlap
            need = lengths.overlap(n[i], n[j])
            ok &= 1 + np.minimum(n[i] - pos[x], n[j] - pos[y]) >= need
            met = np.unique(i[ok] * len(n) + j[ok])
            # parity bits differ in no more than the tokens of one set only
            for at in range(0, len(met), 1 << 14):
                i, j = np.divmod(met[at:at + (1 << 14)], len(n))
                apart = np.bitwise_count(sig[i] ^ sig[j]).sum(axis=1, dtype=np.int64)
                near = apart <= n[i] + n[j] - 2 * lengths.overlap(n[i], n[j])
                yield met[at:at + (1 << 14)][near]

    def batch(met: np.ndarray) -> pa.RecordBatch:
        i, j = np.divmod(met, len(n))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])),
                                           pa.array(np.maximum(rep[i], rep[j]))],
                                          names=["rep_a", "rep_b"])
    found, size = [np.zeros(0, np.int64)], 0
    for s in range(slices):
        tok, row, pos = of_slice(s)
        probes = np.flatnonzero(own[row])
        laid = np.flatnonzero(~own[row] | (pos <= lengths.laid(n, n)[row]))
        sides = [(probes, laid)]
        if keyed:
            sides = [(probes[key[row[probes]]], laid),
                     (probes[~key[row[probes]]], laid[key[row[laid]]])]
        for xs, ys in sides:
            for met in meet(tok, row, pos, xs, ys):
                found.append(met)
                size += len(met)
                if size > 4 * TASK_PAIRS:
                    found = [np.unique(np.concatenate(found))]
                    size = len(found[0])
                    if size > 2 * TASK_PAIRS:
                        yield batch(found[0])
                        found, size = [found[0][:0]], 0
    yield batch(np.unique(np.concatenate(found)))


def _met(lengths: _Lengths, keyed: bool):
    """The pairs of a (group, class) as one table."""
    return lambda table: pa.Table.from_batches(list(_near(table, lengths, keyed)))


def _met_batches(lengths: _Lengths, keyed: bool):
    """The pairs of a (group, class), passed on as they are found."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _near(pa.Table.from_batches(list(rows)), lengths, keyed)
    return run


def similar_sets(corpus: DataFrame, threshold: float, id_col: str = "id",
                 text_col: str = "text", materialize: bool = True,
                 keys: DataFrame | None = None) -> SimilarSets:
    """Members and qualifying pairs. With ``materialize`` (default) both
    are checkpointed once, since every consumer reads them several times
    (top-k, components, group means). ``keys`` (a frame with an ``id``
    column) keeps the pairs that touch the set of one of these ids; only
    those sets then probe the others."""
    num, den = _fraction(threshold)
    lengths = _Lengths(num, den)
    base = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Tokenising is CPU-bound per row; the splits of a few files are few and
    # uneven, so their rows are spread by id first.
    if 2 * len(corpus.inputFiles()) < corpus.sparkSession.sparkContext.defaultParallelism:
        base = base.repartition("id")
    # The filter looks for one letter; on the tokens it would cut them twice.
    toks = (base.filter(F.lower("text").rlike(TOKEN_PATTERN))
            .select("id", letter_tokens(F.col("text")).alias("toks"))
            .select("id", _set_key(F.col("toks")).alias("h"),
                    F.size("toks").cast("long").alias("n"),
                    F.transform("toks", lambda t: F.xxhash64(t)).alias("hs")))
    toks = _kept(toks)
    # One representative per distinct token set.
    reps = _kept(toks.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")))
    # Members meet their representative by key, without the tokens. The
    # copies of a hot text are spread over COPY_SLOTS join keys; the slots in
    # use fetch the representative first.
    slotted = toks.select("id", "h", F.col("n").cast("int").alias("n_tokens"),
                          F.pmod(F.xxhash64("id"), F.lit(COPY_SLOTS)).alias("slot"))
    slots = slotted.select("h", "slot").distinct().join(reps.select("h", "rep"), "h")
    members = slotted.join(slots, ["h", "slot"]).select("id", "rep", "n_tokens")
    if materialize:
        members = cut_lineage(members)
    # The distinct sets: those that occur once stay where they are.
    copied = _marked(reps.filter("rows > 1").select("h"), "h")
    merged = _kept(toks.filter(copied).groupBy("h").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("hs").alias("hs")))
    sets = (toks.filter(~copied).select(F.col("id").alias("rep"), "n", "hs")
            .unionByName(merged.select("rep", "n", "hs")).filter(F.col("rep").isNotNull()))
    counts = (sets.select(F.explode("hs").alias("t"))
              .groupBy(F.col("t").bitwiseAND(F.lit(BUCKETS - 1)).alias("b"))
              .agg(F.count(F.lit(1)).alias("c")).toArrow())
    rare = np.zeros(BUCKETS, np.uint8)
    sizes = counts["c"].to_numpy()
    rare[counts["b"].to_numpy()] = np.minimum(8 * np.log2(np.maximum(sizes, 1)), 255)
    # A group's rows grow with the root of the tokens beyond GROUP_TOKENS.
    over = max(1.0, float(sizes.sum()) / GROUP_TOKENS)
    groups = GROUPS * 2 ** math.ceil(math.log(over, 4))
    probing = sets.withColumn("key", F.lit(False))
    if keys is not None:
        probe = members.join(keys.select("id").distinct(), "id", "left_semi").select(
            "rep").distinct().withColumn("key", F.lit(True))
        probing = sets.join(probe, "rep", "left").withColumn(
            "key", F.coalesce("key", F.lit(False)))
    cand = _kept(probing.select("rep", "n", "key", "hs")
                 .mapInArrow(_rows(rare, groups, lengths), ROW).groupBy("g", "cls")
                 .applyInArrow(_met_batches(lengths, keys is not None), PAIR).distinct())
    # Only sets of candidate pairs are shuffled for the verification.
    used = _marked(cand.select("rep_a").union(cand.select("rep_b")), "rep")
    whole = sets.filter(used).select("rep", "hs")
    ta = whole.select(F.col("rep").alias("rep_a"), F.col("hs").alias("ta"))
    tb = whole.select(F.col("rep").alias("rep_b"), F.col("hs").alias("tb"))
    inter = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - inter
    pairs = (cand.join(ta, "rep_a").join(tb, "rep_b")
             .select("rep_a", "rep_b", inter.alias("inter"), union.alias("uni"))
             .filter(F.col("inter") * den >= F.col("uni") * num)
             .select("rep_a", "rep_b",
                     F.round(F.col("inter") / F.col("uni"), 6).alias("score")))
    if materialize:
        pairs = cut_lineage(pairs)
    return SimilarSets(members, pairs)
