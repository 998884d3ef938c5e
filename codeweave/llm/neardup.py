"""Near-duplicate groups by one-permutation MinHash.

A document's set holds its distinct word 5-shingles (words: runs of other
than space and \\t-\\r, A-Z lowered; shorter texts are one shingle). Two
documents are linked when ``100 * |A & B| >= percent * |A | B|``.

1. Sketch: one 64-bit hash per shingle; its top bits choose one of 192 bins
   and each bin keeps its minimum. Empty bins borrow from a non-empty one by
   optimal densification (a hash sequence per bin, tried in order).
2. Documents with equal sets form one class (128-bit set hash and size),
   named by one of its rows; everything later works on classes, so copies
   never form pairs and colliding hashes never join two classes.
3. Bands of bins give bucket keys: the longest bands under which a pair at
   the threshold shares no bucket with probability below MISS (6 bins at 85
   percent, 4 at 80). Each bucket emits a star: its centre
   paired with every member, never all pairs.
4. Every candidate pair is confirmed on the full sets (exact integers).
   The centre is the class with most collisions over all its buckets.
5. Exactness beyond the star: classes of buckets that still hold several
   components meet once more in an exact prefix-filter join (sets at the
   threshold share one of their first shingles in any common order). Only
   pairs with an end outside its bucket's first component, of different
   components, are made and confirmed. Shingles of one component only can
   join nothing: they come first in the order and are never shuffled to the
   join, which leaves few sets with a prefix at all; a pair is made at the
   first shingle its prefixes share. So no link between classes that share a
   bucket is missed.
6. Components by contraction (``labels``).

A class or component that holds many rows (of which there are fewer than HOT)
is joined to its rows by broadcast, all others by shuffle.

Defined cases: null or blank text has an empty set, is linked to nothing and
is its own component; repeated rows fall in one class; a null doc_id never
names a component unless all ids of the component are null; an empty table
gives an empty result. Only the columns named are read, so others never
clash. Long texts are scanned in pieces. Sets are compared through 64-bit
shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, mix, text_buffers, word_hashes, work_dir, written
from .labels import contract_components

QUERY = "op2_minhash_near_dedup"
ORACLE_SQL = None       # the components need a fixpoint over all similar pairs

SHINGLE = 5
BINS = 192
MISS = 1e-6
PERCENT = 85
SALT_ROWS = 512         # members of one centre or bucket that share a join key

HOT = 10_000            # a key with over 1/HOT of all rows is joined by broadcast
HEAD = 32               # prefix shingles carried to find the first common one

SKETCH_SCHEMA = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, text_hash long"


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Distinct k-shingle hashes of a word-hash sequence, ascending."""
    n = len(words)
    if n == 0:
        return words
    m = min(n, k)
    with np.errstate(over="ignore"):
        s = np.zeros(n - m + 1, dtype=np.uint64)
        for j in range(m):
            s = s * U(0x9FB21C651E98DF25) + words[j:n - m + 1 + j]
        s += U(m)
    return np.unique(mix(s))


def _probe(rows: np.ndarray, attempt: int) -> np.ndarray:
    """Bin tried by empty bin ``rows`` at ``attempt`` (same for all texts)."""
    with np.errstate(over="ignore"):
        h = mix(rows.astype(np.uint64) * U(0xD1B54A32D192ED03) + U(attempt * 2 + 1))
    if attempt >= 4 * BINS:      # a full cycle ends the search for certain
        return (rows + attempt) % BINS
    return (h % U(BINS)).astype(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation sketches (len(sets) x BINS), densified."""
    sig = np.zeros((len(sets), BINS), dtype=np.uint64)
    full = np.zeros((len(sets), BINS), dtype=bool)
    for i, u in enumerate(sets):
        if not len(u):
            continue
        bins = ((u >> U(40)) * U(BINS) >> U(24)).astype(np.int64)
        first = np.empty(len(u), dtype=bool)     # u ascends, so bins do too
        first[0] = True
        np.not_equal(bins[1:], bins[:-1], out=first[1:])
        sig[i, bins[first]] = u[first]
        full[i, bins[first]] = True
    r, b = np.nonzero(~full & full.any(axis=1)[:, None])
    t = 1
    while len(r):
        c = _probe(b, t)
        ok = full[r, c]
        sig[r[ok], b[ok]] = sig[r[ok], c[ok]]
        r, b = r[~ok], b[~ok]
        t += 1
    return sig


def band_size(percent: int) -> int:
    """Bins a band, as many as keep the chance to miss a pair below MISS."""
    fit = [b for b in (6, 4, 3, 2) if (1 - (percent / 100) ** b) ** (BINS // b) < MISS]
    return fit[0] if fit else 1


def band_keys(sig: np.ndarray, band: int) -> np.ndarray:
    n_bands = BINS // band
    with np.errstate(over="ignore"):
        k = np.zeros((len(sig), n_bands), dtype=np.uint64)
        part = sig.reshape(len(sig), n_bands, band)
        for j in range(band):
            k = mix(k * U(0x9FB21C651E98DF25) + part[:, :, j])
        k += np.arange(n_bands, dtype=np.uint64)[None, :] * U(0x9E3779B97F4A7C15)
    return mix(k).view(np.int64)


def _set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every set, as two long columns."""
    with np.errstate(over="ignore"):
        h1 = np.array([u.sum(dtype=np.uint64) for u in sets], dtype=np.uint64)
        h2 = np.array([mix(u ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for u in sets],
                      dtype=np.uint64)
    return mix(h1).view(np.int64), h2.view(np.int64)


def _sketcher(band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                data, offs = text_buffers(part.column(1))
                sets = [shingle_hashes(w) for _, w in word_hashes(data, offs)]
                n = np.array([len(u) for u in sets], dtype=np.int64)
                h1, h2 = _set_hashes(sets)
                keys = band_keys(sketches(sets), band)
                live = n > 0
                width = keys.shape[1]
                off = np.concatenate([[0], np.cumsum(np.where(live, width, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(off, pa.array(keys[live].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(n), pa.array(h1), pa.array(h2), bands,
                     *part.columns[2:]],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands", *part.schema.names[2:]])
    return run


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, h1, h2, text) -> (node, its shingle hashes); texts of another
    class under the same id are left out."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            data, offs = text_buffers(part.column(3))
            sets = [shingle_hashes(w) for _, w in word_hashes(data, offs)]
            h1, h2 = _set_hashes(sets)
            own = (part.column(1).to_numpy() == h1) & (part.column(2).to_numpy() == h2)
            sets = [s.view(np.int64) for s, ok in zip(sets, own, strict=True) if ok]
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            vals = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).filter(pa.array(own, pa.bool_())),
                 pa.ListArray.from_arrays(off, pa.array(vals))], names=["node", "shingles"])


def _join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, whose ``weight`` counts the rows
    of each key. Keys with over 1/HOT of all rows, fewer than HOT by
    definition, are broadcast; no other key weighs on a task of the shuffle."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT > F.lit(total)
    few = F.broadcast(table.filter(hot))
    return rows.join(few, keys).unionByName(
        rows.join(F.broadcast(table.filter(hot).select(*keys)), keys, "left_anti")
        .join(table.filter(~hot), keys))


def _spread(pairs: DataFrame, key: str) -> DataFrame:
    """``pairs`` with ``salts`` and ``salt``: one join key is shared by about
    SALT_ROWS rows at most, however many rows name it."""
    deg = pairs.groupBy(key).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(SALT_ROWS)).cast("int").alias("salts"))
    hot = deg.filter("salts > 1")
    return (pairs.join(hot, key, "left")
            .withColumn("salts", F.coalesce("salts", F.lit(1)))
            .withColumn("salt", F.pmod(F.xxhash64("b", "a"), F.col("salts")).cast("int")))


def _stars(members: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) pairs a < b of each bucket's centre with its members
    whose sizes allow a link."""
    c = centres.select("key", F.col("node").alias("cn"), F.col("n").alias("cs"), "salts")
    c = c.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    m = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    return (m.join(c, ["key", "salt"])
            .filter((F.col("node") != F.col("cn"))
                    & (100 * F.least("n", "cs") >= percent * F.greatest("n", "cs")))
            .select(F.least("node", "cn").alias("a"), F.greatest("node", "cn").alias("b"))
            .distinct())


def _prefix_pairs(open_nodes: DataFrame, sets: DataFrame, percent: int, base: str) -> DataFrame:
    """All pairs (a, b) of ``open_nodes`` (node, n, comp, probe) with a probe,
    in different components, that may reach the threshold: an exact prefix
    and position filter in one order of shingles, those of one component
    first, then rare ones."""
    s = written(sets.join(open_nodes, "node").select(
        "node", "comp", "probe", F.explode("shingles").alias("shingle")), f"{base}/open-shingles")
    common = written(s.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        F.max("probe").alias("asked")).filter("lo <> hi and asked").select("shingle", "df"),
        f"{base}/common")
    kept = _join_hot(s.select("node", "shingle"), common, ["shingle"], "df").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("kept"))
    n, before = F.col("n"), F.col("n") - F.size("kept")
    length = n - F.ceil(percent * n / 100).cast("long") + 1 - before
    p = (kept.join(open_nodes, "node").withColumn("before", before)
         .withColumn("prefix", F.slice(
             F.col("kept.shingle"), 1, F.greatest(length, F.lit(0)).cast("int")))
         .withColumn("head", F.slice("prefix", 1, HEAD))
         .select("node", "n", "comp", "probe", "before", "head", F.posexplode("prefix").alias(
             "at", "shingle")).withColumn("at", F.col("before") + F.col("at")).drop("before"))
    p = written(p, f"{base}/prefixes")
    x = p.filter("probe").select("shingle", F.col("node").alias("xn"), F.col("n").alias("xs"),
                                 F.col("comp").alias("xc"), F.col("head").alias("xhead"),
                                 F.col("at").alias("xat"))
    first = F.get(F.array_intersect("head", "xhead"), 0)
    return (p.join(x, "shingle").filter(
        (F.col("comp") != F.col("xc")) & (~F.col("probe") | (F.col("node") < F.col("xn")))
        & (100 * F.least("n", "xs") >= percent * F.greatest("n", "xs"))
        & ((100 + percent) * F.least(F.col("n") - F.col("at"), F.col("xs") - F.col("xat"))
           >= percent * (F.col("n") + F.col("xs")))
        & (F.coalesce(first, F.col("shingle")) == F.col("shingle")))
        .select(F.least("node", "xn").alias("a"), F.greatest("node", "xn").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT, keep: Iterable[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept,
    plus class_node, n_links (confirmed links of its class) and the long
    columns named in ``keep``."""
    keep = list(keep)
    spark = docs.sparkSession
    base = work_dir(spark, "neardup")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                      F.xxhash64(text_col).alias("text_hash"), *keep)
    schema = SKETCH_SCHEMA + "".join(f", {c} long" for c in keep)
    sk = written(src.mapInArrow(_sketcher(band_size(percent)), schema).withColumn(
        "node", F.monotonically_increasing_id()), f"{base}/sketch")

    live = sk.filter("n_shingles > 0").withColumnRenamed("n_shingles", "n")
    # A class goes by its first row, which supplies bands and text.
    reps = written(live.groupBy("h1", "h2", "n").agg(
        F.min("node").alias("node"), F.min("doc_id").alias("rep"),
        F.count(F.lit(1)).alias("copies")), f"{base}/reps")
    own = live.select("node", "n", "h1", "h2", "doc_id", "text_hash", "bands").join(
        reps.select("node"), "node", "left_semi")
    named = written(own.drop("bands", "n"), f"{base}/named")
    bands = own.select("node", "n", "bands")
    # One shuffle by bucket serves both the sizes and the join.
    exploded = bands.select("node", "n", F.explode("bands").alias("key")).repartition("key")
    sizes = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("size"),
                                        F.min("node").alias("lo"), F.max("node").alias("hi"))
    members = written(exploded.join(sizes.filter("lo <> hi"), "key").select(
        "key", "node", "n", "size", F.ceil(F.col("size") / SALT_ROWS).cast("int").alias("salts")),
        f"{base}/collisions")
    # A class that collides with many is central: it makes the better centre.
    weight = members.groupBy(F.col("node").alias("wn")).agg(F.sum("size").alias("weight"))
    members = written(members.join(weight, F.col("node") == F.col("wn")).drop("wn", "size"),
                      f"{base}/members")

    centres = members.groupBy("key").agg(F.max_by(
        F.struct("node", "n", "salts"), F.struct("weight", "node")).alias("c")).select(
        "key", "c.*")
    stars = written(_stars(members, centres, percent), f"{base}/stars")
    sets = _sets(src, named, stars.select(F.col("a").alias("node")).unionByName(
        stars.select(F.col("b").alias("node"))), None, f"{base}/star")
    edges = written(_confirmed(stars, sets, percent, f"{base}/star"), f"{base}/star-links")

    def components(e: DataFrame, name: str) -> DataFrame:
        return contract_components(e, lambda d, part: written(d, f"{base}/{name}/{part}"))
    comps = components(edges, "star-components")
    # Buckets that still hold several components; a link the stars missed
    # has an end outside its bucket's first component.
    at = (members.join(comps.withColumnRenamed("label", "comp"), "node", "left")
          .withColumn("comp", F.coalesce("comp", "node")))
    spread = at.groupBy("key").agg(
        F.min("comp").alias("c_lo"), F.max("comp").alias("c_hi"),
        F.max_by("comp", F.struct("weight", "node")).alias("c_first"))
    still = spread.filter("c_lo <> c_hi").select("key", "c_first")
    open_nodes = written(at.join(still, "key").groupBy("node").agg(
        F.min("n").alias("n"), F.min("comp").alias("comp"),
        F.max(F.col("comp") != F.col("c_first")).alias("probe")), f"{base}/open")
    sets = _sets(src, named, open_nodes.select("node"), sets, f"{base}/open")
    rest = written(_prefix_pairs(open_nodes, sets, percent, base).join(
        stars, ["a", "b"], "left_anti"), f"{base}/rest")
    more = written(_confirmed(rest, sets, percent, f"{base}/rest"), f"{base}/rest-links")
    if not more.isEmpty():
        edges = edges.unionByName(more)
        comps = components(edges, "components")

    # Links per class, and each component's smallest document.
    ends = edges.select(F.col("a").alias("node")).unionByName(
        edges.select(F.col("b").alias("node")))
    links = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    lab = written(reps.join(comps, "node", "left").withColumn("label", F.coalesce("label", "node")),
                  f"{base}/labelled")
    low = written(lab.groupBy("label").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias(
        "classes")), f"{base}/low")
    classes = written(_join_hot(lab, low, ["label"], "classes").join(links, "node", "left").select(
        "h1", "h2", "n", F.col("node").alias("class_node"), "component", "copies",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), f"{base}/classes")
    found = _join_hot(live.drop("bands", "node", "text_hash"), classes, ["h1", "h2", "n"], "copies")
    none = F.lit(None).cast("long")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"), "class_node", "n_links",
        *keep).unionByName(sk.filter("n_shingles = 0").select(
            "doc_id", "n_shingles", F.col("doc_id").alias("component_id"),
            F.lit(True).alias("kept"), none.alias("class_node"),
            F.lit(0).cast("long").alias("n_links"), *keep))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the smallest
    doc_id, and of rows that repeat its id with an equal set one only. Rows
    without words are all kept. A row is told from others of its id by a
    hash of its text."""
    d = docs.withColumn("__tie", F.xxhash64(text_col))
    found = near_duplicates(d, id_col, text_col, percent, keep=["__tie"]).filter("n_shingles > 0")
    found = written(found.groupBy("doc_id", "class_node", "__tie", "kept").agg(
        F.count(F.lit(1)).alias("n")), work_dir(docs.sparkSession, "neardup-rows"))
    again = found.filter("kept").groupBy(
        F.col("doc_id").alias("d2"), F.col("class_node").alias("c2")).agg(
        F.sum("n").alias("rows"), F.min("__tie").alias("first")).filter("rows > 1")
    again = found.filter("kept").join(again, F.col("doc_id").eqNullSafe(F.col("d2")) & (
        F.col("class_node") == F.col("c2"))).select(
        "doc_id", "__tie", (F.col("__tie") == F.col("first")).alias("once"))
    flags = (found.filter("not kept").select("doc_id", "__tie", F.lit(False).alias("once"))
             .unionByName(again).select(F.col("doc_id").alias("__id"), F.col("__tie").alias("__t"),
                                        "once").distinct().withColumnRenamed("once", "__once"))
    out = d.join(flags, F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
                 & (F.col("__tie") == F.col("__t")), "left").filter("__once is null or __once")
    if flags.filter("__once").isEmpty():
        return out.select(*docs.columns)
    return (out.filter("__once is null").select(*docs.columns).unionByName(
        out.filter("__once").dropDuplicates([id_col, "__tie"]).select(*docs.columns)))


def _sets(src: DataFrame, named: DataFrame, nodes: DataFrame, have: DataFrame | None, base: str
          ) -> DataFrame:
    """(node, shingles) of ``have`` and of all classes in ``nodes``."""
    nodes = nodes.distinct()
    if have is not None:
        nodes = nodes.join(have, "node", "left_anti")
    nodes = written(nodes, f"{base}/nodes")
    wanted = named.join(nodes, "node", "left_semi").select(
        "node", "h1", "h2", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    texts = src.select("doc_id", "text", "text_hash").join(wanted, (
        F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")))
    sets = texts.select("node", "h1", "h2", "text").mapInArrow(
        _set_batches, "node long, shingles array<long>")
    sets = written(sets.dropDuplicates(["node"]), f"{base}/sets")
    return sets if have is None else have.unionByName(sets)


def _confirmed(cand: DataFrame, sets: DataFrame, percent: int, base: str) -> DataFrame:
    """Candidate pairs whose full sets reach the threshold."""
    pairs = written(_spread(cand, "a"), f"{base}/pairs")
    hub = pairs.groupBy("a").agg(F.max("salts").alias("salts"))
    left = (sets.withColumnRenamed("node", "a").join(hub, "a")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            .select("a", "salt", F.col("shingles").alias("sa")))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    inter = F.size(F.array_intersect("sa", "sb"))
    return (pairs.select("a", "b", "salt").join(right, "b").join(left, ["a", "salt"])
            .withColumn("i", inter)
            .filter(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i")))
            .select("a", "b"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document with its near-duplicate component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
