"""Iterative graph plans: bounded breadth-first search and connected
components, as frontier loops of joins.

Each round is one join of the frontier with the edge table plus joins
against what was already reached, which stays where it lies; the only value
that comes back to the driver is "is the new frontier empty". The edge table
is persisted once per traversal (it is re-read every round), and every
layer is checkpointed to the session's checkpoint directory, so the plan
stays small and a lost executor recomputes one round, not all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

HUB_SLOTS = 32
LAST_WIDTH = 4          # times the shuffle partitions: the last layer, which is not merged


def _edges(edges: DataFrame, src: str, dst: str, reverse: bool) -> DataFrame:
    s, d = (dst, src) if reverse else (src, dst)
    return edges.select(F.col(s).alias("__src"), F.col(d).alias("__dst")).distinct()


def _bounded(df: DataFrame) -> DataFrame:
    """Let AQE size the partitions of the state. Each round unions one more
    shuffled layer onto it; without this the partition count, and the files
    every checkpoint writes, would grow by a full shuffle width per round."""
    return df.hint("rebalance")


def _with_min(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``m``, the smallest v of the edge's u. The
    rows of a hub are spread over ``HUB_SLOTS`` join keys: the minimum is
    taken per (u, slot), then per u, and carried back to the slots."""
    e = edges.withColumn("slot", F.pmod(F.xxhash64("v"), F.lit(HUB_SLOTS)))
    per_slot = e.groupBy("u", "slot").agg(F.min("v").alias("m"))
    per_node = per_slot.groupBy("u").agg(F.min("m").alias("m"))
    slots = per_slot.select("u", "slot").join(per_node, "u")
    return e.join(slots, ["u", "slot"]).select("u", "v", "m")


class _Seen:
    """What a walk has reached, kept so that no round shuffles it again.

    Every layer is written to the checkpoint folder (``layers``) and cached
    once as a run: hashed by ``keys`` into ``spark.sql.shuffle.partitions``
    partitions and sorted within them, which is what a join on ``keys`` asks
    for. A round therefore shuffles its own new rows only and meets the runs
    where they lie (a run of a size that Spark broadcasts is broadcast).
    ``FAN_IN`` runs of equal rank are merged into one of the next rank, so r
    rounds leave O(log r) runs and a row moves O(log r) times; walks of up to
    ``FAN_IN`` - 1 rounds never merge. A lost cache block is built again from
    the written layers.
    """

    FAN_IN = 8

    def __init__(self, start: DataFrame, keys: list[str], squeeze=None):
        self.keys = keys
        self.squeeze = squeeze or (lambda df: df)     # rows of equal keys into one
        self.width = int(start.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.layers: list[DataFrame] = []
        self.runs: list[tuple[int, list[DataFrame], DataFrame]] = []   # rank, layers, cache
        self._place(0, [start])

    def _place(self, rank: int, parts: list[DataFrame]) -> None:
        rows = reduce(DataFrame.unionByName, parts).repartition(self.width, *self.keys)
        run = (self.squeeze(rows).sortWithinPartitions(*self.keys)
               .persist(StorageLevel.MEMORY_AND_DISK))
        run.count()      # a cached plan shows its partitioning only once it has run
        self.runs.append((rank, parts, run))

    def add(self, step: DataFrame, last: bool, lazy: bool = False) -> DataFrame | None:
        """``step`` written, as a layer and, unless it is the ``last`` one, as
        a run; None when it has no rows. The last layer, mostly the largest by
        far, may stay a plan (``lazy``): whoever reads the result once needs
        it neither shuffled again nor written."""
        if last and lazy:
            self.layers.append(step)
            return step
        layer = cut_lineage(_bounded(step))
        if layer.isEmpty():
            return None
        self.layers.append(layer)
        if not last:
            self._place(0, [layer])
            while len(self.runs) >= self.FAN_IN and len({r for r, _, _ in
                                                         self.runs[-self.FAN_IN:]}) == 1:
                old, self.runs = self.runs[-self.FAN_IN:], self.runs[:-self.FAN_IN]
                self._place(old[0][0] + 1, [p for _, parts, _ in old for p in parts])
                for _, _, run in old:
                    run.unpersist()
        return layer

    def by_depth(self) -> DataFrame | None:
        """All layers with their ``depth``; they are written already."""
        return reduce(DataFrame.unionByName, [
            layer.withColumn("depth", F.lit(i)) for i, layer in enumerate(self.layers, 1)]) \
            if self.layers else None

    def drop(self) -> None:
        for _, _, run in self.runs:
            run.unpersist()


def bfs(edges: DataFrame, roots: DataFrame, max_depth: int | None, src: str = "src",
        dst: str = "dst", reverse: bool = False, lazy: bool = False) -> DataFrame:
    """Nodes reachable from each root in 1..max_depth steps, with the
    shortest depth: ``(root, node, depth)``.

    ``roots`` has columns ``root`` and ``node`` (the start node; usually
    equal). A root itself is never reported (it is visited at depth 0).
    ``reverse=True`` walks edges backwards (dependents / callers).
    ``max_depth=None`` runs to the fixpoint; the edges then lie hashed and
    sorted by their start, as many rounds would shuffle them all again.
    ``lazy`` leaves the last layer a plan, for a result that is read once.
    """
    e = _edges(edges, src, dst, reverse)
    if max_depth is None:
        width = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        e = e.repartition(width, "__src").sortWithinPartitions("__src")
    e = e.persist(StorageLevel.MEMORY_AND_DISK)
    if max_depth is None:
        e.count()      # a cached plan shows its partitioning only once it has run
    frontier = cut_lineage(roots.select("root", "node").distinct())
    seen, start, depth = _Seen(frontier, ["root", "node"]), frontier, 0
    while frontier is not None and (max_depth is None or depth < max_depth):
        depth += 1
        # Pairs are made distinct before they meet the runs: in the map tasks first.
        step = (frontier.join(e, frontier["node"] == e["__src"])
                .select("root", F.col("__dst").alias("node")).distinct())
        for _, _, run in seen.runs:
            step = step.join(run, ["root", "node"], "left_anti")
        frontier = seen.add(step, depth == max_depth, lazy)
    found = seen.by_depth()
    if found is None:
        found = start.limit(0).withColumn("depth", F.lit(0))
    seen.drop()
    e.unpersist()
    return found


def _bits(mask: Column) -> Column:
    """The positions of the bits set in a long (array<int>); most masks of a
    sparse graph hold one bit, which needs no look at all 64."""
    one = F.lit(1).cast("long")
    single = F.array(F.when(mask < 0, F.lit(63)).otherwise(F.bit_count(mask - 1)))
    return F.when(F.bit_count(mask) == 1, single).otherwise(F.filter(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function(
            "shiftright", mask, i).bitwiseAND(one) == 1))


def _last_masks(frontier: DataFrame, e: DataFrame, written: list[DataFrame],
                width: int) -> DataFrame:
    """(node, __block, depth, __mask) of all depths from 1 on: those of the
    ``written`` layers (start first) and the step from the ``frontier``, where
    it reaches a node first. A node's (block, mask) entries go to each of its
    neighbours as one list, which is all that is shuffled, by the neighbour
    alone: the rows then lie by node for whoever joins them with nodes next."""
    last = len(written)
    entry = F.struct("__block", "__mask")
    lists = frontier.groupBy("node").agg(F.collect_list(entry).alias("__of"))
    lists = lists.join(e, lists["node"] == e["__src"]).select(
        F.col("__dst").alias("node"), F.lit(last).alias("depth"), "__of")
    for i, layer in enumerate(written):
        lists = lists.unionByName(layer.select("node", F.lit(i).alias("depth"),
                                               F.array(entry).alias("__of")))
    at = lists.repartition(width, "node").select("node", "depth", F.explode("__of").alias("__x"))
    zero = F.lit(0).cast("long")
    found = at.groupBy("node", F.col("__x.__block").alias("__block")).agg(*[
        F.coalesce(F.bit_or(F.when(F.col("depth") == i, F.col("__x.__mask"))), zero)
        .alias(f"__m{i}") for i in range(last + 1)])
    had = reduce(Column.bitwiseOR, [F.col(f"__m{i}") for i in range(last)])
    masks = [F.col(f"__m{i}") for i in range(1, last)] + [
        # An edge to null: such a node equals no other, as in the joins of the rounds.
        F.col(f"__m{last}").bitwiseAND(F.bitwise_not(F.when(
            F.col("node").isNotNull(), had).otherwise(zero)))]
    layers = F.array(*[F.struct(F.lit(i).alias("depth"), m.alias("__mask"))
                       for i, m in enumerate(masks, 1)])
    return (found.select("node", "__block", F.explode(layers).alias("__l"))
            .select("node", "__block", "__l.depth", "__l.__mask").filter(F.col("__mask") != 0))


def bfs_masks(edges: DataFrame, roots: DataFrame, max_depth: int | None, src: str = "src",
        dst: str = "dst", reverse: bool = False, lazy: bool = False, by_id: bool = False
        ) -> DataFrame:
    """The answer of ``bfs`` for many roots that reach the same nodes, as in
    call and import graphs. All roots walk at once: 64 of them share a block, and a block's roots that
    reach a node are one 64-bit mask. A round joins (node, block, mask) rows
    with the edges, ORs the masks per (node, block), in the map tasks first,
    and clears the bits already seen; rows per root appear only in the result.
    Where roots share few nodes a mask holds one bit and ``bfs`` is cheaper.

    ``by_id``: roots are longs, and a root's number is the root itself, so that
    the result needs no join for the names of its bits; of use when the roots
    are most of the ids. ``lazy`` leaves the last layer and the rows per root a
    plan, for a result that is read once; with ``by_id`` it lies by node.
    """
    e = _edges(edges, src, dst, reverse).persist(StorageLevel.MEMORY_AND_DISK)
    one = F.lit(1).cast("long")
    keys = ["node", "__block"]

    def ored(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.bit_or("__mask").alias("__mask"))
    ids = roots.select("root").distinct()
    if by_id:
        named = ids.filter("root is not null").withColumn("__id", F.col("root").cast("long"))
    else:
        # Ids count up within a partition, so that blocks are filled without a
        # sort over all roots; the numbering is written once.
        named = cut_lineage(ids.withColumn("__id", F.monotonically_increasing_id()))
    named = named.select(
        "root", F.shiftright("__id", 6).alias("__block"),
        F.col("__id").bitwiseAND(F.lit(63)).cast("int").alias("__bit"))
    frontier = cut_lineage(ored(roots.select("root", "node").join(named, "root").select(
        *keys, F.call_function("shiftleft", one, F.col("__bit")).alias("__mask"))))
    if lazy and max_depth == 1:
        seen = None
    else:
        seen = _Seen(frontier, keys, ored)
    start, depth, layers = frontier, 0, None
    while frontier is not None and (max_depth is None or depth < max_depth):
        depth += 1
        if lazy and depth == max_depth:
            layers = _last_masks(frontier, e, [start, *(seen.layers if seen else [])],
                                 LAST_WIDTH * int(e.sparkSession.conf.get(
                                     "spark.sql.shuffle.partitions")))
            break
        step = ored(frontier.join(e, frontier["node"] == e["__src"]).select(
            F.col("__dst").alias("node"), "__block", "__mask"))
        for _, _, run in seen.runs:
            had = run.withColumnRenamed("__mask", "__had")
            step = step.join(had, keys, "left").select(*keys, F.col("__mask").bitwiseAND(
                F.bitwise_not(F.coalesce("__had", F.lit(0).cast("long")))).alias("__mask"))
        frontier = seen.add(step.filter(F.col("__mask") != 0), depth == max_depth)
    if layers is None:
        layers = seen.by_depth()
    if layers is None:
        layers = start.limit(0).withColumn("depth", F.lit(0))
    if by_id:
        result = layers.select("node", "depth", "__block", F.explode(_bits(F.col("__mask")))
                               .alias("__bit")).select(
            F.shiftleft("__block", 6).bitwiseOR(F.col("__bit").cast("long")).alias("root"),
            "node", "depth")
    else:
        # 64 roots a block at most.
        members = named.groupBy("__block").agg(
            F.collect_list(F.struct("__bit", "root")).alias("__of"))
        result = layers.join(members, "__block").select(
            "node", "depth", F.explode(F.filter("__of", lambda x: F.call_function(
                "shiftright", F.col("__mask"), x["__bit"]).bitwiseAND(one) == 1)).alias("__r")
            ).select("__r.root", "node", "depth")
    if not lazy:
        result = cut_lineage(_bounded(result))
    if seen:
        seen.drop()
    e.unpersist()
    return result


def _is_star_forest(e: DataFrame) -> bool:
    """True when every edge ``(u, v)`` (u < v) hangs off a centre that is
    nobody's leaf and every leaf has one centre: then each component is a
    star around its smallest node. One aggregation, one boolean back."""
    marks = (e.select(F.col("v").alias("n"), F.lit(1).alias("as_leaf"), F.lit(0).alias("as_centre"))
             .unionByName(e.select(F.col("u").alias("n"), F.lit(0).alias("as_leaf"),
                                   F.lit(1).alias("as_centre"))))
    bad = (marks.groupBy("n").agg(F.sum("as_leaf").alias("leaf"), F.max("as_centre").alias("centre"))
           .filter((F.col("leaf") > 1) | ((F.col("leaf") >= 1) & (F.col("centre") == 1))))
    return bad.isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         checkpoint_every: int = 2) -> DataFrame:
    """``(node, component)`` with component = smallest node id in it.

    Alternating large-star / small-star (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014): O(log^2 n) rounds, each a
    groupBy-min and a join, no per-component collect. The loop stops as
    soon as the edges form a forest of stars. Only nodes that appear in
    some edge are labelled.
    """
    e = (edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
         .filter(F.col("u") != F.col("v"))
         .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    e = cut_lineage(e)
    cached: list[DataFrame] = []
    rounds = 0
    while not _is_star_forest(e):
        rounds += 1
        # Large star: every node links its larger neighbours to the
        # smallest node of its closed neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_with_min(both).filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")))
        # Small star: every node links its smaller neighbours (and itself)
        # to the smallest of them.
        norm = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        smin = norm.groupBy("u").agg(F.min("v").alias("m"))
        small = (_with_min(norm)
                 .select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .unionByName(smin.select(F.col("u").alias("a"), F.col("m").alias("b")))
                 .filter(F.col("a") != F.col("b"))
                 .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
                 .distinct())
        if rounds % checkpoint_every == 0:
            e = cut_lineage(small)
        else:
            e = small.persist(StorageLevel.MEMORY_AND_DISK)
            e.count()
            cached.append(e)
    members = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    centres = e.select(F.col("u").alias("node"), F.col("u").alias("component"))
    result = cut_lineage(_bounded(members.unionByName(centres).distinct()))
    for df in cached:
        df.unpersist()
    return result
