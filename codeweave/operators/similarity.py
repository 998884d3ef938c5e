"""Similarity and code-pattern operators over a corpus ``(id, text,
module)``: function bodies of a code graph, or any text table.

* ``similar_functions`` (O32): for each id, its ``limit`` most similar
  other ids by exact Jaccard of letter-token sets, score >= threshold.
* ``similarity_groups`` (O34): connected components of the similarity
  graph, members listed flat.
* ``code_patterns`` (O33): functions with at least ``min_matches`` body
  lines containing any line of a code pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import connected_components
from ..functions import constants as C
from ..plans.keys import MAX_LITERAL_KEYS
from ..plans.setsim import SimilarSets, similar_sets
from ..sources.tables import CodeGraph


def function_corpus(g: CodeGraph) -> DataFrame:
    """(id, text, module): signature and body of every function."""
    body = g.function_body.select("id", "raw_string")
    f = g.function.select("id", "function_signature", F.col("module_name").alias("module"))
    return f.join(body, "id", "left").select(
        "id", F.concat_ws("\n", "function_signature", "raw_string").alias("text"), "module")


def body_corpus(g: CodeGraph) -> DataFrame:
    """(id, text, module): the body of every function, lines as stored."""
    f = g.function.select("id", F.col("module_name").alias("module"))
    return f.join(g.function_body.select("id", F.col("raw_string").alias("text")), "id").select(
        "id", "text", "module")


def _rank_limit(df: DataFrame, part: str, limit: int, *order) -> DataFrame:
    w = Window.partitionBy(part).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def similar_functions(corpus: DataFrame, keys: DataFrame | list | None = None,
                      threshold: float = C.SIMILARITY_THRESHOLD, limit: int = C.LIMIT_SIMILAR,
                      sets: SimilarSets | None = None) -> DataFrame:
    """Top ``limit`` other ids per id, by (score desc, other id asc).

    Exact and bounded without listing every pair: a representative's
    candidates are its own copies (score 1) and, for each similar set,
    that set's ``limit + 1`` smallest ids; the best ``limit + 1`` of those
    per representative contain every member's top ``limit`` once the
    member itself is removed. Output is at most ``limit`` rows per id.
    """
    kdf = None
    if isinstance(keys, DataFrame):
        kdf = keys.select(F.col(keys.columns[0]).cast("long").alias("id")).distinct()
    elif keys is not None:
        if len(keys) > MAX_LITERAL_KEYS:
            raise ValueError("too many literal keys; pass a DataFrame")
        kdf = F.broadcast(corpus.sparkSession.createDataFrame([(int(x),) for x in keys],
                                                              "id long"))
    s = sets or similar_sets(corpus, threshold, keys=kdf)
    k = limit + 1
    small = _rank_limit(s.members, "rep", k, "id").select("rep", F.col("id").alias("member"))
    sym = s.pairs.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other"), "score") \
        .unionByName(s.pairs.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other"),
                                    "score"))
    cand = (sym.join(small.select(F.col("rep").alias("other"), "member"), "other")
            .select("rep", "score", "member")
            .unionByName(small.select("rep", F.lit(1.0).alias("score"), "member")))
    best = _rank_limit(cand, "rep", k, F.desc("score"), "member").drop("rank")
    ids = s.members.select("id", "rep")
    if kdf is not None:
        ids = ids.join(kdf, "id", "left_semi")
    out = (ids.join(best, "rep").filter(F.col("member") != F.col("id"))
           .select("id", F.col("member").alias("other_id"), "score"))
    return _rank_limit(out, "id", limit, F.desc("score"), "other_id").withColumn(
        "rank", F.col("rank").cast("bigint"))


def similarity_groups(corpus: DataFrame, threshold: float = C.SIMILARITY_THRESHOLD,
                      module_pattern: str | None = None,
                      min_group_size: int = C.MIN_GROUP_SIZE,
                      limit: int | None = C.LIMIT_GROUPS,
                      sets: SimilarSets | None = None) -> DataFrame:
    """Groups = connected components of the similarity graph (copies of
    one text are always together). Rows ``(group_id, member_id, module,
    group_size, similarity)``; ``group_id`` is the smallest member id,
    ``similarity`` the mean score of the group's edges between distinct
    sets (1.0 for a group of identical texts). The module filter drops
    members first, then groups smaller than ``min_group_size``; the
    first ``limit`` groups by (size desc, id) are returned."""
    s = sets or similar_sets(corpus, threshold)
    comp = connected_components(s.pairs, "rep_a", "rep_b")
    mem = (s.members.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
           .select("id", F.coalesce("component", "rep").alias("group_id")))
    mem = mem.join(corpus.select("id", "module"), "id")
    if module_pattern:
        mem = mem.filter(F.coalesce("module", F.lit("")).contains(F.lit(module_pattern)))
    sizes = mem.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    sizes = sizes.filter(F.col("group_size") >= min_group_size)
    edge_mean = (s.pairs.join(comp.select(F.col("node").alias("rep_a"),
                                          F.col("component").alias("group_id")), "rep_a")
                 .groupBy("group_id").agg(F.avg("score").alias("similarity")))
    groups = sizes.join(edge_mean, "group_id", "left").select(
        "group_id", F.col("group_size").cast("bigint").alias("group_size"),
        F.round(F.coalesce("similarity", F.lit(1.0)), 6).alias("similarity"))
    if limit is not None:
        groups = groups.orderBy(F.desc("group_size"), "group_id").limit(limit)
    return mem.join(groups, "group_id").select(
        "group_id", F.col("id").alias("member_id"), "module", "group_size", "similarity")


def pattern_lines(pattern_code: str) -> list[str]:
    return [ln.strip() for ln in pattern_code.split("\n") if ln.strip()]


def _matching_lines(corpus: DataFrame, pattern_code: str, min_matches: int,
                    module_pattern: str | None) -> DataFrame:
    """(id, module, lines): the lines ``(line_no, line)`` of each qualifying
    text that hold a pattern line. A text's lines are numbered, filtered and
    counted inside its row, so nothing is shuffled; texts that hold no pattern
    line at all are not split."""
    pats = pattern_lines(pattern_code)
    if not pats:
        raise ValueError("pattern_code has no non-blank line")
    if module_pattern:
        corpus = corpus.filter(F.coalesce("module", F.lit("")).contains(F.lit(module_pattern)))

    def holds(c):
        hit = F.lit(False)
        for p in pats:
            hit = hit | c.contains(F.lit(p))
        return hit
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(
        (i + 1).cast("bigint").alias("line_no"), line.alias("line")))
    return (corpus.filter(holds(F.col("text")))
            .select("id", "module", F.filter(numbered, lambda x: holds(x["line"])).alias("lines"))
            .filter(F.size("lines") >= max(min_matches, 1)))


def code_patterns(corpus: DataFrame, pattern_code: str,
                  min_matches: int = C.MIN_PATTERN_MATCHES, module_pattern: str | None = None,
                  limit: int | None = C.LIMIT_CODE_PATTERNS,
                  lines_shown: int = C.MATCHED_LINES_SHOWN) -> DataFrame:
    """``(id, module, matches, matched_lines)`` for texts with at least
    ``min_matches`` lines containing any pattern line (literal, trimmed), by
    matches desc, id. ``matched_lines`` holds the first ``lines_shown`` of
    them as (line_no, trimmed line); ids are unique in ``corpus``."""
    m = _matching_lines(corpus, pattern_code, min_matches, module_pattern)
    shown = F.transform(F.slice("lines", 1, lines_shown), lambda x: F.struct(
        x["line_no"].alias("line_no"), F.trim(x["line"]).alias("line")))
    out = m.select("id", "module", F.size("lines").cast("bigint").alias("matches"),
                   shown.alias("matched_lines"))
    return out if limit is None else out.orderBy(F.desc("matches"), "id").limit(limit)


def code_pattern_lines(corpus: DataFrame, pattern_code: str,
                       min_matches: int = C.MIN_PATTERN_MATCHES,
                       module_pattern: str | None = None,
                       per_function: int = C.MATCHED_LINES_SHOWN) -> DataFrame:
    """O33 sample: the first ``per_function`` matching lines (trimmed) of
    every text that qualifies."""
    m = _matching_lines(corpus, pattern_code, min_matches, module_pattern)
    first = m.select("id", F.explode(F.slice("lines", 1, per_function)).alias("x"))
    return first.select("id", "x.line_no", F.trim("x.line").alias("line"))
