"""Similarity and code-pattern operators over ``documents``."""

from pyspark.sql import functions as F

from ..operators import similarity as op
from ..registry import register
from ..sources.fixture import document_corpus

_TOK = r"""
, tok AS (SELECT doc_id AS id, source AS module,
            list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}]+'))) AS t
          FROM documents),
  tk AS (SELECT id, module, t, len(t) AS n FROM tok WHERE len(t) > 0)
"""
_PAIRS = _TOK + """
, sets AS (SELECT t, min(id) AS rep, any_value(n) AS n FROM tk GROUP BY t),
  pr AS (SELECT rep_a, rep_b, round(inter / (na + nb - inter), 6) AS score FROM (
           SELECT a.rep AS rep_a, b.rep AS rep_b, len(list_intersect(a.t, b.t)) AS inter,
             a.n AS na, b.n AS nb
           FROM sets a JOIN sets b ON a.rep < b.rep AND b.n * 10 >= a.n * 7
             AND a.n * 10 >= b.n * 7)
         WHERE inter * 10 >= (na + nb - inter) * 7)
"""


@register("similar_set_pairs", _PAIRS + "SELECT rep_a, rep_b, score FROM pr")
def similar_set_pairs(g, spark, sf_dir):
    """Exact Jaccard >= 0.7 between distinct token sets (representatives)."""
    return op.similar_sets(document_corpus(spark, sf_dir), 0.7).pairs


@register("similar_functions", _TOK + """
, p AS (SELECT a.id, b.id AS other_id, len(list_intersect(a.t, b.t)) AS inter, a.n AS na,
          b.n AS nb
        FROM tk a JOIN tk b ON a.id <> b.id AND b.n * 10 >= a.n * 7 AND a.n * 10 >= b.n * 7),
  s AS (SELECT id, other_id, round(inter / (na + nb - inter), 6) AS score FROM p
        WHERE inter * 10 >= (na + nb - inter) * 7)
SELECT id, other_id, score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other_id) AS rank FROM s)
WHERE rank <= 10
""")
def similar_functions(g, spark, sf_dir):
    """Top 10 similar documents per document, Jaccard >= 0.7."""
    return op.similar_functions(document_corpus(spark, sf_dir), threshold=0.7, limit=10)


@register("similarity_groups", _PAIRS + """
, und(a, b) AS (SELECT rep_a, rep_b FROM pr UNION SELECT rep_b, rep_a FROM pr),
  reach(a, b) AS (SELECT rep, rep FROM sets UNION SELECT r.a, u.b FROM reach r JOIN und u ON u.a = r.b),
  comp AS (SELECT a AS rep, min(b) AS grp FROM reach GROUP BY a),
  mem AS (SELECT tk.id, tk.module, comp.grp AS group_id
          FROM tk JOIN sets ON sets.t = tk.t JOIN comp ON comp.rep = sets.rep
          WHERE position('src1' IN coalesce(tk.module, '')) > 0),
  sizes AS (SELECT group_id, count(*) AS group_size FROM mem GROUP BY group_id
            HAVING count(*) >= 2),
  sim AS (SELECT comp.grp AS group_id, avg(pr.score) AS s FROM pr JOIN comp ON comp.rep = pr.rep_a
          GROUP BY comp.grp)
SELECT mem.group_id, mem.id AS member_id, mem.module, CAST(sizes.group_size AS BIGINT) AS group_size,
  round(coalesce(sim.s, 1.0), 6) AS similarity
FROM mem JOIN sizes ON sizes.group_id = mem.group_id LEFT JOIN sim ON sim.group_id = mem.group_id
""", recursive=True)
def similarity_groups(g, spark, sf_dir):
    """Every group (no limit) of sources containing 'src1', size >= 2."""
    return op.similarity_groups(document_corpus(spark, sf_dir), 0.7, module_pattern="src1",
                                limit=None)


_PATTERN = "The and attion to thanedble\n   \nStteen\n"
_LINES = """
, lines AS (SELECT doc_id AS id, source AS module,
              unnest(string_split(text, chr(10))) AS line,
              unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no
            FROM documents),
  m AS (SELECT * FROM lines WHERE position('The and attion to thanedble' IN line) > 0
          OR position('Stteen' IN line) > 0)
"""


@register("code_patterns", _LINES + """
SELECT id, module, count(*) AS matches FROM m GROUP BY id, module HAVING count(*) >= 2
""")
def code_patterns(g, spark, sf_dir):
    """Documents with >= 2 lines containing a pattern line (no limit)."""
    return op.code_patterns(document_corpus(spark, sf_dir), _PATTERN, min_matches=2,
                            limit=None).select("id", "module", "matches")


@register("code_patterns_with_lines", _LINES + """
SELECT id, module, count(*) AS matches,
  array_to_string(list_slice(list(concat(line_no, ':', trim(line)) ORDER BY line_no), 1, 3), '|')
    AS matched_lines
FROM m GROUP BY id, module
""")
def code_patterns_with_lines(g, spark, sf_dir):
    """O33 with the first matched lines of every document that holds one."""
    return op.code_patterns(document_corpus(spark, sf_dir), _PATTERN, min_matches=1,
                            limit=None).withColumn("matched_lines", F.array_join(F.transform(
                                "matched_lines", lambda x: F.concat(
                                    x["line_no"].cast("string"), F.lit(":"), x["line"])), "|"))


@register("code_pattern_lines", _LINES + """
, ok AS (SELECT id FROM m GROUP BY id HAVING count(*) >= 2)
SELECT id, CAST(line_no AS BIGINT) AS line_no, trim(line) AS line FROM (
  SELECT m.*, row_number() OVER (PARTITION BY m.id ORDER BY m.line_no) AS rn
  FROM m WHERE m.id IN (SELECT id FROM ok)) WHERE rn <= 3
""")
def code_pattern_lines(g, spark, sf_dir):
    """O33 sample: first 3 matching lines per qualifying document."""
    return op.code_pattern_lines(document_corpus(spark, sf_dir), _PATTERN, min_matches=2)
