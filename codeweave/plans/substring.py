"""Exact "text contains name" join without a nested loop.

Each distinct text is cut into its distinct q-grams (q = 3); each name of
length >= 3 is keyed by its rarest q-gram among the texts (fewest texts
hold it). An equi-join on that q-gram yields a candidate set that is a
superset of the true matches (every text containing the name contains
all its q-grams), and ``contains`` verifies. Names of length 1 or 2 are
keyed by themselves among the texts' distinct 1- and 2-grams. What is
shuffled per q-gram is the q-gram and a text id, never the text: the bytes
grow linearly with the length of the texts. The postings are computed twice
(to count, with map-side combine, and to join) rather than stored. The
answer equals ``text LIKE '%' || name || '%'`` with the name taken
literally. Empty names are skipped (they are not names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 3


def _grams(text: Column, q: int) -> Column:
    """Distinct q-grams of ``text`` (array<string>)."""
    n = F.length(text) - q + 1
    return F.when(n >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), n), lambda i: F.substring(text, i, q))
    )).otherwise(F.array().cast("array<string>"))


def contains_pairs(names: DataFrame, texts: DataFrame, name_col: str = "name",
                   text_col: str = "text") -> DataFrame:
    """Pairs ``(name, text)`` of distinct strings where ``text`` contains
    ``name``. Join the result back to the entity tables on both strings."""
    dn = names.select(F.col(name_col).alias("name")).filter(
        F.col("name").isNotNull() & (F.length("name") > 0)).distinct()
    dt = (texts.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
          .withColumn("tid", F.xxhash64("text")))

    # Postings: the distinct 1-, 2- and 3-grams of every text, with its id.
    t = F.col("text")
    post = dt.select("tid", F.explode(F.concat(*[_grams(t, q) for q in range(1, Q + 1)])).alias("g"))
    freq = post.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    n = F.col("name")
    name_grams = dn.select("name", F.explode(
        F.when(F.length(n) >= Q, _grams(n, Q)).otherwise(F.array(n))).alias("g"))
    # Inner join: a name with a q-gram that no text holds loses only that
    # q-gram here, and its candidates fail the verification below.
    rarest = (name_grams.join(freq, "g").groupBy("name")
              .agg(F.min(F.struct("df", "g")).alias("r")).select("name", F.col("r.g").alias("g")))
    cand = rarest.join(post, "g").select("name", "tid")
    # One join back to the texts. Two texts that share an id are both
    # fetched and both verified, so the answer does not rest on the hash.
    return (cand.distinct().join(dt, "tid").filter(F.col("text").contains(F.col("name")))
            .select("name", "text"))


IDENTIFIER = "[A-Za-z0-9_]+"


def token_pairs(names: DataFrame, texts: DataFrame, name_col: str = "name",
                text_col: str = "text") -> DataFrame:
    """Pairs ``(name, text)`` of distinct strings where ``name`` equals a
    whole identifier of ``text``: an equi-join with the texts' inverted index
    (identifier, text id); the texts are fetched afterwards."""
    dn = names.select(F.col(name_col).alias("name")).filter(F.col("name").isNotNull()).distinct()
    dt = (texts.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
          .withColumn("tid", F.xxhash64("text")))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), 0))
    index = dt.select("tid", F.explode(words).alias("name"))
    # Two texts that share an id are both fetched, so the word is looked for.
    return (dn.join(index, "name").distinct().join(dt.withColumn("words", words), "tid")
            .filter(F.array_contains("words", F.col("name"))).select("name", "text"))


def name_pairs(names: DataFrame, texts: DataFrame, name_col: str, text_col: str,
               match: str = "substring") -> DataFrame:
    """``contains_pairs`` or, for ``match='identifier'``, ``token_pairs``."""
    if match not in ("substring", "identifier"):
        raise ValueError("match must be 'substring' or 'identifier'")
    return (contains_pairs if match == "substring" else token_pairs)(names, texts, name_col, text_col)
