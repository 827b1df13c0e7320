"""Full-text ranking over a postings table: term, id, tf, length.

A postings table is written once for a corpus, in buckets of its terms; a question reads the buckets of its own terms
and nothing else of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A term: two characters at least, lower case.
TERM = r"[a-z0-9가-힣]{2,}"
BUCKETS = 256
#: Share of its contribution that a later, weaker variant adds; what the i-th title hit adds is TITLE / (1 + i).
BONUS, TITLE = 0.15, 0.08
#: Kinds of exact tokens, in the order in which they are looked for: keys of issues and incidents, codes of check items,
#: kernel parameters, page ids, long numbers.
EXACT = (r"\b[A-Z][A-Z0-9]{2,}-\d{2,}(?:-\d+)?\b", r"\b[A-Z][A-Z0-9_]+_\d+(?:\.\d+)+\b", r"\bvm\.[a-z0-9_.]+\b", r"(?<![.\w])[a-z]+_\d{2,}\b", r"\b\d{6,}\b")
#: A key whose number ends it: that number is no long number of its own.
_KEYED = r"\b[A-Z][A-Z0-9]{2,}-\d{2,}\b(?!-\d)"


def postings(docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """docs: id, text. Combined on the map side, so a term that all texts have is one row for each text.

    only: the terms of a question, where no index was written.
    """
    terms = F.regexp_extract_all(F.lower("text"), F.lit(TERM), 0)
    if only is not None:
        terms = F.filter(terms, lambda t: t.isin(only))
    rows = docs.select("id", F.length("text").alias("length"), F.explode(terms).alias("term"))
    return rows.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, path: str) -> None:
    postings(docs).withColumn("bucket", _bucket(F.col("term"))).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """Postings of the terms; partitions of other buckets are not listed, row groups of other terms are skipped."""
    numbers = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(numbers) & F.col("term").isin(terms)).drop("bucket")


def terms_of(text: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(TERM, text.lower())))


def folded(posts: DataFrame, variants: list[tuple[str, float]], limit: int = 40) -> DataFrame:
    """id, score by the variants of a question, in their order.

    A variant finds what has all its terms; its ``limit`` best texts count, with its weight. A contribution over the
    best so far takes its place, a smaller one adds BONUS of itself: so the order of variants matters.
    """
    spark = posts.sparkSession
    rows = [(i, w, t, len(terms_of(v))) for i, (v, w) in enumerate(variants) if w > 0 for t in terms_of(v)]
    asked = spark.createDataFrame(rows, "variant int, weight double, term string, needed int")  # a question's few
    found = posts.join(F.broadcast(asked), "term").groupBy("variant", "weight", "needed", "id").agg(F.count(F.lit(1)).alias("n"), (F.sum("tf") / (1 + F.log(1 + F.max("length")))).alias("score"))
    return fold(found.where("n = needed").select("variant", "weight", "id", "score"), limit)


def fold(scored: DataFrame, limit: int = 40) -> DataFrame:
    """id, score of texts that variants (variant, weight, id, score) found, by the rule of ``folded``."""
    best = Window.partitionBy("variant").orderBy(F.desc("score"), "id")
    top = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit)
    each = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("variant", (F.col("weight") * F.col("score")).alias("c")))).alias("each"))  # at most one for each variant
    score = F.aggregate("each", F.lit(0.0), lambda a, x: F.when(x["c"] > a, x["c"]).otherwise(a + BONUS * x["c"]))
    return each.select("id", score.alias("score"))


def title_bonus(docs: DataFrame, terms: list[str], limit: int = 40) -> DataFrame:
    """id, bonus. docs: id, title. Each term gives its hits in the order of their ids less and less; six terms at most."""
    asked = docs.sparkSession.createDataFrame([(t,) for t in terms[:6]], "term string")
    hit = docs.join(F.broadcast(asked), F.contains(F.lower("title"), F.lower("term")))
    ranked = hit.withColumn("i", F.row_number().over(Window.partitionBy("term").orderBy("id"))).where(F.col("i") <= limit)
    return ranked.groupBy("id").agg(F.sum(TITLE / F.col("i")).alias("bonus"))


def exact_tokens(text: Column) -> Column:
    """Distinct exact tokens of a text, by kind and then by place."""
    found = [F.regexp_extract_all(text, F.lit(p), 0) for p in EXACT[:-1]]
    numbers = F.regexp_extract_all(F.regexp_replace(text, _KEYED, " "), F.lit(EXACT[-1]), 0)
    return F.array_distinct(F.flatten(F.array(*found, numbers)))


def injected(ranked: DataFrame, docs: DataFrame, tokens: DataFrame, limit: int = 20) -> DataFrame:
    """ranked: id, rank. What has a token (i, token) in its key or title and isn't ranked yet stands before the list.

    docs: id, key, title. Of each token the first ``limit`` by id; a later token, and a later id of it, stands further in front.
    """
    low = F.concat_ws("\n", F.lower("key"), F.lower("title"))
    hit = docs.join(F.broadcast(tokens), F.contains(low, F.lower("token"))).select("id", "i")
    hit = hit.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy("id"))).where(F.col("n") <= limit)
    new = hit.join(ranked.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("i", "n")).alias("at"))
    front = Window.orderBy(F.desc("at"))
    new = new.select("id", (F.row_number().over(front) - 1_000_000).alias("rank"))
    return ranked.select("id", "rank").unionByName(new).withColumn("rank", F.row_number().over(Window.orderBy("rank", "id")))
