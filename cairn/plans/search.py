"""Queries of full-text search by covers, of many questions in one plan, and of the search as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import dictionary, fulltext, shelves, trigrams, vector_index
from cairn.operators import lexical as L
from cairn.operators import rank as R
from cairn.plans.registry import query
from cairn.sources import versions
from cairn.sources.tables import load

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9가-힣]{2,}')"
#: Variants of a question with their weights, in order.
VARIANTS = [("the of and", 1.0), ("version license", 1.0), ("und der die", 0.85), ("que la", 0.85), ("the", 0.25)]


def _asked(variants: list[tuple[str, float]]) -> list[tuple]:
    return [(i, w, t, s, len(ts)) for i, (v, w) in enumerate(variants) for ts in [L.terms_of(v)] for s, t in enumerate(ts)]


def _cover_sql(variants: list[tuple[str, float]]) -> str:
    """CTEs up to cover: variant, weight, id, score."""
    rows = _asked(variants)
    most = range(max(r[4] for r in rows))
    last = ", ".join(f"max(CASE WHEN slot = {i} THEN place WHEN needed <= {i} THEN 1000000000 END) OVER w AS s{i}" for i in most)
    values = ", ".join(f"({i}, {w}::DOUBLE, '{t}', {s}, {n})" for i, w, t, s, n in rows)
    there, least = " AND ".join(f"s{i} IS NOT NULL" for i in most), ", ".join(f"s{i}" for i in most)
    return f"""tok AS (SELECT doc_id AS id, unnest({TOKENS}) AS term, unnest(range(len({TOKENS}))) AS place FROM documents),
ask(variant, weight, term, slot, needed) AS (VALUES {values}),
hit AS (SELECT * FROM (SELECT *, count(DISTINCT slot) OVER (PARTITION BY variant, id) AS have FROM tok JOIN ask USING (term)) WHERE have = needed),
upto AS (SELECT variant, weight, needed, id, place, {last} FROM hit WINDOW w AS (PARTITION BY variant, id ORDER BY place)),
start AS (SELECT *, CASE WHEN {there} THEN least({least}) END AS b FROM upto),
cover AS (SELECT variant, weight, id, sum(1 / (2 + place - b - needed)) AS score FROM (SELECT *, lag(b) OVER (PARTITION BY variant, id ORDER BY place) AS p FROM start) WHERE b IS NOT NULL AND (p IS NULL OR b > p) GROUP BY ALL)"""


DENSE = f"""{_cover_sql(VARIANTS)},
top AS (SELECT * FROM cover QUALIFY row_number() OVER (PARTITION BY variant ORDER BY score DESC, id) <= 40),
dense AS (SELECT id, list_reduce(list_prepend(0.0::DOUBLE, list(weight * score ORDER BY variant)), lambda a, x: CASE WHEN x > a THEN x ELSE a + 0.15 * x END) AS score FROM top GROUP BY id)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {DENSE} SELECT id, round(score, 6) AS score FROM dense")
def r01_cover_density(spark, d):
    return fulltext.dense(_docs(spark, d), VARIANTS).select("id", F.round("score", 6).alias("score"))


_HYBRID = f"""WITH {DENSE},
lex AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM dense QUALIFY rank <= 40),
vec AS (SELECT v.vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.vec_id <> 0 QUALIFY rank <= 40),
rrf AS (SELECT id, sum(part) AS score, min(l) AS lex_rank FROM (SELECT id, 1.0::DOUBLE / (60 + rank) AS part, rank AS l FROM lex UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank), NULL FROM vec) GROUP BY id),
gate AS (SELECT * FROM rrf WHERE (SELECT max(score) FROM rrf) >= 0.012 ORDER BY round(score, 9) DESC, id LIMIT 20)
SELECT source, id, round(score, 9) AS score, CASE WHEN score >= 0.05 OR lex_rank = 1 THEN 'strong' WHEN score >= 0.02 THEN 'medium' ELSE 'weak' END AS label
FROM gate JOIN documents ON doc_id = id QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, id) = 1"""


@query(_HYBRID)
def r08_gate_then_dedupe(spark, d):
    """The search as a whole: covers and vectors fused, the gate cuts to 20 chunks, then the best of each document (source) with its trust label."""
    lex = fulltext.dense(_docs(spark, d), VARIANTS).select("id", F.row_number().over(Window.orderBy(F.desc(F.round("score", 6)), "id")).alias("rank")).where("rank <= 40")
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    one = vectors.where("id = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    near = R.vector_top(vectors, one, 41).select("id", F.round("score", 9).alias("score"))
    vec = near.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank")).where("rank <= 40")
    hits = R.fused([(lex, 1.0), (vec, 1.0)]).join(lex.select("id", F.col("rank").alias("lex_rank")), "id", "left")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return R.searched(hits, docs, "source", 20)


_QUESTIONS = f"""tok AS (SELECT doc_id AS id, length(text) AS length, unnest({TOKENS}) AS term FROM documents), post AS (SELECT term, id, count(*) AS tf, any_value(length) AS length FROM tok GROUP BY term, id),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), said AS (SELECT DISTINCT conv_id || ':' || turn AS qid, unnest({TOKENS}) AS term FROM conversations WHERE role = 'user'),
ask AS (SELECT qid, term, ln(1 + (SELECT count(*) FROM documents) / df) AS weight FROM said JOIN df USING (term))"""


def _said(spark: SparkSession, d: str) -> DataFrame:
    """qid, term: the terms of the user turns of the conversations."""
    return load(spark, d, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("qid"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(L.TERM), 0))).alias("term")).distinct()


def _asked_of(said: DataFrame, df: DataFrame, docs: DataFrame) -> DataFrame:
    """qid, term, weight of questions (qid, term), all their terms, by how many texts (df) have a term."""
    n = docs.agg(F.count(F.lit(1)).alias("texts"))
    asked = said.join(df, "term").crossJoin(F.broadcast(n))  # one row
    return asked.select("qid", "term", F.log(1 + F.col("texts") / F.col("df")).alias("weight"))


def questions(spark: SparkSession, d: str, root: str) -> DataFrame:
    """qid, term, weight: the user turns of the conversations as questions to the index."""
    said = _said(spark, d)
    return _asked_of(said, fulltext.frequencies(spark, root, said), load(spark, d, "documents"))


def index(spark: SparkSession, d: str) -> str:
    """A new index of all documents."""
    root = versions.shared_folder(spark, "index")
    fulltext.add(spark, root, _docs(spark, d).withColumn("deleted", F.lit(False)))
    return root


@query(f"WITH {_QUESTIONS} SELECT qid, id, round(sum(weight * tf / (1 + ln(1 + length))), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(sum(weight * tf / (1 + ln(1 + length))), 6) DESC, id) AS rank FROM ask JOIN post USING (term) GROUP BY qid, id QUALIFY rank <= 40")
def r01_many_questions(spark, d):
    """The 40 best texts of every user turn, all turns answered over shelves of all documents; shelves that can't matter aren't read."""
    place, docs = versions.shared_folder(spark, "shelves"), _docs(spark, d)
    shelves.write(docs, place)
    return shelves.search(spark, place, _asked_of(_said(spark, d), shelves.frequencies(spark, place), docs))


#: Patterns of ILIKE; the fourth is a user's term whose wildcard is a plain character, the last has no trigram.
PATTERNS = ["%trash%", "%rights reserved%", "%und d_r%", trigrams.containing("100%"), trigrams.containing("e_e"), "the %", "%q%"]


@query(" UNION ALL ".join(f"SELECT {i} AS pattern, doc_id FROM documents WHERE text ILIKE '{p}' ESCAPE '\\'" for i, p in enumerate(PATTERNS)))
def f02_trigrams(spark, d):
    """Texts by pattern through an index of trigrams; only texts with all trigrams of a pattern are read."""
    path = versions.shared_folder(spark, "trigrams")
    trigrams.build(_docs(spark, d), path)
    return trigrams.matches(spark, path, _docs(spark, d), PATTERNS).select("pattern", F.col("id").alias("doc_id"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """Entities and their names: passages by their first five words, customers, parts by brand."""
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0), 1, 5)
    item = load(spark, d, "benchmark").select(F.concat(F.lit("item:"), "item_id").alias("entity"), F.array_join(words, " ").alias("name"))
    customer = load(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("entity"), F.col("c_name").alias("name"))
    part = load(spark, d, "part").select(F.concat(F.lit("brand:"), "p_brand").alias("entity"), F.col("p_name").alias("name"))
    return item.unionByName(customer).unionByName(part)


@query(
    r"WITH n AS (SELECT DISTINCT entity, lower(name) AS name FROM (SELECT 'item:' || item_id AS entity, array_to_string(regexp_extract_all(text, '[^\x20\x09-\x0D]+')[1:5], ' ') AS name FROM benchmark "
    "UNION ALL SELECT 'customer:' || c_custkey, c_name FROM customer UNION ALL SELECT 'brand:' || p_brand, p_name FROM part) WHERE length(name) >= 2), t AS (SELECT doc_id, lower(text) AS low FROM documents) "
    "SELECT DISTINCT doc_id, entity, 0.85::DOUBLE AS confidence FROM t JOIN n ON contains(low, name)"
)
def j08_dictionary(spark, d):
    """Texts linked to every entity with a name in them, all names looked for at once."""
    return dictionary.mentions(_docs(spark, d), names(spark, d)).select(F.col("id").alias("doc_id"), "entity", F.lit(0.85).alias("confidence"))


@query(
    "SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, "
    "row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank "
    "FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id AND v.label = q.label WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10"
)
def r03_filtered_vectors(spark, d):
    """For every twentieth vector the ten nearest of its label, through the inverted file in exact mode."""
    root = versions.shared_folder(spark, "vectors")
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    vector_index.build(spark, root, rows, ("label",), k=10)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), "label")
    best = vector_index.search(spark, root, asked, k=11, exact=True)[0]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return best.select("query_id", "id", F.round("score", 6).alias("score"), place.alias("rank")).where("rank <= 10")


#: A question and what it was expanded to; how a variant counts: by its tokens, and single words by how many texts have them.
EXPANDED = ["license version", "the of and", "und der", "the", "trash", "LIC-2024 license"]
_TITLE_HITS = " AND ".join(f"contains(lower(string_split(text, chr(10))[1]), '{t}')" for t in L.terms_of(EXPANDED[0]))


@query(
    f"WITH {_cover_sql([(v, R.variant_weight(v, EXPANDED[0])) for v in EXPANDED])}, n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(DISTINCT id) AS df FROM tok GROUP BY term), "
    "w AS (SELECT variant, CASE WHEN min(weight) = 0.55 AND max(df) > 0.2 * max(n) THEN 0.25 ELSE min(weight) END AS w FROM ask LEFT JOIN df USING (term), n GROUP BY variant), "
    "r AS (SELECT variant, id, row_number() OVER (PARTITION BY variant ORDER BY round(score, 9) DESC, id) AS rank FROM cover QUALIFY rank <= 40), "
    f"s AS (SELECT source, id, w / (60 + rank) * CASE WHEN variant = 0 AND {_TITLE_HITS} THEN 1.15 ELSE 1 END AS score FROM r JOIN w USING (variant) JOIN documents ON doc_id = id), "
    "b AS (SELECT source, id, round(max(score), 9) AS score FROM s GROUP BY source, id) "
    "SELECT source, id, score FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, id) = 1 ORDER BY score DESC, id LIMIT 10"
)
def r10_weighted_variants(spark, d):
    """Lists of all variants of a question in one plan, weighted, with a boost for titles that have the whole question; the best of each document (source)."""
    asked = spark.createDataFrame(_asked([(v, R.variant_weight(v, EXPANDED[0])) for v in EXPANDED]), "variant int, weight double, term string, slot int, needed int")
    posts = fulltext.occurrences(_docs(spark, d), sorted({t for v in EXPANDED for t in L.terms_of(v)}))
    texts = load(spark, d, "documents").agg(F.count(F.lit(1)).alias("texts"))
    often = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = R.frequent_singles_down(asked.join(often, "term", "left").groupBy("variant").agg(F.min("weight").alias("w"), F.max("df").alias("df")).crossJoin(F.broadcast(texts)))
    found = fulltext.covers(posts, asked, max(len(L.terms_of(v)) for v in EXPANDED))
    place = F.row_number().over(Window.partitionBy("variant").orderBy(F.desc(F.round("score", 9)), "id"))
    ranked = found.withColumn("rank", place).where("rank <= 40").join(F.broadcast(weights), "variant").select("variant", "id", (F.col("w") / (60 + F.col("rank"))).alias("score"))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.lower(T.title_of(F.col("text"))).alias("title"))
    whole = F.lit(True)
    for t in L.terms_of(EXPANDED[0]):
        whole = whole & F.contains("title", F.lit(t))
    rows = docs.join(F.broadcast(ranked), "id").withColumn("score", F.col("score") * F.when((F.col("variant") == 0) & whole, 1.15).otherwise(1.0))  # 40 of each variant
    best = rows.groupBy("source", "id").agg(F.round(F.max("score"), 9).alias("score"))
    one = best.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "id"))).where("r = 1")
    return one.select("source", "id", "score").orderBy(F.desc("score"), "id").limit(10)


#: A question whose first tokens a snippet is cut around: the first of them, in the question's order, that the text has.
ASKING = "scum trash license of the und"


@query(
    "WITH x AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS t FROM documents), p AS (SELECT *, greatest(coalesce("
    + ", ".join(f"nullif(strpos(lower(t), '{w}'), 0)" for w in ASKING.split()[:5])
    + ", 1) - 1 - 40, 0) AS skip FROM x) SELECT doc_id, CASE WHEN t = '' THEN '' ELSE CASE WHEN skip > 0 THEN '…' ELSE '' END || substr(t, skip + 1, 220) || CASE WHEN skip + 220 < length(t) THEN '…' ELSE '' END END AS snippet FROM p"
)
def f15_snippet_tokens(spark, d):
    """A stretch of every text around the first of five tokens of a question that it has."""
    return load(spark, d, "documents").select("doc_id", T.snippet_around(F.col("text"), ASKING.split()[:5]).alias("snippet"))


@query("SELECT event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 10")
def a10_latest_ten(spark, d):
    order = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return load(spark, d, "events").select("event_type", "event_id", "ts").withColumn("r", F.row_number().over(order)).where("r <= 10").drop("r")


@query("SELECT lang, doc_id, CASE WHEN l.quality <> 1 THEN 'quality' ELSE 'primary' END AS failed FROM documents d JOIN labels l USING (doc_id) WHERE NOT (l.quality = 1 AND l.toxic = 0)")
def a16_failures(spark, d):
    """The rows behind the rates of an evaluation: what failed, and at which gate."""
    rows = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id")
    good = F.col("quality") == 1
    return rows.where(~(good & (F.col("toxic") == 0))).select("lang", "doc_id", F.when(~good, "quality").otherwise("primary").alias("failed"))


@query("SELECT d.doc_id, d.lang, d.source, l.quality, d.n_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality >= 0.45 AND (text ILIKE '%trash%' OR text ILIKE '%the%' OR source ILIKE '%rc7%') AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.label = 3) ORDER BY l.quality DESC, d.n_chars DESC, d.doc_id LIMIT 25")
def r12_injection_by_quality(spark, d):
    """Candidates that a similar-incident search adds by their texts: the best by quality, then length, without those already listed."""
    good = load(spark, d, "labels").where("quality >= 0.45").select("doc_id", "quality")
    hit = F.ilike("text", F.lit("%trash%")) | F.ilike("text", F.lit("%the%")) | F.ilike("source", F.lit("%rc7%"))
    rows = load(spark, d, "documents").where(hit).select("doc_id", "lang", "source", "n_chars").join(good, "doc_id")
    listed = load(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id"))
    return rows.join(listed, "doc_id", "left_anti").select("doc_id", "lang", "source", "quality", "n_chars").orderBy(F.desc("quality"), F.desc("n_chars"), "doc_id").limit(25)
