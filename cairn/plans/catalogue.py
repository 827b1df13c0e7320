"""The queries of the engine over the test tables, and their DuckDB SQL.

Tables stand in for a knowledge base: orders for tickets (date, status, priority as component, customer as
assignee), documents for pages, embeddings for their vectors, labels for extracted frames, events for
the query log, conversations for questions and answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import aggregate as A
from cairn.operators import rank as R
from cairn.operators import upsert as U
from cairn.operators.lexical import terms_of
from cairn.plans.registry import ORACLE_SQL, QUERIES, query
from cairn.sources.tables import load

# ---- flagship: lexical and vector lists, fused, hydrated

#: Terms of the lexical list, and the vector whose neighbours are the other list.
TERMS, QUERY_VEC = ["the", "und", "que"], 0


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    one = vectors.where(F.col("id") == QUERY_VEC).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return R.lexical(docs, TERMS, 40), R.vector_top(vectors, one, 40)


_LEX = """lex AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
  SELECT doc_id AS id, round((len(string_split(lower(coalesce(text, '')), 'the')) + len(string_split(lower(coalesce(text, '')), 'und')) + len(string_split(lower(coalesce(text, '')), 'que')) - 3)
         / (1 + ln(1 + length(coalesce(text, '')))), 6) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, id LIMIT 40)"""
_VEC = """vec AS (SELECT v.vec_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
         row_number() OVER (ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.vec_id <> 0 QUALIFY rank <= 40)"""


def _rrf_sql(a: float, b: float) -> str:
    return f"rrf AS (SELECT id, round(sum(part), 9) AS score FROM (SELECT id, {a} / (60 + rank) AS part FROM lex UNION ALL SELECT id, {b} / (60 + rank) FROM vec) GROUP BY id)"


@query(f"WITH {_LEX}, {_VEC}, {_rrf_sql(1.0, 1.0)} SELECT r.id AS doc_id, r.score, d.lang, d.source FROM rrf r JOIN documents d ON d.doc_id = r.id ORDER BY score DESC, doc_id LIMIT 20")
def r04_rrf(spark, d):
    lex, vec = _lists(spark, d)
    docs = load(spark, d, "documents").select("doc_id", "lang", "source")
    hits = R.fused([(lex, 1.0), (vec, 1.0)])
    return docs.join(F.broadcast(hits), docs["doc_id"] == hits["id"]).select("doc_id", "score", "lang", "source").orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH {_LEX}, {_VEC}, {_rrf_sql(1.35, 0.55)} SELECT id, score FROM rrf")
def r04_rrf_checklist(spark, d):
    lex, vec = _lists(spark, d)
    return R.fused([(lex, 1.35), (vec, 0.55)])


@query(f"WITH {_LEX} SELECT id, score, rank FROM lex")
def r01_lexical(spark, d):
    return _lists(spark, d)[0]


@query(f"WITH {_VEC} SELECT id, round(score, 6) AS score, rank FROM vec")
def r03_vector_topk(spark, d):
    return _lists(spark, d)[1].select("id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_LEX}, {_VEC}, {_rrf_sql(1.0, 1.0)}, b AS (SELECT r.id, round(r.score + 0.15 * ((contains(lower(coalesce(d.text, '')), 'trash'))::INT + (contains(lower(coalesce(d.text, '')), 'license'))::INT) + CASE WHEN d.source = 'src0' THEN 0.02 ELSE 0 END, 9) AS score FROM rrf r JOIN documents d ON d.doc_id = r.id) SELECT id, score FROM b")
def r06_exact_boost(spark, d):
    lex, vec = _lists(spark, d)
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    rows = docs.join(F.broadcast(R.fused([(lex, 1.0), (vec, 1.0)])), "id")
    tokens = F.array(F.lit("trash"), F.lit("license"))
    return rows.select("id", F.round(F.col("score") + 0.15 * T.hits(tokens, F.coalesce("text", F.lit(""))) + F.when(F.col("source") == "src0", 0.02).otherwise(0.0), 9).alias("score"))


@query(f"WITH {_LEX}, {_VEC}, {_rrf_sql(1.0, 1.0)} SELECT id, score FROM rrf WHERE (SELECT max(score) FROM rrf) >= 0.012 ORDER BY score DESC, id LIMIT 10")
def f07_gate(spark, d):
    lex, vec = _lists(spark, d)
    return R.gated(R.fused([(lex, 1.0), (vec, 1.0)]), 10)


@query(f"WITH {_LEX}, {_VEC}, {_rrf_sql(1.0, 1.0)} SELECT d.source, r.id, r.score, CASE WHEN r.score >= 0.05 THEN 'strong' WHEN r.score >= 0.02 THEN 'medium' ELSE 'weak' END AS label FROM rrf r JOIN documents d ON d.doc_id = r.id QUALIFY row_number() OVER (PARTITION BY d.source ORDER BY r.score DESC, r.id) = 1")
def r08_dedupe(spark, d):
    lex, vec = _lists(spark, d)
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    rows = A.best_per_key(docs.join(F.broadcast(R.fused([(lex, 1.0), (vec, 1.0)])), "id"), "source", "score", "id")
    return rows.select("source", "id", "score", R.trust_label(F.col("score"), F.lit(False)).alias("label"))


# ---- aggregates over tickets


def _counted(name: str, kind: str, column: str, sql: str):
    def f(spark, d):
        return A.counted(load(spark, d, "orders"), A.bucket(kind, F.col(column)))

    f.__name__ = name
    query(f"WITH g AS (SELECT {sql} AS bucket, count(*) AS n FROM orders GROUP BY 1) SELECT bucket, n, round(n / (SELECT sum(n) FROM g), 4) AS share FROM g ORDER BY n DESC, bucket LIMIT 200")(f)


_counted("a01_year", "year", "o_orderdate", "coalesce(strftime(o_orderdate, '%Y'), '(unknown)')")
_counted("a01_month", "month", "o_orderdate", "coalesce(strftime(o_orderdate, '%Y-%m'), '(unknown)')")
for _name, _column in (("a01_status", "o_orderstatus"), ("a01_component", "o_orderpriority"), ("a01_assignee", "o_custkey")):
    _counted(_name, "text", _column, f"CASE WHEN {_column} IS NULL OR trim({_column}::VARCHAR) IN ('', '-') THEN '(empty)' ELSE trim({_column}::VARCHAR) END")


@query("SELECT 'total' AS bucket, count(*) AS n, 1.0::DOUBLE AS share FROM orders")
def a01_total(spark, d):
    return A.counted(load(spark, d, "orders"), F.lit("total")).select("bucket", "n", F.col("share").cast("double").alias("share"))


@query("WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31 23:59:59' AND (o_orderpriority = 'high' OR contains(lower(o_orderpriority), 'high')) GROUP BY 1) SELECT bucket, n, round(n / (SELECT sum(n) FROM g), 4) AS share FROM g")
def a01_filtered(spark, d):
    rows = load(spark, d, "orders").where("o_orderdate BETWEEN TIMESTAMP_NTZ '1995-01-01 00:00:00' AND TIMESTAMP_NTZ '1996-12-31 23:59:59'")
    rows = rows.where((F.col("o_orderpriority") == "high") | F.contains(F.lower("o_orderpriority"), F.lit("high")))
    return A.counted(rows, A.bucket("month", F.col("o_orderdate")))


#: Label, pattern; the first that a text has is its type.
TYPES = [("licence", "license|licence"), ("junk", "[#$%&]{3}"), ("table", r" \| "), ("shout", "!!"), ("notice", "copyright|rights reserved")]


@query(
    "SELECT label, count(*) AS n FROM (SELECT coalesce("
    + ", ".join("CASE " + " ".join(f"WHEN regexp_matches(lower({t}), '{p}') THEN '{n}'" for n, p in TYPES) + " END" for t in ("string_split(coalesce(text, ''), chr(10))[1]", "left(coalesce(text, ''), 2500)"))
    + ", 'other') AS label FROM documents) GROUP BY label"
)
def a01_issue_type(spark, d):
    text = F.coalesce("text", F.lit(""))
    return load(spark, d, "documents").select(T.classify(T.title_of(text), text, TYPES, "other").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 5")
def a03_samples(spark, d):
    return A.samples(load(spark, d, "documents").select("lang", "doc_id", "n_chars"), "lang", "doc_id", 5)


@query("SELECT n.n_name, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 4) AS share FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name")
def a04_entity_share(spark, d):
    orders = load(spark, d, "orders").select("o_custkey")
    total = orders.agg(F.count(F.lit(1)).alias("total"))
    rows = orders.join(load(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("n").alias("n"))
    return rows.join(F.broadcast(total)).select("n_name", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


@query("WITH t AS (SELECT unnest(regexp_extract_all(p_name, '[0-9A-Za-z가-힣]{2,}')) AS token FROM part), g AS (SELECT token, count(*) AS n FROM t WHERE NOT regexp_full_match(token, '[0-9]+') AND lower(token) NOT IN ('the', 'part') GROUP BY token) SELECT token, n, round(n / (SELECT count(*) FROM part), 4) AS share FROM g ORDER BY n DESC, token LIMIT 100")
def a05_title_tokens(spark, d):
    return A.token_frequency(load(spark, d, "part"), F.col("p_name"), ["the", "part"])


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def a06_source_counts(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs"))


@query("SELECT 'lang' AS facet, lang AS value FROM documents WHERE lang IS NOT NULL UNION SELECT 'source', source FROM documents WHERE source IS NOT NULL")
def a07_facets(spark, d):
    docs = load(spark, d, "documents")
    return docs.select(F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("facet", "value")).where("value IS NOT NULL").distinct()


@query("SELECT d.source, count(*) AS documents, count(l.doc_id) AS framed, count(e.vec_id) AS embedded, least(100, round(100.0 * count(e.vec_id) / count(*), 1)) AS pct FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source")
def a08_progress(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "source")
    rows = rows.join(load(spark, d, "labels").select(F.col("doc_id").alias("l")).distinct(), F.col("doc_id") == F.col("l"), "left").join(load(spark, d, "embeddings").select(F.col("vec_id").alias("e")), F.col("doc_id") == F.col("e"), "left")
    rows = rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("l").alias("framed"), F.count("e").alias("embedded"))
    return rows.withColumn("pct", F.least(F.lit(100.0), F.round(100.0 * F.col("embedded") / F.col("documents"), 1)))


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) AS n, count(*) FILTER (WHERE ts > now - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (WHERE ts > now - INTERVAL 24 HOUR) AS last_day, round(avg(value) FILTER (WHERE ts > now - INTERVAL 24 HOUR), 1) AS avg_day FROM events, m GROUP BY event_type")
def a09_query_stats(spark, d):
    events = load(spark, d, "events").select("ts", "event_type", "value")
    rows = events.join(F.broadcast(events.agg(F.max("ts").alias("now"))))
    hour, day = F.col("ts") > F.col("now") - F.expr("INTERVAL 1 HOUR"), F.col("ts") > F.col("now") - F.expr("INTERVAL 24 HOUR")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(hour).alias("last_hour"), F.count_if(day).alias("last_day"), F.round(F.avg(F.when(day, F.col("value"))), 1).alias("avg_day"))


@query("SELECT count(*) AS total, round(avg(quality), 3) AS avg_quality, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS both_slots, count(*) FILTER (WHERE quality >= 0.5) AS good FROM labels")
def a11_frame_stats(spark, d):
    q, t = F.col("quality"), F.col("toxic")
    return load(spark, d, "labels").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(q), 3).alias("avg_quality"), F.count_if((q == 1) & (t == 0)).alias("both_slots"), F.count_if(q >= 0.5).alias("good"))


@query("SELECT t AS name, n, n >= 1000 AS ready FROM (SELECT 'documents' AS t, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'events', count(*) FROM events)")
def a12_readiness(spark, d):
    rows = None
    for name in ("documents", "embeddings", "labels", "events"):
        one = load(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n", (F.col("n") >= 1000).alias("ready"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


#: Days of the periods that are priced; a part is a field with its size as units of seven days, its type the price group, dear types have no price.
PERIODS = (7, 14, 30)
_PRICED = "p AS (SELECT p_type AS grp, round(avg(p_retailprice), 2) AS price FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_type), d(days) AS (VALUES " + ", ".join(f"({x})" for x in PERIODS) + "), x AS (SELECT days, p_partkey AS field, round_even(p_size * (days / 7), 0) AS units, 0.25 * (days / 7) AS mm, price * round_even(p_size * (days / 7), 0) AS cost FROM part CROSS JOIN d LEFT JOIN p ON p.grp = p_type)"


def _priced(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    prices = part.where("p_type <> 'ECONOMY'").groupBy(F.col("p_type").alias("grp")).agg(F.round(F.avg("p_retailprice"), 2).alias("price"))
    rows = part.select(F.col("p_partkey").alias("field"), "p_size", F.col("p_type").alias("grp"), F.explode(F.array(*map(F.lit, PERIODS))).alias("days")).join(prices, "grp", "left")
    scale = F.col("days") / 7
    units = F.bround(F.col("p_size") * scale, 0)
    return rows.select("days", "field", units.alias("units"), (0.25 * scale).alias("mm"), (F.col("price") * units).alias("cost"))


@query(f"WITH {_PRICED} SELECT days, field, CAST(units AS BIGINT) AS units, round(mm, 4) AS mm, round(cost, 2) AS cost FROM x")
def j10_capacity_pricing(spark, d):
    return _priced(spark, d).select("days", "field", F.col("units").cast("long").alias("units"), F.round("mm", 4).alias("mm"), F.round("cost", 2).alias("cost"))


@query(f"WITH {_PRICED} SELECT days, CAST(sum(units) AS BIGINT) AS units, round(sum(mm), 2) AS mm, round(sum(cost), 0) AS cost FROM x GROUP BY days")
def a13_capacity_totals(spark, d):
    return _priced(spark, d).groupBy("days").agg(F.sum("units").cast("long").alias("units"), F.round(F.sum("mm"), 2).alias("mm"), F.round(F.sum("cost"), 0).alias("cost"))


@query("WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT n, round(avg(value), 6) AS mean, max(value) AS largest, min(value) FILTER (WHERE i = round_even(0.5 * (n - 1), 0)) AS p50, min(value) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)) AS p95, min(value) FILTER (WHERE i = round_even(0.99 * (n - 1), 0)) AS p99 FROM s GROUP BY n")
def a14_latency_percentiles(spark, d):
    return A.nearest_rank(load(spark, d, "events"), "value", (0.5, 0.95, 0.99)).withColumn("mean", F.round("mean", 6))


_HITS = "h AS (SELECT q.vec_id AS query_id, q.label AS want, v.vec_id AS id, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id QUALIFY rank <= 3)"


_HIT_RATES = f"WITH {_HITS} SELECT want AS label, count(DISTINCT query_id) AS queries, round(avg(hit), 4) AS hit_at_3, round(avg(good / 3), 4) AS precision_at_3 FROM (SELECT query_id, want, max((label = want)::INT) AS hit, sum((label = want)::INT) AS good FROM h GROUP BY ALL) GROUP BY want"


@query(_HIT_RATES)
def a15_hit_at_3(spark, d):
    """Every twentieth vector is a query, so the set grows with the table; every vector is searched."""
    return _hit_at_3(load(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)



def _hit_at_3(vectors: DataFrame, is_query: Column) -> DataFrame:
    labels = vectors.select(F.col("vec_id").alias("id"), "label")
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    top = R.vector_top(rows, vectors.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), 3)
    top = top.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("want")), "query_id")
    each = top.groupBy("query_id", "want").agg(F.max((F.col("label") == F.col("want")).cast("int")).alias("hit"), F.sum((F.col("label") == F.col("want")).cast("int")).alias("good"))
    return each.groupBy(F.col("want").alias("label")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("hit"), 4).alias("hit_at_3"), F.round(F.avg(F.col("good") / 3), 4).alias("precision_at_3"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS support, count(*) FILTER (WHERE event_type = 'error') AS counter, round((count(*) FILTER (WHERE event_type = 'purchase') + 1) / (count(*) FILTER (WHERE event_type IN ('purchase', 'error')) + 2), 3) AS confidence FROM events GROUP BY user_id")
def a20_confidence(spark, d):
    e = F.col("event_type")
    rows = load(spark, d, "events").groupBy("user_id").agg(F.count_if(e == "purchase").alias("support"), F.count_if(e == "error").alias("counter"))
    return rows.withColumn("confidence", A.laplace(F.col("support"), F.col("counter")))


# ---- filters and lookups


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND source = 'src1'")
def f01_facets(spark, d):
    return load(spark, d, "documents").where((F.col("lang") == "en") & (F.col("source") == "src1")).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%tr_sh%' OR source ILIKE '%rc19%'")
def f02_ilike_or(spark, d):
    return load(spark, d, "documents").where(F.ilike("text", F.lit("%license%")) | F.ilike("text", F.lit("%tr_sh%")) | F.ilike("source", F.lit("%rc19%"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[a-z0-9가-힣]{2,}'), ['the', 'of', 'license'])")
def f03_containment(spark, d):
    return load(spark, d, "documents").where(F.size(F.array_except(F.array(*map(F.lit, ("the", "of", "license"))), T.token_set(F.col("text")))) == 0).select("doc_id")


@query("SELECT want, doc_id, source FROM (VALUES (3, 'src0'), (5, 'src1'), (999999999, 'src2')) w(want, src) JOIN documents d ON d.doc_id = w.want QUALIFY row_number() OVER (PARTITION BY want ORDER BY (source = src)::INT DESC, doc_id) = 1")
def f10_lookup_fallback(spark, d):
    """The wanted source if it has the id, else any."""
    want = spark.createDataFrame([(3, "src0"), (5, "src1"), (999999999, "src2")], "want long, src string")
    rows = load(spark, d, "documents").select("doc_id", "source").join(F.broadcast(want), F.col("doc_id") == F.col("want"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("want").orderBy(F.desc((F.col("source") == F.col("src")).cast("int")), "doc_id"))).where("r = 1").select("want", "doc_id", "source")


_SNIPPETS = "SELECT doc_id, CASE WHEN p > 41 THEN '...' ELSE '' END || substr(flat, greatest(p - 40, 1), 220) || CASE WHEN length(flat) >= greatest(p - 40, 1) + 220 THEN '...' ELSE '' END AS snippet FROM (SELECT doc_id, flat, instr(lower(flat), 'the') AS p FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents))"


@query(_SNIPPETS)
def f15_snippet(spark, d):
    """Snippets of the documents of all languages."""
    return load(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), "the").alias("snippet"))



@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '…' ELSE text END AS short FROM documents")
def f16_truncate(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", F.when(F.length(t) > 120, F.concat(F.left(t, F.lit(120)), F.lit("…"))).otherwise(t).alias("short"))


# ---- joins


@query("SELECT d.doc_id, d.source, l.quality, e.label FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.lang = 'en'")
def j01_inner(spark, d):
    docs = load(spark, d, "documents").where("lang = 'en'").select("doc_id", "source")
    return docs.join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id").join(load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")


@query("SELECT r.rank, d.doc_id, d.n_chars FROM (VALUES (1, 9), (2, 3), (3, 7), (4, 1)) r(rank, id) JOIN documents d ON d.doc_id = r.id")
def j03_hydrate(spark, d):
    ranked = spark.createDataFrame([(1, 9), (2, 3), (3, 7), (4, 1)], "rank int, id long")
    return load(spark, d, "documents").join(F.broadcast(ranked), F.col("doc_id") == F.col("id")).select("rank", "doc_id", "n_chars")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def j05_pending_anti(spark, d):
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents d WHERE source = 'src0' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j06_unframed(spark, d):
    return load(spark, d, "documents").where("source = 'src0'").select("doc_id").join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT n.n_name, count(o.o_orderkey) AS n FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_name")
def j14_entity_counts(spark, d):
    orders = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("k"))
    each = load(spark, d, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("k").alias("n"))
    return load(spark, d, "nation").join(each, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


#: Aliases of the entities that are linked to texts.
ALIASES = [(1, "trash"), (1, "scum"), (2, "license"), (3, "copyright"), (4, "idiot")]


@query("WITH a(entity_id, alias) AS (VALUES " + ", ".join(str(x) for x in ALIASES) + ") SELECT DISTINCT d.doc_id, a.entity_id, 0.85::DOUBLE AS confidence FROM documents d JOIN a ON contains(lower(d.text), a.alias)")
def j08_entity_linker(spark, d):
    """Aliases are a fixed list, so a text looks for each: no pairs of rows are made that don't link."""
    low = F.lower("text")
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(a)), F.lit(i)) for i, a in ALIASES])))
    return load(spark, d, "documents").select("doc_id", F.explode(found).alias("entity_id"), F.lit(0.85).alias("confidence"))


@query("WITH o AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents), l AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5('changed') ELSE h END AS h FROM o WHERE doc_id % 11 <> 0) SELECT o.doc_id, o.h FROM o LEFT JOIN l ON l.doc_id = o.doc_id WHERE o.h IS DISTINCT FROM l.h")
def j12_manifest_diff(spark, d):
    ops = load(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    local = ops.where("doc_id % 11 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 0, F.md5(F.lit("changed"))).otherwise(F.col("h")))
    return U.manifest_diff(ops, local, "doc_id", "h")


@query("WITH u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') SELECT u.conv_id, u.turn, arg_min(a.text, a.turn) AS answer FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn > u.turn GROUP BY u.conv_id, u.turn")
def j13_first_answer(spark, d):
    """The next answer in the conversation: a running minimum from behind instead of a range join."""
    rows = load(spark, d, "conversations")
    behind = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rangeBetween(Window.unboundedPreceding, -1)
    near = F.min(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).over(behind)
    return rows.withColumn("next", near).where("role = 'user'").select("conv_id", "turn", F.col("next.text").alias("answer"))


# ---- similar incidents, buckets, packing

BUCKETS = [(1, ["the of", "and in"], ["trash", "scum idiot"], 0.8), (2, ["und der und", "die ist"], ["idiot"], 0.6), (3, ["license version", "public license", "copyright"], ["scum"], 0.9), (4, ["que la", "de"], [], None)]


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_SIGNAL = "list_filter({0}, lambda s: len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[a-z0-9가-힣]{{2,}}')), obs)) >= ceil(len(list_distinct(regexp_extract_all(lower(s), '[a-z0-9가-힣]{{2,}}'))) / 2))"
_BUCKET_SCORES = (
    "WITH b(bucket_id, signals, counter, confidence) AS (VALUES " + ", ".join(f"({i}, {_sql_list(s)}, {_sql_list(c)}::VARCHAR[], {'NULL' if f is None else f}::DOUBLE)" for i, s, c, f in BUCKETS) + "), o AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9가-힣]{2,}')) AS obs FROM documents), "
    f"m AS (SELECT doc_id, bucket_id, coalesce(confidence, 0.5) AS confidence, len(signals) AS total, len({_SIGNAL.format('signals')}) AS matched, len({_SIGNAL.format('counter')}) AS against FROM o, b) "
    "SELECT doc_id, bucket_id, round(least(greatest(0.6 * least(matched, 4) / least(total, 4) + 0.4 * confidence - 0.5 * against, 0), 1), 3) AS score FROM m"
)


@query(_BUCKET_SCORES)
def r15_bucket_score(spark, d):
    """Scores of the documents of all sources."""
    return _bucket_scores(spark, load(spark, d, "documents"))



def _bucket_scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    buckets = spark.createDataFrame(BUCKETS, "bucket_id int, signals array<string>, counter array<string>, confidence double")
    buckets = buckets.withColumns({c: R.signal_tokens(F.col(c)) for c in ("signals", "counter")})
    tokens = sorted({t for _, signals, counter, _ in BUCKETS for s in [*signals, *counter] for t in terms_of(s)})
    return R.bucket_scores(docs.select("doc_id", T.token_set(F.col("text")).alias("obs")), buckets, tokens).select("doc_id", "bucket_id", "score")


@query("WITH x AS (SELECT d.doc_id, l.quality::DOUBLE AS q, l.toxic = 0 AS ok, (contains(lower(text), 'the'))::INT + (contains(lower(text), 'of'))::INT + (contains(lower(text), 'and'))::INT + (contains(lower(text), 'license'))::INT AS hits, lang = 'en' AS place FROM documents d JOIN labels l ON l.doc_id = d.doc_id), s AS (SELECT *, round(least(0.2 + 0.15 * least(hits, 3) + 0.25 * least(q, 1.0) + CASE WHEN ok THEN 0.2 ELSE 0 END + CASE WHEN place THEN 0.1 ELSE 0 END + CASE WHEN hits >= 3 THEN 0.1 ELSE 0 END, 1.0), 3) AS score FROM x) SELECT doc_id, score, round(CASE WHEN hits >= 3 THEN 0.55 + 0.05 * least(hits - 3, 4) ELSE 0.12 * hits END::DOUBLE, 6) AS boost, CASE WHEN NOT ok OR q < 0.25 THEN 'abstain' WHEN score >= 0.7 THEN 'possible' WHEN score >= 0.45 THEN 'conditional' ELSE 'not-recommended' END AS label FROM s")
def r14_applicability(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "lang", "text").join(load(spark, d, "labels"), "doc_id")
    rows = rows.select("doc_id", F.col("quality").cast("double").alias("q"), (F.col("toxic") == 0).alias("ok"), T.hits(F.array(*map(F.lit, ("the", "of", "and", "license"))), F.col("text")).alias("hits"), (F.col("lang") == "en").alias("place"))
    score = R.applicability(F.col("hits"), F.col("q"), F.col("ok"), F.col("place"), F.col("hits"))
    return rows.withColumn("score", score).select("doc_id", "score", F.round(R.match_boost(F.col("hits")), 6).alias("boost"), R.applicability_label(F.col("score"), F.col("q"), F.col("ok")).alias("label"))


@query("SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderdate IS NOT NULL ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def r18_dated_listing(spark, d):
    rows = load(spark, d, "orders").where("o_orderdate IS NOT NULL").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return R.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 50, 100)


@query("WITH h AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, (length(text) + 1) // 2 + 16 AS est FROM documents WHERE text IS NOT NULL), r AS (SELECT *, sum(est) OVER (PARTITION BY query_id ORDER BY rank) AS running FROM h) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, CAST(running AS BIGINT) AS running, 'C' || rank AS cite FROM r WHERE running <= 5000 OR rank = 1")
def r22_pack(spark, d):
    rows = load(spark, d, "documents").where("text IS NOT NULL").select(F.col("source").alias("query_id"), "doc_id", (F.floor((F.length("text") + 1) / 2) + 16).cast("long").alias("est"))
    # every hit costs 16 at least, so none behind this rank fits; tasks cut their sources to it before the shuffle
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).where(F.col("rank") <= 5000 // 16)
    return R.packed(rows, 5000).select("query_id", "doc_id", "rank", "running", "cite")


# ---- upserts, hashes, text functions


@query("WITH o AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256('new' || coalesce(text, '')) ELSE sha256(coalesce(text, '')) END AS h FROM documents WHERE doc_id % 4 <> 0) SELECT doc_id, CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'keep' WHEN o.h = n.h THEN 'skip' ELSE 'update' END AS action, CASE WHEN o.h IS NULL THEN 1 WHEN n.h IS NOT NULL AND o.h <> n.h THEN 2 ELSE 1 END AS version FROM o FULL JOIN n USING (doc_id)")
def u01_upsert_plan(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit(1).alias("version"))
    new = docs.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat(F.lit("new"), "text"), 256)).otherwise(F.sha2("text", 256)).alias("content_hash"))
    return U.plan(old, new, ["doc_id"])


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(coalesce(text, ''))")
def u05_dedup(spark, d):
    """First of each set of equal texts; only hashes are shuffled."""
    rows = load(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query("SELECT doc_id, sha256(string_split(coalesce(text, ''), chr(10))[1] || chr(10) || coalesce(text, '') || chr(10) || '{}') AS content_hash, source || ':' || doc_id AS stable_id FROM documents")
def s08_content_hash(spark, d):
    text = F.coalesce("text", F.lit(""))
    return load(spark, d, "documents").select("doc_id", T.content_hash(T.title_of(text), text).alias("content_hash"), T.stable_id(F.col("source"), F.col("doc_id").cast("string")).alias("stable_id"))


@query("SELECT 'customer' AS name, c_custkey::VARCHAR AS id, md5(concat_ws('|', c_custkey, c_name, c_nationkey, c_mktsegment)) AS hash FROM customer UNION ALL SELECT 'part', p_partkey::VARCHAR, md5(concat_ws('|', p_partkey, p_name, p_brand, p_size)) FROM part")
def s14_manifest(spark, d):
    one = lambda name, key, cols: load(spark, d, name).select(F.lit(name).alias("name"), F.col(key).cast("string").alias("id"), F.md5(F.concat_ws("|", *cols)).alias("hash"))
    return one("customer", "c_custkey", ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")).unionByName(one("part", "p_partkey", ("p_partkey", "p_name", "p_brand", "p_size")))


@query("SELECT doc_id, i - 1 AS ordinal, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL) WHERE trim(lines[i]) <> ''")
def x06_chunks(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line")).where(F.trim("line") != "").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "line")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN o_orderdate::DATE END AS day FROM orders")
def x05_dates(spark, d):
    """Dates of orders as people write them; every fourth is no date, every fourth has none."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("on "), F.date_format(day, "yyyy-MM-dd"), F.lit(" it"))).when(k == 1, F.date_format(day, "yyyy/M/d")).when(k == 2, F.concat(F.date_format(day, "yyyy"), F.lit(".02.30"))).otherwise("none")
    return load(spark, d, "orders").select("o_orderkey", T.lenient_date(text).alias("day"))


@query("SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9가-힣]{2,}')).len() AS tokens, greatest((length(text) + 1) // 2, 1) AS packed, greatest(length(text) // 2, 1) AS chunked FROM conversations")
def x20_token_estimates(spark, d):
    t = F.col("text")
    return load(spark, d, "conversations").select("conv_id", "turn", F.size(T.token_set(t)).cast("long").alias("tokens"), T.token_estimate(t).alias("packed"), T.token_estimate(t, False).alias("chunked"))


@query("SELECT a.conv_id, a.turn, round(len(list_intersect(list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9가-힣]{2,}')), list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9가-힣]{2,}')))) / nullif(len(list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9가-힣]{2,}'))), 0), 6) AS overlap FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant'")
def x17_faithfulness(spark, d):
    rows = load(spark, d, "conversations").select("conv_id", "turn", "role", T.token_set(F.col("text")).alias("tokens"))
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("tokens").alias("context"))
    share = F.size(F.array_intersect("tokens", "context")) / F.nullif(F.size("tokens"), F.lit(0))
    return rows.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(share, 6).alias("overlap"))


@query("SELECT page_id, regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1) AS names FROM pages WHERE html IS NOT NULL")
def x30_macro_names(spark, d):
    return load(spark, d, "pages").where("html IS NOT NULL").select("page_id", T.macro_names(F.col("html")).alias("names"))


# ---- extensions


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_event_window(spark, d):
    """Extension: counts a day, the batch form of the streaming window."""
    return load(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("WITH g AS (SELECT user_id, ts, value, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE)::INT AS gap, event_id FROM events), s AS (SELECT user_id, ts, sum(coalesce(gap, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, session")
def ext_sessions(spark, d):
    """Extension: sessions of a user, closed by a pause of over thirty minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = load(spark, d, "events").select("user_id", "ts", "event_id").withColumn("gap", F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 30 MINUTE")).cast("long"), F.lit(0)))
    rows = rows.withColumn("session", F.sum("gap").over(w))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


# ---- more lookups, merges and scores

#: Query variants with their weights.
VARIANTS = [("trash", 1.0), ("license", 1.15), ("idiot", 0.55)]


@query("WITH v(term, w) AS (VALUES " + ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in VARIANTS) + "), h AS (SELECT d.source, d.doc_id, w * (len(string_split(lower(coalesce(text, '')), term)) - 1) / (1 + ln(1 + length(coalesce(text, '')))) AS s FROM documents d, v), b AS (SELECT source, doc_id, round(max(s), 6) AS score FROM h WHERE s > 0 GROUP BY ALL) SELECT source, doc_id, score FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 3")
def r10_multi_query_merge(spark, d):
    """Best weighted score of a document over all variants; the variants are a fixed list, scored in one pass."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    best = F.greatest(*[F.lit(w) * (F.size(F.split(low, t)) - 1) / (1 + F.log(1 + F.length(text))) for t, w in VARIANTS])
    rows = load(spark, d, "documents").select("source", "doc_id", F.round(best, 6).alias("score")).where("score > 0")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))).where("r <= 3").drop("r")


@query("SELECT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality >= 0.45 AND (text ILIKE '%trash%' OR text ILIKE '%scum%' OR source ILIKE '%rc7%') AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.label = 3) ORDER BY d.doc_id LIMIT 25")
def r12_injection(spark, d):
    good = load(spark, d, "labels").where("quality >= 0.45").select("doc_id")
    rows = load(spark, d, "documents").where(F.ilike("text", F.lit("%trash%")) | F.ilike("text", F.lit("%scum%")) | F.ilike("source", F.lit("%rc7%"))).select("doc_id").join(good, "doc_id")
    listed = load(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id"))
    return rows.join(listed, "doc_id", "left_anti").orderBy("doc_id").limit(25)


#: Bundle, hints, components (languages stand in for them).
BUNDLES = [("hang", ["the", "of", "trash"], ["en"]), ("disk", ["und", "der"], ["de", "fr"]), ("net", ["license"], ["es"])]


@query("WITH b(bundle, hints, components) AS (VALUES " + ", ".join(f"('{n}', {_sql_list(h)}, {_sql_list(c)})" for n, h, c in BUNDLES) + "), s AS (SELECT doc_id, bundle, round(0.4 * len(list_filter(hints, lambda h: contains(lower(text), h))) + 0.25 * list_contains(components, lang)::INT::DOUBLE, 3) AS score FROM documents, b WHERE text IS NOT NULL) SELECT doc_id, bundle, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, bundle) <= 2")
def r17_bundle_score(spark, d):
    """The two best bundles of a document; the bundles are a short literal list."""
    bundles = spark.createDataFrame(BUNDLES, "bundle string, hints array<string>, components array<string>")
    rows = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "lang", "text").join(F.broadcast(bundles))
    rows = rows.select("doc_id", "bundle", F.round(0.4 * T.hits(F.col("hints"), F.col("text")) + 0.25 * F.array_contains("components", F.col("lang")).cast("int"), 3).alias("score")).where("score > 0")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "bundle"))).where("r <= 2").drop("r")


@query("SELECT p_partkey, p_brand, p_type FROM part ORDER BY p_brand, p_type, p_partkey LIMIT 30 OFFSET 60")
def r19_listing_page(spark, d):
    return R.page(load(spark, d, "part").select("p_partkey", "p_brand", "p_type"), [F.col("p_brand"), F.col("p_type"), F.col("p_partkey")], 30, 60)


@query("WITH l AS (SELECT user_id, event_type, ts, event_id FROM events) SELECT user_id, event_type, ts FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1")
def r20_latest_status(spark, d):
    """Latest row per key; also the latest status of a job."""
    last = F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id"))
    return load(spark, d, "events").groupBy("user_id").agg(last.alias("x")).select("user_id", "x.event_type", "x.ts")


@query("WITH c AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)), s AS (SELECT doc_id, i - 1 AS ordinal, 3 * (contains(lower(line), 'trash')::INT + contains(lower(line), 'license')::INT) + least(length(line) // 200, 5) AS score FROM c) SELECT doc_id, ordinal, score FROM s WHERE score >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) <= 4")
def r23_siblings(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))
    score = 3 * T.hits(F.array(F.lit("trash"), F.lit("license")), F.col("line")) + F.least(F.floor(F.length("line") / 200), F.lit(5))
    rows = lines.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), score.cast("long").alias("score")).where("score >= 3")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal"))).where("r <= 4").drop("r")


@query("WITH w(ref) AS (VALUES ('wiki/3'), ('7'), ('file/src2'), ('none')), c AS (SELECT ref, regexp_replace(ref, '^(wiki|raw|file)/', '') AS k FROM w), t AS (SELECT ref, doc_id, 1 AS tier FROM c JOIN documents ON doc_id::VARCHAR = k UNION ALL SELECT ref, min(doc_id), 2 FROM c JOIN documents ON source = k GROUP BY ref) SELECT ref, doc_id, tier FROM t QUALIFY row_number() OVER (PARTITION BY ref ORDER BY tier, doc_id) = 1")
def f11_resolver(spark, d):
    """By key, else by source, of references without their prefixes; the first tier that finds something counts."""
    refs = spark.createDataFrame([("wiki/3",), ("7",), ("file/src2",), ("none",)], "ref string").withColumn("k", F.regexp_replace("ref", "^(wiki|raw|file)/", ""))
    docs = load(spark, d, "documents").select("doc_id", "source")
    by_key = docs.join(F.broadcast(refs), F.col("doc_id").cast("string") == F.col("k")).select("ref", "doc_id", F.lit(1).alias("tier"))
    by_source = docs.join(F.broadcast(refs), F.col("source") == F.col("k")).groupBy("ref").agg(F.min("doc_id").alias("doc_id")).select("ref", "doc_id", F.lit(2).alias("tier"))
    return by_key.unionByName(by_source).withColumn("r", F.row_number().over(Window.partitionBy("ref").orderBy("tier", "doc_id"))).where("r = 1").drop("r")


@query("SELECT d.source, count(*) AS n FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source")
def j15_bridge_count(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source")
    return docs.join(load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id").join(load(spark, d, "labels").select("doc_id"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(a.source, b.source) AS source, coalesce(a.n, 0) AS long_docs, coalesce(b.n, 0) AS framed FROM (SELECT source, count(*) AS n FROM documents WHERE n_chars > 5000 GROUP BY source) a FULL JOIN (SELECT d.source, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 0 GROUP BY d.source) b ON a.source = b.source")
def j11_source_spine(spark, d):
    docs = load(spark, d, "documents")
    a = docs.where("n_chars > 5000").groupBy("source").agg(F.count(F.lit(1)).alias("long_docs"))
    b = docs.select("doc_id", "source").join(load(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("framed"))
    return a.join(b, "source", "full_outer").na.fill(0, ["long_docs", "framed"])


@query("SELECT event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY event_type")
def a10_domain_counts(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


@query("SELECT lang, count(*) AS n, round(avg((l.quality = 1)::INT), 4) AS pass_rate, round(avg((l.quality = 1 AND l.toxic = 0)::INT), 4) AS primary_rate FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def a16_evaluation(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id")
    ok = F.col("quality") == 1
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok.cast("int")), 4).alias("pass_rate"), F.round(F.avg((ok & (F.col("toxic") == 0)).cast("int")), 4).alias("primary_rate"))


@query("SELECT lang, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def a19_best_per_key(spark, d):
    best = F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id")))
    return load(spark, d, "documents").where("lang IS NOT NULL").groupBy("lang").agg(best.alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query("SELECT doc_id, round(least(CASE WHEN s >= 20 THEN 0.25 WHEN s > 0 THEN 0.1 ELSE 0 END + CASE WHEN c >= 20 THEN 0.35 WHEN c > 0 THEN 0.15 ELSE 0 END + CASE WHEN r >= 20 THEN 0.4 WHEN r > 0 THEN 0.15 ELSE 0 END + CASE WHEN c >= 20 AND r >= 20 THEN 0.1 ELSE 0 END, 1.0), 3)::DOUBLE AS quality FROM (SELECT doc_id, length(trim(coalesce(string_split(text, chr(10))[1], ''))) AS s, length(trim(coalesce(string_split(text, chr(10))[2], ''))) AS c, length(trim(coalesce(string_split(text, chr(10))[3], ''))) AS r FROM documents)")
def x09_frame_quality(spark, d):
    """The first three lines stand for symptom, cause and resolution."""
    line = [F.get(F.split("text", "\n"), F.lit(i)) for i in range(3)]
    return load(spark, d, "documents").select("doc_id", T.frame_quality(*line).alias("quality"))


from cairn.plans import search, service, state  # noqa: E402, F401  register their queries

__all__ = ["ORACLE_SQL", "QUERIES"]
