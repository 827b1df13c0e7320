"""Queries of maintained state: document generations, index segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import diagrams
from cairn.operators import aggregate as A
from cairn.operators import digests, fulltext, snapshot
from cairn.operators import upsert as U
from cairn.plans.registry import query
from cairn.plans.search import TOKENS
from cairn.sources import versions
from cairn.sources.tables import load
from cairn.streaming import jobs

_LINES = "len(string_split(text, chr(10)))"


def _changes(docs):
    """A second batch: some texts change, some go, some come again as they are, some are new."""
    changed = docs.where("key % 7 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\nchanged"))).withColumn("lang", F.lit(None).cast("string"))
    same, gone = docs.where("key % 13 = 1 AND key % 7 <> 0 AND key % 11 <> 0"), docs.where("key % 11 = 0 AND key % 7 <> 0").withColumn("deleted", F.lit(True))
    new = docs.where("key % 17 = 0").withColumn("key", F.col("key") + 1_000_000_000)
    return changed.unionByName(same).unionByName(gone).unionByName(new).withColumn("arrived", F.lit(2))


def _chunked(docs):
    return docs.select("key", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("ordinal", "text"))


@query(
    "WITH d AS (SELECT doc_id AS key, coalesce(text, '') AS text, lang FROM documents), s AS ("
    "SELECT key, text, lang, 1 AS generation FROM d WHERE key % 7 <> 0 AND key % 11 <> 0 UNION ALL SELECT key, text || chr(10) || 'changed', lang, 2 FROM d WHERE key % 7 = 0 "
    f"UNION ALL SELECT key + 1000000000, text, lang, 2 FROM d WHERE key % 17 = 0) SELECT key, generation, lang, {_LINES} AS n_chunks, sha256(text) AS content_hash FROM s"
)
def u01_generations(spark, d):
    """All documents, then a batch of changes, as two generations: what is there, of which generation, with how many active chunks. Values a change lacks are filled."""
    root = versions.shared_folder(spark, "snapshot")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("key"), "text", "lang", F.lit(False).alias("deleted"), F.lit(1).alias("arrived"))
    for batch in (docs, _changes(docs)):
        snapshot.apply(spark, root, batch, _chunked, fill=("lang",))
    active = snapshot.chunks(spark, root).groupBy("key").agg(F.count(F.lit(1)).alias("n_chunks"))
    return snapshot.documents(spark, root).join(active, "key").select("key", "generation", "lang", "n_chunks", "content_hash")


#: Batches of the index: the documents by their ids; the last one changes and deletes older ones.
PARTS = 5


@query(
    f"WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'again ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 9 = 0 OR doc_id % 10 <> 3), "
    f"t AS (SELECT id, unnest({TOKENS}) AS term FROM d) SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM t GROUP BY term"
)
def t01_segments(spark, d):
    """Texts and occurrences of every term in an index that five batches made, then changes, deletions and a merge."""
    root = versions.shared_folder(spark, "segments")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("deleted"))
    for n in range(PARTS):
        fulltext.add(spark, root, docs.where(F.pmod("id", F.lit(PARTS)) == n), number=n)
        while fulltext.merge(spark, root):
            pass
    changed = docs.where("id % 9 = 0").withColumn("text", F.concat(F.lit("again "), F.coalesce("text", F.lit(""))))
    fulltext.add(spark, root, changed.unionByName(docs.where("id % 10 = 3 AND id % 9 <> 0").withColumn("deleted", F.lit(True))), number=PARTS)
    return fulltext.live(spark, root).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


#: Tables whose copies are compared, with their keys and the column that the other copy has changed.
COPIES = {"documents": ("doc_id", "lang"), "embeddings": ("vec_id", "label"), "pages": ("page_id", "url"), "benchmark": ("item_id", "text"), "labels": ("doc_id", "quality"), "conversations": ("conv_id || ':' || turn", "role")}


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS name, key, CASE WHEN k % 23 = 0 THEN 'a' ELSE 'both' END AS side FROM (SELECT ({key})::VARCHAR AS key, {'conv_id' if t == 'conversations' else key} AS k FROM {t}) WHERE k % 23 = 0 OR k % 29 = 0"
        for t, (key, _) in COPIES.items()
    )
)
def s14_digest_trees(spark, d):
    """Keys of all six tables in which a copy differs, found down trees of digests; only leaves that differ are read."""
    found = {}
    for name, (key, column) in COPIES.items():
        rows = load(spark, d, name).withColumn("key", F.expr(f"CAST({key} AS STRING)")).withColumn("k", F.expr("conv_id" if name == "conversations" else key))
        columns = [c for c in rows.columns if c not in ("key", "k")]
        kind = rows.schema[column].dataType
        changed = F.when(F.col("k") % 29 == 0, F.concat(F.col(column).cast("string"), F.lit("1")).cast(kind)).otherwise(F.col(column))
        sides = [versions.shared_folder(spark, f"digests-{name}") for _ in range(2)]
        digests.write(rows, "key", columns, sides[0])
        digests.write(rows.where("k % 23 <> 0").withColumn(column, changed), "key", columns, sides[1])
        found[name] = digests.difference(spark, *sides)
    return digests.of_tables(found)


@query(
    "WITH e AS (SELECT *, max(ts) OVER () AS last FROM events), w AS (SELECT e.*, h FROM e, (VALUES (1), (24)) v(h) WHERE date_trunc('hour', ts) > date_trunc('hour', last) - h * INTERVAL 1 HOUR) "
    "SELECT event_type, h AS hours, count(value) AS n, round(count(*) / (h * 3600.0), 6) AS per_second, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM w GROUP BY event_type, h"
)
def a14_rolling(spark, d):
    """Percentiles and throughput of the last hour and day, merged from hourly sketches."""
    hourly = A.hourly_sketches(load(spark, d, "events"), "ts", "value", "event_type")
    return A.rolling(hourly, [1, 24], [0.5, 0.95], "event_type").select("event_type", "hours", "n", F.round("per_second", 6).alias("per_second"), "p50", "p95")


#: Kinds of buckets of the tickets.
KINDS = {"year": ("year", "o_orderdate"), "month": ("month", "o_orderdate"), "status": ("text", "o_orderstatus"), "component": ("text", "o_orderpriority"), "assignee": ("text", "o_custkey")}


def _bucket_sql(kind: str, column: str) -> str:
    if kind != "text":
        return f"coalesce(strftime({column}, '{'%Y' if kind == 'year' else '%Y-%m'}'), '(unknown)')"
    return f"CASE WHEN {column} IS NULL OR trim({column}::VARCHAR) IN ('', '-') THEN '(empty)' ELSE trim({column}::VARCHAR) END"


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, {_bucket_sql(*x)} AS bucket, count(*) AS n, list(o_orderkey ORDER BY o_orderkey)[1:3] AS ids FROM orders GROUP BY 2" for k, x in KINDS.items()))
def a01_all_kinds(spark, d):
    """Counts by year, month, status, component and assignee with the first tickets of each bucket, from one scan."""
    return A.tallies(load(spark, d, "orders"), "o_orderkey", {k: A.bucket(kind, F.col(column)) for k, (kind, column) in KINDS.items()})


@query(
    "WITH n AS (SELECT max(ts) - INTERVAL 10 SECOND AS now FROM events), l AS (SELECT user_id AS job, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'running' END AS status, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) "
    "SELECT job, status, ts, status = 'running' AND ts + INTERVAL 30 SECOND < now AS stale FROM l, n"
)
def t02_job_states(spark, d):
    """Users stand for jobs: the last status of each, and which have been quiet for over 30 seconds."""
    e = F.col("event_type")
    rows = load(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), "ts", F.when(e == "purchase", "done").when(e == "error", "error").otherwise("running").alias("status"))
    now = rows.agg((F.max("ts") - F.expr("INTERVAL 10 SECONDS")).alias("now"))
    return jobs.states(rows, now)


_UNTIL = "2024-01-25"


def _bucket_states_sql(name: str, where: str) -> str:
    said = lambda c: f"(SELECT user_id, list({c} ORDER BY ts, event_id) AS said FROM (SELECT user_id, {c}, ts, event_id FROM log WHERE {c} IS NOT NULL AND {where} QUALIFY row_number() OVER (PARTITION BY user_id, {c} ORDER BY ts, event_id) = 1) GROUP BY user_id)"
    return (
        f"{name} AS (SELECT b.user_id, nullif(environment, '') AS environment, support, counter, coalesce(s.said, []) AS signals, coalesce(c.said, []) AS counters FROM (SELECT user_id, arg_max(env, (ts, event_id)) FILTER (WHERE env IS NOT NULL) AS environment, "
        f"count(*) FILTER (WHERE event_type <> 'error') AS support, count(*) FILTER (WHERE event_type = 'error') AS counter FROM log WHERE {where} GROUP BY user_id) b LEFT JOIN {said('signal')} s USING (user_id) LEFT JOIN {said('counter_signal')} c USING (user_id))"
    )


@query(
    "WITH log AS (SELECT *, CASE WHEN value < 1 THEN event_type END AS signal, CASE WHEN value > 150 THEN event_type END AS counter_signal, CASE event_id % 297 WHEN 0 THEN 'prod' WHEN 1 THEN 'test' WHEN 2 THEN '' END AS env FROM events), "
    + _bucket_states_sql("old", f"ts < TIMESTAMP '{_UNTIL}'") + ", " + _bucket_states_sql("new", "TRUE")
    + " SELECT n.user_id, n.environment, n.signals, round((n.support + 1) / (n.support + n.counter + 2), 3) AS confidence, CASE WHEN o.user_id IS NULL OR n.signals <> o.signals OR n.counters <> o.counters THEN 'chunk' WHEN n.environment IS DISTINCT FROM o.environment THEN 'patch' ELSE 'none' END AS action FROM new n LEFT JOIN old o USING (user_id)"
)
def u08_reindexing(spark, d):
    """Buckets (users) after their refinements, and what each one's document needs since a day: only a changed meaning is chunked again."""
    e, k = F.col("event_type"), F.col("event_id") % 297
    log = load(spark, d, "events").select(
        "user_id", "ts", F.col("event_id").alias("seq"), F.when(F.col("value") < 1, e).alias("signal"), F.when(F.col("value") > 150, e).alias("counter_signal"),
        F.when(k == 0, " Prod ").when(k == 1, "test").when(k == 2, " ").alias("environment"), (e != "error").alias("confirm"),
    )
    before, after = U.refinements(log.where(f"ts < TIMESTAMP_NTZ '{_UNTIL} 00:00:00'"), "user_id"), U.refinements(log, "user_id")
    return after.select("user_id", "environment", "signals", "confidence").join(U.reindexing(before, after, "user_id"), "user_id")


@query(
    "SELECT page_id, 'Plan ' || page_id AS name, CASE WHEN page_id % 4 < 3 THEN page_id * 10 + 1 END AS attachment_id, TRUE AS inline FROM pages UNION ALL "
    "SELECT page_id, 'second', NULL, TRUE FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'spare', page_id * 10 + 2, FALSE FROM pages WHERE page_id % 5 = 0"
)
def s16_diagrams(spark, d):
    """Macros put into every page's markup, and attachments under each of the ways in which they may be called."""
    pages = load(spark, d, "pages").select("page_id", "html")
    k, name = F.col("page_id"), F.concat(F.lit("Plan "), "page_id")
    macro = lambda n: F.concat(F.lit('<ac:structured-macro ac:name="drawio" ac:schema-version="1"><ac:parameter ac:name="zoom">1</ac:parameter><ac:parameter ac:name="diagramName">\n '), n, F.lit(" </ac:parameter></ac:structured-macro>"))
    other = F.lit('<ac:structured-macro ac:name="info"><ac:parameter ac:name="diagramName">no</ac:parameter></ac:structured-macro>')
    body = F.concat(F.coalesce("html", F.lit("")), macro(name), other, F.when(k % 3 == 0, macro(F.lit("second"))).otherwise(F.lit("")))
    title = F.when(k % 4 == 0, F.concat(name, F.lit(".drawio"))).when(k % 4 == 1, name).when(k % 4 == 2, F.concat(F.upper(name), F.lit(".XML"))).otherwise(F.concat(name, F.lit(".txt")))
    own = F.struct((k * 10 + 1).alias("attachment_id"), title.alias("title"))
    image, spare = (F.struct((k * 10 + n).alias("attachment_id"), t.alias("title")) for n, t in ((0, F.concat(name, F.lit(".png"))), (2, F.lit("spare.drawio"))))
    files = F.array_compact(F.array(image, own, F.when(k % 5 == 0, spare)))
    attachments = pages.select("page_id", F.posexplode(files).alias("ordinal", "f")).select("page_id", "ordinal", "f.*")
    return diagrams.diagrams(pages.select("page_id", body.alias("body")), attachments)
