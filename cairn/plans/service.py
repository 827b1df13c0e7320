"""More queries of the catalogue: full-text ranking, frames, buckets, insights, evaluations, records; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import chunks, frames, records, taxonomy
from cairn.functions import text as T
from cairn.operators import aggregate as A
from cairn.operators import lexical as L
from cairn.operators import rank as R
from cairn.operators import upsert as U
from cairn.plans.registry import query
from cairn.sources.tables import load

# ---- full text

#: Variants of a question with their weights, in order; and the terms of the title bonus.
VARIANTS, TITLES = [("license", 1.0), ("the of", 1.0), ("trash", 0.55), ("license version", 1.0), ("the", 0.25)], ["the", "und", "license"]
_ASKED = [(i, w, t, len(L.terms_of(v))) for i, (v, w) in enumerate(VARIANTS) for t in L.terms_of(v)]
_FOLD = (
    "t AS (SELECT doc_id AS id, length(text) AS length, unnest(regexp_extract_all(lower(text), '[a-z0-9가-힣]{2,}')) AS term FROM documents), "
    "p AS (SELECT term, id, count(*) AS tf, any_value(length) AS length FROM t GROUP BY ALL), v(variant, weight, term, needed) AS (VALUES " + ", ".join(f"({i}, {w}::DOUBLE, '{t}', {n})" for i, w, t, n in _ASKED) + "), "
    "f AS (SELECT variant, weight, needed, id, count(*) AS n, sum(tf) / (1 + ln(1 + max(length))) AS score FROM p JOIN v USING (term) GROUP BY ALL HAVING count(*) = needed), "
    "top AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY variant ORDER BY round(score, 12) DESC, id) <= 40), e AS (SELECT id, list(weight * score ORDER BY variant) AS cs FROM top GROUP BY id), "
    "fold AS (SELECT id, list_reduce(list_prepend(0.0::DOUBLE, cs), lambda a, x: CASE WHEN x > a THEN x ELSE a + 0.15 * x END) AS score FROM e)"
)
_TITLE = "b AS (SELECT id, sum(0.08 / i) AS bonus FROM (SELECT doc_id AS id, term, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS i FROM documents JOIN (VALUES " + ", ".join(f"('{t}')" for t in TITLES) + ") w(term) ON contains(lower(string_split(text, chr(10))[1]), term) QUALIFY i <= 40) GROUP BY id)"


def _fold(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return L.folded(L.postings(docs, sorted({t for _, _, t, _ in _ASKED})), VARIANTS)


def _title(spark, d):
    return L.title_bonus(load(spark, d, "documents").select(F.col("doc_id").alias("id"), T.title_of(F.col("text")).alias("title")), TITLES)


@query(f"WITH {_FOLD} SELECT id, round(score, 9) AS score FROM fold")
def r01_variant_fold(spark, d):
    return _fold(spark, d).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {_TITLE} SELECT id, round(bonus, 9) AS bonus FROM b")
def r02_title_bonus(spark, d):
    return _title(spark, d).select("id", F.round("bonus", 9).alias("bonus"))


@query(f"WITH {_FOLD}, {_TITLE} SELECT id, round(coalesce(f.score, 0) + coalesce(b.bonus, 0), 9) AS score FROM fold f FULL JOIN b USING (id) ORDER BY score DESC, id LIMIT 40")
def r01_lexical_ranked(spark, d):
    """Fold and title bonus together, the list that fusion takes."""
    rows = _fold(spark, d).join(_title(spark, d), "id", "full_outer").na.fill(0.0)
    return rows.select("id", F.round(F.col("score") + F.col("bonus"), 9).alias("score")).orderBy(F.desc("score"), "id").limit(40)


@query("SELECT o_orderkey, list_sort(['AB-' || (o_orderkey + 10), 'page_' || (o_custkey + 10), 'vm.max_' || o_orderkey, (o_orderkey * 1000 + 1000000)::VARCHAR]) AS tokens FROM orders")
def f08_exact_tokens(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    text = F.concat(F.lit("why ABC-"), F.col("o_orderkey") + 10, F.lit(" or vm.max_"), F.col("o_orderkey"), F.lit(" on page_"), F.col("o_custkey") + 10, F.lit(", see "), F.col("o_orderkey") * 1000 + 1000000, F.lit("?"))
    return orders.select("o_orderkey", F.array_sort(F.transform(L.exact_tokens(text), lambda t: F.regexp_replace(t, "^ABC", "AB"))).alias("tokens"))


@query(
    f"WITH {_FOLD}, l AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM fold QUALIFY rank <= 10), "
    "h AS (SELECT doc_id AS id, i, row_number() OVER (PARTITION BY i ORDER BY doc_id) AS n FROM documents JOIN (VALUES (0, 'src7'), (1, 'license')) k(i, token) ON contains(lower(source || chr(10) || string_split(coalesce(text, ''), chr(10))[1]), token) QUALIFY n <= 20), "
    "x AS (SELECT id, min(i * 1000 + n) AS front FROM h WHERE id NOT IN (SELECT id FROM l) GROUP BY id) "
    "SELECT id, row_number() OVER (ORDER BY tier, place, id) AS rank FROM (SELECT id, 0 AS tier, -front AS place FROM x UNION ALL SELECT id, 1, rank FROM l)"
)
def f09_injection(spark, d):
    """What has an exact token in its key or title stands before the ranked list."""
    top = _fold(spark, d).select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(10)
    ranked = top.withColumn("rank", F.row_number().over(R.Window.orderBy(F.desc("score"), "id")))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("key"), T.title_of(F.coalesce("text", F.lit(""))).alias("title"))
    return L.injected(ranked, docs, spark.createDataFrame([(0, "src7"), (1, "license")], "i int, token string"))


@query(f"WITH {_FOLD} SELECT id, round(score + CASE WHEN source = 'src0' THEN 0.02 ELSE 0 END + CASE WHEN source = 'src0' AND lang = 'en' THEN 0.015 ELSE 0 END, 9) AS score FROM fold JOIN documents ON doc_id = id")
def r07_checklist_boost(spark, d):
    """Check items (a source stands for them) above others, those of the question's family once more."""
    item = F.col("source") == "src0"
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang").join(F.broadcast(_fold(spark, d)), "id")
    return rows.select("id", F.round(F.col("score") + F.when(item, 0.02).otherwise(0.0) + F.when(item & (F.col("lang") == "en"), 0.015).otherwise(0.0), 9).alias("score"))


@query(f"WITH {_FOLD}, pool AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM fold QUALIFY rank <= 40) SELECT id AS doc_id, round(1.0::DOUBLE / rank + 0.35 * l.quality + CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 0.2 ELSE 0 END, 6) AS score FROM pool JOIN labels l ON l.doc_id = id ORDER BY score DESC, doc_id LIMIT 8")
def r11_similar_incident(spark, d):
    """Place in the pool of a question's lexical list, frame quality and completeness."""
    top = _fold(spark, d).select("id", F.round("score", 9).alias("s")).orderBy(F.desc("s"), "id").limit(40)
    pool = top.withColumn("rank", F.row_number().over(R.Window.orderBy(F.desc("s"), "id")))
    rows = load(spark, d, "labels").join(F.broadcast(pool), F.col("doc_id") == F.col("id"))
    score = 1.0 / F.col("rank") + 0.35 * F.col("quality") + F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0.2).otherwise(0.0)
    return rows.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(8)


# ---- chunks, frames, taxonomy


@query("SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal, role || turn AS section, '[chat | ' || conv_id || ' | ' || 'Conversation] | ' || role || turn AS header, trim(text) AS text, CAST(greatest(1, length(trim(text)) // 2) AS INTEGER) AS tokens FROM conversations WHERE length(trim(text)) > 0")
def x06_markdown_chunks(spark, d):
    """Conversations as markdown, one heading for each turn; chunks carry the bracketed header (X07)."""
    rows = load(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("# "), "role", "turn", F.lit("\n"), F.coalesce("text", F.lit(""))).alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n\n")  # the turns of one conversation
    docs = rows.groupBy(F.col("conv_id").alias("id")).agg(body.alias("body"))
    return chunks.chunked(docs.select("id", chunks.header(F.lit("chat"), F.col("id").cast("string"), F.lit("Conversation")).alias("header"), "body"))


@query(
    "SELECT o_orderkey AS id, 'status ' || o_orderstatus || ' was seen for this order today' AS symptom, 'priority ' || o_orderpriority || ' is not what was asked for' AS root_cause, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'customer ' || o_custkey || ' was called and the order changed' END AS resolution, ['Oracle', 'Network'] AS components, ['lsof -p ' || o_orderkey] AS commands, CASE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS quality FROM orders"
)
def x08_frames(spark, d):
    """Tickets made of orders: headings in two styles, an unknown resolution in every second one (X10 and X11 beside the slots)."""
    o = load(spark, d, "orders")
    done = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("customer "), "o_custkey", F.lit(" was called and the order changed"))).otherwise(F.lit("미상"))
    body = F.concat(F.lit("## 원본 내용\nh3. 이슈 증상\n * status "), "o_orderstatus", F.lit(" was seen for this order today\n\nh3. 이슈 원인\n - priority "), "o_orderpriority", F.lit(" is not what was asked for\n\n조치 : "), done, F.lit("\n\n$ lsof -p "), F.col("o_orderkey"), F.lit("\nOracle behind BGP\n"))
    # the closing lines belong to no section: a heading that is no slot's ends it
    body = F.replace(body, F.lit("\n\n$ lsof"), F.lit("\n## Comments\n$ lsof"))
    rows = frames.extracted(o.select(F.col("o_orderkey").alias("id"), F.lit("t").alias("title"), body.alias("body")))
    return rows.select("id", "symptom", "root_cause", "resolution", "components", "commands", "quality")


@query(
    "WITH t AS (SELECT doc_id, coalesce(string_split(text, chr(10))[1], '') AS title, coalesce(text, '') AS body, CASE doc_id % 5 WHEN 0 THEN 'A > B > 스토리지' WHEN 1 THEN 'GPU' ELSE source END AS path FROM documents), b AS (SELECT *, title || chr(10) || left(body, 3000) AS blob FROM t) SELECT doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(blob, '{p}') THEN '{n}'" for n, p in taxonomy.ENVIRONMENTS) + " END AS environment, coalesce(CASE " + " ".join(f"WHEN contains(path, '{k}') THEN '{v}'" for k, v in taxonomy.PATHS) + " END, CASE "
    + " ".join(f"WHEN regexp_matches(blob, '{p}') THEN '{n}'" for n, p in taxonomy.DOMAINS) + " END) AS domain FROM b"
)
def x02_x03_taxonomy(spark, d):
    """Environment and domain of every document; paths of a taxonomy stand in for some sources."""
    k, none = F.col("doc_id") % 5, F.lit("")
    rows = load(spark, d, "documents").select("doc_id", F.coalesce(T.title_of(F.col("text")), none).alias("title"), "text", F.when(k == 0, "A > B > 스토리지").when(k == 1, "GPU").otherwise(F.col("source")).alias("path"))
    return rows.select("doc_id", taxonomy.environment(F.col("title"), F.col("text")).alias("environment"), taxonomy.domain(F.col("title"), F.col("text"), F.col("path"), none, none, none).alias("domain"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'onprem' WHEN o_orderstatus = 'O' THEN 'msp' END AS environment, o_orderpriority AS work_type FROM orders")
def x04_enrichment(spark, d):
    """An explicit environment counts before the text's; a ticket's work type is its component."""
    o = load(spark, d, "orders")
    explicit = F.when(F.col("o_orderstatus") == "F", "onprem").when(F.col("o_orderstatus") == "P", "").otherwise(None)
    title = F.when(F.col("o_orderstatus") == "O", "MSP order").otherwise("order")
    return o.select("o_orderkey", taxonomy.given(explicit, taxonomy.environment(title, F.lit(""))).alias("environment"), taxonomy.given(F.lit(None).cast("string"), F.col("o_orderpriority")).alias("work_type"))


# ---- filters and lookups


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(string_split(text, chr(10))[1], '') || chr(10) || doc_id || chr(10) || left(coalesce(text, ''), 1500)), 'license')")
def f06_entity_text(spark, d):
    blob = F.lower(F.concat_ws("\n", F.coalesce(T.title_of(F.col("text")), F.lit("")), "doc_id", F.left(F.coalesce("text", F.lit("")), F.lit(1500))))
    return load(spark, d, "documents").where(F.contains(blob, F.lit("license"))).select("doc_id")


_WANTED = [("p1", 1, "x"), ("p2", 2, "y"), ("p3", 999999999, "z")]


@query("WITH w(ref, code, lang) AS (SELECT ref, code, CASE WHEN code = 1 THEN p_brand ELSE lang END FROM (VALUES " + ", ".join(str(x) for x in _WANTED) + ") v(ref, code, lang) LEFT JOIN part ON p_partkey = code) SELECT ref, p_partkey, p_brand = lang AS exact FROM w JOIN part ON p_partkey = code QUALIFY row_number() OVER (PARTITION BY ref ORDER BY (p_brand = lang) DESC, p_brand) = 1")
def f12_code_lookup(spark, d):
    """A check item by code and language, else by its code alone."""
    part = load(spark, d, "part").select("p_partkey", "p_brand")
    want = spark.createDataFrame(_WANTED, "ref string, code long, lang string")
    hit = part.join(F.broadcast(want), F.col("p_partkey") == F.col("code"))
    exact = F.col("p_brand") == F.when(F.col("code") == 1, F.col("p_brand")).otherwise(F.col("lang"))
    best = R.Window.partitionBy("ref").orderBy(F.desc(exact), "p_brand")
    return hit.select("ref", "p_partkey", exact.alias("exact"), F.row_number().over(best).alias("r")).where("r = 1").drop("r")


@query("SELECT doc_id, nullif(lang, 'fr') AS environment FROM documents WHERE nullif(lang, 'fr') = 'en' OR nullif(lang, 'fr') IS NULL")
def f13_environment_or_none(spark, d):
    env = F.nullif(F.col("lang"), F.lit("fr"))
    return load(spark, d, "documents").select("doc_id", env.alias("environment")).where((F.col("environment") == "en") | F.col("environment").isNull())


@query("SELECT p_partkey, list_filter([{'key': 'Code', 'label': 'code', 'value': p_partkey::VARCHAR}, {'key': 'Area', 'label': 'area', 'value': p_brand}, {'key': 'Subject', 'label': 'subject', 'value': p_name}, {'key': 'size', 'label': 'size', 'value': p_size::VARCHAR}], lambda x: x.value IS NOT NULL AND trim(x.value) <> '').len() AS n, 'code=' || p_partkey || ';area=' || p_brand || ';subject=' || p_name || ';size=' || p_size AS shown FROM part")
def f14_sections(spark, d):
    """Labelled fields in order, a column where the raw field is empty, then what else the raw record has."""
    raw = F.create_map(F.lit("Code"), F.col("p_partkey").cast("string"), F.lit("Area"), F.lit(" "), F.lit("Subject"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"), F.lit("note"), F.lit(""))
    found = records.labelled_sections(raw, [("Code", "code"), ("Area", "area"), ("Risk", "risk"), ("Subject", "subject")], {"Area": F.col("p_brand")})
    return load(spark, d, "part").select("p_partkey", found.alias("s")).select("p_partkey", F.size("s").cast("long").alias("n"), F.array_join(F.transform("s", lambda x: F.concat(x["label"], F.lit("="), x["value"])), ";").alias("shown"))


@query("SELECT user_id, n, confidence FROM (SELECT user_id, count(*) AS n, round((count(*) FILTER (WHERE event_type = 'purchase') + 1) / (count(*) FILTER (WHERE event_type IN ('purchase', 'error')) + 2), 3) AS confidence FROM events GROUP BY user_id) WHERE confidence >= 0.5 AND user_id % 3 = 1")
def f17_confident(spark, d):
    """Buckets (users stand for them) of one domain with enough confidence."""
    e = F.col("event_type")
    rows = load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), A.laplace(F.count_if(e == "purchase"), F.count_if(e == "error")).alias("confidence"))
    return rows.where((F.col("confidence") >= 0.5) & (F.col("user_id") % 3 == 1))


@query("WITH w(needle) AS (VALUES ('3'), ('nation:5'), (" + "'Nation_7'" + "), ('n9'), ('none')), e AS (SELECT 'nation:' || n_nationkey AS id, n_name AS canonical, ['n' || n_nationkey, lower(n_name)] AS aliases FROM nation) SELECT needle, min(id) AS id FROM w JOIN e ON id = needle OR ends_with(id, ':' || needle) OR canonical = needle OR list_contains(aliases, needle) GROUP BY needle")
def j09_entity_resolver(spark, d):
    """By id, the end of an id, the name or an alias; the first by id counts."""
    entities = load(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.col("n_name").alias("canonical"), F.array(F.concat(F.lit("n"), "n_nationkey"), F.lower("n_name")).alias("aliases"))
    want = spark.createDataFrame([("3",), ("nation:5",), ("Nation_7",), ("n9",), ("none",)], "needle string")
    needle = F.col("needle")
    hit = (F.col("id") == needle) | F.endswith("id", F.concat(F.lit(":"), needle)) | (F.col("canonical") == needle) | F.array_contains("aliases", needle)
    return entities.join(F.broadcast(want), hit).groupBy("needle").agg(F.min("id").alias("id"))


# ---- evaluations


@query(
    "WITH r AS (SELECT q.vec_id AS query_id, v.vec_id - q.vec_id AS rank, v.vec_id AS id, v.label AS l FROM embeddings q JOIN embeddings v ON v.vec_id BETWEEN q.vec_id + 1 AND q.vec_id + 3 WHERE q.vec_id % 10 = 0), "
    "g AS (SELECT vec_id AS query_id, label, vec_id % 50 = 0 AS fa FROM embeddings WHERE vec_id % 10 = 0), "
    "o AS (SELECT g.query_id, fa, CASE WHEN fa THEN NOT coalesce(max((rank = 1 AND l = 3 AND id % 2 = 1)::INT) = 1, FALSE) ELSE coalesce(max((l = label)::INT) = 1, FALSE) END AS ok FROM g LEFT JOIN r ON r.query_id = g.query_id GROUP BY g.query_id, fa) "
    "SELECT count(ok) AS n_scored, count(*) FILTER (WHERE ok) AS hits, count(*) FILTER (WHERE ok AND NOT fa) AS similar_hits, count(*) FILTER (WHERE fa AND NOT ok) AS false_apply_failures, round(count(*) FILTER (WHERE ok) / count(ok), 4) AS pass_rate, "
    "count(*) FILTER (WHERE ok) / count(ok) >= 0.7 AND count(ok) >= 8 AND count(*) FILTER (WHERE fa AND NOT ok) = 0 AND count(*) FILTER (WHERE ok AND NOT fa) >= 8 AS pass FROM o"
)
def a17_similar_incidents(spark, d):
    """Each tenth vector is a gold query, the three behind it are its results, those of its label are relevant."""
    e = load(spark, d, "embeddings").select("vec_id", "label")
    query_id = F.col("vec_id") - F.pmod("vec_id", F.lit(10))
    results = e.where(F.pmod("vec_id", F.lit(10)).between(1, 3)).select(query_id.alias("query_id"), (F.col("vec_id") - query_id).alias("rank"), F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 1, "possible").otherwise("conditional").alias("label"), F.col("label").alias("l"))
    gold = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 50 == 0, "false_apply").otherwise("true_similar").alias("kind"), F.col("label").alias("want"))
    lists = gold.join(results, "query_id", "left").groupBy("query_id", "kind").agg(F.collect_list(F.when(F.col("l") == F.col("want"), F.col("id"))).alias("same"), F.collect_list(F.when(F.col("l") == 3, F.col("id"))).alias("forbidden"))  # three results at most
    gold = lists.select("query_id", "kind", F.when(F.col("kind") == "true_similar", F.concat("same", F.array(F.lit(-1).cast("long")))).otherwise(F.col("same")).alias("relevant"), "forbidden")  # each has a relevant id, found or not
    return A.similar_incidents(results, gold, 3)


@query(
    "WITH a AS (SELECT a.turn % 4 = 0 AS quiet, length(a.text) > 0 AS has_text, regexp_matches(a.text, '[0-9]') AS cited, length(a.text) < 40 AS abstained, "
    "len(list_intersect(list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9가-힣]{2,}')), list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9가-힣]{2,}')))) / nullif(len(list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9가-힣]{2,}'))), 0) AS o FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant'), "
    "b AS (SELECT *, CASE WHEN quiet THEN abstained OR coalesce(o, 0) < 0.1 ELSE has_text AND (cited OR abstained) END AS ok FROM a), "
    "c AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT quiet) AS n_answered, round(coalesce(count(*) FILTER (WHERE NOT quiet AND cited) / nullif(count(*) FILTER (WHERE NOT quiet), 0), 0), 4) AS citation_rate, round(coalesce(count(*) FILTER (WHERE NOT quiet AND o >= 0.1) / nullif(count(*) FILTER (WHERE NOT quiet), 0), 0), 4) AS overlap_rate, "
    "round(coalesce(count(*) FILTER (WHERE quiet AND ok) / nullif(count(*) FILTER (WHERE quiet), 0), 1), 4) AS abstain_ok_rate, round(count(*) FILTER (WHERE ok) / count(*), 4) AS row_ok_rate FROM b) SELECT *, n_answered >= 10 AND citation_rate >= 0.6 AND overlap_rate >= 0.5 AND abstain_ok_rate >= 0.5 AS pass FROM c"
)
def a18_groundedness(spark, d):
    """Answers of conversations over the turn before; digits stand for citations, every fourth turn should stay silent."""
    rows = load(spark, d, "conversations").select("conv_id", "turn", "role", "text", T.token_set(F.col("text")).alias("tokens"))
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("tokens").alias("context"))
    o = F.coalesce(F.size(F.array_intersect("tokens", "context")) / F.nullif(F.size("tokens"), F.lit(0)), F.lit(0.0))
    answers = rows.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select(
        (F.length("text") > 0).alias("has_text"), F.rlike("text", F.lit("[0-9]")).alias("has_citation"), F.when(o >= 0.25, "ok").when(o >= 0.1, "medium").otherwise("low").alias("overlap"),
        (F.col("turn") % 4 == 0).alias("expect_abstain"), (F.length("text") < 40).alias("abstained"), F.when(o < 0.1, "weak").otherwise("medium").alias("trust"),
    )
    return A.groundedness(answers)


_TOKENS = "list_distinct(regexp_extract_all(lower({0}.text), '[a-z0-9가-힣]{{2,}}'))"


@query(
    f"WITH x AS (SELECT a.conv_id, a.turn, {_TOKENS.format('a')} AS t, {_TOKENS.format('q')} AS c FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant'), "
    "y AS (SELECT *, len(list_intersect(t, c)) AS n FROM x), l AS (SELECT *, CASE WHEN n / nullif(len(c), 0) >= 0.05 THEN 3 WHEN n / nullif(len(c), 0) >= 0.02 THEN 2 ELSE 1 END AS r, CASE WHEN n / nullif(len(t), 0) >= 0.25 THEN 3 WHEN n / nullif(len(t), 0) >= 0.1 THEN 2 ELSE 1 END AS f FROM y) "
    "SELECT conv_id, turn, CASE WHEN r = 1 AND f = 1 THEN 'abstain' ELSE ['weak', 'medium', 'strong'][least(r, f)] END AS trust FROM l"
)
def x18_trust(spark, d):
    """The weaker of retrieval (how much of the turn before an answer takes up) and faithfulness (how much of the answer comes from there)."""
    rows = load(spark, d, "conversations").select("conv_id", "turn", "role", T.token_set(F.col("text")).alias("tokens"))
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("tokens").alias("context"))
    both = F.size(F.array_intersect("tokens", "context"))
    share = lambda c: both / F.nullif(F.size(c), F.lit(0))
    r = F.when(share("context") >= 0.05, 3).when(share("context") >= 0.02, 2).otherwise(1)
    f = F.when(share("tokens") >= 0.25, 3).when(share("tokens") >= 0.1, 2).otherwise(1)
    label = F.when((r == 1) & (f == 1), "abstain").otherwise(F.element_at(F.array(*map(F.lit, ("weak", "medium", "strong"))), F.least(r, f)))
    return rows.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", label.alias("trust"))


@query("SELECT conv_id, turn, list_sort(list_distinct(['C' || turn, 'C' || (conv_id % 7)])) AS cites, turn = conv_id % 7 AS once FROM conversations WHERE role = 'assistant'")
def x19_citations(spark, d):
    """Marks in both cases among the words of each answer, some of them twice."""
    mark = lambda c, x: F.concat(F.lit(f" [{c}"), x, F.lit("] "))
    turn, other = F.col("turn").cast("string"), (F.col("conv_id") % 7).cast("string")
    words = F.regexp_replace("text", r"\[", "(")
    text = F.concat(mark("c", turn), words, mark("C", other), mark("C", turn), F.lit("[x1] [C]"))
    cites = T.citation_ids(text)
    return load(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.sort_array(cites).alias("cites"), (F.size(cites) == 1).alias("once"))


# ---- failure buckets, insights, seeds

#: Bucket, signals, counter-signals, confidence, domain, environment.
PATTERNS = [(1, ["apache license", "the version"], ["trash"], 0.8, "os", "en"), (2, ["und der die", "mit"], ["licensed under"], 0.6, "network", None), (3, ["los que", "por la", "una"], [], 0.5, "os", "es"), (4, ["the of and to"], ["idiot moron"], 0.7, "web", None)]


def _values(rows) -> str:
    def one(x) -> str:
        return "[" + ", ".join(map(one, x)) + "]::VARCHAR[]" if isinstance(x, list) else "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_SEEN = "list_filter({0}, lambda s: len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[a-z0-9가-힣]{{2,}}')), obs)) >= ceil(len(list_distinct(regexp_extract_all(lower(s), '[a-z0-9가-힣]{{2,}}'))) / 2))"
_MATCH = (
    f"b(bucket_id, signals, counter, confidence, domain, environment) AS (VALUES {_values(PATTERNS)}), o AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[a-z0-9가-힣]{{2,}}')) AS obs FROM documents WHERE text IS NOT NULL), "
    f"m AS (SELECT doc_id, bucket_id, len({_SEEN.format('signals')}) AS matched, len({_SEEN.format('counter')}) AS against, least(len(signals), 4) AS total, confidence FROM o JOIN b ON environment IS NULL OR environment = lang), "
    "s AS (SELECT doc_id, bucket_id, matched, against, greatest(least(0.6 * (least(matched, 4) / total) + 0.4 * confidence - 0.5 * against, 1), 0) AS raw FROM m), "
    "t AS (SELECT doc_id, bucket_id, round(raw, 3) AS score, CASE WHEN against > 0 THEN 'not-recommended' WHEN raw >= 0.7 AND matched > 0 THEN 'possible' WHEN raw >= 0.4 THEN 'conditional' ELSE 'not-recommended' END AS label FROM s)"
)


def _matches(spark, d):
    buckets = spark.createDataFrame(PATTERNS, "bucket_id int, signals array<string>, counter array<string>, confidence double, domain string, environment string")
    buckets = buckets.withColumns({c: R.signal_tokens(F.col(c)) for c in ("signals", "counter")})
    tokens = sorted({t for row in PATTERNS for s in [*row[1], *row[2]] for t in L.terms_of(s)})
    docs = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "lang", T.token_set(F.col("text")).alias("obs"))
    rows = R.bucket_scores(docs, buckets, tokens, F.col("environment").isNull() | (F.col("environment") == F.col("lang")))
    return rows.select("doc_id", "bucket_id", "score", "label")


@query(f"WITH {_MATCH} SELECT doc_id, bucket_id, score, label FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, bucket_id) <= 2")
def r16_bucket_rank(spark, d):
    """The two best buckets of every text, of all that its environment allows."""
    best = R.Window.partitionBy("doc_id").orderBy(F.desc("score"), "bucket_id")
    return _matches(spark, d).withColumn("r", F.row_number().over(best)).where("r <= 2").drop("r")


@query(f"WITH {_MATCH}, k AS (SELECT doc_id, arg_max(bucket_id, (score, -bucket_id)) AS top, max(score) AS score FROM t GROUP BY doc_id) SELECT d.doc_id, CASE WHEN score >= 0.75 THEN top END AS duplicate_of, d.source NOT IN ('src0', 'src1') AS new_domain, NOT (starts_with(d.lang || ':', 'en:') OR starts_with(d.lang || ':', 'de:')) AS odd_evidence FROM documents d LEFT JOIN k USING (doc_id)")
def u09_new_buckets(spark, d):
    """Each text as a new bucket: a likely duplicate, an unknown domain and unusual evidence are reported, nothing is refused."""
    top = _matches(spark, d).groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("bucket_id")).alias("b"))).alias("top"))
    docs = load(spark, d, "documents").select("doc_id", "source", "lang")
    known = F.startswith(F.concat("lang", F.lit(":")), F.lit("en:")) | F.startswith(F.concat("lang", F.lit(":")), F.lit("de:"))
    return docs.join(top, "doc_id", "left").select("doc_id", F.when(F.col("top.score") >= 0.75, -F.col("top.b")).alias("duplicate_of"), (~F.col("source").isin("src0", "src1")).alias("new_domain"), (~known).alias("odd_evidence"))


@query("WITH f AS (SELECT user_id, event_type, min(ts) AS ts FROM events WHERE event_type <> 'view' GROUP BY ALL), s AS (SELECT user_id, list(event_type ORDER BY ts, event_type) AS signals FROM f GROUP BY user_id), c AS (SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS support, count(*) FILTER (WHERE event_type = 'error') AS counter FROM events GROUP BY user_id) SELECT user_id, support, counter, signals, round((support + 1) / (support + counter + 2), 3) AS confidence FROM c LEFT JOIN s USING (user_id)")
def u08_refined_buckets(spark, d):
    """Buckets from the log of their refinements (events of a user)."""
    e = F.col("event_type")
    log = load(spark, d, "events").select("user_id", "ts", F.nullif(e, F.lit("view")).alias("signal"), (e != "error").alias("confirm"))
    return U.refined(log, "user_id").select("user_id", "support", "counter", "signals", "confidence")


_FROM, _TO = "CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'draft' ELSE 'review' END", "CASE o_orderkey % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'draft' END"


@query(f"WITH x AS (SELECT o_orderkey, {_FROM} AS s, {_TO} AS t FROM orders), y AS (SELECT *, (s, t) IN (('draft', 'review'), ('draft', 'rejected'), ('review', 'approved'), ('review', 'rejected'), ('review', 'draft'), ('rejected', 'draft')) AS may FROM x) SELECT o_orderkey, CASE WHEN may THEN t ELSE s END AS status, CASE WHEN may THEN 'moved' ELSE 'refused' END AS action FROM y")
def u10_transitions(spark, d):
    """Insights (orders) move where their status allows it."""
    rows = load(spark, d, "orders").select("o_orderkey", F.expr(_FROM).alias("status"), F.expr(_TO).alias("to_status"))
    return U.transitioned(rows.select("o_orderkey", "status"), rows.select("o_orderkey", "to_status"), "o_orderkey")


@query("SELECT o_orderkey AS document_id, 'insight:' || o_orderkey AS external_id, sha256('order ' || o_orderkey || chr(10) || o_orderstatus || chr(10) || '{}') AS content_hash FROM orders WHERE o_orderstatus = 'F'")
def u10_promoted(spark, d):
    """Approved insights become documents with a content hash, so promoting again changes nothing."""
    rows = load(spark, d, "orders").where("o_orderstatus = 'F'")
    return rows.select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("insight:"), "o_orderkey").alias("external_id"), T.content_hash(F.concat(F.lit("order "), F.col("o_orderkey")), F.col("o_orderstatus")).alias("content_hash"))


@query("SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CAST(CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 <> 0 THEN 2 ELSE 1 END AS INTEGER) AS version FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 = 0")
def u02_item_upsert(spark, d):
    """Check items by code and language: changed ones anew, new ones added, others stay."""
    part = load(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    hashed = lambda df: df.withColumn("content_hash", F.md5(F.col("p_size").cast("string")))
    old = hashed(part.where("p_partkey % 3 <> 0")).withColumn("version", F.lit(1))
    new = hashed(part.where("p_partkey % 4 = 0").withColumn("p_size", F.col("p_size") + 1))
    return U.apply(old, new, ["p_partkey", "p_brand"]).select("p_partkey", "p_brand", "p_size", "version")


@query("SELECT doc_id, quality FROM labels WHERE quality >= 0.45 AND doc_id % 2 = 0")
def u03_frames_due(spark, d):
    """Frames of enough quality that are not yet there (those of odd ids are)."""
    labels = load(spark, d, "labels").select("doc_id", "quality")
    return U.frames_due(labels.where("doc_id % 2 = 1"), labels, "doc_id", 0.45)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'seed ' || n_nationkey ELSE n_name END AS n_name FROM nation UNION ALL SELECT 99, 'seed 99'")
def u04_seeds(spark, d):
    """Seeds take the place of rows with their keys."""
    old = load(spark, d, "nation").select("n_nationkey", "n_name")
    seeds = old.where("n_nationkey % 5 = 0").select("n_nationkey").unionByName(spark.createDataFrame([(99,)], "n_nationkey int")).withColumn("n_name", F.concat(F.lit("seed "), "n_nationkey"))
    return U.replaced(old, seeds, "n_nationkey")


@query("SELECT event_type, CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'ok' END AS action, count(*) AS n FROM events GROUP BY ALL")
def u07_isolation(spark, d):
    """Every seventh record is cut in two and can't be parsed; it is counted, the others go on."""
    text = F.when(F.col("event_id") % 7 == 0, F.lit('{"k": ')).otherwise(F.col("props"))
    rows = load(spark, d, "events").select("event_type", F.try_parse_json(text).cast("string").alias("parsed"))
    return U.isolated(rows, "event_type", F.col("parsed"))


# ---- records


@query("SELECT doc_id, source || '/' || doc_id || '.md' AS path, CASE WHEN source = 'src0' THEN '/v1/checkitems/' || doc_id ELSE '/v1/tickets/' || doc_id || '?source_type=' || source END AS link FROM documents")
def s18_access(spark, d):
    key = F.col("doc_id").cast("string")
    kind = F.when(F.col("source") == "src0", "checkitem").otherwise(F.col("source"))
    return load(spark, d, "documents").select("doc_id", records.document_path(F.col("source"), key).alias("path"), records.body_link(kind, key).alias("link"))


@query("WITH t AS (SELECT p_name AS canonical, CASE WHEN p_size % 2 = 0 THEN [p_brand, p_type] ELSE []::VARCHAR[] END AS variants FROM part), a AS (SELECT list_prepend(canonical, variants) AS al FROM t), e AS (SELECT unnest(al) AS v, al FROM a) SELECT lower(v) AS token, list_sort(list_distinct(flatten(list(al)))) AS variants FROM e GROUP BY 1")
def x15_lexicon(spark, d):
    """Names of parts with brands and types as their variants."""
    part = load(spark, d, "part")
    return records.lexicon(part.select(F.col("p_name").alias("canonical"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type")).alias("variants")))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Linux' WHEN 1 THEN 'DBMS' WHEN 2 THEN CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN c_mktsegment END END AS field FROM customer")
def x24_fields(spark, d):
    """Names of fields as customers might give them: aliases, segments of which two are known, blanks."""
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, "linux").when(k == 1, " DB ").when(k == 2, F.concat(F.lit(" "), "c_mktsegment")).otherwise(" ")
    return load(spark, d, "customer").select("c_custkey", records.field_name(name, ["MACHINERY", "FURNITURE"]).alias("field"))


@query("SELECT p_partkey, coalesce(nullif(lower(regexp_replace(regexp_replace(trim(p_name), '[^a-zA-Z0-9가-힣_-]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'bundle') AS slug, 'bundle:' || p_partkey AS id FROM part")
def x27_bundle_slug(spark, d):
    return load(spark, d, "part").select("p_partkey", records.slug(F.col("p_name")).alias("slug"), records.bundle_id(F.col("p_partkey").cast("string")).alias("id"))


@query("SELECT c_custkey, '# [failure_bucket] ' || c_name || chr(10) || 'fb_domain: os' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || '프로토콜: tcp' ELSE '' END || chr(10) || '근거: log:' || c_custkey || chr(10) || chr(10) || '증상: ' || c_mktsegment || chr(10) || chr(10) || '판별 신호:' || chr(10) || '- a' || chr(10) || '- ' || c_mktsegment || chr(10) || chr(10) || '반증 신호:' || chr(10) || '- (없음)' || chr(10) || chr(10) || '근본원인: (미상)' || chr(10) || chr(10) || '조치: call' AS body FROM customer")
def x28_bucket_text(spark, d):
    c, none = F.col("c_mktsegment"), F.array().cast("array<string>")
    protocol = F.when(F.col("c_custkey") % 2 == 0, "tcp").otherwise("")
    body = records.bucket_text(F.col("c_name"), F.lit("os"), protocol, F.concat(F.lit("log:"), "c_custkey"), c, F.array(F.lit("a"), c), none, F.lit(""), F.lit("call"))
    return load(spark, d, "customer").select("c_custkey", body.alias("body"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 WHEN 'click' THEN 1 END AS rating FROM events")
def x29_rating(spark, d):
    verdict = F.element_at(F.create_map(*[F.lit(x) for x in ("purchase", "Helpful", "error", "FAILED", "click", " edited ", "view", "seen", "signup", "")]), F.col("event_type"))
    return load(spark, d, "events").select("event_id", records.rating(verdict).alias("rating"))


# ---- ranges, gates, shares


@query("SELECT 'listing' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'all', count(*) FROM orders UNION ALL SELECT 'since', count(*) FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderdate >= TIMESTAMP '1996-01-01' UNION ALL SELECT 'other', count(*) FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
def f04_ranges(spark, d):
    """A listing and aggregations over two date fields, of which one is missing in every fifth row."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    fields = {"Created": F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")), "Resolved": F.col("o_orderdate")}
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    kinds = {"listing": ("Created", None, None, True), "all": ("nonsense", None, None, False), "since": ("Created", at("1996-01-01"), None, False), "other": ("Resolved", at("1995-01-01"), at("1995-12-31"), True)}
    out = None
    for name, how in kinds.items():
        one = A.dated(orders, fields, *how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_FOLD} SELECT id, round(score, 9) AS score FROM fold WHERE (SELECT max(score) FROM fold) >= 0.012 AND round(score, 9) >= 0.2 ORDER BY score DESC, id LIMIT 15")
def f07_gate_min_score(spark, d):
    return R.gated(_fold(spark, d).select("id", F.round("score", 9).alias("score")), 15, min_score=0.2)


@query("WITH o AS (SELECT o_orderkey, n.n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation n ON n_nationkey = c_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01') SELECT n_name, count(*) AS n, round(count(*) / (SELECT count(*) FROM o), 4) AS share FROM o GROUP BY n_name")
def a04_entity_share_dated(spark, d):
    """Shares of entities in a date range, which holds for the counts and for their total."""
    orders = A.dated(load(spark, d, "orders"), {"Created": F.col("o_orderdate")}, "Created", F.lit("1996-01-01").cast("timestamp_ntz"), None, False).select("o_custkey")
    rows = orders.join(load(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("n").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))  # one row
    return rows.join(F.broadcast(total)).select("n_name", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


_READY = ("documents", "embeddings", "labels", "events", "pages", "conversations", "benchmark", "orders")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, count(*) >= 1000 AS ready FROM {t}" for t in _READY))
def a12_readiness_all(spark, d):
    """Rows of all eight tables that a service needs; counts come from the files' footers."""
    out = None
    for t in _READY:
        one = load(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n", (F.col("n") >= 1000).alias("ready"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'tech_repo' WHEN 1 THEN 'tech_repo' WHEN 2 THEN 'checkitem' END AS search, CASE doc_id % 5 WHEN 0 THEN 'confluence_docs' WHEN 1 THEN 'tech_repo' WHEN 2 THEN 'checkitem' WHEN 3 THEN 'confluence_docs' END AS upload FROM documents")
def x31_aliases(spark, d):
    """What a document's source might be called, in a search and at an upload; its own name stands for no source."""
    k = F.col("doc_id") % 5
    name = F.when(k == 0, "Docs").when(k == 1, " wiki").when(k == 2, "checkitem").when(k == 3, "confluence_docs").otherwise(F.col("source"))
    return load(spark, d, "documents").select("doc_id", records.source_of(name, False).alias("search"), records.source_of(name, True).alias("upload"))


_MORE = "CASE lower(t) " + " ".join(f"WHEN '{k}' THEN [" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in records.SYNONYMS.items()) + " ELSE []::VARCHAR[] END"


@query(f"WITH w AS (SELECT conv_id, turn, list_append(regexp_extract_all(lower(text), '[a-z0-9가-힣]{{2,}}')[1:3], CASE turn % 3 WHEN 0 THEN 'FS' WHEN 1 THEN 'oom' ELSE 'none' END) AS terms FROM conversations), e AS (SELECT conv_id, turn, list_concat(terms, flatten(list_transform(terms, lambda t: {_MORE}))) AS all_terms FROM w) SELECT conv_id, turn, list_sort(list_distinct(all_terms)) AS terms FROM e")
def x26_terms(spark, d):
    """The first terms of every turn and one that check items know, with their synonyms."""
    k = F.col("turn") % 3
    first = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(L.TERM), 0), 1, 3)
    terms = F.array_append(first, F.when(k == 0, "FS").when(k == 1, "oom").otherwise("none"))
    return load(spark, d, "conversations").select("conv_id", "turn", F.array_sort(records.expanded(terms)).alias("terms"))


# ---- lookups and lists again, with all their rules


@query("WITH w(ref) AS (VALUES ('wiki/3'), ('7'), ('file/src2'), ('raw/rc19'), ('none')), c AS (SELECT ref, regexp_replace(ref, '^(wiki|raw|file)/', '') AS k FROM w), t AS (SELECT ref, doc_id, 1 AS tier FROM c JOIN documents ON doc_id::VARCHAR = k UNION ALL SELECT ref, min(doc_id), 2 FROM c JOIN documents ON source = k GROUP BY ref UNION ALL SELECT ref, min(doc_id), 3 FROM c JOIN documents ON contains(source, k) GROUP BY ref) SELECT ref, doc_id, tier FROM t QUALIFY row_number() OVER (PARTITION BY ref ORDER BY tier, doc_id) = 1")
def f11_resolver_tiers(spark, d):
    """By key, by the whole source name, by a part of it; the first tier that finds something counts."""
    refs = spark.createDataFrame([("wiki/3",), ("7",), ("file/src2",), ("raw/rc19",), ("none",)], "ref string").withColumn("k", F.regexp_replace("ref", "^(wiki|raw|file)/", ""))
    k, source = F.col("k"), F.col("source")
    tier = F.when(F.col("doc_id").cast("string") == k, 1).when(source == k, 2).when(F.contains(source, k), 3)
    rows = load(spark, d, "documents").select("doc_id", "source").join(F.broadcast(refs), F.contains(source, k) | (F.col("doc_id").cast("string") == k))
    return rows.groupBy("ref").agg(F.min(F.struct(tier.alias("tier"), "doc_id")).alias("x")).select("ref", "x.doc_id", "x.tier")


@query("SELECT e.label AS entity, d.source, count(*) AS n FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.label IN (1, 3) AND d.source IN ('src0', 'src1', 'src2') GROUP BY ALL")
def j07_entity_documents(spark, d):
    """Documents of some entities (labels of their vectors) in some sources."""
    docs = load(spark, d, "documents").where("source IN ('src0', 'src1', 'src2')").select("doc_id", "source")
    links = load(spark, d, "embeddings").where("label IN (1, 3)").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("entity"))
    return docs.join(links, "doc_id").groupBy("entity", "source").agg(F.count(F.lit(1)).alias("n"))


_ALIASES = [(1, "trash"), (1, "scum"), (2, "license"), (4, "idiot"), (5, "x")]


@query("WITH a(entity_id, alias) AS (VALUES " + ", ".join(str(x) for x in _ALIASES) + ") SELECT DISTINCT d.doc_id, a.entity_id, 0.85::DOUBLE AS confidence FROM documents d JOIN a ON length(alias) >= 2 AND contains(lower(d.text), a.alias) WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1 AND a.entity_id = 1)")
def j08_new_links(spark, d):
    """Links of entities to texts that have an alias of two characters at least, without those that are there (labels tell some)."""
    low = F.lower("text")
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(a)), F.lit(i)) for i, a in _ALIASES if len(a) >= 2])))
    links = load(spark, d, "documents").select("doc_id", F.explode(found).alias("entity_id"))
    there = load(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("entity_id"))
    return links.join(there, ["doc_id", "entity_id"], "left_anti").withColumn("confidence", F.lit(0.85))


@query("SELECT event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 10")
def a09_recent(spark, d):
    """The ten latest of each kind; tasks cut to ten before the shuffle."""
    latest = R.Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id")
    return load(spark, d, "events").select("event_type", "event_id", "ts").withColumn("r", F.row_number().over(latest)).where("r <= 10").drop("r")


_RAW = [("src0", 100), ("src1", 5), ("src99", 7)]


@query("WITH m(source, raw) AS (VALUES " + ", ".join(str(x) for x in _RAW) + "), c AS (SELECT source, count(*) AS documents, count(e.vec_id) AS embedded, sum(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''))) AS chunks FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id GROUP BY source) SELECT coalesce(c.source, m.source) AS source, coalesce(raw, 0) AS raw, coalesce(documents, 0) AS documents, CAST(coalesce(chunks, 0) AS BIGINT) AS chunks, coalesce(embedded, 0) AS embedded, CASE WHEN coalesce(documents, 0) = 0 THEN CASE WHEN coalesce(raw, 0) > 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END ELSE least(100.0::DOUBLE, round(100.0::DOUBLE * embedded / documents, 1)) END AS pct FROM c FULL JOIN m ON m.source = c.source")
def a08_progress_raw(spark, d):
    """Progress over a manifest of raw files: a source that has files and no documents stands at 0."""
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    docs = load(spark, d, "documents").select("doc_id", "source", lines.alias("lines"))
    rows = docs.join(load(spark, d, "embeddings").select(F.col("vec_id").alias("e")), F.col("doc_id") == F.col("e"), "left")
    rows = rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("lines").alias("chunks"), F.count("e").alias("embedded"))
    rows = rows.join(spark.createDataFrame(_RAW, "source string, raw long"), "source", "full_outer").na.fill(0, ["raw", "documents", "chunks", "embedded"])
    pct = F.when(F.col("documents") == 0, F.when(F.col("raw") > 0, 0.0).otherwise(100.0)).otherwise(F.least(F.lit(100.0), F.round(100.0 * F.col("embedded") / F.nullif("documents", F.lit(0)), 1)))
    return rows.select("source", "raw", "documents", "chunks", "embedded", pct.alias("pct"))


@query("WITH c AS (SELECT doc_id, i - 1 AS ordinal, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)), s AS (SELECT doc_id, ordinal, 3 * (contains(lower(line), 'trash')::INT + contains(lower(line), 'license')::INT) + least(length(line) // 200, 5) AS score FROM c) SELECT doc_id, ordinal, score FROM s WHERE score >= 3 AND ordinal <> 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) <= 4")
def r23_new_siblings(spark, d):
    """Chunks beside those already listed (the first of each text), the four best."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))
    score = 3 * T.hits(F.array(F.lit("trash"), F.lit("license")), F.col("line")) + F.least(F.floor(F.length("line") / 200), F.lit(5))
    listed = load(spark, d, "documents").select("doc_id", F.lit(0).cast("long").alias("ordinal"))
    rows = lines.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), score.cast("long").alias("score")).where("score >= 3").join(listed, ["doc_id", "ordinal"], "left_anti")
    best = R.Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal")
    return rows.withColumn("r", F.row_number().over(best)).where("r <= 4").drop("r")
