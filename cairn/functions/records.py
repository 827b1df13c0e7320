"""Small record functions: access handles, slugs, bucket texts, ratings, field names, labelled sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RATINGS = {"helpful": 1, "resolved": 1, "edited": 1, "not_helpful": -1, "failed": -1, "refuted": -1}
FIELDS = {"aix": "AIX", "hp-ux": "HP-UX", "hpux": "HP-UX", "solaris": "Solaris", "linux": "Linux", "windows": "Windows", "web/was": "Web/WAS", "web": "Web/WAS", "was": "Web/WAS", "web_was": "Web/WAS", "dbms": "DBMS", "db": "DBMS", "database": "DBMS"}

# What a question or an upload calls a source, which differ for exported pages.
SECTIONS = {"tickets": "support_history", "wiki": "tech_repo", "docs": "tech_repo", "tuning": "tuning_ai", "checks": "checkitem"}
UPLOADS = {"tickets": "support_history", "wiki": "tech_repo", "docs": "confluence_docs", "tuning": "tuning_ai", "checks": "checkitem"}
#: Terms of check items with what they are also called.
SYNONYMS = {"fs": ["filesystem", "파일시스템"], "oom": ["out of memory", "메모리 부족"], "leak": ["누수"], "kdump": ["crash dump"], "linux": ["리눅스"]}


def source_of(name: Column, upload: bool) -> Column:
    """The source that a section's or an upload's name stands for; a source's own name stands for itself."""
    names = UPLOADS if upload else SECTIONS
    key = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(_map(names), key), F.when(key.isin(*set(names.values())), key))


def expanded(terms: Column) -> Column:
    """Terms with their synonyms behind them, each once."""
    more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.lower(t)), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(terms, more))


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def document_path(source_type: Column, external_id: Column) -> Column:
    """source/id.md; the source alone without an id."""
    source = F.coalesce(F.nullif(F.trim(source_type), F.lit("")), F.lit("support_history"))
    key = F.nullif(F.trim(external_id), F.lit(""))
    return F.when(key.isNull(), source).when(F.endswith(key, F.lit(".md")), F.concat_ws("/", source, key)).otherwise(F.concat(source, F.lit("/"), key, F.lit(".md")))


def body_link(source_type: Column, external_id: Column) -> Column:
    """Where the whole text is: check items by code, others by id and source."""
    key = F.url_encode(external_id)
    return F.when(source_type == "checkitem", F.concat(F.lit("/v1/checkitems/"), key)).otherwise(F.concat(F.lit("/v1/tickets/"), key, F.lit("?source_type="), F.url_encode(source_type)))


def slug(name: Column) -> Column:
    x = F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"[^a-zA-Z0-9가-힣_-]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("bundle"))


def bundle_id(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("bundle:")), name).otherwise(F.concat(F.lit("bundle:"), name))


def rating(verdict: Column) -> Column:
    """1 or -1 of a verdict in any case; null if it is none."""
    return F.try_element_at(_map(RATINGS), F.lower(F.trim(verdict)))


def field_name(name: Column, known: list[str]) -> Column:
    t = F.nullif(F.trim(name), F.lit(""))
    return F.when(t.isin(*known), t).otherwise(F.try_element_at(_map(FIELDS), F.lower(t)))


def bucket_text(name: Column, domain: Column, protocol: Column, evidence: Column, symptom: Column, signals: Column, counter: Column, cause: Column, action: Column) -> Column:
    """The text that is searched for a failure bucket; counts are left out, so its hash only changes with its meaning."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("(미상)"))
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda s: F.concat(F.lit("- "), s)), "\n")).otherwise("- (없음)")
    line = lambda label, c: F.concat(F.lit(label), c)
    head = F.concat_ws("\n", line("# [failure_bucket] ", name), line("fb_domain: ", domain), line("프로토콜: ", F.nullif(protocol, F.lit(""))), line("근거: ", evidence))
    return F.concat_ws("\n\n", head, line("증상: ", known(symptom)), line("판별 신호:\n", listed(signals)), line("반증 신호:\n", listed(counter)), line("근본원인: ", known(cause)), line("조치: ", known(action)))


def labelled_sections(raw: Column, spec: list[tuple[str, str]], fallback: dict[str, Column] | None = None) -> Column:
    """Array of key, label, value: the fields of spec in their order, then the raw map's others; empty ones are left out."""
    value = lambda k: F.coalesce(F.nullif(F.trim(F.try_element_at(raw, F.lit(k))), F.lit("")), (fallback or {}).get(k, F.lit(None)).cast("string"))
    known = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), value(k).alias("value")) for k, label in spec])
    rest = F.transform(F.filter(F.map_entries(raw), lambda e: ~e["key"].isin(*[k for k, _ in spec])), lambda e: F.struct(e["key"].alias("key"), e["key"].alias("label"), e["value"].alias("value")))
    return F.filter(F.concat(known, rest), lambda e: F.length(F.trim(e["value"])) > 0)


def lexicon(terms: DataFrame) -> DataFrame:
    """terms: canonical, variants -> token (lower case), and all variants of the terms it stands in."""
    rows = terms.select(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("variants", F.array().cast("array<string>")))).alias("all"))
    pairs = rows.select(F.explode("all").alias("v"), "all").select(F.lower("v").alias("token"), F.explode("all").alias("variant")).distinct()
    return pairs.groupBy("token").agg(F.array_sort(F.collect_list("variant")).alias("variants"))
