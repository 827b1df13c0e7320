"""Markdown and JSON knowledge sources as document tables, seeds, manifests, and the audit sink.

Every scan returns COLUMNS, so that scans can be put together by name. Files are read whole, one row per file, in
parallel; what a source doesn't know is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import taxonomy
from cairn.functions.records import UPLOADS
from cairn.functions.text import clean_markup

COLUMNS = ("source_type", "external_id", "title", "body", "metadata", "grade", "work_type", "environment", "domain", "path_l2", "path_l3")


def _document(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    return rows.select(F.lit(source).alias("source_type"), *[columns.get(c, F.lit(None).cast("string")).alias(c) for c in COLUMNS[1:]])


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("value").alias("body"), F.regexp_replace(name, r"\.[A-Za-z]+$", "").alias("stem"), name.alias("file")).where(~F.col("file").startswith("."))


def pairs(text: Column, line: str) -> Column:
    """A map of key and value groups of a line pattern; of repeated keys the last counts."""
    entries = F.arrays_zip(F.regexp_extract_all(text, F.lit(line), 1).alias("k"), F.regexp_extract_all(text, F.lit(line), 2).alias("v"))
    return F.aggregate(entries, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != F.trim(e["k"])), F.create_map(F.trim(e["k"]), F.trim(e["v"]))))


def first_heading(text: Column, levels: str = "1") -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^#{{1,{levels}}}[ \t]+(.+)$", 1)), F.lit(""))


def front_matter(text: Column) -> Column:
    return pairs(F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---", 1), r"""(?m)^([^:：\n]+)[:：][ \t]*["']?(.*?)["']?[ \t]*$""")


_FRONT = r"(?s)^---\s*\n.*?\n---[ \t]*\n?"


def _given(key: str) -> Column:
    return F.nullif(F.trim(F.try_element_at("metadata", F.lit(key))), F.lit(""))


def tickets(spark: SparkSession, path: str) -> DataFrame:
    """Support tickets: bold-labelled list lines are the metadata, the issue key is the id, else the file's stem."""
    body = F.col("body")
    rows = _files(spark, path, "*.{md,txt}").withColumn("metadata", pairs(body, r"(?m)^\s*-\s*\*\*(.+?)\*\*\s*:\s*(.*)$"))
    title, clean = F.coalesce(first_heading(body), "stem"), clean_markup(body)
    cloud = F.rlike(F.concat(title, F.left(clean, F.lit(2000))), F.lit("(?i)SCP|클라우드"))
    return _document(rows, "support_history", external_id=F.coalesce(_given("Issue Key"), "stem"), title=F.left(title, F.lit(1000)), body=clean, metadata=F.col("metadata"), grade=taxonomy.grade(F.coalesce(_given("Status"), F.lit(""))), work_type=_given("Component"), environment=F.when(cloud, "csp"))


def _pages(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Front matter, its body, and a title from it or from the first heading of levels 1 to 3, at most 200 characters."""
    rows = _files(spark, path, "*.md").withColumn("metadata", front_matter(F.col("body"))).withColumn("body", F.regexp_replace("body", _FRONT, ""))
    title = F.coalesce(*[F.when(F.length(x) >= 2, x) for x in (_given("title"), _given("제목"))], first_heading(F.col("body"), "3"), F.col("stem"))
    return rows.select("*", F.left(title, F.lit(200)).alias("title"), F.coalesce(_given("Page ID"), F.regexp_replace("stem", "^confluence_", "")).alias("external_id"))


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """Wiki pages: the third part of the breadcrumb is path_l2 (else its last), with the fourth path_l3; the domain follows from it."""
    directory = F.coalesce(_given("directory"), _given("디렉토리"), F.lit(""))
    rows = _pages(spark, path, "tech_repo").withColumn("parts", F.filter(F.transform(F.split(directory, ">"), lambda x: F.trim(x)), lambda x: x != ""))
    third, fourth = F.get("parts", F.lit(2)), F.get("parts", F.lit(3))
    l2 = F.coalesce(third, F.try_element_at("parts", F.lit(-1)))
    return _document(rows, "tech_repo", external_id=F.col("external_id"), title=F.col("title"), body=clean_markup(F.col("body")), metadata=F.col("metadata"), grade=F.lit("A"), path_l2=l2, path_l3=F.when(fourth.isNotNull(), F.concat(third, F.lit(" > "), fourth)).otherwise(l2), domain=taxonomy.domain_of_path(directory))


def exported_pages(spark: SparkSession, path: str) -> DataFrame:
    """Exported pages: as wiki pages, without a breadcrumb."""
    rows = _pages(spark, path, "confluence_docs")
    return _document(rows, "confluence_docs", external_id=F.col("external_id"), title=F.col("title"), body=clean_markup(F.col("body")), metadata=F.col("metadata"), grade=F.lit("A"))


def tuning_reports(spark: SparkSession, path: str) -> DataFrame:
    rows = _files(spark, path, "*.md").withColumn("metadata", front_matter(F.col("body"))).withColumn("body", F.regexp_replace("body", _FRONT, ""))
    return _document(rows, "tuning_ai", external_id=F.coalesce(_given("issue_id"), "stem"), title=F.coalesce(first_heading(F.col("body")), "stem"), body=clean_markup(F.col("body")), metadata=F.col("metadata"), grade=F.lit("A-"), domain=F.lower(_given("domain")))


def check_items(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of check items in JSON files: one document per code, its body from the labelled sections that have text."""
    raw = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    text = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
    sections = [F.when(F.length(F.trim(text(c))) > 0, F.concat(F.lit(f"## {c}\n"), text(c))) for c in ("method", "criteria", "result", "remediation")]
    meta = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in raw.columns]), lambda e: e["value"].isNotNull()))
    return _document(raw, "checkitem", external_id=text("Code"), title=text("Subject"), body=F.concat_ws("\n\n", *sections), metadata=meta, grade=F.lit("A"), domain=F.lower(text("Area"))).where("external_id IS NOT NULL")


def seeds(spark: SparkSession, path: str, schema: str, fallback: list[tuple]) -> DataFrame:
    """Rows of a seed file (a JSON array of records); those of the fallback where the file is missing or holds none."""
    try:
        rows = spark.read.schema(schema).option("multiLine", True).json(path)
        if rows.take(1):
            return rows
    except Exception as e:  # a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return spark.createDataFrame(fallback, schema)


def raw_manifest(spark: SparkSession, path: str) -> DataFrame:
    """source, files of a manifest {sources: {name: {files}}}; no rows where it is missing or malformed."""
    kind = "sources map<string, struct<files: bigint>>"
    rows = seeds(spark, path, kind, [])
    return rows.where("sources IS NOT NULL").select(F.explode("sources").alias("source", "x")).select("source", F.coalesce("x.files", F.lit(0)).alias("files"))


def audit(rows: DataFrame, path: str, day: str = "day") -> None:
    """Append query or answer rows below path, a folder for each day; what was written before isn't read."""
    rows.write.mode("append").partitionBy(day).parquet(path)


SCANS = {"support_history": tickets, "tech_repo": wiki_pages, "confluence_docs": exported_pages, "tuning_ai": tuning_reports, "checkitem": check_items}


def scan(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The named sources, put together in the order of SCANS."""
    return reduce(DataFrame.unionByName, [SCANS[name](spark, paths[name]) for name in SCANS if name in paths])


#: Bytes of an upload at most, and the file names that are read.
UPLOAD_BYTES, UPLOAD_NAMES = 20_000_000, (".md", ".txt")


def upload(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One uploaded file as a document of the source that an upload's name stands for (see records.UPLOADS).

    Raises on a name that no scan reads, on another kind of file, and on one that is too large.
    """
    source = UPLOADS.get(name.strip().lower(), name.strip().lower())
    if source not in SCANS or source == "checkitem":
        raise ValueError(f"uploads of {name} can't be read")
    if not path.endswith(UPLOAD_NAMES):
        raise ValueError(f"{path} is none of {UPLOAD_NAMES}")
    size = spark.read.format("binaryFile").load(path).select("length").first()
    if size is None or size["length"] > UPLOAD_BYTES:
        raise ValueError(f"{path} has over {UPLOAD_BYTES} bytes")
    return SCANS[source](spark, path)
