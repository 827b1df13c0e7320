"""Diagrams of wiki pages: names in the macros of a page's storage format, and the attachments that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the storage format.
MACRO = r'(?s)<ac:structured-macro[^>]*ac:name="drawio"[^>]*>(.*?)</ac:structured-macro>'
NAME = r'(?s)<ac:parameter[^>]*ac:name="diagramName"[^>]*>(.*?)</ac:parameter>'
SUFFIX, SOURCES = ".drawio", ("drawio", "xml")
WHITE = " \t\n\x0b\x0c\r"


def diagram_names(body: Column) -> Column:
    """Names in the order of the macros; macros without a name give none, null and malformed bodies an empty array."""
    macros = F.filter(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(MACRO), 1), lambda m: F.rlike(m, F.lit(NAME)))
    return F.transform(macros, lambda m: F.trim(F.regexp_extract(m, NAME, 1), F.lit(WHITE)))


def _step(name: Column, title: Column) -> Column:
    """How an attachment fits a name: 1 with the suffix, 2 bare, 3 by its stem in any case with a source's suffix; null: not."""
    stem, ext = F.regexp_extract(title, r"(?s)^(.*)\.([^.]*)$", 1), F.regexp_extract(title, r"(?s)^(.*)\.([^.]*)$", 2)
    loose = F.contains(title, F.lit(".")) & F.lower(ext).isin(*SOURCES) & (F.lower(stem) == F.lower(F.trim(name, F.lit(WHITE))))
    return F.when(title == F.concat(name, F.lit(SUFFIX)), 1).when(title == name, 2).when(loose, 3)


def diagrams(pages: DataFrame, attachments: DataFrame) -> DataFrame:
    """page_id, name, attachment_id, inline: a row for each macro with its best attachment (null: none), then sources that no macro names.

    pages: page_id, body; attachments: page_id, attachment_id, ordinal (their order on the page), title.
    """
    named = pages.select("page_id", F.posexplode(diagram_names(F.col("body"))).alias("at", "name"))
    fit = named.join(attachments, "page_id").withColumn("step", _step(F.col("name"), F.col("title"))).where("step IS NOT NULL")
    best = fit.groupBy("page_id", "at").agg(F.min_by("attachment_id", F.struct("step", "ordinal")).alias("attachment_id"))
    inline = named.join(best, ["page_id", "at"], "left").select("page_id", "name", "attachment_id", F.lit(True).alias("inline"))
    others = attachments.where(F.endswith("title", F.lit(SUFFIX))).join(best, ["page_id", "attachment_id"], "left_anti")
    stem = F.expr(f"left(title, length(title) - {len(SUFFIX)})")
    return inline.unionByName(others.select("page_id", stem.alias("name"), "attachment_id", F.lit(False).alias("inline")))
