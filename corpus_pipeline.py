"""A corpus pipeline of five stages: rules, classifier, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return
the columns of their input. Stages are written as Parquet and read again, so a lost executor
repeats a part of one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import ngram_join, packing, quality_classifier, quality_rules, suffix_dedup
from cairn.llm.tables import stored, table

#: Near duplicates: words of a shingle, and the least similarity in percent.
SHINGLE, SIMILAR = 5, 80
#: Bytes of a passage that goes when an earlier document has it; shorter ones (single lines, phrases) stay.
PASSAGE = 160
#: Least score of the quality classifier.
GOOD = 0.5


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected by the current policy of the rule ledger: gone. Null and empty texts have no words and go."""
    rows = docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_in"))
    return quality_rules.kept_rows(quality_rules.ledger(rows, "_in", ("_doc",))).select("_doc.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scored below GOOD: gone. All labelled rows may be learnt from."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", F.col("quality").alias("label")), GOOD)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; rows without an id stay.

    Rows that share an id are one document: each of its different texts stays, of equal ones the row that is first by all its columns.
    """
    groups = ngram_join.join(docs, SHINGLE, SIMILAR)
    key, place = _free(docs, "key"), _free(docs, "place")
    least = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(least, docs["doc_id"] == least[key], "left_semi")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)).orderBy(F.to_json(F.struct(F.isnull("text").alias("text"), *rest)))
    return kept.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place).unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut out (a character cut in two goes with them); n_chars follows."""
    key, row, kept = (_free(docs, x) for x in ("key", "row", "kept"))
    cut = suffix_dedup.cut_repeats(docs, PASSAGE, as_text=True).select(F.col("row").alias(row), F.col("kept").alias(kept))
    rows = docs.withColumn(key, suffix_dedup._row()).join(cut, F.col(key) == F.col(row), "left")
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNotNull(), F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in the token windows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", pack),
]

#: SQL can't express the classifier or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
