"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one
bit per failed rule; policies (versioned bit masks) and ablations are then bitwise
work on the ledger, without another look at the texts.

Edge cases: a null text counts as empty (no words, fails ``few_words``); ties and repeated
rows each get their own ledger row; an empty table gives an empty ledger; other columns
of the input are kept out of the ledger, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.tables import table, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: Rule name -> condition of failure over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "shouting": "100 * n_exclamations > 50 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 40 * n_words",
}
#: Policy version -> the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "shouting", "long_words"),
    "v2": tuple(RULES),
}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations")


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def _pairs(a: Column) -> Column:
    """Neighbours of an array as structs (0, 1); the last has no right neighbour."""
    return F.arrays_zip(a.alias("0"), F.slice(a, 2, F.greatest(F.size(a), F.lit(1))).alias("1"))


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements of every whole text, beside the columns in ``keep``.

    Repeats are found by sorting the hashes of a text's five-word windows, so a text of n
    words takes n log n steps, however often its windows repeat.
    """
    w = F.col("_words")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.transform(
        F.arrays_zip(*[F.slice(w, i + 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))) for i in range(WINDOW)]),
        lambda x: F.xxhash64(*[x[str(i)] for i in range(WINDOW)]),
    )
    # xxhash64 skips nulls, but words are never null, so equal hashes mean equal windows
    d = docs.select(*keep, text_or_empty(text).alias("_text"))
    d = d.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    d = d.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", r"[^!]+", "")).cast("long").alias("n_exclamations"),
        lines.alias("_lines"),
        windows.alias("_windows"),
    )
    h, s, p = F.col("_windows"), F.col("_sorted"), F.col("_at")
    d = d.select(
        *keep,
        *("n_words", "word_chars", "n_symbols", "n_exclamations", "_windows"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        (F.size(h) > F.size(F.array_distinct(h))).alias("_again"),
    )
    # (hash, position) in order: equal neighbours are repeats; then words covered from left to right
    d = d.withColumn(
        "_sorted",
        F.when(F.col("_again"), F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("p")))),
    )
    equal = F.filter(_pairs(s), lambda x: x["0"]["h"] == x["1"]["h"])
    d = d.withColumn(
        "_at",
        F.when(F.col("_again"), F.sort_array(F.array_distinct(F.flatten(F.transform(equal, lambda x: F.array(x["0"]["p"], x["1"]["p"])))))),
    )
    covered = F.aggregate(_pairs(p), F.lit(0).cast("long"), lambda acc, x: acc + F.least(F.lit(WINDOW), F.coalesce(x["1"] - x["0"], F.lit(WINDOW))))
    return d.withColumn("n_repeat_words", F.when(F.col("_again"), covered).otherwise(F.lit(0)).cast("long")).select(*keep, *MEASURES)


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements with ``fail_bits``: bit i is set if rule i of RULES fails.

    Ledger rows are numbered. A filter that reads the numbers can't be moved below the measurements, where
    each would be evaluated again for every rule that reads it.
    """
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, cond in enumerate(RULES.values())])
    return measured(docs, text, keep).withColumns({"fail_bits": bits.cast("long"), "ledger_row": F.monotonically_increasing_id()})


def apply_policy(rows: DataFrame, policy: str = CURRENT, kept: str = "kept") -> DataFrame:
    """A verdict per ledger row: kept if none of the policy's bits is set."""
    return rows.withColumn(kept, F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def kept_rows(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger rows that a policy keeps. The filter reads the rows' numbers, so it stays above the measurements."""
    return apply_policy(rows, policy, "_kept").where("_kept AND ledger_row >= 0").drop("_kept")


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: rows it fails, rows that only it fails (these would be kept without it).

    One pass over the ledger: a bit_count and one conditional sum per rule, combined on the map side.
    """
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    names = list(RULES)
    one = rows.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum((bits != 0).cast("long")), F.lit(0)).alias("n_rejected"),
        *[F.coalesce(F.sum((bits.bitwiseAND(F.lit(1 << names.index(r))) != 0).cast("long")), F.lit(0)).alias(f"f_{r}") for r in POLICIES[policy]],
        *[F.coalesce(F.sum((bits == F.lit(1 << names.index(r))).cast("long")), F.lit(0)).alias(f"o_{r}") for r in POLICIES[policy]],
    )
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only")) for r in POLICIES[policy]])
    return one.select("n_docs", "n_rejected", F.explode(each).alias("x")).select("x.*", "n_docs", "n_rejected")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents", "doc_id", "text"))
    rows = apply_policy(apply_policy(rows, "base", "base_kept"), CURRENT)
    return rows.select(
        *("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        (~F.col("base_kept")).alias("base_failed"),
        *("kept", "fail_bits"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x : x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_ex,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_ex > 50 * n_words THEN 8 ELSE 0 END
             + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END
             + CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""
