"""Text functions over columns; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_of(text: Column) -> Column:
    """First line."""
    return F.substring_index(text, "\n", 1)


def clean_markup(text: Column) -> Column:
    """Wiki macros out whatever their case, code macros to fences, no-break spaces to spaces, dash noise out, four and more line ends to three, trimmed."""
    x = F.regexp_replace(text, "\u00a0|&nbsp;", " ")
    x = F.regexp_replace(x, r"(?i)\{(?:color|panel)[^}]*\}", "")
    x = F.regexp_replace(x, r"(?i)\{code[^}]*\}", "```")
    x = F.regexp_replace(x, r"(?i)\{noformat\}", "")
    x = F.regexp_replace(x, r"\{-+\}\{\{-\}\}*", "")
    return F.regexp_replace(F.regexp_replace(x, r"\n{4,}", "\n\n\n"), r"(?U)^\s+|\s+$", "")


def content_hash(title: Column, body: Column, metadata: Column | None = None) -> Column:
    """SHA-256 of title, body and the metadata map as JSON with sorted keys."""
    meta = F.lit("{}") if metadata is None else F.to_json(F.map_from_entries(F.array_sort(F.map_entries(metadata))))
    return F.sha2(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")), meta), 256)


def stable_id(source_type: Column, external_id: Column) -> Column:
    """source:id with unsafe characters replaced, at most 64 characters; longer ones end in a hash instead of being cut alike."""
    x = F.regexp_replace(F.concat_ws(":", source_type, external_id), r"[^A-Za-z0-9_.:\-]", "_")
    return F.when(F.length(x) <= 64, x).otherwise(F.concat(F.left(x, F.lit(55)), F.lit("_"), F.left(F.md5(x), F.lit(8))))


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str | None) -> Column:
    """Label of the first rule whose pattern the text has."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return F.coalesce(out, F.lit(otherwise)) if otherwise is not None else out


def classify(title: Column, body: Column, rules: list[tuple[str, str]], otherwise: str, body_chars: int = 2500) -> Column:
    """All rules over the title first, then all over the head of the body."""
    return F.coalesce(first_match(F.lower(title), rules, None), first_match(F.lower(F.left(body, F.lit(body_chars))), rules, None), F.lit(otherwise))


def lenient_date(text: Column) -> Column:
    """The first year-month-day anywhere, with -, / or .; null if it isn't a date."""
    part = [F.regexp_extract(text, r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", i) for i in (1, 2, 3)]
    return F.try_to_date(F.concat_ws("-", *part), "y-M-d")


def token_set(text: Column, least: int = 2) -> Column:
    """Distinct lower-cased runs of ASCII letters, digits and Hangul."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z0-9가-힣]{{{least},}}"), 0))


def token_estimate(text: Column, packing: bool = True) -> Column:
    """Estimated tokens: half the length, rounded up where windows are packed and down where texts are chunked; 1 at least."""
    n = F.length(text)
    return F.greatest(F.floor((n + 1) / 2) if packing else F.floor(n / 2), F.lit(1)).cast("long")


def citation_ids(text: Column) -> Column:
    """[C1]-like marks, upper-cased, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[([Cc]\d+)\]"), 1), F.upper))


def commands(text: Column) -> Column:
    """Prompt lines' commands under 160 characters, distinct, eight at most."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*[$#][ \t]+(\S.*?)[ \t]*$"), 1)
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) < 160)), 1, 8)


def macro_names(html: Column, pattern: str = r"(?s)<title>(.*?)</title>") -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), 1)


def hits(tokens: Column, text: Column) -> Column:
    """How many of the tokens the text contains, whatever their case."""
    low = F.lower(text)
    return F.size(F.filter(tokens, lambda t: F.contains(low, F.lower(t))))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once for a row, however often f has it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _flat(text: Column) -> Column:
    """White space collapsed and trimmed; single spaces are no matches, so most text is copied in long stretches."""
    return F.trim(F.regexp_replace(text, r"\s{2,}|[\t\n\x0B\f\r]", " "))


def _window(flat: Column, hit: Column, before: int, width: int, mark: str) -> Column:
    def cut(start: Column) -> Column:
        tail = F.when(F.length(flat) >= start + width, F.lit(mark)).otherwise(F.lit(""))
        return F.concat(F.when(start > 1, F.lit(mark)).otherwise(F.lit("")), F.substring(flat, start, F.lit(width)), tail)

    return once(F.greatest(hit - before, F.lit(1)), cut)


def snippet(text: Column, token: str, before: int = 40, width: int = 220) -> Column:
    """A window from shortly before the first hit, white space collapsed, with ellipses where it was cut."""
    return once(_flat(text), lambda flat: _window(flat, F.locate(token.lower(), F.lower(flat)), before, width, "..."))


def snippet_around(text: Column, tokens: list[str], before: int = 40, width: int = 220) -> Column:
    """A window from shortly before the first hit of the first token, in their order, that the text has; from the start if it has none."""

    def first(low: Column, left: list[str]) -> Column:
        return once(F.locate(left[0].lower(), low), lambda at: F.when(at > 0, at).otherwise(first(low, left[1:]))) if left else F.lit(1)

    def cut(flat: Column) -> Column:
        return F.when(flat == "", "").otherwise(_window(flat, once(F.lower(flat), lambda low: first(low, tokens)), before, width, "…"))

    return once(_flat(F.coalesce(text, F.lit(""))), cut)


def frame_quality(symptom: Column, cause: Column, resolution: Column) -> Column:
    """Weights of the three slots by whether they have 20 characters, and a bonus if cause and resolution both have."""
    def slot(c: Column, long: float, short: float) -> Column:
        n = F.length(F.trim(F.coalesce(c, F.lit(""))))
        return F.when(n >= 20, long).when(n > 0, short).otherwise(0.0)

    both = (F.length(F.trim(cause)) >= 20) & (F.length(F.trim(resolution)) >= 20)
    return F.round(F.least(slot(symptom, 0.25, 0.1) + slot(cause, 0.35, 0.15) + slot(resolution, 0.4, 0.15) + F.when(both, 0.1).otherwise(0.0), F.lit(1.0)), 3)
