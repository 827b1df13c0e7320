"""Markdown documents as chunks under headings, within a budget of estimated tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Estimated tokens (two characters each) of a chunk, and of the paragraphs that the next one repeats.
MOST, OVERLAP = 512, 64
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+)$", re.M)


def estimate(text: str) -> int:
    return max(1, len(text) // 2)


def sections(text: str) -> list[tuple[str, str]]:
    """(heading, content) in order; what stands before the first heading has none; those without content are left out."""
    text = text.strip()
    heads = list(_HEADING.finditer(text))
    edges = [0, *(h.start() for h in heads), len(text)]
    found = [("", text[: edges[1]])] + [(h[2].strip(), text[h.end() : stop]) for h, stop in zip(heads, edges[2:], strict=True)]
    return [(h, c.strip()) for h, c in found if c.strip()]


def pieces(content: str, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs put together up to the budget; a paragraph is never cut; the last ones are repeated within the overlap."""
    if estimate(content) <= most:
        return [content]
    out, held, size = [], [], 0
    for p in re.split(r"\n{2,}", content):
        if held and size + estimate(p) > most:
            out.append("\n\n".join(held))
            tail, room = [], overlap
            while held and estimate(held[-1]) <= room:
                room -= estimate(held[-1])
                tail.insert(0, held.pop())
            held, size = tail, sum(map(estimate, tail))
        held.append(p)
        size += estimate(p)
    return [*out, "\n\n".join(held)]


def header(source: Column, key: Column, title: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(" | ", source, key, F.left(title, F.lit(80))), F.lit("]"))


def chunked(docs: DataFrame, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """docs: id, header, body -> id, ordinal, section, header, text, tokens; null and blank bodies have no chunks."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, n, s, f"{h} | {s}" if s else h, t, estimate(t)) for i, h, b in f.itertuples(index=False) for n, (s, t) in enumerate((s, t) for s, c in sections(b or "") for t in pieces(c, most, overlap))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "section", "header", "text", "tokens"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "header", "body").mapInPandas(cut, f"id {kind}, ordinal int, section string, header string, text string, tokens int")
