"""Issue frames: symptom, cause, resolution and workaround of a ticket's markdown, with components and commands."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import frame_quality, once

# Labels of the slots as tickets write them, in headings and in bold, and what stands for "not known yet".
LABELS = {
    "symptom": r"(?:이슈\s*)?(?:증상|요청이슈|발생\s*현상|현상)",
    "root_cause": r"(?:이슈\s*)?(?:장애\s*)?(?:근본\s*원인|세부원인|원인(?:\s*및\s*해결)?|분석결과(?:\s*\(?원인\)?)?)",
    "resolution": r"(?:장애\s*)?(?:해결(?:\s*방안|\s*책)?|조치(?:\s*내용|\s*내역|\s*완료)?)",
    "workaround": r"(?:임시\s*조치|워크어라운드|workaround)",
}
BOLD = {"root_cause": r"분석결과\s*\(?원인\)?|분석결과|원인", "resolution": r"조치내용", "symptom": r"요청이슈|배경"}
NOT_KNOWN = re.compile(r"(?:세부\s*원인\s*분석\s*예정|상세\s*원인\s*파악\s*중|원인\s*분석\s*중|미상|N/?A|-)", re.I)
SUMMARY = re.compile(r"##\s*LLM\s*요약(.*?)(?=\n##\s+원본|\Z)", re.I | re.S)
ORIGINAL = re.compile(r"##\s*원본\s*내용(.*?)(?=\n##\s+Comments|\Z)", re.I | re.S)
SOLVED = re.compile(r"^(.+?(?:재기동|reboot|리부팅|재시작|적용|변경|조치|패치|업그레이드).+?)\s*->\s*해결\s*[Oo0]", re.I | re.M)
COMPONENTS = (
    ("Redis", r"\bRedis\b"),
    ("Kubernetes", r"\bKubernetes\b|\bk8s\b|POD"),
    ("ESXi", r"\bESXi\b"),
    ("BFD", r"\bBFD\b"),
    ("Oracle", r"\bOracle\b"),
    ("PostgreSQL", r"\bPostgreSQL\b|\bPostgres\b"),
    ("MySQL", r"\bMySQL\b"),
    ("Network", r"\bNetwork\b|네트워크|Spine|BGW|방화벽"),
    ("Storage", r"\bStorage\b|스토리지|WEKA|Ceph|NetApp"),
    ("Linux", r"\bLinux\b|리눅스"),
    ("SCP", r"\bSCP\b"),
    ("NFS", r"\bNFS\b"),
    ("Cluster", r"\bHA\b|클러스터|Cluster"),
    ("VMware", r"\bVMware\b|vSphere|v-?motion"),
    ("Network", r"\bBGP\b|\bCDN\b"),
)

_LEAD = r"\s*(?:#{1,4}\s*|h[1-6]\.\s*(?:\d+\.?\s*)?|[-*•○.]?\s*\d+[.)]\s*|[-*•○.]\s*)?\**"
_HEADS = [(slot, re.compile(_LEAD + label + r"(?P<rest>.*)$", re.I)) for slot, label in LABELS.items()]
_BOLD = [(slot, re.compile(rf"\*\*(?:{label})\s*\**\s*[:：]?\s*(.+?)(?=\n\s*[-*]*\s*\*\*|\n\s*h[1-3]\.|\n##|\Z)", re.I | re.S)) for slot, label in BOLD.items()]
_ITEM = re.compile(r"\s*(?:[-*•○#]|h\d|\d+[.)])", re.I)


def _tidy(text: str, most: int = 1500) -> str | None:
    t = re.sub(r"^(?:내용|[*])*\s*[:：]\s*", "", text.strip())
    t = re.sub(r"\s+", " ", t).strip(" -•*")
    return t[:most] if len(t) >= 2 and not NOT_KNOWN.fullmatch(t) else None


def _candidates(text: str) -> Iterator[tuple[str, str]]:
    """(slot, text) in the order in which they are weighed: bold labels, sections, values behind a label, notes."""
    for slot, pattern in _BOLD:
        for m in pattern.finditer(text):
            yield slot, m[1]
    lines = text.split("\n")
    heads = [(i, slot, m["rest"]) for i, line in enumerate(lines) for slot, p in _HEADS if (m := p.match(line))]
    stops = [*(i for i, _, _ in heads[1:]), len(lines)][: len(heads)]
    inline = []
    for (i, slot, rest), stop in zip(heads, stops, strict=True):
        body = "\n".join(lines[i + 1 : stop])
        value = re.match(r"\W*?[:：]\s*(.+)$", rest)
        yield slot, (body if len(body.strip()) >= 8 or not value else value[1])[:2500]
        if value:  # up to the next item of a list
            more = next((j for j in range(i + 1, stop) if _ITEM.match(lines[j])), stop)
            inline.append((slot, "\n".join([value[1], *lines[i + 1 : more]])))
    yield from inline
    if m := re.search(r"Workaround\s+([^\n]{10,200})", text, re.I):
        yield "workaround", m[1]
    if solved := SOLVED.findall(text):
        yield "resolution", " / ".join(solved[-3:])


def slots(body: str, title: str) -> dict[str, str | None]:
    """The four slots: of a summary block first, then of the original text; a clearly longer text takes a shorter one's place."""
    found: dict[str, str | None] = dict.fromkeys(LABELS)
    summary, original = SUMMARY.search(body), ORIGINAL.search(body)
    for block in ([summary[1]] if summary else []) + [original[1] if original else body]:
        for slot, text in _candidates(block):
            new, old = _tidy(text), found[slot]
            if new and (not old or len(new) >= len(old) + 20 or len(old) < 40 and len(new) > len(old)):
                found[slot] = new
    if not found["symptom"] and title:
        found["symptom"] = _tidy(re.sub(r"^\[[A-Z][A-Z0-9]*-\d+\]\s*", "", title), 400)
    return found


def components(title: Column, body: Column) -> Column:
    """Distinct names of the components that the title or the head of the body has, in the order of COMPONENTS."""
    whole = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.left(F.coalesce(body, F.lit("")), F.lit(12000)))
    return once(whole, lambda text: F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(name)) for name, p in COMPONENTS]))))


def commands(body: Column) -> Column:
    """Commands behind a prompt at the start of a line of the body's head, under 160 characters, distinct, eight at most."""
    found = F.regexp_extract_all(F.left(body, F.lit(8000)), F.lit(r"(?m)^\s*[$#]\s*([a-zA-Z0-9_./\-]+[^\n]{0,120})"), 1)
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) < 160))), 1, 8)


def extracted(tickets: DataFrame) -> DataFrame:
    """tickets: id, title, body -> id, the slots, components, commands, quality. Null texts have no slots."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = pd.DataFrame([slots(b or "", t or "") for t, b in zip(f["title"], f["body"], strict=True)], columns=list(LABELS), dtype=object)
            yield pd.concat([f[["id", "components", "commands"]].reset_index(drop=True), found], axis=1)

    kind = tickets.schema["id"].dataType.simpleString()
    rows = tickets.select("id", "title", "body", components(F.col("title"), F.col("body")).alias("components"), commands(F.coalesce("body", F.lit(""))).alias("commands"))
    rows = rows.mapInPandas(cut, f"id {kind}, components array<string>, commands array<string>, " + ", ".join(f"{c} string" for c in LABELS))
    return rows.withColumn("quality", frame_quality(F.col("symptom"), F.col("root_cause"), F.col("resolution")))
