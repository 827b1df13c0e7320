"""Scans of markdown and JSON sources, and text functions over them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import encode
from cairn.functions import text as T
from cairn.sources import knowledge


def test_ticket_scan(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Disk full\n- **Issue Key**: OPS-7\n- **Status**: Closed\n\nBody\n")
    (tmp_path / "b.txt").write_text("no heading\n")
    (tmp_path / "c.bin").write_text("not read")
    rows = {r["external_id"]: r for r in knowledge.tickets(spark, str(tmp_path)).collect()}
    assert set(rows) == {"OPS-7", "b"}
    assert rows["OPS-7"]["title"] == "Disk full" and rows["OPS-7"]["metadata"]["Status"] == "Closed"
    assert rows["b"]["title"] == "b" and rows["b"]["metadata"] == {}


def test_wiki_and_tuning_scan(spark, tmp_path):
    (tmp_path / "w").mkdir(), (tmp_path / "t").mkdir()
    (tmp_path / "w" / "p.md").write_text("---\ntitle: Runbook\nPage ID: 42\n---\n## Steps\n")
    (tmp_path / "t" / "q.md").write_text("---\nissue_id: 'T-1'\ndomain: os\n---\n# Tune\n")
    rows = knowledge.scan(spark, {"tech_repo": str(tmp_path / "w"), "tuning_ai": str(tmp_path / "t")}).collect()
    assert [(r["source_type"], r["external_id"], r["title"]) for r in rows] == [("tech_repo", "42", "Runbook"), ("tuning_ai", "T-1", "Tune")]
    assert rows[1]["metadata"]["domain"] == "os"


def test_check_items(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"Code": "L-1", "Subject": "s", "method": "look", "criteria": ""}, {"Subject": "no code"}]))
    (row,) = knowledge.check_items(spark, str(tmp_path / "c.json")).collect()
    assert row["external_id"] == "L-1" and row["body"] == "## method\nlook" and row["metadata"]["Subject"] == "s"


def test_text_functions(spark):
    row = spark.range(1).select(
        T.clean_markup(F.lit("{color:red}x{color}\n\n\n\n\ny")).alias("clean"),
        T.citation_ids(F.lit("a [c1] b [C2] [C1]")).alias("cites"),
        T.commands(F.lit("text\n$ ls -l\n# df -h\n$ ls -l")).alias("commands"),
        T.stable_id(F.lit("s"), F.lit("x" * 99)).alias("id"),
        T.frame_quality(F.lit("x" * 20), F.lit("y" * 20), F.lit("z")).alias("q"),
    ).first()
    assert row["clean"] == "x\n\n\ny" and row["cites"] == ["C1", "C2"] and row["commands"] == ["ls -l", "df -h"]
    assert len(row["id"]) == 64 and row["q"] == 0.75


def test_document_columns(spark, tmp_path):
    for name in ("t", "w", "c", "u"):
        (tmp_path / name).mkdir()
    (tmp_path / "t" / "a.md").write_text("# Slow cloud SCP\n- **Issue Key**: OPS-8\n- **Status**: Done\n- **Component**: support\n\n{color:red}text{color}\n")
    (tmp_path / "w" / "p.md").write_text("---\ntitle: Runbook\nPage ID: 7\ndirectory: Top > Tech > 데이터베이스 > Oracle\n---\nbody\n")
    (tmp_path / "c" / "confluence_99.md").write_text("## Only heading\ntext\n")
    (tmp_path / "u" / "q.md").write_text("---\nissue_id: T-2\ndomain: OS\n---\n# Tune\n")
    rows = {r["external_id"]: r for r in knowledge.scan(spark, {"support_history": str(tmp_path / "t"), "tech_repo": str(tmp_path / "w"), "confluence_docs": str(tmp_path / "c"), "tuning_ai": str(tmp_path / "u")}).collect()}
    t, w, c, u = (rows[k] for k in ("OPS-8", "7", "99", "T-2"))
    assert (t["grade"], t["work_type"], t["environment"]) == ("A", "support", "csp") and "{color" not in t["body"]
    assert (w["path_l2"], w["path_l3"], w["domain"], w["body"]) == ("데이터베이스", "데이터베이스 > Oracle", "dbms", "body")
    assert (c["title"], c["source_type"], c["grade"]) == ("Only heading", "confluence_docs", "A") and (u["grade"], u["domain"]) == ("A-", "os")


def test_seeds_manifest_and_audit(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"canonical": "disk", "priority": 2}]))
    kind = "canonical string, priority int"
    assert knowledge.seeds(spark, str(tmp_path / "s.json"), kind, []).collect()[0]["priority"] == 2
    assert knowledge.seeds(spark, str(tmp_path / "none.json"), kind, [("net", 1)]).collect()[0]["canonical"] == "net"
    (tmp_path / "m.json").write_text(json.dumps({"sources": {"wiki": {"files": 3, "by_ext": {"md": 3}}, "empty": {}}}))
    (tmp_path / "bad.json").write_text("{sources")
    assert {(r["source"], r["files"]) for r in knowledge.raw_manifest(spark, str(tmp_path / "m.json")).collect()} == {("wiki", 3), ("empty", 0)}
    assert knowledge.raw_manifest(spark, str(tmp_path / "bad.json")).count() == 0 and knowledge.raw_manifest(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([("q1", "2024-01-01"), ("q2", "2024-01-02")], "query string, day string")
    for _ in range(2):
        knowledge.audit(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_upload(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n- **Issue Key**: OPS-1\n")
    (tmp_path / "b.pdf").write_text("x")
    (row,) = knowledge.upload(spark, str(tmp_path / "a.md"), " Tickets").collect()
    assert (row["source_type"], row["external_id"], row["title"]) == ("support_history", "OPS-1", "Title")
    for path, name in (("a.md", "nothing"), ("a.md", "checks"), ("b.pdf", "wiki")):
        with pytest.raises(ValueError):
            knowledge.upload(spark, str(tmp_path / path), name)


def test_encoder(spark):
    df = spark.createDataFrame([(1, "disk is full"), (2, "disk is full"), (3, None), (4, "")], "id long, text string")
    got = {r["id"]: r["vec"] for r in encode.encoded(df).collect()}
    assert got[1] == got[2] and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and got[3] is None and len(got[4]) == 64
    assert encode.encoded(df, "query").where("id = 1").first()["vec"] != got[1]
    own = encode.encoded(df, encoder=lambda texts: np.array([[len(t), 0.0] for t in texts])).where("id = 1").first()["vec"]
    assert own == [1.0, 0.0]
