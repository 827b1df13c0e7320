"""The entry module with and without the training-data subpackage."""

import importlib.util

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_llm_folders(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("cairn.llm", "corpus_pipeline")) else real(name, *a))
    names = set(entry.queries())
    assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= names
