"""The entry point without the corpus operators."""

import importlib.util

import __spark_entry__


def test_queries_without_the_corpus_folder(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "marketlens.llm" else find(name, *a))
    names, checks = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "which_products_to_test" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names) and set(checks) <= set(names)
