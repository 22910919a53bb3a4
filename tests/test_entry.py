import builtins
import importlib
import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "title", "n_blocks", "markdown"] and df.count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_training_data_queries(monkeypatch):
    gone = [n for n in sys.modules if n.startswith("docloom.llm") or n == "corpus_pipeline"]
    for n in gone:
        monkeypatch.delitem(sys.modules, n)
    real = importlib.import_module

    def missing(name, *a):
        if name.startswith(("docloom.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert not any(n.startswith("op1_") or n == "pipeline" for n in entry.queries())
    assert builtins.len(entry.queries()) > 60
