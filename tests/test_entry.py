"""The entry module works with and without the training-data subpackage."""

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_training_data(monkeypatch):
    import builtins

    real = builtins.__import__

    def gone(name, glob=None, loc=None, fromlist=(), level=0):
        if name.startswith("quillwork.llm"):
            raise ModuleNotFoundError(name, name="quillwork.llm")
        return real(name, glob, loc, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", gone)
    assert "corruption_score" in entry.queries() and not any(k.startswith("op") for k in entry.queries())
