import importlib
import sys

import __spark_entry__


def test_names_and_sql():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50
    for n in (2, 3, 5, 6):
        assert f"p{n}_found" in q


def test_without_optional_part(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("sylvaq.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sylvaq.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "p3_found" in entry.queries() and "p1_percentiles" not in entry.queries()


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert {"Species_Name", "trees", "stock_23", "mean_growth"} == set(df.columns) and df.count() > 0
