"""Driver contract: entry() runs on sf0.001, every query has an oracle, names are clean."""

import importlib.util
import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_contract(spark):
    se = _entry_module()
    qs, sql = se.queries(), se.oracle_sql()
    core = {name for name in qs if name != "pipeline" and not re.match(r"op\d+_", name)}
    assert core <= set(sql) <= set(qs) and len(core) >= 50
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", name) for name in qs)
    df = se.entry(spark)
    first = df.schema.simpleString()
    assert df.count() > 0 and se.entry(spark).schema.simpleString() == first
    assert len(set(df.columns)) == len(df.columns)
