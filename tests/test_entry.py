"""The driver's contract: queries against their SQL, streams against batches, and life without the llm subpackage."""

from __future__ import annotations

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lexiloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.sql(catalog.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(found.columns)
    at = [found.columns.index(c) for c in cols]
    key = lambda r: repr([float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r])
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=key)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - {"search_pipeline"}))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_stream_bucket_equals_batch(spark):
    a = {r.event_id: r.allowed for r in catalog.QUERIES["stream_token_bucket"](spark, SF).collect()}
    b = {r.event_id: r.allowed for r in catalog.QUERIES["token_bucket"](spark, SF).collect()}
    assert a == b


def test_entry_without_the_llm_subpackage(tmp_path):
    for p in ROOT.iterdir():
        if p.name in ("lexiloom", "__spark_entry__.py"):
            subprocess.run(["cp", "-r", str(p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lexiloom" / "llm")], check=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'bm25_topk' in q and set(s) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
    assert int(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout) > 60


def test_nothing_else_imports_llm():
    for p in (ROOT / "lexiloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lexiloom.llm" not in p.read_text()
