"""The registered queries against their SQL, and what may import what."""

import ast
import decimal
import importlib
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = importlib.import_module("foliate.queries")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, (float, decimal.Decimal)) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(OWN.QUERIES))
def test_query(spark, duck, name):
    df = OWN.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows, "a query without rows tests nothing"
    if name in OWN.SQL:
        cur = duck.execute(OWN.SQL[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield f"{'.' * node.level}{node.module or ''}"


MODULES = [p for p in (ROOT / "foliate").rglob("*.py") if "llm" not in p.parts]


@pytest.mark.parametrize("path", MODULES, ids=lambda p: str(p.relative_to(ROOT)))
def test_nothing_else_imports_llm(path):
    assert not any("llm" in name.split(".") for name in imports(path))


@pytest.mark.parametrize("path", [p for p in MODULES if "scoring" not in p.parent.name and p.name != "queries.py"], ids=lambda p: str(p.relative_to(ROOT)))
def test_only_scoring_reads_the_answer_key(path):
    assert not any(name.endswith("scoring.answers") or name in ("..scoring", "foliate.scoring") for name in imports(path))


def test_streams_equal_their_batch_twins(spark):
    stream = {(r.user_id, r.event_id): r.running_tokens for r in OWN.QUERIES["stream_running_cost"](spark, SF).collect()}
    batch = {(r.user_id, r.event_id): r.running_tokens for r in OWN.QUERIES["running_cost"](spark, SF).collect()}
    assert stream == batch
