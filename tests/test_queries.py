"""Every query that has SQL against DuckDB on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from quoteloom.plans import PLANS

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float) and math.isfinite(v):
        return f"{v:.10g}"
    return repr(v)


@pytest.mark.parametrize("plan,name", [(p, n) for p in PLANS for n in p.ORACLES])
def test_sql(spark, plan, name):
    got = plan.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = connection.execute(f"SELECT {quoted} FROM ({plan.ORACLES[name]})").fetchall()
    rows = [tuple(map(plain, r)) for r in got.select(*columns).collect()]
    assert sorted(rows) == sorted(tuple(map(plain, r)) for r in want)


def test_llm_is_apart():
    """Nothing outside the subpackage imports it, but for the guarded entry point."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "quoteloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quoteloom.llm" not in path.read_text()
