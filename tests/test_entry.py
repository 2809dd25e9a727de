"""The driver's contract: the entry runs, and queries equal their SQL on the smallest tables."""

import __spark_entry__ as entry
import duckdb
import pytest
from emberline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each group in the quick test; the driver runs them all.
SOME = ["a2_classify", "a14_task_xml", "b3_evtx", "b15_mft", "b25_compact_usn", "c5_coerce_time", "d3_timeline", "e4_entities", "e5_resolve", "g8_powershell", "g9_download_execution", "g13_all_rules", "h1_edge_classes", "h2_edges", "h6_incidents", "h7_enrich", "i5_network", "i10_merge", "i12_report", "i19_dedup", "j3_overview", "k1_neighbours", "k2_relation_counts", "k3_relation_classes"]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def shown(v):
    return "" if v is None else str(int(v)) if isinstance(v, (bool, float, int)) and float(v).is_integer() else f"{v:.6f}" if isinstance(v, float) else str(v)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) > 120


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    rel = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(shown(v) for v in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want
