"""Places that are few enough are handed to every task, whose findings are put together; the answers are the SQL's."""

import duckdb
import pytest

from plumbline.operators import knn, leaf_search
from plumbline.plans import catalogue

#: Queries of the findings.
SEARCHES = [
    "knn_exclude_self",
    "knn_graph",
    "knn_graph_offsets",
    "knn_reverse_degree",
    "knn_1",
    "knn_100",
    "knn_after_insert",
    "knn_bichromatic",
    "knn_remote",
    "kth_distance",
]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    d = tmp_path_factory.mktemp("handed")
    con = duckdb.connect()
    made = {
        # every point has copies, and so have the distances
        "part": "SELECT i AS p_partkey, CAST(1 + hash(i % 700) % 20 AS INTEGER) AS p_size, 900 + (hash(i % 700 + 1) % 90) / 1.0 AS p_retailprice FROM range(2100) t(i)",
        "customer": "SELECT i AS c_custkey, (hash(i) % 300) / 1.0 AS c_acctbal FROM range(2100) t(i)",
        "supplier": "SELECT i AS s_suppkey, (hash(i + 9) % 300) / 1.0 AS s_acctbal FROM range(90) t(i)",
    }
    for name, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS FROM '{d}/{name}.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", SEARCHES)
def test_no_point_is_dealt_by_leaf(spark, small, monkeypatch, name):
    def by_parts(*_):
        raise AssertionError("points are dealt by leaf")

    monkeypatch.setattr(knn, "_near_by_parts", by_parts)
    monkeypatch.setattr(leaf_search, "CHUNK", 200)
    monkeypatch.setattr(leaf_search, "RUN", 8)
    monkeypatch.setattr(knn, "HELD_FROM", 0)
    d, con = small
    got = catalogue.queries()[name](spark, d)
    want = con.execute(f"SELECT {', '.join(f'{c!r}'.replace(chr(39), chr(34)) for c in got.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
