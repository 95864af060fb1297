"""Searches of leaves rank their pairs within tasks, in numpy."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from plumbline.operators import knn, leaf_search
from plumbline.operators.partition import Splits
from plumbline.plans import catalogue

SEARCHES = [
    "knn_self",
    "knn_exclude_self",
    "knn_graph",
    "knn_graph_offsets",
    "knn_reverse_degree",
    "knn_1",
    "knn_100",
    "knn_after_delete",
    "knn_after_rebalance",
    "knn_after_insert",
    "knn_bichromatic",
    "knn_remote",
    "kth_distance",
    "knn_lineitem",
]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    con = duckdb.connect()
    made = {
        "part": "SELECT i AS p_partkey, CAST(1 + hash(i) % 50 AS INTEGER) AS p_size, 900 + (hash(i + 1) % 1000) / 1e1 AS p_retailprice FROM range(2000) t(i)",
        "customer": "SELECT i AS c_custkey, (hash(i) % 1000) / 1e1 AS c_acctbal FROM range(2000) t(i)",
        "supplier": "SELECT i AS s_suppkey, (hash(i + 9) % 1000) / 1e1 AS s_acctbal FROM range(100) t(i)",
        "lineitem": "SELECT i // 4 AS l_orderkey, CAST(i % 4 AS INTEGER) AS l_linenumber, i AS l_partkey, i AS l_suppkey, 1.0 + hash(i) % 50 AS l_quantity, 900 + (hash(i + 1) % 1000) / 1e1 AS l_extendedprice FROM range(4000) t(i)",
    }
    for name, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS FROM '{d}/{name}.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", SEARCHES)
def test_pairs_are_ranked_within_tasks(spark, small, monkeypatch, name):
    def top(*_):
        raise AssertionError("a row a pair is shuffled")

    monkeypatch.setattr(knn, "_top", top)
    d, con = small
    got = catalogue.queries()[name](spark, d)
    want = con.execute(f"SELECT {', '.join(f'{c!r}'.replace(chr(39), chr(34)) for c in got.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("need", [1, 3, 40])
def test_leaves_are_searched_as_by_brute_force(need):
    rng = np.random.default_rng(need)
    p, q = rng.integers(0, 30, (400, 2)).astype(float), rng.integers(-5, 35, (60, 2)).astype(float)
    walk = Splits(["x", "y"], {1: (0, 15.0), 2: (1, 10.0), 3: (1, 20.0), 7: (0, 22.0)}).walker()
    leaf, ids = walk(p), rng.permutation(400)
    places = pa.table({"qx": q[:, 0], "qy": q[:, 1]}).to_batches()
    bounds = list(leaf_search.bounder(walk, p[::4], ["qx", "qy"], need, 8)(iter(places)))
    held = np.unique(leaf)
    zones = {"leaf_id": held, "n": [int((leaf == x).sum()) for x in held]}
    for i, c in enumerate("xy"):
        zones |= {f"lo_{c}": [p[leaf == x, i].min() for x in held], f"hi_{c}": [p[leaf == x, i].max() for x in held]}
    visits = pa.Table.from_batches(leaf_search.visitor(pa.table(zones), ["x", "y"], ["qx", "qy"])(iter(bounds)))
    assert visits.num_rows < len(q) * len(held) or need == 40
    near = pa.struct([("dist2", pa.float64()), ("nid", pa.string())])
    points = pa.table({"leaf_id": leaf, "nid": pa.array([f"{i:03d}" for i in ids]), "x": p[:, 0], "y": p[:, 1]})
    found = leaf_search.searcher(["x", "y"], ["qx", "qy"], need, near)(points, visits.rename_columns(["leaf", *visits.column_names[1:]])).to_pylist()
    got = sorted((r["qx"], r["qy"], [(n["dist2"], n["nid"]) for n in r["__near"]]) for r in found)
    want = [(x, y, sorted(((a - x) * (a - x) + (b - y) * (b - y), f"{i:03d}") for (a, b), i in zip(p.tolist(), ids, strict=True))[:need]) for x, y in q.tolist()]
    assert got == sorted(want)
