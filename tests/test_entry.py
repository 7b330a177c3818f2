"""Queries against their SQL, on small tables made here."""

from __future__ import annotations

import math
import random

import duckdb
import pytest

import __spark_entry__
from motifold.plans import catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("tables"), random.Random(1)
    con = duckdb.connect()
    text = lambda: "".join(rng.choice("abcdefghij klmno pqrstuvwxyzé.,\n") for _ in range(rng.choice([0, 20, 400, 3000])))
    made = {
        "documents": ("doc_id long, text string", [(i, text()) for i in range(60)]),
        "customer": ("c_custkey long, c_name string", [(i, f"Customer#{i:09}") for i in range(1, 60)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int", [(i, f"part {i % 20}", f"Brand#{i % 30}", rng.choice(["STANDARD X", "PROMO Y", "ECONOMY", "SMALL"]), rng.randint(1, 50)) for i in range(80)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string", [(i, rng.randint(1, 80), rng.choice("FOP"), rng.lognormvariate(5, 1), rng.choice(["1-URGENT", "2-HIGH", "5-LOW"])) for i in range(200)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_linenumber int", [(rng.randint(0, 60), rng.randint(0, 79), rng.randint(1, 7)) for _ in range(300)]),
        "nation": ("n_nationkey int, n_regionkey int", [(i, i % 4) for i in range(25)]),
        "region": ("r_regionkey int", [(i,) for i in range(6)]),
    }
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    spark.createDataFrame([(i, 1_700_000_000 + rng.randint(0, 200_000), rng.randint(0, 9), rng.uniform(0, 100)) for i in range(400)], "event_id long, t long, user_id long, value double").selectExpr("event_id", "timestamp_ntz '1970-01-01' + make_dt_interval(0, 0, 0, t) ts", "user_id", "value").write.parquet(f"{at}/events.parquet")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet/*.parquet'")
    return str(at), con


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, tables, name):
    at, con = tables
    got = catalog.queries()[name](spark, at)
    names = sorted(got.columns)
    out = con.execute(catalog.oracle_sql()[name])
    at_sql = [x[0] for x in out.description]
    assert sorted(at_sql) == names
    want = sorted((tuple(plain(r[at_sql.index(c)]) for c in names) for r in out.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr) == want


@pytest.fixture(scope="module")
def long_contigs(spark, tmp_path_factory):
    """Contigs of more than twice the terminal limit: matches far inside, and runs of them across the limit at both ends."""
    at, con = tmp_path_factory.mktemp("long"), duckdb.connect()
    p, q = "bbbdaa", "ddaccc"  # what becomes CCCTAA and TTAGGG
    rows = [(i, "a" * (49_940 - i % 5 * 180) + p * 40 + "a" * 10_000 + q * 3 + "h" * 9_000 + p + "a" * 9_000 + q + "a" * 30_000 + q * 40 + "a" * 49_900) for i in (1, 2, 5)] + [(3, "a" * 110_000 + p)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["match_islands", "motif_hits_exact", "terminal_blocks", "path_summary", "bed_round_trip"])
def test_long_contigs(spark, long_contigs, name):
    test_query(spark, long_contigs, name)


@pytest.fixture(scope="module")
def odd_letters(spark, tmp_path_factory):
    """Texts with letters whose lower case is longer, shorter or beyond ASCII, or that take two places in UTF-16."""
    at, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    p, q = "bbbdaa", "ddaccc"
    texts = ["\u0130" + p + "\u0130\u0130" + q, p + "\U0001f600" + q, "\u212a" + p + "\u017f" + q + "\u1e9e" + p, p * 40 + "\u0130" + q * 40, "\u0391\u03a3 " + p + "\x00\n" + q, "", None]
    spark.createDataFrame([(i * 10 + k, t) for i, t in enumerate(texts) for k in (3, 4)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["motif_hits_exact", "match_islands", "gap_runs", "terminal_blocks", "motif_hits_edit1"])
def test_odd_letters(spark, odd_letters, name):
    test_query(spark, odd_letters, name)


def test_entry_points():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known) and "terminal_blocks" in known
