"""Rows whose order or last digit floating-point sums leave open: queries and their SQL agree, on what exact arithmetic gives."""

import datetime
import itertools

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from trackworks.plans import load_all

REGISTRY = load_all()


def both(spark, path, name, **tables):
    """The rows of a query and of its SQL over given tables, sorted."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), path / f"{table}.parquet")
        con.sql(f"create view {table} as select * from '{path}/{table}.parquet'")
    df = REGISTRY.queries[name](spark, str(path))
    cols = ", ".join(f'"{c}"' for c in df.columns)
    return sorted(map(tuple, df.collect())), sorted(con.sql(f"select {cols} from ({REGISTRY.sql[name]})").fetchall())


def test_equal_means_rank_by_song_in_any_order_of_sums(spark, tmp_path):
    prices = (221173.92, 129133.9, 382480.85)  # the sum of doubles depends on their order
    orders = [(song, p) for song, own in enumerate(itertools.permutations(prices)) for p in own] + [(9, float("nan")), (8, 60000.0)]
    songs, scores = map(list, zip(*orders, strict=True))
    orders = {"o_custkey": songs, "o_totalprice": scores, "o_orderstatus": ["F"] * len(songs), "o_orderpriority": ["1"] * len(songs)}
    customers = {"c_custkey": list(range(10)), "c_mktsegment": ["A"] * 10}
    rows, sql = both(spark, tmp_path, "e1_rank_in_group", orders=orders, customer=customers)
    assert rows == sql == sorted([("F", 9, "1", 1, 8), *[("F", k, "1", k + 2, 8) for k in range(6)], ("F", 8, "1", 8, 8)])


def test_covered_shares_round_halves_up_and_ends_on_a_bound_give_no_window(spark, tmp_path):
    day = datetime.datetime(2024, 1, 2)
    # file 0: 27 * 201 seconds up to midnight, a share of 0.0628125, and the rest of its two hours after it; file 1: an hour up to midnight exactly
    events = {"event_id": [6, 10], "user_id": [0, 1], "event_type": ["click"] * 2, "ts": [day - datetime.timedelta(seconds=27 * 201), day - datetime.timedelta(hours=1)]}
    rows, sql = both(spark, tmp_path, "c11_window_coverage", events=events)
    assert rows == sql == [(0, 19723, 0.062813), (0, 19724, 0.020521), (1, 19723, 0.041667)]
