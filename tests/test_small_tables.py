"""Queries against their SQL on small tables made for one trait each."""

import duckdb

from girder.plans.registry import ORACLES, QUERIES

from .oracle import differences


def written(folder, table: str, sql: str) -> None:
    duckdb.sql(sql).write_parquet(f"{folder}/{table}.parquet")


def test_lines_alike_are_one_element(spark, tmp_path):
    """Lines of one brand, order, number, length and size count once, whichever part or supplier they name."""
    written(tmp_path, "part", "SELECT * FROM (VALUES (1::BIGINT, 'A', 7), (2, 'A', 7), (3, 'A', 8), (4, 'B', 7), (5, 'B', NULL), (6, NULL, 7)) x(p_partkey, p_brand, p_size)")
    lines = [(1, 1, 10.0, 1), (1, 1, 10.0, 1), (1, 1, 10.0, 2), (1, 1, 10.0, 3), (1, 1, 10.0, 4), (1, 1, 11.0, 1), (1, 2, 10.0, 1), (2, 1, 10.0, 1), (3, 1, 10.0, 5), (3, 1, 10.0, 5), (3, 1, 10.0, 6), (3, 1, 10.0, 6), (4, 1, "NULL", 1), (4, 1, "NULL", 1)]
    rows = ", ".join(f"({o}, {n}, {q}, {p})" for o, n, q, p in lines)
    written(tmp_path, "lineitem", f"SELECT o::BIGINT AS l_orderkey, n::INT AS l_linenumber, q::DOUBLE AS l_quantity, p::BIGINT AS l_partkey FROM (VALUES {rows}) x(o, n, q, p)")
    assert differences(spark, "q_bom_plates", QUERIES["q_bom_plates"], ORACLES["q_bom_plates"], str(tmp_path)) == []
    assert {r.p_brand: r.n_elements for r in QUERIES["q_bom_plates"](spark, str(tmp_path)).collect()} == {"A": 6, "B": 2, None: 1}


def test_missing_values_count_in_the_last_cluster(spark, tmp_path):
    rows = "(1::BIGINT, 1.0::DOUBLE), (1, 2.0), (1, 9.0), (1, NULL), (1, NULL), (2, NULL), (3, NULL), (3, 4.5), (4, 'nan'), (4, 'nan'), (4, 3.0), (4, NULL)"
    written(tmp_path, "events", f"SELECT * FROM (VALUES {rows}) x(user_id, value)")
    assert differences(spark, "q_cluster_1d", QUERIES["q_cluster_1d"], ORACLES["q_cluster_1d"], str(tmp_path)) == []


def test_equal_values_share_a_cluster(spark, tmp_path):
    """The SQL leaves open which of some equal values begins a cluster; here none of them stays in the one before."""
    written(tmp_path, "events", "SELECT k // 3000 AS user_id, CAST(k % 3 * 10 AS DOUBLE) AS value FROM range(30000) x(k)")
    got = {tuple(r) for r in QUERIES["q_cluster_1d"](spark, str(tmp_path)).collect()}
    assert got == {(user, k, 10.0 * k, 1000) for user in range(10) for k in range(3)}


def test_tokens_of_times_before_1970_and_of_missing_ids(spark, tmp_path):
    rows = "(5::BIGINT, '1969-12-31 23:58:59.999'), (4, '1969-12-31 23:59:00.0004'), (3, '1969-12-31 23:59:59.9996'), (2, '1970-01-01 00:00:59.9'), (1, '1960-02-29 12:34:56.789'), (6, NULL), (7, NULL), (NULL, '2024-01-01 00:00:10'), (NULL, '2024-01-01 00:00:20'), (8, '2024-01-01 00:00:30'), (9, '2024-01-01 00:01:00')"
    written(tmp_path, "events", f"SELECT event_id, ts::TIMESTAMP AS ts FROM (VALUES {rows}) x(event_id, ts)")
    assert differences(spark, "q_share_token", QUERIES["q_share_token"], ORACLES["q_share_token"], str(tmp_path)) == []


def test_tokens_of_a_minute_with_more_than_a_thousand_tries(spark, tmp_path):
    written(tmp_path, "events", "SELECT k // 2 AS event_id, TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(k % 70000) AS ts FROM range(5000) x(k)")
    assert differences(spark, "q_share_token", QUERIES["q_share_token"], ORACLES["q_share_token"], str(tmp_path)) == []
