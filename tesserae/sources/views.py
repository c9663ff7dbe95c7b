"""Adapter views: raster pixels, daily observations, cells, overlaps and features from the star-schema tables.

The same portable SQL runs in Spark and in an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    "grid_px": """
        WITH li AS (
            SELECT l_partkey, avg(l_extendedprice) / 1e3 AS rad, avg(l_quantity) / 5e1 AS q, avg(l_discount) * 1e1 AS d
            FROM lineitem GROUP BY l_partkey)
        SELECT CAST(floor(p_partkey / 2e1) AS INT) AS r, CAST(p_partkey % 20 AS INT) AS c,
            CASE WHEN p_partkey % 37 = 5 THEN NULL ELSE rad END AS radiance,
            CASE WHEN p_partkey % 41 = 7 THEN NULL ELSE q END AS base_proxy,
            CAST(p_size * 2 AS DOUBLE) AS occ,
            CAST(1e0 - CASE WHEN p_size * 2 > 90 THEN 1e0 ELSE p_size * 2 / 9e1 END AS DOUBLE) AS persistent_w,
            1e0 - CASE WHEN d > 1e0 THEN 1e0 ELSE d END AS spectral_w,
            p_size * 2 >= 90 AS persistent_mask, p_partkey % 3 = 0 AS infra
        FROM part JOIN li ON l_partkey = p_partkey""",
    "daily_obs": """
        SELECT CAST(ts AS DATE) AS d, CAST(floor(user_id / 15e0) AS INT) AS r, CAST(user_id % 15 AS INT) AS c,
            value AS radiance, CAST(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS mqf,
            CAST((CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) + 2 * (event_id % 6)
                + 16 * (CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END) + 64 * (event_id % 3)
                + (CASE WHEN event_id % 13 = 0 THEN 256 ELSE 0 END) + (CASE WHEN event_id % 17 = 0 THEN 512 ELSE 0 END)
                + (CASE WHEN event_id % 19 = 0 THEN 1024 ELSE 0 END) AS INT) AS qf,
            CAST(CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS INT) AS snow, CAST(event_id % 120 AS INT) AS age_days,
            event_id AS source_index, CAST(event_id % 4 AS INT) AS datatake
        FROM events""",
    "cells": """
        WITH o AS (SELECT o_custkey, sum(o_totalprice) / 1e5 AS rad FROM orders GROUP BY o_custkey),
        k AS (SELECT c_custkey AS cell_id, (c_custkey % 40) * 6e2 + (c_custkey * 37 % 101) AS x_m,
            floor(c_custkey / 4e1) * 6e2 + (c_custkey * 53 % 97) AS y_m, (c_acctbal + 1e3) / 11e3 AS proxy_mean FROM customer)
        SELECT cell_id, CAST(x_m AS DOUBLE) AS x_m, CAST(y_m AS DOUBLE) AS y_m, proxy_mean, rad AS radiance,
            concat(CAST(CAST(floor(x_m / 5e3) AS INT) AS VARCHAR(12)), '_', CAST(CAST(floor(y_m / 5e3) AS INT) AS VARCHAR(12))) AS block_id
        FROM k LEFT JOIN o ON o_custkey = cell_id""",
    "cell_overlap": """
        SELECT l_suppkey AS cell, CAST(floor(l_partkey / 2e1) AS INT) AS r, CAST(l_partkey % 20 AS INT) AS c,
            sum(l_quantity) AS area, max(s_acctbal) AS cell_radiance
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey, l_partkey""",
    "features": """
        SELECT l_orderkey AS feature_id, l_linenumber AS part_no, CASE WHEN p_type IS NULL THEN 'unknown' ELSE p_type END AS class,
            CASE WHEN l_returnflag = 'R' THEN 'rail' ELSE 'road' END AS subtype, l_suppkey AS cell, l_quantity AS measure
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; only the tables that it names are opened."""
    sql = VIEWS[name]
    used = {}
    for t in TABLES:
        marked = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        if marked != sql:
            sql, used[t] = marked, table(spark, sf_dir, t)
    return spark.sql(sql, **used)


def with_views(body: str, *names: str) -> str:
    """SQL that defines the named views, for an engine that has the tables."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + (", " if body.lstrip().upper().startswith("WITH ") else " ") + body.strip().removeprefix("WITH ")
