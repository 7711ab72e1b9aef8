"""Every query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from brindle.plans import catalog, shops
from brindle.plans.fixtures import TABLES, frame


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    at = [x[0] for x in cursor.description]
    assert sorted(at) == columns
    want = sorted((tuple(_plain(r[at.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_entry_has_rows_and_names_agree(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_host_query_reads_only_what_it_needs(spark, sf_dir):
    plan = catalog.QUERIES["q_page_canonical_url"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan


def test_sheets_read_records_made_once(spark, sf_dir):
    plan = catalog.QUERIES["q_sheets"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", sorted(shops.SPREAD))
def test_rows_of_much_work_are_dealt_out(spark, sf_dir, name):
    """However small the tables are that they are made of."""
    rows = frame(spark, sf_dir, name)
    assert rows.rdd.getNumPartitions() == shops.parts(spark)
    assert rows.count() == spark.sql(f"SELECT * FROM {shops.spark_sql(shops.relation(TABLES[name], name), sf_dir)} AS t").count()


def test_submenus_do_not_go_by_way_of_the_driver(spark, sf_dir):
    plan = catalog.QUERIES["q_submenu"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("SubqueryBroadcast")] if "SubqueryBroadcast" in plan else plan
    assert "LeftAnti, BuildRight" not in after and "BroadcastHashJoin [page_id" not in after


def test_site_modes_shred_each_page_once(spark, sf_dir):
    for name in ("q_site_mode", "q_generic_roots", "q_synthetic_nodes"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1, name


@pytest.mark.parametrize("name", ["q_menu_topk", "q_site_mode", "q_sure_roots"])
def test_menus_of_any_length_equal_sql(spark, sf_dir, tmp_path, name):
    """The best links of a page come after 400 others, and after the 12,000 characters that are read of what it shows."""
    for table in ("part", "supplier", "lineitem"):
        (tmp_path / f"{table}.parquet").symlink_to(f"{sf_dir}/{table}.parquet")
    links = "".join(f'<li><a href="/l{i}">{"Tin " + "dài " * 9 if i < 400 else "Cho thuê máy ảnh"} {i}</a></li>' for i in range(430))
    c = duckdb.connect()
    c.execute(f"COPY (SELECT 7::BIGINT AS page_id, 'https://wide.vn/' AS url, '<html><body><ul>{links}</ul></body></html>' AS html) TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    for table in ("part", "supplier", "lineitem", "pages"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path)).where("page_id = 7")
    c.execute(f"CREATE TABLE want AS {catalog.ORACLE_SQL[name]}")
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM want WHERE page_id = 7").fetchall()
    assert want and sorted(map(tuple, df.collect())) == sorted(want)
