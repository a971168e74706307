"""Queries over pages of which some share a url, with numbers like years and references cut short, against their SQL."""

import duckdb
import pytest

from tests.conftest import SF
from tests.helpers import same_rows
from webloom import plans


@pytest.mark.parametrize("name", ["page_titles", "search_heads", "search_year", "service_batch", "service_crawl", "sitemap_pages"])
def test_pages_of_one_url(spark, tmp_path, name):
    pages = f"""SELECT page_id + 2000 + k AS page_id, url, CASE WHEN k = 61 THEN replace(replace(html, '</title>', '&amp</title>'), '<title>', '<title>&lt;') ELSE html END AS html
 FROM '{SF}/pages.parquet', (VALUES (0), (61), (122)) t(k)"""
    duckdb.sql(f"COPY ({pages}) TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    same_rows(plans.QUERIES[name](spark, str(tmp_path)), con, plans.ORACLES[name])
