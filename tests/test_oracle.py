"""Each registered query against its SQL."""

from __future__ import annotations

import pytest

from groovemill.plans import registry
from tests.comparison import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    wanted = sql_rows(con, registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(c[0] for c in con.execute(registry.ORACLE_SQL[name]).description)
    assert spark_rows(df) == wanted


#: Queries without SQL, and the tests that compare their rows with plain versions.
ELSEWHERE = {"modular_communities": "test_graph", "playlist_fill": "test_playlists", "photo_ranks": "test_playlists", "name_match": "test_names", "names_in_texts": "test_names", "image_confidence": "test_names", "html_pages": "test_graph"}


def test_queries_without_sql_have_a_plain_version():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == set(ELSEWHERE)


def test_every_sql_has_its_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
