"""Partitions that grow with the input, so that tasks don't."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from groovemill.operators import batches, lookups, pages
from groovemill.plans import graph_queries, lookup_queries
from groovemill.sources import graph_files, parts
from tests.comparison import connect, spark_rows, sql_rows


def _largest(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.count("*"), F.max("count")).first()


def test_edges_are_dealt_by_rows(spark, sf_dir, monkeypatch):
    con = connect(sf_dir)
    monkeypatch.setattr(parts, "ROWS", 500)
    for name in ("artist_edges", "undirected_edges", "label_propagation"):
        df = graph_queries.QUERIES[name](spark, sf_dir)
        assert spark_rows(df) == sql_rows(con, graph_queries.SQL[name])
        if name != "label_propagation":
            n, most = _largest(df)
            assert n >= 10 and most <= 750


def test_hits_are_dealt_by_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(parts, "ROWS", 10)
    df = lookup_queries.best_release_groups(spark, sf_dir)
    assert spark_rows(df) == sql_rows(connect(sf_dir), lookup_queries.SQL["best_release_groups"])
    assert _largest(df)[1] <= 10 and "Join" not in df._jdf.queryExecution().toString()


def test_next_ids_join_each_id_once(spark):
    existing = spark.range(4000).selectExpr("id % 7 + 1 AS id")
    got = batches.next_ids(existing, "id", 3, 12)
    assert sorted(r["id"] for r in got.collect()) == [8, 9, 10, 11, 12]
    assert "Aggregate" in got._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_parsed_a_few_at_a_time(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(300))], names=["page_id"])
    cut = list(pages.few_at_once(iter([batch, batch.slice(0, 0)])))
    assert [x for b in cut for x in b.column(0).to_pylist()] == list(range(300)) and max(b.num_rows for b in cut) <= pages.PAGES < 300
    found = pages.with_parts(spark.range(300).repartition(1).selectExpr("id AS page_id", "concat('<p>', id, '</p>') AS html"))
    assert {r["page_id"]: r["strings"][0]["text"] for r in found.collect()} == {i: str(i) for i in range(300)}


def test_no_lookup_is_nested_in_a_filter_of_reviews(spark):
    """Filters that Spark takes below the columns they ask for would look everything up again, for each element of each lookup."""
    head = '<div class="headerbox"><h1>Band - Record</h1></div>'
    body = '<div id="rezitext"><p>Text</p></div>'
    rows = [(1, f'<div id="rezension">{head}{body}</div>'), (2, f'<div id="rezension">{body}</div>'), (3, f'<div id="rezension">{head}</div>'), (4, f"<div>{head}{body}</div>"), (5, None), (6, f'<div id="rezension">{head.replace("Band", "")}{body}</div>')]
    df = pages.parse_reviews(spark.createDataFrame(rows, "page_id long, html string"))
    assert [tuple(r) for r in df.select("page_id", "artist", "album", "text").collect()] == [(1, "Band", "Record", "Text")]
    filters = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "- Filter " in x]
    assert all(x.count("lambdafunction") <= 1 for x in filters)


def test_graph_files_hold_a_bounded_number_of_edges(spark, tmp_path):
    n = 600_000
    edges = spark.range(n).repartition(1).selectExpr("concat('a', id) AS src", "concat('b', id % 7) AS dst", "id / 2D AS weight")
    graph_files.write_edges(edges, str(tmp_path / "graph"))
    found = graph_files.read_edges(spark, str(tmp_path / "graph"))
    per_file = [r["count"] for r in found.groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) == n and max(per_file) <= 1 << 18
    assert found.agg(F.sum("weight"), F.countDistinct("src")).first() == (n * (n - 1) / 4, n)
