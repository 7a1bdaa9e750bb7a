"""A deterministic corpus of any size as a data source: ``spark.read.format("sample_corpus")``.

Every row follows from its id by a rule, so that any number of partitions gives equal rows, and bounds of the id that a query
filters by become bounds of what is made. Options: ``rows`` (ids run from 1 to it), ``table`` (reviews, metadata, affinities,
communities) and ``partitions``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "sample_corpus"
SCHEMAS = {
    "reviews": "id bigint, url string, artist string, album string, text string, labels array<string>, release_year int, rating double",
    "metadata": "id bigint, artist_mbid string, labels array<string>",
    "affinities": "id bigint, community string, share double",
    "communities": "id bigint, community string, centroid string, top_artists array<string>",
}
#: Artists before their names come again, communities, and years from the first on.
ARTISTS, COMMUNITIES, FIRST_YEAR, YEARS = 97, 4, 1997, 27
LABEL, BATCH = "Sample Label", 4096


def _artist(i: int) -> str:
    return f"Sample Artist {i * 31 % ARTISTS:02d}"


def _community(n: int) -> str:
    return f"C{n % COMMUNITIES + 1:03d}"


def rows_of(table: str, i: int) -> list[tuple]:
    """The rows of an id. An album has shares of 6/10, 3/10 and 1/10 of three communities; two of five artists have no mbid."""
    if table == "reviews":
        return [(i, f"https://example.org/review/{i}", _artist(i), f"Album {i}", f"What album {i} sounds like.", [LABEL], FIRST_YEAR + i * 7 % YEARS, 5.0 + i % 11 / 2)]
    if table == "metadata":
        return [(i, f"mbid-{i * 31 % ARTISTS:02d}" if i * 31 % ARTISTS % 5 > 1 else None, [LABEL])]
    if table == "affinities":
        return [(i, _community(i + k), share) for k, share in enumerate((0.6, 0.3, 0.1))]
    return [(i, _community(i - 1), f"Style {i}", [_artist(i), _artist(i + COMMUNITIES)])] if i <= COMMUNITIES else []


class _Range(NamedTuple):
    low: int
    high: int


class _Part(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, table: str, schema, rows: int, partitions: int):
        self.table, self.schema, self.bounds, self.parts = table, schema, _Range(1, rows), partitions
        self.ids: list[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds and lists of ids; all else is left to Spark."""
        low, high = self.bounds
        for f in filters:
            own = getattr(f, "attribute", None) == ("id",)
            if own and isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                low = max(low, f.value + isinstance(f, GreaterThan))
            if own and isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                high = min(high, f.value - isinstance(f, LessThan))
            if own and isinstance(f, In):
                found = {v for v in f.value if v is not None}
                self.ids = sorted(found if self.ids is None else found & set(self.ids))
            if not (own and isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan | LessThanOrEqual | LessThan | In)):
                yield f
        self.bounds = _Range(low, high)

    def partitions(self) -> list[InputPartition]:
        low, high = self.bounds
        if self.ids is not None:
            self.ids = [i for i in self.ids if low <= i <= high]
            low, high = (self.ids[0], self.ids[-1]) if self.ids else (1, 0)
        n = max(1, min(self.parts, high - low + 1))
        edges = [low + (high - low + 1) * k // n for k in range(n + 1)]
        return [_Part(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        ids = range(partition.low, partition.high) if self.ids is None else [i for i in self.ids if partition.low <= i < partition.high]
        for at in range(0, len(ids), BATCH):
            rows = [r for i in ids[at : at + BATCH] for r in rows_of(self.table, i)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class SampleCorpus(DataSource):
    """The data source; ``register`` makes it known to a session."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _table(self) -> str:
        table = self.options.get("table", "reviews")
        if table not in SCHEMAS:
            raise ValueError(f"table has to be one of {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> DataSourceReader:
        rows, parts = int(self.options.get("rows", 24)), int(self.options.get("partitions", 4))
        if rows < 0 or parts < 1:
            raise ValueError("rows has to be 0 or more, partitions 1 or more")
        return _Reader(self._table(), schema, rows, parts)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets filters reach it."""
    spark.dataSource.register(SampleCorpus)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, table: str = "reviews", rows: int = 24, partitions: int = 4) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).options(table=table, rows=rows, partitions=partitions).load()


def newest(reviews: DataFrame, count: int) -> DataFrame:
    """The reviews of largest id, one at least."""
    from pyspark.sql import functions as F

    return reviews.orderBy(F.col("id").desc()).limit(max(1, count))
