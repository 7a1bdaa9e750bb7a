"""Lenient readers of line-delimited JSON and logs, and their writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groovemill.functions.text import repair_cp1252, strip
from groovemill.operators.batches import last_wins

CORRUPT = "_corrupt"

REVIEW = (
    "id long, url string, artist string, album string, text string, title string, author string, labels array<string>, release_date date, release_year int, rating double, user_rating double, "
    "tracklist array<struct<number:int,title:string,duration:string,is_highlight:boolean>>, highlights array<string>, total_duration string, references array<string>, first_seen_at timestamp, extra map<string,string>"
)
BATCH = "run_at timestamp, review_ids array<long>"

#: What a log says of new reviews, in a line with its time and wherever it stands.
FOUND = r"Found (\d+) new reviews \((\d+)-(\d+)\)\. Continuing with enrichment\."
LOG_LINE = rf"^(\d{{4}}-\d{{2}}-\d{{2}} [\d:,]+) .*{FOUND}"
#: Ids in a block, by which ranges of ids meet the known ones.
ID_BLOCK = 1024


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file and at of the lines of a text file or folder; no rows if there is none.

    at orders all lines: by file, by the block of the file that a task reads, and by the line in it.
    """
    try:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string, file string, block long, line long")
    return lines.select("value", "file", F.struct("file", "block", "line").alias("at"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a file with ``seq`` (their order, see ``read_lines``) and ``_corrupt`` (the line, where it is no object of the schema).

    Blank lines are left out; a missing file has no rows.
    """
    wide, line = f"{schema}, {CORRUPT} string", strip(F.col("value"))
    rows = read_lines(spark, path).where(F.length(line) > 0)
    object_ = F.when(line.startswith("{"), F.col("value"))  # else Spark takes an array for its first element
    parsed = rows.select(F.from_json(object_, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"), F.col("at").alias("seq"), "value")
    fields = [f"r.{c}" for c in parsed.select("r.*").columns if c != CORRUPT]
    return parsed.select(*fields, F.when(F.col("r").isNull(), F.col("value")).otherwise(F.col(f"r.{CORRUPT}")).alias(CORRUPT), "seq")


def valid(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_keyed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last object of each non-null key."""
    return last_wins(valid(read_jsonl(spark, path, schema)).where(F.col(key).isNotNull()), key, "seq").drop("seq")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Typed reviews with texts, mis-decoded characters repaired; reviews without a text are left out."""
    rows = valid(read_jsonl(spark, path, REVIEW)).drop("seq")
    repaired = rows.withColumns({c: repair_cp1252(F.col(c)) for c in ("artist", "album", "text", "title", "author")})
    return repaired.where(F.length(strip(F.col("text"))) > 0)


def read_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The distinct ids of a file's objects."""
    return valid(read_jsonl(spark, path, f"{key} long")).where(F.col(key).isNotNull()).select(key).distinct()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """run_at, review_ids of batches with a time and at least one id, in the order of their times."""
    return valid(read_jsonl(spark, path, BATCH)).drop("seq").where("run_at IS NOT NULL AND size(review_ids) > 0").orderBy("run_at")


def _known_ids(ranges: DataFrame, known: DataFrame) -> DataFrame:
    """``ranges`` (at, run_at, low, high) with review_ids, the known ids within; ranges without any are left out.

    A range is dealt out by its blocks of ids, not by its ids, so that a wide one costs little.
    """
    blocks = ranges.where("low <= high").withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / ID_BLOCK), F.floor(F.col("high") / ID_BLOCK))))
    ids = known.select("review_id", F.floor(F.col("review_id") / ID_BLOCK).alias("block")).distinct()
    hits = blocks.join(ids, "block").where(F.col("review_id").between(F.col("low"), F.col("high")))
    return hits.groupBy("at", "run_at").agg(F.array_sort(F.collect_set("review_id")).alias("review_ids"))


def read_log_batches(spark: SparkSession, path: str, known: DataFrame, now: Column) -> DataFrame:
    """run_at, review_ids of log lines that name a range of new reviews; only known ids (review_id) stay.

    A line's time has milliseconds or not. If no line with a time gives a batch, all that a log says of new reviews counts,
    with ``now`` for its time.
    """
    lines = read_lines(spark, path)
    stamped = lines.select("at", *(F.regexp_extract(F.btrim("value"), LOG_LINE, i).alias(c) for i, c in ((1, "time"), (3, "low"), (4, "high")))).where("time <> ''")
    ranges = stamped.select("at", F.try_to_timestamp(F.replace("time", F.lit(","), F.lit("."))).alias("run_at"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    found = _known_ids(ranges.where("run_at IS NOT NULL"), known)
    if found.isEmpty():
        each = lambda i: F.regexp_extract_all("value", F.lit(FOUND), F.lit(i))
        said = lines.select("at", F.posexplode(F.arrays_zip(each(2).alias("low"), each(3).alias("high"))).alias("nth", "r"))
        found = _known_ids(said.select(F.struct("at", "nth").alias("at"), now.alias("run_at"), F.col("r.low").cast("long").alias("low"), F.col("r.high").cast("long").alias("high")), known)
    return found.select("run_at", "review_ids")


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank; -1 if the file is missing."""
    try:
        return spark.read.text(path).where(F.length(strip(F.col("value"))) > 0).count()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return -1
        raise


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def review_lines(reviews: DataFrame) -> DataFrame:
    """``value``: reviews as lines of JSON with all fields of REVIEW, as ``read_reviews`` reads them.

    Fields that ``reviews`` doesn't have are null; lists and ``extra`` are empty instead of null; times are in UTC, with
    fractions of a second where there are any. Further columns are left out.
    """
    empty = {"labels": F.array(), "tracklist": F.array(), "highlights": F.array(), "references": F.array(), "extra": F.create_map()}
    fields = T.StructType.fromDDL(REVIEW)
    known = {f.name: (F.col(f.name) if f.name in reviews.columns else F.lit(None)).cast(f.dataType) for f in fields}
    for name, nothing in empty.items():
        known[name] = F.coalesce(known[name], nothing.cast(fields[name].dataType))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), known["first_seen_at"].cast("timestamp_ntz"))
    known["first_seen_at"] = F.replace(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"), F.lit(".000000"), F.lit(""))
    known["release_date"] = known["release_date"].cast("string")
    return reviews.select(F.to_json(F.struct(*(c.alias(n) for n, c in known.items())), {"ignoreNullFields": "false"}).alias("value"))


def write_reviews(reviews: DataFrame, path: str, append: bool = False) -> None:
    """Reviews as lines of JSON, in ranges of their ids."""
    ranged = reviews.repartitionByRange("id").sortWithinPartitions("id")
    review_lines(ranged).write.mode("append" if append else "overwrite").text(path)
