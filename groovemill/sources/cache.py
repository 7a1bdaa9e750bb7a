"""Results that are kept as long as the files they come from stay as they are."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groovemill.sources.checkpoints import checkpointed

#: Results of one application, the last used at the end, and how many are kept at most.
_KEPT: OrderedDict[tuple[str, str, str], tuple[tuple, DataFrame]] = OrderedDict()
MOST = 16


def signature(spark: SparkSession, path: str) -> tuple:
    """Number, size and last change of the files that Spark reads at ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.sum(F.xxhash64("path").cast("decimal(38,0)"))).first())


def kept(spark: SparkSession, name: str, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, from a checkpoint; it is built again after the files at ``path`` have changed.

    Results of applications that have ended are dropped, and of this one those that were last used before the MOST others.
    """
    application = spark.sparkContext.applicationId
    for key in [k for k in _KEPT if k[0] != application]:
        del _KEPT[key]
    now, key = signature(spark, path), (application, name, path)
    if key not in _KEPT or _KEPT[key][0] != now:
        _KEPT[key] = now, checkpointed(build())
    _KEPT.move_to_end(key)
    while len(_KEPT) > MOST:
        _KEPT.popitem(last=False)
    return _KEPT[key][1]
