"""Profiles of what a pipeline spends its Python time on."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from contextlib import contextmanager
from cProfile import Profile

from pyspark.sql import SparkSession

_CONF = "spark.sql.pyspark.udf.profiler"


@contextmanager
def profiled(spark: SparkSession, folder: str) -> Iterator[Profile]:
    """Profile what runs inside, errors included: the calling thread's Python goes to ``<milliseconds>.prof`` in the driver's
    ``folder``, which must exist, and that of the UDFs called inside, gathered from all executors by Spark, to files
    ``udf_<id>_perf.pstats`` beside it. UDFs over iterators of batches (``mapInArrow``) aren't profiled by Spark."""
    if not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    before, profile, begun = spark.conf.get(_CONF, None), Profile(), int(time.time() * 1000)
    spark.conf.set(_CONF, "perf")
    spark.profile.clear(type="perf")
    profile.enable()
    try:
        yield profile
    finally:
        profile.disable()
        profile.dump_stats(os.path.join(folder, f"{begun}.prof"))
        spark.profile.dump(folder, type="perf")
        spark.conf.unset(_CONF) if before is None else spark.conf.set(_CONF, before)
