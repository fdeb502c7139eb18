"""Session plumbing that the corpus operators share: scratch tables, table reads."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.functions.session import files_of, shared_folder, ship

__all__ = ["Scratch", "released", "ship", "spread", "table", "whole_groups"]


class Scratch:
    """Written intermediate tables of one operator run.

    ``cut`` writes a DataFrame as Parquet under the shared folder and reads it back: it ends the lineage, survives
    lost executors, and is columnar and compressed, unlike an RDD checkpoint. ``drop`` deletes tables that no later
    plan reads.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._count = 0

    def cut(self, frame: DataFrame, codec: str = "zstd") -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count}"
        frame.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, *frames: DataFrame) -> None:
        files, path = files_of(self.spark, self.root)
        for frame in frames:
            files.delete(path(frame._scratch_path), True)  # noqa: SLF001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the cluster has cores, dealt out to all of them; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a Python worker's task; at its end, what the worker has freed goes back to the system. A worker waits
    beside its executor for the next task, and what it holds counts as the executor's memory meanwhile."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole groups, and where each group begins (and one more): a batch's last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        every = pa.concat_batches([*held, batch]) if held else batch
        names = [every.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = 1 + np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0))
        if len(cuts):
            yield every.slice(0, cuts[-1]), np.r_[0, cuts]
            held = [every.slice(cuts[-1])]
        else:
            held = [every]
    if held:
        yield held[0], np.array([0, held[0].num_rows])
