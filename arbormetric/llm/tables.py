"""Reading tables, shared scratch space and size-checked broadcasts for the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Rows of two numbers up to which a side may be broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share. A session on
    this machine alone that names none gets one of its own; a cluster has to name it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends, and lost executors
    lose nothing."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_and_seen(df: DataFrame, **of: Column) -> tuple[DataFrame, dict]:
    """``stored(df)``, and the aggregates ``of`` its rows, which the write itself finds: no job reads
    the files for them."""
    seen = Observation()
    return stored(df.observe(seen, *(column.alias(name) for name, column in of.items()))), seen.get


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``stored`` that a newer one replaces."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("llm-"):
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its checked number of rows allows one."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def stored_small(df: DataFrame) -> DataFrame:
    """``small(stored(df))`` whose rows are counted as they are written."""
    rows, seen = stored_and_seen(df, rows=F.count("*"))
    return F.broadcast(rows) if seen["rows"] <= BROADCAST_ROWS else rows


def byte_runs(texts: pa.Array, most: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Places of runs of rows with about ``most`` bytes of text, and ``rows`` rows, at most; a longer
    text is a run of its own."""
    start, held, sizes = 0, 0, pc.binary_length(texts).to_pylist()
    for at, size in enumerate(sizes):
        size = size or 0
        if at > start and (held + size > most or at - start == rows):
            yield start, at
            start, held = at, 0
        held += size
    if sizes:
        yield start, len(sizes)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand at most ``rows`` rows at once to Python, which bounds what the buffers
    on both sides hold; the setting is put back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
