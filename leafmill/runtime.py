"""Session plumbing shared by all operators: tables, checkpoints, row identity and distributed ranks."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data directory (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured_broadcasts(spark: SparkSession) -> None:
    """Let joins be broadcast only by sizes measured while the query runs.

    Estimates made before that take a text column for twenty bytes and know nothing of exploded rows, so the static threshold
    is switched off and its value becomes the adaptive one, which looks at the shuffled bytes of a side.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if (most := spark.conf.get(static)) != "-1":
        if spark.conf.get(adaptive, None) is None:
            spark.conf.set(adaptive, most)
        spark.conf.set(static, "-1")


def ensure_shipped(spark: SparkSession) -> None:
    """Make a session ready: broadcasts by measure, and the package on the executors unless they find it on their own path.

    Python workers import operators by module name. Where the repository is on ``PYTHONPATH`` or is the working
    directory nothing is sent; otherwise the package goes out once per context as a zip through ``addPyFile``.
    """
    measured_broadcasts(spark)
    parent = str(_ROOT.parent)
    sc = spark.sparkContext
    if parent in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == parent or getattr(sc, "_leafmill_sent", False):
        return
    target = Path(tempfile.mkdtemp()) / "leafmill_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in _ROOT.rglob("*.py"):
            z.write(p, p.relative_to(_ROOT.parent))
    sc.addPyFile(str(target))
    sc._leafmill_sent = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of this machine is made only for a local master without that setting."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not shared and not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="leafmill-ckpt-"))
    return shared or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_packed(df: DataFrame) -> DataFrame:
    """As ``cut``, with a batch of rows in one compressed record: checkpoints are written as they are and rows of texts or arrays take
    several times the room. Shuffle files that nothing needs any more are given back."""
    import pyarrow as pa

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["b"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield from pa.ipc.open_stream(x.as_buffer())

    rows = cut(df.mapInArrow(pack, "b binary"))
    gc.collect()
    df.sparkSession._jvm.System.gc()  # Spark's cleaner follows the driver's garbage
    return rows.mapInArrow(unpack, df.schema)


def merged(a: DataFrame, b: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that grow with the data: both are shuffled, whatever the planner believes their sizes to be."""
    return a.join(b.hint("merge"), on, how)


def latest_by_id(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order`` columns, nulls first. Map-side combined.

    Equal rows collapse. Rows that tie on ``order`` but differ elsewhere are resolved by the ``keep`` columns, so
    the result never depends on the order of rows. A null ``key`` forms no row.
    """
    ranked = F.struct(*order, *[c for c in keep if c not in order])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(ranked).alias("_top"))
        .select(key, *[F.col(f"_top.{c}").alias(c) for c in keep])
    )


def distributed_rank(df: DataFrame, group: list[str], order: list[Column], rank: str, total: str | None = None, weight: str | None = None) -> DataFrame:
    """Add the 1-based position of each row in its group's order, or the running sum of ``weight``, without bringing a group into one task.

    Rows are range-partitioned by group and order, so a hot group is spread over many tasks. Each task numbers its
    own piece; the sizes of the pieces, one small row per (task, group), give the offsets. ``order`` must be total
    within the group if the numbering is to be unique across runs. Rows in, rows out; ``total`` adds the group size.
    """
    keys = [F.col(g) for g in group]
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()))
    line = W.partitionBy("_pid", *group).orderBy(*order)
    local = placed.withColumn("_rn", F.sum(weight).over(line.rowsBetween(W.unboundedPreceding, 0)) if weight else F.row_number().over(line))
    sizes = placed.groupBy("_pid", *group).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    by_group = W.partitionBy(*group)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(by_group.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    offsets = offsets.withColumn("_total", F.sum("_n").over(by_group)).drop("_n")
    same = local["_pid"] == offsets["_pid"]
    for g in group:
        same = same & local[g].eqNullSafe(offsets[g])
    out = local.join(offsets, same)
    cols = [local[c] for c in df.columns] + [(local["_rn"] + offsets["_before"]).alias(rank)]
    if total:
        cols.append(offsets["_total"].alias(total))
    return out.select(*cols)
