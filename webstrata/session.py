"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import contextlib
import pathlib
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stream state.

    The cluster names it in ``spark.checkpoint.dir``. A session on one machine
    (``local[...]``) that has neither the setting nor a checkpoint folder gets a
    temporary one; on a cluster that is an error, since executors would each
    write to their own disk.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jsc.isDefined():
        return jsc.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="webstrata-checkpoint-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(root)
    return root


#: Paths written inside the scratch blocks that are open, the innermost last.
_SCOPES: list[list[str]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and read it back.

    Like a reliable checkpoint it survives lost executors and ends the plan;
    being a parquet table it also tells the optimizer its size, so later joins
    with a small result are broadcast on a measured bound. The table goes at the
    end of the ``scratch`` block around it, or when the driver ends.
    """
    return _written(df, _SCOPES[-1] if _SCOPES else None)


def _written(df: DataFrame, scope: list[str] | None) -> DataFrame:
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/webstrata-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(df.sparkSession, path)
    if scope is not None:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``cut_lineage`` writes inside the block go when it ends.

    The block gets a function that writes a table which stays: results must be
    written by it, since a plan that still reads a table of the block would fail.
    """
    scope: list[str] = []
    outer = _SCOPES[-1] if _SCOPES else None
    _SCOPES.append(scope)
    try:
        yield lambda df: _written(df, outer)
    finally:
        _SCOPES.pop()
        for path in scope:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` as a table bucketed by ``key`` below the checkpoint folder.

    Later joins and groupings by the key read it in place, without a shuffle. It
    has as many buckets as a shuffle has partitions and goes when the driver ends.
    """
    spark = df.sparkSession
    name = f"webstrata_{uuid.uuid4().hex}"
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    remove_at_end(spark, path)
    return spark.table(name)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver's file system delete ``path`` when the driver ends."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python tasks, once per application.

    The same as ``--py-files``, for sessions that were started without it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    source = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="webstrata-")) / "webstrata.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(source.rglob("*.py")):
            out.write(file, file.relative_to(source.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
