"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written inside the open tables_of() blocks, innermost last.
_OPEN: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own, but only with a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("papyrine.shared.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='papyrine')}"
        spark.conf.set("papyrine.shared.dir", found)
    return found


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df as a table written in the shared folder: cuts lineage and survives the loss of any executor. A filter on the columns `by` reads its own files only."""
    path = f"{shared_dir(df.sparkSession)}/papyrine-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(by) or None)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._papyrine_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def stored_by(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df like stored(), dealt to `parts` buckets by keys: joins on these keys read it as it lies, without a shuffle, however often."""
    name = f"papyrine_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    out = df.sparkSession.table(name)
    out._papyrine_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes a table made by stored() that no later plan reads. Deleting it twice does nothing."""
    path = df._papyrine_path
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Tables(list):
    """Tables to delete; those taken out stay."""

    def remove(self, df: DataFrame) -> None:
        self[:] = [x for x in self if x is not df]


@contextmanager
def tables_of(spark: SparkSession) -> Iterator[Tables]:
    """Deletes, at the end of the block, the tables that stored() has written inside it and that weren't removed from the list.

    For steps whose result is itself written inside the block: plans that are still to run must not need the tables.
    """
    used = Tables()
    _OPEN.append(used)
    try:
        yield used
    finally:
        _OPEN.pop()
        for df in used:
            drop_stored(df)
