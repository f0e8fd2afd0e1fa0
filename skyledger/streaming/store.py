"""Tables that streams add to: one folder per batch, merged now and then into a snapshot.

``out/run=<name>/batch=<number>`` holds what one batch wrote; a batch that is run again replaces its
folder. :func:`compact` merges all folders into ``out/snapshot=<name>`` and then switches the file
``out/_current``, which names the snapshot and the last batch of each run that it holds. The
switch is one rename, so readers see the old table or the new one; a batch that is run again after
it was merged is recognised by its number and not counted twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyledger.session import materialize

POINTER = "_current"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names below ``path`` that are not hidden; none without the folder."""
    files, where = file_system(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(n for n in names if n[0] not in "_.")


def batch_folder(out: str, run: str, batch: int) -> str:
    return f"{out}/run={run}/batch={batch}"


def _pointer(spark: SparkSession, out: str) -> dict:
    files, where = file_system(spark, f"{out}/{POINTER}")
    if not files.exists(where):
        return {"snapshot": None, "merged": {}}
    stream = files.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _switch(spark: SparkSession, out: str, pointer: dict) -> None:
    """Replace the pointer by one rename."""
    jvm = spark.sparkContext._jvm
    files, new = file_system(spark, f"{out}/_next-{uuid.uuid4().hex}")
    stream = files.create(new, True)
    stream.write(bytearray(json.dumps(pointer).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{out}/{POINTER}"), options)


def _batches(spark: SparkSession, out: str) -> dict[str, list[int]]:
    """Batch numbers of every run."""
    runs = [n.removeprefix("run=") for n in folders(spark, out) if n.startswith("run=")]
    return {r: sorted(int(b.removeprefix("batch=")) for b in folders(spark, f"{out}/run={r}")) for r in runs}


def _live(spark: SparkSession, out: str, pointer: dict) -> list[str]:
    """The folders that hold the table."""
    new = [batch_folder(out, r, b) for r, numbers in _batches(spark, out).items() for b in numbers if b > pointer["merged"].get(r, -1)]
    return [f"{out}/{pointer['snapshot']}", *new] if pointer["snapshot"] else new


def read_versions(spark: SparkSession, out: str) -> DataFrame:
    """The snapshot's rows and those of all batches after it, as the streams wrote them."""
    return spark.read.option("recursiveFileLookup", "true").parquet(*_live(spark, out, _pointer(spark, out)))


def compact(spark: SparkSession, out: str, merge: Callable[[DataFrame], DataFrame]) -> int:
    """Replace all versions by ``merge`` of them; returns how many folders became one.

    ``merge`` must give the same table for merged rows and new ones together as for all rows at once. One
    compaction may run at a time, beside any number of writing streams.
    """
    pointer = _pointer(spark, out)
    merged, live = _batches(spark, out), _live(spark, out, pointer)
    if len(live) < 2:
        return len(live)
    snapshot = f"snapshot={uuid.uuid4().hex}"
    merge(spark.read.option("recursiveFileLookup", "true").parquet(*live)).write.parquet(f"{out}/{snapshot}")
    last = {r: max(numbers) for r, numbers in merged.items() if numbers}
    _switch(spark, out, {"snapshot": snapshot, "merged": pointer["merged"] | {r: max(b, pointer["merged"].get(r, -1)) for r, b in last.items()}})
    for old in live:
        files, where = file_system(spark, old)
        files.delete(where, True)
    return len(live)


def replace_partitions(new: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], by: str) -> list[str]:
    """Merge ``new`` into the table below ``path``, which is stored by the column ``by``.

    Only the partitions that ``new`` touches are read, merged and written; returns their folders.
    ``merge`` gets (new rows, stored rows of those partitions). The merged rows are stored before the partitions are
    replaced, so nothing reads what it overwrites.
    """
    spark = new.sparkSession
    stored = materialize(new, "new-rows")
    # One value per partition.
    touched = stored.select(by).distinct()
    names = {f"{by}={'__HIVE_DEFAULT_PARTITION__' if r[0] is None else r[0]}" for r in touched.collect()}
    have = [n for n in folders(spark, path) if n in names]
    if have:
        old = spark.read.schema(new.schema).option("basePath", path).parquet(*[f"{path}/{n}" for n in have]).select(*new.columns)
    else:
        old = new.limit(0)
    result = materialize(merge(stored, old), "merged-rows")
    result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return sorted(names)
