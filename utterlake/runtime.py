"""Session helpers: table access, shared scratch tables, and shipping the package to Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPO_ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of input files for a task of a sort.
TASK_BYTES = 1 << 30
_live: dict[str, SparkSession] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small enough for very long texts."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *have])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names one.

    Where it is unset, a local master gets a temporary folder (tests), any other master a folder beside the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            named = "file://" + tempfile.mkdtemp(prefix="utterlake-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _live[path] = spark
    return path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete scratch paths in whatever store holds them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _live.pop(path, None)


def _status(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return fs.getFileStatus(p) if fs.exists(p) else None


def exists(spark: SparkSession, path: str) -> bool:
    return _status(spark, path) is not None


def is_file(spark: SparkSession, path: str) -> bool:
    found = _status(spark, path)
    return found is not None and found.isFile()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none where there is no such folder."""
    if not exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(x.getPath().getName() for x in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a file or folder; an error where new exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    fs = a.getFileSystem(conf)
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(f"{old} cannot become {new}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that replaces the one at path in one step: readers see the old text or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, final = jvm.org.apache.hadoop.fs.Path(f"{path}.new"), jvm.org.apache.hadoop.fs.Path(path)
    out = final.getFileSystem(conf).create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(new, final, options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """What a small text file holds; None where there is none."""
    if not exists(spark, path):
        return None
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@atexit.register
def _release_all() -> None:
    for path, spark in list(_live.items()):
        try:
            release(spark, path)
        except Exception:  # the JVM may be gone already; the folder is the cluster's to clear
            _live.pop(path, None)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df once to the shared folder and read it back. Survives the loss of executors.

    Unlike checkpoint(), which runs its last stage twice, this computes df once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Free what materialize wrote for these, as a loop does with the tables of its former round. They must not be read again."""
    for table_ in tables:
        if path := _paths.pop(table_, None):
            release(table_.sparkSession, path)


def tasks_for(df: DataFrame) -> int:
    """Tasks with about TASK_BYTES of the files that df reads, but not fewer than the session's shuffle partitions.

    Plans tell the size of files without reading them. Tables that have none (rows from the driver) count as empty.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    unknown = 1 << 60  # what Spark takes for the size of such rows is beyond this
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(s for s in sizes if s < unknown) // TASK_BYTES)


def dealt_by_range(df: DataFrame, *keys: Column | str) -> DataFrame:
    """df range-partitioned by keys: over the session's shuffle partitions, which AQE may merge, or over more where df is too large for them."""
    n = tasks_for(df)
    return df.repartitionByRange(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartitionByRange(*keys)


def free_names(df: DataFrame, *bases: str) -> list[str]:
    """bases, each with underscores put before it until no column of df has that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        while base.lower() in taken:
            base = "_" + base
        out.append(base)
    return out


def numbered(df: DataFrame, groups: list[str], order: list[Column | str], name: str) -> DataFrame:
    """df with each row's 0-based place within its group, by ascending values of order; nulls form a group.

    A group may span as many tasks as its rows need: rows are range-partitioned and sorted by (groups, order), a row's
    place is its place in its partition plus what its group has in the partitions before. The starts that are joined are
    one row for each pair of group and partition that occurs, at most groups plus partitions.
    """
    part, row, n, first, of, shift = free_names(df, "_part", "_row", "_n", "_first", "_of", "_shift")
    keys = dict(zip(free_names(df, *(f"_k{i}" for i in range(len(order)))), (F.col(c) if isinstance(c, str) else c for c in order), strict=True))
    of_group = free_names(df, *(f"_g{i}" for i in range(len(groups))))
    by = [*groups, *keys] or [F.lit(0)]
    dealt = dealt_by_range(df.withColumns(keys), *by).sortWithinPartitions(*by).drop(*keys)
    rows = materialize(dealt.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id()}), "numbered")
    own = rows.groupBy(*groups, part).agg(F.count("*").alias(n), F.min(row).alias(first))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = own.select(*(F.col(g).alias(x) for g, x in zip(groups, of_group, strict=True)), F.col(part).alias(of), (before - F.col(first)).alias(shift))
    same = F.col(part) == F.col(of)
    for g, x in zip(groups, of_group, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(x))
    return rows.join(starts, same).select(*(c for c in df.columns if c != name), (F.col(row) + F.col(shift)).alias(name))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row even where the optimizer would repeat it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def splitters(df: DataFrame, key: str, n: int) -> list:
    """At most n-1 ascending values of key that cut df into about equal parts; one column is scanned."""
    if n < 2:
        return []
    got = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0]
    return sorted(set(got or []))


def bucket_of(key: Column, cuts: list) -> Column:
    """0-based number of the range (cuts[i-1], cuts[i]] that holds key; nulls go to 0. A binary search in an array, for any number of cuts."""
    if not cuts:
        return F.lit(0)
    values = F.array(*map(F.lit, cuts))

    def halved(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        above = (s["lo"] < s["hi"]) & F.coalesce(key > F.get(values, mid), F.lit(False))
        return F.struct(F.when(above, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi"))

    whole = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), whole, halved, lambda s: s["lo"])
