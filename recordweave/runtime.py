"""Session helpers shared by all operators: table access, parallelism, lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Tasks that keep every core busy: twice the cores, and never below the session's shuffle width."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by keys when the input has fewer splits than the cluster has cores to give.

    Decided from the size the plan estimates, without running any of it: a large input already comes in enough splits
    and is left as it is, so this costs a shuffle only where the table is small and the work per row is large. Hashing by
    key keeps a retried task's rows the same.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if size >= 2 * spark.sparkContext.defaultParallelism * split:
        return df
    return df.repartition(parallelism(spark), *keys)


def identity(*cols: Column | str) -> Column:
    """128 bits that stand for the columns' values: two hashes, as one of 64 bits would meet by chance among billions."""
    return F.struct(F.xxhash64(*cols).alias("h"), F.xxhash64(F.lit(7), *cols).alias("g"))


def by_key(df: DataFrame) -> DataFrame:
    """df for a join on keys: it is shuffled and sorted, and never sent whole to the driver and every executor.

    For postings, pairs and members, whose size grows with the data: an estimate of a shuffled stage's size is far below
    what its hash table takes, so leaving the choice to the planner means broadcasts that fill the driver.
    """
    return df.hint("merge")


def _folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's checkpoint folder, a temporary one only for a local master without any."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="recordweave-")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written as a table to the shared checkpoint folder and read from there; survives the loss of executors.

    Every stage runs once, and readers fetch only the columns they need. The table is deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def collected(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer used; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Delete tables that cut gave, before the session ends, where nothing will read them again."""
    for t in tables:
        spark = t.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in t.inputFiles()}
        for f in folders:
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def memo(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], object]) -> object:
    """What make gives, once per session for these inputs (files or folders); made anew when one of their files changes."""
    conf, state = spark._jsc.hadoopConfiguration(), []
    for i in inputs:
        p = spark._jvm.org.apache.hadoop.fs.Path(i)
        for f in p.getFileSystem(conf).listStatus(p):
            state.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    known = spark.sparkContext.__dict__.setdefault("_recordweave_known", {})
    key = (name, *inputs)
    if key not in known or known[key][0] != state:
        known[key] = (state, make())
    return known[key][1]


def once(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make gives, cut once per session for these inputs. See memo."""
    return memo(spark, name, inputs, lambda: cut(make()))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, where they may not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_recordweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="recordweave-")) / "recordweave.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(to))  # the driver serves it to every executor
    sc._recordweave_shipped = True
