"""Exact positions and running sums over a globally sorted table, without one task per group.

The table is range-partitioned on (group, order...), so a group of any size lies in consecutive partitions. A partition's
rows of one group continue the group's rows of earlier partitions; only the first group of a partition can do so, hence
the table of offsets has at most one row per partition, and is added by a broadcast join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordweave.runtime import cut, parallelism


def _free(df: DataFrame, *names: str) -> None:
    if taken := set(names) & set(df.columns):
        raise ValueError(f"columns are taken: {sorted(taken)}")


def _runs(cols: list[pa.Array], n: int) -> np.ndarray:
    """True where a row's group differs from the row before."""
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols:
        codes = c.dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def local_sums(schema: pa.Schema | None, group: list[str], weight: str | None, most: int | None):
    """Arrow batches of a sorted partition with _run (sum of weights up to and with the row, in its group and partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = [b.column(b.schema.get_field_index(g)) for g in group]
            new = _runs(cols, n)
            first = tuple(c[0].as_py() for c in cols)
            w = np.ones(n, np.int64) if weight is None else b.column(b.schema.get_field_index(weight)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(w)
            starts = np.flatnonzero(new)
            base = np.repeat(total[starts] - w[starts], np.diff(np.append(starts, n)))
            at = total - base
            if last is not None and first == last:
                end = starts[1] if len(starts) > 1 else n
                at[:end] += carried
            last, carried = tuple(c[n - 1].as_py() for c in cols), int(at[-1])
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "_run"])
            yield out if most is None else out.filter(pa.array(at <= most))

    return run


def _sorted_runs(df: DataFrame, group: list[str], order: list[Column], weight: str | None, most: int | None) -> DataFrame:
    keys = [F.col(g) for g in group]
    parts = df.repartitionByRange(parallelism(df.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    parts = parts.withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*parts.schema.fields, T.StructField("_run", T.LongType())])
    return parts.mapInArrow(local_sums(None, group, weight, most), schema)


def _offsets(runs: DataFrame, group: list[str]) -> DataFrame:
    """(group as _g0.., _p, _before): sum of the group's rows before partition _p, one row a partition of the sort at most.

    Only a partition's last group can go on in the next one, so of each partition that group and its sum are kept.
    """
    ends = runs.groupBy("_part").agg(F.max(F.struct(*group, "_run")).alias("_e"))
    ends = ends.select("_part", *[F.col(f"_e.{g}").alias(f"_g{i}") for i, g in enumerate(group)], F.col("_e._run").alias("_sum"))
    upto = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    following = F.lead("_part").over(Window.orderBy("_part"))
    return ends.select(*[f"_g{i}" for i in range(len(group))], following.alias("_p"), F.sum("_sum").over(upto).alias("_before")).filter("_p is not null")


def _placed(runs: DataFrame, group: list[str]) -> DataFrame:
    off = F.broadcast(_offsets(runs, group))  # at most one row per partition of the sort
    on = [runs["_part"] == off["_p"], *[runs[g].eqNullSafe(off[f"_g{i}"]) for i, g in enumerate(group)]]
    return runs.join(off, on, "left").withColumn("_run", F.col("_run") + F.coalesce("_before", F.lit(0))).drop("_p", "_before", "_part", *[f"_g{i}" for i in range(len(group))])


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, position: str = "position") -> DataFrame:
    """The first n rows of every group by order, with their exact position from 1.

    order must be total for a result that is the same on every run. Each partition of the global sort drops rows beyond
    its own n-th of a group (they can't be among the first n), so what is counted and joined is at most n rows per group
    and partition. A null group is a group. Equal rows take one position each. An empty table gives an empty one.
    Raises ValueError when a helper's or the position's name is taken.
    """
    _free(df, "_part", "_run", "_p", "_before", position)
    runs = cut(_sorted_runs(df, group, order, None, n))
    return _placed(runs, group).filter(F.col("_run") <= n).withColumnRenamed("_run", position)


def running_sum(df: DataFrame, group: list[str], order: list[Column], weight: str, total: str = "running") -> DataFrame:
    """Every row with the sum of weight over its group's rows up to it; null weights count 0. Skew-free as top_n."""
    _free(df, "_part", "_run", "_p", "_before", total)
    return _placed(cut(_sorted_runs(df, group, order, weight, None)), group).withColumnRenamed("_run", total)
