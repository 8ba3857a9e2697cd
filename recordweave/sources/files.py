"""Files of the linkage contract: tab-separated records and id lists, cached normalised records, summaries, samples."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TSV = {"sep": "\t", "quote": "", "escape": "", "header": True, "nullValue": "\0", "emptyValue": ""}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str = RECORD) -> DataFrame:
    """Tab-separated strings with a header, no quoting; an empty field is an empty string, never null."""
    return spark.read.csv(path, schema=schema, **TSV).na.fill("")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(source1_entity_id, record_id): one row per id of each comma list; empty lists give none."""
    raw = read_tsv(spark, path, "source1_entity_id string, matched_entity_ids string")
    return split_list(raw, "source1_entity_id", "matched_entity_ids", "record_id")


def split_list(df: DataFrame, key: str, column: str, value: str) -> DataFrame:
    return df.select(key, F.explode(F.split(column, ",")).alias(value)).withColumn(value, F.trim(value)).filter(F.col(value) != "")


def list_column(src: str, pos: str, record: str) -> Column:
    """Comma list of a group's record ids in the order (source, position)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(src, pos, record))), lambda x: x[record]), ",")


def result_lists(queries: DataFrame, pairs: DataFrame, query: str, src: str, pos: str, record: str, out: str) -> DataFrame:
    """(query, out): one row per query, those without pairs with an empty list."""
    lists = pairs.groupBy(query).agg(list_column(src, pos, record).alias(out))
    return queries.select(query).distinct().join(lists, query, "left").withColumn(out, F.coalesce(out, F.lit("")))


def write_lists(lists: DataFrame, query: str, path: str) -> None:
    """Tab-separated result lists, in the order of the query ids over all files."""
    lists.orderBy(query).write.mode("overwrite").csv(path, sep="\t", quote="", escape="", header=True, emptyValue="")


def cached(df: DataFrame, path: str) -> DataFrame:
    """df from parquet at path, written first where no complete table is there."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def store(features: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Feature rows kept at path, a folder per value of by, and read from there; written only where no complete store is. Column order and names stay."""
    spark = features.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        features.write.mode("overwrite").partitionBy(*by).parquet(path)
    kept = spark.read.parquet(path)
    if set(kept.columns) != set(features.columns):
        raise ValueError(f"the store at {path} has other columns")
    return kept.select(*features.columns)


def lookup(stored: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The stored rows of the given keys; a key given twice counts once, one that isn't stored has no row."""
    return stored.join(keys.select(*on).distinct(), on, "left_semi")


def write_summary(values: dict, path: str) -> None:
    """A run's figures as JSON; values are scalars, lists and dicts."""
    Path(path).write_text(json.dumps(values, indent=1, sort_keys=True))


def uniform(key: Column, seed: str = "") -> Column:
    """A number in [0, 1) that depends on the key alone and is the same in other engines: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def smoke_sample(queries: DataFrame, records: DataFrame, truth: DataFrame, query: str, record: str, share: float) -> tuple[DataFrame, DataFrame]:
    """A sample of queries, and of records: all that belong to sampled queries, and `share` of the others."""
    q = queries.filter(uniform(F.col(query)) < share)
    theirs = truth.join(q.select(query), query, "left_semi").select(record).distinct().withColumn("_true", F.lit(True))
    r = records.join(theirs, record, "left").filter(F.coalesce("_true", F.lit(False)) | (uniform(F.col(record)) < share)).drop("_true")
    return q, r
