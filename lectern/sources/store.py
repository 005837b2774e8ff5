"""The chunk store as parquet tables.

Writes go to a new version folder and readers pick the newest complete one,
so no plan reads and overwrites the same path, and a retried job rewrites only
its own version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, base: str) -> list[int]:
    jvm, p, fs = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def read_latest(spark: SparkSession, base: str, schema) -> DataFrame:
    """Newest complete version, or an empty frame of ``schema`` (S6 default)."""
    v = versions(spark, base)
    if not v:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/v={v[-1]}")


def write_version(df: DataFrame, base: str, partition_by: list[str] | None = None) -> int:
    """Write ``df`` as the next version (S7 upsert result or S8 full rebuild)."""
    spark = df.sparkSession
    v = (versions(spark, base) or [0])[-1] + 1
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{base}/v={v}")
    return v


def rebuild(df: DataFrame, base: str, partition_by: list[str] | None = None) -> int:
    """A full rebuild is simply a new version that ignores the old ones."""
    return write_version(df, base, partition_by)


def count(store: DataFrame) -> int:
    """Number of stored chunks (0 means 'no index': retrieval refuses)."""
    return store.count()
