"""Writers: line-delimited JSON, Parquet with CSV, split manifests, training examples, shards.

All write in parallel, a file a task; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    """One object a line; null fields are written, so all lines have the same keys."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def parquet_and_csv(df: DataFrame, path: str) -> None:
    """The same rows twice: ``path``/parquet and ``path``/csv (with a header)."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def append_ledger(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the ledger doesn't have yet; returns how many that were.

    Rows of one call with the same key are one (the least); a second call with the same
    rows appends nothing, so a restart is safe."""
    spark = df.sparkSession
    first = df.groupBy(key).agg(F.min(F.struct(*df.columns)).alias("r")).select("r.*")
    try:
        new = first.join(spark.read.parquet(path).select(key), key, "left_anti").select(*df.columns)
    except Exception as e:  # no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = first
    new = new.checkpoint() if spark.sparkContext.getCheckpointDir() else new.cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def split_projection(df: DataFrame, path: str, hide: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(public, private): both have the row's locator, a digest of the path; only the
    private side has the path and the hidden columns."""
    located = df.withColumn("locator", F.substring(F.sha2(F.col(path), 256), 1, 16))
    return located.drop(path, *hide), located


def training_examples(df: DataFrame, key: str, inputs: tuple[str, ...], targets: tuple[str, ...], default: dict[str, str] | None = None) -> DataFrame:
    """``key`` and a JSON example of input and target; a null input takes its default
    ('UNK' for a tier), other nulls are left out."""
    default = {"tier": "UNK"} if default is None else default
    value: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(default[c])) if c in default else F.col(c) for c in inputs}
    return df.select(key, F.to_json(F.struct(F.struct(*(v.alias(c) for c, v in value.items())).alias("input"), F.struct(*targets).alias("target"))).alias("example"))
