"""Incremental runs: arriving rows are de-duplicated, routed and written once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.dedupe import first_per_key
from ..sources.tables import failed, passed, route


def arriving(spark: SparkSession, folder: str, schema: str | StructType, glob: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


_KEY_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _session_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_incremental(
    source: DataFrame, key: Sequence[str], order: Sequence[str | Column], checks: Sequence[tuple[str, Column, str]], ok_path: str, failed_path: str, checkpoint: str
) -> None:
    """Process what has arrived, then stop; a later call goes on from the checkpoint.

    Of rows with the same key the one of the earliest batch is kept, inside a batch the first by `order`, at any
    distance in time; null keys are equal to each other. Each batch is first reduced to one row a key, before its
    shuffle, so that a frequent key is one row. A second stream then drops keys that it has seen: they lie in a
    state store, which is asked for the batch's keys only, so a batch reads no earlier batch.

    The second stream catches up before the next batch is written. It therefore never takes rows of two batches at
    once, and it has finished any step that was cut short before files it reads can be written again. Repeated steps
    overwrite what they left, and the two tables are written after that, so a row lands in exactly one of them
    however often executors or the driver restart.
    """
    spark, schema, names = source.sparkSession, source.schema, list(key)
    reduced, unseen = f"{checkpoint}/reduced", f"{checkpoint}/unseen"

    def drop_seen() -> None:
        with _session_settings(spark, _KEY_STATE):
            fresh = arriving(spark, f"{reduced}/*", schema).dropDuplicates(names)
            _each_batch(fresh, lambda batch, number: batch.write.mode("overwrite").parquet(f"{unseen}/{number}"), f"{checkpoint}/seen")

    def reduce_batch(batch: DataFrame, number: int) -> None:
        if number:
            drop_seen()
        first_per_key(batch, names, list(order)).write.mode("overwrite").parquet(f"{reduced}/{number}")

    _each_batch(source, reduce_batch, f"{checkpoint}/arrived")
    drop_seen()
    routed = route(arriving(spark, f"{unseen}/*", schema), checks)
    queries = [
        part.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{checkpoint}/{name}")
        .outputMode("append").trigger(availableNow=True).start()
        for name, part, path in (("ok", passed(routed), ok_path), ("failed", failed(routed), failed_path))
    ]
    for q in queries:
        q.awaitTermination()


def apply_rows(df: DataFrame, function: Callable[[dict], object], columns: Sequence[str], output: str, stage: str = "row_function") -> DataFrame:
    """`function` per row in parallel; an exception becomes `stage` and `error_message` on its row.

    For work no built-in expresses. `output` is the SQL type of the `value` column.
    """
    columns = list(columns)
    names = df.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", value {output}, stage string, error_message string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, stages, messages = [], [], []
            for row in pdf[columns].to_dict("records"):
                try:
                    values.append(function(row))
                    stages.append(None)
                    messages.append(None)
                except Exception as e:
                    values.append(None)
                    stages.append(stage)
                    messages.append(f"{type(e).__name__}: {e}")
            yield pdf[names].assign(value=values, stage=stages, error_message=messages)

    return df.mapInPandas(run, schema)


def score_batches(df: DataFrame, load_model: Callable[[], Callable[[pd.DataFrame], pd.Series]], columns: Sequence[str], output: str = "double", rows_per_call: int = 1024) -> DataFrame:
    """Model loaded once per task, called on batches; a failing batch keeps its rows with the error."""
    columns = list(columns)
    names = df.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", value {output}, stage string, error_message string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for pdf in batches:
            for lo in range(0, len(pdf), rows_per_call):
                part = pdf.iloc[lo : lo + rows_per_call]
                try:
                    yield part[names].assign(value=model(part[columns]), stage=None, error_message=None)
                except Exception as e:
                    yield part[names].assign(value=None, stage="model", error_message=f"{type(e).__name__}: {e}")

    return df.mapInPandas(run, schema)
