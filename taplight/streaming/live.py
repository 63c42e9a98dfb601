"""The batch operators on live input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from taplight.sources.shared import settings


def rocks(spark: SparkSession):
    """While it holds, streams that begin keep their state in RocksDB, as keyed processors need it."""
    return settings(spark, {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})


def tail(spark: SparkSession, folder: str, schema: str | StructType, files: int = 64) -> DataFrame:
    """JSON lines of files that land in a folder, a bounded number of files to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def rates(rows: DataFrame, keys: list[str], ts: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts per key and event-time window; rows later than the delay are dropped by the watermark."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def first_of_repeats(alerts: DataFrame, key: str, ts: str, delay: str = "5 minutes") -> DataFrame:
    """Alerts of which the same identifier came before within the delay are left out."""
    return alerts.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def cooldown(candidates: DataFrame, keys: list[str], cooldown_us: int, columns: str, rank: str = "rank", ts_us: str = "ts_us", arrival: str = "flow_id") -> DataFrame:
    """The cooldown and escalation fold with keyed state: the last emitted time and rank of each key.

    Rows of a batch are folded in event-time order; a key's state is two numbers.  ``columns`` is the DDL of
    ``candidates``.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, top = state.get if state.exists else (None, None)
        # What a micro-batch has of a key is put in order, so it is held; ``maxFilesPerTrigger`` bounds it.
        rows = pd.concat(list(batches)).sort_values([ts_us, arrival])
        kept = []
        for i, (t, r) in enumerate(zip(rows[ts_us], rows[rank], strict=True)):
            if last is None or t - last >= cooldown_us or r > top:
                last, top = int(t), int(r)
                kept.append(i)
        state.update((last, top))
        yield rows.iloc[kept]

    return candidates.groupBy(*keys).applyInPandasWithState(fold, columns, "last long, top int", "append", GroupStateTimeout.NoTimeout)


def sessions(alerts: DataFrame, key: str, ts: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Runs of a key's alerts that are no more than a gap apart, emitted when the watermark has passed them."""
    run = F.session_window(ts, gap)
    return alerts.withWatermark(ts, delay).groupBy(run.alias("run"), key).agg(F.count(F.lit(1)).alias("occurrences"), F.max("score").alias("max_score"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")).drop("run")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream gives for the input that is there now, through a Parquet sink with a checkpoint beside it."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_complete(stream: DataFrame, folder: str) -> DataFrame:
    """The whole result of an aggregation for the input that is there now, with what no watermark has passed yet.

    Each micro-batch writes the result under its number; the last one is read.
    """
    done: list[int] = []

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows-{number}")
        done.append(number)

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows-{max(done)}")
