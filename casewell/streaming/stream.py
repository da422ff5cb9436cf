"""Streams: triage of messages as they arrive, and near-duplicate collapse within a horizon."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text as T
from ..operators.route import pattern_route, with_policy
from ..operators.vectors import Neighbours


def with_policy_of(messages: DataFrame, classes: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """A stream's messages joined with two static tables: the class of each (key, intent) and the class's policy."""
    return with_policy(messages.join(classes.select(key, "intent"), key, "left"), taxonomy)


def route_batch(messages: DataFrame, vectors: DataFrame, history: Neighbours, key: str, message: str = "text", least: float = 0.3) -> DataFrame:
    """A micro-batch of messages with similarity and triggered_rule: patterns first, then the class's policy, then whether
    the history holds anything similar. Vectors (key, vector) and history are static: all batches search the same index."""
    asked = vectors.join(messages.select(key).distinct(), key, "left_semi").select(F.col(key).alias("query_id"), "vector")
    near = history.topk(asked, 2).where("id <> query_id").groupBy(F.col("query_id").alias(key)).agg(F.max("similarity").alias("similarity"))
    rows = pattern_route(messages.join(near, key, "left"), message).withColumnRenamed("triggered_rule", "pattern_")
    rule = F.when(F.col("pattern_") != "rules_only", F.col("pattern_")).when(F.col("never_auto"), "never_auto_intent")
    return rows.withColumn("triggered_rule", rule.when(F.coalesce("similarity", F.lit(0.0)) < least, "low_retrieval_similarity").otherwise("rules_only")).drop("pattern_")


def run_batches(stream: DataFrame, handle, name: str, checkpoint: str, sink: str) -> None:
    """Drive a bounded stream to completion, each micro-batch through ``handle`` (rows in, rows out); a batch that is
    repeated after a failure writes its own folder again."""

    def one(rows: DataFrame, number: int) -> None:
        handle(rows).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRST = "dedupe_key string, time_us long, id long"
#: Buckets of keys that share a state.
BUCKETS = 4096


class FirstByTime(StatefulProcessor):
    """Of each key the earliest message by event time and, once a horizon has passed since one was given out, the next.
    Messages wait until the watermark has passed them, so a later one that arrives first does not win. Keys are dealt to
    buckets, whose state is read and written in one go, for a call per key takes far longer than its rows. State of a
    bucket: what waits, a row for each batch, and the times last given out, which are forgotten when they are older than the horizon."""

    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "dedupe_key array<string>, time_us array<long>, id array<long>")
        self.last = handle.getListState("last", "dedupe_key string, time_us long")

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat([_none(), *rows]).groupby(["dedupe_key", "time_us"], as_index=False).id.min()
        if len(rows):
            self.waiting.appendValue(tuple(rows[c].tolist() for c in rows.columns))
            self.handle.registerTimer(-(-int(rows.time_us.min()) // 1000))
        yield _none()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows, last = sorted((t, i, k) for many in self.waiting.get() for k, t, i in zip(*many)), dict(self.last.get())
        held, out, later = bool(last), [], [r for r in rows if r[0] > passed]
        for t, i, k in rows[: len(rows) - len(later)]:
            if k not in last or t >= last[k] + self.horizon:
                out.append((k, t, i))
                last[k] = t
        if len(later) < len(rows):
            self._keep(self.waiting, [([k for _, _, k in later], [t for t, _, _ in later], [i for _, i, _ in later])] if later else [])
        last = {k: t for k, t in last.items() if passed < t + self.horizon}
        if held or last:
            self._keep(self.last, list(last.items()))
        for due in [t for t, _, _ in later[:1]] + ([min(last.values()) + self.horizon] if last else []):
            self.handle.registerTimer(-(-due // 1000))
        yield pd.concat([_none(), pd.DataFrame(out, columns=["dedupe_key", "time_us", "id"]).astype({"time_us": "int64", "id": "int64"})])

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def _none() -> pd.DataFrame:
    return pd.DataFrame({"dedupe_key": pd.Series(dtype=str), "time_us": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64")})


def stream_dedupe(messages: DataFrame, message: str, time: str, id_column: str, horizon: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """dedupe_key, time_us, id of the first message of every key by event time, and of the first one a horizon or more after
    it, and so on; ties go to the smaller id. Messages later than ``delay`` behind the newest are dropped."""
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    millis = int(pd.Timedelta(horizon).total_seconds() * 1000)
    keyed = messages.withWatermark(time, delay).select(T.dedupe_key(F.col(message)).alias("dedupe_key"), F.unix_micros(F.col(time)).alias("time_us"), F.col(id_column).cast("long").alias("id"), F.col(time).alias("time"))
    dealt = keyed.withColumn("bucket", F.pmod(F.xxhash64("dedupe_key"), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(FirstByTime(millis), FIRST, "Append", "EventTime")


def run_to_end(stream: DataFrame, name: str, checkpoint: str, sink: str) -> DataFrame:
    """Drive a bounded stream to completion into Parquet files and read them."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)
