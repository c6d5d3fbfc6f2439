"""Feed ingestion as structured streams: parse, route by age, insert what is new, divert what is refused.

A link that was seen is kept as keyed state on RocksDB for `KEPT_DAYS`, so no batch reads what was stored before, and a
feed that is delivered again inserts nothing.  Late items are kept and routed, so no watermark drops them.  Rows reach
the table by the file sink, whose log makes a retried batch replace nothing and repeat nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewire.functions import text as X
from tidewire.operators.storage import keep
from tidewire.sources.blobs import stored
from tidewire.sources.feed_xml import every_item, items

FEED = "source_name STRING, xml STRING"
KEPT_DAYS = 90
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVERY = "30 seconds"  # fixed value: the longest that a batch of messages waits
TRIES = 5  # fixed value: deliveries before a dead letter


def routed(rows: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    fresh = F.unix_timestamp(F.coalesce("pub_date", F.lit(0).cast("timestamp"))) > F.unix_timestamp(now) - hours * 3600
    return rows.withColumn("status", F.when(fresh, "PENDING_FETCH").otherwise("SKIPPED_TOO_OLD"))


class FirstSeen(StatefulProcessor):
    """The first row of each link, by title; links that state knows give none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "times bigint", KEPT_DAYS * 86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        first, times = None, int(self.seen.get()[0]) if known else 0
        for f in rows:
            times += len(f)
            best = f.sort_values("title", kind="stable").head(1)
            if first is None or best["title"].iat[0] < first["title"].iat[0]:
                first = best
        self.seen.update((times,))
        if not known and first is not None:
            yield first

    def close(self) -> None:
        pass


def new_items(rows: DataFrame) -> DataFrame:
    """Rows whose link is seen for the first time; rows: a stream with a link and a title, neither null."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy("link").transformWithStateInPandas(FirstSeen(), rows.schema, "Append", "ProcessingTime")


def checks(feeds: DataFrame) -> DataFrame:
    """What each delivery says of its source, for scraper.states(): ok if its text was a feed with an item that is kept.

    feeds: source_id, frequency, checked_at, xml.
    """
    kept = F.exists(every_item(F.col("xml")), lambda i: (X.clean_string(F.coalesce(i["title"], F.lit("UNKNOWN"))) != "") & X.host(X.clean_url(i["link"])).isNotNull())
    ok = F.coalesce(kept, F.lit(False))
    return feeds.select("source_id", "frequency", "checked_at", ok.alias("ok"), F.when(~ok, "no item in the feed").alias("error"))


def start(spark: SparkSession, feeds: str, table: str, refused: str, checkpoint: str, now: Column, every: str | None = None) -> list[StreamingQuery]:
    """feeds: folder of JSON lines (source_name, xml).  Two queries: new items to `table`, refused ones to `refused`.

    every: time between batches (in production EVERY); without it both run over what is there and stop.
    """
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 100).json(feeds)
    rows = routed(items(stream), now)
    when = {"processingTime": every} if every else {"availableNow": True}

    def to(part: DataFrame, path: str, name: str) -> StreamingQuery:
        return part.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{checkpoint}/{name}").trigger(**when).start()

    good = rows.where(~F.col("rejected") & F.col("link").isNotNull() & F.col("title").isNotNull())
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"  # batches without rows only serve the clock: a run that stops has none
    before = spark.conf.get(idle)
    spark.conf.set(idle, "true" if every else "false")  # a query keeps what is set when it starts
    try:
        return [to(new_items(good), table, "new"), to(rows.where("rejected"), refused, "refused")]
    finally:
        spark.conf.set(idle, before)


# ---- rows that fail --------------------------------------------------------------------------------------------------

def careful(work: Callable[[DataFrame], None], retries: str, dead: str, tries: int = TRIES) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that does `work` and survives rows that make it fail.

    A batch that fails is split by a hash until the rows that fail are alone; these wait for the next batches, with a
    count of their tries, and after `tries` of them are written to `dead`.  Waiting rows are a table of each batch, so a
    batch that is run again finds what the one before it left.  work() must bear a row that it has done already.
    """

    def attempt(rows: DataFrame, depth: int = 0) -> list[tuple[DataFrame, str]]:
        """Parts that failed, each with its error."""
        try:
            work(rows.drop("_tries", "_key"))
            return []
        except Exception as e:  # whatever the work raises
            error = str(e)[:500]
        if depth >= 62 or rows.select("_key").distinct().limit(2).count() < 2:
            return [(rows, error)]
        bit = F.shiftright("_key", depth).bitwiseAND(F.lit(1))
        out = []
        for b in (0, 1):
            part = rows.where(bit == b)
            if not part.isEmpty():
                out += attempt(part, depth + 1)
        return out

    def run(batch: DataFrame, number: int) -> None:
        spark, cols = batch.sparkSession, batch.columns
        rows = batch.withColumn("_tries", F.lit(0)).withColumn("_key", F.xxhash64(*cols))
        before = f"{retries}/batch={number - 1}"
        if number and stored(spark, before):
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(before))
        rows = keep(rows, "batch")
        failed = [] if rows.isEmpty() else attempt(rows)
        left = rows.where(F.lit(False)).withColumn("_error", F.lit(None).cast("string"))
        for part, error in failed:
            left = left.unionByName(part.withColumn("_tries", F.col("_tries") + 1).withColumn("_error", F.lit(error)))
        left = keep(left, "failed")
        left.where(F.col("_tries") < tries).drop("_error").write.mode("overwrite").parquet(f"{retries}/batch={number}")
        left.where(F.col("_tries") >= tries).drop("_key").write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return run
