"""Streaming forms of the batch operators.

Every job takes a streaming DataFrame and gives one; `run_to_table` drives it over what has landed and stores the result.
Moments are TIMESTAMP columns (a TIMESTAMP_NTZ must be cast before it can carry a watermark).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from newsgrid import vocab
from newsgrid.checkpoint import checkpointed, ensure_checkpoint_dir
from newsgrid.operators import state, weather
from newsgrid.sources import feeds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RAW_SCHEMA = "source_id string, type string, feed_url string, body string"


def _place(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all that has landed and return what the job has written so far; run again with the same places to go on."""
    spark = stream.sparkSession
    base = _place(spark)
    path, checkpoint = path or f"{base}/out", checkpoint or f"{base}/checkpoint"
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def land(rows: DataFrame, order: str) -> DataFrame:
    """A table as a stream that gives the rows of one value of `order` at a time, in the order of the values."""
    spark, at = rows.sparkSession, f"{_place(rows.sparkSession)}/landed"
    for v in sorted(r[0] for r in rows.select(order).distinct().collect()):
        rows.filter(F.col(order) == v).coalesce(1).write.mode("append").parquet(f"{at}/{order}={v}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Hand every micro-batch of what has landed to `each`."""
    checkpoint = checkpoint or f"{_place(stream.sparkSession)}/checkpoint"
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_ingest(spark: SparkSession, landing: str, out: str, checkpoint: str | None = None) -> None:
    """ST1: landed feed documents (JSON lines of RAW_SCHEMA) become items, appended per micro-batch."""
    raw = spark.readStream.schema(RAW_SCHEMA).json(landing)
    run_batches(raw, lambda batch, _: feeds.ingest(batch).write.mode("append").parquet(out), checkpoint)


def stream_dedup(items: DataFrame, key: str = "url", memory: str = "48 hours") -> DataFrame:
    """ST2: the first item of each key; a key is remembered for `memory`."""
    return items.withWatermark("published_at", memory).dropDuplicatesWithinWatermark([key])


def stream_guard(items: DataFrame, now, max_ahead_s: int = 3600, keep: str = "7 days") -> DataFrame:
    """ST3: without items dated too far ahead; later stages forget what is older than `keep`."""
    return items.filter(F.unix_seconds("published_at") <= F.unix_seconds(now) + max_ahead_s).withWatermark("published_at", keep)


def stream_breaking(members: DataFrame, min_sources: int = vocab.BREAKING_SOURCES, span: str = "60 minutes", step: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """ST4: clusters and windows in which enough publishers report (tight_spans decides by the spans themselves).

    The state of a window is the set of its sources as 64-bit hashes, eight bytes each: a sketch holds thousands of registers
    for the one or two sources that most windows have."""
    source = F.when(F.col("source_id").isNotNull(), F.xxhash64("source_id"))
    seen = members.withWatermark("published_at", late).groupBy(F.window("published_at", span, step), "cluster_id").agg(F.size(F.collect_set(source)).cast("long").alias("n_publishers"))
    return seen.filter(F.col("n_publishers") >= min_sources).select("cluster_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_publishers")


def stream_sessions(members: DataFrame, gap: str = "72 hours", late: str = "1 hour") -> DataFrame:
    """ST5: runs of reports of a cluster without a gap longer than `gap`."""
    runs = members.withWatermark("published_at", late).groupBy(F.session_window("published_at", gap), "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.select("cluster_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: Hash partitions of the state tables.
BUCKETS = 64
STATE = "event_id string, status string, version int, aliases array<string>, first_seen_s long, last_seen_s long, batch long"
MEMBERS = "event_id string, item_id string, source_id string"
#: table: its columns and the one that says in which partition a row lies.
TABLES = {"state": (STATE, "event_id"), "members": (MEMBERS, "event_id"), "claims": ("key string, event_id string", "key"), "owners": ("item_id string, event_id string", "item_id")}
MANIFEST = "name string, bucket int, at long, oldest_s long"


def _bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class StateTable:
    """Clusters between runs as partitioned tables: state and members by cluster, claims (ids and aliases) and owners (items)
    as indexes from what a batch names to the clusters it touches.

    A batch writes only the partitions that change, under its own number, and last of all a manifest: which batch wrote the
    partition that holds, and the oldest cluster in it.  What no manifest names does not count, so a batch that failed is
    simply done again, and one that is complete is not done twice.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets

    def manifest(self, n: int) -> dict[tuple[str, int], tuple[int, int | None]] | None:
        """(table, partition) -> (batch that wrote it, oldest last_seen_s), after batch n; None: there is none."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{n}").collect()  # a row for each partition of four tables
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return {(r["name"], r["bucket"]): (r["at"], r["oldest_s"]) for r in rows}

    def read(self, name: str, held: dict, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its partitions."""
        schema, parts = TABLES[name][0], {}
        for (table, b), (at, _) in held.items():
            if table == name and (buckets is None or b in buckets):
                parts.setdefault(at, []).append(b)
        found = [self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.root}/{name}/{at}").filter(F.col("bucket").isin(bs)) for at, bs in parts.items()]
        empty = self.spark.createDataFrame([], f"{schema}, bucket int")
        return reduce(DataFrame.union, found, empty)

    def touched(self, keys: DataFrame, key: str) -> set[int]:
        return {r["b"] for r in keys.select(_bucket_of(key, self.buckets).alias("b")).distinct().collect()}

    def look_up(self, name: str, held: dict, keys: DataFrame) -> DataFrame:
        """The clusters that an index has for keys (a column named like the table's key)."""
        key = TABLES[name][1]
        return self.read(name, held, self.touched(keys, key)).join(keys.select(key).distinct(), key, "left_semi").select("event_id").distinct()

    def replace(self, name: str, held: dict, n: int, gone: DataFrame, new: DataFrame, also: set[int] = frozenset(), keep: Column | None = None) -> dict:
        """Write the partitions that hold a key of gone (event_id and the key) or a row of new, without gone's rows and with
        new's, and those in `also`; -> what the manifest has for them."""
        schema, key = TABLES[name]
        names = [c.split()[0] for c in schema.split(", ")]
        buckets = self.touched(gone, key) | self.touched(new, key) | set(also)
        if not buckets:
            return {}
        rest = self.read(name, held, buckets).select(*names).join(gone.select("event_id").distinct(), "event_id", "left_anti")
        rows = rest.unionByName(new.select(*names))
        rows = (rows.filter(keep) if keep is not None else rows).withColumn("bucket", _bucket_of(key, self.buckets))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/{n}")
        oldest = {}
        if name == "state":
            # an empty result leaves no file to read
            kept = self.read(name, {(name, b): (n, None) for b in buckets}) if not rows.isEmpty() else rows
            oldest = {r["bucket"]: r["o"] for r in kept.groupBy("bucket").agg(F.min("last_seen_s").alias("o")).collect()}
        there = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        return {(name, b): (n, oldest.get(b)) if b in there else None for b in buckets}

    def apply(self, clusters: DataFrame, members: DataFrame, n: int, now_s: int, prune_days: float = 7) -> bool:
        """Make batch n (clusters: event_id, aliases, first_seen_s, last_seen_s; members: MEMBERS) part of the state; False if
        it already is."""
        if self.manifest(n) is not None:
            return False
        held = (self.manifest(n - 1) if n else {}) or {}
        clusters, members = clusters.persist(), members.persist()
        try:
            keys = clusters.select(F.explode(F.concat(F.array("event_id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("key")).distinct()
            near = self.look_up("claims", held, keys).union(self.look_up("owners", held, members.select("item_id"))).distinct()
            near = checkpointed(near)
            first = self._of(held, near)
            # clusters whose id a touched one claims can be taken in, if all their members are held
            claimed = first.select(F.explode("aliases").alias("key")).union(keys).distinct()
            near = checkpointed(near.union(self.look_up("claims", held, claimed)).distinct())
            prev, prev_members = checkpointed(self._of(held, near)), checkpointed(self._of(held, near, "members"))
            nxt = checkpointed(state.update_state(clusters, members, prev, prev_members, now_s, prune_days))
            fresh = nxt.filter("origin IS NOT NULL").select("event_id", "origin").join(members.withColumnRenamed("event_id", "origin"), "origin").select("event_id", "item_id", "source_id")
            stay = prev_members.join(nxt.filter("origin IS NULL").select("event_id"), "event_id", "left_semi")
            now_members = checkpointed(fresh.unionByName(stay).distinct())
            alive = F.col("last_seen_s").isNull() | (now_s - F.col("last_seen_s") <= prune_days * 86400)
            stale = {b for (name, b), (_, oldest) in held.items() if name == "state" and oldest is not None and now_s - oldest > prune_days * 86400}
            expired = checkpointed(self.read("state", held, stale).filter(~alive).select("event_id", "aliases"))
            gone = prev.select("event_id", "aliases").union(expired)
            gone_members = prev_members.unionByName(self._of(held, expired, "members").select("event_id", "item_id", "source_id"))
            claims = lambda d: d.select("event_id", F.explode(F.concat(F.array("event_id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("key")).distinct()
            done = dict(held)
            for name, old, new, also in (
                ("state", gone, nxt.withColumn("batch", F.lit(n).cast("long")), stale),
                ("members", gone, now_members, ()),
                ("claims", claims(gone), claims(nxt), ()),
                ("owners", gone_members, now_members.select("item_id", "event_id").distinct(), ()),
            ):
                for k, v in self.replace(name, held, n, old, new, set(also)).items():
                    done.pop(k, None)
                    if v is not None:
                        done[k] = v
            rows = [(name, b, at, oldest) for (name, b), (at, oldest) in done.items()]
            self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{n}")
        finally:
            clusters.unpersist()
            members.unpersist()
        return True

    def _of(self, held: dict, ids: DataFrame, name: str = "state") -> DataFrame:
        return self.read(name, held, self.touched(ids, "event_id")).drop("bucket").join(ids.select("event_id").distinct(), "event_id", "left_semi")

    def clusters(self, n: int) -> DataFrame:
        """All clusters after batch n; those that it did not touch are unchanged."""
        rows = self.read("state", self.manifest(n) or {})
        return rows.withColumn("status", F.when(F.col("batch") == n, F.col("status")).otherwise("unchanged")).drop("bucket", "batch")

    def members(self, n: int) -> DataFrame:
        return self.read("members", self.manifest(n) or {}).drop("bucket")


def stream_state(clusters: DataFrame, root: str, now_s: int | Callable[[int], int], prune_days: float = 7, checkpoint: str | None = None, buckets: int = BUCKETS) -> StateTable:
    """ST6: each micro-batch of clusters (event_id, first_seen_s, last_seen_s, aliases, item_id, source_id; a row per
    member) becomes part of the state table under `root`; now_s: the moment, or the moment of each batch."""
    table = StateTable(clusters.sparkSession, root, buckets)

    def each(batch: DataFrame, n: int) -> None:
        bounds = batch.groupBy(F.col("event_id").cast("string").alias("event_id")).agg(F.min("first_seen_s").alias("first_seen_s"), F.max("last_seen_s").alias("last_seen_s"), F.first("aliases").alias("aliases"))
        members = batch.select(*[F.col(c).cast("string").alias(c) for c in ("event_id", "item_id", "source_id")]).distinct()
        table.apply(bounds, members, n, now_s(n) if callable(now_s) else now_s, prune_days)

    run_batches(clusters, each, checkpoint)
    return table


class SourceSets(StatefulProcessor):
    """Remembers the sources of a cluster and tells of new ones; forgets a cluster some time after its last report.  The sources
    and the moment of that report are one value, read and written once for a cluster and batch: a call for each source costs
    a trip to the state store and back."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("ms", LongType()), StructField("sources", ArrayType(StringType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        known, sources = (held[0], list(held[1])) if held is not None else (None, [])
        if known is not None and timerValues.getCurrentWatermarkInMs() > known + self.keep_ms:
            # new reports come before the timers of a batch
            self.handle.deleteTimer(known + self.keep_ms)
            known, sources = None, []
        last, seen, out = known, set(sources), []
        for part in rows:
            ms = int(part["published_at"].max().timestamp() * 1000)
            last = ms if last is None else max(last, ms)
            for source in part["source_id"].astype(str).unique():
                if source not in seen:
                    seen.add(source)
                    out.append((key[0], source))
        if last != known or out:
            self.held.update((last, sources + [source for _, source in out]))
        if last != known:
            if known is not None:
                self.handle.deleteTimer(known + self.keep_ms)
            self.handle.registerTimer(last + self.keep_ms)
        if out:
            yield pd.DataFrame(out, columns=["cluster_id", "source_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


class TightSpans(StatefulProcessor):
    """Keeps the moments of a cluster's reports in order and the tightest spans over two and over `least` of them.  Moments
    are dropped once no report that can still come makes a tighter span with them."""

    def __init__(self, least: int) -> None:
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getListState("moments", StructType([StructField("us", LongType())]))
        self.found = handle.getValueState("found", StructType([StructField(n, LongType()) for n in ("n", "two", "many")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, two, many = self.found.get() if self.found.exists() else (0, None, None)
        moments = [m[0] for m in self.moments.get()] if self.moments.exists() else []
        new = [int(t.value // 1000) for part in rows for t in part["published_at"]]
        n, moments = n + len(new), sorted([*moments, *new])

        def tightest(k: int, known: int | None) -> int | None:
            return min([b - a for a, b in zip(moments, moments[k - 1 :])] + ([known] if known is not None else []), default=None)

        two, many = tightest(2, two), tightest(self.least, many)
        span = many if n >= self.least else moments[-1] - moments[0] if n > 1 else None
        if many is not None:
            edge = timerValues.getCurrentWatermarkInMs() * 1000 - max(two, many)
            moments = [m for m in moments if m >= edge]
        self.moments.put([(m,) for m in moments])
        self.found.update((n, two, many))
        minutes = lambda x: None if x is None else x / 6e7
        yield pd.DataFrame([(key[0], n, minutes(span), minutes(two))], columns=["cluster_id", "n", "span", "two"])

    def close(self) -> None:
        pass


def _with_rocksdb(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.set(name, before)


def stream_source_sets(members: DataFrame, keep: str = "30 days", late: str = "1 hour") -> DataFrame:
    """ST7: (cluster_id, source_id) the first time that a source reports on a cluster.  `keep` after its last report, by the
    time of events, a cluster is forgotten, and its sources join anew.  Needs the RocksDB state store."""
    rows = members.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("source_id").cast("string").alias("source_id"), F.col("published_at").cast("timestamp").alias("published_at")).withWatermark("published_at", late)
    return rows.groupBy("cluster_id").transformWithStateInPandas(SourceSets(int(pd.Timedelta(keep).total_seconds() * 1000)), StructType.fromDDL("cluster_id long, source_id string"), "Append", "EventTime")


def stream_tight_spans(members: DataFrame, min_sources: int = vocab.BREAKING_SOURCES, late: str = "1 hour") -> DataFrame:
    """ST4: (cluster_id, n, span, two) whenever a cluster has new reports: the exact spans of tight_spans, in minutes, over
    its n dated reports so far, so of the rows of a cluster the one with the largest n counts.  Needs the RocksDB state
    store."""
    rows = members.filter(F.col("published_at").isNotNull()).select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("published_at").cast("timestamp").alias("published_at")).withWatermark("published_at", late)
    return rows.groupBy("cluster_id").transformWithStateInPandas(TightSpans(min_sources), StructType.fromDDL("cluster_id long, n long, span double, two double"), "Append", "EventTime")


def stream_alerts(alerts: DataFrame, memory: str = "30 days") -> DataFrame:
    """ST8: each alert of warning level once."""
    return alerts.filter(weather.is_warning(F.col("event"), F.col("severity"))).withWatermark("effective", memory).dropDuplicatesWithinWatermark(["alert_id"])


class DailyQuota(StatefulProcessor):
    """Counts what a reader was told today; `quota` a day."""

    def __init__(self, quota: int = 3) -> None:
        self.quota = quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.today = handle.getValueState("today", StructType([StructField("day", StringType()), StructField("n", IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day, n = self.today.get() if self.today.exists() else ("", 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "story_id"]).itertuples():
            d = r.at.strftime("%Y-%m-%d")
            if d < day:
                continue
            day, n = (d, 0) if d > day else (day, n)
            if n < self.quota:
                n += 1
                out.append((key[0], int(r.story_id), d))
        self.today.update((day, n))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "story_id", "day"])

    def close(self) -> None:
        pass


def stream_quota(stories: DataFrame, quota: int = 3) -> DataFrame:
    """ST9: (user_id, story_id, day): the first `quota` stories of each reader and day; stories in quiet hours are to be left
    out before (library.in_quiet_hours).  Needs the RocksDB state store."""
    rows = stories.select(F.col("user_id").cast("long").alias("user_id"), F.col("story_id").cast("long").alias("story_id"), F.col("at").cast("timestamp").alias("at"))
    return rows.groupBy("user_id").transformWithStateInPandas(DailyQuota(quota), StructType.fromDDL("user_id long, story_id long, day string"), "Append", "None")


def stream_health(items: DataFrame, late: str = "1 hour") -> DataFrame:
    """ST10: items and newest moment of each source and day."""
    days = items.withWatermark("published_at", late).groupBy(F.window("published_at", "1 day"), "source_id").agg(F.count(F.lit(1)).alias("n"), F.max("published_at").alias("newest"))
    return days.select("source_id", F.col("window.start").alias("day"), "n", "newest")


def with_rocksdb(stream: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """Run a job that keeps state in pandas to its table, under the RocksDB state store."""
    return _with_rocksdb(spark, lambda: run_to_table(stream()))
