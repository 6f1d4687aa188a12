"""Structured Streaming forms of the polling behaviours.

Every function takes a streaming DataFrame and returns one, except the ``foreachBatch`` jobs, which return the query.
State is bounded by a watermark, a timeout or a trailing table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from gristmill.functions.text import clean_title, token_set
from gristmill.operators import feeds as FE
from gristmill.operators import related as RL
from gristmill.session import scratch_path


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a Parquet folder on shared storage and read that folder."""
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, name), scratch_path(spark, f"{name}-ckpt")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Like ``drain`` for results that change: every batch writes the rows it changed under its number, and a row of
    ``keys`` is read as the last batch left it. A repeated batch overwrites its own folder."""
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, name), scratch_path(spark, f"{name}-ckpt")
    columns = [c for c in stream.columns if c not in keys]

    def step(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/_batch={batch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", ckpt).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    log = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).parquet(out)
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_batch").alias("_last"))
    return last.select(*keys, "_last.*").select(*stream.columns)


def item_dedupe(items: DataFrame, when: str = "pub_ts", key: str = "link_key", days: int = 5) -> DataFrame:
    """First item per link key inside the watermark; items later than the watermark are dropped."""
    return items.withWatermark(when, f"{days} days").dropDuplicatesWithinWatermark([key])


def _ordered_store(spark: SparkSession) -> None:
    """State with timers lives in the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class HiddenIntervals(StatefulProcessor):
    """The open intervals of a story: start to (last mark, number of marks); marks may come in any order.

    A mark joins the intervals whose marks are less than a span away, and may join two of them to one. An interval that
    the watermark has left by a span can meet no further mark; a timer removes it.
    """

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start bigint", "last bigint, marks bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: (v[0], v[1]) for k, v in self.open.iterator()}
        now = dict(before)
        for pdf in filter(len, rows):
            times = np.sort(pdf["millis"].to_numpy(np.int64))
            cuts = np.flatnonzero(np.diff(times) >= self.span) + 1
            for run in np.split(times, cuts):
                lo, hi, n = int(run[0]), int(run[-1]), len(run)
                for start, (last, marks) in list(now.items()):
                    if lo < last + self.span and start < hi + self.span:
                        lo, hi, n = min(lo, start), max(hi, last), n + marks
                        del now[start]
                now[lo] = hi, n
        out = []
        for start in before.keys() - now.keys():
            # it is part of an interval with another start from here on
            self.open.removeKey((start,))
            out.append((key[0], start, None, 0))
        for start, (last, marks) in now.items():
            if before.get(start) != (last, marks):
                self.open.updateValue((start,), (last, marks))
                self.handle.registerTimer(last + self.span)
                out.append((key[0], start, last + self.span, marks))
        return iter([pd.DataFrame(out, columns=["key", "hidden_from", "hidden_until", "marks"]).astype({"hidden_until": "Int64"})] if out else ())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        for start, (last, _) in [(k[0], v) for k, v in self.open.iterator()]:
            if last + self.span <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.removeKey((start,))
        return iter(())


def unusable_ttl(marks: DataFrame, delay: str, key: str = "story_key", when: str = "t", hours: int = 24) -> DataFrame:
    """Intervals in which a story is hidden, in milliseconds: (key, hidden_from, hidden_until, marks), in update mode.

    A mark hides its story for 24 hours; marking it again renews the time. An interval is emitted when it opens and again
    whenever it changes, so open ones are known too; ``drain_updates`` keeps the last state of (key, hidden_from). A mark
    that comes late but within ``delay`` can move a start or join two intervals: the row of the start that is gone is
    emitted with no marks (``marks = 0``). Marks that come later than ``delay`` are dropped.
    """
    _ordered_store(marks.sparkSession)
    kind = dict(marks.dtypes)[key]
    x = marks.withWatermark(when, delay).withColumn("millis", F.unix_millis(when)).select(key, when, "millis")
    out = x.groupBy(key).transformWithStateInPandas(
        HiddenIntervals(hours * 3600 * 1000), f"key {kind}, hidden_from bigint, hidden_until bigint, marks bigint", "update", "EventTime")
    return out.select(F.col("key").alias(key), "hidden_from", "hidden_until", F.col("marks").cast("int").alias("marks"))


class RateCounter(StatefulProcessor):
    """Hits wait until the watermark has passed their slot of event time, then they are decided in order.

    State of a key: the hits that wait, in one list, and (accepted so far, last accepted hit, next timer). One timer stands
    at the end of the earliest slot that has hits; when it fires, the hits of all slots that the watermark has passed are
    decided at once, so a batch costs a key a few calls to the store, however many of its slots end.
    """

    def __init__(self, limit: int, gap: int, slot: int):
        self.limit, self.gap, self.slot = limit, gap, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros bigint")
        self.counter = handle.getValueState("counter", "n bigint, last bigint, timer bigint")

    def _ends(self, times: np.ndarray) -> np.ndarray:
        return (times // 1000 // self.slot + 1) * self.slot

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        times = np.concatenate([pdf["micros"].to_numpy(np.int64) for pdf in rows] or [np.empty(0, np.int64)])
        if len(times):
            self.waiting.appendList([(t,) for t in times.tolist()])
            n, last, timer = self.counter.get() or (0, None, None)
            first = int(self._ends(times).min())
            if timer is None or first < timer:
                self.handle.registerTimer(first)
                self.counter.update((n, last, first))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        n, last, timer = self.counter.get() or (0, None, None)
        if timer is None or timer > now:
            # an earlier timer of this key has done the work
            return iter(())
        times = np.sort(np.array([r[0] for r in self.waiting.get()], np.int64))
        passed = self._ends(times) <= now
        for t in times[passed].tolist():
            if last is not None and t - last >= self.gap:
                n = 0
            ok = n < self.limit
            if ok:
                n, last = n + 1, t
            out.append((key[0], t, ok))
        rest = times[~passed]
        if out:
            if len(rest):
                self.waiting.put([(t,) for t in rest.tolist()])
            else:
                self.waiting.clear()
        if len(rest):
            timer = int(self._ends(rest[:1])[0])
        elif last is not None and last + self.gap > now * 1000:
            # the counter is forgotten once no later hit can be inside its gap
            timer = (last + self.gap) // 1000 // self.slot * self.slot + 2 * self.slot + 1
        else:
            timer = None
        if timer is None:
            self.counter.clear()
        else:
            self.handle.registerTimer(timer)
            self.counter.update((n, last, timer))
        return iter([pd.DataFrame(out, columns=["key", "us", "accepted"])] if out else ())


def rate_audit(hits: DataFrame, delay: str, key: str = "key", when: str = "ts", limit: int = 3, gap_seconds: int = 600, slot_seconds: int = 60) -> DataFrame:
    """(key, ts, accepted) per hit that is not later than ``delay``, in append mode.

    A counter lives until ``gap_seconds`` pass without an accepted hit; at the limit hits are refused. Hits are decided in
    the order of their times, whatever order they come in: those of a slot when the watermark has passed it.
    """
    _ordered_store(hits.sparkSession)
    kind = dict(hits.dtypes)[key]
    x = hits.withWatermark(when, delay).withColumn("micros", F.unix_micros(when)).select(key, when, "micros")
    out = x.groupBy(key).transformWithStateInPandas(
        RateCounter(limit, gap_seconds * 1_000_000, slot_seconds * 1000), f"key {kind}, us bigint, accepted boolean", "append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("us").alias("ts"), "accepted")


def usage_windows(hits: DataFrame, delay: str, key: str = "key", when: str = "ts", tokens: str = "tokens", size: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """Tokens per key in sliding windows; in update mode (``drain_updates``) windows that are still open count too."""
    g = hits.withWatermark(when, delay).groupBy(F.window(when, size, step).alias("w"), key).agg(F.sum(tokens).alias("tokens"))
    return g.select(key, F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "tokens")


def usage_last_minute(hits: DataFrame, key: str = "key", when: str = "ts", tokens: str = "tokens", span_seconds: int = 60) -> DataFrame:
    """Batch form: tokens of the key in the last ``span_seconds`` at each hit, itself included.

    A window over the whole key would sort a busy key in one task. Each hit is placed in its own time slice and, as
    history, in the next one; a slice then holds at most two spans of one key.
    """
    us, span = F.unix_micros(when), span_seconds * 1_000_000
    own = F.floor(us / span)
    x = hits.withColumn("_us", us).withColumn("_own", own).withColumn("_slice", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = W.partitionBy(key, "_slice").orderBy("_us").rangeBetween(-(span - 1), 0)
    return x.withColumn("used", F.sum(tokens).over(w)).filter("_slice = _own").drop("_us", "_own", "_slice")


def coverage_job(stories: DataFrame, name: str, when: str = "published_at", hours: int = 40, ckpt: str | None = None, folder: str | None = None):
    """Coverage kept over a trailing table: each batch joins its new stories to those of the last 40 hours.

    The trailing table is partitioned by hour of publication, so a batch lists and reads the partitions of the last 40
    hours only, however long the history is. Only stories near one that came or fell out of the 40 hours are counted
    again. Returns (streaming query, path of the coverage table): one row for each story and batch that changed it; the row
    of the highest batch number is current. A repeated batch overwrites its own partitions.
    """
    spark = stories.sparkSession
    folder = folder or scratch_path(spark, name)
    past, out, marks, ckpt = f"{folder}/past", f"{folder}/out", f"{folder}/newest", ckpt or f"{folder}/ckpt"
    schema = "story_id bigint, title string, source string, published_at timestamp, hour bigint, _batch bigint"
    span = hours * 3600

    def newest_until(batch: int) -> float | None:
        """The newest time, in seconds, of the batches before this one."""
        try:
            return spark.read.parquet(f"{marks}/_batch={batch - 1}").first()[0]
        except AnalysisException:
            return None

    def between(batch: int, low: float | None, high: float) -> DataFrame:
        """Stories of the trailing table with low < time <= high, from the partitions of these hours."""
        rows = spark.read.schema(schema).parquet(past).filter((F.col("hour") <= int(high // 3600)) & (F.col("_batch") <= batch))
        rows = rows if low is None else rows.filter(F.col("hour") >= int(low // 3600))
        seconds = F.unix_micros("published_at") / 1e6
        return rows.filter(seconds <= high) if low is None else rows.filter((seconds > low) & (seconds <= high))

    def step(new: DataFrame, batch: int) -> None:
        rows = new.select("story_id", "title", "source", F.col(when).alias("published_at"))
        rows = rows.withColumns({"hour": F.floor(F.unix_seconds("published_at") / 3600), "_batch": F.lit(batch).cast("bigint")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "_batch").parquet(past)
        before, latest = newest_until(batch), rows.agg(F.max(F.unix_micros("published_at") / 1e6)).first()[0]
        newest = max(t for t in (before, latest, 0.0) if t is not None)
        spark.createDataFrame([(newest,)], "newest double").coalesce(1).write.mode("overwrite").parquet(f"{marks}/_batch={batch}")
        live = between(batch, newest - span, newest)
        # in the first batch every story has come
        changed = None if before is None else rows.select("title")
        if before is not None and newest > before:
            changed = changed.unionByName(between(batch - 1, before - span, newest - span).select("title"))
        counted = FE.coverage(live.select("story_id", "title", "source"), changed)
        counted.select("story_id", "coverage").write.mode("overwrite").parquet(f"{out}/_batch={batch}")

    return stories.writeStream.foreachBatch(step).option("checkpointLocation", ckpt).trigger(availableNow=True).start(), out


def read_coverage(spark: SparkSession, out: str) -> DataFrame:
    """Current coverage per story."""
    df = spark.read.schema("story_id bigint, coverage int, _batch bigint").parquet(out)
    return df.groupBy("story_id").agg(F.max_by("coverage", "_batch").alias("coverage"))


def _packed(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _unpacked(rows) -> pa.Table | None:
    tables = [pa.ipc.open_stream(bytes(r[0])).read_all() for r in rows]
    return pa.concat_tables(tables).combine_chunks() if tables else None


class _Units:
    """Rows of equal id, time and size as one set: its tokens are those of all its rows, repeats counted."""

    def __init__(self, t: pa.Table):
        ids = t["id"].combine_chunks().dictionary_encode()
        no, us, n = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False), t["us"].to_numpy(), t["n"].to_numpy()
        order = np.lexsort((n, us, no))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (no, us, n)], axis=0)
        self.of_row = np.empty(len(order), np.int64)
        self.of_row[order] = np.cumsum(new) - 1
        first = order[new]
        self.id, self.us, self.need, self.null = t["id"].combine_chunks().take(pa.array(first)), us[first], t["need"].to_numpy()[first], no[first] < 0
        self.rows = np.bincount(self.of_row, minlength=len(first))
        lists = t["codes"].combine_chunks().take(pa.array(order))
        size = np.bincount(self.of_row[order], lists.value_lengths().to_numpy(zero_copy_only=False), len(first)).astype(np.int32)
        self.codes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), lists.flatten())

    def batch(self, rows: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"id": pa.array(rows), "t": pa.array(need), "codes": self.codes.take(pa.array(rows))})


class WaitingSections(StatefulProcessor):
    """Sections of one slot of time and lane, and the stories that may meet them.

    A story is final when the watermark has passed it: no section before it can come any more, so it meets all that it can
    meet at once, and goes. A section goes when the watermark has passed the end of its span, with a row of its own if no
    story has met it. Rows are kept as Arrow tables, so a batch costs a key a few calls to the store.
    """

    def __init__(self, span: int, step: int):
        self.span, self.step = span, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sections = handle.getListState("sections", "rows binary")
        self.stories = handle.getListState("stories", "rows binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def _time(self, *tables: pa.Table | None) -> int | None:
        """The first step past the time at which a story or the end of a section's span is final."""
        ends = [int(t["us"].to_numpy().min()) + add for t, add in zip(tables, (self.span, 0)) if t is not None and t.num_rows]
        return -(-(min(ends) // 1000 + 1) // self.step) * self.step if ends else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = []
        for pdf in filter(len, rows):
            for side, state in enumerate((self.sections, self.stories)):
                own = pdf[pdf["side"] == side]
                if not len(own):
                    continue
                lists = own["codes"].tolist()
                codes = np.concatenate([np.asarray(x, np.int64) for x in lists])
                ends = pa.array(np.append(0, np.cumsum([len(x) for x in lists])), pa.int32())
                t = pa.table({"id": pa.array(own["id"], pa.string(), from_pandas=True), "us": pa.array(own["us"].to_numpy(np.int64)), "n": pa.array(own["n"].to_numpy(np.int64)),
                              "need": pa.array(own["need"].to_numpy(np.int32)), "codes": pa.ListArray.from_arrays(ends, pa.array(codes)), "met": pa.array(np.zeros(len(own), np.int8))})
                state.appendList([(_packed(t),)])
                first.append(self._time(*((t, None) if side == 0 else (None, t))))
        if first:
            at = self.timer.get()
            if at is None or min(first) < at[0]:
                self.handle.registerTimer(min(first))
                self.timer.update((min(first),))
        return iter(())

    def _pairs(self, sections: _Units, stories: _Units, met: np.ndarray) -> Iterator[pd.DataFrame]:
        """The pairs, once for each row of a section; marks the sections that were met."""
        need = stories.need
        left = np.flatnonzero(~sections.null & (sections.codes.value_lengths().to_numpy(zero_copy_only=False) > 0))
        for lo in range(0, len(left), RL.BLOCK_SETS):
            some = left[lo:lo + RL.BLOCK_SETS]
            block = RL._Block([sections.batch(some, sections.need[some])])
            for at in range(0, len(need), 10_000):
                part = np.arange(at, min(at + 10_000, len(need)))
                for l, r, shared in block.meet(stories.batch(part, need[part])):
                    l, r = some[l], part[r]
                    inside = (sections.us[l] <= stories.us[r]) & (stories.us[r] <= sections.us[l] + self.span)
                    l, r, shared = l[inside], r[inside], shared[inside]
                    met[l] = True
                    l, r, shared = (np.repeat(x, n) for n in (sections.rows[l],) for x in (l, r, shared))
                    for i in range(0, len(l), 50_000):
                        j = slice(i, i + 50_000)
                        yield pd.DataFrame({"section_id": sections.id.take(pa.array(l[j])).to_pandas(), "story_id": stories.id.take(pa.array(r[j])).to_pandas(), "shared": pd.array(shared[j], "Int64")})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at = timerValues.getCurrentWatermarkInMs(), self.timer.get()
        if at is None or at[0] > now:
            # an earlier timer of this key has done the work
            return
        sections, stories = _unpacked(self.sections.get()), _unpacked(self.stories.get())
        final = stories["us"].to_numpy() <= now * 1000 if stories is not None else np.empty(0, bool)
        if sections is not None:
            seen = sections["met"].to_numpy() > 0
            if final.any():
                units = _Units(sections)
                met = np.zeros(len(units.us), bool)
                yield from self._pairs(units, _Units(stories.filter(pa.array(final))), met)
                seen = seen | met[units.of_row]
            over = sections["us"].to_numpy() + self.span <= now * 1000
            alone = sections["id"].filter(pa.array(over & ~seen)).to_pandas()
            for i in range(0, len(alone), 50_000):
                ids = alone[i:i + 50_000].reset_index(drop=True)
                yield pd.DataFrame({"section_id": ids, "story_id": pd.Series([None] * len(ids), dtype=object), "shared": pd.array([pd.NA] * len(ids), "Int64")})
            sections = sections.set_column(sections.schema.get_field_index("met"), "met", pa.array(seen.astype(np.int8))).filter(pa.array(~over))
        stories = None if stories is None else stories.filter(pa.array(~final))
        for state, t in ((self.sections, sections), (self.stories, stories)):
            if t is not None and t.num_rows:
                state.put([(_packed(t),)])
            else:
                state.clear()
        timer = self._time(sections, stories)
        if timer is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(timer)
            self.timer.update((timer,))


def carry_expiry(sections: DataFrame, stories: DataFrame, hours: int = 72, delay: str = "1 hour", lanes: int = 4, step_seconds: int = 60) -> DataFrame:
    """Waiting sections met by a related story inside their 72 hours, and those that expire: (section_id, story_id, shared).

    ``sections(section_id, title, at)`` and ``stories(story_id, title, published_at)`` are streams. A story meets the sections
    whose interval it falls into when the watermark has passed it (in steps of ``step_seconds``); a section that no story has
    met when the watermark passes the end of its interval is emitted with a null ``story_id``, and its state goes. Sections are
    dealt by half spans of time and into ``lanes``; a story goes to the three half spans and the lanes that it can meet.
    """
    _ordered_store(sections.sparkSession)
    kinds, span = {c: dict(d.dtypes)[c] for d, c in ((sections, "section_id"), (stories, "story_id"))}, hours * 3600 * 1_000_000
    tokens = token_set(clean_title("title"))
    codes = F.transform("tokens", lambda x: F.xxhash64(x)).alias("codes")
    slot = lambda us: F.floor(us / (span // 2))
    s = sections.withWatermark("at", delay).withColumns({"tokens": tokens, "us": F.unix_micros("at")}).filter("us IS NOT NULL")
    # the size of the story alone decides how much must be shared
    s = s.select(F.col("at").alias("when"), F.lit(0).alias("side"), F.col("section_id").cast("string").alias("id"), "us", F.lit(0).cast("bigint").alias("n"), F.lit(2**31 - 1).alias("need"), codes,
                 slot(F.col("us")).alias("slot"), F.pmod(F.xxhash64("section_id"), F.lit(lanes)).alias("lane"))
    t = stories.withWatermark("published_at", delay).withColumns({"tokens": tokens, "us": F.unix_micros("published_at")}).filter("us IS NOT NULL")
    t = t.select(F.col("published_at").alias("when"), F.lit(1).alias("side"), F.col("story_id").cast("string").alias("id"), "us", F.size("tokens").cast("bigint").alias("n"),
                 RL.RELATED(F.greatest(F.size("tokens"), F.lit(1))).cast("int").alias("need"), codes,
                 F.explode(F.sequence(slot(F.col("us") - span), slot(F.col("us")))).alias("slot"))
    t = t.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lanes - 1).cast("bigint"))))
    out = s.unionByName(t).groupBy("slot", "lane").transformWithStateInPandas(
        WaitingSections(span, step_seconds * 1000), "section_id string, story_id string, shared bigint", "append", "EventTime")
    return out.select(*[F.col(c).cast(kinds[c]).alias(c) for c in kinds], "shared")
