"""Streaming forms: stateless scans, windows, bounded joins, cooldown and attempt limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threatscan.functions.tables import in_blocks, met, stored
from threatscan.operators.urls import scan_urls

COOLDOWN, TTL, ATTEMPTS = 60, 600, 5


def scan_stream(urls: DataFrame, url: str = "url") -> DataFrame:
    """The URL scan of a stream: the batch transform, unchanged."""
    return scan_urls(urls, url)


def verdict_windows(scored: DataFrame, ts: str = "ts", size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Verdicts in tumbling or sliding windows; rows later than the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return scored.withWatermark(ts, late).groupBy(w.alias("w"), "verdict").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "verdict", "n")


def sessions(scored: DataFrame, key: str, ts: str = "ts", gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    return scored.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def within(left: DataFrame, right: DataFrame, key: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Stream-stream join on ``key`` of rows whose times (``ts`` and ``scanned_at``) lie within a bound."""
    a, b = left.withWatermark("ts", late), right.withColumnRenamed(key, "__k").withWatermark("scanned_at", late)
    return a.join(b, F.expr(f"{key} = __k AND scanned_at BETWEEN ts AND ts + INTERVAL {seconds} SECONDS")).drop("__k")


def distinct_stream(df: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def _processor(handle_rows):
    """Keeps ``(since, n)`` for each key. ``handle_rows(state, key, rows)`` gives rows, the new state (or none) and the second from which on it says nothing any more; when the watermark passes that, the state goes."""
    from pyspark.sql.streaming import StatefulProcessor

    class Keyed(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("last", "since double, n long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            was = self.state.get() if self.state.exists() else None
            out, state, until = handle_rows(was, key[0], pd.concat(list(rows)).sort_values("ts"))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if state is None:
                self.state.clear()
            else:
                self.state.update(state)
                self.handle.registerTimer(int(until * 1000))
            yield out

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.state.clear()
            return iter([])

        def close(self) -> None:
            pass

    return Keyed()


def cooldown_stream(alerts: DataFrame, seconds: int = COOLDOWN, late: str = "10 minutes") -> DataFrame:
    """At most one alert of a key within ``seconds`` of the last one emitted; state is one number for each key, dropped once the watermark is past its cooldown."""

    def rows(state, key, pdf: pd.DataFrame):
        last = state[0] if state else None
        out = []
        for t in pdf["ts"]:
            s = t.timestamp()
            if last is None or s - last >= seconds:
                out.append((key, t))
                last = s
        return pd.DataFrame(out, columns=["key", "ts"]), (last, 0), last + seconds

    return alerts.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_processor(rows), "key string, ts timestamp", "append", "eventTime")


def attempts_stream(attempts: DataFrame, limit: int = ATTEMPTS, ttl: int = TTL, late: str = "10 minutes") -> DataFrame:
    """Failures of each key and whether it is locked.

    A count begins with a key's first attempt and ends ``ttl`` seconds later or
    with a success; the next attempt begins another. From ``limit`` failures on
    the key is locked: further attempts are refused, right ones too, until the
    count ends.
    """

    def rows(state, key, pdf: pd.DataFrame):
        since, n = state or (None, 0)
        out = []
        for t, ok in zip(pdf["ts"], pdf["ok"], strict=True):
            s = t.timestamp()
            if since is None or s - since >= ttl:
                since, n = s, 0
            if n < limit:
                n = 0 if ok else n + 1
            out.append((key, t, n, n >= limit))
            if ok and n < limit:
                since = None
        return pd.DataFrame(out, columns=["key", "ts", "failures", "locked"]), None if since is None else (since, int(n)), None if since is None else since + ttl

    return attempts.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_processor(rows), "key string, ts timestamp, failures long, locked boolean", "append", "eventTime")


def _next_times(alerts: DataFrame, us: int) -> DataFrame:
    """``(key, t, nxt, start)``: each time of a key, the first one ``us`` or more after it, and whether none is less than ``us`` before it.

    Events are looked at in spans of ``us``, each with its neighbour, so no
    group holds all events of a key; only one row for each span is put in order.
    The first later time comes from a frame that grows from the latest event
    backwards, so that each row is looked at once.
    """
    times = alerts.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).filter("t is not null").distinct()
    return _next_of(times, us)


def _next_of(times: DataFrame, us: int) -> DataFrame:
    """``_next_times`` of different ``(key, t)``, ``t`` in microseconds."""
    times = times.withColumn("span", ((F.col("t") - F.pmod("t", F.lit(us))) / us).cast("long"))
    spans = times.groupBy("key", "span").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    of_key = W.partitionBy("key").orderBy("span")
    spans = spans.select("key", "span", F.lag("high").over(of_key).alias("before"), F.lead("low", 1).over(of_key).alias("low1"), F.lead("span", 1).over(of_key).alias("span1"), F.lead("low", 2).over(of_key).alias("low2"))
    both = times.select("key", "t", F.explode(F.array(F.col("span"), F.col("span") - 1)).alias("at"), "span").withColumn("back", -F.col("t"))
    of_span = W.partitionBy("key", "at").orderBy("back")
    near = both.select("key", "t", "span", "at", F.min("t").over(of_span.rangeBetween(W.unboundedPreceding, -us)).alias("near"), F.lead("t").over(of_span).alias("prev")).filter("span = at")
    e = met(near.drop("at"), spans, ["key", "span"])
    later = F.when(F.col("span1") == F.col("span") + 1, F.col("low2")).otherwise(F.col("low1"))
    prev = F.coalesce("prev", "before")
    return e.select("key", "t", F.coalesce("near", later).alias("nxt"), (prev.isNull() | (F.col("t") - prev >= us)).alias("start"))


def _reached(links: DataFrame) -> DataFrame:
    """``(key, at)`` of all places that starts lead to, for ``links (key, at, nxt, start)``, stored: pointers are doubled, so a chain of a million takes some twenty rounds."""
    marked = stored(links.filter("start").select("key", "at"))
    jumps = links.filter("nxt is not null").select("key", "at", "nxt")
    jumps = stored(met(jumps, marked.withColumnRenamed("at", "nxt"), ["key", "nxt"], "left_anti"))
    while not jumps.isEmpty():
        on = jumps.withColumnRenamed("nxt", "after")
        reached = met(marked, on, ["key", "at"]).select("key", F.col("after").alias("at"))
        marked = stored(marked.unionAll(reached).distinct())
        jumps = stored(met(jumps, on.withColumnRenamed("at", "nxt"), ["key", "nxt"]).select("key", "at", F.col("after").alias("nxt")))
    return marked


def cooldown(alerts: DataFrame, seconds: int = COOLDOWN) -> DataFrame:
    """Batch form: ``(key, ts)`` of the alerts that are emitted, without a group of all alerts of a key.

    An alert with none in the ``seconds`` before it is always emitted. Every
    alert points to the first one at or after its cooldown; what is reached from
    an emitted alert is emitted, marked by pointer doubling on stored tables.
    """
    if seconds <= 0:
        return alerts.filter("ts is not null").select("key", "ts")
    found = stored(_next_times(alerts, seconds * 1_000_000).withColumnRenamed("t", "at"))
    return _reached(found).select("key", F.timestamp_micros("at").cast(alerts.schema["ts"].dataType).alias("ts"))


def attempt_lock(attempts: DataFrame, limit: int = ATTEMPTS, ttl: int = TTL) -> DataFrame:
    """Batch form of ``attempts_stream``: ``(key, seq, ts, failures, locked)`` for ``attempts (key, seq, ts, ok)``.

    Attempts of one time are in the order of ``seq``. Null times come first, as
    of one time; a null ``ok`` is a failure. Where a count that began with an
    attempt would end is known for every attempt: behind the next success, if
    fewer than ``limit`` failures lie before it, or else at the first attempt
    ``ttl`` seconds later. Which attempts do begin a count is then a matter of
    following these pointers, by doubling. No task holds all attempts of a key.
    """
    us = ttl * 1_000_000
    rows = attempts.select("key", "seq", "ts", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 61))).alias("t"))
    placed = in_blocks(rows, "key", ["t", "seq", "ok"])
    success = F.when(F.col("ok"), F.struct("pos", "t"))
    back = W.partitionBy("key", "block").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    blocks_back = W.partitionBy("key").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    firsts = placed.groupBy("key", "block").agg(F.min(success).alias("first")).select("key", "block", F.last("first", True).over(blocks_back).alias("later"))
    ahead = met(placed.withColumn("own", F.last(success, True).over(back)), firsts, ["key", "block"]).withColumn("s", F.coalesce("own", "later"))
    # the first place of each time, and of the first time at which a count from here has expired
    at_time = placed.groupBy("key", "t").agg(F.min("pos").alias("first_pos"))
    times = met(_next_of(at_time.select("key", "t"), us), at_time, ["key", "t"])
    times = met(times, at_time.select("key", F.col("t").alias("nxt"), F.col("first_pos").alias("nxt_pos")), ["key", "nxt"], "left").drop("nxt")
    seen = met(ahead, times, ["key", "t"])
    ends = F.when((F.col("s.t") < F.col("t") + us) & (F.col("s.pos") - F.col("pos") < limit), F.col("s.pos") + 1).otherwise(F.col("nxt_pos"))
    links = seen.select("key", F.col("pos").alias("at"), ends.alias("nxt"), (F.col("start") & (F.col("pos") == F.col("first_pos"))).alias("start"))
    begun = _reached(stored(links)).select("key", F.col("at").alias("pos"), F.col("at").alias("begin"))
    counted = stored(met(placed, begun, ["key", "pos"], "left"))
    on = W.partitionBy("key", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    blocks_on = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    lasts = counted.groupBy("key", "block").agg(F.max("begin").alias("last")).select("key", "block", F.last("last", True).over(blocks_on).alias("earlier"))
    told = met(counted.withColumn("own", F.last("begin", True).over(on)), lasts, ["key", "block"])
    before = F.col("pos") - F.coalesce("own", "earlier")
    failures = F.when(F.col("ok") & (before < limit), 0).otherwise(F.least(before + 1, F.lit(limit))).cast("long")
    return told.select("key", "seq", "ts", failures.alias("failures"), (failures >= limit).alias("locked"))


def latest_open(challenges: DataFrame) -> DataFrame:
    """The latest challenge of each (email, purpose) that is not consumed; reduced in each task before the shuffle."""
    rest = [c for c in challenges.columns if c not in ("email", "purpose")]
    latest = F.max_by(F.struct(*rest), F.struct("created_at", "seq"))
    return challenges.filter("consumed_at is null").groupBy("email", "purpose").agg(latest.alias("c")).select("email", "purpose", "c.*").select(*challenges.columns)
