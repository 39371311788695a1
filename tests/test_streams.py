"""Streams give what batches give."""

import datetime as dt
import os
import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from threatscan.operators import urls as U
from threatscan.streaming import feeds

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def stream(spark, tmp_path, rows, schema, name="in"):
    path = str(tmp_path / name)
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/b={i}")
        for f in Path(f"{path}/b={i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 10 * i,) * 2)  # files are taken in the order of their times
    return spark.readStream.schema(spark.createDataFrame(rows[0], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_scan_is_the_batch_scan(spark, tmp_path):
    urls = [("http://paypa1.com/login",), ("https://google.com",), ("web-trezorr-login-x-en.pages.dev",)]
    got = drain(feeds.scan_stream(stream(spark, tmp_path, [urls[:1], urls[1:]], "url string")).select("url", "score", "verdict"), tmp_path, "scan")
    want = U.scan_urls(spark.createDataFrame(urls, "url string")).select("url", "score", "verdict")
    assert sorted(got.collect()) == sorted(want.collect())


def test_windows_and_late_rows(spark, tmp_path):
    rows = [[(at(0), "Safe"), (at(30), "Phishing")], [(at(4000), "Safe")], [(at(4001), "Safe")], [(at(10), "Safe")], [(at(9000), "Safe")]]
    got = drain(feeds.verdict_windows(stream(spark, tmp_path, rows, "ts timestamp, verdict string")), tmp_path, "win")
    counts = {(r.start.replace(tzinfo=None), r.verdict): r.n for r in got.collect()}
    assert counts[(T0.replace(tzinfo=None), "Safe")] == 1  # the row at 10 s came after the watermark
    assert counts[(T0.replace(tzinfo=None), "Phishing")] == 1


def test_cooldown_is_the_batch_cooldown(spark, tmp_path):
    rows = [("a", at(s)) for s in (0, 30, 59, 60, 100, 119, 121, 300)] + [("b", at(5))]
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    batch = sorted((r.key, r.ts) for r in feeds.cooldown(df).collect())
    assert [k for k, _ in batch].count("a") == 4
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = drain(feeds.cooldown_stream(stream(spark, tmp_path, [rows[:4], rows[4:]], "key string, ts timestamp")), tmp_path, "cool")
    assert sorted((r.key, r.ts) for r in got.collect()) == batch


def brute_attempts(rows, limit=feeds.ATTEMPTS, ttl=feeds.TTL):
    """seq -> (failures, locked), one attempt after the other."""
    out, state = {}, {}
    for key, seq, ts, ok in sorted(rows, key=lambda r: (r[0] or "", r[2], r[1])):
        since, n = state.get(key, (None, 0))
        if since is None or (ts - since).total_seconds() >= ttl:
            since, n = ts, 0
        if n < limit:
            n = 0 if ok else n + 1
        out[seq] = (n, n >= limit)
        state[key] = (None, 0) if ok and n < limit else (since, n)
    return out


def test_attempt_limit(spark, tmp_path):
    rows = [("a", i, at(i), i == 2) for i in range(9)] + [("a", 9, at(9), True), ("a", 10, at(602), True), ("a", 11, at(603), False)]
    df = spark.createDataFrame(rows, "key string, seq long, ts timestamp, ok boolean")
    got = {r.seq: (r.failures, r.locked) for r in feeds.attempt_lock(df).collect()}
    assert got[1] == (2, False) and got[2] == (0, False) and got[3] == (1, False)  # a success begins anew
    assert got[6] == (4, False) and got[7] == (5, True) and got[8] == (5, True) and got[9] == (5, True)  # locked: a right one is refused
    assert got[10] == (5, True) and got[11] == (1, False)  # the count that began at 3 s has ended
    assert got == brute_attempts(rows)
    days = [("a", i, at(86400 * i), False) for i in range(8)]
    assert {r.failures for r in feeds.attempt_lock(spark.createDataFrame(days, "key string, seq long, ts timestamp, ok boolean")).collect()} == {1}


def test_join_within_and_distinct(spark):
    a = spark.createDataFrame([("u", at(0)), ("v", at(0))], "url string, ts timestamp")
    b = spark.createDataFrame([("u", at(50), 9), ("v", at(500), 1)], "url string, scanned_at timestamp, score int")
    assert [r.url for r in feeds.within(a, b, "url", 60).collect()] == ["u"]


def test_distinct_stream(spark, tmp_path):
    rows = [[("u", at(0)), ("u", at(1))], [("u", at(2)), ("w", at(3))]]
    got = drain(feeds.distinct_stream(stream(spark, tmp_path, rows, "url string, ts timestamp"), ["url"]), tmp_path, "dist")
    assert sorted(r.url for r in got.select("url").collect()) == ["u", "w"]


def test_cooldown_gathers_no_key(spark):
    rng = random.Random(4)
    rows = [(k, at(s)) for k, n in (("hot", 900), ("a", 40), (None, 30)) for s in (rng.randrange(6000) for _ in range(n))] + [("a", None)]
    df = spark.createDataFrame(rows + [("a", at(10**6)), ("a", at(10**6 + 60))], "key string, ts timestamp")
    want, last = [], {}
    for key, ts in sorted(((r.key or "", r.ts) for r in df.filter("ts is not null").collect())):
        if key not in last or (ts - last[key]).total_seconds() >= 60:
            want.append((key, ts))
            last[key] = ts
    got = feeds.cooldown(df, 60)
    assert sorted((r.key or "", r.ts) for r in got.collect()) == want
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert "collect_list" not in feeds._next_times(df, 60_000_000)._jdf.queryExecution().toString()


def test_attempts_stream_counts_and_expires(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    a = [("a", at(s), False) for s in (0, 10, 20)] + [("b", at(5), True)]
    b = [("a", at(30), True), ("a", at(40), False), ("a", at(50), False)]
    c = [("a", at(700), False), ("b", at(5000), False)]
    d = [("a", at(9000), False), ("b", at(9001), False)]  # by now the watermark has passed both counts
    got = drain(feeds.attempts_stream(stream(spark, tmp_path, [a, b, c, d], "key string, ts timestamp, ok boolean")), tmp_path, "attempts").collect()
    seen = {(r.key, int(r.ts.timestamp() - T0.replace(tzinfo=None).timestamp())): (r.failures, r.locked) for r in got}
    assert {s: v for (k, s), v in seen.items() if k == "a"} == {0: (1, False), 10: (2, False), 20: (3, False), 30: (0, False), 40: (1, False), 50: (2, False), 700: (1, False), 9000: (1, False)}
    assert {s: v for (k, s), v in seen.items() if k == "b"} == {5: (0, False), 5000: (1, False), 9001: (1, False)}


def test_batch_attempts_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, at(rng.randrange(0, 9_000)), rng.random() < 0.2) for i in range(500)]
    rows += [("hot", 1000 + i, at(i * 2 % 700), rng.random() < 0.05) for i in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "key string, seq long, ts timestamp, ok boolean")
        assert feeds.in_blocks(df, "key", ["ts"]).filter("key = 'hot'").select("block").distinct().count() > 1
        got = {r.seq: (r.failures, r.locked) for r in feeds.attempt_lock(df, ttl=300).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_attempts(rows, ttl=300)
    assert got == want and any(x for _, x in want.values())
    odd = spark.createDataFrame([("a", 1, None, None), ("a", 2, None, True), ("a", 3, at(0), False)], "key string, seq long, ts timestamp, ok boolean")
    assert {r.seq: r.failures for r in feeds.attempt_lock(odd).collect()} == {1: 1, 2: 0, 3: 1}
    assert feeds.attempt_lock(odd.limit(0)).count() == 0


def test_attempts_batch_is_the_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(8)
    moments = sorted(rng.sample(range(4000), 90))
    rows = [(rng.choice("ab"), i, at(s), rng.random() < 0.2) for i, s in enumerate(moments)]
    plain = [(k, t, ok) for k, _, t, ok in rows]
    got = drain(feeds.attempts_stream(stream(spark, tmp_path, [plain[:30], plain[30:60], plain[60:]], "key string, ts timestamp, ok boolean")), tmp_path, "both").collect()
    batch = feeds.attempt_lock(spark.createDataFrame(rows, "key string, seq long, ts timestamp, ok boolean")).collect()
    assert sorted((r.key, r.ts, r.failures, r.locked) for r in got) == sorted((r.key, r.ts, r.failures, r.locked) for r in batch)


def test_cooldown_of_a_dense_key_is_near_linear(spark):
    """40,000 alerts of one key within two minutes: each is looked at once."""
    df = spark.range(40_000).select(F.lit("k").alias("key"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 2750).alias("ts"))
    began = time.time()
    assert feeds.cooldown(df, 60).count() == 2
    assert time.time() - began < 20
