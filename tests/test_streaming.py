import os
import random

from pyspark.sql import functions as F

from docmarket.sources import listings as L
from docmarket.streaming import jobs as O


def landed(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 8} {i % 8 * 3:02d}:00:00", f"k{i % 5}", "t" + str(i % 3), float(i)) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, d string, key string, term string, value double").select("id", F.col("d").cast("timestamp").alias("ts"), "key", "term", "value")
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in"))


def drain(spark, df, tmp_path, mode="append"):
    job = df.writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


def test_demand_stream_agrees_with_batch(spark, tmp_path):
    batch = landed(spark, tmp_path)
    args = ("ts", "term", F.lit("jobicy"), F.col("value"))
    want = {(r["window_start"], r["term"], r["mentions"], r["weighted"]) for r in O.demand_over_time(batch, *args).collect()}
    stream = O.read_landed(spark, str(tmp_path / "in"), batch.schema)
    got = {(r["window_start"], r["term"], r["mentions"], r["weighted"]) for r in drain(spark, O.demand_over_time(stream, *args), tmp_path).collect()}
    # windows the watermark has not closed yet are still open
    last = batch.agg(F.max("ts")).first()[0]
    closed = {w for w in want if (last - w[0]).total_seconds() >= (6 + 6) * 3600}
    assert closed <= got <= want and closed


def test_dedupe_stream_keeps_first(spark, tmp_path):
    batch = landed(spark, tmp_path)
    stream = O.read_landed(spark, str(tmp_path / "in"), batch.schema)
    got = drain(spark, O.dedupe_stream(stream, "key", "ts"), tmp_path)
    assert sorted(r["key"] for r in got.collect()) == [f"k{i}" for i in range(5)]


ATTEMPTS = "ts timestamp, source string, query string, status string, error string, result_count int, elapsed_ms double"


def attempts(rng, n, first_hour, hours):
    rows = []
    for _ in range(n):
        hour = first_hour + rng.random() * hours
        day, rest = divmod(hour * 3600, 86400)
        ts = f"2024-01-{1 + int(day):02d} {int(rest // 3600):02d}:{int(rest % 3600 // 60):02d}:{int(rest % 60):02d}"
        rows.append((ts, rng.choice("ab"), f"q{rng.randrange(3000)}", rng.choice(["success", "failed"]), rng.choice(["", "Read Timeout", "http 500", None]), rng.randrange(9), rng.random() * 10 - 2))
    return rows


def land(spark, folder, rows, number):
    """One file, dated by its number, so the stream reads them in this order."""
    part = folder.parent / f"part{number}"
    spark.createDataFrame(rows, ATTEMPTS.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(part))
    folder.mkdir(exist_ok=True)
    (file,) = part.glob("*.parquet")
    data = file.read_bytes()
    out = folder / f"{number}.parquet"
    out.write_bytes(data)
    os.utime(out, (1_700_000_000 + number, 1_700_000_000 + number))


def test_attempt_stream_agrees_with_batch_over_several_files(spark, tmp_path):
    rng = random.Random(9)
    kept = []
    for number in range(4):
        rows = attempts(rng, 1500, 12 * number, 12)
        land(spark, tmp_path / "in", rows, number)
        kept += rows
    late = [("2024-01-01 01:00:00", "a", "late", "success", "", 1, 1.0)]
    land(spark, tmp_path / "in", late, 4)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = O.read_landed(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    got = drain(spark, O.attempt_rollup_stream(stream), tmp_path)
    # Batch twin over all that was in time: the late row belongs to a window the watermark had closed.
    batch = spark.createDataFrame(kept, ATTEMPTS.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    plain = ("window_start", "source", "requests", "successes", "errors", "timeouts", "raw_returned", "max_elapsed_ms", "queries")
    want = {tuple(r) for r in O.attempt_rollup_stream(batch).select(*plain).collect()}
    seen = {tuple(r) for r in got.select(*plain).collect()}
    assert seen <= want and len(seen) >= 2 * 6  # 48 hours less the watermark's delay
    exact = {(r["w"]["start"], r["source"]): r["n"] for r in batch.groupBy(F.window("ts", O.DEMAND_WINDOW).alias("w"), "source").agg(F.countDistinct("query").alias("n")).collect()}
    assert all(abs(r[-1] - exact[r[0], r[1]]) <= 0.03 * exact[r[0], r[1]] for r in want)
    # Sketches merge: a query in many windows counts once.
    totals = {r["source"]: r for r in O.attempt_totals(O.attempt_rollup_stream(batch)).collect()}
    for source, n in batch.groupBy("source").agg(F.countDistinct("query")).collect():
        assert abs(totals[source]["queries"] - n) <= 0.03 * n
        assert totals[source]["requests"] == batch.filter(F.col("source") == source).count()


def test_ingest_touches_only_its_buckets(spark, tmp_path):
    fields = "ts timestamp, event_id int, source string, external_id string, value double"
    rows = [(f"2024-01-0{1 + i // 40} 00:{i % 40:02d}:00", i, "s", f"k{i * 7 % 30}", float(i)) for i in range(120)]
    frame = lambda part: spark.createDataFrame(part, fields.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    key = ["source", "external_id"]

    def merge(before, batch):
        return L.upsert_listings(before, batch.withColumn("arrival", F.col("event_id")), F.col("ts"), ["event_id"], key=key).select(*schema.names)

    empty = frame(rows).limit(0)
    schema = L.upsert_listings(empty, empty.withColumn("arrival", F.col("event_id")), F.col("ts"), ["event_id"], key=key).schema

    def ingest():
        stream = O.read_landed(spark, str(tmp_path / "in"), empty.schema, files_per_batch=1)
        O.ingest_listings_stream(stream, str(tmp_path / "table"), str(tmp_path / "cp"), schema, merge, key, buckets=8).awaitTermination()
        return {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "table").glob("bucket=*")}

    frame(rows[:60]).coalesce(1).write.parquet(str(tmp_path / "in"))
    before = ingest()
    frame(rows[60:]).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    ingest()
    one = [("2024-01-09 00:00:00", 500, "s", "k3", -1.0)]
    after = ingest()
    frame(one).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = ingest()
    assert len(before) > 1 and sum(after[b] != last[b] for b in after) == 1  # one key, one bucket rewritten
    got = {r["external_id"]: (r["event_id"], r["value"], r["created_at"], r["last_seen_at"]) for r in spark.read.schema(schema).parquet(str(tmp_path / "table")).collect()}
    want = {}
    for r in frame(rows + one).orderBy("ts", "event_id").collect():
        want[r["external_id"]] = (r["event_id"], r["value"], want.get(r["external_id"], (0, 0, r["ts"]))[2], r["ts"])
    assert got == want
