"""The stateful stream against the batch rule, on shuffled and late input and across a restart."""

import random

from waymark.streaming.recordings import recordings, recordings_of

SCHEMA = "track_id string, ts timestamp, seq int, lat double, lon double"
T0 = 1_716_624_000


def walk(rng, track, n, start):
    """Points of one track: walking, standing, and now and then a pause that ends a recording."""
    t, lat, out = start, 43.0, []
    for k in range(n):
        t += rng.choice([1, 2, 5]) if rng.random() < 0.96 else 200
        lat += rng.choice([0, 0, 4, 6, 9]) * 1e-5
        out.append((track, t, k, lat, 42.0))
    return out


def rounded(rows):
    none = lambda x: None if x is None or x != x else round(x, 5)
    return sorted((r.track_id, r.start_ms, r.end_ms, r.n_points, none(r.distance_m), none(r.moving_s), none(r.max_kmh)) for r in rows)


def write(spark, rows, path, k):
    df = spark.createDataFrame([(a, t, s, y, x) for a, t, s, y, x in rows], "track_id string, t long, seq int, lat double, lon double")
    df.selectExpr("track_id", "timestamp_seconds(t) AS ts", "seq", "lat", "lon").coalesce(1).write.parquet(f"{path}/in/k={k}")


def run(spark, path, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    out = recordings(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return rounded(spark.read.parquet(f"{path}/out").collect())


def test_stream_equals_batch_when_shuffled_late_and_restarted(spark, tmp_path):
    rng = random.Random(4)
    rows = [p for j in range(4) for p in walk(rng, f"t{j}", 120, T0 + 50 * j)]
    arrival = sorted(rows, key=lambda p: p[1] + rng.uniform(0, 300))  # up to five minutes out of order
    parts = [arrival[i : i + 60] for i in range(0, len(arrival), 60)]
    end = [("end", max(p[1] for p in rows) + 4000, 0, 43.0, 42.0)]  # moves the watermark past all recordings
    too_late = [("t0", T0 - 9000, -1, 50.0, 42.0), ("t9", T0 - 9000, -1, 50.0, 42.0)]
    for k, part in enumerate(parts[:4]):
        write(spark, part, tmp_path, k)
    before = run(spark, tmp_path, "first")
    for k, part in enumerate(parts[4:] + [end, too_late, end], 4):
        write(spark, part, tmp_path, k)
    after = run(spark, tmp_path, "second")  # goes on from the checkpoint
    batch = spark.createDataFrame([(a, t * 1000, s, y, x) for a, t, s, y, x in rows], "track_id string, ts_ms long, seq int, lat double, lon double")
    want = rounded(recordings_of(batch).collect())
    assert len(want) > 10
    assert set(before) < set(want)
    assert after == want
