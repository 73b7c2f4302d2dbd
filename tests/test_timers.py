"""Alarms of rows in any order against the rules in plain Python."""

import random
from datetime import datetime, timedelta, timezone

from orbweave.streaming import timers

SCHEMA = "u string, at timestamp, n long, v double"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(rows, threshold, k, idle):
    out, state = set(), {}
    for u, at, n, v in sorted(rows, key=lambda r: r[1:3]):
        seen, run, done, last = state.get(u, (0, 0, False, None))
        if last is not None and (at - last).total_seconds() > idle:
            seen, run, done = 0, 0, False
        seen, run = seen + 1, run + 1 if v is not None and v > threshold else 0
        if run >= k and not done:
            done = True
            out.add((u, seen, at))
        state[u] = seen, run, done, at
    return out


def run(spark, batches, folder, late, idle):
    source, out = folder / "in", folder / "out"
    source.mkdir()
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"b{number}"))
        (part,) = (source / f"b{number}").glob("*.parquet")
        (folder / "all").mkdir(exist_ok=True)
        part.rename(folder / "all" / f"{number}.parquet")
    fresh = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "all"))
    alarms = timers.ordered_alarms(fresh, "u", "at", "n", "v", 5.0, 3, late, idle)
    with timers.rocksdb(spark):
        started = alarms.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
        started.awaitTermination()
    state = started.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    return {(r.u, r.fire, r.at.replace(tzinfo=timezone.utc)) for r in spark.read.schema(alarms.schema).parquet(str(out)).collect()}, state


def test_any_order_within_the_watermark(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for u in "abc":
        at = START
        for n in range(40):
            at += timedelta(minutes=rng.choice([0, 1, 3, 5, 200]))
            rows.append((u, at, n, rng.choice([None, 4.0, 6.0, 7.0, 8.0])))
    moved = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, 90)))
    size = len(moved) // 3 + 1
    batches = [moved[n : n + size] for n in range(0, len(moved), size)]
    end = [("z", START + timedelta(days=400), 0, 1.0)]
    got, _ = run(spark, [*batches, end], tmp_path, "90 minutes", 3600.0)
    assert got == plain(rows, 5.0, 3, 3600.0) and len(got) > 3


def test_late_rows_go_and_idle_series_leave(spark, tmp_path):
    minute = lambda n: START + timedelta(minutes=n)
    first = [("a", minute(n), n, 9.0) for n in (0, 1)]
    ahead = [[("b", minute(300), 0, 1.0)], [("b", minute(301), 1, 1.0)]]  # the first moves the watermark, the next batch releases what it has passed
    late = [("a", minute(2), 2, 9.0), ("a", minute(299), 3, 9.0)]
    end = [("b", minute(9000), 2, 1.0)]
    got, state = run(spark, [first, *ahead, late, end], tmp_path, "30 minutes", 600.0)
    assert got == set()  # the third of the run came after the watermark; what followed begins anew
    assert state <= 4  # of b alone; a is gone
