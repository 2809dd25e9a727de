from emberline.streaming import rules as streaming
from pyspark.sql import functions as F

from test_operators import events


def test_rules_on_a_stream(spark, tmp_path):
    rows = [(1, 0, "browser", "file_download", None, r"C:\d\a.exe"), (2, 60, "prefetch", "process_execution", "A.EXE", None), (3, 90, "prefetch", "process_execution", "a.exe", None), (4, 100, "defender", "malware_detection", "x", None)]
    batch = events(spark, rows).withColumns({n: F.lit(None).cast("string") for n in ("command_line", "script_name", "host_application")})
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, df in (("findings", streaming.findings(stream)), ("pairs", streaming.executions_after_downloads(stream))):
        df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start(str(tmp_path / name)).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "findings")).collect()
    assert sorted(r.rule_name for r in found) == ["browser_activity", "defender_detection"]
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    assert pairs.count() == 2
    assert [r.execution_id for r in streaming.first_executions(pairs).collect()] == ["e2"]


def test_first_executions_as_state(spark, tmp_path):
    day = 86_400
    rows = [
        (1, 0, "browser", "file_download", None, r"C:\d\a.exe"),
        (2, 90, "prefetch", "process_execution", "a.exe", None),
        (3, 60, "prefetch", "process_execution", "A.EXE", None),  # earlier, though it comes later
        (4, 70, "browser", "file_download", None, r"C:\d\a.exe"),
        (5, 0, "browser", "file_download", None, r"C:\d\b.exe"),
        (6, 8 * day, "prefetch", "process_execution", "b.exe", None),  # a week is over
        (7, 9 * day, "browser", "file_download", None, r"C:\d\c.exe"),
        (8, 9 * day + 5, "prefetch", "process_execution", "c.exe", None),
        (9, 30 * day, "defender", "malware_detection", "x", None),
        (10, 30 * day, "prefetch", "process_execution", "z.exe", None),
    ]
    batch = events(spark, rows).withColumns({n: F.lit(None).cast("string") for n in ("command_line", "script_name", "host_application")})
    for i in range(5):  # a file, and so a batch, at a time
        batch.where(F.substring("event_id", 2, 9).cast("int").isin(2 * i + 1, 2 * i + 2)).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = streaming.first_executions_after_downloads(stream, late="1 day")
    found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r.download_id: r.execution_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"e1": "e3", "e4": "e2", "e7": "e8"}


def test_settling_equals_a_plain_search():
    import random

    rng = random.Random(4)
    for _ in range(200):
        downloads = [(rng.randrange(50), f"d{i}") for i in range(rng.randrange(6))]
        runs = [(rng.randrange(50), i, f"r{i}") for i in range(rng.randrange(6))]
        window, seen, open_d, open_r = 9, [], [], []
        for now in sorted(rng.sample(range(1, 60), 4)) + [100]:
            open_d += [d for d in downloads if d[0] < now and d not in open_d and (d[0] >= (seen[-1][0] if seen else 0))]
            open_r += [r for r in runs if r[0] < now and r not in open_r and (r[0] >= (seen[-1][0] if seen else 0))]
            pairs, open_d, open_r = streaming.settled(open_d, open_r, now, window)
            seen.append((now, pairs))
        got = sorted((d, r) for _, pairs in seen for d, r in pairs)
        best = [(d, min(fit)) for d in downloads if (fit := [r for r in runs if d[0] <= r[0] <= d[0] + window])]
        assert got == sorted(best)
        assert not open_d and not open_r
