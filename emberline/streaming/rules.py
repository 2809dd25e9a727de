"""Correlation rules over Structured Streaming sources.

Rules of one event are stateless projections, so they run on a stream as they are. A download and the
execution that follows it come in two forms. :func:`executions_after_downloads` is a stream-stream join that
reports every execution in the window. :func:`first_executions_after_downloads` keeps a state for each
file name and reports the earliest one only, once the watermark has passed it and nothing earlier can come.

Streamed events carry ``tl_pos`` (any number that grows with arrival, such as the source's offset)
and ``entity_id``; ``timestamp`` is the event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberline.functions import columns as C
from emberline.operators import rules


def findings(events: DataFrame) -> DataFrame:
    """The findings of all rules of one event, as a stream."""
    return rules.run_rules(events, rules.EVENT_RULES)


PREFETCH_RUN = "(artifact_type = 'prefetch' AND event_type = 'process_execution')"
PIPELINE_RUN = "(artifact_type = 'evtx' AND event_type = 'powershell_pipeline_execution')"
IS_RUN = f"{PREFETCH_RUN} OR {PIPELINE_RUN}"
IS_DOWNLOAD = "artifact_type = 'browser' AND event_type = 'file_download'"


def _named(events: DataFrame, late: str) -> DataFrame:
    return events.withColumns({"file": C.best_identity("object_name", "object_path"), "at": F.col("timestamp").cast("timestamp")}).withWatermark("at", late)


def executions_after_downloads(events: DataFrame, days: int = rules.WINDOW_DAYS, late: str = "1 hour") -> DataFrame:
    """download_id, execution_id, file, downloaded, executed, tl_pos of the execution, for every execution in the window."""
    named = _named(events, late)
    downloads = named.where(IS_DOWNLOAD).select(F.col("event_id").alias("download_id"), F.col("file").alias("name"), F.col("at").alias("downloaded"))
    runs = named.where(IS_RUN).select(F.col("event_id").alias("execution_id"), "file", F.col("at").alias("executed"), "tl_pos")
    return downloads.join(runs, F.expr(f"name = file AND executed >= downloaded AND executed <= downloaded + interval {days} days")).drop("name")


def settled(downloads: list[tuple], runs: list[tuple], now: int, window: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Pairs that nothing can change any more, and the downloads and runs that are still open.

    Downloads are (time, id), runs (time, tl_pos, id); no event before ``now`` can come any more. A run up to then
    settles all open downloads before it, so neither is needed longer; nor is a download whose window has passed.
    """
    pairs, open_ = [], sorted(downloads)
    for run in sorted(runs):
        if run[0] >= now:
            break
        pairs += [(d, run) for d in open_ if d[0] <= run[0] <= d[0] + window]
        open_ = [d for d in open_ if d[0] > run[0]]
    return pairs, [d for d in open_ if d[0] + window >= now], [r for r in runs if r[0] >= now]


FIRST = "download_id string, execution_id string, file string, downloaded timestamp, executed timestamp"
STATE = "d_at array<long>, d_id array<string>, r_at array<long>, r_pos array<long>, r_id array<string>"


def first_executions_after_downloads(events: DataFrame, days: int = rules.WINDOW_DAYS, late: str = "1 hour") -> DataFrame:
    """download_id, execution_id, file, downloaded, executed: the earliest execution of each download, as soon as it is sure.

    For each file name the state holds downloads that wait, and runs of the last ``late`` only.
    """
    window = days * 86_400_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d_at, d_id, r_at, r_pos, r_id = (list(x) for x in state.get) if state.exists else ([], [], [], [], [])
        downloads, runs = list(zip(d_at, d_id, strict=True)), list(zip(r_at, r_pos, r_id, strict=True))
        for batch in batches:
            for run, at, pos, name in zip(batch["run"], batch["micros"], batch["tl_pos"], batch["event_id"], strict=True):
                (runs.append((int(at), int(pos), name)) if run else downloads.append((int(at), name)))
        now = state.getCurrentWatermarkMs() * 1000
        pairs, downloads, runs = settled(downloads, runs, now, window)
        if downloads or runs:
            state.update(([d[0] for d in downloads], [d[1] for d in downloads], [r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs]))
            next_ = min([r[0] for r in runs] + [d[0] + window for d in downloads])
            state.setTimeoutTimestamp(max(next_ // 1000, now // 1000) + 1)
        else:
            state.remove()
        if pairs:
            rows = [(d[1], r[2], key[0], pd.Timestamp(d[0], unit="us"), pd.Timestamp(r[0], unit="us")) for d, r in pairs]
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in FIRST.split(", ")])

    rows = _named(events, late).where(f"file IS NOT NULL AND ({IS_DOWNLOAD} OR {IS_RUN})")
    told = rows.select("file", "at", F.unix_micros("at").alias("micros"), F.expr(IS_RUN).alias("run"), F.col("tl_pos").cast("long").alias("tl_pos"), "event_id")
    return told.groupBy("file").applyInPandasWithState(step, FIRST, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_executions(written: DataFrame) -> DataFrame:
    """The earliest execution of each download."""
    row = F.struct("execution_id", "file", "downloaded", "executed")
    return written.groupBy("download_id").agg(F.min_by(row, F.struct("executed", "tl_pos")).alias("r")).select("download_id", "r.*")
