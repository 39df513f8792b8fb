"""Progress of long runs, from the lines of their logs.

The lines are the only unbounded input.  Each line becomes at most one event by
native expressions; the events of a run are folded into its latest state, in
batch by windows and in a stream by arbitrary state per run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

# Stages of a run and the share of its progress that each takes, as (from, to) percent.
STAGES = {"parse": (0.0, 65.0), "repair": (65.0, 75.0), "layout": (75.0, 85.0), "render": (85.0, 90.0), "validate": (90.0, 93.0), "image_render": (93.0, 95.0), "image_validate": (95.0, 98.0), "qc": (98.0, 98.0)}
LOG_CHARS = 400_000
EVENT_SCHEMA = "run_id string, seq bigint, stage string, done int, total int, status string"


def clean_line(line: Column) -> Column:
    """A line without terminal colours and carriage returns."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"\x1b\[[0-9;?]*[A-Za-z]", ""), r"\r", "\n"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """(run_id, seq, stage, done, total, status): the events in log lines of (run_id, seq, line); other lines give nulls."""
    t = clean_line(F.col("line"))
    stage = F.lower(F.regexp_extract(t, r"(?i)^(?:\[[^\]]*\]\s*)?(image[_ ]render|image[_ ]validate|parse|repair|layout|render|validate|qc)\b", 1))
    count = r"(\d+)\s*/\s*(\d+)"
    status = F.when(t.rlike(r"(?i)\b(?:completed|finished)\b"), "completed").when(t.rlike(r"(?i)\bskipp(?:ed|ing)\b"), "skipped").when(t.rlike(r"(?i)\b(?:failed|error)\b"), "failed").when(t.rlike(r"(?i)\b(?:started|processing)\b"), "running")
    return lines.select("run_id", "seq", F.nullif(F.regexp_replace(stage, " ", "_"), F.lit("")).alias("stage"), F.nullif(F.regexp_extract(t, count, 1), F.lit("")).cast("int").alias("done"), F.nullif(F.regexp_extract(t, count, 2), F.lit("")).cast("int").alias("total"), status.alias("status"))


def percent(stage: Column, done: Column, total: Column) -> Column:
    """The progress of an event within its stage, to one decimal (halves to the even one); null without a stage."""
    out = F.lit(None).cast("double")
    share = F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(0.0)
    for name, (low, high) in STAGES.items():
        out = F.when(stage == name, F.lit(low) + (high - low) * share).otherwise(out)
    return F.bround(out, 1)


def running_progress(events: DataFrame) -> DataFrame:
    """The events with the state so far: percent never falls, stage and status stay until the next."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("status").isin("completed", "skipped"), 100.0).otherwise(percent(F.col("stage"), F.col("done"), F.col("total")))
    return events.withColumn("_p", own).select("run_id", "seq", F.last("stage", ignorenulls=True).over(w).alias("stage"), F.last("status", ignorenulls=True).over(w).alias("status"), F.coalesce(F.max("_p").over(w), F.lit(0.0)).alias("percent"))


def idle_gaps(ticks: DataFrame, key: str, when: str, seconds: int) -> DataFrame:
    """(key, from_ts, to_ts, gap_seconds): silences of at least so many seconds between the ticks of a key."""
    w = Window.partitionBy(key).orderBy(when)
    gap = F.unix_timestamp(when) - F.unix_timestamp(F.lag(when).over(w))
    return ticks.select(key, F.lag(when).over(w).alias("from_ts"), F.col(when).alias("to_ts"), gap.alias("gap_seconds")).filter(F.col("gap_seconds") >= seconds)


def fold_stream(lines: DataFrame, idle_ms: int = 1_800_000) -> DataFrame:
    """The latest state of each run of a stream of (run_id, seq, line); a run that stays silent is reported as idle.

    The state of a run is three values, whatever the length of its log.
    """
    parsed = parse_lines(lines)
    events = parsed.withColumn("p", F.when(F.col("status").isin("completed", "skipped"), 100.0).otherwise(percent(F.col("stage"), F.col("done"), F.col("total")))).select("run_id", "seq", "stage", "status", "p")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            stage, status, best, last = state.get
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "seq": [last], "stage": [stage], "status": ["idle"], "percent": [best]})
            return
        stage, status, best, last = state.get if state.exists else (None, None, 0.0, -1)
        for batch in batches:
            for r in batch.sort_values("seq").itertuples():
                if r.seq <= last:
                    continue  # a line that was read before
                last = int(r.seq)
                stage = r.stage if isinstance(r.stage, str) else stage
                status = r.status if isinstance(r.status, str) else status
                best = max(best, float(r.p)) if r.p == r.p and r.p is not None else best
        state.update((stage, status, best, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"run_id": [key[0]], "seq": [last], "stage": [stage], "status": [status], "percent": [best]})

    return events.groupBy("run_id").applyInPandasWithState(step, "run_id string, seq bigint, stage string, status string, percent double", "stage string, status string, best double, last bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)


def log_since(lines: DataFrame, offset: int, kept: int = LOG_CHARS) -> DataFrame:
    """(run_id, offset, text): what a reader at *offset* has not seen; an offset that is no longer kept starts over."""
    w = Window.partitionBy("run_id").orderBy("seq")
    at = lines.withColumn("stop", F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sized = at.withColumn("all", F.max("stop").over(Window.partitionBy("run_id")))
    first = F.greatest(F.lit(0), F.col("all") - kept)
    start = F.when(F.lit(offset) < first, first).otherwise(F.lit(offset))
    return sized.filter(F.col("stop") > start).groupBy("run_id").agg(F.max("all").alias("offset"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("text"))
