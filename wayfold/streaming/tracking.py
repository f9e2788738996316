"""Filters over a stream of fixes: one state per source, the same results as in batch.

A source's fixes must come in order of time. Within a batch they are sorted; a fix that is not later than the last one
filtered is dropped and counted (``late``). The state of a source has a fixed number of particles. With a time-out, the
state of a source that stays silent goes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.filters import RESULT, Tracker, frame, nullable, source_ids, source_number
from wayfold.operators.fleet import Fleet
from wayfold.operators.network import RoadNetwork
from wayfold.params import TrackingParameters

STATE = "tracker binary, last_us long, records int, late long"
#: Groups of sources that bootstrap filters without a time-out are kept in, and their state.
GROUPS, GROUP_STATE = 256, "fleet binary, last binary"


def track_stream(fixes: DataFrame, network: RoadNetwork, params: TrackingParameters, method: str = "pl", silence: str | None = None) -> DataFrame:
    """A stream with source_id, ts (timestamp), x, y as a stream of source_id and `RESULT` rows with ``late``, the source's
    late fixes so far. ``silence``: time-out in milliseconds of processing time. Bootstrap filters without a time-out keep
    the state of a group of sources together and work on all of them at once."""
    sent = fixes.sparkSession.sparkContext.broadcast(network.compact())  # at most BROADCAST_SEGMENTS segments
    thin = fixes.select("source_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "x", "y")
    schema = f"source_id {dict(fixes.dtypes)['source_id']}, {RESULT}, late long"
    if method == "bootstrap" and not silence:
        grouped = thin.withColumn("group", F.pmod(F.xxhash64("source_id"), F.lit(GROUPS))).groupBy("group")
        return grouped.applyInPandasWithState(_in_groups(sent, params), schema, GROUP_STATE, "append", "NoTimeout")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        blob, last, records, late = state.get if state.exists else (None, None, 0, 0)
        tracker = Tracker(sent.value, params, method, source_number(key[0]))
        if blob is not None:
            tracker.restore(*pickle.loads(blob))
        rows = pd.concat(list(batches)).sort_values("us", kind="stable")
        out = []
        for us, x, y in zip(rows["us"].tolist(), rows["x"].tolist(), rows["y"].tolist(), strict=True):
            if last is not None and us <= last:
                late += 1
                continue
            xy = np.array([x, y], dtype=float)
            if records == 0:
                tracker.start(xy, None, 0)
            else:
                tracker.step(xy, records)
            out.append(tracker.best(records))
            last, records = us, records + 1
        state.update((pickle.dumps(tracker.state()), last, records, late))
        if silence:
            state.setTimeoutDuration(int(silence))
        if out:
            found = frame(out)
            found.insert(0, "source_id", [key[0]] * len(found))
            yield found.assign(late=late)

    return thin.groupBy("source_id").applyInPandasWithState(run, schema, STATE, "append", "ProcessingTimeTimeout" if silence else "NoTimeout")


def _in_groups(sent, params: TrackingParameters):
    """The filter of a group of sources: their particles, and of each source (time of the last fix, fixes, late ones)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fleet, last = Fleet(sent.value, params), {}
        if state.exists:
            blob, known = state.get
            fleet.loads(blob)
            last = pickle.loads(known)
        rows = pd.concat(list(batches), ignore_index=True)
        ids = source_ids(rows["source_id"])
        index = {s: k for k, s in enumerate(dict.fromkeys(ids))}
        names, at = list(index), np.array([index[s] for s in ids], dtype=np.int64)
        us, xy = rows["us"].to_numpy(), rows[["x", "y"]].to_numpy(dtype=float)
        order = np.lexsort((us, at))
        at, us, xy = at[order], us[order], xy[order]
        again = (np.diff(at, prepend=-1) == 0) & (np.diff(us, prepend=us[:1]) == 0)
        begun = np.array([s in last for s in names], dtype=bool)
        before = np.array([last[s][0] if s in last else 0 for s in names], dtype=np.int64)
        kept = ~again & (~begun[at] | (us > before[at]))
        late = np.bincount(at[~kept], minlength=len(names)) + np.array([last[s][2] if s in last else 0 for s in names])
        done = np.array([last[s][1] if s in last else 0 for s in names], dtype=np.int64)
        at, us, xy = at[kept], us[kept], xy[kept]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        number = np.bincount(at, minlength=len(names))
        newest = before.copy()
        newest[at] = us  # they rise
        for k, s in enumerate(names):
            last[s] = (int(newest[k]), int(done[k] + number[k]), int(late[k]))
        out = []
        for k in range(int(number.max(initial=0))):  # the k-th new fix of every source
            now = np.flatnonzero(rank == k)
            own = [names[i] for i in at[now].tolist()]
            found = pd.DataFrame(fleet.advance(own, [source_number(s) for s in own], xy[now], (done[at[now]] + k).tolist()))
            found.insert(0, "source_id", own)
            out.append(found.assign(late=late[at[now]]))
        state.update((fleet.dumps(), pickle.dumps(last)))
        if out:
            yield nullable(pd.concat(out, ignore_index=True))

    return run


def drop_late(fixes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Deduplicates a stream by (source_id, ts) within a watermark; later duplicates and late fixes go."""
    return fixes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source_id", "ts"])


def windowed(fixes: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Fixes and mean place per source and time window (tumbling, or sliding with ``slide``)."""
    timed = fixes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(window, "source_id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))


def replay(fixes: DataFrame, schema_path: str, network: RoadNetwork, params: TrackingParameters, out: str, checkpoint: str, method: str = "pl", files_per_trigger: int = 1) -> DataFrame:
    """Runs the stream over the Parquet files of a folder until they are used up and returns what it wrote."""
    spark = fixes.sparkSession
    stream = spark.readStream.schema(fixes.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(schema_path)
    tracked = track_stream(stream, network, params, method)
    query = tracked.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
