"""The change feed: latest state per path, bursts, and upkeep of the index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.window import Window

from tessella.operators.index import leb, unleb
from tessella.operators.scan import exclude_globs, ignore_file_events, is_indexable, not_ignored
from tessella.sources.store import update_index

STATE = ["kind", "ts", "event_id", "mtime", "size"]


def latest_per_path(changes: DataFrame) -> DataFrame:
    """The last event of each path, by (ts, event_id). On a stream this is the running state, one row of it per path."""
    last = F.max_by(F.struct(*STATE), F.struct("ts", "event_id")).alias("x")
    return changes.groupBy("path").agg(last).select("path", "x.*")


def _root(path: str = "path"):
    return F.regexp_extract(path, "^/?[^/]*", 0)


def coalesce_bursts(changes: DataFrame, gap_seconds: int) -> DataFrame:
    """root, began, ended (a gap after the last event), n_events, n_paths of every run of events less than the gap apart, over all paths below one top folder.

    Events of one root in one slot as long as the gap are always of one run, so runs
    are found on a row per slot, and events and paths are counted with partial
    sums: nothing holds all paths or events of a run.
    """
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(gap_seconds * 1_000_000))
    per_path = changes.withColumn("root", _root()).groupBy("root", slot.alias("slot"), "path").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    slots = per_path.groupBy("root", "slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    in_order = Window.partitionBy("root").orderBy("slot")
    begins = F.coalesce(F.unix_micros(F.col("lo").cast("timestamp")) - F.lag(F.unix_micros(F.col("hi").cast("timestamp"))).over(in_order) >= gap_seconds * 1_000_000, F.lit(True))
    runs = slots.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))).select("root", "slot", "run")
    # A path counts once in a run, in however many of its slots it stands.
    paths = per_path.join(runs, ["root", "slot"]).groupBy("root", "run", "path").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = paths.groupBy("root", "run").agg(F.min("lo").alias("began"), F.max("hi").alias("hi"), F.sum("n").cast("long").alias("n_events"), F.count("*").alias("n_paths"))
    return out.select("root", "began", (F.col("hi") + F.make_interval(secs=F.lit(gap_seconds))).alias("ended"), "n_events", "n_paths")


BURST = "root string, began timestamp, ended timestamp, n_events long, n_paths long"


#: Tasks that share the paths of one root. A stream must keep to it.
SHARES = 16
_DEALT = "root string, share int, times binary, paths array<string>, own binary"
#: So that no time is negative; paths that are held before they go to the state.
_SHIFT, _HELD = 1 << 61, 50_000


def _times(micros: np.ndarray) -> bytes:
    """Rising times, packed."""
    return leb(np.diff(micros, prepend=-_SHIFT))[0].tobytes()


def _untimes(data: bytes) -> np.ndarray:
    return np.cumsum(unleb(np.frombuffer(data, np.uint8))[0]) - _SHIFT


def _to_shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each share of a root gets the times of all its events, a few bytes each, and the paths that are its own."""
    for df in batches:
        df = df.assign(at=df["ts"].astype("datetime64[us]").astype("int64"), path=df["path"].fillna("")).sort_values("at")
        df["share"] = pd.util.hash_array(df["path"].to_numpy(object)) % SHARES
        out = []
        for root, rows in df.groupby("root", dropna=False):
            times, of = _times(rows["at"].to_numpy()), dict(list(rows.groupby("share")))
            for k in range(SHARES):
                own = of.get(k, rows[:0])
                out.append((None if pd.isna(root) else root, k, times, own["path"].tolist(), _times(own["at"].to_numpy())))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _DEALT.split(", ")])


class Bursts(StatefulProcessor):
    """Of one share of a root: the open runs, as first and last time and number of events, and for each path of the share one time in each run in which it stands.

    Every share sees the times of all events of its root, so all have the same runs at the same time, and
    only paths are counted in shares. Runs grow and join but never part, so a time tells its run for good.
    """

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "lo array<long>, hi array<long>, n array<long>")
        self.due = handle.getValueState("due", "at long")
        self.paths = handle.getMapState("paths", "path string", "times array<long>")

    def _joined(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs less than the gap apart are one."""
        order = np.argsort(lo, kind="stable")
        lo, hi, n = lo[order], np.maximum.accumulate(hi[order]), n[order]
        begin = np.flatnonzero(np.append(True, lo[1:] - hi[:-1] >= self.gap)) if len(lo) else np.zeros(0, np.int64)
        return lo[begin], hi[np.append(begin[1:], len(hi)) - 1] if len(lo) else hi, np.add.reduceat(n, begin) if len(lo) else n

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        on_time = lambda at: at > late if late > 0 else np.ones(len(at), bool)
        runs, held = self._held(), {}
        for df in rows:
            for times, paths, own in zip(df["times"], df["paths"], df["own"], strict=True):
                at = _untimes(times)
                at = at[on_time(at)]
                runs = self._joined(*(np.concatenate(x) for x in zip(runs, (at, at, np.ones(len(at), np.int64)), strict=True)))
                at = _untimes(own)
                good = on_time(at)
                which = np.searchsorted(runs[0], at[good], "right") - 1
                for path, run in set(zip(np.asarray(paths, object)[good].tolist(), which.tolist(), strict=True)):
                    held.setdefault(path, set()).add(int(runs[0][run]))
            if len(held) > _HELD:
                self._keep(held, runs[0])
                held = {}
        self._keep(held, runs[0])
        self._put(runs)
        return iter(())

    def _held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.array(x, np.int64) for x in (self.runs.get() if self.runs.exists() else ((), (), ())))

    def _put(self, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Keeps the runs, and one timer: for the first that may be over."""
        self.runs.update(tuple(x.tolist() for x in runs))
        due = int(runs[1].min() + self.gap) // 1000 + 1 if len(runs[1]) else None
        before = self.due.get()[0] if self.due.exists() else None
        if before is not None and before != due:
            self.handle.deleteTimer(before)
            self.due.clear()
        if due is not None and before != due:
            self.handle.registerTimer(due)
            self.due.update((due,))

    def _keep(self, held: dict[str, set[int]], lo: np.ndarray) -> None:
        """One time of each run is kept of a path."""
        for path, times in held.items():
            before = self.paths.getValue((path,))[0] if self.paths.containsKey((path,)) else []
            own = {int(np.searchsorted(lo, t, "right")): int(t) for t in (*times, *before)}
            if sorted(own.values()) != sorted(before):
                self.paths.updateValue((path,), (sorted(own.values()),))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The runs whose last event lies a gap before the watermark: no later event can go on with them."""
        lo, hi, n = self._held()
        over = hi + self.gap < timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        if over.any():
            counts = self._take(lo, over)
            time = lambda x: pd.to_datetime(x[over], unit="us")
            yield pd.DataFrame({"root": [key[0]] * int(over.sum()), "began": time(lo), "ended": time(hi + self.gap), "n_events": n[over], "n_paths": counts[over]})
        self._put((lo[~over], hi[~over], n[~over]))

    def _take(self, lo: np.ndarray, over: np.ndarray) -> np.ndarray:
        """Takes the times of the runs that are over out of the paths; how many paths stood in each run."""
        n, gone, less = np.zeros(len(lo), np.int64), [], []
        for (path,), (times,) in self.paths.iterator():
            which = np.searchsorted(lo, np.array(times, np.int64), "right") - 1
            own = np.unique(which[over[which]])
            if len(own):
                n[own] += 1
                rest = [int(t) for t, k in zip(times, which, strict=True) if not over[k]]
                (less if rest else gone).append((path, rest))
            if len(gone) + len(less) >= 10_000:
                self._drop(gone, less)
                gone, less = [], []
        self._drop(gone, less)
        return n

    def _drop(self, gone: list, less: list) -> None:
        for path, _ in gone:
            self.paths.removeKey((path,))
        for path, rest in less:
            self.paths.updateValue((path,), (rest,))

    def close(self) -> None:
        pass


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All shares of a run, which come in one batch, as one."""
    runs: dict[tuple, int] = {}
    for df in batches:
        for *run, n in df.astype({"root": object}).itertuples(index=False):
            run = tuple(run)
            runs[run] = runs.get(run, 0) + n
    if runs:
        yield pd.DataFrame([(*run, n) for run, n in runs.items()], columns=[c.split()[0] for c in BURST.split(", ")])


def stream_bursts(changes: DataFrame, gap_seconds: int, late: str) -> DataFrame:
    """``coalesce_bursts`` on a stream: a run comes out once, when the watermark is a gap behind its last event. Events later than ``late`` are passed over. Keyed state: see ``Bursts``; the session must use the RocksDB state store."""
    on_time = changes.withColumn("root", _root()).select("root", "path", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    shares = on_time.mapInPandas(_to_shares, _DEALT).groupBy("root", "share").transformWithStateInPandas(Bursts(gap_seconds), BURST, "Append", "EventTime")
    return shares.repartition("root", "began").mapInPandas(_summed, BURST)


def follow(changes: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def rescan_requests(changes: DataFrame) -> DataFrame:
    """path, event_id, ts, kind: the last event of each ignore file, which asks for a full scan."""
    return latest_per_path(ignore_file_events(changes)).select("path", "event_id", "ts", "kind")


REQUEST = "what string, event_id long, ts timestamp, value string"


def _real_changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The events after which the value is another one than before; the value, and when it was set, are all that is kept."""
    last = state.get if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")  # control events are few
    out = []
    for r in rows.itertuples(index=False):
        at = (int(r.ts.value), int(r.event_id))
        if last is not None and at <= (last[1], last[2]):
            continue  # it came late: a later value stands already
        if last is None or r.value != last[0]:
            out.append((key[0], int(r.event_id), r.ts, r.value))
        last = (r.value, *at)
    if last is not None:
        state.update(last)
    if out:
        yield pd.DataFrame(out, columns=["what", "event_id", "ts", "value"])


def setting_requests(controls: DataFrame) -> DataFrame:
    """what, event_id, ts, value: a request for a full scan for each real change of the settings or the list of folders, and for their first value.

    controls: a stream of event_id, ts, what (``settings``, ``folders``) and value, their whole
    content or a digest of it; an event with the value that stands already asks for nothing, and one
    that is older than the value that stands is passed over.
    """
    rows = controls.select("what", "event_id", "ts", "value")
    return rows.groupBy("what").applyInPandasWithState(_real_changes, REQUEST, "value string, ts long, event_id long", "append", GroupStateTimeout.NoTimeout)


def apply_changes(changes: DataFrame, index_dir: str, load: Callable[[DataFrame], DataFrame], globs: list[str], checkpoint: str, rescan: Callable[[DataFrame], None] | None = None, once: bool = True, ignore: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Follows a streaming table of changes.

    By default ignore files have no say in changes. ignore: gives the rules (root, globs) of ``cap_ignore`` as they
    stand at a batch; then a change that they match is passed over like an excluded one.

    In each batch the last event of a path counts. Deleted paths leave the
    index; created and changed ones that no glob excludes (by their exact path)
    and that may be indexed are loaded and replaced; only the buckets of these
    paths are written. load(changes) gives path, mtime, text. ``rescan`` gets the
    batch's ``rescan_requests`` if there are any. A batch that runs again gives the same index.
    """

    def batch(df: DataFrame, _: int) -> None:
        last = latest_per_path(df).persist()
        try:
            asked = rescan_requests(last)
            if rescan and not asked.isEmpty():
                rescan(asked)
            gone = last.filter(F.col("kind") == "delete").select("path")
            fresh = is_indexable(exclude_globs(last.filter(F.col("kind") != "delete"), globs, tree=False))
            fresh = not_ignored(fresh, ignore()) if ignore else fresh
            update_index(df.sparkSession, index_dir, load(fresh), gone)
        finally:
            last.unpersist()

    return follow(changes, batch, checkpoint, once)
