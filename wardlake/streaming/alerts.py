"""Alert rules over a stream of samples, with notifications per group.

The batch form, ``metrics.threshold_alerts``, says how the rules stand at one time;
here they are evaluated every ``every`` seconds of event time, as samples arrive:

1. Samples are joined with the rules (a small table) and reduced to the last one
   per rule and evaluation interval, a windowed aggregate that sums up before the
   shuffle: a hot metric sends one row per interval on.  The rules are broadcast, as a
   join by metric would deal all samples of a metric to one task, and a stream has no
   adaptive execution that would see how few rules there are.
2. ``transformWithState`` keeps the rules of one service.  It starts with the rules
   as initial state, so a rule whose metric never arrives is known too, and sets an
   event-time timer for the next thing that happens *without* a row: a sample grows
   too old, a notification is due, a firing group must be repeated.

A row whose metric could not be read (``error``) makes its rules fire, as in the batch
form.  Between two rows or timers nothing can change, so that equals evaluating at every
tick.  Event time moves with the samples of all metrics, those without a rule too.

Rows: ``change`` (a rule's state changed), ``notify`` (what fires in the group
changed), ``repeat`` (it still fires).  A group that starts to fire waits
``group_wait``; later changes come ``group_interval`` apart; a change that is undone
in the meantime is not sent; what still fires is repeated after ``repeat_interval``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import metrics
from . import batches
from .incremental import _start, with_state_store

# ---------------------------------------------------------------------------
# Fixed values, in seconds: how often rules are evaluated, how long a new group
# waits, the least time between a group's notifications, and after how long what
# still fires is sent again.
EVERY = 10
GROUP_WAIT = 10
GROUP_INTERVAL = 60
REPEAT_INTERVAL = 4 * 3600
# ---------------------------------------------------------------------------
MICRO = 1_000_000

ALERT_SCHEMA = T.StructType([
    T.StructField("service", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("kind", T.StringType()),
    T.StructField("rule", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("firing", T.ArrayType(T.StringType())), T.StructField("resolved", T.ArrayType(T.StringType())),
])
_AlertRow = Row(*ALERT_SCHEMA.names)


class Group:
    """The rules of one service and what was last sent about them.  Times are seconds
    of event time, those of samples microseconds."""

    def __init__(self, start: int, every: int = EVERY, wait: int = GROUP_WAIT, interval: int = GROUP_INTERVAL,
                 repeat: int = REPEAT_INTERVAL):
        self.start, self.every, self.wait, self.interval, self.repeat = start, every, wait, interval, repeat
        self.rules: dict[str, dict] = {}
        self.begun = False
        self.sent: list[str] = []
        self.last: int | None = None  # when the last notification was sent
        self.due: int | None = None  # when the next one is

    def add(self, name: str, limit: float, lookback: int, no_data_alerts: bool, severity: str | None) -> None:
        self.rules[name] = {"limit": limit, "lookback": lookback, "no_data": no_data_alerts, "severity": severity,
                            "ts": None, "value": None, "error": False, "state": None}

    def dump(self) -> str:
        return json.dumps([self.rules, self.begun, self.sent, self.last, self.due])

    def load(self, text: str) -> "Group":
        self.rules, self.begun, self.sent, self.last, self.due = json.loads(text)
        return self

    def _tick(self, at: int) -> int:
        return -(-at // self.every) * self.every

    def _too_old(self, rule: dict) -> int:
        """The first tick at which the rule's sample is out of its look-back."""
        return ((rule["ts"] + rule["lookback"] * MICRO) // (self.every * MICRO) + 1) * self.every

    def next_event(self) -> int:
        """The tick of what happens next if no sample comes; 0 if nothing does."""
        if not self.begun:
            return self._tick(self.start)
        at = [self._too_old(r) for r in self.rules.values() if r["ts"] is not None]
        if self.due is not None:
            at.append(self.due)
        if self.sent:
            at.append(self._tick(self.last + self.repeat))
        return min(at, default=0)

    def samples(self, tick: int, found: list[tuple]) -> Iterator[tuple]:
        """The samples (rule, time, value, perhaps whether it is an error instead) of the
        interval that ends at ``tick``."""
        yield from self.advance(tick - 1)
        for name, ts, value, *error in found:
            if name in self.rules:
                self.rules[name].update(ts=ts, value=value, error=any(error))
        if tick >= self.start:
            yield from self._evaluate(tick)

    def advance(self, until: int) -> Iterator[tuple]:
        """Everything that happens up to ``until`` without a sample."""
        at = self.next_event()
        while at and at <= until:
            yield from self._evaluate(at)
            at = self.next_event()

    def _evaluate(self, tick: int) -> Iterator[tuple]:
        """Rows (at, kind, rule, severity, state, reason, value, firing, resolved)."""
        self.begun = True
        for name, r in self.rules.items():
            if r["ts"] is not None and self._too_old(r) <= tick:
                r.update(ts=None, value=None, error=False)
            if r["ts"] is None:
                state, reason = "Alerting" if r["no_data"] else "NoData", "no data"
            elif r["error"]:
                state, reason = "Alerting", "error"
            else:
                state, reason = "Alerting" if r["value"] < r["limit"] else "Normal", "value"
            if state != r["state"]:
                r["state"] = state
                yield tick, "change", name, r["severity"], state, reason, r["value"], None, None
        firing = sorted(n for n, r in self.rules.items() if r["state"] == "Alerting")
        if firing == self.sent:
            self.due = None
        elif self.due is None:
            self.due = self._tick(max(tick, self.last + self.interval) if self.sent else tick + self.wait)
        kind = None
        if self.due is not None and self.due <= tick:
            kind = "notify"
        elif self.sent and self.last + self.repeat <= tick:
            # due changes are sent on their own; the repeat is about what was sent
            kind = "repeat"
        if kind:
            resolved = [n for n in self.sent if n not in firing] if kind == "notify" else []
            if kind == "notify":
                self.sent, self.due = firing, None
            self.last = tick
            yield tick, kind, None, None, None, None, None, list(self.sent), resolved


class _Alerts(StatefulProcessor):
    """Keeps one ``Group`` per service, and one timer for its next event."""

    def __init__(self, start: int, limits: tuple[int, ...]):
        self.make = lambda: Group(start, *limits)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("group", "group string, timer bigint")

    def _get(self) -> tuple[Group, int]:
        if not self.state.exists():
            return self.make(), 0
        text, timer = self.state.get()
        return self.make().load(text), timer

    def _keep(self, group: Group, timer: int) -> None:
        at = group.next_event() * 1000
        if at != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if at:
                self.handle.registerTimer(at)
        self.state.update((group.dump(), at))

    def _rows(self, key, found) -> Iterator[Row]:
        for at, *rest in found:
            yield _AlertRow(key[0], datetime.fromtimestamp(at, timezone.utc), *rest)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        group, timer = self._get()
        r = initialState
        group.add(r.rule, r.less_than, r.lookback_seconds, r.no_data_alerts, r.severity)
        self._keep(group, timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        group, timer = self._get()
        ticks: dict[int, list[tuple]] = {}
        for r in rows:  # at most one per rule and interval
            ticks.setdefault(r.tick, []).append((r.rule, r.ts, r.value, r.error))
        out = [x for tick in sorted(ticks) for x in group.samples(tick, ticks[tick])]
        self._keep(group, timer)
        return self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        group, _ = self._get()
        # all samples before the watermark are in, so what follows up to it happens now too
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        out = list(group.advance(until // 1000))
        self._keep(group, 0)
        return self._rows(key, out)

    def close(self) -> None:
        pass


def last_per_interval(samples: DataFrame, rules: DataFrame, every: int = EVERY) -> DataFrame:
    """service, rule, tick (seconds), ts (microseconds), value and error: the last sample
    of each rule in each interval; of equal times an error, else the greatest value."""
    own = F.col("labels") if "labels" in samples.columns else F.lit(None).cast("map<string,string>")
    error = metrics.read_error(samples)
    s = samples.where((F.col("value").isNotNull() | error) & F.col("ts").isNotNull()).select(
        "metric", "ts", F.when(~error, F.col("value")).alias("value"), error.alias("error"), own.alias("_own"))
    wanted = rules.select("rule", "metric", F.coalesce("service", F.lit("")).alias("service"), F.col("labels").alias("_wanted"))
    match = F.col("_wanted").isNull() | F.forall(F.map_entries("_wanted"), lambda e: F.coalesce(
        F.try_element_at(F.col("_own"), e["key"]) == e["value"], F.lit(False)))
    last = F.max(F.struct(F.unix_micros("ts").alias("ts"), "error", "value")).alias("last")
    return s.join(F.broadcast(wanted), "metric").where(match).groupBy("service", "rule", F.window("ts", f"{every} seconds").alias("interval")).agg(
        last).select("service", "rule", "interval", F.unix_seconds("interval.end").alias("tick"), "last.ts", "last.value",
               "last.error")


def alert_stream(samples: DataFrame, rules: DataFrame, start, delay: str = "1 minute", every: int = EVERY,
                 group_wait: int = GROUP_WAIT, group_interval: int = GROUP_INTERVAL,
                 repeat_interval: int = REPEAT_INTERVAL) -> DataFrame:
    """Streaming frame of ``ALERT_SCHEMA`` over a stream of samples (metric, ts,
    value, perhaps labels).  Rules are evaluated from ``start`` on at every multiple
    of ``every`` seconds t over the samples in [t - lookback, t); samples that come
    more than ``delay`` late are dropped.  Changed rules need a new checkpoint."""
    first = int(datetime.fromisoformat(str(start)).replace(tzinfo=timezone.utc).timestamp())
    reduced = last_per_interval(samples.withWatermark("ts", delay), rules, every)
    known = rules.select(F.coalesce("service", F.lit("")).alias("service"), "rule", "less_than", "lookback_seconds",
                         "no_data_alerts", "severity").groupBy("service")
    return reduced.groupBy("service").transformWithState(
        _Alerts(first, (every, group_wait, group_interval, repeat_interval)), ALERT_SCHEMA, "Append", "EventTime", known)


def stream_threshold_alerts(samples: DataFrame, rules: DataFrame, out_dir: str, checkpoint: str, start,
                            available_now: bool = True, fold_every: int = 100, **options) -> StreamingQuery:
    """Write the alert rows as they come up (read with ``read_alerts``)."""
    def apply(df: DataFrame, batch_id: int) -> None:
        s = df.sparkSession
        batches.write_batch(df, out_dir, batches.query_id(s, checkpoint), batch_id)
        if batch_id % fold_every == fold_every - 1:
            batches.fold(s, out_dir, ALERT_SCHEMA)

    rows = alert_stream(samples, rules, start, **options)
    return with_state_store(samples.sparkSession, lambda: _start(
        rows.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", checkpoint), available_now))


def read_alerts(spark: SparkSession, out_dir: str) -> DataFrame:
    paths = batches.committed(spark, out_dir)
    return spark.read.schema(ALERT_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], ALERT_SCHEMA)
