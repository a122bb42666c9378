"""Aggregated rules on a stream: gap sessions and whole-log groups with thresholds, in one state.

The batch form is :func:`alertweft.operators.sessions.bursts`; over a stream that
was ended by :func:`end` both give the same groups.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from alertweft.operators.replay import natural
from alertweft.operators.rules import RuleError, field_column, match_rules
from alertweft.operators.sessions import limits
from alertweft.session import ship

ship(__name__)

#: time of the row that ends a stream, in milliseconds (9999-01-01), and when everything still open is due (9000-01-01)
END_MS, FLUSH_MS = 253_370_764_800_000, 221_845_392_000_000
#: end of a group that holds an event without a time, as in the batch form
FOREVER = 1 << 62
#: distinct values a session keeps beside its counts; one with more keeps each as an entry of its own
HELD = 64
#: sessions and values of a key that are kept as one entry; a key with more keeps each session as an entry of its own
PACKED = 256

SESSION = "start_us bigint, end_us bigint, n bigint, untimed bigint, first_us bigint, first_order string, first_key string, n_distinct bigint, dead boolean, held array<string>"
OUTPUT = "rule_case string, group array<string>, n bigint, start_us bigint, end_us bigint, n_distinct bigint, first_key string"


class Session:
    """An open group: what its rows so far come to."""

    def __init__(self, sid: int, values: tuple | None = None, stored: bool = False):
        self.sid, self.stored = sid, stored
        (self.start, self.end, self.n, self.untimed, self.first_us, self.first_order, self.first_key,
         self.n_distinct, self.dead, held) = values or (None, None, 0, 0, None, None, None, 0, False, [])
        self.held: set[str | None] | None = None if held is None else set(held)

    def row(self) -> tuple:
        return (self.start, self.end, self.n, self.untimed, self.first_us, self.first_order, self.first_key, self.n_distinct, self.dead,
                None if self.held is None else list(self.held))

    def first(self) -> tuple:
        return (self.first_us is None, self.first_us or 0, self.first_order or "", self.first_key or "")

    def join(self, other: Session) -> None:
        """Take in another group's rows, all but its distinct values."""
        starts, ends = [s for s in (self.start, other.start) if s is not None], [e for e in (self.end, other.end) if e is not None]
        self.start, self.end = min(starts, default=None), max(ends, default=None)
        if self.n == 0 or (other.n and other.first() < self.first()):
            self.first_us, self.first_order, self.first_key = other.first_us, other.first_order, other.first_key
        self.n, self.untimed, self.dead = self.n + other.n, self.untimed + other.untimed, self.dead or other.dead


class Bursts(StatefulProcessor):
    """Open groups of one (rule, group) key.

    A key with few sessions and values keeps them in one entry and sets a timer for the
    first that is due, so that it costs one read, one write and one timer.  Beyond PACKED, two maps hold
    its state: its open sessions, each with its own timer, and one entry per distinct value
    of a session with more than HELD of them, so that no value of the state holds a
    set without bound.  A session is due when no event above the watermark can join it.
    One whose span is beyond the rule's limit can never qualify again: it gives up its
    values and stays only to take in what joins it.
    """

    def __init__(self, rules: dict[str, dict]):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # null: no open session; else [first timer, [sid, session], ...] as JSON, or '' where the sessions are in the map
        self.packed = handle.getValueState("packed", "sessions string")
        self.sessions = handle.getMapState("sessions", "sid bigint", SESSION)
        self.values = handle.getMapState("values", "sid bigint, absent boolean, value string", "held boolean")

    def _open(self) -> tuple[list[Session], bool, int | None]:
        """(open sessions of the key, whether the map holds them, first timer of a packed key)."""
        found = self.packed.get()
        if found is None:
            return [], False, None
        if not found[0]:
            return [Session(k[0], tuple(v), stored=True) for k, v in self.sessions.iterator()], True, None
        due, *rows = json.loads(found[0])
        return [Session(sid, tuple(values)) for sid, values in rows], False, due

    def _pack(self, rule: dict, opened: list[Session], timer: int | None) -> None:
        """Keep the sessions as one entry, with a timer that is not later than the first one due."""
        due = min(self._due(rule, s) for s in opened)
        if timer is None or due < timer:
            timer = due
            self.handle.registerTimer(due)
        self.packed.update((json.dumps([timer, *((s.sid, s.row()) for s in opened)]),))

    def _drop_values(self, session: Session) -> list[str | None]:
        """Take a session's values out of the state."""
        if session.held is not None:
            mine, session.held = list(session.held), set()
            return mine
        keys = [tuple(k) for k in self.values.keys() if k[0] == session.sid]
        for key in keys:
            self.values.removeKey(key)
        session.held = set()
        return [None if absent else value for _, absent, value in keys]

    def _merge(self, kept: Session, gone: Session) -> None:
        kept.join(gone)
        moved = self._drop_values(gone)
        if not kept.dead:
            for value in moved:
                self._add_value(kept, value)
        if gone.stored:
            self.sessions.removeKey((gone.sid,))

    def _add_value(self, session: Session, value: str | None) -> None:
        if session.held is not None:
            session.held.add(value)
            session.n_distinct = len(session.held)
            if len(session.held) > HELD:
                for known in session.held:
                    self.values.updateValue((session.sid, known is None, known or ""), (True,))
                session.held = None
            return
        key = (session.sid, value is None, value or "")
        if not self.values.containsKey(key):
            self.values.updateValue(key, (True,))
            session.n_distinct += 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # rows that only move the watermark
            for _ in rows:
                pass
            return
        rule, seen = self.rules[key[0]], set()
        gap, within = rule["gap"], rule["within"]
        # open gap sessions lie more than a gap apart, so they are in order by start and by end
        opened, mapped, timer = self._open()
        opened.sort(key=lambda s: s.start or 0)
        touched: dict[int, Session] = {}
        for row in rows:
            one = Session(row.us if gap is not None and row.us is not None else 0)
            one.start = one.end = one.first_us = row.us
            one.n, one.untimed, one.first_order, one.first_key = 1, int(row.us is None), row.order, row.key
            if gap is not None and row.us is None:
                # infinitely far from every other event: a group of its own
                one.n_distinct = 1
                yield from self._result(key, one)
                continue
            high = len(opened) if gap is None else bisect_right(opened, row.us + gap, key=lambda s: s.start)
            low = high
            while low > 0 and (gap is None or opened[low - 1].end >= row.us - gap):
                low -= 1
            home = max(opened[low:high], key=lambda s: s.n_distinct, default=one)
            for other in opened[low:high]:
                if other is not home:
                    self._merge(home, other)
                    touched.pop(other.sid, None)
            if home is not one:
                home.join(one)
            opened[low:high] = [home]
            touched[home.sid] = home
            if not home.dead and within is not None and (home.untimed or home.end - home.start > within):
                home.dead, home.n_distinct = True, 0
                self._drop_values(home)
            if rule["distinct"] is not None and not home.dead:
                if home.held is not None:
                    self._add_value(home, row.value)
                elif (home.sid, row.value) not in seen:
                    seen.add((home.sid, row.value))
                    self._add_value(home, row.value)
        if not opened:
            return
        if not mapped and all(s.held is not None for s in opened) and sum(1 + len(s.held) for s in opened) <= PACKED:
            self._pack(rule, opened, timer)
            return
        if not mapped:
            self.packed.update(("",))
            touched = {s.sid: s for s in opened}
        for sid, session in touched.items():
            self.sessions.updateValue((sid,), session.row())
            self.handle.registerTimer(self._due(rule, session))

    def _due(self, rule: dict, session: Session) -> int:
        if rule["gap"] is None or session.end is None:
            return FLUSH_MS
        return min(FLUSH_MS, -((session.end + rule["gap"]) // -1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rule, now = self.rules[key[0]], timerValues.getCurrentWatermarkInMs()
        opened, mapped, _ = self._open()
        # what was extended after its timer was set is not due yet
        left = [s for s in opened if self._due(rule, s) > now]
        for session in opened:
            if self._due(rule, session) <= now:
                if mapped:
                    self.sessions.removeKey((session.sid,))
                    self._drop_values(session)
                yield from self._result(key, session)
        if opened and not left:
            self.packed.clear()
        elif not mapped and left:
            self._pack(rule, left, None)

    def _result(self, key, session: Session) -> Iterator[Row]:
        rule = self.rules[key[0]]
        start, end = (0, FOREVER) if session.untimed else (session.start, session.end)
        if session.dead or session.n < rule["count"] or (rule["within"] is not None and end - start > rule["within"]):
            return
        if rule["distinct"] is not None and session.n_distinct < rule["distinct"]:
            return
        yield Row(rule_case=key[0], group=json.loads(key[1]), n=session.n, start_us=start, end_us=end,
                  n_distinct=session.n_distinct if rule["distinct"] is not None else None, first_key=session.first_key)

    def close(self) -> None:
        pass


def aggregated_alerts(events: DataFrame, rules: list[dict], ends: DataFrame, at: str = "event_time", key: str = "record_key",
                      late: str = "10 minutes") -> DataFrame:
    """Qualifying groups of all rules with an aggregation block, each once, when the watermark closes it.

    ``events`` is a stream and ``ends`` that of :func:`endings`.  One scan
    evaluates all rules and one stateful operator holds the groups of all of
    them, keyed by rule and group values (null is a value of its own, as for
    distinct values).  Columns: rule_case, group (in the order of ``group_by``),
    n, start_us, end_us, n_distinct (null if the rule counts no values) and
    first_key, the record key of the group's first event.  A rule without a
    session gap judges the whole log, so its groups come out only when the stream
    is ended.  An event without a time is a group of its own beside a gap, and
    makes the span of a whole-log group infinite.  Events later than ``late`` are
    dropped by the watermark, and so are those of 1970-01-01 00:00 and before, where it starts.  A group's rows of one micro-batch are read by one
    task one after the other; its state is one row per open session and one per
    distinct value of a session that has more than HELD of them.  That no rule has an aggregation block is an error.
    """
    grouped = [r for r in rules if r.get("aggregation")]
    if not grouped:
        raise RuleError("no rule has an aggregation block")
    text = lambda field: field_column(field).cast("string")
    group = value = F.lit(None).cast("string")
    for rule in grouped:
        block, mine = rule["aggregation"], F.col("rule_case") == rule["case_id"]
        group = F.when(mine, F.to_json(F.array(*[text(f) for f in block["group_by"]]))).otherwise(group)
        if block.get("distinct"):
            value = F.when(mine, text(block["distinct"]["field"])).otherwise(value)
    order = natural(F.col(key).cast("string"))
    hits = match_rules(events, grouped).select(
        "rule_case", group.alias("group_key"), F.col(at).cast("timestamp").alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"),
        order.alias("order"), F.col(key).cast("string").alias("key"), value.alias("value"))
    rows = hits.unionByName(ends.select("at"), allowMissingColumns=True)
    # the watermark stands above the union, so that the end counts for it
    return rows.withWatermark("at", late).groupBy("rule_case", "group_key").transformWithState(
        Bursts({r["case_id"]: limits(r) for r in grouped}), StructType.fromDDL(OUTPUT), "Append", "EventTime")


def endings(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of ends written to ``folder`` by :func:`end`."""
    spark.createDataFrame([], "at timestamp").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("at timestamp").parquet(folder)


def end(spark: SparkSession, folder: str) -> None:
    """Say that the log is complete: the next micro-batch closes all that is open, and later events are late."""
    spark.range(1).select(F.timestamp_millis(F.lit(END_MS)).alias("at")).coalesce(1).write.mode("append").parquet(folder)


#: keyed state with timers needs this store; other streams keep the session's
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def write_available(stream: DataFrame, path: str) -> StreamingQuery:
    """Run a stream of :func:`aggregated_alerts` over what is there, appending to the table at ``path``; run again, it goes on from its state."""
    spark, (name, store) = stream.sparkSession, STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        # a query takes its settings when it starts
        return stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
            "checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
