"""Streaming jobs: redacted audit, continuous upsert, running-balance breaks, session flow, event-time rollups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docketry.functions.text import redact, redacted
from docketry.functions.wording import lint
from docketry.sources.store import merge_batch


def audit_stream(turns: DataFrame, path: str, checkpoint: str, text_cols: tuple[str, ...] = ("text",)) -> StreamingQuery:
    """Turns with their texts redacted, appended to a table; the checkpoint makes each row land once."""
    safe = turns.withColumns({c: redact(F.col(c)) for c in text_cols})
    return safe.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def upsert_stream(chunks: DataFrame, root: str, key: str, checkpoint: str, order: tuple[str, ...] = (), buckets: int = 64) -> StreamingQuery:
    """Each batch is merged into the store at `root` (`sources.store`): of repeated keys the last by `order`; a batch counts once."""

    def write(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, root, key, order, buckets)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_rows(turns: DataFrame, at: Column) -> DataFrame:
    """The audit record of each answered turn, its texts redacted at every depth; feeds `audit_stream`, whose own redaction changes nothing more.

    turns: trace_id, session_id, channel, route, rule_version, guardrail (struct), primary, confidence, secondary, decision_inputs
    (map of texts), handoff_required, reply. Terms that the reply should not use are added to the decision's inputs; null routes,
    versions and hand-offs read as empty and false. `at` is the record's time.
    """
    met = F.col("_l.violations")
    inputs = F.coalesce("decision_inputs", F.create_map().cast("map<string,string>"))
    inputs = F.when(F.size(met) > 0, F.map_concat(F.map_filter(inputs, lambda k, _: k != "terminology_violations"), F.create_map(F.lit("terminology_violations"), F.to_json(met)))).otherwise(inputs)
    rows = turns.withColumn("_l", lint(F.col("reply"))).select(
        "trace_id", "session_id", "channel", F.coalesce("route", F.lit("")).alias("route"), F.coalesce("rule_version", F.lit("")).alias("rule_version"), "guardrail", F.struct("primary", "confidence", "secondary").alias("intent"),
        inputs.alias("decision_inputs"), F.coalesce("handoff_required", F.lit(False)).alias("handoff_required"), at.cast("timestamp").alias("timestamp"),
    )
    return rows.withColumns({c: redacted(F.col(c), rows.schema[c].dataType) for c in ("guardrail", "decision_inputs")})


class Idle(StatefulProcessor):
    """State of a key that goes once the watermark is `idle_ms` past the key's last event; without idle_ms it stays."""

    def __init__(self, idle_ms: int | None = None, time: str = "ts") -> None:
        self.idle_ms, self.time = idle_ms, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.idle_ms is not None:
            self.ends = handle.getValueState("ends", "at long")

    def seen(self, batch: pd.DataFrame) -> None:
        """Put the key's end off to its last event and idle_ms; there is one timer a key."""
        if self.idle_ms is None or batch[self.time].isna().all():
            return
        at = int(batch[self.time].max().timestamp() * 1000) + self.idle_ms
        before = self.ends.get()[0] if self.ends.exists() else None
        if before is None or at > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.ends.update((at,))

    def over(self, timerValues) -> bool:
        """Whether the key's end has passed; rows of a batch come before its timers, so a key that starts anew can still have its old state."""
        if self.idle_ms is None or not self.ends.exists() or self.ends.get()[0] > timerValues.getCurrentWatermarkInMs():
            return False
        self.handle.deleteTimer(self.ends.get()[0])
        self.ends.clear()
        return True

    def close(self) -> None:
        pass


def with_idle(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, idle: str | None, late: str, time: str) -> DataFrame:
    if idle is None:
        return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "None")
    return rows.withWatermark(time, late).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def in_ms(idle: str | None) -> int | None:
    return None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)


class LastBalance(Idle):
    """Per statement: the last balance there was, and a row for each balance that doesn't follow from it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "balance double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("row_no")
        if self.over(timerValues):
            self.last.clear()
        last = self.last.get()[0] if self.last.exists() else None
        found = []
        for r in batch.itertuples():
            if pd.isna(r.balance):
                continue
            if last is not None:
                expected = last - (0 if pd.isna(r.debit) else r.debit) + (0 if pd.isna(r.credit) else r.credit)
                if abs(expected - r.balance) > 0.01:
                    found.append((key[0], r.row_no, round(expected, 2), r.balance))
            last = r.balance
        if last is not None:
            self.last.update((float(last),))
        self.seen(batch)
        yield pd.DataFrame(found, columns=["statement", "row_no", "expected", "balance"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.ends.clear()
        yield pd.DataFrame([], columns=["statement", "row_no", "expected", "balance"])


def balance_break_stream(transactions: DataFrame, idle: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Breaks of the running balance of each statement. transactions: statement, row_no, debit, credit, balance; printed order within a batch.

    With `idle`, transactions have an event time: a statement's state goes once the watermark, `late` behind the latest event, is `idle` past the
    statement's last one; rows behind the watermark are dropped, and a statement that goes on later starts anew.
    Stateful jobs need the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    return with_idle(transactions, "statement", LastBalance(in_ms(idle), time), "statement string, row_no long, expected double, balance double", idle, late, time)


class SessionFlow(Idle):
    """Per session: the last stage, so that an unclear turn is asked about once and then handed off."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.stage = handle.getValueState("stage", "stage string, turn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("turn")
        out = []
        if self.over(timerValues):
            out.append((key[0], self.stage.get()[1], "ended"))
            self.stage.clear()
        stage = self.stage.get()[0] if self.stage.exists() else None
        for r in batch.itertuples():
            action = None if not r.unclear else "hand_off" if stage == "clarifying" else "clarify"
            stage = "clarifying" if r.unclear else "answering"
            out.append((key[0], r.turn, action))
        self.stage.update((stage, int(batch["turn"].iloc[-1])))
        self.seen(batch)
        yield pd.DataFrame(out, columns=["session_id", "turn", "action"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turn = self.stage.get()[1] if self.stage.exists() else None
        self.stage.clear()
        self.ends.clear()
        yield pd.DataFrame([(key[0], turn, "ended")], columns=["session_id", "turn", "action"])


def session_flow_stream(turns: DataFrame, idle: str | None = None, late: str = "5 minutes", time: str = "ts") -> DataFrame:
    """Action of each turn from the stage its session is in. turns: session_id, turn, unclear.

    With `idle`, turns have an event time: a session ends, with a row of its last turn and the action `ended`, once the
    watermark, `late` behind the latest event, is `idle` past its last turn; turns behind the watermark are dropped, and a session that goes on after
    its end starts anew.
    """
    return with_idle(turns, "session_id", SessionFlow(in_ms(idle), time), "session_id string, turn long, action string", idle, late, time)


def daily_rollup(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Count and sum of each day and type by event time; a day is final once the watermark has passed it."""
    day = F.window("ts", "1 day")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(day, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")
