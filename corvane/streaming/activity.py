"""Activity of entities kept up to date by a stream of signals; dormancy comes by itself, when event time has passed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.activity import ALIVE, DORMANT_DAYS, ENDED

DAY = 86_400_000
#: Spark's settings for keyed state with timers.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "entity_key long, status string, rule string, at timestamp"


def first_rule(closed: bool, active: int, ended: int, recent_departments: int, silent_days: float) -> tuple[str, str]:
    """(status, rule): the first rule that fires, as of one moment."""
    if closed:
        return "CLOSED", "explicit_closure"
    if not active and ended:
        return "CLOSED", "all_cancelled"
    if recent_departments >= 3 and silent_days < 180:
        return "ACTIVE", "multi_department"
    if active and silent_days >= DORMANT_DAYS:
        return "DORMANT", "dormant"
    return "UNCERTAIN", "none"


class Activity(StatefulProcessor):
    """Of each entity: its latest signal, what its registrations say, and each department's latest signal; one timer for the day it falls dormant.

    A row is given whenever the status differs from the last one given. Signals that come late but within the watermark count, yet never move the latest one back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entity = handle.getValueState("entity", "latest long, active int, ended int, closed boolean, given string")
        self.departments = handle.getMapState("departments", "department string", "latest long")

    def _now(self, key, at: int) -> Iterator[pd.DataFrame]:
        latest, active, ended, closed, given = self.entity.get()
        recent = sum(at - v[0] < 365 * DAY for _, v in self.departments.iterator())
        status, rule = first_rule(closed, active, ended, recent, (at - latest) / DAY)
        if status != given:
            self.entity.update((latest, active, ended, closed, status))
            yield pd.DataFrame({"entity_key": [key[0]], "status": [status], "rule": [rule], "at": [pd.Timestamp(at, unit="ms")]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, active, ended, closed, given = self.entity.get() if self.entity.exists() else (-1, 0, 0, False, "")
        before = latest
        for batch in rows:
            at = batch["ts"].astype("datetime64[ms]").astype("int64")
            latest = max(latest, int(at.max()))
            active, ended = active + int(batch["status"].isin(ALIVE).sum()), ended + int(batch["status"].isin(ENDED).sum())
            closed = closed or bool((batch["formal_closure"].fillna(False).astype(bool) & (batch["signal_type"] == "closure")).any())
            for department, last in at.groupby(batch["department"]).max().items():
                known = self.departments.getValue((department,))[0] if self.departments.containsKey((department,)) else -1
                if last > known:
                    self.departments.updateValue((department,), (int(last),))
        self.entity.update((latest, active, ended, closed, given))
        if latest > before:
            if before >= 0:
                self.handle.deleteTimer(before + DORMANT_DAYS * DAY)
            self.handle.registerTimer(latest + DORMANT_DAYS * DAY)
        yield from self._now(key, max(latest, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._now(key, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def statuses(signals: DataFrame, late: str = "30 days") -> DataFrame:
    """(entity_key, status, rule, at): a row for each change of status. signals: entity_key, department, signal_type, status, formal_closure, ts.

    Event time is the signals' own: when the stream's watermark passes 540 days after an entity's last signal, DORMANT is given without a new signal of it.
    The session needs the settings of STATE.
    """
    rows = signals.select(F.col("entity_key").cast("long"), "department", "signal_type", "status", F.col("formal_closure").cast("boolean"), F.col("ts").cast("timestamp")).filter("entity_key is not null and ts is not null")
    rows = rows.withColumn("department", F.coalesce("department", F.lit("")))
    return rows.withWatermark("ts", late).groupBy("entity_key").transformWithStateInPandas(statefulProcessor=Activity(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
