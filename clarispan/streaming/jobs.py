"""Structured Streaming forms of the quota and publication operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from clarispan.operators.publication import CHANGE, Roles
from clarispan.operators.quotas import DECISION, Allowance


def usage_windows(events: DataFrame, delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Events per visitor and tumbling window (visitor, created); rows later than the watermark drop."""
    counted = events.withWatermark("created", delay).groupBy(F.window("created", window), "visitor").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "visitor", "n")


def distinct_publications(arrivals: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each publication id once, replays within the watermark's delay dropped."""
    return arrivals.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["publication_id"])


class SiteGate(StatefulProcessor):
    """Keyed by site: its accepted turns of the month, in a list, and a timer that empties it when the month is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "created long, event_id string, visitor string, network string")

    def handleInputRows(self, key, rows, timer):
        allowance, out = Allowance(self.turns.get()), []
        for r in pd.concat([*rows]).sort_values(["micros", "event_id"]).itertuples(index=False):
            out.append((key[0], str(r.event_id), r.created, *allowance.admit(int(r.micros), str(r.event_id), str(r.visitor), str(r.network))))
        if allowance.changed:
            self.turns.put(allowance.turns)
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(allowance.after // 1000)
        yield pd.DataFrame(out, columns=_DECISION)

    def handleExpiredTimer(self, key, timer, expired):
        self.turns.clear()
        return iter(())

    def close(self) -> None:
        pass


_DECISION = [f.split(" ")[0] for f in DECISION.split(", ")]


def gate(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Accepts or rejects each event (site, event_id, created, visitor, network) as quotas.replay does, as they arrive. A
    session needs the RocksDB state store."""
    rows = events.select(F.col("site").cast("string").alias("site"), "event_id", "created", F.unix_micros("created").alias("micros"), "visitor", "network").withWatermark("created", delay)
    return rows.groupBy("site").transformWithStateInPandas(SiteGate(), DECISION, "append", "EventTime")


class GenerationRoles(StatefulProcessor):
    """Keyed by source: the active generation and the one before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.two = handle.getValueState("two", "active string, active_date string, rollback string, rollback_date string")

    def handleInputRows(self, key, rows, timer):
        a = self.two.get() if self.two.exists() else (None,) * 4
        roles = Roles(*((name, date) if name is not None else None for name, date in (a[:2], a[2:])))
        out = []
        for r in pd.concat([*rows]).sort_values("arrival").itertuples(index=False):
            out += [(key[0], int(r.arrival), *change) for change in roles.apply(r.action, str(r.generation), r.source_date)]
        self.two.update((*(roles.active or (None, None)), *(roles.rollback or (None, None))))
        yield pd.DataFrame(out, columns=["key", "arrival", "generation", "role"])

    def close(self) -> None:
        pass


def generation_roles(commands: DataFrame) -> DataFrame:
    """Changes of roles as publication.role_changes gives them, as commands arrive."""
    return commands.groupBy("key").transformWithStateInPandas(GenerationRoles(), CHANGE, "append", "none")


def latest_generation(arrivals: DataFrame) -> DataFrame:
    """Newest source date of each key so far; an older arrival is marked as a regression."""
    def fold(key, frames, state):
        newest = state.get[0] if state.exists else None
        rows = pd.concat([*frames]).sort_values("arrival")
        out = []
        for a, d in zip(rows["arrival"], rows["source_date"]):
            late = newest is not None and d < newest
            newest = d if newest is None or d > newest else newest
            out.append((key[0], a, d, late))
        state.update((newest,))
        yield pd.DataFrame(out, columns=["key", "arrival", "source_date", "regression"])

    return arrivals.groupBy("key").applyInPandasWithState(
        fold, "key string, arrival long, source_date string, regression boolean", "newest string", "append", GroupStateTimeout.NoTimeout)


def publish_batches(stream: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs `publish` on each new batch once; a replay of a batch has its old number."""
    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
