"""Usage against quotas."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clarispan.policy import NETWORK_LIMITS, SITE_LIMITS, TURN_COST, VISITOR_LIMITS

MINUTE, DAY = 60_000_000, 86_400_000_000
DECISION = "site string, event_id string, created timestamp, accepted boolean, scope string, limit string, retry_after long"


def usage(events: DataFrame, as_of: Column) -> DataFrame:
    """Per scope and key the events of the current month, day and minute, and the limit that is reached
    first. Events: visitor, network, created."""
    month, day, minute = F.date_trunc("month", as_of), F.date_trunc("day", as_of), as_of - F.expr("INTERVAL 60 SECONDS")
    rows = events.where((F.col("created") >= F.least(month, minute)) & (F.col("created") <= as_of))
    both = rows.select(F.explode(F.array(
        F.struct(F.lit("visitor").alias("scope"), F.col("visitor").cast("string").alias("key")), F.struct(F.lit("network").alias("scope"), F.col("network").cast("string").alias("key")))).alias("s"), "created")
    since = lambda t: F.count_if(F.col("created") >= t)
    g = both.groupBy("s.scope", "s.key").agg(since(month).alias("month"), since(day).alias("day"), since(minute).alias("minute"))
    over = lambda w: F.col(w) >= F.when(F.col("scope") == "visitor", VISITOR_LIMITS[w]).otherwise(NETWORK_LIMITS[w])
    return g.withColumn("reached", F.when(over("month"), "month").when(over("day"), "day").when(over("minute"), "minute").otherwise("none"))


def site_cost(events: DataFrame, as_of: Column) -> DataFrame:
    """Reserved cost of the site this month and day."""
    month, day = F.date_trunc("month", as_of), F.date_trunc("day", as_of)
    rows = events.where((F.col("created") >= month) & (F.col("created") <= as_of))
    return rows.agg((F.count("*") * TURN_COST).alias("month_micro"), (F.count_if(F.col("created") >= day) * TURN_COST).alias("day_micro"))


def sliding(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Most events of a visitor in any window of some seconds that ends with one."""
    w = Window.partitionBy("visitor").orderBy(F.unix_micros("created")).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n", F.count("*").over(w)).groupBy("visitor").agg(F.max("n").alias("most"))


class Allowance:
    """A site's turns so far: what is reserved this month and day, and who reserved in the last minute. Limits are tried in
    the order site, visitor, network, each by month, day and minute; only accepted turns count. Time does not go back: a
    turn older than one before it counts as of that one. Of a month, at most the site's limit of turns is kept."""

    def __init__(self, turns: Iterable[tuple[int, str, str, str]] = ()):
        self.now, self.month, self.day, self.after = -(1 << 62), -(1 << 62), -(1 << 62), 0
        self.counts = {"month": Counter(), "day": Counter(), "minute": Counter()}
        self.recent: deque[tuple[int, str, str, str]] = deque()
        self.turns: list[tuple[int, str, str, str]] = []  # micros, event, visitor, network
        self.events: set[str] = set()
        for turn in turns:
            self._advance(turn[0])
            self._count(turn)
        self.changed = False  # since then

    def _advance(self, t: int) -> None:
        self.now = max(self.now, t)
        if self.now >= self.after:
            at = datetime.fromtimestamp(self.now // 1_000_000, UTC)
            first = datetime(at.year, at.month, 1, tzinfo=UTC)
            self.month = int(first.timestamp()) * 1_000_000
            self.after = int(datetime(at.year + at.month // 12, at.month % 12 + 1, 1, tzinfo=UTC).timestamp()) * 1_000_000
            self.counts["month"].clear()
            self.events.clear()
            self.turns = [x for x in self.turns if x[0] >= self.now - MINUTE]
        day = self.now - self.now % DAY
        if day > self.day:
            self.day = day
            self.counts["day"].clear()
        while self.recent and self.recent[0][0] < self.now - MINUTE:
            self.counts["minute"].subtract(self._keys(self.recent.popleft()))

    @staticmethod
    def _keys(turn: tuple[int, str, str, str]) -> tuple:
        return ("site", ""), ("visitor", turn[2]), ("network", turn[3])

    def _count(self, turn: tuple[int, str, str, str]) -> None:
        for window, since in (("month", self.month), ("day", self.day)):
            if turn[0] >= since:
                self.counts[window].update(self._keys(turn))
        self.counts["minute"].update(self._keys(turn))
        self.recent.append(turn)
        self.turns.append(turn)
        self.events.add(turn[1])
        self.changed = True

    def admit(self, t: int, event: str, visitor: str, network: str) -> tuple[bool, str, str, int]:
        """(accepted, scope, window, seconds after which to try again); a turn that was accepted before is a repeat."""
        self._advance(t)
        if event in self.events:
            return False, "request", "repeat", 0
        for (scope, key), limits in zip(self._keys((t, event, visitor, network)), (SITE_LIMITS, VISITOR_LIMITS, NETWORK_LIMITS)):
            for window in ("month", "day", "minute"):
                used = self.counts[window][scope, key]
                if (used + 1) * TURN_COST > limits.get(window, 1 << 62) if scope == "site" else used >= limits[window]:
                    until = {"month": self.after, "day": self.day + DAY, "minute": self.now + MINUTE}[window]
                    return False, scope, window, max(1, -((self.now - until) // 1_000_000))
        self._count((self.now, event, visitor, network))
        return True, "", "", 0


def decisions(batches: Iterable[pa.RecordBatch], columns: list[str]):
    """Of batches (site, event_id, created in micros, visitor, network) in order of site and time, batches of DECISION."""
    site, allowance = None, Allowance()
    kinds = [pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.bool_(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        out = []
        for s, event, t, visitor, network in zip(*(b.column(i).to_pylist() for i in range(5))):
            if s != site:
                site, allowance = s, Allowance()
            out.append((s, event, t, *allowance.admit(t, event, visitor, network)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], columns)


def replay(events: DataFrame) -> DataFrame:
    """Accepts or rejects each event (site, event_id, created, visitor, network) as if they had arrived in order of time
    (DECISION). A site's turns depend on each other, so a site is one task's stream, which holds its month's accepted
    turns and not its events; sites spread over tasks."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = events.select(text("site"), text("event_id"), F.unix_micros("created").alias("created"), text("visitor"), text("network"))
    rows = rows.repartition("site").sortWithinPartitions("site", "created", "event_id")
    names = [f.split(" ")[0] for f in DECISION.split(", ")]
    return rows.mapInArrow(lambda batches: decisions(batches, names), DECISION)
