"""Replay of arrivals and pickups at collection points of several bins: what each pickup took from where, and what lay on the street for how long."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

#: Amounts up to this are nothing.
LEAST = 1e-9
MEASURES = ("arrived", "left_in_bin", "left_on_street", "peak_street", "kg_hours", "overflow_hours", "scheduled", "from_street", "from_bin", "unmet", "street_before", "street_after", "bin_before", "bin_after")
ROWS = "kind string, point string, bin string, pickup string, day date, minute double, status string, " + ", ".join(f"{m} double" for m in MEASURES)
SCHEMA = pa.schema([("kind", pa.string()), ("point", pa.string()), ("bin", pa.string()), ("pickup", pa.string()), ("day", pa.date32()), ("minute", pa.float64()), ("status", pa.string()), *((m, pa.float64()) for m in MEASURES)])
DAY = datetime.timedelta(days=1)


class Bin:
    """What one bin holds, what lies beside it, and what this adds up to over a day."""

    def __init__(self, name: str, capacity: float) -> None:
        self.name, self.capacity, self.held, self.street = name, capacity, 0.0, 0.0
        self.begin()

    def begin(self) -> None:
        self.since, self.arrived, self.kg_hours, self.overflow_hours, self.peak = 0.0, 0.0, 0.0, 0.0, self.street

    def until(self, minute: float) -> None:
        hours = (minute - self.since) / 60
        self.kg_hours += self.street * hours
        self.overflow_hours += hours if self.street > LEAST else 0.0
        self.since = minute

    def arrive(self, minute: float, kg: float) -> None:
        self.until(minute)
        into = min(kg, max(self.capacity - self.held, 0.0))
        self.arrived += kg
        self.held += into
        self.street += kg - into
        self.peak = max(self.peak, self.street)


class Point:
    """The bins of one point in order of name, and the day that is worked through."""

    def __init__(self, name: str | None) -> None:
        self.name, self.bins, self.day = name, {}, None

    def days_until(self, day: datetime.date | None) -> Iterator[dict]:
        """End each day before `day` (None: the last one too): a row for each bin and day, without a gap."""
        while self.day is not None and (day is None or self.day < day):
            for b in self.bins.values():
                b.until(1440.0)
                yield {"kind": "day", "point": self.name, "bin": b.name, "day": self.day, "arrived": b.arrived, "left_in_bin": b.held, "left_on_street": b.street, "peak_street": b.peak, "kg_hours": b.kg_hours, "overflow_hours": b.overflow_hours}
                b.begin()
            self.day = None if day is None else self.day + DAY
        self.day = day

    def pick_up(self, pickup: str | None, minute: float, kg: float) -> Iterator[dict]:
        """From the street first, then from the bins, the largest amount first (ties in order of name), until the scheduled amount is taken."""
        left, taken = kg, {"street": 0.0, "held": 0.0}
        before = {k: sum(getattr(b, k) for b in self.bins.values()) for k in taken}
        place = {"kind": "service", "point": self.name, "pickup": pickup, "day": self.day, "minute": minute}
        for source in taken:
            for b in sorted(self.bins.values(), key=lambda b: -getattr(b, source)):
                take = min(getattr(b, source), left)
                if left <= LEAST:
                    break
                if take > LEAST:
                    b.until(minute)
                    was = (b.street, b.held)
                    setattr(b, source, getattr(b, source) - take)
                    left -= take
                    taken[source] += take
                    yield place | {"bin": b.name, "from_street": take if source == "street" else 0.0, "from_bin": take if source == "held" else 0.0, "street_before": was[0], "street_after": b.street, "bin_before": was[1], "bin_after": b.held}
        after = {k: sum(getattr(b, k) for b in self.bins.values()) for k in taken}
        status = "street_remaining" if after["street"] > LEAST else "partial_bin_service" if after["held"] > LEAST else "cleared"
        amounts = {"scheduled": kg, "from_street": taken["street"], "from_bin": taken["held"], "unmet": kg - taken["street"] - taken["held"], "street_before": before["street"], "street_after": after["street"], "bin_before": before["held"], "bin_after": after["held"]}
        yield place | {"kind": "pickup", "status": status} | amounts


def _fold(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Events in order of point and time, worked through one by one; only the bins of one point are held."""
    point, out = None, []
    for batch in batches:
        for name, day, minute, kind, bin_, pickup, kg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if point is None or point.name != name:
                out += point.days_until(None) if point else ()
                point = Point(name)
            if kind == 0:
                point.bins[bin_] = Bin(bin_, kg)
                continue
            if point.day != day:
                for row in point.days_until(day):
                    out.append(row)
                    if len(out) >= rows:
                        yield pa.RecordBatch.from_pylist(out, SCHEMA)
                        out = []
            if kind == 1:
                point.bins[bin_].arrive(minute, kg)
            else:
                out += point.pick_up(pickup, minute, kg)
            if len(out) >= rows:
                yield pa.RecordBatch.from_pylist(out, SCHEMA)
                out = []
    out += point.days_until(None) if point else ()
    yield pa.RecordBatch.from_pylist(out, SCHEMA)


def replay_points(bins: DataFrame, arrivals: DataFrame, pickups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: days (point, bin, day and what arrived, was left, peaked and lay on the street), pickups (and their status), services (each take of a pickup from one bin).

    Arrivals (bin, day, minute, kg) fill their bin to its capacity, then the street beside it; a pickup (pickup, point, day, minute, kg) takes up to its scheduled amount from the streets of the
    point's bins (bin, point, capacity), the largest first, then from the bins, the largest first (ties to the lesser bin). kg_hours is the integral of what lies on the
    street, overflow_hours the time that anything does. Order: (day, minute, arrivals first, pickup, shorter names first).
    A point has a row for each bin and day from its first event to its last; bins of points without events have none.

    Null and negative amounts count as 0, a null minute as the start of the day, a minute past 1440 is an error. Bins without a point or capacity, events of unknown bins or
    points and events without a day are left out; of repeated bins that of the least (point, capacity) counts. Names are returned as text.

    Which bin a pickup empties depends on all that came before, so events are worked through in order: sorted by point and time over all tasks, and folded in one pass with
    the bins of one point in memory, however long its history.
    """
    known = bins.select(F.col("bin").cast("string").alias("bin"), F.col("point").cast("string").alias("point"), F.col("capacity").cast("double").alias("capacity")).dropna().groupBy("bin").agg(F.min(F.struct("point", "capacity")).alias("b")).select("bin", "b.*")
    kg = F.greatest(F.coalesce(F.col("kg").cast("double"), F.lit(0.0)), F.lit(0.0))
    late = F.when(F.col("minute") > 1440, F.raise_error(F.lit("an event after the end of its day")).cast("double"))
    at = [F.col("day").cast("date").alias("day"), F.coalesce(late, F.col("minute").cast("double"), F.lit(0.0)).alias("minute")]
    nobody = F.lit(None).cast("string")
    came = arrivals.filter("day IS NOT NULL").select(F.col("bin").cast("string").alias("bin"), *at, kg.alias("kg")).join(known, "bin").select("point", "day", "minute", F.lit(1).alias("kind"), "bin", nobody.alias("pickup"), "kg")
    went = pickups.filter("day IS NOT NULL").select(F.col("point").cast("string").alias("point"), *at, F.lit(2).alias("kind"), nobody.alias("bin"), F.col("pickup").cast("string").alias("pickup"), kg.alias("kg")).join(known.select("point").distinct(), "point", "left_semi")
    there = known.select("point", F.lit(None).cast("date").alias("day"), F.lit(None).cast("double").alias("minute"), F.lit(0).alias("kind"), "bin", nobody.alias("pickup"), F.col("capacity").alias("kg"))
    order = ["point", F.col("day").asc_nulls_first(), "minute", "kind", "bin", F.length("pickup"), "pickup"]
    events = there.unionByName(came).unionByName(went).repartition("point").sortWithinPartitions(*order)
    out = materialise(events.mapInArrow(_fold, ROWS), "replay")
    days = out.filter("kind = 'day'").select("point", "bin", "day", *MEASURES[:6])
    taken = out.filter("kind = 'pickup'").select("point", "pickup", "day", "minute", "status", *MEASURES[6:])
    services = out.filter("kind = 'service'").select("point", "pickup", "bin", "day", "minute", "from_street", "from_bin", *MEASURES[10:])
    return days, taken, services
