"""The replay of points against a plain one that steps through all events of a point at once."""

from __future__ import annotations

import datetime
import random
from collections import defaultdict

import pytest

from marlstone.operators.timeline import replay_points

START = datetime.date(2024, 2, 27)
BINS, ARRIVALS, PICKUPS = "bin int, point string, capacity double, kg string", "bin int, day date, minute int, kg double, point string", "pickup int, point string, day date, minute int, kg double, bin int"


def sample(seed: int = 3):
    rng = random.Random(seed)
    bins = [(b, f"p{b % 4}", rng.choice([10.0, 25.0]), "clash") for b in range(11)] + [(20, None, 5.0, None), (21, "p1", None, None), (22, "idle", 5.0, None)]
    day = lambda: START + datetime.timedelta(days=rng.choice([0, 1, 2, 6]))
    arrivals = [(rng.choice([*range(11), 20, 99]), day(), rng.randrange(0, 1441, 30), rng.choice([0.0, 2.0, 7.0, 7.0, None, -3.0]), None) for _ in range(400)]
    pickups = [(i, rng.choice(["p0", "p1", "p2", "p3", "p9"]), day(), rng.randrange(0, 1441, 60), rng.choice([0.0, 5.0, 40.0, 500.0, None]), 1) for i in range(60)]
    arrivals += [arrivals[0], (1, None, 5, 2.0, None), (2, START, None, 9.0, None)]
    return bins, arrivals, pickups


def plain(bins, arrivals, pickups):
    point = {b: (p, c) for b, p, c, _ in bins if p is not None and c is not None}
    events = [(point[b][0], d, m or 0, 0, b, None, max(0.0, k or 0.0)) for b, d, m, k, _ in arrivals if b in point and d]
    events += [(p, d, m or 0, 1, None, i, max(0.0, k or 0.0)) for i, p, d, m, k, _ in pickups if d and p in {x for x, _ in point.values()}]
    days, took, served = {}, {}, defaultdict(float)
    for p in {e[0] for e in events}:
        mine = sorted(b for b in point if point[b][0] == p)
        held, street = dict.fromkeys(mine, 0.0), dict.fromkeys(mine, 0.0)
        own = sorted((e[1:] for e in events if e[0] == p), key=lambda e: (e[0], e[1], e[2], -1 if e[4] is None else e[4]))
        day = own[0][0]
        while day <= own[-1][0]:
            arrived, peak, hours, over, at = dict.fromkeys(mine, 0.0), dict(street), dict.fromkeys(mine, 0.0), dict.fromkeys(mine, 0.0), 0
            for _, m, kind, b, i, kg in [*(e for e in own if e[0] == day), (day, 1440, 2, None, None, 0.0)]:
                for x in mine:
                    hours[x] += street[x] * (m - at) / 60
                    over[x] += (m - at) / 60 * (street[x] > 0)
                at = m
                if kind == 0:
                    into = min(kg, point[b][1] - held[b])
                    arrived[b] += kg
                    held[b] += into
                    street[b] += kg - into
                    peak[b] = max(peak[b], street[b])
                elif kind == 1:
                    left = kg
                    for store, name in ((street, "street"), (held, "bin")):
                        for x in sorted(mine, key=lambda x: (-store[x], str(x))):
                            take = min(left, store[x])
                            store[x] -= take
                            left -= take
                            if take:
                                served[i, x, name] += take
                    took[i] = (kg - left, left, "street_remaining" if sum(street.values()) else "partial_bin_service" if sum(held.values()) else "cleared")
            for x in mine:
                days[str(x), day] = (arrived[x], held[x], street[x], peak[x], hours[x], over[x])
            day += datetime.timedelta(days=1)
    return days, took, dict(served)


@pytest.mark.parametrize("seed", [3, 4])
def test_replay_of_points(spark, seed):
    bins, arrivals, pickups = sample(seed)
    days, taken, services = replay_points(spark.createDataFrame(bins, BINS), spark.createDataFrame(arrivals, ARRIVALS), spark.createDataFrame(pickups, PICKUPS))
    want_days, want_taken, want_services = plain(bins, arrivals, pickups)
    got = {(r.bin, r.day): (r.arrived, r.left_in_bin, r.left_on_street, r.peak_street, r.kg_hours, r.overflow_hours) for r in days.collect()}
    assert set(got) == set(want_days) and all(got[k] == pytest.approx(want_days[k]) for k in got)
    assert {int(r.pickup): (r.from_street + r.from_bin, r.unmet, r.status) for r in taken.collect()} == {k: (pytest.approx(a), pytest.approx(b), s) for k, (a, b, s) in want_taken.items()}
    found = {(int(r.pickup), int(r.bin), "street" if r.from_street else "bin"): r.from_street + r.from_bin for r in services.collect()}
    assert found == pytest.approx(want_services)


def test_no_events_and_late_events(spark):
    bins, arrivals, pickups = (spark.createDataFrame(r, s) for r, s in zip(sample(), (BINS, ARRIVALS, PICKUPS), strict=True))
    assert all(t.isEmpty() for t in replay_points(bins, arrivals.limit(0), pickups.limit(0)))
    assert all(t.isEmpty() for t in replay_points(bins.limit(0), arrivals, pickups))
    with pytest.raises(Exception, match="after the end of its day"):
        replay_points(bins, spark.createDataFrame([(1, START, 1441, 1.0, None)], ARRIVALS), pickups)
