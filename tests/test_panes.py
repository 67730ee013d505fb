"""Dashboards over panes equal looking at every sample of every window."""

import random

import pytest

from probefleet.operators import rates


def brute_increase(samples, step, window):
    out, series = [], {}
    for key, at, value in samples:
        series.setdefault(key, []).append((at, value))
    for key, rows in series.items():
        rows.sort()
        steps = [(at, 0.0 if i == 0 else value if value < rows[i - 1][1] else value - rows[i - 1][1]) for i, (at, value) in enumerate(rows)]
        for at in range(0, rows[-1][0] + window + step, step):
            seen = [s for s in steps if at - window < s[0] <= at]
            if len(seen) > 1:
                out.append((key, at, sum(s[1] for s in seen[1:]), seen[-1][0] - seen[0][0]))
    return sorted(out)


def brute_total(samples, step, lookback):
    out = {}
    for key in {s[0] for s in samples}:
        rows = sorted(s[1:] for s in samples if s[0] == key)
        for at in range(0, rows[-1][0] + lookback + step, step):
            seen = [value for ms, value in rows if at - lookback < ms <= at]
            if seen:
                out[at] = out.get(at, 0.0) + seen[-1]
    return sorted(out.items())


@pytest.fixture(scope="module")
def samples():
    draw, out = random.Random(9), []
    for key in "abc":
        at, value = draw.randrange(50), 0.0
        for _ in range(60):
            # Regular scrapes, long silences, and restarts at 0.
            at += draw.choice([7, 10, 10, 13, 400])
            value = draw.choice([value, value + draw.randrange(5), 1.0])
            out.append((key, at, value))
    return out


@pytest.mark.parametrize("step, window", [(10, 50), (20, 50), (25, 60), (50, 30), (1, 3)])
@pytest.mark.parametrize("chunk", [128, 2])
def test_increase_equals_brute_force(spark, samples, monkeypatch, step, window, chunk):
    monkeypatch.setattr(rates, "_CHUNK_WINDOWS", chunk)
    rows = spark.createDataFrame(samples, "series STRING, scrape_ms BIGINT, value DOUBLE")
    got = rates.counter_increase(rows, ["series"], step, window).collect()
    assert sorted((r.series, r.at_ms, r.increase, r.covered_ms) for r in got) == brute_increase(samples, step, window)


@pytest.mark.parametrize("step, lookback", [(20, 50), (30, 100)])
def test_total_equals_brute_force(spark, samples, step, lookback):
    rows = spark.createDataFrame(samples, "k STRING, scrape_ms BIGINT, value DOUBLE")
    rows = rows.selectExpr("'m' as name", "map('k', k) as labels", "scrape_ms", "value")
    got = rates.counter_total(rows, step, lookback).collect()
    assert sorted((r.at_ms, r.total) for r in got) == brute_total(samples, step, lookback)


@pytest.mark.parametrize("window", [600, 6000])
def test_panes_travel_once(spark, window):
    """A tenfold window leaves the rows that are shuffled as they are, but for copies near the borders of chunks."""
    panes = spark.range(5000).selectExpr("'s' as series", "id * 60 as pane", "1L as n")
    near = rates.with_border(panes, "pane", window * rates._CHUNK_WINDOWS, back=window)
    assert near.count() <= panes.count() * (1 + 2 / rates._CHUNK_WINDOWS) + window / 60
