"""Series in blocks against the same in one window, exact selection, interval cells and islands against plain versions."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fibrelark.operators import selection
from fibrelark.operators.incidents import MINUTE, Machine, Policy, latch
from fibrelark.operators.matching import meet, with_cells, with_islands
from fibrelark.operators.scans import FAN, lower_cusum, running
from fibrelark.operators.segments import run_length, with_last_seen, with_segments

T0 = datetime(2025, 1, 1, tzinfo=UTC)
BLOCK = 35 * MINUTE  # a few rows


def wandering(spark, seed, n=400):
    """Two series of a fixed step with gaps and missing values."""
    rng = random.Random(seed)
    rows = []
    for entity in ("a", "b"):
        minute = 0
        for _ in range(n):
            minute += rng.choice([5] * 12 + [10, 60, 400])
            rows.append((entity, T0 + timedelta(minutes=minute), rng.choice([None, *(rng.gauss(0, 1) for _ in range(9))])))
    return spark.createDataFrame(rows, "entity_id string, timestamp timestamp, x double")


def told(frame, *names):
    rounded = [F.round(c, 9).alias(c) if frame.schema[c].dataType.simpleString() == "double" else F.col(c) for c in names]
    return sorted([tuple(r) for r in frame.select("entity_id", "timestamp", *rounded).collect()], key=repr)


def no_window_over_whole_series(frame, keys):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line or "windowspecdefinition" in line]
    bare = [line for line in windows if "block" not in line and "wide" not in line]
    return windows and not bare


def test_blocks_equal_whole_windows(spark, monkeypatch):
    monkeypatch.setattr("fibrelark.operators.scans.FAN", 4)
    frame = wandering(spark, 1)
    columns = {
        "total": ("sum", F.col("x")), "most": ("max", F.col("x")), "least": ("min", F.col("x")), "latest": ("last", F.col("x")),
        "earlier": ("before", F.col("x")), "row_before": ("lag", F.col("x")), "pair": ("max", F.when(F.col("x") > 0, F.struct(F.floor("x").alias("k"), (-F.col("x")).alias("v")))),
    }
    whole, parts = running(frame, ["entity_id"], columns), running(frame, ["entity_id"], columns, BLOCK)
    assert parts.columns == whole.columns
    flat = lambda df: df.withColumns({"pair_k": F.col("pair.k"), "pair_v": F.col("pair.v")})
    names = [*[c for c in columns if c != "pair"], "pair_k", "pair_v"]
    assert told(flat(parts), *names) == told(flat(whole), *names)
    assert no_window_over_whole_series(parts, ["entity_id"])
    assert FAN == 256 and running(frame.limit(0), ["entity_id"], columns, BLOCK).count() == 0


def test_segments_runs_and_cusum_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("fibrelark.operators.scans.FAN", 4)
    frame = wandering(spark, 2)

    def work(block):
        out = with_segments(frame, ["entity_id"], "x", 5 * MINUTE, block=block)
        out = run_length(out, ["entity_id"], F.col("x") > 0, F.hour("timestamp") == 7, block=block)
        out = with_last_seen(out, ["entity_id"], "x", "seen", block=block)
        return lower_cusum(out, ["entity_id"], "x", 3, 0.25, block=block)

    got = told(work(BLOCK), "segment", "pos", "run", "seen", "cusum")
    assert got == told(work(None), "segment", "pos", "run", "seen", "cusum")
    # A plain loop.
    rows = {(r.entity_id, r.timestamp): r for r in work(BLOCK).collect()}
    for entity in ("a", "b"):
        state, before, pos, run, seen = 0.0, None, 0, 0, None
        for r in sorted((r for r in rows.values() if r.entity_id == entity), key=lambda r: r.timestamp):
            goes_on = before is not None and r.x is not None and before.x is not None and r.timestamp - before.timestamp == timedelta(minutes=5)
            pos = pos + 1 if goes_on else 0
            run = (0 if r.timestamp.hour == 7 else run) + 1 if r.x is not None and r.x > 0 else 0
            seen = r.timestamp if r.x is not None else seen
            state = max(0.0, state - r.x - 0.25) if r.x is not None and pos >= 3 else 0.0
            assert (r.pos, r.run, r.seen) == (pos, run, seen)
            assert r.cusum == (pytest.approx(state, abs=1e-9) if r.x is not None and pos >= 3 else None)
            before = r


def test_latch_in_blocks_and_for_many_policies(spark, monkeypatch):
    monkeypatch.setattr("fibrelark.operators.scans.FAN", 4)
    rng = random.Random(5)
    rows = []
    for e in range(12):
        minute = 0
        for _ in range(150):
            minute += rng.choice([5, 5, 5, 5, 5, 5, 10, 40, 90])
            rows.append((f"e{e}", minute, rng.choice([None, 0.1, 0.3, 0.6, 0.95, 0.95, 0.97, 0.9, 0.5, 0.2])))
    scores = spark.createDataFrame([(e, T0 + timedelta(minutes=m), s) for e, m, s in rows], "entity_id string, timestamp timestamp, score double")
    policies = [Policy(high, low, o, c, 5, 1.0) for high, low in ((0.9, 0.5), (0.8, 0.3)) for o in (1, 2, 3) for c in (1, 2)]
    table = spark.createDataFrame([(f"p{k}", *[getattr(p, n) for n in Policy.__dataclass_fields__]) for k, p in enumerate(policies)],
        "policy_id string, high double, low double, opening_intervals int, closing_intervals int, interval_minutes int, max_gap_hours double")
    us = lambda t: None if t is None else round((t.replace(tzinfo=UTC) - T0).total_seconds() / 60)
    want = []
    for k, policy in enumerate(policies):
        for e in range(12):
            m, mine = Machine(policy), []
            for entity, minute, score in rows:
                if entity == f"e{e}":
                    mine += m.step(minute * MINUTE, score)
            want += [(f"p{k}", f"e{e}-{n}", s // MINUTE, None if x is None else x // MINUTE, p, why) for n, s, x, p, why in mine + m.active()]
    for block in (None, 50 * MINUTE):
        got = [(r.policy_id, r.incident_id, us(r.start_time), us(r.end_time), r.max_score, r.reason) for r in latch(scores, table, block).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def grouped(spark, seed):
    """Groups with ties, heavy values, outliers, nulls, one value, and none at all."""
    rng = random.Random(seed)
    rows = [("a", rng.gauss(0, 1)) for _ in range(900)] + [("a", None)] * 5
    rows += [("b", rng.choice([1.0, 1.0, 1.0, 2.0, 5.0, rng.random()])) for _ in range(700)]
    rows += [("c", 10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1])) for _ in range(500)]
    rows += [("d", 3.5)] * 400 + [("e", 7.0), ("e", 8.0)] + [("f", None)] * 3 + [(None, float(k % 50)) for k in range(300)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, v double").repartition(3)


@pytest.mark.parametrize("limit", [20, 10_000])
def test_exact_quantiles(spark, limit, monkeypatch):
    monkeypatch.setattr(selection, "GRID", 8)
    frame = grouped(spark, 3)
    shares = {"low": 0.01, "q": 0.31, "mid": 0.5, "high": 0.98, "most": 1.0}
    got = {r.k: tuple(r[n] for n in shares) for r in selection.quantiles(frame, ["k"], "v", shares, limit).collect()}
    want = frame.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()]).collect()
    assert set(got) == {r.k for r in want} and len(got) == 7
    for r in want:
        for n, value in zip(shares, got[r.k], strict=True):
            assert value == (None if r[n] is None else pytest.approx(r[n], rel=1e-12)), (r.k, n)
    assert selection.quantiles(frame.limit(0), ["k"], "v", shares, limit).count() == 0


def test_average_ranks(spark, monkeypatch):
    monkeypatch.setattr(selection, "GRID", 8)
    frame = grouped(spark, 4).withColumn("id", F.monotonically_increasing_id()).cache()
    got = {r.id: r["rank"] for r in selection.average_ranks(frame, ["k"], "v").collect()}
    rows = frame.collect()
    assert len(got) == len(rows)
    by = {}
    for r in rows:
        if r.v is not None:
            by.setdefault(r.k, []).append(r.v)
    for r in rows:
        mine = by.get(r.k, [])
        want = None if r.v is None else sum(x < r.v for x in mine) + (sum(x == r.v for x in mine) + 1) / 2
        assert got[r.id] == want


def test_interval_cells(spark):
    rng = random.Random(8)
    hour = timedelta(hours=1)
    spans = [(k, rng.choice("ab"), T0 + rng.randrange(5000) * hour / 3, timedelta(0)) for k in range(40)]
    spans = [(k, e, s, s + rng.choice([timedelta(0), hour / 7, hour, 30 * hour, 900 * hour, 90_000 * hour])) for k, e, s, _ in spans] + [(90, "a", None, T0), (91, "a", T0 + hour, T0)]
    points = [(n, rng.choice("abc"), T0 + rng.randrange(-100, 9000) * hour / 5) for n in range(300)] + [(n, "a", s) for n, (_, _, s, _) in enumerate(spans[:20], 300)]
    f = spark.createDataFrame(spans, "k int, e string, start timestamp, until timestamp")
    p = spark.createDataFrame(points, "n int, entity string, t timestamp")
    assert with_cells(f, "start", "until").groupBy("k").count().agg(F.max("count")).first()[0] <= 3  # ten years too
    for closed in (False, True):
        got = sorted((r.n, r.k) for r in meet(p, "entity", "t", f, "e", "start", "until", closed).collect())
        assert got == sorted((n, k) for n, a, t in points for k, e, s, u in spans if a == e and s is not None and s <= t and (t <= u if closed else t < u))
    assert meet(p, "entity", "t", f.limit(0), "e", "start", "until").count() == 0


def test_islands_of_overlapping_faults(spark):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [("f1", "a", 0, 5), ("f2", "a", 4, 6), ("f3", "a", 6, 9), ("f4", "a", 7, 30), ("f5", "a", 10, 11), ("f6", "a", 31, 32), ("g", "b", 0, 100)]
    faults = spark.createDataFrame([(f, e, at(s), at(t)) for f, e, s, t in rows], "fault_id string, entity_id string, onset_time timestamp, end_time timestamp")
    islands = {r.fault_id: r.island for r in with_islands(faults).collect()}
    assert islands == {"f1": 1, "f2": 1, "f3": 2, "f4": 2, "f5": 2, "f6": 3, "g": 1}
