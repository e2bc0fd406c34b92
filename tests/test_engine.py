"""The telemetry engine: contracts, grid, features, detectors, incidents and evaluation on small tables."""

import math
import random
from dataclasses import replace
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fibrelark.functions.columns import fec_probabilities
from fibrelark.operators import diagnostics, explain, forest
from fibrelark.operators.channels import measurement_channels
from fibrelark.operators.evaluate import Evaluator, tune
from fibrelark.operators.features import RX_FEATURES, FeatureSpec, columns_for, feature_table, rx_features
from fibrelark.operators.grid import resample
from fibrelark.operators.incidents import Machine, Policy, check_scores, latch
from fibrelark.operators.matching import match_events
from fibrelark.operators.order import running_total
from fibrelark.operators.reference import fit_references, residuals
from fibrelark.operators.scoring import combined, fit_normalizer, normalize, normalize_in_buckets
from fibrelark.operators.splits import TemporalSplit, split_of
from fibrelark.schema import ContractError, fec_metric
from fibrelark.sources.adapter import TelemetryAdapter, require_downstream_rx, synthetic_adapter
from fibrelark.sources.simulate import ORIGIN, GeneratorConfig, generated_checks, simulate, topology

T0 = datetime(2025, 1, 1, tzinfo=UTC)
RX = "rx_power_dbm"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def telemetry(spark, rows):
    return spark.createDataFrame([(at(m), e, n, v) for m, e, n, v in rows], "timestamp timestamp, entity_id string, metric_name string, value double")


def series(spark, values, entity="a", step=5):
    rows = [(entity, "rx", at(step * k), v, v, 0.0) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity_id string, channel string, timestamp timestamp, raw double, x double, c0 double")


def test_adapter_converts_units_zones_and_ranges(spark):
    native = spark.createDataFrame(
        [("2025-07-01 12:00:00", "u1", 1.0, 5.0), ("2025-07-01 12:05:00", "u1", -1.0, 2.5), ("2025-07-01 12:10:00", "u1", float("nan"), -3.0)], "t string, d string, p double, c double"
    ).withColumn("t", F.col("t").cast("timestamp_ntz"))
    count = fec_metric("upstream", "total")
    adapter = TelemetryAdapter({"p": RX, "c": count}, {RX: "mW", count: "interval_count"}, {RX: "gauge", count: "interval_count"}, "t", "d", "Europe/London")
    rows = {(r.metric_name, r.timestamp.strftime("%H:%M")): r.value for r in adapter.transform(native).collect()}
    assert rows == {(RX, "11:00"): 0.0, (RX, "11:05"): None, (RX, "11:10"): None, (count, "11:00"): 5.0, (count, "11:05"): None, (count, "11:10"): None}


@pytest.mark.parametrize("local", ["2025-03-30 01:30:00", "2025-10-26 01:30:00"])
def test_adapter_refuses_local_times_without_one_meaning(spark, local):
    native = spark.createDataFrame([(local, "u", 1.0)], "t string, d string, p double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    adapter = TelemetryAdapter({"p": RX}, {RX: "dBm"}, {RX: "gauge"}, "t", "d", "Europe/London")
    with pytest.raises(Exception, match="local time"):
        adapter.transform(native, check=False).collect()


def test_adapter_contracts(spark):
    native = spark.createDataFrame([(T0, "u", 1.0), (T0, "u", 2.0)], "t timestamp, d string, p double")
    good = TelemetryAdapter({"p": RX}, {RX: "dBm"}, {RX: "gauge"}, "t", "d")
    with pytest.raises(ContractError, match="duplicate"):
        good.transform(native)
    for bad in (TelemetryAdapter({}, {}, {}), TelemetryAdapter({"q": RX}, {RX: "dBm"}, {RX: "gauge"}, "t", "d"), TelemetryAdapter({"p": RX}, {RX: "C"}, {RX: "gauge"}, "t", "d"), TelemetryAdapter({"p": RX}, {RX: "dBm"}, {RX: "counter"}, "t", "d")):
        with pytest.raises(ContractError):
            bad.transform(native)
    with pytest.raises(ContractError):
        synthetic_adapter(["nothing"])
    with pytest.raises(ContractError, match="b"):
        require_downstream_rx(telemetry(spark, [(0, "a", RX, 1.0), (0, "b", RX, None)]))


def test_bins_close_on_the_right_and_gaps_are_filled(spark):
    total = fec_metric("downstream", "total")
    rows = telemetry(spark, [(0, "a", RX, 1.0), (2, "a", RX, 2.0), (5, "a", RX, 4.0), (16, "a", RX, 8.0), (1, "a", total, 3.0), (2, "a", total, 4.0), (12, "a", total, None)])
    out = {(r.metric_name, r.timestamp): (r.value, r.observed) for r in resample(rows, 5).collect()}
    got = {((t.replace(tzinfo=None) - T0.replace(tzinfo=None)).total_seconds() / 60, m): v for (m, t), v in out.items()}
    assert got == {
        (0, RX): (1.0, True), (5, RX): (3.0, True), (10, RX): (None, False), (15, RX): (None, False), (20, RX): (8.0, True),
        (5, total): (7.0, True), (10, total): (None, False), (15, total): (None, False),
    }
    with pytest.raises(ContractError):
        resample(rows, 0)


def plain_features(x, spec):
    """The features row by row, from their definitions, for one segment without gaps."""
    w, dt, out = spec.window, spec.step_hours, []
    slope = bend = cusum = None
    for k in range(len(x)):
        row = dict.fromkeys(RX_FEATURES)
        if k >= 1:
            d = (x[k] - x[k - 1]) / dt
            slope = d if slope is None else spec.alpha * d + (1 - spec.alpha) * slope
            row["slope"] = slope
        if k >= 2:
            e = ((x[k] - x[k - 1]) - (x[k - 1] - x[k - 2])) / dt**2
            bend = e if bend is None else spec.alpha * e + (1 - spec.alpha) * bend
            row["acceleration"] = bend
        if k >= w:
            cusum = max(0.0, (cusum or 0.0) - x[k] - spec.allowance)
            row["cusum"] = cusum
        if k >= w - 1:
            part, far = np.array(x[k - w + 1 : k + 1]), np.array(x[max(0, k - spec.long_window + 1) : k + 1])
            t = (np.arange(w) - (w - 1) / 2) * dt
            c = part - part.mean()
            linear = 10 ** (part / 10)
            shares = np.histogram(part, [-np.inf, -3, -2, -1, 0, 1, 2, 3, np.inf])[0] / w
            row |= {
                "level": part.mean(), "variability": part.std(), "regression_slope": (t * part).sum() / (t * t).sum(), "long_level": far.mean(),
                "short_minus_long": part.mean() - far.mean(), "below_baseline_fraction": (part < 0).mean(), "cov": linear.std() / linear.mean(),
                "autocorrelation": (c[1:] * c[:-1]).sum() / (c * c).sum(), "entropy": -sum(p * math.log(p) for p in shares if p),
            }
        out.append(row)
    return out


SPEC = FeatureSpec(window=12, long_window_hours=2.0, interval_minutes=5)


def test_features_match_their_definitions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1.5, 150).tolist()
    rows = rx_features(series(spark, x), SPEC).orderBy("timestamp").collect()
    for got, want in zip(rows, plain_features(x, SPEC), strict=True):
        for name in RX_FEATURES:
            assert (got[name] is None) == (want[name] is None), name
            if want[name] is not None:
                assert got[name] == pytest.approx(want[name], abs=1e-9), name


def test_features_start_anew_after_a_gap_and_never_look_ahead(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 60).tolist()
    gap = x[:30] + [None] + x[31:]
    rows = rx_features(series(spark, gap), SPEC).orderBy("timestamp").collect()
    assert all(rows[k]["level"] is None for k in range(30, 42)) and rows[42]["level"] is not None
    assert rows[31]["slope"] is None and rows[32]["slope"] is not None and rows[42]["cusum"] is None and rows[43]["cusum"] is not None
    changed = x[:40] + [99.0] * 20
    before = [r.asDict() for r in rx_features(series(spark, x), SPEC).orderBy("timestamp").limit(40).collect()]
    after = [r.asDict() for r in rx_features(series(spark, changed), SPEC).orderBy("timestamp").limit(40).collect()]
    assert before == after


def test_feature_sets_are_nested(spark):
    assert [len(columns_for(s)) for s in ("rx_only", "both_rx", "tx_rx", "fec", "temperature")] == [12, 18, 30, 46, 52]
    base = series(spark, [float(k % 7) for k in range(30)])
    both = base.unionByName(base.withColumn("channel", F.lit("upstream_rx")))
    rows = feature_table(both, SPEC, "both_rx").orderBy("timestamp").collect()
    assert rows[0].__fields__[2:] == columns_for("both_rx")
    assert rows[11]["upstream_rx_slope"] is None and rows[12]["upstream_rx_slope"] == pytest.approx(rows[12]["slope"])
    assert rows[20]["upstream_rx_level"] == pytest.approx(rows[20]["level"])


def test_columns_keep_the_fixed_order():
    assert RX_FEATURES[:6] == ["cov", "autocorrelation", "cusum", "entropy", "acceleration", "slope"]
    assert RX_FEATURES[6:] == ["level", "variability", "regression_slope", "long_level", "short_minus_long", "below_baseline_fraction"]
    with pytest.raises(ContractError, match="three rows"):
        FeatureSpec(window=2)


def test_feature_table_is_joined_one_to_one(spark):
    base = series(spark, [float(k % 7) for k in range(15)])
    both = base.unionByName(base.withColumn("channel", F.lit("upstream_rx")))
    for channel in ("rx", "upstream_rx"):
        with pytest.raises(Exception, match="repeated rows of a channel"):
            feature_table(both.unionByName(base.withColumn("channel", F.lit(channel)).limit(1)), SPEC, "both_rx").collect()


def test_the_latch_refuses_replays_and_scores_out_of_range(spark):
    policy = Policy(high=0.95, low=0.2, opening_intervals=3, closing_intervals=2)
    rows = [(at(5 * k), "a", s) for k, s in enumerate([0.99, 0.5, None, 0.1])]
    of = lambda more: latch(spark.createDataFrame(rows + more, "timestamp timestamp, entity_id string, score double"), policy)
    assert of([(at(20), "a", float("nan"))]).collect() == []
    with pytest.raises(Exception, match="replayed"):
        of([(at(5), "a", 0.3)]).collect()
    for score in (1.5, -0.1):
        with pytest.raises(Exception, match="0..1"):
            of([(at(20), "a", score)]).collect()


def test_what_a_generator_promises_is_checked(spark):
    config = GeneratorConfig(entities=2, days=8, interval_minutes=60)
    native, truth = simulate(spark, config)
    native, truth, units = native.cache(), truth.cache(), topology(spark, config)
    check = lambda n, t: {r.check: r.holds for r in generated_checks(n, t, units, config, ORIGIN).collect()}
    assert all(check(native, truth).values())
    last = native.agg(F.max("time")).first()[0]
    broken = check(native.filter((F.col("time") < F.lit(last)) | (F.col("device") != "ONT-000")), truth.union(truth.limit(1)))
    assert not broken["configured_rows_per_entity"] and not broken["unique_fault_ids"] and broken["ordered_fixed_cadence"] and broken["configured_entity_count"]
    moved = check(native.withColumn("time", F.expr("time + interval 1 minute")), truth.withColumn("observable_onset_time", F.col("end_time")))
    assert not moved["ordered_fixed_cadence"] and not moved["observable_onset_inside_fault"]
    assert not check(native.filter("device = 'ONT-000'"), truth)["configured_entity_count"]
    assert not check(native.withColumn("time", F.expr("if(device = 'ONT-000' and minute(time) = 0 and hour(time) = 5, null, time)")), truth)["timestamps_present"]


def test_references_recover_a_daily_cycle(spark):
    hours = np.arange(0, 24 * 4, 0.5)
    y = 10 + 2 * np.sin(2 * np.pi * hours / 24) - 1 * np.cos(2 * np.pi * hours / 24)
    rows = [("a", "rx", at(30 * k), float(v)) for k, v in enumerate(y)] + [("short", "rx", at(30 * k), 1.0) for k in range(50)]
    long = spark.createDataFrame(rows, "entity_id string, channel string, timestamp timestamp, raw double")
    refs = fit_references(long, 12, 30)
    r = refs.collect()
    assert len(r) == 1 and (r[0].c0, r[0].c1, r[0].c2) == pytest.approx((10, 2, -1), abs=1e-9) and r[0].scale == 0.05
    out = residuals(long, refs)
    assert out.filter("entity_id = 'short' AND x IS NOT NULL").count() == 0
    assert out.filter("entity_id = 'a'").agg(F.max(F.abs("x"))).first()[0] < 1e-6
    with pytest.raises(ContractError):
        fit_references(long, 12, 30, strict=True)


def test_channels_and_contradicting_counts(spark):
    names = {k: fec_metric("downstream", k) for k in ("corrected", "uncorrectable", "total")}
    rows = [(0, "a", RX, -20.0), (0, "a", "olt_tx_power_dbm", 3.0)]
    for minute, (c, u, t) in enumerate([(8, 1, 10), (8, 3, 10), (8, None, 10), (0, 0, 0)], 1):
        rows += [(minute, "a", names[k], None if x is None else float(x)) for k, x in zip(names, (c, u, t), strict=True)]
    out = measurement_channels(telemetry(spark, rows), [RX, "olt_tx_power_dbm", *names.values()]).orderBy("timestamp").collect()
    assert out[0].downstream_loss == 23.0 and "upstream_loss" not in out[0].__fields__
    assert [r.downstream_fec_corrected for r in out[1:]] == [pytest.approx(math.log1p(0.8e6)), None, pytest.approx(math.log1p(0.8e6)), None]


def test_code_probabilities(spark):
    rows = spark.createDataFrame([(0.0,), (1e-5,), (1e-3,), (1.0,)], "b double")
    corrected, lost = fec_probabilities(F.col("b"))
    out = rows.select(corrected.alias("c"), lost.alias("u")).collect()
    assert (out[0].c, out[0].u, out[3].c, out[3].u) == (0.0, 0.0, 0.0, 1.0)
    p = 1 - (1 - 1e-3) ** 8
    tail = [math.comb(255, k) * p**k * (1 - p) ** (255 - k) for k in range(256)]
    assert out[2].c == pytest.approx(sum(tail[1:9]), rel=1e-9) and out[2].u == pytest.approx(sum(tail[9:]), rel=1e-9)


def test_normalizer_both_ways(spark):
    rng = random.Random(2)
    scores = spark.createDataFrame([(float(rng.randrange(300)),) for _ in range(900)], "s double")
    knots = fit_normalizer(scores, "s")
    asked = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (0.5,), (150.25,), (1e9,)] + [(float(k),) for k in range(0, 300, 7)], "s double")
    a = {r.s: r.r for r in normalize(asked, "s", knots, "r").filter("s is not null and not isnan(s)").collect()}
    b = {r.s: r.r for r in normalize_in_buckets(asked, "s", knots, "r").filter("s is not null and not isnan(s)").collect()}
    assert a == pytest.approx(b) and a[-1.0] == 0 and a[1e9] == 1 and 0 < a[150.25] < 1
    assert normalize(asked, "s", knots, "r").filter("r is null").count() == 2
    counts = scores.groupBy("s").count()
    totals = sorted((r.s, r.t) for r in running_total(counts, "s", "count", "t").collect())
    assert totals[-1][1] == 900 and all(x[1] < y[1] for x, y in zip(totals, totals[1:], strict=False))
    with pytest.raises(ContractError):
        fit_normalizer(scores.limit(50), "s")
    row = spark.range(1).select(combined(F.lit(0.2), F.lit(0.7)).alias("a"), combined(F.lit(0.2), F.lit(None).cast("double")).alias("b")).first()
    assert row.a == 0.7 and row.b is None


POLICY = Policy(0.9, 0.5, 2, 3, 5, 1.0)


def machine_rows(rows, policy):
    out, state = [], {}
    for entity, minute, score in sorted(rows, key=lambda r: (r[0], r[1])):
        m = state.setdefault(entity, Machine(policy))
        out += [(entity, *e) for e in m.step(minute, score)]
    for entity, m in state.items():
        out += [(entity, *e) for e in m.active()]
    return sorted(out, key=lambda e: (e[0], e[1]))


def test_latch_equals_the_row_by_row_machine(spark):
    rng = random.Random(9)
    rows = []
    for e in range(60):
        minute = 0
        for _ in range(70):
            minute += rng.choice([5, 5, 5, 5, 10, 40, 90])
            rows.append((f"e{e}", minute, rng.choice([None, 0.1, 0.3, 0.6, 0.95, 0.95, 0.97, 0.9, 0.5])))
    frame = spark.createDataFrame([(e, at(m), s) for e, m, s in rows], "entity_id string, timestamp timestamp, score double")
    us = lambda t: None if t is None else round((t.replace(tzinfo=UTC) - T0).total_seconds() / 60)
    got = sorted((r.entity_id, int(r.incident_id.rsplit("-", 1)[1]), us(r.start_time), us(r.end_time), r.max_score, r.reason) for r in latch(frame, POLICY).collect())
    minute = 60_000_000
    want = [(e, n, s // minute, None if x is None else x // minute, p, why) for e, n, s, x, p, why in machine_rows([(e, m * minute, s) for e, m, s in rows], POLICY)]
    assert got == want and {w[-1] for w in want} == {"recovery", "telemetry_gap", "active"}


def test_machine_rules():
    m = Machine(POLICY)
    minute = 60_000_000
    assert m.step(5 * minute, 0.9) == [] and m.high == 0  # strictly above
    m.step(10 * minute, 0.95)
    m.step(15 * minute, None)
    assert m.high == 0
    with pytest.raises(ContractError):
        m.step(15 * minute, 0.5)
    with pytest.raises(ContractError):
        m.step(20 * minute, 1.5)
    with pytest.raises(ContractError):
        Policy(0.5, 0.5)


def test_score_contracts(spark):
    frame = spark.createDataFrame([("a", T0, 0.5), ("a", T0, 0.6)], "entity_id string, timestamp timestamp, score double")
    with pytest.raises(ContractError, match="replayed"):
        check_scores(frame)
    with pytest.raises(ContractError, match="0..1"):
        check_scores(frame.limit(1).withColumn("score", F.lit(2.0)))


FAULT = "fault_id string, entity_id string, fault_type string, onset_time timestamp, observable_onset_time timestamp, impact_time timestamp, end_time timestamp"
ALERT = "incident_id string, entity_id string, start_time timestamp"


def test_matching_is_as_large_as_can_be(spark):
    rng = random.Random(5)
    faults, alerts, sizes = [], [], {}
    for e in range(25):
        f = [(f"f{e}-{k}", rng.randrange(0, 60)) for k in range(rng.randrange(1, 7))]
        f = [(name, a, a + rng.randrange(1, 30)) for name, a in f]
        s = [(f"a{e}-{k}", rng.randrange(0, 90)) for k in range(rng.randrange(1, 7))]
        faults += [(n, f"e{e}", "exponential", at(a), at(a), None, at(b)) for n, a, b in f]
        alerts += [(n, f"e{e}", at(t)) for n, t in s]
        free, best = list(f), 0
        for _, t in sorted(s, key=lambda x: x[1]):  # earliest end first is optimal for the size
            hits = [x for x in free if x[1] <= t < x[2]]
            if hits:
                free.remove(min(hits, key=lambda x: x[2]))
                best += 1
        sizes[f"e{e}"] = best
    a, f = spark.createDataFrame(alerts, ALERT), spark.createDataFrame(faults, FAULT)
    got = match_events(a, f).collect()
    count = {}
    for r in got:
        count[r.entity_id] = count.get(r.entity_id, 0) + 1
    assert {e: n for e, n in sizes.items() if n} == count
    assert len({r.incident_id for r in got}) == len({r.fault_id for r in got}) == len(got)
    with pytest.raises(ContractError):
        match_events(a.union(a), f)


def test_evaluation_counts(spark):
    step = 5
    rows = telemetry(spark, [(step * k, "a", RX, 1.0 if k % 50 else None) for k in range(288)])
    truth = spark.createDataFrame(
        [("f1", "a", "exponential", at(100), at(100), at(300), at(400)), ("f2", "a", "variance_shift", at(600), None, at(700), at(800)), ("f3", "a", "exponential", at(1400), at(1400), None, at(2000))], FAULT
    )
    alerts = spark.createDataFrame([("i1", "a", at(270)), ("i2", "a", at(280)), ("i3", "a", at(500)), ("i4", "a", at(1410)), ("i5", "a", at(671))], ALERT)
    metrics, outcomes = Evaluator(5, 30.0, 3).evaluate(alerts, truth, rows, at(0), at(1440))
    m = metrics.first()
    assert (m.faults, m.detected, m.missed, m.boundary_faults) == (2, 2, 0, 1)
    assert (m.duplicate_incidents, m.unmatched_incidents, m.boundary_incidents, m.incidents) == (1, 1, 1, 5)
    assert m.nuisance_per_1000_entity_days == pytest.approx(2000) and m.monitored_entity_days == pytest.approx(1.0)
    assert m.observation_coverage == pytest.approx(1 - 6 / 288)
    found = {r.fault_id: r for r in outcomes.collect()}
    assert found["f1"].lead_minutes == 30 and found["f1"].minimum_lead and found["f1"].opportunity
    assert found["f2"].lead_minutes == 29 and not found["f2"].minimum_lead and found["f2"].delay_reference == "onset_time"
    with pytest.raises(ContractError):
        Evaluator().evaluate(alerts, truth, rows, at(5), at(5))


def test_a_grid_of_policies_is_evaluated_like_each_alone(spark):
    rng = random.Random(3)
    scores = [(at(5 * k), e, rng.choice([0.1, 0.5, 0.97, 0.99, None])) for e in ("a", "b") for k in range(200)]
    scores = spark.createDataFrame(scores, "timestamp timestamp, entity_id string, statistical double")
    scores = scores.withColumns({"isolation_forest": F.col("statistical") * 0.99, "combined": F.col("statistical")}).cache()
    rows = telemetry(spark, [(5 * k, e, RX, 1.0) for e in ("a", "b") for k in range(200)])
    truth = [(f"f{k}", "ab"[k % 2], "exponential", at(60 * k), at(60 * k), at(60 * k + 50), at(60 * k + 110)) for k in range(15)]
    truth = spark.createDataFrame(truth, FAULT)
    evaluator, base = Evaluator(5, 10.0, 2), Policy(high=0.95, low=0.3, opening_intervals=1, closing_intervals=1)
    table = tune(scores, truth, rows, at(0), at(900), evaluator, base, [1, 2], [2], 5000.0).collect()
    assert len(table) == 6 and [r.meets_workload_budget for r in table] == sorted((r.meets_workload_budget for r in table), reverse=True)
    for r in table:
        if r.detector == "isolation_forest":
            continue
        policy = replace(base, opening_intervals=r.opening_intervals, closing_intervals=r.closing_intervals)
        alone = latch(scores.select("timestamp", "entity_id", F.col(r.detector).alias("score")), policy)
        own = evaluator.evaluate(alone, truth, rows, at(0), at(900))[0].first().asDict()
        assert {k: r[k] for k in own} == own
        assert r.telemetry_gap_closures == alone.filter("reason = 'telemetry_gap'").count()
    with pytest.raises(ContractError, match="monitoring"):
        tune(scores, truth, rows.union(rows.limit(1)), at(0), at(900), evaluator, base, [1], [2], 5.0)


def test_splits_are_half_open(spark):
    split = split_of(T0, 10)
    ends = [split.train_end, split.calibration_end, split.validation_end, split.test_end]
    rows = spark.createDataFrame([(e + timedelta(microseconds=d),) for e in ends for d in (-1, 0)], "t timestamp")
    parts = [r.p for r in rows.orderBy("t").select(split.part(F.col("t")).alias("p")).collect()]
    assert parts == ["train", "calibration", "calibration", "validation", "validation", "test", "test", None]
    with pytest.raises(ContractError):
        TemporalSplit(T0, T0, T0, T0)
    with pytest.raises(ContractError):
        split_of(T0, 10, (0.4, 0.6, 0.75, 1.0))


def test_forest_ranks_outliers_and_explains_them(spark):
    rng = np.random.default_rng(6)
    rows = [("e", at(k), float(a), float(b)) for k, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    frame = spark.createDataFrame([*rows, ("far", at(1000), 9.0, -9.0), ("none", at(1001), None, 1.0)], "entity_id string, timestamp timestamp, u double, w double")
    fitted = forest.fit_forest(frame, ["u", "w"])
    again = forest.fit_forest(frame.repartition(5), ["u", "w"])
    scored = {(r.entity_id, r.timestamp): r.raw for r in forest.forest_scores(frame, fitted).collect()}
    assert scored == {(r.entity_id, r.timestamp): r.raw for r in forest.forest_scores(frame, again).collect()}
    far = next(v for (e, _), v in scored.items() if e == "far")
    there = [v for v in scored.values() if v is not None]
    assert far == max(there) and 0 < min(there) < max(there) <= 1 and sum(v is None for v in scored.values()) == 1
    loaded = forest.IsolationForest.from_table(fitted.to_table(spark), ["u", "w"], fitted.subsample)
    x = np.array([[0.0, 0.0], [5.0, 5.0]])
    assert loaded.raw(x).tolist() == fitted.raw(x).tolist()
    out = explain.explain_scores(fitted, frame.limit(16), frame.filter("entity_id = 'far'")).first()
    assert out.reconstructed_score == pytest.approx(out.raw_anomaly_score) and out.raw_anomaly_score == pytest.approx(far)
    with pytest.raises(ContractError):
        forest.fit_forest(frame.limit(50), ["u", "w"])


def test_quality_and_missing_runs(spark):
    values = [1.0, None, None, 2.0, 3.0, None]
    rows = telemetry(spark, [(5 * k, "a", RX, v) for k, v in enumerate(values)])
    out = diagnostics.observation_quality(rows, 5, window=2).orderBy("timestamp").collect()
    assert [r.missing_run_intervals for r in out] == [0, 1, 2, 0, 0, 1]
    assert [r.minutes_since_observation for r in out] == [0, 5, 10, 0, 0, 5]
    assert [r.recent_observed_fraction for r in out] == [None, 0.5, 0, 0.5, 1, 0.5]
    native = rows.select(F.col("timestamp").alias("time"), F.col("entity_id").alias("device"), "value")
    report = diagnostics.missingness_report(native).first()
    assert (report["rows"], report.observed, report.longest_missing_intervals, report.unique_observed_values) == (6, 3, 2, 3)
