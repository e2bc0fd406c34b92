"""The driver's queries over the test tables, one for each operator of the engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fibrelark.functions.columns import count_or_null, day_phase, fec_probabilities, finite, micros, milliwatt_to_dbm, ratio_or_null
from fibrelark.operators import diagnostics, explain
from fibrelark.operators.channels import measurement_channels
from fibrelark.operators.evaluate import Evaluator, policy_table, ranked, tune
from fibrelark.operators.features import summarise
from fibrelark.operators.forest import complete_rows, fit_forest, forest_scores, seeded_sample
from fibrelark.operators.grid import resample
from fibrelark.operators.incidents import latch
from fibrelark.operators.matching import eligible, match_events
from fibrelark.operators.reference import harmonic_fit
from fibrelark.operators.regression import correlation, fitted, least_squares, spearman
from fibrelark.operators.scoring import combined, fit_normalizer
from fibrelark.operators.scans import DAY, lower_cusum
from fibrelark.operators.selection import average_ranks, quantiles
from fibrelark.operators.segments import last_seen, run_length, with_last_seen, with_segments
from fibrelark.operators.splits import TemporalSplit
from fibrelark.plans import views as v
from fibrelark.schema import METRICS, fec_metric
from fibrelark.sources.adapter import TelemetryAdapter
from fibrelark.sources.simulate import ORIGIN, GeneratorConfig, generated_checks, simulate, structural_checks, topology

SPLIT = TemporalSplit(v.TRAIN_END, v.CALIBRATION_END, v.VALIDATION_END, v.END)


def tidy(df: DataFrame) -> DataFrame:
    """Times as microseconds and doubles to six places, so that results compare as plain values."""
    out: list[Column] = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6) + F.lit(0.0)  # no negative zero
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q01_scan_project_filter(spark, sf_dir):
    return v.events(spark, sf_dir).filter((F.col("event_type") == "error") & F.col("value").between(10, 50)).select("event_id", "user_id", "ts", "value")


def q02_adapt_unpivot(spark, sf_dir):
    """Two source columns to canonical rows; missing values stay as rows."""
    native = v.events(spark, sf_dir).select(
        "ts", F.concat_ws("-", F.col("event_type"), F.col("event_id").cast("string")).alias("device"), "value", F.when(F.col("value") > 20, F.col("value") / 2).alias("half")
    )
    adapter = TelemetryAdapter(
        {"value": "rx_power_dbm", "half": "ont_tx_power_dbm"}, {"rx_power_dbm": "dBm", "ont_tx_power_dbm": "dBm"}, {"rx_power_dbm": "gauge", "ont_tx_power_dbm": "gauge"}, "ts", "device"
    )
    return adapter.transform(native)


def q03_unit_mw_to_dbm(spark, sf_dir):
    value = F.col("value") - F.lit(5.0)
    return v.events(spark, sf_dir).select("event_id", milliwatt_to_dbm(value).alias("from_mw"), milliwatt_to_dbm(value, 1000.0).alias("from_w"))


def q04_sanitise_ranges(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    odd = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).when(F.col("l_linenumber") == 4, F.lit(float("inf"))).otherwise(F.col("l_discount") * 12)
    return rows.select(
        "l_orderkey", "l_linenumber", ratio_or_null(finite(odd)).alias("ratio"), count_or_null(finite(F.col("l_quantity") - 5)).alias("counted"), count_or_null(finite(F.col("l_extendedprice"))).alias("price_count")
    )


def q05_duplicate_key_report(spark, sf_dir):
    keyed = v.events(spark, sf_dir).groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.filter("n > 1")


def q06_split_masks(spark, sf_dir):
    part = SPLIT.part(F.col("ts"))
    return v.events(spark, sf_dir).groupBy(part.alias("part"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def q07_resample_mean(spark, sf_dir):
    return v.grid(spark, sf_dir).filter("observed").select("entity_id", "timestamp", "value")


def q08_resample_sum(spark, sf_dir):
    counts = v.events(spark, sf_dir).select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("entity_id"), F.lit(fec_metric("downstream", "total")).alias("metric_name"), F.floor("value").cast("double").alias("value")
    )
    return resample(counts, 45).select("entity_id", "timestamp", "value", "observed")  # 45 minutes divide a day


def q09_grid_complete(spark, sf_dir):
    return v.grid(spark, sf_dir).select("entity_id", "timestamp", "observed")


def q10_pivot_channels(spark, sf_dir):
    """Event types stand in for metrics of one entity; losses are differences of columns."""
    names = {"click": "olt_tx_power_dbm", "error": "rx_power_dbm", "purchase": "ont_tx_power_dbm", "view": "upstream_rx_power_dbm"}
    kinds = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = v.grid(spark, sf_dir).select("timestamp", F.lit("e").alias("entity_id"), F.element_at(kinds, F.col("entity_id")).alias("metric_name"), "value")
    return measurement_channels(rows.filter("metric_name is not null"), list(names.values()))


def q11_fec_log_fraction(spark, sf_dir):
    whole = F.floor(F.col("value"))
    rows = v.events(spark, sf_dir).select("event_id", "ts", whole.alias("total"), F.floor(whole / 7).alias("corrected"), F.floor(whole * F.when(F.col("event_id") % 11 == 0, 2).otherwise(0.1)).alias("lost"))
    wide = rows.select(F.col("ts").alias("timestamp"), F.col("event_id").cast("string").alias("entity_id"), *[F.col(s).cast("double").alias(fec_metric("upstream", k)) for s, k in (("corrected", "corrected"), ("lost", "uncorrectable"), ("total", "total"))])
    metrics = [fec_metric("upstream", k) for k in ("corrected", "uncorrectable", "total")]
    return measurement_channels(wide.unpivot(["timestamp", "entity_id"], metrics, "metric_name", "value"), metrics)


def q12_segment_ids(spark, sf_dir):
    return with_segments(v.long(spark, sf_dir), ["entity_id"], "raw", v.HOUR).select("entity_id", "timestamp", "segment", "pos")


def q13_run_lengths(spark, sf_dir):
    return run_length(v.grid(spark, sf_dir), ["entity_id"], F.col("value") > 50, name="run").select("entity_id", "timestamp", "run")


def q14_last_seen_age(spark, sf_dir):
    rows = v.grid(spark, sf_dir).withColumn("seen", last_seen("value", ["entity_id"]))
    return rows.select("entity_id", "timestamp", ((micros(F.col("timestamp")) - micros(F.col("seen"))) / F.lit(60e6)).alias("age_minutes"))


def q15_harmonic_fit(spark, sf_dir):
    return harmonic_fit(v.long(spark, sf_dir), ["entity_id"], "raw", day_phase(F.col("timestamp")))


def q16_mad_scale(spark, sf_dir):
    return v.references(spark, sf_dir).select("entity_id", "c0", "c1", "c2", "scale")


def q17_residuals(spark, sf_dir):
    return v.residual_rows(spark, sf_dir).select("entity_id", "timestamp", "x")


def _features(*names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: v.features(spark, sf_dir, *names)


q18_level_variability = _features("level", "variability")
q19_regression_slope = _features("regression_slope")
q20_long_and_contrast = _features("long_level", "short_minus_long")
q21_below_baseline = _features("below_baseline_fraction", "error_interval_fraction")
q22_ewma_slope = _features("slope", "late_slope")
q24_lag_one = _features("autocorrelation")
q25_entropy = _features("entropy")
q26_cusum = _features("cusum", "acceleration")


def q23_cov_linear(spark, sf_dir):
    small = v.residual_rows(spark, sf_dir).withColumns({"raw": F.col("raw") / 20, "c0": F.col("c0") / 20})
    return summarise(small, v.SPEC, {"cov"}).drop("channel")


def q27_midrank_normaliser(spark, sf_dir):
    return fit_normalizer(v.events(spark, sf_dir).select(F.round("value", 0).alias("value")), "value", check=False)


def q28_interp_score(spark, sf_dir):
    return v.scored(spark, sf_dir)


def q29_combined_score(spark, sf_dir):
    rows = v.grid(spark, sf_dir).select("entity_id", "timestamp", (F.col("value") / 997).alias("a"), F.when(F.hour("timestamp") != 7, F.lit(0.05)).alias("b"))
    return rows.select("entity_id", "timestamp", combined(F.col("a"), F.col("b")).alias("combined"))


def q30_incidents_latch(spark, sf_dir):
    """The end is in seconds; it is missing while an incident is open."""
    return v.incidents(spark, sf_dir).withColumn("end_time", F.unix_micros("end_time") / 1e6)


def q31_interval_join(spark, sf_dir):
    return eligible(v.incidents(spark, sf_dir), v.faults(spark, sf_dir))


EVALUATOR = Evaluator(interval_minutes=60, minimum_lead_minutes=120.0, opportunity_intervals=3)


def _scope(spark, sf_dir):
    return EVALUATOR.scope(v.incidents(spark, sf_dir), v.faults(spark, sf_dir), v.grid(spark, sf_dir).drop("observed"), v.CALIBRATION_END, v.VALIDATION_END)


def q32_anti_boundary(spark, sf_dir):
    scope = _scope(spark, sf_dir)
    return scope.faults.select("fault_id", F.lit("inside").alias("place")).union(scope.boundary.select("fault_id", F.lit("boundary")))


def q33_semi_duplicates(spark, sf_dir):
    """Every alert as if none were matched: inside a fault of the period, a boundary fault, or none."""
    scope = _scope(spark, sf_dir)
    none = spark.createDataFrame([], "incident_id string")
    return EVALUATOR.alert_classes(scope, none)


def q34_opportunity_runs(spark, sf_dir):
    return EVALUATOR.opportunities(v.faults(spark, sf_dir), v.grid(spark, sf_dir).select("entity_id", "timestamp", "value"))


def q35_match_cardinality(spark, sf_dir):
    pairs = match_events(v.incidents(spark, sf_dir), v.faults(spark, sf_dir))
    return pairs.agg(F.count(F.lit(1)).alias("matched"))


def q36_fault_outcomes(spark, sf_dir):
    scope = _scope(spark, sf_dir)
    return EVALUATOR.outcomes(scope, match_events(scope.alerts, scope.faults, check=False))


def q37_metrics_block(spark, sf_dir):
    metrics, _ = EVALUATOR.evaluate(v.incidents(spark, sf_dir), v.faults(spark, sf_dir), v.grid(spark, sf_dir).drop("observed"), v.CALIBRATION_END, v.VALIDATION_END)
    return metrics


def q38_tune_grid(spark, sf_dir):
    """Incidents of six policies in one plan."""
    policies = policy_table(spark, [1, 2, 3], [3, 6], v.POLICY, ("statistical",)).drop("detector")
    found = latch(v.scored(spark, sf_dir).select("entity_id", "timestamp", "score"), policies)
    return found.groupBy("policy_id").agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("reason") == "recovery").alias("recovered"), F.max("max_score").alias("peak"))


def q39_observation_quality(spark, sf_dir):
    return diagnostics.observation_quality(v.grid(spark, sf_dir).drop("observed"), 60)


def q40_missingness_report(spark, sf_dir):
    native = v.grid(spark, sf_dir).select(F.col("timestamp").alias("time"), F.col("entity_id").alias("device"), "value", F.when(F.hour("timestamp") % 2 == 0, F.col("value")).alias("half"))
    return diagnostics.missingness_report(native)


def q41_describe_percentiles(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    base = rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_quantity").alias("sd"), F.var_samp("l_discount").alias("var")
    )
    prices = quantiles(rows, ["l_returnflag"], "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p99": 0.99})
    return base.join(prices, "l_returnflag").join(quantiles(rows, ["l_returnflag"], "l_quantity", {"q05": 0.05}), "l_returnflag")


def q42_pearson_pairs(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = _table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(1.0))
    pairs = [(a, b) for k, a in enumerate([*columns, "constant"]) for b in [*columns, "constant"][k + 1 :]]
    sums = rows.groupBy("l_returnflag").agg(*[correlation(F.col(a), F.col(b)).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    listed = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"p{k}").alias("pearson")) for k, (a, b) in enumerate(pairs)])
    return sums.select("l_returnflag", F.explode(listed).alias("p")).select("l_returnflag", "p.*")


def q43_spearman_pairs(spark, sf_dir):
    rows = v.events(spark, sf_dir).groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("mean"))
    return spearman(rows, ["event_type"], "n", "mean")


def q44_acf_lags(spark, sf_dir):
    _, acf = diagnostics.dependence_reports(v.grid(spark, sf_dir).drop("observed"), 60, ["rx_power_dbm"])
    return acf.filter("view = 'raw'").drop("view")


def q45_holdout_r2(spark, sf_dir):
    return diagnostics.canonical_statistics(v.grid(spark, sf_dir).drop("observed"), 60).select("entity_id", "observed", "mean", "std", "lag1", "lag_daily", "daily_amplitude", "daily_holdout_r2", "daily_weekly_holdout_r2")


def q46_hourly_profile(spark, sf_dir):
    return diagnostics.hourly_profile(v.grid(spark, sf_dir).drop("observed"))


def q47_context_contrast(spark, sf_dir):
    native = v.grid(spark, sf_dir).select(F.col("timestamp").alias("time"), F.col("entity_id").alias("device"), F.col("value").alias("rx_dbm"))
    return diagnostics.fault_contrasts(native, v.faults(spark, sf_dir))


def q48_structural_checks(spark, sf_dir):
    """Keys, references and order of the order tables, each check one aggregate or anti-join."""
    t = {n: _table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders", "lineitem")}
    n = lambda df: df.agg(F.count(F.lit(1)).alias("bad"))
    lost = lambda a, x, b, y: n(t[a].join(t[b].select(F.col(y).alias("k")), F.col(x) == F.col("k"), "left_anti"))
    checks = {
        "nation_without_region": lost("nation", "n_regionkey", "region", "r_regionkey"),
        "customer_without_nation": lost("customer", "c_nationkey", "nation", "n_nationkey"),
        "order_without_customer": lost("orders", "o_custkey", "customer", "c_custkey"),
        "line_without_order": lost("lineitem", "l_orderkey", "orders", "o_orderkey"),
        "order_twice": n(t["orders"].groupBy("o_orderkey").count().filter("count > 1")),
        "negative_quantity": n(t["lineitem"].filter("l_quantity < 0")),
        "discount_out_of_range": n(t["lineitem"].filter("l_discount < 0 OR l_discount > 1")),
    }
    return reduce(DataFrame.union, [c.select(F.lit(name).alias("check"), "bad", (F.col("bad") == 0).alias("holds")) for name, c in checks.items()])


FOREST_COLUMNS = ["level", "variability", "regression_slope", "below_baseline_fraction", "slope"]


def _forest(spark, sf_dir):
    rows = v.features(spark, sf_dir, *FOREST_COLUMNS)
    return rows, fit_forest(rows.filter(F.col("timestamp") < F.lit(v.CALIBRATION_END)), FOREST_COLUMNS)


def q49_forest_scores(spark, sf_dir):
    rows, forest = _forest(spark, sf_dir)
    return forest_scores(rows, forest, "raw").select("entity_id", "timestamp", "raw")


def q50_topk_and_sample(spark, sf_dir):
    top = v.events(spark, sf_dir).orderBy(F.desc("value"), "event_id").limit(20)
    return top.select("event_id", "event_type", "value")


def q51_shapley_importance(spark, sf_dir):
    rows, forest = _forest(spark, sf_dir)
    there = complete_rows(rows, FOREST_COLUMNS)
    background = seeded_sample(there.filter(F.col("timestamp") < F.lit(v.TRAIN_END)), ["entity_id", "timestamp"], 16, 42)
    wanted = seeded_sample(there.filter(F.col("timestamp") >= F.lit(v.CALIBRATION_END)), ["entity_id", "timestamp"], 32, 42)
    return explain.importance(explain.explain_scores(forest, background, wanted), FOREST_COLUMNS)


def q52_topology(spark, sf_dir):
    return topology(spark, GeneratorConfig())


SMALL_FLEET = GeneratorConfig(entities=4, days=8, interval_minutes=30)


def q53_simulate_telemetry(spark, sf_dir):
    return simulate(spark, SMALL_FLEET)[0]


def q54_fec_probabilities(spark, sf_dir):
    ratios = spark.createDataFrame([(10.0**-k,) for k in range(1, 9)] + [(0.0,), (3e-3,)], "ber double")
    corrected, lost = fec_probabilities(F.col("ber"))
    return ratios.select((F.col("ber") * 1e9).alias("ber_e9"), corrected.alias("corrected"), lost.alias("uncorrectable"), F.when(lost > 0, F.log10(lost)).alias("log10_uncorrectable"))


def q55_simulated_structure(spark, sf_dir):
    native, truth = simulate(spark, SMALL_FLEET)
    return structural_checks(native, truth, topology(spark, SMALL_FLEET))


def q56_average_ranks(spark, sf_dir):
    rows = v.events(spark, sf_dir).select("event_id", "event_type", F.round("value", 0).alias("value"))
    return average_ranks(rows, ["event_type"], "value").select("event_id", "rank")


def q57_least_squares(spark, sf_dir):
    terms = [F.lit(1.0), F.col("l_quantity"), F.col("l_discount")]
    rows = _table(spark, sf_dir, "lineitem")
    fits = least_squares(rows, ["l_returnflag"], "l_extendedprice", terms)
    errors = rows.join(F.broadcast(fits), "l_returnflag").groupBy("l_returnflag").agg(F.avg(F.pow(F.col("l_extendedprice") - fitted(terms), 2)).alias("mse"))
    named = fits.select("l_returnflag", "n", *[F.element_at("beta", k + 1).alias(f"b{k}") for k in range(3)]).join(errors, "l_returnflag")
    return named.select("l_returnflag", "n", *[F.round(c, 2).alias(c) for c in ("b0", "b1", "b2")], F.round(F.sqrt("mse"), 2).alias("rmse"))


def q58_outcome_summary(spark, sf_dir):
    scope = _scope(spark, sf_dir)
    return diagnostics.outcome_summary(EVALUATOR.outcomes(scope, match_events(scope.alerts, scope.faults, check=False)))


def q59_ranked_policies(spark, sf_dir):
    """Ordering of a comparison with missing values last."""
    table = spark.createDataFrame(
        [(True, 0.5, 3.0, "statistical", 2, 3), (True, None, 1.0, "combined", 2, 3), (False, 0.9, None, "combined", 3, 3), (True, 0.5, 2.0, "isolation_forest", 2, 6), (True, 0.5, 2.0, "isolation_forest", 2, 3)],
        "meets_workload_budget boolean, minimum_lead_recall double, nuisance_per_1000_entity_days double, detector string, opening_intervals int, closing_intervals int",
    )
    return ranked(table).select("detector", "opening_intervals", "closing_intervals", "minimum_lead_recall")


def q60_metric_dictionary(spark, sf_dir):
    return spark.createDataFrame([(k, m.unit, m.kind, m.description) for k, m in METRICS.items()], "metric_name string, unit string, kind string, description string")


def q61_error_regimes(spark, sf_dir):
    native = v.events(spark, sf_dir).select(F.floor(F.col("value") / 10).cast("double").alias("tens"), F.floor("value").cast("double").alias("units"))
    return diagnostics.error_regimes(native, ["tens", "units"])


def q62_feature_availability(spark, sf_dir):
    rows = v.features(spark, sf_dir, "level", "slope", "cusum")
    return diagnostics.feature_availability(rows, {"level": ["level"], "trend": ["level", "slope"], "all": ["level", "slope", "cusum"]})


def q64_tune_policies(spark, sf_dir):
    """The whole comparison of detectors and policies: incidents, matching and metrics of every policy, ranked."""
    scores = v.scored(spark, sf_dir).select("entity_id", "timestamp", F.col("score").alias("statistical"))
    scores = scores.withColumns({"isolation_forest": F.pow(F.col("statistical"), 2), "combined": F.when(F.hour("timestamp") != 7, F.col("statistical"))}).persist()
    return tune(
        scores, v.faults(spark, sf_dir), v.grid(spark, sf_dir).drop("observed"), v.CALIBRATION_END, v.VALIDATION_END, EVALUATOR, v.POLICY, [1, 2], [3], 5.0
    )


def q65_healthy_statistics(spark, sf_dir):
    native = v.grid(spark, sf_dir).select(F.col("timestamp").alias("time"), F.col("entity_id").alias("device"), F.lit(0.0).alias("olt_tx_dbm"), (-F.col("value")).alias("rx_dbm"))
    return diagnostics.healthy_statistics(native, 60, 40.0, 3.0, 6.0, 0.5)


def q66_development_faults(spark, sf_dir):
    native = v.grid(spark, sf_dir).select(F.col("timestamp").alias("time"), F.col("entity_id").alias("device"), F.col("value").alias("rx_dbm"))
    return diagnostics.development_faults(v.faults(spark, sf_dir), native, v.VALIDATION_END, 60, 120.0, 3)


def q67_generated_checks(spark, sf_dir):
    native, truth = simulate(spark, SMALL_FLEET)
    return generated_checks(native, truth, topology(spark, SMALL_FLEET), SMALL_FLEET, ORIGIN)


def q68_correlation_views(spark, sf_dir):
    """Correlations of every pair of metrics, raw and without the daily pattern."""
    grid = v.grid(spark, sf_dir).drop("observed")
    other = grid.withColumn("metric_name", F.lit("upstream_rx_power_dbm")).withColumn("value", F.col("value") * 0.5 + F.hour("timestamp"))
    return diagnostics.dependence_reports(grid.unionByName(other), 60, ["rx_power_dbm", "upstream_rx_power_dbm"])[0]


def q69_seeded_sample(spark, sf_dir):
    """A sample that a seeded order of the keys decides."""
    return seeded_sample(v.events(spark, sf_dir).select("event_id", "event_type", "value"), ["event_id"], 16, 42)


def q63_reason_counts(spark, sf_dir):
    return v.incidents(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def q70_segmented_scan(spark, sf_dir):
    """Segments, runs, last seen times and CUSUM of series worked in blocks of a day, by as many tasks."""
    rows = v.long(spark, sf_dir).select("entity_id", "timestamp", ((F.col("raw") - 50) / 10).alias("x"))
    rows = with_segments(rows, ["entity_id"], "x", v.HOUR, block=DAY)
    rows = run_length(rows, ["entity_id"], F.col("x") > 0, block=DAY)
    rows = with_last_seen(rows, ["entity_id"], "x", "seen", block=DAY)
    return lower_cusum(rows, ["entity_id"], "x", 3, 0.25, block=DAY).drop("x")


def q71_latch_in_blocks(spark, sf_dir):
    """The incidents of q30, each entity's history worked in blocks of five days."""
    scores = v.scored(spark, sf_dir).select("entity_id", "timestamp", "score")
    return latch(scores, v.POLICY, 5 * DAY).withColumn("end_time", F.unix_micros("end_time") / 1e6)


def _tidied(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' times mean UTC
        return tidy(query(spark, sf_dir))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _tidied(query) for name, query in sorted(globals().items()) if name[:1] == "q" and name[1:3].isdigit() and callable(query)
}
