"""Event evaluation: scope, opportunities, outcomes, alert classes, metrics, policy comparison."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fibrelark.functions.columns import finite
from fibrelark.operators.incidents import Policy, latch
from fibrelark.operators.matching import eligible, match_events, meet
from fibrelark.schema import ContractError

MINUTE = 60_000_000
REFERENCES = {"observable": "observable_onset_time", "physical_onset": "onset_time"}


@dataclass(frozen=True)
class Scope:
    """What an evaluation period holds."""

    alerts: DataFrame
    faults: DataFrame
    boundary: DataFrame
    available: DataFrame


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


@dataclass(frozen=True)
class Evaluator:
    interval_minutes: int = 5
    minimum_lead_minutes: float = 30.0
    opportunity_intervals: int = 3

    def __post_init__(self) -> None:
        if self.interval_minutes < 1 or self.minimum_lead_minutes < 0 or self.opportunity_intervals < 1:
            raise ContractError("interval and opportunity must be positive, the lead not negative")

    def scope(self, incidents: DataFrame, truth: DataFrame, telemetry: DataFrame, start: datetime, end: datetime, check: bool = True) -> Scope:
        """Alerts that start in [start, end), faults wholly inside, faults that only overlap, and monitoring rows."""
        if start >= end:
            raise ContractError("the period must end after it starts")
        low, high = F.lit(start), F.lit(end)
        alerts = incidents.filter((F.col("start_time") >= low) & (F.col("start_time") < high))
        faults = truth.filter((F.col("onset_time") >= low) & (F.col("end_time") <= high))
        overlapping = truth.filter((F.col("onset_time") < high) & (F.col("end_time") > low))
        boundary = overlapping.join(faults.select("fault_id"), "fault_id", "left_anti")
        rows = telemetry.filter((F.col("metric_name") == "rx_power_dbm") & (F.col("timestamp") >= low) & (F.col("timestamp") < high))
        available = rows.select("entity_id", "timestamp", finite(F.col("value")).alias("value"))
        if check and available.groupBy("entity_id", "timestamp").count().filter("count > 1").limit(1).count():
            raise ContractError("repeated monitoring rows")
        return Scope(alerts, faults, boundary, available)

    def opportunities(self, faults: DataFrame, available: DataFrame) -> DataFrame:
        """fault_id of the faults with enough readings in a row between their reference and the last useful warning."""
        reference = F.when(F.col("fault_type") == "variance_shift", F.col("onset_time")).otherwise(F.col("observable_onset_time"))
        deadline = F.timestamp_micros(F.unix_micros("impact_time") - F.lit(int(self.minimum_lead_minutes * MINUTE)))
        spans = faults.select("fault_id", F.col("entity_id").alias("e"), reference.alias("from"), deadline.alias("until")).filter("from <= until")
        a = meet(available, "entity_id", "timestamp", spans, "e", "from", "until", closed=True)
        order = Window.partitionBy("fault_id").orderBy("timestamp")
        us = F.unix_micros("timestamp")
        held = F.col("value").isNotNull()
        gap = F.coalesce(us - F.lag(us).over(order) > F.lit(int(1.5 * self.interval_minutes * MINUTE)), F.lit(True))
        work = a.withColumn("island", F.sum((gap | ~held).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        runs = work.filter(held).groupBy("fault_id", "island").count()
        return runs.filter(F.col("count") >= self.opportunity_intervals).select("fault_id").distinct()

    def outcomes(self, scope: Scope, matches: DataFrame, chances: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        """One row for each fault of the period."""
        chances = (self.opportunities(scope.faults, scope.available) if chances is None else chances).withColumn("opportunity", F.lit(True))
        alerts = scope.alerts.select("incident_id", "start_time")
        joined = scope.faults.join(matches.select("fault_id", "incident_id"), "fault_id", "left").join(alerts, "incident_id", "left").join(chances, "fault_id", "left")
        shift = F.col("fault_type") == "variance_shift"
        kind = F.when(shift, "onset_time").otherwise("observable_onset_time")
        base = F.when(shift, F.col("onset_time")).otherwise(F.col("observable_onset_time"))
        minutes = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / F.lit(60e6)
        early = F.coalesce(F.col("start_time") < F.col("impact_time"), F.lit(False))
        lead = minutes(F.col("impact_time"), F.col("start_time"))
        return joined.select(
            *by,
            "fault_id",
            "fault_type",
            F.col("incident_id").isNotNull().alias("detected"),
            F.coalesce("opportunity", F.lit(False)).alias("opportunity"),
            kind.alias("opportunity_reference"),
            early.alias("pre_impact"),
            F.col("impact_time").isNotNull().alias("impacting"),
            lead.alias("lead_minutes"),
            (early & (lead >= self.minimum_lead_minutes)).alias("minimum_lead"),
            minutes(F.col("start_time"), base).alias("delay_minutes"),
            kind.alias("delay_reference"),
        )

    def alert_classes(self, scope: Scope, matches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """incident_id and class: matched, duplicate (in a fault of the period), boundary, or unmatched."""
        within = lambda table: eligible(scope.alerts, table).select("incident_id").distinct()
        out = scope.alerts.select(*by, "incident_id")
        for name, ids in (("m", matches.select("incident_id").distinct()), ("d", within(scope.faults)), ("b", within(scope.boundary))):
            out = out.join(ids.withColumn(name, F.lit(True)), "incident_id", "left")
        kind = F.when(F.col("m"), "matched").when(F.col("d"), "duplicate").when(F.col("b"), "boundary").otherwise("unmatched")
        return out.select(*by, "incident_id", kind.alias("class"))

    def metrics(self, scope: Scope, outcomes: DataFrame, classes: DataFrame, groups: DataFrame | None = None) -> DataFrame:
        """Counts, recalls and workload: one row, or one for each row of ``groups``; a ratio over nothing is NULL."""
        by = [] if groups is None else groups.columns
        n = F.count(F.lit(1))
        hits = lambda c: F.count_if(c)
        chance, early, timely = F.col("opportunity"), F.col("pre_impact"), F.col("minimum_lead")
        observable = F.col("delay_reference") == "observable_onset_time"
        by_reference = [
            c
            for name, column in REFERENCES.items()
            for c in (
                hits(chance & (F.col("opportunity_reference") == column)).alias(f"{name}_warning_opportunities"),
                hits(chance & early & (F.col("opportunity_reference") == column)).alias(f"{name}_pre_impact_detected"),
            )
        ]
        of_faults = outcomes.groupBy(*by).agg(
            n.alias("faults"),
            hits(F.col("detected")).alias("detected"),
            hits(chance).alias("warning_opportunities"),
            hits(chance & early).alias("pre_impact_detected"),
            hits(chance & timely).alias("minimum_lead_detected"),
            hits(F.col("impacting")).alias("impacting_faults"),
            hits(F.col("impacting") & early).alias("all_early"),
            F.median(F.when(observable, F.col("delay_minutes"))).alias("median_detection_delay_minutes"),
            F.median(F.when(~observable, F.col("delay_minutes"))).alias("median_variance_onset_delay_minutes"),
            *by_reference,
        )
        of_alerts = classes.groupBy(*by).agg(
            n.alias("incidents"),
            hits(F.col("class") == "unmatched").alias("unmatched_incidents"),
            hits(F.col("class") == "duplicate").alias("duplicate_incidents"),
            hits(F.col("class") == "boundary").alias("boundary_incidents"),
        )
        of_rows = scope.available.agg(
            (n * F.lit(self.interval_minutes / 1440)).alias("monitored_entity_days"),
            F.avg(F.col("value").isNotNull().cast("double")).alias("observation_coverage"),
        )
        edges = scope.boundary.groupBy(*by).agg(n.alias("boundary_faults"))
        if groups is None:
            row = of_faults.crossJoin(of_alerts).crossJoin(of_rows).crossJoin(edges)  # four tables of one row
        else:
            row = groups.join(of_faults, by, "left").join(of_alerts, by, "left").join(edges, by, "left").crossJoin(F.broadcast(of_rows))
            row = row.fillna(0, subset=[k for k, kind in row.dtypes if kind == "bigint"])
        c = F.col
        return row.select(
            *by,
            "faults",
            "detected",
            (c("faults") - c("detected")).alias("missed"),
            "warning_opportunities",
            (c("faults") - c("warning_opportunities")).alias("faults_without_warning_opportunity"),
            "pre_impact_detected",
            _ratio(c("pre_impact_detected"), c("warning_opportunities")).alias("pre_impact_recall"),
            F.lit(float(self.minimum_lead_minutes)).alias("minimum_lead_minutes"),
            "minimum_lead_detected",
            _ratio(c("minimum_lead_detected"), c("warning_opportunities")).alias("minimum_lead_recall"),
            "impacting_faults",
            _ratio(c("all_early"), c("impacting_faults")).alias("pre_impact_recall_all_impacting"),
            "unmatched_incidents",
            "duplicate_incidents",
            _ratio(F.lit(1000.0) * (c("unmatched_incidents") + c("duplicate_incidents")), c("monitored_entity_days")).alias("nuisance_per_1000_entity_days"),
            "monitored_entity_days",
            "observation_coverage",
            "median_detection_delay_minutes",
            "median_variance_onset_delay_minutes",
            "incidents",
            "boundary_incidents",
            "boundary_faults",
            *[
                x
                for name in REFERENCES
                for x in (
                    f"{name}_warning_opportunities",
                    f"{name}_pre_impact_detected",
                    _ratio(c(f"{name}_pre_impact_detected"), c(f"{name}_warning_opportunities")).alias(f"{name}_pre_impact_recall"),
                )
            ],
        )

    def evaluate(self, incidents: DataFrame, truth: DataFrame, telemetry: DataFrame, start: datetime, end: datetime, check: bool = True) -> tuple[DataFrame, DataFrame]:
        """(metrics, outcomes). Detections are never widened to whole faults."""
        scope = self.scope(incidents, truth, telemetry, start, end, check)
        matches = match_events(scope.alerts, scope.faults, check).persist()
        outcomes = self.outcomes(scope, matches)
        return self.metrics(scope, outcomes, self.alert_classes(scope, matches)), outcomes

    def evaluate_policies(self, incidents: DataFrame, policies: DataFrame, truth: DataFrame, telemetry: DataFrame, start: datetime, end: datetime) -> DataFrame:
        """A row of metrics for each policy_id, in one plan.

        Entities, alerts and faults are told apart by policy, so every operator of a
        single evaluation serves all of them; opportunities do not depend on the
        policy and are found once.
        """
        ids = policies.select("policy_id")
        tag = lambda c: F.concat_ws("|", F.col("policy_id"), F.col(c)).alias(c)
        whole = self.scope(incidents.drop("policy_id"), truth, telemetry, start, end)
        chances = self.opportunities(whole.faults, whole.available)

        def each(table: DataFrame) -> DataFrame:
            return F.broadcast(ids).crossJoin(table).select("policy_id", *[tag(c) if c in ("fault_id", "entity_id") else F.col(c) for c in table.columns])

        period = (F.col("start_time") >= F.lit(start)) & (F.col("start_time") < F.lit(end))
        alerts = incidents.filter(period).select("policy_id", tag("incident_id"), tag("entity_id"), "start_time")
        scope = Scope(alerts, each(whole.faults).persist(), each(whole.boundary), whole.available)
        matches = match_events(scope.alerts, scope.faults, check=False).persist()
        outcomes = self.outcomes(scope, matches, each(chances).select("fault_id"), ("policy_id",))
        return self.metrics(scope, outcomes, self.alert_classes(scope, matches, ("policy_id",)), ids)


DETECTORS = ("statistical", "isolation_forest", "combined")


def policy_table(spark: SparkSession, openings: list[int], closings: list[int], base: Policy, detectors: tuple[str, ...] = DETECTORS) -> DataFrame:
    """Every combination, as a small table for one plan."""
    rows = [
        (f"{d}|{o}|{c}", d, float(base.high), float(base.low), int(o), int(c), int(base.interval_minutes), float(base.max_gap_hours))
        for d in detectors
        for o in openings
        for c in closings
    ]
    return spark.createDataFrame(
        rows, "policy_id string, detector string, high double, low double, opening_intervals int, closing_intervals int, interval_minutes int, max_gap_hours double"
    )


def incidents_of_policies(scores: DataFrame, policies: DataFrame) -> DataFrame:
    """Incidents of every policy in one plan: scores in long form meet the policies of their detector."""
    long = scores.unpivot(["entity_id", "timestamp"], list(DETECTORS), "d", "score")
    found = None
    for detector in DETECTORS:
        own = latch(long.filter(F.col("d") == detector).drop("d"), policies.filter(F.col("detector") == detector).drop("detector"))
        found = own if found is None else found.unionByName(own)
    return found




def ranked(comparison: DataFrame, *more: str) -> DataFrame:
    """Workload first, then timely warnings, then few nuisances, then the plainer policy."""
    return comparison.orderBy(
        F.desc("meets_workload_budget"),
        F.desc_nulls_last("minimum_lead_recall"),
        F.asc_nulls_last("nuisance_per_1000_entity_days"),
        *[F.asc(c) for c in (*more, "detector", "opening_intervals", "closing_intervals")],
    )


def tune(
    scores: DataFrame, truth: DataFrame, telemetry: DataFrame, start: datetime, end: datetime, evaluator: Evaluator, base: Policy,
    openings: list[int], closings: list[int], budget: float, detectors: tuple[str, ...] = DETECTORS,
) -> DataFrame:
    """A row of metrics for each policy, best first; incidents and evaluation of all policies are one plan."""
    policies = policy_table(scores.sparkSession, openings, closings, base, detectors)
    incidents = incidents_of_policies(scores, policies).persist()
    metrics = evaluator.evaluate_policies(incidents, policies, truth, telemetry, start, end)
    gaps = incidents.groupBy("policy_id").agg(F.count_if(F.col("reason") == "telemetry_gap").alias("telemetry_gap_closures"))
    coverage = scores.agg(*[F.avg(F.col(d).isNotNull().cast("double")).alias(d) for d in DETECTORS])
    coverage = coverage.unpivot([], list(DETECTORS), "detector", "score_coverage")
    table = policies.drop("interval_minutes").join(metrics, "policy_id").join(F.broadcast(coverage), "detector").join(gaps, "policy_id", "left")
    table = table.fillna(0, subset=["telemetry_gap_closures"]).drop("policy_id")
    return ranked(table.withColumn("meets_workload_budget", F.coalesce(F.col("nuisance_per_1000_entity_days") <= F.lit(budget), F.lit(False))))
