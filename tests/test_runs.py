"""The simulator, the run lifecycle from generation to the sealed evaluation, and streams."""

import json
import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fibrelark.operators.grid import resample
from fibrelark.operators.incidents import INCIDENT, Policy, latch
from fibrelark.plans import runs
from fibrelark.schema import METRICS, ContractError, fec_metric
from fibrelark.sources import datasource, files, simulate
from fibrelark.sources.simulate import Entity, GeneratorConfig
from fibrelark.streaming.pipeline import streaming_bins, streaming_grid, streaming_incidents
from fibrelark.streaming.tables import IncidentTable, write_incidents

SMALL = GeneratorConfig(entities=3, days=8, interval_minutes=30)


def test_autoregressive_noise_is_stationary():
    x = simulate.autoregressive(100_000, 0.5, 0.8, np.random.default_rng(1))
    assert x.var() == pytest.approx(0.25, rel=0.04)
    assert np.corrcoef(x[1:], x[:-1])[0, 1] == pytest.approx(0.8, abs=0.01)
    with pytest.raises(ContractError):
        simulate.autoregressive(5, 1.0, 1.0, np.random.default_rng(1))


def test_crossings_are_confirmed_not_backdated():
    holds = np.array([0, 1, 1, 0, 1, 1, 1, 1], bool)
    assert simulate.confirmed_at(holds, 3) == 6 and simulate.confirmed_at(holds, 5) is None and simulate.confirmed_at(holds[:0], 1) is None


def test_entities_do_not_depend_on_each_other_and_missing_rows_do_not_move_impacts():
    a, b = Entity(SMALL, 1), Entity(GeneratorConfig(entities=3, days=8, interval_minutes=30, missing_probability=0.3), 1)
    assert [f[5] for f in a.faults] == [f[5] for f in b.faults]
    assert a.readings().equals(Entity(SMALL, 1).readings())
    assert all(f[3] >= simulate.ORIGIN + timedelta(days=8 * 0.55) for f in a.faults)


def test_codewords_are_conserved():
    ber = np.array([0.0, 1e-6, 1e-3, 0.02, 0.1, 1.0])
    total = np.full(6, 10_000)
    corrected, lost = simulate.draw_codewords(ber, total, np.random.default_rng(2))
    assert (corrected + lost <= total).all() and corrected[0] == lost[0] == 0 and lost[-1] == 10_000
    with pytest.raises(ContractError):
        simulate.codeword_probabilities(np.array([1.1]))


@pytest.mark.parametrize("change", [{"days": 7}, {"entities": 0}, {"noise_db": 0.0}, {"missing_probability": 1.0}, {"faults_per_entity": 3}, {"seed": -1}, {"days": 8.5}, {"noise_db": float("nan")}])
def test_generator_settings_are_checked(change):
    with pytest.raises(ContractError):
        GeneratorConfig(**change)


def test_simulated_tables_keep_their_contracts(spark):
    native, truth = simulate.simulate(spark, SMALL)
    native, truth = native.persist(), truth.persist()
    units = simulate.topology(spark, SMALL)
    assert all(simulate.require_structure(native, truth, units).values())
    assert native.count() == 3 * SMALL.rows and truth.count() == 6
    with pytest.raises(ContractError, match="topology_covers_devices"):
        simulate.require_structure(native, truth, units.limit(1))
    with pytest.raises(ContractError, match="unique_samples"):
        simulate.require_structure(native.union(native.limit(1)), truth, units)
    datasource.register(spark)
    read = spark.read.format("fibrelark_fleet").option("entities", 1).option("days", 8).option("interval_minutes", 30).load()
    first = native.filter("device = 'ONT-000'")
    assert read.count() == SMALL.rows and read.select("time", "olt_tx_dbm").exceptAll(first.select("time", "olt_tx_dbm")).count() == 0


def test_files(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") / 3)
    files.write_table(df, str(tmp_path / "t.parquet"))
    assert files.read_table(spark, str(tmp_path / "t.parquet"), ["x"], "id < 4").count() == 4
    files.write_csv(df, str(tmp_path / "t.csv"))
    assert files.read_csv(spark, str(tmp_path / "t.csv"), "id long, x double").agg(F.sum("id")).first()[0] == 45
    assert files.digest(tmp_path / "t.parquet") == files.digest(tmp_path / "t.parquet")
    assert files.table_digests(spark, str(tmp_path / "t.parquet")).count() >= 1
    files.write_json(tmp_path / "m.json", {"a": 1}, exclusive=True)
    with pytest.raises(FileExistsError):
        files.write_json(tmp_path / "m.json", {}, exclusive=True)


def test_run_from_generation_to_one_final_evaluation(spark, tmp_path):
    config = {
        "generator": {"entities": 2, "days": 10, "interval_minutes": 20},
        "features": {"window": 6, "long_window_hours": 6.0},
        "incidents": {"opening_candidates": [2], "closing_candidates": [3], "high": 0.97},
        "model": {"feature_set": "both_rx"},
        "output": str(tmp_path / "run"),
    }
    root = runs.develop(spark, config, ("rx_only", "both_rx"))
    comparison = spark.read.option("header", True).csv(str(root / "comparison.csv"))
    assert comparison.count() == 3 + 2
    with pytest.raises(ContractError):
        runs.develop(spark, config)
    run = runs.Run.open(spark, root)
    assert run.table("canonical").agg(F.max("timestamp")).first()[0].replace(tzinfo=UTC) <= run.split.validation_end
    out = runs.explain_run(spark, root, sample_size=4, background_size=4, local_size=2, permutations=1)
    assert spark.read.parquet(str(out / "sample.parquet")).count() == 4
    metrics = runs.final_evaluation(spark, root)
    assert metrics["monitored_entity_days"] == pytest.approx(5.0, abs=0.1) and metrics["faults"] >= 0
    with pytest.raises(FileExistsError):
        runs.final_evaluation(spark, root)
    model = json.loads((root / "model.json").read_text())
    (root / "model.json").write_text(json.dumps(model | {"feature_set": "rx_only"}))
    with pytest.raises(ContractError, match="model.json"):
        runs.verify(root)
    with pytest.raises(ContractError, match="other settings"):
        runs.prepare(spark, config | {"splits": [0.3, 0.55, 0.75, 1.0]})
    with pytest.raises(ContractError):
        runs.check_calibration_truth(run.table("truth"), datetime(2026, 1, 1, tzinfo=UTC))


T0 = datetime(2025, 1, 1, tzinfo=UTC)


def test_streamed_bins_equal_the_batch(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=m), "a", "rx_power_dbm", float(m)) for m in (0, 2, 5, 7, 31)]
    schema = "timestamp timestamp, entity_id string, metric_name string, value double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = streaming_bins(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 5, "0 minutes")
    stream.writeStream.format("memory").queryName("bins").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.timestamp.replace(tzinfo=UTC) - T0).total_seconds() / 60: r.value for r in spark.table("bins").collect()}
    assert {k: got[k] for k in (0, 5, 10)} == {0: 0.0, 5: 3.5, 10: 7.0}
    assert METRICS["rx_power_dbm"].kind == "gauge"


def test_streamed_incidents_equal_the_batch(spark, tmp_path):
    policy = Policy(0.9, 0.5, 2, 2, 5, 1.0)
    scores = [0.95, 0.96, 0.2, 0.1, 0.95, 0.97, None, 0.98, 0.99, 0.95]
    rows = [(e, T0 + timedelta(minutes=5 * k), s) for e in ("a", "b") for k, s in enumerate(scores)]
    schema = "entity_id string, timestamp timestamp, score double"
    whole = spark.createDataFrame(rows, schema)
    source = str(tmp_path / "in")
    spark.createDataFrame([], schema).coalesce(1).write.parquet(source)

    def run(batch):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        out = streaming_incidents(spark.readStream.schema(schema).parquet(source), policy)
        writer = out.writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).outputMode("update")
        writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    found = []
    run([r for r in rows if r[1] < T0 + timedelta(minutes=25)])
    run([r for r in rows if r[1] >= T0 + timedelta(minutes=25)])
    last = {r.incident_id: r for r in found}  # upsert by id
    batch = {r.incident_id: r for r in latch(whole, policy).collect()}
    assert {k: (r.start_time, r.end_time, r.max_score, r.reason) for k, r in last.items()} == {k: (r.start_time, r.end_time, r.max_score, r.reason) for k, r in batch.items()}
    assert len(batch) == 4


def test_streamed_grid_equals_the_batch_after_a_restart(spark, tmp_path):
    """Late and reordered rows within the lateness, gaps of several bins, two metrics, in three runs of one query."""
    rng = random.Random(3)
    rows, minute = [], 0
    for _ in range(90):
        minute += rng.choice([1, 2, 3, 4, 40])
        rows.append((minute, rng.choice("ab"), rng.choice(["rx_power_dbm", fec_metric("downstream", "total")]), rng.choice([None, 1.0, 2.0, 5.5])))
    rows += [(minute + k * 60, e, n, 1.0) for k in (5, 6) for e in "ab" for n in ("rx_power_dbm", fec_metric("downstream", "total"))]  # the ends come out too
    moved = sorted(rows, key=lambda r: r[0] + rng.randrange(8))
    schema = "timestamp timestamp, entity_id string, metric_name string, value double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = lambda part: spark.createDataFrame([(T0 + timedelta(minutes=m), e, n, v) for m, e, n, v in part], schema).coalesce(1)
    for part in (moved[:30], moved[30:60], moved[60:-4], moved[-4:]):
        frame(part).write.mode("append").parquet(source)
        grid = streaming_grid(spark.readStream.schema(schema).parquet(source), 5, "10 minutes")
        writer = grid.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append")
        writer.trigger(availableNow=True).start().awaitTermination()
    got = {(r.entity_id, r.metric_name, r.timestamp): (r.value, r.observed) for r in spark.read.parquet(out).collect()}
    assert len(got) == spark.read.parquet(out).count()
    want = {(r.entity_id, r.metric_name, r.timestamp): (r.value, r.observed) for r in resample(frame(rows), 5).collect()}
    until = T0 + timedelta(minutes=minute + 300)
    early = lambda found: {k: v for k, v in found.items() if k[2].replace(tzinfo=UTC) < until}
    assert early(got) == early(want) and any(not seen for _, seen in early(got).values())


def test_replayed_batches_change_nothing(spark, tmp_path):
    policy = Policy(0.9, 0.5, 2, 2, 5, 1.0)
    scores = [0.95, 0.96, 0.2, 0.1, 0.95, 0.97, None, 0.98, 0.99, 0.95]
    rows = [(e, T0 + timedelta(minutes=5 * k), s) for e in ("a", "b") for k, s in enumerate(scores)]
    schema = "entity_id string, timestamp timestamp, score double"
    source = str(tmp_path / "in")
    table = IncidentTable(spark, f"file://{tmp_path}/table")
    told = lambda frame: sorted((r.incident_id, r.start_time, r.end_time, r.max_score, r.status) for r in frame.collect())

    def run(part, into):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        updates = streaming_incidents(spark.readStream.schema(schema).parquet(source), policy)
        write_incidents(updates, into, str(tmp_path / "c"), availableNow=True).awaitTermination()

    class Failing(IncidentTable):
        def _mark(self, kind, number):
            raise OSError("lost before the commit")

    assert table.read().count() == 0
    run(rows[:3] + rows[10:13], table)
    with pytest.raises(Exception, match="lost before the commit"):
        run(rows[3:8] + rows[13:18], Failing(spark, table.path))
    assert len(table._marked("_log")) == 1  # what was written is not seen
    run(rows[8:10] + rows[18:], table)
    want = told(latch(spark.createDataFrame(rows, schema), policy))
    assert told(table.read()) == want
    last = table._marked("_log")[-1]
    table.upsert(spark.createDataFrame([("a-1", "a", T0, None, 0.1, "OPEN", "active")], INCIDENT), last)  # the same number again
    assert told(table.read()) == want
    table.compact()
    table.compact()
    table.upsert(spark.createDataFrame([("a-1", "a", T0, None, 0.1, "OPEN", "active")], INCIDENT), last)
    assert told(table.read()) == want and table._marked("_log") == [] and table._marked("_base") == [last]
    table.upsert(spark.createDataFrame([("c-1", "c", T0, None, 0.5, "OPEN", "active")], INCIDENT), last + 1)
    assert len(told(table.read())) == len(want) + 1
