"""The queries in DuckDB's SQL, written apart from the Spark plans."""

from __future__ import annotations

import math

from fibrelark.schema import METRICS

_ALPHA = 1 - math.exp(-1 / 3)
_TRAIN, _CAL, _VAL, _END = (1704067200000000 + int(d * 86_400_000_000) for d in (12, 16.5, 22.5, 30))
_H = 3_600_000_000

_GRID = f"""
ev AS (SELECT event_id, user_id, event_type AS entity_id, epoch_us(ts) AS us, value FROM events),
bins AS (SELECT entity_id, ((us + {_H - 1}) // {_H}) * {_H} AS tk, avg(value) AS v FROM ev GROUP BY 1, 2),
ends AS (SELECT entity_id, min(tk) AS a, max(tk) AS b FROM bins GROUP BY 1),
slots AS (SELECT entity_id, unnest(range(a, b + 1, {_H})) AS tk FROM ends),
grid AS (SELECT s.entity_id, s.tk, b.v FROM slots s LEFT JOIN bins b USING (entity_id, tk)),
ph AS (SELECT *, sin((tk % 86400000000) * 2 * pi() / 86400000000) AS s, cos((tk % 86400000000) * 2 * pi() / 86400000000) AS c FROM grid)"""


def _solve(source: str) -> str:
    """Normal equations of 1, sin and cos by cofactors."""
    return f"""
SELECT entity_id, n, det / (n * n * n) > 1e-9 AS rank_ok,
  ((ss * cc - sc * sc) * y + (c * sc - s * cc) * ys + (s * sc - ss * c) * yc) / det AS c0,
  ((c * sc - s * cc) * y + (n * cc - c * c) * ys + (s * c - n * sc) * yc) / det AS c1,
  ((s * sc - ss * c) * y + (s * c - n * sc) * ys + (n * ss - s * s) * yc) / det AS c2
FROM (SELECT *, n * (ss * cc - sc * sc) + s * (c * sc - s * cc) + c * (s * sc - ss * c) AS det FROM (
  SELECT entity_id, count(v)::DOUBLE AS n, sum(s) AS s, sum(c) AS c, sum(s * s) AS ss, sum(c * c) AS cc, sum(s * c) AS sc,
    sum(v) AS y, sum(v * s) AS ys, sum(v * c) AS yc FROM {source} WHERE v IS NOT NULL GROUP BY 1))"""


_REF = f"""{_GRID},
train AS (SELECT * FROM ph WHERE tk < {_TRAIN}),
fit AS ({_solve("train")}),
tr AS (SELECT t.entity_id, v - (c0 + c1 * s + c2 * c) AS r FROM train t JOIN fit USING (entity_id) WHERE v IS NOT NULL),
mid AS (SELECT entity_id, median(r) AS m FROM tr GROUP BY 1),
mad AS (SELECT entity_id, greatest(1.4826 * median(abs(r - m)), 0.05) AS scale FROM tr JOIN mid USING (entity_id) GROUP BY 1),
ref AS (SELECT entity_id, c0, c1, c2, scale FROM fit JOIN mad USING (entity_id) WHERE n >= 100 AND rank_ok)"""

_RES = f"""{_REF},
res AS (SELECT p.entity_id, p.tk, p.v AS raw, c0, (v - (c0 + c1 * s + c2 * c)) / scale AS x FROM ph p LEFT JOIN ref USING (entity_id))"""


def _segments(source: str, value: str, name: str) -> str:
    return f"""
{name}_l AS (SELECT *, lag({value}) OVER w AS before, lag(tk) OVER w AS tk_before FROM {source} WINDOW w AS (PARTITION BY entity_id ORDER BY tk)),
{name}_n AS (SELECT * EXCLUDE (before, tk_before), sum(CASE WHEN {value} IS NULL OR before IS NULL OR coalesce(tk - tk_before <> {_H}, true) THEN 1 ELSE 0 END)
  OVER (PARTITION BY entity_id ORDER BY tk) AS segment FROM {name}_l),
{name} AS (SELECT *, row_number() OVER (PARTITION BY entity_id, segment ORDER BY tk) - 1 AS pos FROM {name}_n)"""


_SEG = f"{_RES},{_segments('res', 'x', 'seg')}"
_SHORT = "(PARTITION BY entity_id, segment ORDER BY tk ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
_LONG = "(PARTITION BY entity_id, segment ORDER BY tk ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


def _windowed(**columns: str) -> str:
    made = ", ".join(f"CASE WHEN x IS NOT NULL AND pos >= 11 THEN round({sql}, 6) + 0.0 END AS {name}" for name, sql in columns.items())
    return f"WITH {_SEG} SELECT entity_id, tk AS timestamp, {made} FROM seg"


_SMOOTH = f"""{_SEG},
dd AS (SELECT *, x - lag(x) OVER (PARTITION BY entity_id, segment ORDER BY tk) AS d FROM seg),
bb AS (SELECT *, d - lag(d) OVER (PARTITION BY entity_id, segment ORDER BY tk) AS e FROM dd),
slopes AS (SELECT a.entity_id, a.tk, a.pos,
    sum(CASE WHEN b.pos = 1 THEN b.d * pow({1 - _ALPHA!r}, a.pos - 1) WHEN b.pos > 1 THEN {_ALPHA!r} * pow({1 - _ALPHA!r}, a.pos - b.pos) * b.d END) AS slope,
    sum(CASE WHEN b.pos = 2 THEN b.e * pow({1 - _ALPHA!r}, a.pos - 2) WHEN b.pos > 2 THEN {_ALPHA!r} * pow({1 - _ALPHA!r}, a.pos - b.pos) * b.e END) AS bend
  FROM bb a JOIN bb b ON a.entity_id = b.entity_id AND a.segment = b.segment AND b.pos <= a.pos GROUP BY 1, 2, 3)"""

_SCORED = f"""{_SMOOTH},
raws AS (SELECT entity_id, tk, -slope AS raw FROM slopes),
cnt AS (SELECT raw AS value, count(*) AS n FROM raws WHERE tk >= {_TRAIN} AND tk < {_CAL} AND raw IS NOT NULL GROUP BY 1),
knots AS (SELECT value, (sum(n) OVER (ORDER BY value) - n / 2.0) / sum(n) OVER () AS rank FROM cnt),
spans AS (SELECT value, rank, lead(value) OVER (ORDER BY value) AS value2, lead(rank) OVER (ORDER BY value) AS rank2 FROM knots),
edge AS (SELECT min(value) AS a, max(value) AS b FROM knots),
scored AS (SELECT r.entity_id, r.tk, r.raw, CASE WHEN r.raw IS NULL THEN NULL WHEN r.raw < a THEN 0.0 WHEN r.raw > b THEN 1.0
    WHEN s.value2 IS NULL THEN s.rank ELSE s.rank + (s.rank2 - s.rank) * (r.raw - s.value) / (s.value2 - s.value) END AS score
  FROM raws r CROSS JOIN edge ASOF LEFT JOIN spans s ON r.raw >= s.value)"""

_STEP = 3_600_000_000
# The state machine row by row: one recursion for each entity.
_MACHINE = f"""{_SCORED},
rows_ AS MATERIALIZED (SELECT entity_id, tk, score, row_number() OVER (PARTITION BY entity_id ORDER BY tk) AS k FROM scored),
m AS (
  SELECT DISTINCT entity_id, 0::BIGINT AS k, false AS open, 0 AS hi, 0 AS lo, NULL::BIGINT AS prev, NULL::BIGINT AS valid, NULL::BIGINT AS start, NULL::DOUBLE AS peak, 0 AS num,
    NULL::INT AS e_num, NULL::BIGINT AS e_start, NULL::BIGINT AS e_end, NULL::DOUBLE AS e_peak, NULL::VARCHAR AS e_why FROM rows_
  UNION ALL
  SELECT entity_id, k, CASE WHEN opens THEN true WHEN closes THEN false ELSE open1 END, CASE WHEN closes THEN 0 ELSE hi2 END, CASE WHEN closes OR opens THEN 0 ELSE lo2 END,
    tk, CASE WHEN score IS NULL THEN valid ELSE tk END, CASE WHEN opens THEN tk ELSE start END,
    CASE WHEN opens THEN score WHEN open1 AND score IS NOT NULL THEN greatest(peak, score) ELSE peak END, num + CASE WHEN opens THEN 1 ELSE 0 END,
    CASE WHEN expired OR closes THEN num END, start, CASE WHEN expired THEN valid WHEN closes THEN tk END,
    CASE WHEN closes THEN greatest(peak, score) ELSE peak END, CASE WHEN expired THEN 'telemetry_gap' WHEN closes THEN 'recovery' END
  FROM (SELECT *, NOT open1 AND score IS NOT NULL AND hi2 >= 2 AS opens, open1 AND score IS NOT NULL AND lo2 >= 3 AS closes FROM (
    SELECT *, CASE WHEN score IS NULL THEN 0 WHEN open1 THEN hi1 WHEN score > 0.9 THEN hi1 + 1 ELSE 0 END AS hi2,
      CASE WHEN score IS NULL THEN 0 WHEN NOT open1 THEN lo1 WHEN score < 0.5 THEN lo1 + 1 ELSE 0 END AS lo2 FROM (
    SELECT *, open AND far AS expired, open AND NOT far AS open1, CASE WHEN far OR gap THEN 0 ELSE hi END AS hi1, CASE WHEN far OR gap THEN 0 ELSE lo END AS lo1 FROM (
    SELECT r.entity_id, r.k, r.tk, r.score, m.open, m.hi, m.lo, m.valid, m.start, m.peak, m.num,
      coalesce(r.tk - m.valid > 6 * {_STEP}, false) AS far, coalesce(r.tk - m.prev > 1.5 * {_STEP}, false) AS gap
    FROM m JOIN rows_ r ON r.entity_id = m.entity_id AND r.k = m.k + 1))))),
inc AS (
  SELECT entity_id, e_num AS num, e_start AS s, e_end AS e, e_peak AS p, e_why AS why FROM m WHERE e_num IS NOT NULL
  UNION ALL
  SELECT entity_id, num, start, NULL, peak, 'active' FROM m WHERE open AND k = (SELECT max(k) FROM rows_ r WHERE r.entity_id = m.entity_id)),
incidents AS (SELECT entity_id || '-' || num AS incident_id, entity_id, s AS start_time, e AS end_time, p AS max_score,
  CASE WHEN why = 'active' THEN 'OPEN' ELSE 'CLOSED' END AS status, why AS reason FROM inc)"""

_FAULTS = f"""
fb AS (SELECT entity_id, quantile_cont(value, 0.98) AS bound FROM ev GROUP BY 1),
fh AS (SELECT ev.*, lag(us) OVER (PARTITION BY entity_id ORDER BY us, event_id) AS before FROM ev JOIN fb USING (entity_id) WHERE value > bound),
faults AS (SELECT 'F-' || event_id AS fault_id, entity_id, CASE WHEN event_id % 3 = 0 THEN 'variance_shift' ELSE 'exponential' END AS fault_type, us AS onset_time,
  CASE WHEN event_id % 3 <> 0 THEN us END AS observable_onset_time, CASE WHEN event_id % 5 <> 0 THEN us + 12 * {_H} END AS impact_time, us + 24 * {_H} AS end_time
  FROM fh WHERE coalesce(us - before >= 24 * {_H}, true))"""

_SCOPE = f"""
al AS (SELECT * FROM incidents WHERE start_time >= {_CAL} AND start_time < {_VAL}),
fi AS (SELECT * FROM faults WHERE onset_time >= {_CAL} AND end_time <= {_VAL}),
fo AS (SELECT * FROM faults WHERE onset_time < {_VAL} AND end_time > {_CAL} AND fault_id NOT IN (SELECT fault_id FROM fi))"""

# Stand-in faults of an entity never overlap, so an alert lies in one at most and the first alert in a fault is its match.
_OUTCOMES = f"""
av AS (SELECT * FROM grid WHERE tk >= {_CAL} AND tk < {_VAL}),
mt AS (SELECT fault_id, arg_min(incident_id, (start_time, incident_id)) AS incident_id, min(start_time) AS start_time FROM al JOIN fi f
  ON al.entity_id = f.entity_id AND f.onset_time <= al.start_time AND al.start_time < f.end_time GROUP BY 1),
cw AS (SELECT f.fault_id, g.tk, g.v, lag(g.tk) OVER (PARTITION BY f.fault_id ORDER BY g.tk) AS b FROM fi f JOIN av g ON g.entity_id = f.entity_id
  AND g.tk >= CASE WHEN fault_type = 'variance_shift' THEN onset_time ELSE observable_onset_time END AND g.tk <= impact_time - 7200000000),
ci AS (SELECT *, sum(CASE WHEN v IS NULL OR coalesce(tk - b > 1.5 * {_H}, true) THEN 1 ELSE 0 END) OVER (PARTITION BY fault_id ORDER BY tk) AS k FROM cw),
ch AS (SELECT DISTINCT fault_id FROM (SELECT fault_id, k FROM ci WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)),
oc AS (SELECT fault_id, fault_type, mt.incident_id IS NOT NULL AS detected, ch.fault_id IS NOT NULL AS opportunity,
    CASE WHEN fault_type = 'variance_shift' THEN 'onset_time' ELSE 'observable_onset_time' END AS opportunity_reference,
    coalesce(start_time < impact_time, false) AS pre_impact, impact_time IS NOT NULL AS impacting, (impact_time - start_time) / 60e6 AS lead_minutes,
    coalesce(start_time < impact_time AND (impact_time - start_time) / 60e6 >= 120, false) AS minimum_lead,
    (start_time - CASE WHEN fault_type = 'variance_shift' THEN onset_time ELSE observable_onset_time END) / 60e6 AS delay_minutes,
    CASE WHEN fault_type = 'variance_shift' THEN 'onset_time' ELSE 'observable_onset_time' END AS delay_reference
  FROM fi LEFT JOIN mt USING (fault_id) LEFT JOIN ch USING (fault_id)),
cl AS (SELECT incident_id, CASE WHEN incident_id IN (SELECT incident_id FROM mt) THEN 'matched'
  WHEN EXISTS (SELECT 1 FROM fi f WHERE f.entity_id = al.entity_id AND f.onset_time <= al.start_time AND al.start_time < f.end_time) THEN 'duplicate'
  WHEN EXISTS (SELECT 1 FROM fo f WHERE f.entity_id = al.entity_id AND f.onset_time <= al.start_time AND al.start_time < f.end_time) THEN 'boundary' ELSE 'unmatched' END AS class FROM al)"""

_BY_REFERENCE = ", ".join(
    f"{name}_warning_opportunities, {name}_pre_impact_detected, round({name}_pre_impact_detected / nullif({name}_warning_opportunities, 0), 6) AS {name}_pre_impact_recall"
    for name in ("observable", "physical_onset")
)
_COUNT_REFERENCE = ", ".join(
    f"count(*) FILTER (opportunity AND opportunity_reference = '{column}') AS {name}_warning_opportunities, "
    f"count(*) FILTER (opportunity AND pre_impact AND opportunity_reference = '{column}') AS {name}_pre_impact_detected"
    for name, column in (("observable", "observable_onset_time"), ("physical_onset", "onset_time"))
)

_CORR = "CASE WHEN count({x}) >= {least} AND min({x}) < max({x}) AND min({y}) < max({y}) THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def _corr(x: str, y: str, least: int = 3) -> str:
    """x and y must be null together."""
    return _CORR.format(x=x, y=y, least=least)


_PAIRS = [(a, b) for k, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "1.0"]) for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "1.0"][k + 1 :]]
_NAMED = lambda c: "constant" if c == "1.0" else c
_BY_CLASS = " + ".join(
    f"CASE WHEN n{k} > 0 THEN -(n{k} / 12.0) * ln(n{k} / 12.0) ELSE 0 END" for k in range(8)
)
_CLASS = " + ".join(f"CASE WHEN x >= {e} THEN 1 ELSE 0 END" for e in (-3, -2, -1, 0, 1, 2, 3))
_SLOPE = " + ".join(f"{(i - 5.5) / 143.0!r} * lag(x, {11 - i}) OVER (PARTITION BY entity_id, segment ORDER BY tk)" for i in range(12))
_RATIOS = [10.0**-k for k in range(1, 9)] + [0.0, 3e-3]

ORACLE_SQL: dict[str, str] = {
    "q01_scan_project_filter": "SELECT event_id, user_id, epoch_us(ts) AS ts, round(value, 6) AS value FROM events WHERE event_type = 'error' AND value BETWEEN 10 AND 50",
    "q02_adapt_unpivot": """
SELECT epoch_us(ts) AS timestamp, event_type || '-' || event_id AS entity_id, 'rx_power_dbm' AS metric_name, round(value, 6) AS value FROM events
UNION ALL SELECT epoch_us(ts), event_type || '-' || event_id, 'ont_tx_power_dbm', CASE WHEN value > 20 THEN round(value / 2, 6) END FROM events""",
    "q03_unit_mw_to_dbm": """
SELECT event_id, CASE WHEN value > 5 THEN round(10 * log10(value - 5.0), 6) + 0.0 END AS from_mw, CASE WHEN value > 5 THEN round(10 * log10((value - 5.0) * 1000), 6) + 0.0 END AS from_w FROM events""",
    "q04_sanitise_ranges": """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linenumber NOT IN (3, 4) AND l_discount * 12 BETWEEN 0 AND 1 THEN round(l_discount * 12, 6) END AS ratio,
  CASE WHEN l_quantity - 5 >= 0 AND l_quantity - 5 = floor(l_quantity - 5) THEN l_quantity - 5 END AS counted,
  CASE WHEN l_extendedprice >= 0 AND l_extendedprice = floor(l_extendedprice) THEN l_extendedprice END AS price_count FROM lineitem""",
    "q05_duplicate_key_report": "SELECT user_id, epoch_us(date_trunc('hour', ts)) AS hour, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "q06_split_masks": f"""
SELECT CASE WHEN epoch_us(ts) < {_TRAIN} THEN 'train' WHEN epoch_us(ts) < {_CAL} THEN 'calibration' WHEN epoch_us(ts) < {_VAL} THEN 'validation' WHEN epoch_us(ts) < {_END} THEN 'test' END AS part,
  event_type, count(*) AS n, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events GROUP BY 1, 2""",
    "q07_resample_mean": f"WITH {_GRID} SELECT entity_id, tk AS timestamp, round(v, 6) AS value FROM bins",
    "q08_resample_sum": """
WITH b AS (SELECT event_type AS entity_id, ((epoch_us(ts) + 2699999999) // 2700000000) * 2700000000 AS tk, sum(floor(value)) AS v FROM events GROUP BY 1, 2),
s AS (SELECT entity_id, unnest(range(min(tk), max(tk) + 1, 2700000000)) AS tk FROM b GROUP BY 1)
SELECT s.entity_id, s.tk AS timestamp, v AS value, v IS NOT NULL AS observed FROM s LEFT JOIN b USING (entity_id, tk)""",
    "q09_grid_complete": f"WITH {_GRID} SELECT entity_id, tk AS timestamp, v IS NOT NULL AS observed FROM grid",
    "q10_pivot_channels": f"""
WITH {_GRID}, w AS (SELECT tk, max(CASE WHEN entity_id = 'click' THEN v END) AS olt, max(CASE WHEN entity_id = 'error' THEN v END) AS rx,
  max(CASE WHEN entity_id = 'purchase' THEN v END) AS ont, max(CASE WHEN entity_id = 'view' THEN v END) AS up FROM grid WHERE entity_id IN ('click', 'error', 'purchase', 'view') GROUP BY 1)
SELECT 'e' AS entity_id, tk AS timestamp, round(up, 6) AS upstream_rx, round(olt - rx, 6) + 0.0 AS downstream_loss, round(ont - up, 6) + 0.0 AS upstream_loss FROM w""",
    "q11_fec_log_fraction": """
WITH e AS (SELECT event_id::VARCHAR AS entity_id, epoch_us(ts) AS timestamp, floor(value) AS t, floor(floor(value) / 7) AS c, floor(floor(value) * CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0.1::DOUBLE END) AS u FROM events),
f AS (SELECT *, CASE WHEN t > 0 THEN c / t END AS fc, CASE WHEN t > 0 THEN u / t END AS fu, c + u > t AS bad FROM e)
SELECT entity_id, timestamp, CASE WHEN fc BETWEEN 0 AND 1 AND NOT bad THEN round(ln(1 + fc / 1e-6), 6) END AS upstream_fec_corrected,
  CASE WHEN fu BETWEEN 0 AND 1 AND NOT bad THEN round(ln(1 + fu / 1e-6), 6) END AS upstream_fec_uncorrectable FROM f""",
    "q12_segment_ids": f"WITH {_GRID},{_segments('grid', 'v', 'sg')} SELECT entity_id, tk AS timestamp, segment::BIGINT AS segment, pos::BIGINT AS pos FROM sg",
    "q13_run_lengths": f"""
WITH {_GRID}, h AS (SELECT *, coalesce(v > 50, false) AS hold FROM grid),
i AS (SELECT *, sum(CASE WHEN hold THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id ORDER BY tk) AS k FROM h)
SELECT entity_id, tk AS timestamp, (sum(CASE WHEN hold THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, k ORDER BY tk))::BIGINT AS run FROM i""",
    "q14_last_seen_age": f"""
WITH {_GRID} SELECT entity_id, tk AS timestamp, round((tk - max(CASE WHEN v IS NOT NULL THEN tk END) OVER (PARTITION BY entity_id ORDER BY tk)) / 60e6, 6) AS age_minutes FROM grid""",
    "q15_harmonic_fit": f"WITH {_GRID}, f AS ({_solve('ph')}) SELECT entity_id, n::BIGINT AS n, rank_ok, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM f",
    "q16_mad_scale": f"WITH {_REF} SELECT entity_id, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2, round(scale, 6) AS scale FROM ref",
    "q17_residuals": f"WITH {_RES} SELECT entity_id, tk AS timestamp, round(x, 6) + 0.0 AS x FROM res",
    "q18_level_variability": _windowed(level=f"avg(x) OVER {_SHORT}", variability=f"stddev_pop(x) OVER {_SHORT}"),
    "q19_regression_slope": _windowed(regression_slope=_SLOPE),
    "q20_long_and_contrast": _windowed(long_level=f"avg(x) OVER {_LONG}", short_minus_long=f"avg(x) OVER {_SHORT} - avg(x) OVER {_LONG}"),
    "q21_below_baseline": _windowed(
        below_baseline_fraction=f"avg(CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END) OVER {_SHORT}", error_interval_fraction=f"avg(CASE WHEN raw > 0 THEN 1.0 ELSE 0.0 END) OVER {_SHORT}"
    ),
    "q22_ewma_slope": f"WITH {_SMOOTH} SELECT entity_id, tk AS timestamp, round(slope, 6) + 0.0 AS slope, CASE WHEN pos >= 12 THEN round(slope, 6) + 0.0 END AS late_slope FROM slopes",
    "q23_cov_linear": f"""
WITH {_SEG}, l AS (SELECT *, pow(10.0, (raw - c0) / 200.0) AS lin FROM seg)
SELECT entity_id, tk AS timestamp, CASE WHEN x IS NOT NULL AND pos >= 11 THEN round(stddev_pop(lin) OVER {_SHORT} / abs(avg(lin) OVER {_SHORT}), 6) END AS cov FROM l""",
    "q24_lag_one": f"""
WITH {_SEG}, w AS (SELECT a.entity_id, a.tk, a.pos, b.pos AS q, b.x, avg(b.x) OVER (PARTITION BY a.entity_id, a.tk) AS m FROM seg a LEFT JOIN seg b
  ON a.entity_id = b.entity_id AND a.segment = b.segment AND b.pos BETWEEN a.pos - 11 AND a.pos),
z AS (SELECT *, x - m AS z, lead(x - m) OVER (PARTITION BY entity_id, tk ORDER BY q) AS z2 FROM w)
SELECT entity_id, tk AS timestamp, CASE WHEN count(x) = 12 THEN round(CASE WHEN sum(z * z) > 1e-15 THEN sum(z * z2) / sum(z * z) ELSE 0 END, 6) + 0.0 END AS autocorrelation FROM z GROUP BY 1, 2""",
    "q25_entropy": f"""
WITH {_SEG}, k AS (SELECT *, {_CLASS} AS class FROM seg),
n AS (SELECT *, {", ".join(f"count(CASE WHEN class = {k} THEN 1 END) OVER {_SHORT} AS n{k}" for k in range(8))} FROM k)
SELECT entity_id, tk AS timestamp, CASE WHEN x IS NOT NULL AND pos >= 11 THEN round({_BY_CLASS}, 6) + 0.0 END AS entropy FROM n""",
    "q26_cusum": f"""
WITH RECURSIVE {_SMOOTH},
cs AS (SELECT entity_id, segment, pos, tk, x, 0.0::DOUBLE AS s FROM seg WHERE pos = 11 AND x IS NOT NULL
  UNION ALL SELECT n.entity_id, n.segment, n.pos, n.tk, n.x, greatest(0.0, c.s - n.x - 0.25) FROM cs c JOIN seg n ON n.entity_id = c.entity_id AND n.segment = c.segment AND n.pos = c.pos + 1)
SELECT p.entity_id, p.tk AS timestamp, round(c.s, 6) + 0.0 AS cusum, round(p.bend, 6) + 0.0 AS acceleration FROM slopes p
LEFT JOIN cs c ON c.entity_id = p.entity_id AND c.tk = p.tk AND c.pos >= 12""",
    "q27_midrank_normaliser": "WITH c AS (SELECT round(value, 0) AS value, count(*) AS n FROM events GROUP BY 1) SELECT value, round((sum(n) OVER (ORDER BY value) - n / 2.0) / sum(n) OVER (), 6) AS rank FROM c",
    "q28_interp_score": f"WITH {_SCORED} SELECT entity_id, tk AS timestamp, round(raw, 6) + 0.0 AS raw, round(score, 6) + 0.0 AS score FROM scored",
    "q29_combined_score": f"""
WITH {_GRID} SELECT entity_id, tk AS timestamp, CASE WHEN v IS NOT NULL AND (tk // {_H}) % 24 <> 7 THEN round(greatest(v / 997, 0.05::DOUBLE), 6) END AS combined FROM grid""",
    "q30_incidents_latch": f"WITH RECURSIVE {_MACHINE} SELECT * REPLACE (round(max_score, 6) AS max_score, round(end_time / 1e6, 6) AS end_time) FROM incidents",
    "q31_interval_join": f"""
WITH RECURSIVE {_MACHINE},{_FAULTS} SELECT a.entity_id, incident_id, start_time, fault_id, onset_time, f.end_time FROM incidents a JOIN faults f
ON a.entity_id = f.entity_id AND onset_time <= start_time AND start_time < f.end_time""",
    "q32_anti_boundary": f"""
WITH {_GRID},{_FAULTS}, fi AS (SELECT * FROM faults WHERE onset_time >= {_CAL} AND end_time <= {_VAL})
SELECT fault_id, 'inside' AS place FROM fi UNION ALL SELECT fault_id, 'boundary' FROM faults WHERE onset_time < {_VAL} AND end_time > {_CAL} AND fault_id NOT IN (SELECT fault_id FROM fi)""",
    "q33_semi_duplicates": f"""
WITH RECURSIVE {_MACHINE},{_FAULTS},{_SCOPE}
SELECT incident_id, CASE WHEN EXISTS (SELECT 1 FROM fi f WHERE f.entity_id = al.entity_id AND f.onset_time <= al.start_time AND al.start_time < f.end_time) THEN 'duplicate'
  WHEN EXISTS (SELECT 1 FROM fo f WHERE f.entity_id = al.entity_id AND f.onset_time <= al.start_time AND al.start_time < f.end_time) THEN 'boundary' ELSE 'unmatched' END AS class FROM al""",
    "q34_opportunity_runs": f"""
WITH {_GRID},{_FAULTS},
w AS (SELECT f.fault_id, g.tk, g.v, lag(g.tk) OVER (PARTITION BY f.fault_id ORDER BY g.tk) AS b FROM faults f JOIN grid g ON g.entity_id = f.entity_id
  AND g.tk >= CASE WHEN fault_type = 'variance_shift' THEN onset_time ELSE observable_onset_time END AND g.tk <= impact_time - 7200000000),
i AS (SELECT *, sum(CASE WHEN v IS NULL OR coalesce(tk - b > 1.5 * {_H}, true) THEN 1 ELSE 0 END) OVER (PARTITION BY fault_id ORDER BY tk) AS k FROM w)
SELECT DISTINCT fault_id FROM (SELECT fault_id, k FROM i WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)""",
    "q35_match_cardinality": f"""
WITH RECURSIVE {_MACHINE},{_FAULTS} SELECT count(DISTINCT fault_id) AS matched FROM incidents a JOIN faults f
ON a.entity_id = f.entity_id AND onset_time <= start_time AND start_time < f.end_time""",
    "q36_fault_outcomes": f"""
WITH RECURSIVE {_MACHINE},{_FAULTS},{_SCOPE},{_OUTCOMES} SELECT * REPLACE (round(lead_minutes, 6) AS lead_minutes, round(delay_minutes, 6) AS delay_minutes) FROM oc""",
    "q37_metrics_block": f"""
WITH RECURSIVE {_MACHINE},{_FAULTS},{_SCOPE},{_OUTCOMES},
f AS (SELECT count(*) AS faults, count(*) FILTER (detected) AS detected, count(*) FILTER (opportunity) AS warning_opportunities,
    count(*) FILTER (opportunity AND pre_impact) AS pre_impact_detected, count(*) FILTER (opportunity AND minimum_lead) AS minimum_lead_detected,
    count(*) FILTER (impacting) AS impacting_faults, count(*) FILTER (impacting AND pre_impact) AS all_early,
    median(delay_minutes) FILTER (delay_reference = 'observable_onset_time') AS seen_delay, median(delay_minutes) FILTER (delay_reference = 'onset_time') AS shift_delay, {_COUNT_REFERENCE}
  FROM oc),
a AS (SELECT count(*) AS incidents, count(*) FILTER (class = 'unmatched') AS unmatched_incidents, count(*) FILTER (class = 'duplicate') AS duplicate_incidents,
    count(*) FILTER (class = 'boundary') AS boundary_incidents FROM cl),
r AS (SELECT count(*) * 60 / 1440 AS days, avg(CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END) AS coverage FROM av),
e AS (SELECT count(*) AS boundary_faults FROM fo)
SELECT faults, detected, faults - detected AS missed, warning_opportunities, faults - warning_opportunities AS faults_without_warning_opportunity, pre_impact_detected,
  round(pre_impact_detected / nullif(warning_opportunities, 0), 6) AS pre_impact_recall, 120.0::DOUBLE AS minimum_lead_minutes, minimum_lead_detected,
  round(minimum_lead_detected / nullif(warning_opportunities, 0), 6) AS minimum_lead_recall, impacting_faults, round(all_early / nullif(impacting_faults, 0), 6) AS pre_impact_recall_all_impacting,
  unmatched_incidents, duplicate_incidents, round(1000.0 * (unmatched_incidents + duplicate_incidents) / nullif(days, 0), 6)::DOUBLE AS nuisance_per_1000_entity_days,
  round(days, 6)::DOUBLE AS monitored_entity_days, round(coverage, 6)::DOUBLE AS observation_coverage, round(seen_delay, 6) AS median_detection_delay_minutes,
  round(shift_delay, 6) AS median_variance_onset_delay_minutes, incidents, boundary_incidents, boundary_faults, {_BY_REFERENCE}
FROM f, a, r, e""",
    "q39_observation_quality": f"""
WITH {_GRID}, h AS (SELECT *, v IS NOT NULL AS o FROM grid),
i AS (SELECT *, sum(CASE WHEN o THEN 0 ELSE 1 END) OVER w AS k1, sum(CASE WHEN o THEN 1 ELSE 0 END) OVER w AS k2, count(*) OVER r AS n, avg(CASE WHEN o THEN 1.0 ELSE 0.0 END) OVER r AS f,
  max(CASE WHEN o THEN tk END) OVER w AS seen FROM h WINDOW w AS (PARTITION BY entity_id ORDER BY tk), r AS (PARTITION BY entity_id ORDER BY tk ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT entity_id, tk AS timestamp, o AS current_observed, CASE WHEN n = 12 THEN round(f, 6) END AS recent_observed_fraction,
  (sum(CASE WHEN o THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id, k2 ORDER BY tk))::BIGINT AS missing_run_intervals, round((tk - seen) / 60e6, 6) AS minutes_since_observation,
  round((sum(CASE WHEN o THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, k1 ORDER BY tk))::DOUBLE, 6) AS contiguous_history_hours FROM i""",
    "q40_missingness_report": f"""
WITH {_GRID}, l AS (SELECT entity_id, tk, 'value' AS measurement, v FROM grid UNION ALL SELECT entity_id, tk, 'half', CASE WHEN (tk // {_H}) % 2 = 0 THEN v END FROM grid),
i AS (SELECT *, sum(CASE WHEN v IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id, measurement ORDER BY tk) AS k FROM l),
r AS (SELECT entity_id, measurement, k, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS run FROM i GROUP BY 1, 2, 3),
x AS (SELECT entity_id, measurement, max(run)::BIGINT AS longest_missing_intervals FROM r GROUP BY 1, 2)
SELECT entity_id, measurement, count(*) AS rows, count(v) AS observed, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_fraction,
  longest_missing_intervals, count(DISTINCT v) AS unique_observed_values FROM l JOIN x USING (entity_id, measurement) GROUP BY ALL""",
    "q41_describe_percentiles": """
SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_discount), 6) AS var,
  round(quantile_cont(l_extendedprice, 0.01), 6) AS p01, round(median(l_extendedprice), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99, round(quantile_cont(l_quantity, 0.05), 6) AS q05
FROM lineitem GROUP BY 1""",
    "q42_pearson_pairs": "\nUNION ALL ".join(
        f"SELECT l_returnflag, '{_NAMED(a)}' AS \"left\", '{_NAMED(b)}' AS \"right\", round({_corr(a, b)}, 6) + 0.0 AS pearson FROM lineitem GROUP BY 1" for a, b in _PAIRS
    ),
    "q43_spearman_pairs": f"""
WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*)::DOUBLE AS n, avg(value) AS mean FROM events GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY n) + (count(*) OVER (PARTITION BY event_type, n) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY event_type ORDER BY mean) + (count(*) OVER (PARTITION BY event_type, mean) - 1) / 2.0 AS rb FROM d)
SELECT event_type, count(*) AS paired, round({_corr("ra", "rb")}, 6) AS spearman FROM r GROUP BY 1""",
    "q44_acf_lags": f"""
WITH {_GRID}, p AS (SELECT a.entity_id, k AS lag_intervals, CASE WHEN b.v IS NOT NULL THEN a.v END AS x, CASE WHEN a.v IS NOT NULL THEN b.v END AS y FROM grid a
  CROSS JOIN (SELECT unnest([1, 6, 12, 24, 48, 168]) AS k) LEFT JOIN grid b ON a.entity_id = b.entity_id AND b.tk = a.tk - k * {_H})
SELECT entity_id, 'rx_power_dbm' AS metric_name, lag_intervals::BIGINT AS lag_intervals, (lag_intervals * 60)::BIGINT AS lag_minutes, count(x) AS paired_observations,
  round({_corr("x", "y")}, 6) + 0.0 AS autocorrelation FROM p GROUP BY p.entity_id, p.lag_intervals""",
    "q46_hourly_profile": f"""
WITH {_GRID}, m AS (SELECT entity_id, median(v) AS m FROM grid GROUP BY 1)
SELECT 'rx_power_dbm' AS metric_name, ((tk // {_H}) % 24)::BIGINT AS hour, round(median(v - m), 6) + 0.0 AS median_centred FROM grid JOIN m USING (entity_id) GROUP BY 2""",
    "q47_context_contrast": f"""
WITH {_GRID},{_FAULTS},
j AS (SELECT f.fault_id, f.fault_type, CASE WHEN tk < onset_time THEN v END AS b, CASE WHEN tk >= onset_time THEN v END AS d, tk, onset_time, v FROM faults f
  LEFT JOIN grid g ON g.entity_id = f.entity_id AND tk >= onset_time - 24 * {_H} AND tk < end_time)
SELECT fault_id, fault_type, round(median(d) - median(b), 6) + 0.0 AS median_change_db, round(quantile_cont(d, 0.05) - median(b), 6) + 0.0 AS low_tail_change_db,
  round(CASE WHEN stddev_samp(b) > 0 THEN stddev_samp(d) / stddev_samp(b) END, 6) AS std_ratio,
  round(avg(CASE WHEN tk < onset_time THEN CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END END), 6) AS missing_before,
  round(avg(CASE WHEN tk >= onset_time THEN CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END END), 6) AS missing_during FROM j GROUP BY 1, 2""",
    "q48_structural_checks": """
WITH c AS (
  SELECT 'nation_without_region' AS "check", count(*) AS bad FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
  UNION ALL SELECT 'customer_without_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT 'order_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'line_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'order_twice', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'negative_quantity', count(*) FROM lineitem WHERE l_quantity < 0
  UNION ALL SELECT 'discount_out_of_range', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1)
SELECT "check", bad, bad = 0 AS holds FROM c""",
    "q50_topk_and_sample": "SELECT event_id, event_type, round(value, 6) AS value FROM events ORDER BY events.value DESC, event_id LIMIT 20",
    "q57_least_squares": """
WITH m AS (SELECT l_returnflag AS f, count(*) AS n, avg(l_extendedprice) AS y, avg(l_quantity) AS q, avg(l_discount) AS d, covar_pop(l_extendedprice, l_quantity) AS yq,
    covar_pop(l_extendedprice, l_discount) AS yd, var_pop(l_quantity) AS qq, var_pop(l_discount) AS dd, covar_pop(l_quantity, l_discount) AS qd FROM lineitem GROUP BY 1),
c AS (SELECT *, (yq * dd - yd * qd) / (qq * dd - qd * qd) AS b1, (yd * qq - yq * qd) / (qq * dd - qd * qd) AS b2 FROM m),
b AS (SELECT *, y - b1 * q - b2 * d AS b0 FROM c)
SELECT l_returnflag, any_value(n) AS n, round(any_value(b0), 2) AS b0, round(any_value(b1), 2) AS b1, round(any_value(b2), 2) AS b2,
  round(sqrt(avg(pow(l_extendedprice - b0 - b1 * l_quantity - b2 * l_discount, 2))), 2) AS rmse FROM lineitem JOIN b ON l_returnflag = f GROUP BY 1""",
    "q58_outcome_summary": f"""
WITH RECURSIVE {_MACHINE},{_FAULTS},{_SCOPE},{_OUTCOMES} SELECT fault_type, count(*) AS faults, count(*) FILTER (detected) AS detected,
  count(*) FILTER (opportunity) AS opportunities, round(median(delay_minutes), 6) AS median_delay_minutes FROM oc GROUP BY 1""",
    "q59_ranked_policies": """
SELECT * FROM (VALUES ('isolation_forest', 2::BIGINT, 3::BIGINT, 0.5::DOUBLE), ('isolation_forest', 2, 6, 0.5), ('statistical', 2, 3, 0.5), ('combined', 2, 3, NULL), ('combined', 3, 3, 0.9))
  r(detector, opening_intervals, closing_intervals, minimum_lead_recall)""",
    "q66_development_faults": f"""
WITH {_GRID},{_FAULTS}, t AS (SELECT * FROM faults WHERE onset_time < {_VAL} AND end_time <= {_VAL}),
w AS (SELECT t.fault_id, g.tk, g.v, lag(g.tk) OVER (PARTITION BY t.fault_id ORDER BY g.tk) AS b FROM t JOIN grid g ON g.entity_id = t.entity_id
  AND g.tk >= observable_onset_time AND g.tk <= impact_time - 7200000000),
i AS (SELECT *, sum(CASE WHEN v IS NULL OR coalesce(tk - b <> {_H}, true) THEN 1 ELSE 0 END) OVER (PARTITION BY fault_id ORDER BY tk) AS k FROM w),
c AS (SELECT DISTINCT fault_id AS chance FROM (SELECT fault_id, k FROM i WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3))
SELECT t.*, round((end_time - onset_time) / 3600e6, 6) AS duration_hours, round((impact_time - observable_onset_time) / 60e6, 6) AS warning_minutes,
  chance IS NOT NULL AS warning_opportunity_proxy FROM t LEFT JOIN c ON chance = fault_id""",
    "q52_topology": """
SELECT 'ONT-' || lpad(i::VARCHAR, 3, '0') AS entity_id, 'OLT-' || lpad((i // 64)::VARCHAR, 3, '0') AS olt_id, 'PON-' || lpad((i // 16)::VARCHAR, 3, '0') AS pon_port_id,
  'SPLITTER-' || lpad((i // 8)::VARCHAR, 3, '0') AS splitter_id FROM range(96) r(i)""",
    "q54_fec_probabilities": f"""
WITH b AS (SELECT unnest({_RATIOS}::DOUBLE[]) AS ber), p AS (SELECT ber, 1 - pow(1 - ber, 8) AS p FROM b),
t AS (SELECT ber, k, exp(lgamma(256) - lgamma(k + 1) - lgamma(256 - k) + k * ln(p) + (255 - k) * 8 * ln(1 - ber)) AS m FROM p, range(1, 256) r(k) WHERE ber > 0),
s AS (SELECT ber, sum(CASE WHEN k <= 8 THEN m ELSE 0 END) AS c, sum(CASE WHEN k > 8 THEN m ELSE 0 END) AS u FROM t GROUP BY 1)
SELECT round(b.ber * 1e9, 6) AS ber_e9, round(coalesce(c, 0), 6) AS corrected, round(coalesce(u, 0), 6) AS uncorrectable, CASE WHEN u > 0 THEN round(log10(u), 6) + 0.0 END AS log10_uncorrectable
FROM b LEFT JOIN s USING (ber)""",
    "q56_average_ranks": """
SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY round(value, 0)) + (count(*) OVER (PARTITION BY event_type, round(value, 0)) - 1) / 2.0 AS rank FROM events""",
    "q60_metric_dictionary": "SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', '{m.unit}', '{m.kind}', '{m.description}')" for k, m in METRICS.items())
    + ") t(metric_name, unit, kind, description)",
    "q61_error_regimes": """
WITH l AS (SELECT 'tens' AS measurement, floor(value / 10) AS v FROM events UNION ALL SELECT 'units', floor(value) FROM events)
SELECT measurement, count(v) AS observed, round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction, round(median(v), 6) AS median, round(quantile_cont(v, 0.99), 6) AS p99 FROM l GROUP BY 1""",
    "q62_feature_availability": f"""
WITH {_SEG}, a AS (SELECT tk, x IS NOT NULL AND pos >= 11 AS l, x IS NOT NULL AND pos >= 1 AS s, x IS NOT NULL AND pos >= 12 AS c FROM seg)
SELECT 'level' AS feature_set, 1::BIGINT AS features, round(avg(l::INT), 6) AS available_fraction, min(CASE WHEN l THEN tk END) AS first_ready FROM a
UNION ALL SELECT 'trend', 2, round(avg((l AND s)::INT), 6), min(CASE WHEN l AND s THEN tk END) FROM a
UNION ALL SELECT 'all', 3, round(avg((l AND c)::INT), 6), min(CASE WHEN l AND c THEN tk END) FROM a""",
    "q63_reason_counts": f"WITH RECURSIVE {_MACHINE} SELECT reason, count(*) AS n FROM incidents GROUP BY 1",
    "q70_segmented_scan": f"""
WITH {_GRID}, y AS (SELECT entity_id, tk, (v - 50) / 10 AS x FROM grid),{_segments('y', 'x', 'sg')},
f AS (SELECT *, CASE WHEN pos >= 3 THEN -x - 0.25 END AS fall, sum(CASE WHEN coalesce(x > 0, false) THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id ORDER BY tk) AS island FROM sg),
t AS (SELECT *, sum(fall) OVER (PARTITION BY entity_id, segment ORDER BY tk) AS s FROM f),
m AS (SELECT *, min(s) OVER (PARTITION BY entity_id, segment ORDER BY tk) AS low FROM t)
SELECT entity_id, tk AS timestamp, segment::BIGINT AS segment, pos::BIGINT AS pos,
  (sum(CASE WHEN coalesce(x > 0, false) THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, island ORDER BY tk))::BIGINT AS run,
  max(CASE WHEN x IS NOT NULL THEN tk END) OVER (PARTITION BY entity_id ORDER BY tk) AS seen,
  CASE WHEN fall IS NOT NULL THEN round(s - least(0, low), 6) + 0.0 END AS cusum FROM m""",
}
ORACLE_SQL["q71_latch_in_blocks"] = ORACLE_SQL["q30_incidents_latch"]

# Time in days since a series' first bin, with sin and cos of the day.
_SINCE = f"""{_GRID},
since AS (SELECT *, (tk - min(tk) OVER (PARTITION BY entity_id)) / 86400e6 AS days FROM grid),
ph2 AS (SELECT entity_id, tk, v, days, max(days) OVER (PARTITION BY entity_id) AS span, sin(days * 2 * pi()) AS s, cos(days * 2 * pi()) AS c FROM since)"""


def _lagged_corr(value: str, before: str) -> str:
    return _corr(f"CASE WHEN {before} IS NOT NULL THEN {value} END", f"CASE WHEN {value} IS NOT NULL THEN {before} END", 2)


# The weekly terms need 21 days before the hold-out, which the 30 days of events never have.
ORACLE_SQL["q45_holdout_r2"] = f"""
WITH {_SINCE},
l AS (SELECT *, lag(v, 1) OVER w AS l1, lag(v, 24) OVER w AS l24, days < span * 0.7 AS train FROM ph2 WINDOW w AS (PARTITION BY entity_id ORDER BY tk)),
early AS (SELECT * FROM l WHERE train),
fit AS ({_solve("early")}),
base AS (SELECT entity_id, count(v) AS observed, avg(v) AS mean, stddev_samp(v) AS std, {_lagged_corr("v", "l1")} AS lag1, {_lagged_corr("v", "l24")} AS lag_daily,
  count(v) FILTER (train) AS n_train, count(v) FILTER (NOT train) AS n_test, avg(v) FILTER (train) AS flat, max(span) * 0.7 AS cut FROM l GROUP BY 1),
err AS (SELECT l.entity_id, avg(pow(v - (c0 + c1 * s + c2 * c), 2)) AS mse, avg(pow(v - flat, 2)) AS none FROM l JOIN fit USING (entity_id) JOIN base USING (entity_id)
  WHERE NOT train AND v IS NOT NULL GROUP BY 1)
SELECT entity_id, observed, round(mean, 6) AS mean, round(std, 6) AS std, round(lag1, 6) + 0.0 AS lag1, round(lag_daily, 6) + 0.0 AS lag_daily,
  CASE WHEN n_train >= 100 AND n_test >= 30 THEN round(sqrt(c1 * c1 + c2 * c2), 6) END AS daily_amplitude,
  CASE WHEN n_train >= 100 AND n_test >= 30 THEN round(1 - mse / none, 6) + 0.0 END AS daily_holdout_r2,
  CASE WHEN cut >= 21 THEN error('weekly terms are expected to be missing') END::DOUBLE AS daily_weekly_holdout_r2
FROM base LEFT JOIN fit USING (entity_id) LEFT JOIN err USING (entity_id)"""
_RHO = math.exp(-1 / 6) * 1600 / 1609
ORACLE_SQL["q65_healthy_statistics"] = f"""
WITH {_SINCE},
fit AS ({_solve("ph2")}),
r AS (SELECT p.entity_id, tk, v - (c0 + c1 * s + c2 * c) AS r, sqrt(c1 * c1 + c2 * c2) AS a FROM ph2 p JOIN fit USING (entity_id) WHERE n >= 100),
b AS (SELECT *, lag(r) OVER (PARTITION BY entity_id ORDER BY tk) AS before FROM r),
t AS (SELECT entity_id, any_value(a) AS a, var_samp(r) AS var, {_lagged_corr("r", "before")} AS rho FROM b GROUP BY 1)
SELECT entity_id, round(a, 6) AS daily_amplitude_db, 0.5::DOUBLE AS expected_amplitude_db, round(var, 6) AS residual_variance, 1609.0::DOUBLE AS expected_variance,
  round(rho, 6) + 0.0 AS residual_lag1, round({_RHO!r}::DOUBLE, 6) AS expected_lag1, abs(a - 0.5) <= 0.1 AS amplitude_in_band, abs(var / 1609 - 1) <= 0.25 AS variance_in_band,
  coalesce(abs(rho - {_RHO!r}) <= 0.1, false) AS correlation_in_band FROM t"""


def _machine(opening: int, closing: int) -> str:
    """The state machine with other counts."""
    return _MACHINE.replace("hi2 >= 2", f"hi2 >= {opening}").replace("lo2 >= 3", f"lo2 >= {closing}")


ORACLE_SQL["q38_tune_grid"] = "\nUNION ALL ".join(
    f"""SELECT 'statistical|{o}|{c}' AS policy_id, count(*) AS incidents, count(*) FILTER (reason = 'recovery') AS recovered, round(max(max_score), 6) AS peak
FROM (WITH RECURSIVE {_machine(o, c)} SELECT * FROM incidents) HAVING count(*) > 0"""
    for o in (1, 2, 3)
    for c in (3, 6)
)
