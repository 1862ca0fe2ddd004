"""Plain SQL with the meaning of the queries in `queries_tables`, for DuckDB."""

from __future__ import annotations

KPI = """kpi AS (
SELECT CAST(((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS BIGINT) AS record_id,
 l_shipdate + INTERVAL '1' HOUR * CAST(l_orderkey % 24 AS INT) AS timestamp,
 concat('CELL_', CAST(l_suppkey AS VARCHAR)) AS cell_id,
 CASE l_returnflag WHEN 'A' THEN 'macro' WHEN 'N' THEN 'micro' ELSE 'pico' END AS cell_type,
 CASE l_orderkey % 3 WHEN 0 THEN 'HC' WHEN 1 THEN 'URLLC' ELSE 'eMBB' END AS slice_type,
 l_extendedprice / CAST(500 AS DOUBLE) AS throughput_mbps,
 CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_quantity * CAST(2 AS DOUBLE) END AS latency_ms,
 l_discount * CAST(50 AS DOUBLE) AS packet_loss_pct,
 CAST(l_linenumber AS BIGINT) AS handover_count,
 CAST(-70 - (l_partkey % 50) AS DOUBLE) AS rsrp_dbm,
 CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE CAST(-5 AS DOUBLE) - l_tax * CAST(200 AS DOUBLE) END AS rsrq_db,
 CAST((l_suppkey * 7 + l_linenumber * 13) % 100 AS DOUBLE) AS prb_utilization_pct,
 CAST(l_orderkey % 400 AS BIGINT) AS active_users,
 CASE WHEN l_orderkey % 53 = 0 THEN NULL WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END AS sla_compliant
FROM lineitem)"""

SCORED = """scored AS (
SELECT record_id, slice_type AS dataset_name, cell_type AS anomaly_family,
 coalesce(latency_ms, CAST(0 AS DOUBLE)) / CAST(100 AS DOUBLE) + packet_loss_pct / CAST(5 AS DOUBLE)
   + prb_utilization_pct / CAST(100 AS DOUBLE) AS score,
 CASE WHEN throughput_mbps < 50 OR packet_loss_pct > 4 THEN 1 ELSE 0 END AS label
FROM kpi)"""

LABELLED = """labelled AS (
SELECT *, CASE WHEN throughput_mbps < 50 OR packet_loss_pct > 4 THEN 1 ELSE 0 END AS label FROM kpi)"""

RATIOS = """basic AS (
SELECT *, throughput_mbps / nullif(active_users, 0) AS throughput_per_user,
 throughput_mbps / nullif(prb_utilization_pct, 0) AS spectral_efficiency,
 CAST(hour(timestamp) AS INT) AS hour_of_day, CAST(isodow(timestamp) - 1 AS INT) AS day_of_week,
 CAST(hour(timestamp) BETWEEN 18 AND 22 AS INT) AS is_peak_hour,
 CAST(cell_type = 'macro' AS INT) AS cell_type_macro, CAST(cell_type = 'micro' AS INT) AS cell_type_micro,
 CAST(cell_type = 'pico' AS INT) AS cell_type_pico, CAST(slice_type = 'HC' AS INT) AS slice_type_HC,
 CAST(slice_type = 'URLLC' AS INT) AS slice_type_URLLC, CAST(slice_type = 'eMBB' AS INT) AS slice_type_eMBB
FROM kpi)"""

KPIS = [
    "throughput_mbps", "latency_ms", "packet_loss_pct", "handover_count", "rsrp_dbm", "rsrq_db", "prb_utilization_pct",
    "active_users",
]
RATIO_NAMES = ["throughput_per_user", "spectral_efficiency"]
ONE_HOTS = ["cell_type_macro", "cell_type_micro", "cell_type_pico", "slice_type_HC", "slice_type_URLLC", "slice_type_eMBB"]


def r(sql: str, places: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(round({sql}, {places}) + CAST(0 AS DOUBLE))"


def query(sql: str, *ctes: str) -> str:
    return f"WITH {', '.join([KPI, *ctes])} {sql}"


_LIMITS = """percentiles AS (
SELECT {key} AS k, quantile_cont(throughput_mbps, 0.05) AS tput05, quantile_cont(throughput_mbps, 0.2) AS tput20,
 quantile_cont(latency_ms, 0.8) AS lat80, quantile_cont(latency_ms, 0.95) AS lat95,
 quantile_cont(packet_loss_pct, 0.8) AS loss80, quantile_cont(packet_loss_pct, 0.95) AS loss95,
 least(85, quantile_cont(prb_utilization_pct, 0.8)) AS prb80, least(90, quantile_cont(prb_utilization_pct, 0.9)) AS prb90,
 quantile_cont(CAST(active_users AS DOUBLE), 0.75) AS users75, quantile_cont(CAST(active_users AS DOUBLE), 0.2) AS users20,
 quantile_cont(CAST(handover_count AS DOUBLE), 0.85) AS ho85, quantile_cont(CAST(handover_count AS DOUBLE), 0.95) AS ho95
FROM kpi GROUP BY {key})"""
LIMITS = _LIMITS.format(key="slice_type")
LIMIT_NAMES = {
    "very_low_throughput": "tput05", "low_throughput": "tput20", "high_latency": "lat80", "very_high_latency": "lat95",
    "high_packet_loss": "loss80", "very_high_packet_loss": "loss95", "high_prb": "prb80", "very_high_prb": "prb90",
    "high_users": "users75", "low_users": "users20", "high_handover": "ho85", "very_high_handover": "ho95",
}

# Every comparison as a flag that is false for a missing value.
FLAGS = """flags AS (
SELECT kpi.*,
 coalesce(prb_utilization_pct >= prb90, false) AS prb_vhigh, coalesce(prb_utilization_pct >= prb80, false) AS prb_high,
 coalesce(prb_utilization_pct < prb80, false) AS prb_below, coalesce(prb_utilization_pct < 50, false) AS prb_low,
 coalesce(active_users >= users75, false) AS users_high, coalesce(active_users <= users20, false) AS users_low,
 coalesce(throughput_mbps <= tput20, false) AS tput_low, coalesce(throughput_mbps <= tput05, false) AS tput_vlow,
 coalesce(latency_ms >= lat80, false) AS lat_high, coalesce(latency_ms >= lat95, false) AS lat_vhigh,
 coalesce(packet_loss_pct >= loss80, false) AS loss_high, coalesce(packet_loss_pct >= loss95, false) AS loss_vhigh,
 coalesce(rsrp_dbm <= -115, false) AS rsrp_vweak, coalesce(rsrp_dbm <= -110, false) AS rsrp_weak,
 coalesce(rsrp_dbm > -110, false) AS rsrp_fair, coalesce(rsrq_db <= -15, false) AS rsrq_poor,
 coalesce(rsrq_db <= -18, false) AS rsrq_vpoor, coalesce(handover_count >= ho85, false) AS ho_high,
 coalesce(handover_count >= ho95, false) AS ho_vhigh
FROM kpi JOIN percentiles ON slice_type = k)"""

POINTS = """points AS (
SELECT *,
 CASE WHEN prb_vhigh THEN 3 WHEN prb_high THEN 2 ELSE 0 END + 2 * CAST(users_high AS INT) + 2 * CAST(tput_low AS INT)
  + CAST(lat_high AS INT) + CAST(loss_high AS INT) AS s1,
 3 * CAST(tput_vlow AS INT) + 2 * CAST(users_low AS INT) + 2 * CAST(prb_low AS INT) + CAST(loss_high AS INT)
  + CAST(lat_high AS INT) AS s2,
 CASE WHEN loss_vhigh THEN 3 WHEN loss_high THEN 2 ELSE 0 END + CASE WHEN lat_vhigh THEN 3 WHEN lat_high THEN 2 ELSE 0 END
  + 2 * CAST(prb_below AS INT) + CAST(tput_low AS INT) AS s3,
 CASE WHEN rsrp_vweak THEN 4 WHEN rsrp_weak THEN 3 ELSE 0 END + 2 * CAST(tput_low AS INT) + CAST(loss_high AS INT)
  + CAST(rsrq_poor AS INT) AS s4,
 CASE WHEN rsrq_vpoor THEN 4 WHEN rsrq_poor THEN 3 ELSE 0 END + 2 * CAST(loss_high AS INT) + CAST(lat_high AS INT)
  + CAST(rsrp_fair AS INT) AS s5,
 CASE WHEN ho_vhigh THEN 4 WHEN ho_high THEN 3 ELSE 0 END + 2 * CAST(loss_high AS INT) + CAST(lat_high AS INT)
  + CAST(tput_low AS INT) AS s6,
 concat_ws(', ', CASE WHEN tput_low THEN 'throughput_mbps' END, CASE WHEN lat_high THEN 'latency_ms' END,
  CASE WHEN loss_high THEN 'packet_loss_pct' END, CASE WHEN prb_high THEN 'prb_utilization_pct' END,
  CASE WHEN users_high OR users_low THEN 'active_users' END, CASE WHEN rsrp_weak THEN 'rsrp_dbm' END,
  CASE WHEN rsrq_poor THEN 'rsrq_db' END, CASE WHEN ho_high THEN 'handover_count' END) AS all_affected
FROM flags)"""

CAUSES = """causes AS (
SELECT *, CASE WHEN NOT issue THEN 'Normal' WHEN top < 3 THEN 'Generic SLA Degradation / Needs Investigation'
 WHEN s2 = top THEN 'Suspected Cell Outage / Severe Service Drop' WHEN s1 = top THEN 'RAN Congestion'
 WHEN s3 = top THEN 'Backhaul / Transport Issue' WHEN s4 = top THEN 'Radio Coverage Degradation'
 WHEN s5 = top THEN 'Interference / Poor Signal Quality' ELSE 'Mobility / Handover Issue' END AS root_cause
FROM (SELECT *, greatest(s1, s2, s3, s4, s5, s6) AS top,
 CASE WHEN sla_compliant IS NOT NULL THEN sla_compliant <> 1 ELSE all_affected <> '' END AS issue FROM points))"""


def _signal(flag: str, label: str, kpi: str) -> str:
    return f"CASE WHEN {flag} THEN '{label} (' || CAST({kpi} AS VARCHAR) || ')' END"


_T, _L, _P = "throughput_mbps", "latency_ms", "packet_loss_pct"
_LOW_T = _signal("tput_low", "low throughput", _T)
_HIGH_L = _signal("lat_high", "high latency", _L)
_HIGH_P = _signal("loss_high", "high packet loss", _P)
_SIGNALS = {
    "RAN Congestion": [
        _signal("prb_vhigh", "very high PRB utilization", "prb_utilization_pct"),
        _signal("prb_high AND NOT prb_vhigh", "high PRB utilization", "prb_utilization_pct"),
        _signal("users_high", "high active users", "active_users"), _LOW_T, _HIGH_L, _HIGH_P,
    ],
    "Suspected Cell Outage / Severe Service Drop": [
        _signal("tput_vlow", "very low throughput", _T), _signal("users_low", "low active users", "active_users"),
        _signal("prb_low", "low PRB utilization", "prb_utilization_pct"), _HIGH_P, _HIGH_L,
    ],
    "Backhaul / Transport Issue": [
        _signal("loss_vhigh", "very high packet loss", _P), _signal("loss_high AND NOT loss_vhigh", "high packet loss", _P),
        _signal("lat_vhigh", "very high latency", _L), _signal("lat_high AND NOT lat_vhigh", "high latency", _L),
        _signal("prb_below", "PRB below congestion threshold", "prb_utilization_pct"), _LOW_T,
    ],
    "Radio Coverage Degradation": [
        _signal("rsrp_vweak", "very weak RSRP", "rsrp_dbm"), _signal("rsrp_weak AND NOT rsrp_vweak", "weak RSRP", "rsrp_dbm"),
        _LOW_T, _HIGH_P, _signal("rsrq_poor", "poor RSRQ", "rsrq_db"),
    ],
    "Interference / Poor Signal Quality": [
        _signal("rsrq_vpoor", "very poor RSRQ", "rsrq_db"), _signal("rsrq_poor AND NOT rsrq_vpoor", "poor RSRQ", "rsrq_db"),
        _HIGH_P, _HIGH_L, _signal("rsrp_fair", "RSRP not severely weak", "rsrp_dbm"),
    ],
    "Mobility / Handover Issue": [
        _signal("ho_vhigh", "very high handover count", "handover_count"),
        _signal("ho_high AND NOT ho_vhigh", "high handover count", "handover_count"), _HIGH_P, _HIGH_L, _LOW_T,
    ],
}


def _signals(separator: str) -> str:
    branches = " ".join(f"WHEN '{c}' THEN concat_ws('{separator}', {', '.join(items)})" for c, items in _SIGNALS.items())
    return f"CASE root_cause {branches} ELSE '' END"


_SCORE = {
    "RAN Congestion": "s1", "Suspected Cell Outage / Severe Service Drop": "s2", "Backhaul / Transport Issue": "s3",
    "Radio Coverage Degradation": "s4", "Interference / Poor Signal Quality": "s5", "Mobility / Handover Issue": "s6",
}
_SCORE_NAMES = ["congestion_score", "outage_score", "backhaul_score", "coverage_score", "interference_score", "mobility_score"]
_CLEARED = {c: f"CASE WHEN root_cause = 'Normal' THEN 0 ELSE {s} END" for c, s in _SCORE.items()}
_BREAKDOWN = " || '; ' || ".join(f"'{c}=' || CAST({s} AS VARCHAR)" for c, s in _CLEARED.items())
_ACTIONS = {
    "Normal": "No action required",
    "RAN Congestion": "Check PRB utilization trend | Verify active user count | Check neighboring cell load | Consider load balancing or capacity optimization",
    "Suspected Cell Outage / Severe Service Drop": "Check cell availability alarms | Verify site power/backhaul status | Check recent configuration changes | Escalate to field operations team",
    "Backhaul / Transport Issue": "Check transport link health | Verify latency and packet loss on backhaul path | Check router/switch interface errors | Escalate to transport team",
    "Radio Coverage Degradation": "Check RSRP trend | Inspect antenna or site coverage issues | Verify antenna tilt, power, and configuration | Check coverage complaints if available",
    "Interference / Poor Signal Quality": "Check RSRQ/SINR degradation | Check neighboring cell interference | Verify frequency planning | Investigate external interference sources",
    "Mobility / Handover Issue": "Check handover counters | Review neighbor relation configuration | Check mobility parameter changes | Analyze source-target handover patterns",
    "Generic SLA Degradation / Needs Investigation": "Review related KPIs | Check alarms and logs | Continue investigation",
}
_SEVERITIES = {
    "Normal": "Normal", "Suspected Cell Outage / Severe Service Drop": "Critical", "RAN Congestion": "High",
    "Backhaul / Transport Issue": "High", "Radio Coverage Degradation": "High", "Interference / Poor Signal Quality": "Medium",
    "Mobility / Handover Issue": "Medium", "Generic SLA Degradation / Needs Investigation": "Low",
}


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_CONFIDENCE = (
    "CASE WHEN root_cause = 'Normal' THEN CAST(0.95 AS DOUBLE) WHEN top < 3 THEN CAST(0.5 AS DOUBLE) "
    "WHEN top >= 7 THEN CAST(0.9 AS DOUBLE) WHEN top >= 5 THEN CAST(0.8 AS DOUBLE) WHEN top = 4 THEN CAST(0.7 AS DOUBLE) "
    "ELSE CAST(0.6 AS DOUBLE) END"
)
ROWS = f"""result AS (
SELECT *, {_signals(' | ')} AS signals, {_signals(', ')} AS reason,
 CASE WHEN root_cause = 'Normal' THEN '' ELSE all_affected END AS affected,
 {_case('root_cause', _SEVERITIES)} AS severity, {_CONFIDENCE} AS confidence_score,
 {_BREAKDOWN} AS score_breakdown, {_case('root_cause', _ACTIONS)} AS actions
FROM causes)"""
EXPLANATION = (
    "CASE WHEN root_cause = 'Normal' THEN 'SLA is compliant, so no RCA issue was detected.' WHEN top < 3 THEN "
    "'The row violates SLA, but the KPI pattern does not strongly match congestion, outage, backhaul, radio, interference, "
    "or mobility rules.' WHEN reason <> '' THEN 'The row is classified as ' || root_cause || ' because ' || reason || '.' "
    "ELSE 'The row is classified as ' || root_cause || ' based on the strongest KPI score.' END"
)
RCA = [LIMITS, FLAGS, POINTS, CAUSES, ROWS]


def rca_query(columns: str, where: str = "true") -> str:
    return query(f"SELECT {columns} FROM result WHERE {where}", *RCA)


TIME = "strftime(timestamp, '%Y-%m-%d %H:%M:%S')"
INCIDENT = "'INC-' || lpad(CAST(row_number() OVER (ORDER BY record_id) AS VARCHAR), 6, '0')"
_RISK = "(score - (SELECT min(score) FROM scored)) / (SELECT max(score) - min(score) FROM scored)"
_STATUS = "CASE WHEN anomaly_score <= 0.3 THEN 'Healthy' WHEN anomaly_score <= 0.6 THEN 'Moderate Risk' ELSE 'High Risk' END"
SCORE_TABLE = f"score_table AS (SELECT *, {_STATUS} AS status FROM (SELECT record_id, round_even({_RISK}, 4) AS anomaly_score, label FROM scored))"

_SET = "CASE anomaly_family WHEN 'macro' THEN 'stress_test_dataset_rate_0p05' WHEN 'micro' THEN 'stress_test_dataset_rate_0p1' ELSE 'cross_dataset_pico' END"

PAIRS = {
    "latency_x_packet_loss": "latency_ms * packet_loss_pct",
    "latency_per_throughput": "latency_ms / (abs(throughput_mbps) + 0.001::DOUBLE)",
    "throughput_per_prb": "throughput_mbps / (abs(prb_utilization_pct) + 0.001::DOUBLE)",
    "active_users_x_utilization": "active_users * prb_utilization_pct",
    "rsrp_x_rsrq": "rsrp_dbm * rsrq_db",
    "spectral_efficiency_x_utilization": "spectral_efficiency * prb_utilization_pct",
    "throughput_per_user_x_latency": "throughput_per_user * latency_ms",
    "packet_loss_per_signal_quality": "packet_loss_pct / (abs(rsrq_db) + 0.001::DOUBLE)",
    "handover_per_signal_strength": "handover_count / (abs(rsrp_dbm) + 0.001::DOUBLE)",
    "latency_x_utilization": "latency_ms * prb_utilization_pct",
    "loss_x_handover": "packet_loss_pct * handover_count",
    "users_per_throughput": "active_users / (abs(throughput_mbps) + 0.001::DOUBLE)",
    "utilization_per_spectral_efficiency": "prb_utilization_pct / (abs(spectral_efficiency) + 0.001::DOUBLE)",
}
INDICES = {
    "service_degradation_index": "latency_ms + packet_loss_pct - throughput_mbps",
    "congestion_pressure_index": "active_users + prb_utilization_pct - throughput_per_user",
    "radio_quality_index": "rsrp_dbm + rsrq_db + spectral_efficiency",
    "peak_load_pressure": "is_peak_hour * (active_users + prb_utilization_pct)",
    "urllc_risk_pressure": "slice_type_URLLC * (latency_ms + packet_loss_pct)",
    "embb_capacity_pressure": "slice_type_eMBB * (prb_utilization_pct / (abs(throughput_mbps) + 0.001::DOUBLE))",
}
_CONTEXT = [
    "latency_ms", "packet_loss_pct", "throughput_mbps", "prb_utilization_pct", "active_users", "throughput_per_user",
    "spectral_efficiency", "rsrp_dbm", "rsrq_db",
]


def _z(columns: list[str], source: str) -> str:
    stats = ", ".join(
        f"median(CAST({c} AS DOUBLE)) AS {c}_med, quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25) AS {c}_iqr, "
        f"avg({c}) AS {c}_avg, stddev_samp({c}) AS {c}_sd"
        for c in columns
    )
    cells = ", ".join(
        f"{r(f'({c} - {c}_med) / ({c}_iqr + 0.001::DOUBLE)')} AS {c}_robust_context_z, "
        f"{r(f'({c} - {c}_avg) / ({c}_sd + 0.001::DOUBLE)')} AS {c}_batch_z"
        for c in columns
    )
    return query(f"SELECT record_id, {cells} FROM basic, stats", RATIOS, f"stats AS (SELECT {stats} FROM {source})")


_NAMES = [
    "cell_type", "slice_type", *KPIS, "sla_compliant", "hour_of_day", "day_of_week", "is_peak_hour", *RATIO_NAMES, *ONE_HOTS,
]
_WIDE = f"wide AS (SELECT *, {', '.join(f'{s} AS {n}' for n, s in {**PAIRS, **INDICES}.items())} FROM basic)"
_COUNTS = "counts AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, count({n}) AS present FROM wide" for n in [*_NAMES, *PAIRS, *INDICES]
) + ")"
FEATURE_COUNTS = [RATIOS, _WIDE, _COUNTS]
_KPI_LIST = ", ".join(f"'{c}'" for c in KPIS)
_KPI_WORDS = "throughput|latency|packet_loss|handover|rsrp|rsrq|prb|active_users|sla|spectral_efficiency"


def _first_match(pairs: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(feature), '{w}') THEN '{t}'" for w, t in pairs) + f" ELSE '{other}' END"


MEANING = _first_match(
    [
        ("latency", "Service delay and responsiveness"), ("packet_loss", "Packet delivery reliability"),
        ("throughput", "Traffic carrying performance"), ("prb", "Radio resource utilization"), ("active_users", "Cell user load"),
        ("rsrp", "Radio signal strength"), ("rsrq", "Radio signal quality"), ("spectral", "Radio efficiency"),
        ("handover", "Mobility stability"), ("congestion", "Load and capacity pressure"),
        ("service_degradation", "Combined latency/loss/throughput degradation"), ("radio_quality", "Combined signal health"),
        ("urllc", "URLLC slice SLA pressure"), ("embb", "eMBB capacity pressure"),
    ],
    "General telecom operating context",
)
USE = _first_match(
    [
        ("latency|packet_loss", "Captures service degradation and transport instability."),
        ("throughput|spectral", "Highlights capacity loss and radio efficiency collapse."),
        ("rsrp|rsrq", "Detects coverage and signal-quality degradation."),
        ("active_users|prb|congestion", "Identifies load pressure, resource saturation, and congestion."),
        ("slice", "Separates slice-specific behavior and SLA risk."),
    ],
    "Provides contextual separation for anomalous telecom states.",
)

_SCALED_STATS = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in [*KPIS, *RATIO_NAMES])
_SCALED = f"""scaled AS (SELECT record_id, {', '.join(f'({c} - {c}_m) / {c}_s AS {c}' for c in [*KPIS, *RATIO_NAMES])},
 throughput_mbps < 50 OR packet_loss_pct > 4 AS label FROM basic, (SELECT {_SCALED_STATS} FROM basic))"""

_SLA = "CASE WHEN throughput_mbps < 50 OR latency_ms > 80 OR packet_loss_pct > 3 OR prb_utilization_pct > 90 OR rsrp_dbm < -115 OR rsrq_db < -18 THEN 0 ELSE 1 END"

_RECOMMENDED = {
    "Backhaul / Transport Issue": "Check transport link utilization | Verify backhaul capacity and throughput | Inspect transmission links and interfaces | Review transport alarms and packet drops | Monitor latency and congestion trends",
    "Interference / Poor Signal Quality": "Review RSRP and RSRQ trends | Analyze uplink and downlink interference levels | Check neighboring cell PCI/frequency conflicts | Inspect antenna alignment and transmit power | Perform spectrum analysis if interference persists",
    "Mobility / Handover Issue": "Review handover success and failure statistics | Verify neighbor relation configuration | Check handover parameter settings | Investigate ping-pong handovers | Monitor mobility KPIs after optimization",
    "Normal": "No corrective action required | Continue routine KPI monitoring | Record observation for trend analysis",
    "Radio Coverage": "Review RSRP coverage distribution | Verify antenna tilt and azimuth configuration | Inspect potential physical obstructions | Check site transmit power settings | Validate coverage using drive-test or MDT data",
    "RAN Congestion": "Review PRB utilization trends | Check active user distribution | Enable or verify load balancing | Review traffic steering configuration | Evaluate capacity expansion if congestion persists",
    "Suspected Cell Outage": "Verify cell availability status | Check power and hardware alarms | Inspect radio unit and baseband connectivity | Verify transmission link status | Escalate to field maintenance if the cell remains unavailable",
    "Generic SLA Degradation / Needs Investigation": "Review affected KPI trends | Verify recent configuration changes | Check neighboring cell performance | Escalate to Network Operations if the issue persists",
}
_SHORT = "CASE root_cause WHEN 'Suspected Cell Outage / Severe Service Drop' THEN 'Suspected Cell Outage' WHEN 'Radio Coverage Degradation' THEN 'Radio Coverage' ELSE root_cause END"

_JSON_OUTCOME = "CASE handover_count WHEN 7 THEN 'not_an_object' WHEN 6 THEN 'bad_json' WHEN 5 THEN 'not_an_object' ELSE CASE WHEN latency_ms IS NULL OR rsrq_db IS NULL THEN 'missing_fields' ELSE 'ok' END END"
_MISSING = "concat_ws(',', CASE WHEN latency_ms IS NULL THEN 'latency_ms' END, CASE WHEN rsrq_db IS NULL THEN 'rsrq_db' END)"

_ALL_LIMITS = [*LIMIT_NAMES, "weak_rsrp", "poor_rsrq", "very_poor_rsrq"]
_FIXED = "CAST(-110 AS DOUBLE) AS weak_rsrp, CAST(-15 AS DOUBLE) AS poor_rsrq, CAST(-18 AS DOUBLE) AS very_poor_rsrq"
_LIMIT_COLUMNS = ", ".join(f"{r(s)} AS {n}" for n, s in LIMIT_NAMES.items()) + ", " + _FIXED
_SLICELESS = "CASE WHEN sla_compliant IS NULL THEN NULL ELSE slice_type END"

_CELLS = " UNION ALL ".join(
    f"SELECT row, l_orderkey, l_linenumber, l_returnflag, '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM lines"
    for c in ("l_partkey", "l_suppkey", "l_linestatus")
)
SPARSE = f"""lines AS MATERIALIZED (SELECT row_number() OVER () AS row, * FROM lineitem), cells AS ({_CELLS}),
codes AS (SELECT feature, value, row_number() OVER (ORDER BY feature, value) - 1 AS position
 FROM (SELECT DISTINCT feature, value FROM cells WHERE l_returnflag <> 'R' AND value IS NOT NULL))"""

ORACLE = {
    "scan_kpi_csv": query(f"SELECT * REPLACE ({TIME} AS timestamp) FROM kpi"),
    "scan_dataset_glob": query(
        f"SELECT {_SET} AS dataset_name, count(*) AS rows, {r('avg(score)')} AS mean_score, CAST(sum(label) AS BIGINT) AS positives FROM scored GROUP BY 1",
        SCORED,
    ),
    "rate_from_path": query(
        f"SELECT dataset_name, CASE dataset_name WHEN 'stress_test_dataset_rate_0p05' THEN CAST(0.05 AS DOUBLE) WHEN 'stress_test_dataset_rate_0p1' "
        f"THEN CAST(0.1 AS DOUBLE) ELSE {r('avg(label)')} END AS anomaly_rate, count(*) AS rows "
        f"FROM (SELECT {_SET} AS dataset_name, label FROM scored) GROUP BY 1",
        SCORED,
    ),
    "scan_json_records": query(
        f"SELECT outcome, CASE WHEN outcome IN ('ok', 'missing_fields') THEN gaps END AS missing, count(*) AS n, "
        f"{r('''sum(CASE WHEN outcome = 'ok' THEN throughput_mbps END)''')} AS throughput "
        f"FROM (SELECT *, {_JSON_OUTCOME} AS outcome, {_MISSING} AS gaps FROM kpi) GROUP BY 1, 2"
    ),
    "require_fields": query(
        "SELECT record_id, concat_ws(', ', CASE WHEN latency_ms IS NULL THEN 'latency_ms' END, CASE WHEN rsrq_db IS NULL THEN 'rsrq_db' END) AS missing_fields FROM kpi"
    ),
    "read_feature_report": query(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, '{t}' AS dtype FROM kpi HAVING var_pop({c}) > 0"
            for c, t in {**{c: "bigint" if c in ("handover_count", "active_users") else "double" for c in KPIS}, "sla_compliant": "int"}.items()
        )
    ),
    "sink_csv": rca_query(f"record_id, root_cause, signals, {EXPLANATION} AS explanation, confidence_score"),
    "json_records": query(
        "SELECT '{\"record_id\":' || CAST(record_id AS VARCHAR) || ',\"anomaly_score\":' || "
        "CASE WHEN anomaly_score > 0 AND anomaly_score < 0.001 THEN CAST(CAST(anomaly_score * 10000 AS INT) AS VARCHAR) || '.0E-4' ELSE CAST(anomaly_score AS VARCHAR) END "
        "|| ',\"status\":\"' || status || '\"}' AS record FROM score_table",
        SCORED, SCORE_TABLE,
    ),
    "doc_listing": "SELECT name || '.parquet' AS source_filename, name AS document_id FROM (SELECT unnest(['region', 'nation', 'customer', 'supplier', "
    "'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name)",
    "page_metadata": "SELECT 'kb/' || lang || '/' || source || '.v' || CAST(doc_id AS VARCHAR) || '.pdf' AS source, "
    "source || '.v' || CAST(doc_id AS VARCHAR) || '.pdf' AS source_filename, CAST(n_chars + 1 AS INT) AS page_number, "
    "source || '.v' || CAST(doc_id AS VARCHAR) AS document_id, CAST(length(text) AS INT) AS length FROM documents WHERE text IS NOT NULL",
    "trim_columns": query("SELECT record_id, cell_id, throughput_mbps FROM kpi"),
    "coerce_types": query(
        f"SELECT record_id, CASE WHEN cell_type <> 'pico' THEN throughput_mbps END AS number, CASE WHEN cell_type <> 'macro' THEN {TIME} END AS time FROM kpi"
    ),
    "time_features": query("SELECT record_id, hour_of_day, day_of_week, is_peak_hour FROM basic", RATIOS),
    "ratio_features": query(f"SELECT record_id, {', '.join(RATIO_NAMES)} FROM basic", RATIOS),
    "clean_infinite": query(
        "SELECT record_id, coalesce(throughput_per_user, 0) AS per_user, coalesce(spectral_efficiency, 0) AS per_block FROM basic", RATIOS
    ),
    "one_hot_static": query(f"SELECT record_id, {', '.join(ONE_HOTS)} FROM basic", RATIOS),
    "one_hot_dynamic": "SELECT event_id, " + ", ".join(
        f"CAST(event_type = '{t}' AS INT) AS event_type_{t}" for t in ("click", "purchase", "signup", "view")
    ) + " FROM events",
    "one_hot_sparse": f"WITH {SPARSE} SELECT l_orderkey, l_linenumber, coalesce(string_agg(CAST(position AS VARCHAR), ',' ORDER BY position), '') AS positions "
    "FROM cells LEFT JOIN codes USING (feature, value) GROUP BY row, l_orderkey, l_linenumber",
    "one_hot_shares": f"WITH {SPARSE}, sizes AS (SELECT l_returnflag, count(*) AS size FROM lineitem GROUP BY l_returnflag) "
    "SELECT l_returnflag, feature, value, count(*) AS ones, round(count(*) / any_value(size), 9) AS share "
    "FROM cells JOIN codes USING (feature, value) JOIN sizes USING (l_returnflag) GROUP BY l_returnflag, feature, value",
    "label_encode": query(
        "SELECT record_id, cell_type, CASE cell_type WHEN 'macro' THEN CAST(3 AS DOUBLE) WHEN 'micro' THEN CAST(8 AS DOUBLE) ELSE "
        "(SELECT median(CASE cell_type WHEN 'macro' THEN CAST(3 AS DOUBLE) ELSE CAST(8 AS DOUBLE) END) FROM kpi WHERE cell_type <> 'pico') END AS cell_type_enc FROM kpi"
    ),
    "distinct_mapping": query(
        "SELECT DISTINCT cell_type, CASE cell_type WHEN 'macro' THEN CAST(3 AS DOUBLE) ELSE CAST(8 AS DOUBLE) END AS cell_type_enc FROM kpi WHERE cell_type <> 'pico'"
    ),
    "minmax_vs_reference": query(
        "SELECT record_id, " + ", ".join(f"{r(f'({c} - {c}_lo) / ({c}_hi - {c}_lo)')} AS {c}_norm" for c in [*KPIS, *RATIO_NAMES]) + " FROM basic, ends",
        RATIOS,
        "ends AS (SELECT " + ", ".join(
            f"min(CAST({c} AS DOUBLE)) AS {c}_lo, max(CAST({c} AS DOUBLE)) AS {c}_hi" for c in [*KPIS, *RATIO_NAMES]
        ) + " FROM basic WHERE cell_type = 'macro')",
    ),
    "pair_features": query(f"SELECT record_id, {', '.join(f'CAST({s} AS DOUBLE) AS {n}' for n, s in PAIRS.items())} FROM basic", RATIOS),
    "composite_indices": query(f"SELECT record_id, {', '.join(f'{s} AS {n}' for n, s in INDICES.items())} FROM basic", RATIOS),
    "context_z": _z(_CONTEXT, "basic"),
    "reference_stats_join": _z(_CONTEXT, "basic WHERE cell_type = 'macro'"),
    "drop_id_time": query("SELECT * EXCLUDE (record_id, timestamp, cell_id) FROM kpi"),
    "split_types": query(
        " UNION ALL ".join(
            [f"SELECT 'kpi' AS source, '{c}' AS feature, '{k}' AS kind, count({c}) AS present FROM kpi" for c, k in {
                **{"record_id": "numeric", "timestamp": "other", "cell_id": "categorical", "cell_type": "categorical", "slice_type": "categorical"},
                **dict.fromkeys([*KPIS, "sla_compliant"], "numeric"),
            }.items()]
            + [f"SELECT 'events' AS source, '{c}' AS feature, '{k}' AS kind, count({c}) AS present FROM events" for c, k in {
                "event_id": "numeric", "ts": "other", "user_id": "numeric", "event_type": "categorical", "value": "numeric", "props": "categorical",
            }.items()]
        )
    ),
    "kpi_columns": query(f"SELECT * FROM counts WHERE regexp_matches(lower(feature), '{_KPI_WORDS}')", *FEATURE_COUNTS),
    "feature_taxonomy": query(
        "SELECT *, CASE WHEN regexp_matches(feature, '^(cell_type_|slice_type_)') THEN 'encoded_categorical' WHEN regexp_matches(feature, '_z$|ratio|index|_x_|_per_') "
        f"THEN 'engineered_numeric' ELSE 'numeric' END AS feature_type, {MEANING} AS business_interpretation, {USE} AS usefulness_reason FROM counts",
        *FEATURE_COUNTS,
    ),
    "risk_status": query("SELECT record_id, anomaly_score, status FROM score_table", SCORED, SCORE_TABLE),
    "risk_level": query(
        "SELECT record_id, CASE WHEN label = 1 AND (score - lo) / (hi - lo + 1e-9) >= 0.75 THEN 'High Risk' WHEN label = 1 THEN 'Moderate Risk' ELSE 'Healthy' END AS risk_level "
        "FROM scored, (SELECT min(score) AS lo, max(score) AS hi FROM scored)",
        SCORED,
    ),
    "family_candidate": query(
        "SELECT record_id, CASE WHEN NOT label THEN 'Unknown' WHEN prb_utilization_pct > active_users AND latency_ms > 0 THEN 'Congestion' "
        "WHEN rsrp_dbm < -0.75 OR rsrq_db < -0.75 THEN 'Coverage' WHEN active_users > 1 AND throughput_per_user < -0.5 THEN 'Capacity' "
        "WHEN rsrq_db < -0.75 OR spectral_efficiency < -0.75 THEN 'Signal Quality' WHEN latency_ms > 1 AND packet_loss_pct > 1 THEN 'Transport' "
        "WHEN active_users > 1 THEN 'User Surge' ELSE 'Unknown' END AS family FROM scaled",
        RATIOS, _SCALED,
    ),
    "sla_infer": query(f"SELECT record_id, {_SLA} AS sla FROM kpi"),
    "enrich_defaults": query(
        f"SELECT record_id, CASE WHEN cell_type = 'macro' THEN '2024-01-01 00:00:00' ELSE {TIME} END AS timestamp, "
        "CASE WHEN handover_count = 1 THEN 'LIVE_INPUT' ELSE cell_id END AS cell_id, CASE WHEN handover_count = 2 THEN 'unknown' ELSE cell_type END AS cell_type, "
        "CASE WHEN handover_count = 3 THEN 'unknown' ELSE slice_type END AS slice_type, "
        "CASE WHEN handover_count = 4 THEN 'core' WHEN handover_count = 3 THEN 'unknown' ELSE slice_type END AS network_slice, "
        f"CASE WHEN handover_count = 5 THEN CAST({_SLA} AS VARCHAR) ELSE CAST(sla_compliant AS VARCHAR) END AS sla_compliant FROM kpi"
    ),
    "live_incident_id": query(
        "SELECT record_id, 'LIVE-' || strftime(timestamp, '%Y%m%d%H%M%S') || '-' || CAST(record_id AS VARCHAR) AS incident_id FROM kpi"
    ),
    "rca_sla_gate": rca_query("record_id, issue AS is_issue"),
    "rca_rule_scores": rca_query("record_id, " + ", ".join(f"CAST({s} AS INT) AS {n}" for s, n in zip(_SCORE.values(), _SCORE_NAMES))),
    "rca_signals": rca_query("record_id, signals"),
    "rca_affected_kpis": rca_query("record_id, affected"),
    "rca_classify": rca_query("record_id, root_cause, CAST(CASE WHEN root_cause = 'Normal' THEN 0 ELSE top END AS INT) AS top_score"),
    "rca_confidence": rca_query("record_id, confidence_score"),
    "rca_severity_actions": rca_query("record_id, severity, actions"),
    "rca_explanation": rca_query(f"record_id, {EXPLANATION} AS explanation"),
    "score_breakdown_text": rca_query("record_id, score_breakdown"),
    "score_breakdown_parse": rca_query("record_id, " + ", ".join(f"CAST({s} AS INT) AS {n}" for s, n in zip(_CLEARED.values(), _SCORE_NAMES))),
    "split_lists": rca_query(
        "record_id, CAST(CASE WHEN signals = '' THEN 0 ELSE len(string_split(signals, ' | ')) END AS INT) AS n_signals, "
        "nullif(string_split(signals, ' | ')[1], '') AS first_signal, "
        "CAST(CASE WHEN affected = '' THEN 0 ELSE len(string_split(affected, ', ')) END AS INT) AS n_affected, "
        "nullif(string_split(affected, ', ')[-1], '') AS last_affected"
    ),
    "incident_id": rca_query(
        f"{INCIDENT} AS incident_id, {TIME} AS timestamp, cell_id AS \"cell_id/site_id\", slice_type AS network_slice, sla_compliant, root_cause"
    ),
    "adapt_incident": rca_query(
        f"{INCIDENT} AS incident_id, {TIME} AS timestamp, cell_id, cell_type, slice_type AS network_slice, slice_type, sla_compliant, root_cause, severity, "
        f"confidence_score AS confidence, affected AS affected_kpis, signals AS matched_signals, score_breakdown, {EXPLANATION} AS explanation"
    ),
    "incident_listing": query(
        f"SELECT * FROM (SELECT {INCIDENT} AS incident_id, cell_id, root_cause, severity FROM result) WHERE root_cause <> 'Normal'", *RCA
    ),
    "retrieval_query_text": rca_query(
        f"record_id, 'Root Cause: ' || root_cause || chr(10) || '    Severity: ' || severity || chr(10) || '    Network Slice: ' || slice_type || chr(10) || "
        f"'    Affected KPIs: ' || affected || chr(10) || '    RCA Explanation: ' || {EXPLANATION} AS query",
        "root_cause <> 'Normal'",
    ),
    "slice_thresholds": query(
        f"SELECT k AS slice_type, {_LIMIT_COLUMNS} FROM percentiles UNION ALL BY NAME SELECT '__all__' AS slice_type, {_LIMIT_COLUMNS} FROM every",
        LIMITS, _LIMITS.replace("percentiles AS", "every AS").replace("GROUP BY {key}", "").format(key="1"),
    ),
    "slice_threshold_join": query(
        f"SELECT record_id, {', '.join(_ALL_LIMITS)} FROM (SELECT record_id, {_SLICELESS} AS s FROM kpi) "
        f"JOIN (SELECT k, {_LIMIT_COLUMNS} FROM percentiles WHERE k IS NOT NULL UNION ALL BY NAME SELECT NULL AS k, {_LIMIT_COLUMNS} FROM every) ON s IS NOT DISTINCT FROM k",
        _LIMITS.format(key=_SLICELESS).replace("GROUP BY " + _SLICELESS, "GROUP BY ALL"),
        _LIMITS.replace("percentiles AS", "every AS").replace("GROUP BY {key}", "").format(key="1"),
    ),
    "calibration_join": query(
        f"SELECT count(*) AS rows, {r('min(CASE WHEN latency_ms >= 96 AND packet_loss_pct >= 4 THEN score END)')} AS threshold FROM scored JOIN kpi USING (record_id)",
        SCORED,
    ),
    "recommendation_join": rca_query(f"record_id, cell_id, {_SHORT} AS root_cause, {_case(_SHORT, _RECOMMENDED)} AS recommendations"),
    "semi_join_features": query(f"SELECT * FROM counts WHERE feature IN ({_KPI_LIST})", *FEATURE_COUNTS),
    "new_features_anti": query(f"SELECT * FROM counts WHERE feature NOT IN ({_KPI_LIST})", *FEATURE_COUNTS),
    "union_frames": query(
        f"SELECT record_id, dataset_name, {r('score')} AS score, label, CASE label WHEN 0 THEN 'normal' ELSE 'faulty' END AS source FROM scored", SCORED
    ),
}
