"""Plain SQL with the meaning of the queries in `queries_stats`, for DuckDB."""

from __future__ import annotations

from itertools import combinations_with_replacement

from cellsight.plans.oracle_tables import FLAGS, KPIS, LABELLED, LIMITS, MEANING, POINTS, CAUSES, RATIO_NAMES, RATIOS, SCORED, SCORE_TABLE, USE, query, r

ALL = [*KPIS, *RATIO_NAMES]
_USES = [LIMITS, FLAGS, POINTS, CAUSES]


def _long(columns: list[str], source: str, keep: str = "") -> str:
    return "long AS (" + " UNION ALL ".join(
        f"SELECT {keep}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source} WHERE {c} IS NOT NULL" for c in columns
    ) + ")"


def _u(key: str, seed: str) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8)) AS UBIGINT) / CAST(4294967296 AS DOUBLE))"


# Two columns that follow others, and one constant.
_FLAT = "flat AS (SELECT *, CAST(0 AS DOUBLE) AS constant_col, throughput_mbps * 2 + 1 AS doubled, -latency_ms AS latency_negated FROM kpi)"
_SELECTION = [*KPIS, "constant_col", "doubled", "latency_negated"]
_POSITIONS = {c: i for i, c in enumerate(KPIS)}


def _pairs(f: str) -> str:
    parts = []
    for a, b in combinations_with_replacement(KPIS, 2):
        parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {f}({a}, {b}) AS v FROM kpi")
        if a != b:
            parts.append(f"SELECT '{b}' AS feature_a, '{a}' AS feature_b, {f}({a}, {b}) AS v FROM kpi")
    return " UNION ALL ".join(parts)


def _report(columns: dict[str, tuple[str, str, str]], source: str) -> str:
    words = "throughput|latency|packet_loss|handover|rsrp|rsrq|prb|active_users|sla|spectral_efficiency"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{t}' AS dtype, count(*) - count({c}) AS missing_count, "
        f"{r(f'var_samp({c})') if t != 'string' else 'CAST(NULL AS DOUBLE)'} AS variance, {k} AS is_kpi, '{d}' AS decision FROM {source}"
        for c, (t, k, d) in columns.items()
    )


_TYPES = {c: "bigint" if c in ("handover_count", "active_users") else "double" for c in KPIS}
_REPORT = {"cell_type": ("string", "false", "not_numeric_or_excluded"), "slice_type": ("string", "false", "not_numeric_or_excluded")}
_REPORT |= {c: (_TYPES[c], "true", "selected") for c in KPIS}
_SELECTED = _REPORT | {
    "sla_compliant": ("int", "true", "selected"),
    "constant_col": ("double", "false", "removed_low_variance"),
    "doubled": ("double", "false", "removed_high_correlation"),
    "latency_negated": ("double", "true", "selected"),
}

# Power of the KPIs -------------------------------------------------------------------------------
_LONG = _long(KPIS, "labelled", "label, ")
_RANGE = "normal_range AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long WHERE label = 0 GROUP BY 1)"
_BINS = """bins AS (SELECT feature, label, least(floor((value - lo) / ((hi - lo) / 50)), 49) AS bin, count(*) AS n
FROM long JOIN normal_range USING (feature) WHERE value BETWEEN lo AND hi GROUP BY ALL)"""
_OVERLAP = """overlap AS (SELECT feature, sum(least(n0 / t0, n1 / t1)) AS distribution_overlap FROM (
SELECT feature, bin, sum(CASE WHEN label = 0 THEN n ELSE 0 END) AS n0, sum(CASE WHEN label = 1 THEN n ELSE 0 END) AS n1,
 sum(sum(CASE WHEN label = 0 THEN n ELSE 0 END)) OVER (PARTITION BY feature) AS t0,
 sum(sum(CASE WHEN label = 1 THEN n ELSE 0 END)) OVER (PARTITION BY feature) AS t1
FROM bins GROUP BY feature, bin) GROUP BY feature)"""
_SEPARATION = """separation AS (SELECT feature,
 abs(avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0)) /
 (sqrt((var_pop(value) FILTER (label = 1) + var_pop(value) FILTER (label = 0)) / 2) + 1e-9) AS anomaly_separation_power
FROM long GROUP BY feature)"""
_EDGES = "edges AS (SELECT feature, list_distinct(quantile_cont(value, [" + ", ".join(str(k / 20) for k in range(1, 20)) + "])) AS cuts FROM long GROUP BY feature)"
_CELLS = """cells AS (SELECT feature, label, len(list_filter(cuts, lambda c: value > c)) AS bin, count(*) AS n
FROM long JOIN edges USING (feature) GROUP BY ALL)"""
_INFORMATION = """information AS (SELECT feature, sum(n / t * ln(CAST(n AS DOUBLE) * t / (CAST(b AS DOUBLE) * l))) AS mutual_information FROM (
SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS b,
 sum(n) OVER (PARTITION BY feature, label) AS l FROM cells) GROUP BY feature)"""
_POWER = """power AS (SELECT feature, variance, mutual_information, anomaly_separation_power, distribution_overlap,
 mutual_information + anomaly_separation_power + (1 - distribution_overlap) AS discriminative_score
FROM (SELECT feature, var_pop(value) AS variance FROM long GROUP BY feature) JOIN information USING (feature)
JOIN separation USING (feature) JOIN overlap USING (feature))"""
POWER = [LABELLED, _LONG, _RANGE, _BINS, _OVERLAP, _SEPARATION, _EDGES, _CELLS, _INFORMATION, _POWER]
_POWER_COLUMNS = ", ".join(
    f"{r(c)} AS {c}" for c in ("variance", "mutual_information", "anomaly_separation_power", "distribution_overlap", "discriminative_score")
)


def _psi(x: str) -> str:
    """The digamma function of a whole number: harmonic sum below 9, asymptotic series from there on."""
    low = f"list_sum(list_transform(range(1, CAST({x} AS BIGINT)), lambda i: 1.0::DOUBLE / i))"
    high = f"ln({x}) - 0.5::DOUBLE / {x} - 1.0::DOUBLE / (12 * pow({x}, 2)) + 1.0::DOUBLE / (120 * pow({x}, 4)) - 1.0::DOUBLE / (252 * pow({x}, 6))"
    return f"(CASE WHEN {x} < 9 THEN coalesce({low}, 0) - 0.5772156649015329::DOUBLE ELSE {high} END)"


def _reach(j: int) -> str:
    """Further end of the run of four values of a class with `j` of them below the value."""
    if j == 0:
        return "lead3 - value"
    if j == 3:
        return "value - lag3"
    return f"CASE WHEN lag{j} IS NOT NULL AND lead{3 - j} IS NOT NULL THEN greatest(value - lag{j}, lead{3 - j} - value) END"


_NEAR = [
    "placed AS (SELECT feature, label, value, count(*) OVER (PARTITION BY feature, label) AS size, "
    + ", ".join(f"{f}(value, {i}) OVER w AS {f}{i}" for f in ("lag", "lead") for i in (1, 2, 3))
    + " FROM long WINDOW w AS (PARTITION BY feature, label ORDER BY value))",
    f"radii AS (SELECT *, least({', '.join(_reach(j) for j in range(4))}) * (1 - 1e-9::DOUBLE) AS radius FROM placed)",
    "nearer AS (SELECT *, CAST(count(*) OVER (PARTITION BY feature ORDER BY value RANGE BETWEEN radius PRECEDING AND radius FOLLOWING) AS DOUBLE) AS m, "
    "CAST(count(*) OVER (PARTITION BY feature) AS DOUBLE) AS total FROM radii)",
    "terms AS (SELECT feature, total, count(*) AS n, size, m FROM nearer GROUP BY ALL)",
    f"near_information AS (SELECT feature, greatest(0, sum(n * ({_psi('total')} + {_psi('3')} - {_psi('size')} - {_psi('m')})) / sum(n)) AS mutual_information FROM terms GROUP BY feature)",
]

# Scores ------------------------------------------------------------------------------------------
_STEPS = """steps AS (SELECT dataset_name, score, n, pos, t, p,
 coalesce(sum(n) OVER w, 0) AS bn, coalesce(sum(pos) OVER w, 0) AS bp FROM (
SELECT dataset_name, score, count(*) AS n, sum(label) AS pos, sum(count(*)) OVER (PARTITION BY dataset_name) AS t,
 sum(sum(label)) OVER (PARTITION BY dataset_name) AS p FROM scored GROUP BY dataset_name, score)
WINDOW w AS (PARTITION BY dataset_name ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_AUC = """auc AS (SELECT dataset_name, sum(CAST(pos AS DOUBLE) * ((bn - bp) + (n - pos) / 2)) / max(CAST(p AS DOUBLE) * (t - p)) AS roc_auc,
 sum(CAST(pos AS DOUBLE) / p * (CAST(p - bp AS DOUBLE) / (t - bn))) AS pr_auc FROM steps GROUP BY dataset_name)"""


def _cuts(percentiles: list[int]) -> str:
    return "cuts AS (" + " UNION ALL ".join(
        f"SELECT dataset_name, 'percentile_{p}' AS method, quantile_cont(score, {p / 100}) AS threshold FROM scored GROUP BY dataset_name"
        for p in percentiles
    ) + ")"


_MATRIX = """matrix AS (SELECT dataset_name, method, threshold,
 count(*) FILTER (score < threshold AND label = 0) AS tn, count(*) FILTER (score >= threshold AND label = 0) AS fp,
 count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score >= threshold AND label = 1) AS tp
FROM scored JOIN cuts USING (dataset_name) GROUP BY ALL)"""
_METRICS = """measured AS (SELECT *, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy,
 coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
 coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM matrix LEFT JOIN auc USING (dataset_name))"""
CUTS = _cuts([90, 95, 99])
EVALUATION = [SCORED, _STEPS, _AUC, CUTS, _MATRIX, _METRICS]
SWEEP = [SCORED, _STEPS, _AUC, _cuts([90, 92, 94, 95, 96, 97, 98, 99]), _MATRIX, _METRICS]
_PERCENTILE = "CAST(replace(method, 'percentile_', '') AS INT)"
_FOUR = ["accuracy", "precision", "recall", "f1"]
_SIX = [*_FOUR, "roc_auc", "pr_auc"]


def _rounded(columns: list[str]) -> str:
    return ", ".join(f"{r(c)} AS {c}" for c in columns)


def _means(columns: list[str]) -> str:
    return ", ".join(f"{r(f'avg({c})')} AS {c}" for c in columns)


_AVERAGE = ["precision", "recall", "f1", "roc_auc", "anomaly_percentage", "accuracy", "tn", "fp", "fn", "tp"]
_SWEPT = f"swept AS (SELECT *, {_PERCENTILE} AS threshold_percentile, (tp + fp) * CAST(100 AS DOUBLE) / (tp + fp + tn + fn) AS anomaly_percentage FROM measured)"
_RANKED = "ranked AS (SELECT dataset_name, method, roc_auc * 1000 + recall * 100 + precision * 10 + f1 AS rank_score FROM measured)"
_FAMILIES = """families AS (SELECT dataset_name, anomaly_family, count(*) AS count, avg(CAST(score >= threshold AS INT)) AS recall,
 avg(score) AS mean_score, count(*) FILTER (score < threshold) AS missed
FROM scored JOIN cuts USING (dataset_name) WHERE label = 1 AND method = 'percentile_90' GROUP BY ALL)"""

_IQR = "SELECT dataset_name, 'iqr_{k}' AS method, quantile_cont(score, 0.75) + {k} * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) AS threshold FROM scored GROUP BY 1"
_MAD = "SELECT dataset_name, 'mad_{k}' AS method, max(m) + {k} * 1.4826::DOUBLE * median(abs(score - m)) AS threshold FROM scored JOIN (SELECT dataset_name, median(score) AS m FROM scored GROUP BY 1) USING (dataset_name) GROUP BY 1"
_GAUSS = "SELECT dataset_name, 'gaussian_{k}' AS method, avg(score) + {k} * stddev_samp(score) AS threshold FROM scored GROUP BY 1"
_EVT = """SELECT dataset_name, 'evt' AS method, CASE WHEN n > 20 AND v > 0 THEN start + sc / sh * (pow(0.1::DOUBLE, -sh) - 1) ELSE p99 END AS threshold
FROM (SELECT *, 0.5 * (1 - m * m / v) AS sh, 0.5 * m * (1 + m * m / v) AS sc FROM (
SELECT dataset_name, start, p99, count(*) FILTER (score > start) AS n, avg(score - start) FILTER (score > start) AS m,
 var_samp(score - start) FILTER (score > start) AS v
FROM scored JOIN (SELECT dataset_name, quantile_cont(score, 0.95) AS start, quantile_cont(score, 0.99) AS p99 FROM scored GROUP BY 1) USING (dataset_name)
GROUP BY ALL))"""
_IQRS = " UNION ALL ".join(_IQR.format(k=k) for k in ("1.5", "3"))
_MADS = " UNION ALL ".join(_MAD.format(k=k) for k in ("3.5", "5"))
_GAUSSES = " UNION ALL ".join(_GAUSS.format(k=k) for k in ("2.5", "3"))
_FOUR_CUTS = _cuts([90, 95, 98, 99])
_ALL_CUTS = _FOUR_CUTS[:-1] + f" UNION ALL {_IQRS} UNION ALL {_MADS} UNION ALL {_GAUSSES} UNION ALL {_EVT})"


def _threshold(sql: str) -> str:
    return query(f"SELECT dataset_name, method, {r('threshold')} AS threshold FROM ({sql})", SCORED)


_RANK = "(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY {by})"

# Drivers and families ------------------------------------------------------------------------------
_FILLED = "filled AS (SELECT record_id, label, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in ALL) + \
    " FROM (SELECT *, throughput_mbps < 50 OR packet_loss_pct > 4 AS label FROM basic))"
_DRIVER_ORDER = [
    "latency_ms", "packet_loss_pct", "throughput_mbps", "handover_count", "rsrp_dbm", "rsrq_db", "prb_utilization_pct", "active_users",
    "throughput_per_user", "spectral_efficiency",
]
_DEVIATION_STATS = "stats AS (SELECT " + ", ".join(
    f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s, median({c}) AS {c}_d, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_q" for c in _DRIVER_ORDER
) + " FROM filled)"
_DRIVERS = "drivers AS (SELECT filled.*, list_sort([" + ", ".join(
    f"{{'less': -(0.65::DOUBLE * abs(({c} - {c}_m) / {c}_s) + 0.35::DOUBLE * abs(({c} - {c}_d) / {c}_q)), 'position': {i}, 'name': '{c}'}}"
    for i, c in enumerate(_DRIVER_ORDER)
) + "]) AS d FROM filled, stats)"
_DRIVER_COLUMNS = ", ".join(
    f"CASE WHEN label THEN d[{i}].name ELSE '' END AS {n}_driver, "
    f"CASE WHEN label THEN round_even(-d[{i}].less, 6) ELSE CAST(0 AS DOUBLE) END AS driver_{i}_deviation"
    for i, n in ((1, "primary"), (2, "secondary"), (3, "tertiary"))
)
_FAMILY = """CASE WHEN NOT label THEN 'Unknown' WHEN prb_utilization_pct > active_users AND latency_ms > 0 THEN 'Congestion'
WHEN rsrp_dbm < -0.75 OR rsrq_db < -0.75 THEN 'Coverage' WHEN active_users > 1 AND throughput_per_user < -0.5 THEN 'Capacity'
WHEN rsrq_db < -0.75 OR spectral_efficiency < -0.75 THEN 'Signal Quality' WHEN latency_ms > 1 AND packet_loss_pct > 1 THEN 'Transport'
WHEN active_users > 1 THEN 'User Surge' ELSE 'Unknown' END"""

# Perturbation --------------------------------------------------------------------------------------


def _positions(source: str, seed: str, key: str = "record_id") -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR) || '|{seed}'), {key}) - 1 AS position, count(*) OVER () AS total FROM {source})"


def _draws(n: str, seed: str, total: str, offset: str = "0") -> str:
    return f"(SELECT i + {offset} AS draw, CAST(floor({_u('i', f'{seed}|draw')} * {total}) AS BIGINT) AS position FROM range({n}) g(i))"


_SHIFTS = {
    "macro": {"rsrp_dbm": -0.90, "rsrq_db": -0.85, "packet_loss_pct": 0.35},
    "micro": {
        "active_users": 0.80, "prb_utilization_pct": 0.80, "latency_ms": 0.35, "packet_loss_pct": 0.35,
    },
}


def _shifted(c: str) -> str:
    steps = " ".join(f"WHEN '{k}' THEN CAST({s[c]} AS DOUBLE) * {c}_s" for k, s in _SHIFTS.items() if c in s)
    return f"{r(f'{c} + CASE cell_type {steps} ELSE CAST(0 AS DOUBLE) END', 5)} AS {c}"


_FAULT_KPIS = ["latency_ms", "packet_loss_pct", "throughput_mbps", "prb_utilization_pct", "active_users", "rsrp_dbm", "rsrq_db"]
_FAMILY_NAMES = [
    "Latency-only anomalies", "Packet-loss anomalies", "Throughput-collapse anomalies", "Signal-quality anomalies", "Congestion anomalies",
    "User-surge anomalies", "Combined multi-KPI anomalies", "Subtle anomalies", "Contradictory anomalies",
]
# KPI -> [(family number, quarter or None, level, amount)]
_PATTERNS = {
    "latency_ms": [(0, None, "high", 1.0), (4, None, "mhigh", 0.35), (6, None, "high", 1.0), (7, None, "mhigh", 0.4), (8, 0, "high", 1.0)],
    "packet_loss_pct": [(1, None, "high", 1.0), (6, None, "high", 1.0), (7, None, "mhigh", 0.35), (8, 1, "high", 1.0)],
    "throughput_mbps": [(2, None, "low", 1.0), (6, None, "low", 0.75), (8, 0, "high", 1.0), (8, 3, "low", 1.0)],
    "prb_utilization_pct": [(4, None, "high", 1.0), (5, None, "mhigh", 0.45), (6, None, "high", 0.75), (8, 1, "low", 0.7)],
    "active_users": [(4, None, "high", 1.0), (5, None, "high", 1.0), (8, 3, "low", 0.7)],
    "rsrp_dbm": [(3, None, "low", 1.0), (8, 2, "high", 1.0)],
    "rsrq_db": [(3, None, "low", 1.0), (8, 2, "low", 1.0)],
}
_LEVELS = {"high": ("q99", 1, 0.65, 0.7), "low": ("q01", -1, 0.65, 0.7), "mhigh": ("q95", 1, 0.5, 0.6)}


def _fault(c: str) -> str:
    steps = []
    for family, quarter, level, amount in _PATTERNS[c]:
        q, sign, low, width = _LEVELS[level]
        test = f"family = {family}" + ("" if quarter is None else f" AND quarter = {quarter}")
        steps.append(f"WHEN {test} THEN {c}_{q} + {sign} * CAST({amount} AS DOUBLE) * scale * {c}_sd * ({low} + {width} * {_u('record_id', f'42|{c}')})")
    return f"{r(f'CASE {chr(32).join(steps)} ELSE CAST({c} AS DOUBLE) END', 5)} AS {c}"


_FAULT_STATS = "stats AS (SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.99) AS {c}_q99, quantile_cont(CAST({c} AS DOUBLE), 0.01) AS {c}_q01, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.95) AS {c}_q95, stddev_samp({c}) AS {c}_sd" for c in _FAULT_KPIS
) + " FROM kpi)"
_MARKED = f"""marked AS (SELECT *, CASE WHEN hit THEN CAST(floor({_u('record_id', '42|family')} * 9) AS INT) END AS family,
 CASE WHEN hit THEN CAST(floor({_u('record_id', '42|difficulty')} * 3) AS INT) END AS level,
 CAST(floor({_u('record_id', '42|quarter')} * 4) AS INT) AS quarter
FROM (SELECT *, {_u('record_id', '42|fault')} < 0.3 AS hit FROM kpi))"""
_SCALED_MARKED = "graded AS (SELECT *, CASE level WHEN 0 THEN 1.15::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.45::DOUBLE END AS scale FROM marked)"

_WINSOR = ["throughput_mbps", "latency_ms", "rsrq_db", "active_users"]
_MODE = "(SELECT {c} FROM kpi WHERE handover_count <> {h} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_GRID = [0.01 + (0.99 - 0.01) * i / 119 for i in range(120)]
_OFFSETS = {f"score_{p}": f"quantile_cont(-score, {p / 100})" for p in (1, 3, 5, 10, 15)}
_OFFSET_ROW = "offsets AS (SELECT " + ", ".join(f"{s} AS {n}" for n, s in _OFFSETS.items()) + " FROM scored)"
_QUARTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}

ORACLE = {
    "median_impute": query(
        "SELECT record_id, coalesce(latency_ms, (SELECT median(latency_ms) FROM kpi)) AS latency_ms, coalesce(rsrq_db, (SELECT median(rsrq_db) FROM kpi)) AS rsrq_db, "
        "coalesce(CAST(sla_compliant AS DOUBLE), (SELECT median(sla_compliant) FROM kpi)) AS sla_compliant FROM kpi"
    ),
    "mode_impute": query(
        f"SELECT record_id, CASE WHEN handover_count = 1 THEN {_MODE.format(c='cell_type', h=1)} ELSE cell_type END AS cell_type, "
        f"CASE WHEN handover_count = 2 THEN {_MODE.format(c='cell_id', h=2)} ELSE cell_id END AS cell_id, 'unknown' AS site FROM kpi"
    ),
    "dedupe_rows": query("SELECT DISTINCT * EXCLUDE (timestamp) FROM (SELECT * FROM kpi UNION ALL SELECT * FROM kpi WHERE cell_type = 'macro')"),
    "outlier_flag": query(
        "SELECT record_id, CAST(" + " OR ".join(
            f"coalesce({c} < {c}_1 - 1.5 * ({c}_3 - {c}_1) OR {c} > {c}_3 + 1.5 * ({c}_3 - {c}_1), false)" for c in ALL
        ) + " AS INT) AS eda_outlier_flag FROM basic, q",
        RATIOS,
        "q AS (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS {c}_1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS {c}_3" for c in ALL) + " FROM basic)",
    ),
    "standard_scale": query(
        "SELECT record_id, " + ", ".join(f"{r(f'({c} - {c}_m) / {c}_s')} AS {c}" for c in KPIS) + ", CAST(0 AS DOUBLE) AS constant_col FROM kpi, s",
        "s AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in KPIS) + " FROM kpi)",
    ),
    "variance_filter": query(
        f"SELECT feature, {r('var_pop(value)')} AS variance FROM long GROUP BY feature HAVING var_pop(value) > 0", _FLAT, _long(_SELECTION, "flat")
    ),
    "corr_matrix": query(f"SELECT feature_a, feature_b, {r('v')} AS corr FROM ({_pairs('corr')})"),
    "cov_matrix": query(f"SELECT feature_a, feature_b, {r('v')} AS cov FROM ({_pairs('covar_samp')})"),
    "corr_prune": query("SELECT 'doubled' AS feature FROM flat HAVING abs(corr(throughput_mbps, doubled)) > 0.95", _FLAT),
    "top_correlations": query(
        f"SELECT feature_a, feature_b, {r('strength')} AS strength FROM (SELECT feature_a, feature_b, abs(v) AS strength FROM ({_pairs('corr')}) "
        "WHERE CASE feature_a " + " ".join(f"WHEN '{c}' THEN {i}" for c, i in _POSITIONS.items()) + " END < CASE feature_b "
        + " ".join(f"WHEN '{c}' THEN {i}" for c, i in _POSITIONS.items()) + " END ORDER BY strength DESC, feature_a, feature_b LIMIT 15)"
    ),
    "feature_report": query(_report({**_REPORT, "sla_compliant": ("int", "true", "not_numeric_or_excluded")}, "kpi")),
    "select_features": query(_report(_SELECTED, "flat"), _FLAT),
    "kpi_profile": query(
        f"SELECT feature, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('min(value)')} AS min, "
        + ", ".join(f"{r(f'quantile_cont(value, {p})')} AS {n}" for n, p in _QUARTILES.items())
        + f", {r('max(value)')} AS max, {r('avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5)')} AS skewness, {r('kurtosis_pop(value)')} AS kurtosis "
        "FROM (SELECT *, avg(value) OVER (PARTITION BY feature) AS m FROM long) GROUP BY feature",
        _long(KPIS, "kpi"),
    ),
    "value_counts": query("SELECT root_cause, count(*) AS n FROM causes GROUP BY 1", *_USES),
    "rca_coverage": query(
        "SELECT total_rows, normal_rows, total_rows - normal_rows AS issue_rows, total_rows - normal_rows - generic_rows AS specific_rows, generic_rows, "
        f"{r('(total_rows - normal_rows - generic_rows) * 100.0::DOUBLE / (total_rows - normal_rows)')} AS coverage_pct FROM (SELECT count(*) AS total_rows, "
        "count(*) FILTER (root_cause = 'Normal') AS normal_rows, count(*) FILTER (root_cause LIKE 'Generic%') AS generic_rows FROM causes)",
        *_USES,
    ),
    "score_summary": query(
        f"SELECT count(*) AS total_records, {r('avg(anomaly_score)')} AS mean_anomaly_score, max(anomaly_score) AS max_anomaly_score, min(anomaly_score) AS min_anomaly_score, "
        f"CAST(sum(label) AS BIGINT) AS predicted_anomalies, {r('avg(label)')} AS predicted_anomaly_rate, "
        "(SELECT string_agg(status || '=' || n, '; ' ORDER BY status) FROM (SELECT status, count(*) AS n FROM score_table GROUP BY 1)) AS status_counts FROM score_table",
        SCORED, SCORE_TABLE,
    ),
    "anomaly_summary": query(
        "SELECT count(*) AS total_records, CAST(sum(label) AS BIGINT) AS total_anomalies, round_even(avg(label) * 100, 4) AS anomaly_percentage, "
        "round_even(avg(score), 6) AS average_score, round_even(max(score), 6) AS maximum_score, round_even(min(score), 6) AS minimum_score, "
        "(SELECT string_agg(risk || '=' || n, '; ' ORDER BY risk) FROM (SELECT risk, count(*) AS n FROM levels GROUP BY 1)) AS risk_level_distribution FROM levels",
        SCORED,
        "levels AS (SELECT *, CASE WHEN label = 1 AND (score - lo) / (hi - lo + 1e-9) >= 0.75 THEN 'High Risk' WHEN label = 1 THEN 'Moderate Risk' ELSE 'Healthy' END AS risk "
        "FROM scored, (SELECT min(score) AS lo, max(score) AS hi FROM scored))",
    ),
    "score_histogram": query(
        f"SELECT CAST(b AS INT) AS bin, CAST(c AS INT) AS label, {r('lo + b * w')} AS lower, {r('lo + (b + 1) * w')} AS upper, coalesce(n, 0) AS n, "
        f"{r('coalesce(n, 0) / (t * w)')} AS density FROM range(45) g(b), range(2) k(c), (SELECT min(score) AS lo, (max(score) - min(score)) / 45 AS w FROM scored) "
        "LEFT JOIN (SELECT label, least(floor((score - lo) / w), 44) AS bin, count(*) AS n FROM scored, (SELECT min(score) AS lo, (max(score) - min(score)) / 45 AS w FROM scored) GROUP BY ALL) h "
        "ON h.bin = b AND h.label = c LEFT JOIN (SELECT label AS tl, count(*) AS t FROM scored GROUP BY 1) ON tl = c",
        SCORED,
    ),
    "histogram_overlap": query(f"SELECT feature, {r('distribution_overlap')} AS distribution_overlap FROM overlap", *POWER),
    "class_separation": query(f"SELECT feature, {r('anomaly_separation_power')} AS anomaly_separation_power FROM separation", *POWER),
    "mutual_information": query(f"SELECT feature, {r('mutual_information')} AS mutual_information FROM information", *POWER),
    "neighbour_information": query(f"SELECT feature, {r('mutual_information')} AS mutual_information FROM near_information", LABELLED, _LONG, *_NEAR),
    "feature_power": query(f"SELECT feature, {_POWER_COLUMNS} FROM power", *POWER),
    "select_by_power": query(
        f"SELECT feature, {r('discriminative_score')} AS discriminative_score FROM power WHERE feature IN ('throughput_mbps', 'rsrq_db') OR discriminative_score > "
        "(SELECT median(discriminative_score) FROM power WHERE feature IN ('throughput_mbps', 'rsrq_db'))",
        *POWER,
    ),
    "importance_rank": query(
        f"SELECT feature, row_number() OVER (ORDER BY discriminative_score DESC, feature) AS importance_rank, {r('discriminative_score')} AS discriminative_power, "
        f"{MEANING} AS business_interpretation, {USE} AS usefulness_reason FROM power",
        *POWER,
    ),
    "feature_power_join": query(
        "SELECT feature, coalesce(place, (SELECT count(DISTINCT feature) FROM long) + 1) AS importance_rank, coalesce(" + r("discriminative_score") + ", 0) AS discriminative_power "
        "FROM (SELECT DISTINCT feature FROM long) LEFT JOIN (SELECT feature, discriminative_score, row_number() OVER (ORDER BY discriminative_score DESC, feature) AS place FROM power) USING (feature)",
        *POWER,
    ),
    "confusion": query(f"SELECT dataset_name, method, {r('threshold')} AS threshold, tn, fp, fn, tp FROM matrix", *EVALUATION),
    "class_metrics": query(f"SELECT dataset_name, method, {_rounded(_FOUR)} FROM measured", *EVALUATION),
    "roc_auc": query(f"SELECT dataset_name, {r('roc_auc')} AS roc_auc FROM auc", SCORED, _STEPS, _AUC),
    "pr_auc": query(f"SELECT dataset_name, {r('pr_auc')} AS pr_auc FROM auc", SCORED, _STEPS, _AUC),
    "curve_points": query(
        f"SELECT dataset_name, {r('score')} AS score, {r('CAST((t - bn) - (p - bp) AS DOUBLE) / (t - p)')} AS fpr, {r('CAST(p - bp AS DOUBLE) / p')} AS tpr, "
        f"{r('CAST(p - bp AS DOUBLE) / (t - bn)')} AS precision, {r('CAST(2 * (p - bp) AS DOUBLE) / ((t - bn) + p)')} AS f1 FROM steps",
        SCORED, _STEPS,
    ),
    "f1_curve": query(
        f"SELECT dataset_name, prob, {r('threshold')} AS threshold, {r('2 * CAST(count(*) FILTER (label = 1 AND score >= threshold) AS DOUBLE) / (count(*) FILTER (score >= threshold) + count(*) FILTER (label = 1))')} AS f1 "
        "FROM scored JOIN grid USING (dataset_name) GROUP BY dataset_name, prob, threshold",
        SCORED.replace("SELECT record_id, slice_type", "SELECT * REPLACE (round(score, 6) AS score) FROM (SELECT record_id, slice_type") + ")",
        f"grid AS (SELECT dataset_name, unnest({[round(p, 6) for p in _GRID]}::DOUBLE[]) AS prob, unnest(q) AS threshold FROM "
        f"(SELECT dataset_name, quantile_cont(score, {_GRID}) AS q FROM scored GROUP BY 1))",
    ),
    "best_f1_threshold": query(
        f"SELECT dataset_name, {r('score')} AS threshold, {r('f1')} AS f1 FROM (SELECT *, CAST(2 * (p - bp) AS DOUBLE) / ((t - bn) + p) AS f1, "
        "row_number() OVER (PARTITION BY dataset_name ORDER BY CAST(2 * (p - bp) AS DOUBLE) / ((t - bn) + p) DESC, score) AS place FROM steps) WHERE place = 1",
        SCORED, _STEPS,
    ),
    "threshold_sweep": query(
        f"SELECT dataset_name, threshold_percentile, {r('threshold')} AS threshold_value, {_rounded([*_FOUR, 'roc_auc'])}, tn, fp, fn, tp, "
        f"{r('anomaly_percentage')} AS anomaly_percentage, {r('CAST(tp + fn AS DOUBLE) / (tp + fp + tn + fn)')} AS ground_truth_anomaly_rate, tp + fp + tn + fn AS records FROM swept",
        *SWEEP, _SWEPT,
    ),
    "sweep_average_row": query(
        f"SELECT dataset_name, threshold_percentile, {_rounded(_AVERAGE)} FROM swept UNION ALL SELECT 'AVERAGE', threshold_percentile, "
        f"{_means(_AVERAGE)} FROM swept GROUP BY threshold_percentile",
        *SWEEP, _SWEPT,
    ),
    "constrained_best": query(
        f"SELECT threshold_percentile, {_rounded(['precision', 'recall', 'f1', 'roc_auc'])} FROM (SELECT threshold_percentile, avg(precision) AS precision, avg(recall) AS recall, "
        "avg(f1) AS f1, avg(roc_auc) AS roc_auc FROM swept GROUP BY 1) ORDER BY recall >= 0.75 DESC, CASE WHEN recall >= 0.75 THEN precision ELSE recall END DESC, f1 DESC, "
        "CASE WHEN recall >= 0.75 THEN recall ELSE precision END DESC, roc_auc DESC, threshold_percentile LIMIT 1",
        *SWEEP, _SWEPT,
    ),
    "method_comparison": query(f"SELECT method, {_means([*_SIX, 'fp', 'fn', 'tp'])} FROM measured GROUP BY method", *EVALUATION),
    "rank_score_best": query(
        f"SELECT method, {r('s')} AS rank_score FROM (SELECT method, avg(roc_auc) * 1000 + avg(recall) * 100 + avg(precision) * 10 + avg(f1) AS s FROM measured GROUP BY 1) ORDER BY s DESC, method LIMIT 1",
        *EVALUATION,
    ),
    "argmax_row": query(
        f"SELECT dataset_name, arg_max(method, rank_score) AS method, {r('max(rank_score)')} AS rank_score FROM ranked GROUP BY dataset_name", *EVALUATION, _RANKED
    ),
    "family_recall": query(
        f"SELECT dataset_name, anomaly_family, count, {r('recall')} AS recall, {r('mean_score')} AS mean_score, missed FROM families", SCORED, CUTS, _FAMILIES
    ),
    "failure_ranking": query(
        f"SELECT dataset_name, anomaly_family, {r('recall')} AS recall, missed FROM families ORDER BY families.recall, families.missed DESC, dataset_name, anomaly_family LIMIT 12",
        SCORED, CUTS, _FAMILIES,
    ),
    "heaviest_errors": query(
        " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS kind, dataset_name, method, {c} AS errors FROM measured ORDER BY {c} DESC, dataset_name, method LIMIT 5)" for c in ("fp", "fn")),
        *EVALUATION,
    ),
    "metric_gains": query(
        " UNION ALL ".join(
            f"SELECT '{c}' AS metric, {r(f'avg({c}) FILTER (method = {chr(39)}percentile_99{chr(39)})')} AS baseline, {r(f'avg({c}) FILTER (method = {chr(39)}percentile_90{chr(39)})')} AS optimised, "
            f"{r(f'avg({c}) FILTER (method = {chr(39)}percentile_90{chr(39)}) - avg({c}) FILTER (method = {chr(39)}percentile_99{chr(39)})')} AS gain FROM measured"
            for c in _SIX
        ),
        *EVALUATION,
    ),
    "prevalence": query(f"SELECT dataset_name, {r('avg(label)')} AS prevalence, count(*) AS n FROM scored GROUP BY ROLLUP (dataset_name)", SCORED),
    "thr_percentile": query(f"SELECT dataset_name, method, {r('threshold')} AS threshold FROM cuts", SCORED, _FOUR_CUTS),
    "thr_iqr": _threshold(_IQRS),
    "thr_mad": _threshold(_MADS),
    "thr_gaussian": _threshold(_GAUSSES),
    "thr_evt": _threshold(_EVT),
    "apply_threshold": query(
        "SELECT record_id, CAST(score >= threshold AS INT) AS predicted FROM scored JOIN cuts USING (dataset_name) WHERE method = 'percentile_95'", SCORED, CUTS
    ),
    "threshold_matrix": query(
        f"SELECT dataset_name, method, {r('threshold')} AS threshold, tn, fp, fn, tp, {_rounded(_SIX)} FROM measured", SCORED, _STEPS, _AUC, _ALL_CUTS, _MATRIX, _METRICS
    ),
    "percentile_rank": query(f"SELECT record_id, {r(_RANK.format(by='1', c='score'))} AS rank FROM scored", SCORED),
    "dataset_partition_rank": query(f"SELECT record_id, dataset_name, {r(_RANK.format(by='dataset_name', c='score'))} AS rank FROM scored", SCORED),
    "stable_row_ids": query("SELECT record_id, cell_id, row_number() OVER (ORDER BY record_id NULLS LAST, cell_id) AS row_id FROM kpi"),
    "sort_multi": query(
        f"SELECT dataset_name, threshold_percentile, {_rounded(['roc_auc', 'recall', 'precision', 'f1'])} FROM swept ORDER BY swept.roc_auc DESC, swept.recall DESC", *SWEEP, _SWEPT
    ),
    "head_k": query("SELECT record_id, cell_id, root_cause FROM causes WHERE root_cause <> 'Normal' ORDER BY record_id LIMIT 10", *_USES),
    "top_drivers": query(f"SELECT record_id, {_DRIVER_COLUMNS} FROM drivers", RATIOS, _FILLED, _DEVIATION_STATS, _DRIVERS),
    "sample_n": query("SELECT record_id, cell_id, throughput_mbps FROM kpi ORDER BY md5(CAST(record_id AS VARCHAR) || '|42'), record_id LIMIT 2000"),
    "train_test_split": query(f"SELECT record_id, CASE WHEN {_u('record_id', '42')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM kpi"),
    "winsorize": query(
        "SELECT record_id, " + ", ".join(f"{r(f'CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {c}_l), {c}_h) END')} AS {c}" for c in _WINSOR) + " FROM kpi, b",
        "b AS (SELECT " + ", ".join(
            f"quantile_cont(CAST({c} AS DOUBLE), 0.05) - 0.1::DOUBLE * stddev_samp({c}) AS {c}_l, quantile_cont(CAST({c} AS DOUBLE), 0.95) + 0.1::DOUBLE * stddev_samp({c}) AS {c}_h"
            for c in _WINSOR
        ) + " FROM kpi)",
    ),
    "bootstrap_rows": query(
        f"SELECT draw, record_id, throughput_mbps FROM {_draws('(SELECT count(*) FROM kpi)', '42', '(SELECT count(*) FROM kpi)')} JOIN {_positions('kpi', '42')} USING (position)"
    ),
    "target_prevalence": query(
        "SELECT draw, record_id, score, label FROM (SELECT * FROM "
        f"{_draws('(SELECT count(*) - CAST(round_even(count(*) * 0.1::DOUBLE, 0) AS BIGINT) FROM scored)', '42|0', '(SELECT count(*) FROM scored WHERE label = 0)')} "
        f"JOIN {_positions('scored WHERE label = 0', '42|0')} USING (position) UNION ALL BY NAME SELECT * FROM "
        f"{_draws('(SELECT CAST(round_even(count(*) * 0.1::DOUBLE, 0) AS BIGINT) FROM scored)', '42|1', '(SELECT count(*) FROM scored WHERE label = 1)', '(SELECT count(*) - CAST(round_even(count(*) * 0.1::DOUBLE, 0) AS BIGINT) FROM scored)')} "
        f"JOIN {_positions('scored WHERE label = 1', '42|1')} USING (position))",
        SCORED,
    ),
    "split_strata": query("SELECT record_id, CAST(ntile(7) OVER (ORDER BY md5(CAST(record_id AS VARCHAR) || '|42'), record_id) - 1 AS INT) AS stratum FROM kpi"),
    "regime_shift": query(
        f"SELECT record_id, {', '.join(_shifted(c) for c in ('rsrp_dbm', 'rsrq_db', 'packet_loss_pct', 'active_users', 'latency_ms'))} FROM kpi, s",
        "s AS (SELECT " + ", ".join(f"stddev_samp({c}) AS {c}_s" for c in KPIS) + " FROM kpi)",
    ),
    "inject_fault": query(
        "SELECT record_id, CAST(hit AS INT) AS ground_truth_label, CASE WHEN hit THEN [" + ", ".join(f"'{n}'" for n in _FAMILY_NAMES) + "][family + 1] ELSE 'Normal' END AS anomaly_family, "
        f"CASE level WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'none' END AS difficulty, {', '.join(_fault(c) for c in _FAULT_KPIS)} FROM graded, stats",
        _FAULT_STATS, _MARKED, _SCALED_MARKED,
    ),
    "iforest_offset": query("SELECT count(*) AS rows, " + ", ".join(f"{r(s)} AS {n}" for n, s in _OFFSETS.items()) + " FROM scored", SCORED),
    "risk_normalize": query(
        f"SELECT record_id, {r('(score - lo) / (hi - lo)')} AS risk FROM scored, (SELECT min(score) AS lo, max(score) AS hi FROM scored)", SCORED
    ),
    "score_table": query("SELECT record_id, anomaly_score, status, label AS is_anomaly FROM score_table", SCORED, SCORE_TABLE),
    "score_fusion": query(
        f"SELECT record_id, {r('a * 0.15::DOUBLE + b * 0.2::DOUBLE + c * 0.25::DOUBLE')} AS weighted_average, {r('(a + b + c) / 3')} AS rank_aggregation, {r('greatest(a, b, c)')} AS percentile_max "
        f"FROM (SELECT record_id, {_RANK.format(by='dataset_name', c='score')} AS a, {_RANK.format(by='dataset_name', c='rsrp_dbm')} AS b, {_RANK.format(by='dataset_name', c='throughput_mbps')} AS c "
        "FROM scored JOIN kpi USING (record_id))",
        SCORED,
    ),
    "mean_fusion": query(f"SELECT record_id, {r('score + (score_1 + score_3 + score_5 + score_10 + score_15) / 5')} AS raw_score FROM scored, offsets", SCORED, _OFFSET_ROW),
    "ensemble_scores": query(f"SELECT record_id, {', '.join(f'{r(f_)} AS {n}' for n, f_ in ((n, f'score + {n}') for n in _OFFSETS))} FROM scored, offsets", SCORED, _OFFSET_ROW),
    "live_decision": query(
        "SELECT record_id, hit AS is_anomaly, CASE WHEN hit THEN 'Anomaly' ELSE 'Normal' END AS anomaly_status FROM "
        "(SELECT record_id, score >= 1.5 AND coalesce(sla_compliant, 0) <> 1 AS hit FROM scored JOIN kpi USING (record_id))",
        SCORED,
    ),
    "production_output": query(
        f"SELECT record_id, round_even(score, 6) AS ensemble_score, round_even(normalized, 6) AS normalized_score, round_even(pr, 6) AS anomaly_percentile, "
        "'given' AS threshold_method, CASE WHEN label AND normalized >= 0.75 THEN 'High Risk' WHEN label THEN 'Moderate Risk' ELSE 'Healthy' END AS risk_level, "
        f"CAST(label AS INT) AS is_anomaly, {_DRIVER_COLUMNS}, {_FAMILY} AS anomaly_family_candidate "
        f"FROM (SELECT drivers.*, score, (score - (SELECT min(score) FROM scored)) / ((SELECT max(score) - min(score) FROM scored) + 1e-9) AS normalized, {_RANK.format(by='1', c='score')} AS pr "
        "FROM drivers JOIN (SELECT record_id, score FROM scored) USING (record_id))",
        RATIOS, SCORED, _FILLED, _DEVIATION_STATS, _DRIVERS,
    ),
}
