"""Rule-based root-cause analysis of KPI rows.

Thresholds are percentiles per network slice.  Each row is scored for six causes by additive rules;
the highest score wins and a fixed priority breaks ties.  The rules are data and compile to column
expressions, so a row is explained by one projection without Python on the executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from cellsight.functions.text import with_number_texts
from cellsight.operators.quantiles import wide_quantiles
from cellsight.operators.ranking import stable_row_ids
from cellsight.session import materialise
from cellsight.sources.schema import first_present

# Cause names, severities, actions, limits and points.
NORMAL = "Normal"
GENERIC = "Generic SLA Degradation / Needs Investigation"
OUTAGE = "Suspected Cell Outage / Severe Service Drop"
CONGESTION = "RAN Congestion"
BACKHAUL = "Backhaul / Transport Issue"
COVERAGE = "Radio Coverage Degradation"
INTERFERENCE = "Interference / Poor Signal Quality"
MOBILITY = "Mobility / Handover Issue"

# Order of the causes in score texts, and order in which ties are broken.
TEXT_ORDER = [CONGESTION, OUTAGE, BACKHAUL, COVERAGE, INTERFERENCE, MOBILITY]
TIE_ORDER = [OUTAGE, CONGESTION, BACKHAUL, COVERAGE, INTERFERENCE, MOBILITY]

SEVERITY = {
    NORMAL: "Normal",
    OUTAGE: "Critical",
    CONGESTION: "High",
    BACKHAUL: "High",
    COVERAGE: "High",
    INTERFERENCE: "Medium",
    MOBILITY: "Medium",
    GENERIC: "Low",
}

ACTIONS = {
    NORMAL: ["No action required"],
    CONGESTION: [
        "Check PRB utilization trend",
        "Verify active user count",
        "Check neighboring cell load",
        "Consider load balancing or capacity optimization",
    ],
    OUTAGE: [
        "Check cell availability alarms",
        "Verify site power/backhaul status",
        "Check recent configuration changes",
        "Escalate to field operations team",
    ],
    BACKHAUL: [
        "Check transport link health",
        "Verify latency and packet loss on backhaul path",
        "Check router/switch interface errors",
        "Escalate to transport team",
    ],
    COVERAGE: [
        "Check RSRP trend",
        "Inspect antenna or site coverage issues",
        "Verify antenna tilt, power, and configuration",
        "Check coverage complaints if available",
    ],
    INTERFERENCE: [
        "Check RSRQ/SINR degradation",
        "Check neighboring cell interference",
        "Verify frequency planning",
        "Investigate external interference sources",
    ],
    MOBILITY: [
        "Check handover counters",
        "Review neighbor relation configuration",
        "Check mobility parameter changes",
        "Analyze source-target handover patterns",
    ],
    GENERIC: [
        "Review related KPIs",
        "Check alarms and logs",
        "Continue investigation",
    ],
}

# Threshold name -> (KPI, percentile).
PERCENTILES = {
    "very_low_throughput": ("throughput_mbps", 0.05),
    "low_throughput": ("throughput_mbps", 0.20),
    "high_latency": ("latency_ms", 0.80),
    "very_high_latency": ("latency_ms", 0.95),
    "high_packet_loss": ("packet_loss_pct", 0.80),
    "very_high_packet_loss": ("packet_loss_pct", 0.95),
    "high_prb": ("prb_utilization_pct", 0.80),
    "very_high_prb": ("prb_utilization_pct", 0.90),
    "high_users": ("active_users", 0.75),
    "low_users": ("active_users", 0.20),
    "high_handover": ("handover_count", 0.85),
    "very_high_handover": ("handover_count", 0.95),
}
# Upper limits of percentile thresholds; also used when the KPI has no value.
CAPS = {"high_prb": 85.0, "very_high_prb": 90.0}
CONSTANTS = {"weak_rsrp": -110.0, "poor_rsrq": -15.0, "very_poor_rsrq": -18.0}
THRESHOLDS = [*PERCENTILES, *CONSTANTS]


class Rule(NamedTuple):
    """Points for a cause when `kpi op limit` holds; of the rules of one step only the first match counts."""

    cause: str
    step: int
    points: int
    kpi: str
    op: str
    limit: str | float
    label: str


RULES = [
    Rule(CONGESTION, 1, 3, "prb_utilization_pct", ">=", "very_high_prb", "very high PRB utilization"),
    Rule(CONGESTION, 1, 2, "prb_utilization_pct", ">=", "high_prb", "high PRB utilization"),
    Rule(CONGESTION, 2, 2, "active_users", ">=", "high_users", "high active users"),
    Rule(CONGESTION, 3, 2, "throughput_mbps", "<=", "low_throughput", "low throughput"),
    Rule(CONGESTION, 4, 1, "latency_ms", ">=", "high_latency", "high latency"),
    Rule(CONGESTION, 5, 1, "packet_loss_pct", ">=", "high_packet_loss", "high packet loss"),
    Rule(OUTAGE, 1, 3, "throughput_mbps", "<=", "very_low_throughput", "very low throughput"),
    Rule(OUTAGE, 2, 2, "active_users", "<=", "low_users", "low active users"),
    Rule(OUTAGE, 3, 2, "prb_utilization_pct", "<", 50.0, "low PRB utilization"),
    Rule(OUTAGE, 4, 1, "packet_loss_pct", ">=", "high_packet_loss", "high packet loss"),
    Rule(OUTAGE, 5, 1, "latency_ms", ">=", "high_latency", "high latency"),
    Rule(BACKHAUL, 1, 3, "packet_loss_pct", ">=", "very_high_packet_loss", "very high packet loss"),
    Rule(BACKHAUL, 1, 2, "packet_loss_pct", ">=", "high_packet_loss", "high packet loss"),
    Rule(BACKHAUL, 2, 3, "latency_ms", ">=", "very_high_latency", "very high latency"),
    Rule(BACKHAUL, 2, 2, "latency_ms", ">=", "high_latency", "high latency"),
    Rule(BACKHAUL, 3, 2, "prb_utilization_pct", "<", "high_prb", "PRB below congestion threshold"),
    Rule(BACKHAUL, 4, 1, "throughput_mbps", "<=", "low_throughput", "low throughput"),
    Rule(COVERAGE, 1, 4, "rsrp_dbm", "<=", -115.0, "very weak RSRP"),
    Rule(COVERAGE, 1, 3, "rsrp_dbm", "<=", "weak_rsrp", "weak RSRP"),
    Rule(COVERAGE, 2, 2, "throughput_mbps", "<=", "low_throughput", "low throughput"),
    Rule(COVERAGE, 3, 1, "packet_loss_pct", ">=", "high_packet_loss", "high packet loss"),
    Rule(COVERAGE, 4, 1, "rsrq_db", "<=", "poor_rsrq", "poor RSRQ"),
    Rule(INTERFERENCE, 1, 4, "rsrq_db", "<=", "very_poor_rsrq", "very poor RSRQ"),
    Rule(INTERFERENCE, 1, 3, "rsrq_db", "<=", "poor_rsrq", "poor RSRQ"),
    Rule(INTERFERENCE, 2, 2, "packet_loss_pct", ">=", "high_packet_loss", "high packet loss"),
    Rule(INTERFERENCE, 3, 1, "latency_ms", ">=", "high_latency", "high latency"),
    Rule(INTERFERENCE, 4, 1, "rsrp_dbm", ">", "weak_rsrp", "RSRP not severely weak"),
    Rule(MOBILITY, 1, 4, "handover_count", ">=", "very_high_handover", "very high handover count"),
    Rule(MOBILITY, 1, 3, "handover_count", ">=", "high_handover", "high handover count"),
    Rule(MOBILITY, 2, 2, "packet_loss_pct", ">=", "high_packet_loss", "high packet loss"),
    Rule(MOBILITY, 3, 1, "latency_ms", ">=", "high_latency", "high latency"),
    Rule(MOBILITY, 4, 1, "throughput_mbps", "<=", "low_throughput", "low throughput"),
]

# KPI checks behind `affected_kpis`, in the order of the list.
AFFECTED_CHECKS = [
    ("throughput_mbps", "<=", "low_throughput"),
    ("latency_ms", ">=", "high_latency"),
    ("packet_loss_pct", ">=", "high_packet_loss"),
    ("prb_utilization_pct", ">=", "high_prb"),
    ("active_users", ">=", "high_users"),
    ("active_users", "<=", "low_users"),
    ("rsrp_dbm", "<=", "weak_rsrp"),
    ("rsrq_db", "<=", "poor_rsrq"),
    ("handover_count", ">=", "high_handover"),
]

# Score needed for a named cause, and confidence by winning score.
MINIMUM_SCORE = 3
CONFIDENCE_STEPS = [(7, 0.90), (5, 0.80), (4, 0.70), (3, 0.60)]

def slice_column(df: DataFrame) -> str | None:
    return first_present(df, ["network_slice", "slice_type"])


def compute_thresholds(df: DataFrame, by: str | None = None) -> DataFrame:
    """The 15 thresholds per group, or one global row."""
    present = {name: spec for name, spec in PERCENTILES.items() if spec[0] in df.columns}
    keys = [by] if by else []
    found = wide_quantiles(df, present, keys)
    if by:
        # Groups without any KPI value still get a row.
        found = df.where(F.col(by).isNotNull()).select(by).distinct().join(found, by, "left")
    columns = []
    for name in THRESHOLDS:
        value = F.col(name) if name in present else F.lit(None).cast("double")
        if name in CAPS:
            value = F.least(F.lit(CAPS[name]), value)
        elif name in CONSTANTS:
            value = F.lit(CONSTANTS[name])
        columns.append(value.alias(name))
    return materialise(found.select(*keys, *columns), "thresholds")


def threshold_values(thresholds: DataFrame) -> dict[str, float | None]:
    """The single row of a global threshold table as plain numbers."""
    return thresholds.select(*THRESHOLDS).first().asDict()


def join_thresholds(df: DataFrame, per_slice: DataFrame, global_row: dict[str, float | None], by: str) -> DataFrame:
    """Give each row the thresholds of its slice; rows of an unknown or null slice get the global ones."""
    renamed = per_slice.withColumn("_known", F.lit(True)).withColumnRenamed(by, "_slice")
    joined = df.join(renamed, F.col(by) == F.col("_slice"), "left")
    chosen = {
        name: F.when(F.col("_known"), F.col(name)).otherwise(F.lit(global_row[name]).cast("double"))
        for name in THRESHOLDS
    }
    return joined.withColumns(chosen).drop("_known", "_slice")


def with_global_thresholds(df: DataFrame, global_row: dict[str, float | None]) -> DataFrame:
    return df.withColumns({name: F.lit(global_row[name]).cast("double") for name in THRESHOLDS})


def attach_thresholds(df: DataFrame, by: str | None = None) -> DataFrame:
    """Thresholds of the table itself, per slice when `by` names a column.

    The global row is only computed when a row without a slice needs it.
    """
    if by is None:
        return with_global_thresholds(df, threshold_values(compute_thresholds(df)))
    per_slice = compute_thresholds(df, by)
    unsliced = bool(df.where(F.col(by).isNull()).select(by).take(1))
    global_row = threshold_values(compute_thresholds(df)) if unsliced else dict.fromkeys(THRESHOLDS)
    return join_thresholds(df, per_slice, global_row, by)


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def _comparisons() -> list[tuple[str, str, str | float]]:
    """Every distinct comparison of a KPI with a limit that a rule or check makes."""
    made = [(rule.kpi, rule.op, rule.limit) for rule in RULES] + AFFECTED_CHECKS
    return list(dict.fromkeys(made))


_TEST = {comparison: f"_test_{i}" for i, comparison in enumerate(_comparisons())}


def with_tests(df: DataFrame, only: str | None = None) -> DataFrame:
    """Add one boolean per comparison, false when the KPI or its limit is missing and in rows outside `only`."""
    sql = []
    asked = f"{only} AND " if only else ""
    for (kpi, op, limit), name in _TEST.items():
        bound = limit if isinstance(limit, str) else f"CAST({limit} AS DOUBLE)"
        present = kpi in df.columns
        sql.append(f"{f'{asked}coalesce(nanvl(CAST({kpi} AS DOUBLE), NULL) {op} {bound}, false)' if present else 'false'} AS {name}")
    return df.selectExpr("*", *sql)


def rule_hits() -> list[tuple[Rule, str]]:
    """Each rule with its condition; later rules of a step need the earlier ones to fail."""
    hits: list[tuple[Rule, str]] = []
    for rule in RULES:
        test = _TEST[rule.kpi, rule.op, rule.limit]
        earlier = [f"NOT {_TEST[o.kpi, o.op, o.limit]}" for o, _ in hits if (o.cause, o.step) == (rule.cause, rule.step)]
        hits.append((rule, " AND ".join([test, *earlier])))
    return hits


def rule_scores() -> dict[str, str]:
    """The additive score of every cause."""
    hits = rule_hits()
    return {
        cause: " + ".join(f"IF({hit}, {rule.points}, 0)" for rule, hit in hits if rule.cause == cause)
        for cause in TEXT_ORDER
    }


def rule_signals(cause: str, value_text: dict[str, str]) -> str:
    """The labels of the matched rules of one cause, with the KPI value."""
    texts = [
        f"IF({hit}, concat({_sql_text(rule.label + ' (')}, {value_text[rule.kpi]}, ')'), NULL)"
        for rule, hit in rule_hits()
        if rule.cause == cause and rule.kpi in value_text
    ]
    return f"array_compact(array({', '.join(texts)}))" if texts else _EMPTY


def affected_kpis() -> str:
    """Names of the KPIs outside their thresholds, each once, in the fixed order."""
    names = [f"IF({_TEST[check]}, '{check[0]}', NULL)" for check in AFFECTED_CHECKS]
    return f"array_distinct(array_compact(array({', '.join(names)})))"


def is_issue(df: DataFrame, affected: str) -> str:
    """A row with a flag is an issue unless the flag truncates to 1; without a flag when any KPI is affected."""
    if "sla_compliant" not in df.columns:
        return f"size({affected}) > 0"
    flag = "CAST(sla_compliant AS STRING)"
    compliant = f"coalesce(CAST(nanvl(TRY_CAST({flag} AS DOUBLE), NULL) AS INT) = 1, false)"
    return f"IF({flag} IS NOT NULL AND lower({flag}) <> 'nan', NOT {compliant}, size({affected}) > 0)"


def root_cause(scores: dict[str, str], issue: str) -> str:
    top = f"greatest({', '.join(scores.values())})"
    ranked = " ".join(f"WHEN {scores[cause]} = {top} THEN {_sql_text(cause)}" for cause in TIE_ORDER)
    return (
        f"CASE WHEN NOT ({issue}) THEN {_sql_text(NORMAL)} "
        f"WHEN {top} < {MINIMUM_SCORE} THEN {_sql_text(GENERIC)} {ranked} END"
    )


def confidence(cause: str, top: str) -> str:
    steps = " ".join(f"WHEN {top} >= {score} THEN {value}D" for score, value in CONFIDENCE_STEPS)
    return (
        f"CASE WHEN {cause} = {_sql_text(NORMAL)} THEN 0.95D "
        f"WHEN {cause} = {_sql_text(GENERIC)} THEN 0.5D {steps} ELSE 0.5D END"
    )


def _by_cause(cause: str, values: dict[str, str]) -> str:
    """A fixed table of at most eight entries, kept inside the projection."""
    return f"CASE {cause} " + " ".join(f"WHEN {_sql_text(c)} THEN {v}" for c, v in values.items()) + " END"


def severity(cause: str) -> str:
    return _by_cause(cause, {c: _sql_text(s) for c, s in SEVERITY.items()})


def actions(cause: str) -> str:
    return _by_cause(cause, {c: f"array({', '.join(map(_sql_text, items))})" for c, items in ACTIONS.items()})


def explanation(cause: str, signals: str) -> str:
    no_pattern = (
        "The row violates SLA, but the KPI pattern does not strongly match congestion, "
        "outage, backhaul, radio, interference, or mobility rules."
    )
    return (
        f"CASE WHEN {cause} = {_sql_text(NORMAL)} THEN 'SLA is compliant, so no RCA issue was detected.' "
        f"WHEN {cause} = {_sql_text(GENERIC)} THEN {_sql_text(no_pattern)} "
        f"WHEN size({signals}) > 0 THEN concat('The row is classified as ', {cause}, ' because ', "
        f"array_join({signals}, ', '), '.') "
        f"ELSE concat('The row is classified as ', {cause}, ' based on the strongest KPI score.') END"
    )


def score_breakdown(scores: dict[str, str]) -> str:
    items = [f"concat({_sql_text(cause + '=')}, {score})" for cause, score in scores.items()]
    return f"concat_ws('; ', {', '.join(items)})"


_EMPTY = "CAST(array() AS ARRAY<STRING>)"
# Score columns added by `classify`, in text order.
SCORE_COLUMNS = {
    CONGESTION: "congestion_score",
    OUTAGE: "outage_score",
    BACKHAUL: "backhaul_score",
    COVERAGE: "coverage_score",
    INTERFERENCE: "interference_score",
    MOBILITY: "mobility_score",
}


def _within(sql: str, only: str | None) -> str:
    """The value in rows where `only` holds, null elsewhere; without a condition the value itself."""
    return f"IF({only}, {sql}, NULL)" if only else sql


def _scored(df: DataFrame, only: str | None = None) -> DataFrame:
    scores = [f"{_within(sql, only)} AS {SCORE_COLUMNS[cause]}" for cause, sql in rule_scores().items()]
    return with_tests(df, only).selectExpr("*", *scores, f"{_within(affected_kpis(), only)} AS affected")


def score_rows(df: DataFrame) -> DataFrame:
    """Add the six rule scores and the affected KPIs to rows with thresholds, before any gate."""
    return _scored(df).drop(*_TEST.values())


def _classified(df: DataFrame, only: str | None = None) -> DataFrame:
    scored = _scored(df, only)
    caused = scored.selectExpr("*", f"{_within(root_cause(SCORE_COLUMNS, is_issue(df, 'affected')), only)} AS root_cause")
    normal = f"root_cause = {_sql_text(NORMAL)}"
    return caused.selectExpr(
        *[f"`{c}`" for c in df.columns],
        *_TEST.values(),
        *[f"IF({normal}, 0, {name}) AS {name}" for name in SCORE_COLUMNS.values()],
        f"IF({normal}, {_EMPTY}, affected) AS affected",
        "root_cause",
        f"IF({normal}, 0, greatest({', '.join(SCORE_COLUMNS.values())})) AS top_score",
    )


def classify(df: DataFrame) -> DataFrame:
    """Add root_cause, the six scores, top_score and affected KPIs; Normal rows have zeros and no KPI."""
    return _classified(df).drop(*_TEST.values())


def explain_rows(df: DataFrame, given: dict[str, str] | None = None, only: str | None = None) -> DataFrame:
    """All analysis columns for rows with thresholds; lists stay arrays.

    `given` names columns with the original text of KPI values; whole numbers are shown as given.
    `only` names a boolean column: the other rows stay without an analysis, and none is worked out for them.
    """
    given = given or {}
    whole = {f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long")}
    kpis = dict.fromkeys(rule.kpi for rule in RULES if rule.kpi in df.columns)
    value_text = {kpi: f"_text_{kpi}" for kpi in kpis}
    staged = with_number_texts(_classified(df, only), {t: (_within(k, only), k in whole) for k, t in value_text.items()})
    if given:
        staged = staged.withColumns(
            {
                value_text[k]: F.expr(_within(f"IF({c} RLIKE '^-?[0-9]+$', {c}, {value_text[k]})", only))
                for k, c in given.items()
                if k in kpis
            }
        )
    signals = _by_cause("root_cause", {c: rule_signals(c, value_text) for c in TIE_ORDER})
    staged = staged.selectExpr("*", f"coalesce({signals}, {_EMPTY}) AS signals")
    return staged.selectExpr(
        *[f"`{c}`" for c in staged.columns if c not in value_text.values() and c not in _TEST.values()],
        f"{severity('root_cause')} AS severity",
        f"{_within(confidence('root_cause', 'top_score'), only)} AS confidence_score",
        f"{_within(score_breakdown(SCORE_COLUMNS), only)} AS score_breakdown",
        f"{_within(explanation('root_cause', 'signals'), only)} AS explanation",
        f"{actions('root_cause')} AS actions",
    )


def result_rows(explained: DataFrame, incident_id: str) -> DataFrame:
    """The 14-column result with lists joined to text; `incident_id` is the SQL of the id column."""
    by, site = slice_column(explained), first_present(explained, ["cell_id", "site_id"])

    def optional(name: str | None, default: str = "CAST(NULL AS STRING)") -> str:
        return name if name and name in explained.columns else default

    return explained.selectExpr(
        f"{incident_id} AS incident_id",
        f"{optional('timestamp')} AS timestamp",
        f"{optional(site)} AS `cell_id/site_id`",
        f"{optional('cell_type', _sql_text('Unknown'))} AS cell_type",
        f"{optional(by)} AS network_slice",
        f"{optional('sla_compliant')} AS sla_compliant",
        "root_cause",
        "severity",
        "confidence_score",
        "array_join(affected, ', ') AS affected_kpis",
        "array_join(signals, ' | ') AS matched_signals",
        "score_breakdown",
        "explanation",
        "array_join(actions, ' | ') AS recommended_actions",
    )


def analyse(df: DataFrame, key: str = "record_id") -> DataFrame:
    """Batch analysis of a KPI table: per-slice thresholds, result rows numbered by the key."""
    numbered = stable_row_ids(df, key, "_position")
    explained = explain_rows(attach_thresholds(numbered, slice_column(df)))
    return result_rows(explained, "format_string('INC-%06d', _position)")


def coverage(results: DataFrame) -> DataFrame:
    """Row counts by outcome and the share of issues with a named cause."""
    normal = F.count_if(F.col("root_cause") == NORMAL)
    generic = F.count_if(F.col("root_cause") == GENERIC)
    return results.agg(
        F.count(F.lit(1)).alias("total_rows"), normal.alias("normal_rows"), generic.alias("generic_rows")
    ).select(
        "total_rows",
        "normal_rows",
        (F.col("total_rows") - F.col("normal_rows")).alias("issue_rows"),
        (F.col("total_rows") - F.col("normal_rows") - F.col("generic_rows")).alias("specific_rows"),
        "generic_rows",
        F.coalesce(
            F.try_divide(
                (F.col("total_rows") - F.col("normal_rows") - F.col("generic_rows")) * 100.0,
                F.col("total_rows") - F.col("normal_rows"),
            ),
            F.lit(0.0),
        ).alias("coverage_pct"),
    )


def listing(results: DataFrame) -> DataFrame:
    """The incidents that are not Normal, four columns."""
    return results.where(F.col("root_cause") != NORMAL).select(
        "incident_id", F.col("`cell_id/site_id`").alias("cell_id"), "root_cause", "severity"
    )


def adapt_incidents(results: DataFrame) -> DataFrame:
    """Result rows in the report schema; the slice is given under both of its names."""
    return results.select(
        "incident_id",
        "timestamp",
        F.col("`cell_id/site_id`").alias("cell_id"),
        "cell_type",
        "network_slice",
        F.col("network_slice").alias("slice_type"),
        "sla_compliant",
        "root_cause",
        "severity",
        F.col("confidence_score").alias("confidence"),
        "affected_kpis",
        "matched_signals",
        "score_breakdown",
        "explanation",
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


