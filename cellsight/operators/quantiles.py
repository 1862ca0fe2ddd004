"""Exact linear-interpolated quantiles of many columns, globally or per group.

A bounded sketch first brackets each wanted quantile; values outside the brackets are snapped to the
bracket ends, which keeps the order but collapses nearly all rows to a few counted values before the
shuffle.  The remaining values are ranked range by range, so the answer is exact at any size and no
buffer grows with the data.

The sketch of a group and column is a set of sorted buffers; a full buffer keeps every second value at twice the
weight.  Sketches are built per Arrow batch, merge in any order (per slot, then per group), and serve all wanted
probabilities.  Where the brackets of all groups fit, rows of several columns are snapped and counted per batch too; otherwise, and
for a single column, the rows are joined with the brackets of their group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cellsight.operators.ranking import running_totals
from cellsight.session import materialise
from cellsight.sources.schema import literal, number, quoted

# Groups up to this size are bracketed by their minimum and maximum.
SMALL_GROUP = 20_000
# Half width of a bracket, as a share of the rows.
PAD = 0.001
# Values of a buffer; the rank error of a sketch is below levels / (2 * BUFFER) of the rows.
BUFFER = 16_384
# Numbers held in the sketches of a task before they are passed on, and brackets that are sent to all tasks.
HELD_NUMBERS = 8_000_000
SENT_BRACKETS = 20_000
SLOTS = 32


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    by: list[str] = (),
) -> DataFrame:
    """Rows (by..., feature, prob, value) for each column and probability in `wanted`.

    Missing values are ignored, rows with a null group key are left out, and a column without
    any value gives no row.
    """
    by = list(by)
    values = df.select(*by, *[number(c).alias(c) for c in wanted])
    for key in by:
        values = values.where(F.col(key).isNotNull())
    if not wanted:
        raise ValueError("quantiles need at least one column")
    result = _narrowed(values, wanted, by, SMALL_GROUP)
    if result.where("outside").take(1):
        # The sketch missed a bracket: rank all values instead.
        result = _narrowed(values, wanted, by, None)
    return result.drop("outside")


def _array(values: list[float]) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def _narrowed(values: DataFrame, wanted: dict[str, list[float]], by: list[str], small_group: int | None) -> DataFrame:
    probs = {c: sorted(set(ps)) for c, ps in wanted.items()}
    if small_group is None:
        marked = _every_value(values, probs, by)
    else:
        brackets = materialise(_brackets(values, probs, by, small_group), "brackets")
        # Sending a value to Python costs more than the brackets of a single column in the plan.
        if not by or len(wanted) > 1 and brackets.count() <= SENT_BRACKETS:
            marked = _snap_batches(values, probs, by, brackets)
        else:
            marked = _snap_joined(values, probs, by, brackets)
    counts = marked.where("v IS NOT NULL").groupBy(*by, "feature", "v", "side").agg(F.sum("n").alias("n"))
    ranked = running_totals(counts, [*by, "feature"], ["v", "side"], ["n"])
    return materialise(_pick(ranked, probs, by), "quantiles")


def _every_value(values: DataFrame, probs: dict[str, list[float]], by: list[str]) -> DataFrame:
    """One row (by..., feature, v, side, n) per row and column, as it is."""
    pieces = [F.struct(F.lit(c).alias("feature"), F.col(quoted(c)).alias("v"), F.lit(0).alias("side"), F.lit(1).cast("long").alias("n")) for c in probs]
    return values.select(*by, F.inline(F.array(*pieces)))


class Sketch:
    """Sorted buffers by level; a value of level i stands for 2**i values."""

    def __init__(self) -> None:
        self.count, self.low, self.high = 0, np.inf, -np.inf
        self.levels: dict[int, list[np.ndarray]] = {}
        self.odd = 0

    def add(self, values: np.ndarray, level: int = 0) -> None:
        self.levels.setdefault(level, []).append(values)
        while sum(map(len, self.levels.get(level, []))) > BUFFER:
            merged = np.sort(np.concatenate(self.levels.pop(level)))
            # A value without a partner stays at its level.
            if len(merged) % 2:
                self.levels[level], merged = [merged[-1:]], merged[:-1]
            self.odd ^= 1
            level += 1
            self.levels.setdefault(level, []).append(merged[self.odd :: 2])

    def see(self, values: np.ndarray) -> None:
        if len(values):
            self.count += len(values)
            self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
            self.add(values)

    def numbers(self) -> int:
        return sum(len(v) for held in self.levels.values() for v in held)

    def ends(self, probs: list[float], small_group: int) -> tuple[list[float], list[float]]:
        """Bracket ends of each probability; the whole range for a small group."""
        if self.count <= small_group:
            return [self.low] * len(probs), [self.high] * len(probs)
        values = np.concatenate([v for held in self.levels.values() for v in held])
        weights = np.concatenate([np.full(len(v), 2.0**level) for level, held in self.levels.items() for v in held])
        order = np.argsort(values, kind="stable")
        values, ranks = values[order], np.cumsum(weights[order])
        total = ranks[-1]
        low = [self.low if p <= PAD else float(values[min(np.searchsorted(ranks, (p - PAD) * total), len(values) - 1)]) for p in probs]
        high = [self.high if p >= 1 - PAD else float(values[min(np.searchsorted(ranks, (p + PAD) * total), len(values) - 1)]) for p in probs]
        return low, high


def _groups(batch: pd.DataFrame, by: list[str]):
    """Row positions of each group of a batch."""
    if not by:
        return [((), slice(None))]
    return [(key if isinstance(key, tuple) else (key,), at) for key, at in batch.groupby(by, sort=False).indices.items()]


def _brackets(values: DataFrame, probs: dict[str, list[float]], by: list[str], small_group: int) -> DataFrame:
    """Rows (by..., feature, low, high): the ends of the bracket of each wanted probability."""
    places = {c: f"c{i}" for i, c in enumerate(probs)}
    keys = [f"k{i}" for i in range(len(by))]
    kinds = [f"{k} {values.schema[c].dataType.simpleString()}" for k, c in zip(keys, by)]
    schema = ", ".join([*kinds, "feature string", "slot int", "level int", "vs array<double>", "n long", "low double", "high double"])

    def rows(held: dict, slot: int) -> pd.DataFrame:
        out = []
        for (key, feature), sketch in held.items():
            for i, (level, buffers) in enumerate(sketch.levels.items()):
                stats = (sketch.count, sketch.low, sketch.high) if i == 0 else (0, np.nan, np.nan)
                out.append((*key, feature, slot, level, np.concatenate(buffers), *stats))
        return pd.DataFrame(out, columns=[*keys, "feature", "slot", "level", "vs", "n", "low", "high"])

    def build(batches):
        slot, held, numbers = TaskContext.get().partitionId() % SLOTS, {}, 0
        for batch in batches:
            for key, at in _groups(batch, keys):
                for feature, place in places.items():
                    v = batch[place].to_numpy(dtype=float)[at]
                    v = v[~np.isnan(v)]
                    if len(v):
                        sketch = held.setdefault((key, feature), Sketch())
                        before = sketch.numbers()
                        sketch.see(v)
                        numbers += sketch.numbers() - before
            if numbers > HELD_NUMBERS:
                yield rows(held, slot)
                held, numbers = {}, 0
        if held:
            yield rows(held, slot)

    def merged(part: pd.DataFrame) -> Sketch:
        sketch = Sketch()
        for level, vs in zip(part["level"], part["vs"]):
            sketch.add(np.asarray(vs, dtype=float), int(level))
        sketch.count, sketch.low, sketch.high = int(part["n"].sum()), part["low"].min(), part["high"].max()
        return sketch

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        return rows({(tuple(first[keys]), first["feature"]): merged(part)}, int(first["slot"]))

    def close(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[:1][[*keys, "feature"]].reset_index(drop=True)
        low, high = merged(part).ends(probs[first["feature"][0]], small_group)
        return first.assign(lows=[np.array(low, dtype=float)], highs=[np.array(high, dtype=float)])

    parts = values.toDF(*keys, *places.values()).mapInPandas(build, schema)
    slots = parts.groupBy(*keys, "feature", "slot").applyInPandas(merge, schema)
    ends = slots.groupBy(*keys, "feature").applyInPandas(close, ", ".join([*kinds, "feature string", "lows array<double>", "highs array<double>"]))
    return ends.withColumnsRenamed(dict(zip(keys, by)))


def _snap_batches(values: DataFrame, probs: dict[str, list[float]], by: list[str], brackets: DataFrame) -> DataFrame:
    """Rows (by..., feature, v, side, n): each batch is snapped by binary search and counted before it leaves the task.

    `side` is 0 for values kept as they are, -1 and 1 for values below and above a bracket.
    """
    places = {c: f"c{i}" for i, c in enumerate(probs)}
    keys = [f"k{i}" for i in range(len(by))]
    kinds = [f"{k} {values.schema[c].dataType.simpleString()}" for k, c in zip(keys, by)]
    found = brackets.toDF(*keys, "feature", "lows", "highs").toPandas()
    ends = {
        (tuple(getattr(r, k) for k in keys), r.feature): (np.asarray(r.lows, dtype=float), np.maximum.accumulate(np.asarray(r.highs, dtype=float)))
        for r in found.itertuples()
    }

    def snap(batches):
        for batch in batches:
            for key, at in _groups(batch, keys):
                for feature, place in places.items():
                    v = batch[place].to_numpy(dtype=float)[at]
                    v = v[~np.isnan(v)]
                    if not len(v):
                        continue
                    low, reach = ends[key, feature]
                    # The last bracket that starts at or below a value, and whether the value is inside.
                    slot = np.searchsorted(low, v, side="right") - 1
                    end = reach[np.maximum(slot, 0)]
                    inside = (slot >= 0) & (v <= end)
                    kept, counts = np.unique(v[inside], return_counts=True)
                    above = np.bincount(slot[~inside] + 1, minlength=len(low) + 1)
                    past = np.flatnonzero(above)
                    out = {k: [part] * (len(kept) + len(past)) for k, part in zip(keys, key)}
                    yield pd.DataFrame(
                        {
                            **out,
                            "feature": feature,
                            "v": np.concatenate((kept, np.where(past == 0, low[0], reach[np.maximum(past - 1, 0)]))),
                            "side": np.concatenate((np.zeros(len(kept), int), np.where(past == 0, -1, 1))),
                            "n": np.concatenate((counts, above[past])),
                        }
                    )

    schema = ", ".join([*kinds, "feature string", "v double", "side int", "n long"])
    return values.toDF(*keys, *places.values()).mapInPandas(snap, schema).withColumnsRenamed(dict(zip(keys, by)))


def _snap_joined(values: DataFrame, probs: dict[str, list[float]], by: list[str], brackets: DataFrame) -> DataFrame:
    """As `_snap_batches` for any number of groups: the rows are joined with the brackets of their group."""
    ends = [
        F.max(F.when(F.col("feature") == c, F.col(side)[i])).alias(f"{name}_{c}_{i}")
        for c, ps in probs.items()
        for i in range(len(ps))
        for side, name in (("lows", "lo"), ("highs", "hi"))
    ]
    wide = materialise(brackets.groupBy(*by).agg(*ends), "wide_brackets")
    pieces = ", ".join(_snapped_value(c, len(ps)) for c, ps in probs.items())
    snapped = values.join(wide, by, "inner").selectExpr(*by, f"inline(array({pieces}))")
    return snapped.withColumn("n", F.lit(1).cast("long"))


def _snapped_value(c: str, n_probs: int) -> str:
    """SQL for (feature, v, side): the value inside a bracket, else the nearest bracket end before it."""

    def piece(value: str, side: int) -> str:
        return f"struct({literal(c)} AS feature, {value} AS v, {side} AS side)"

    name = quoted(c)
    low, high = ([quoted(f"{end}_{c}_{i}") for i in range(n_probs)] for end in ("lo", "hi"))
    steps = [f"WHEN {name} < {low[0]} THEN {piece(low[0], -1)}"]
    for i in range(n_probs):
        if i:
            steps.append(f"WHEN {name} < {low[i]} THEN {piece(high[i - 1], 1)}")
        steps.append(f"WHEN {name} <= {high[i]} THEN {piece(name, 0)}")
    last = piece(f"IF({name} IS NULL, NULL, {high[-1]})", 1)
    return f"CASE {' '.join(steps)} ELSE {last} END"


def _pick(ranked: DataFrame, probs: dict[str, list[float]], by: list[str]) -> DataFrame:
    """Interpolate between the two order statistics around each wanted position."""
    wanted = F.expr("CASE feature " + " ".join(f"WHEN {literal(c)} THEN {_array(ps)}" for c, ps in probs.items()) + " END")
    position = lambda p: (F.col("total_n") - 1) * p
    first, last = F.col("before_n"), F.col("before_n") + F.col("n") - 1
    touching = F.filter(
        wanted, lambda p: (F.floor(position(p)) <= last) & (F.floor(position(p)) + 1 >= first)
    )
    hits = ranked.select("*", F.explode(touching).alias("prob")).withColumn("at", position(F.col("prob")))
    floor = F.floor("at")
    below = (floor >= first) & (floor <= last)
    above = (floor + 1 >= first) & (floor + 1 <= last)
    both = hits.groupBy(*by, "feature", "prob").agg(
        F.max(F.when(below, F.col("v"))).alias("lower"),
        F.max(F.when(above, F.col("v"))).alias("upper"),
        F.max(F.col("at") - floor).alias("part"),
        F.max(F.when(below, F.col("side") != 0)).alias("lower_out"),
        F.max(F.when(above, F.col("side") != 0)).alias("upper_out"),
    )
    exact = (F.col("part") == 0) | F.col("upper").isNull() | (F.col("lower") == F.col("upper"))
    value = F.when(exact, F.col("lower")).otherwise(
        F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("part")
    )
    outside = F.col("lower_out") | ((F.col("part") > 0) & F.coalesce("upper_out", F.lit(False)))
    return both.select(*by, "feature", "prob", value.alias("value"), outside.alias("outside"))


def wide_quantiles(
    df: DataFrame, named: dict[str, tuple[str, float]], by: list[str] = ()
) -> DataFrame:
    """One row per group with a column for each name -> (column, probability)."""
    by = list(by)
    wanted: dict[str, list[float]] = {}
    for column, prob in named.values():
        wanted.setdefault(column, []).append(prob)
    long = exact_quantiles(df, wanted, by)
    cells = [
        F.expr(f"max(IF(feature = {literal(c)} AND prob = {float(p)!r}D, value, NULL)) AS {quoted(name)}") for name, (c, p) in named.items()
    ]
    return long.groupBy(*by).agg(*cells) if by else long.agg(*cells)


def quantile_values(df: DataFrame, named: dict[str, tuple[str, float]]) -> dict[str, float]:
    """Global quantiles as plain numbers, one per name; None where the column has no value."""
    row = wide_quantiles(df, named).first()
    return {name: row[name] for name in named}

