"""Text columns: number formatting, list splitting and score texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_number_texts(df: DataFrame, texts: dict[str, tuple[str, bool]]) -> DataFrame:
    """Add text columns for numbers: output -> (column, is it a whole-number column).

    Whole numbers print without a fraction and doubles in shortest decimal form.  Doubles print in
    plain decimals from 1e-4 up to 1e16 and with a two-digit exponent outside, while a plain cast
    switches to the exponent form at 1e-3 and 1e7.  The parts are separate columns, which keeps
    each expression small.
    """
    plain = df.selectExpr("*", *[f"CAST({c} AS STRING) AS {out}" for out, (c, _) in texts.items()])
    doubles = {out: c for out, (c, whole) in texts.items() if not whole}
    parts = plain.selectExpr(
        "*",
        *[f"IF(contains({out}, 'E'), TRY_CAST(split_part({out}, 'E', 2) AS INT), NULL) AS {out}_exp" for out in doubles],
        *[f"IF(contains({out}, 'E'), regexp_replace(split_part({out}, 'E', 1), '^-|[.]0$', ''), NULL) AS {out}_man" for out in doubles],
    )
    digits = parts.selectExpr("*", *[f"replace({out}_man, '.', '') AS {out}_dig" for out in doubles])
    spelled = digits.withColumns({out: F.expr(_spelled(out, c)) for out, c in doubles.items()})
    return spelled.drop(*[f"{out}_{part}" for out in doubles for part in ("exp", "man", "dig")])


def _spelled(out: str, c: str) -> str:
    exponent, mantissa, digits = f"{out}_exp", f"{out}_man", f"{out}_dig"
    large = (
        f"concat(substring(rpad({digits}, {exponent} + 1, '0'), 1, {exponent} + 1), '.', "
        f"IF(length({digits}) > {exponent} + 1, substring({digits}, {exponent} + 2), '0'))"
    )
    small = f"concat('0.', repeat('0', -{exponent} - 1), {digits})"
    scientific = f"concat({mantissa}, IF({exponent} < 0, 'e-', 'e+'), lpad(CAST(abs({exponent}) AS STRING), 2, '0'))"
    return (
        f"IF({exponent} IS NULL, {out}, concat(IF({c} < 0, '-', ''), CASE WHEN {exponent} BETWEEN 0 AND 15 THEN {large} "
        f"WHEN {exponent} BETWEEN -4 AND -1 THEN {small} ELSE {scientific} END))"
    )


def split_list(text: Column, separator: str) -> Column:
    """Split on a separator, trim the parts and drop empty ones; null gives an empty list."""
    parts = F.transform(F.split(text, f"[{separator}]"), lambda part: F.trim(part))
    return F.coalesce(F.filter(parts, lambda part: part != ""), F.array().cast("array<string>"))


def parse_breakdown(text: Column) -> Column:
    """'a=1; b=2' as a map of integers; entries without '=' are left out, a bad number counts as 0."""
    items = F.filter(F.split(text, "; "), lambda item: item.contains("="))
    key = lambda item: F.regexp_replace(item, "=[^=]*$", "")
    points = lambda item: F.coalesce(F.trim(F.substring_index(item, "=", -1)).try_cast("int"), F.lit(0))
    entries = F.transform(items, lambda item: F.struct(key(item).alias("key"), points(item).alias("value")))
    # A repeated name keeps its last value.
    merged = F.aggregate(
        entries,
        F.create_map().cast("map<string,int>"),
        lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])),
    )
    return F.coalesce(merged, F.create_map().cast("map<string,int>"))
