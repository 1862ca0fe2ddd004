"""Mixing sources to target weights by Pareto order sampling.  DataFrame operations only.

Sources by code point (null last) weigh 3, 1, 2, repeating, and share 150 % of all words.  A target
stops at twice its source's size and the excess is shared again by weight, which has a closed form:
with the sources in the order of cap / weight, the stopped ones are a prefix.  Both steps use range
partitioned running totals, so no task holds all sources or a whole source.

Within a source every document gets floor(target / size) certain copies.  The rest of the target is
drawn with the inclusion probability p = the fraction that is left: documents are ranked by the odds of
a hashed uniform number over the inclusion odds p / (1 - p), and taken in that order while they fit.
What is left open by the first document that does not fit is offered to the later ones in the same
order, and at last to the one document that brings the words nearest to the target.

A null or empty text has size 0, takes nothing and counts in no source's size; a null source is a
source of its own.  The draw hashes id, source and text, so reruns agree under any partitioning; rows
equal in all three are interchangeable and each is a document of its own.  Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellsight.llm.common import ROW, WORD, materialise, with_row
from cellsight.operators.joins import null_safe_join
from cellsight.operators.ranking import running_totals

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str) -> Column:
    """A number in (0, 1) with 52 bits from the row's content."""
    name = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit(seed), F.coalesce("source", F.lit("-")), F.col("text_md5"))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Per source: source_size and target, from rows of (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"no_source": F.col("source").isNull(), "one": F.lit(1)})
    placed = running_totals(sources, [], ["no_source", "source"], ["one"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before_one") % len(weights)).cast("int") + 1)
    capped = placed.select("source", "source_size", "no_source", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    ordered = running_totals(capped.withColumn("ratio", F.col("cap") / F.col("weight")), [], ["ratio", "no_source", "source"], ["cap", "weight"])
    level = (F.col("total_cap") * (share / most) - F.col("before_cap")) / (F.col("total_weight") - F.col("before_weight"))
    leveled = materialise(ordered.select("source", "source_size", "cap", "weight", "ratio", level.alias("level")), "targets")
    first = leveled.where("ratio > level").agg(F.min_by("level", "ratio").alias("level")).first()["level"]
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.col("weight") * F.lit(first))
    return leveled.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def _drawn(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Add the source's columns, the rate of copies and, where a copy is left to chance, the place in the draw."""
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    rated = null_safe_join(rows, targets, ["source"]).withColumns({"rate": rate, "u": uniform(seed)})
    inclusion = F.col("rate") - F.floor("rate")
    odds = (F.col("u") / (1 - F.col("u"))) * (1 - inclusion) / F.nullif(inclusion, F.lit(0.0))
    return rated.withColumn("draw", F.when((F.col("size") > 0) & (inclusion > 0), odds)).withColumn("place", F.struct("draw", ROW))


def _fitting(rows: DataFrame, room: str) -> DataFrame:
    """Mark the rows whose running size in the order of the draw stays within the source's room."""
    totals = running_totals(rows, ["source"], ["draw", ROW], ["size"])
    return totals.select(*rows.columns, (F.col("before_size") + F.col("size") <= F.col(room)).alias("fits"))


def _ends(rows: DataFrame, room: str, number: int) -> DataFrame:
    """Per source: the words that the marked rows leave open, and the place of the last marked row.

    Sizes are positive, so the marked rows are a prefix of the order and the place says which they are.
    """
    taken = F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))
    last = F.max(F.when(F.col("fits"), F.struct("draw", ROW)))
    return rows.groupBy("source").agg((F.first(room) - taken).alias(f"gap_{number}"), last.alias(f"end_{number}"))


def _draw_limits(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """The targets with what tells, row by row, whether the draw takes it: gap_1, end_1, end_2 and last_row."""
    drawn = _drawn(rows.select(ROW, "id", "source", "size", "text_md5"), targets, seed).where("draw IS NOT NULL")
    room = F.col("target") - F.floor("rate") * F.col("source_size")
    first = materialise(_fitting(drawn.select(ROW, "source", "size", "draw", room.alias("room")), "room"), "draw")
    ends = materialise(_ends(first, "room", 1), "ends")
    rest = null_safe_join(first.where("NOT fits").drop("fits"), ends, ["source"]).where("size <= gap_1")
    second = materialise(_fitting(rest.select(ROW, "source", "size", "draw", "gap_1"), "gap_1"), "draw")
    ends = null_safe_join(ends, _ends(second, "gap_1", 2), ["source"], "left")
    ends = materialise(ends.withColumn("gap_2", F.coalesce("gap_2", "gap_1")), "ends")
    left = null_safe_join(first.where("NOT fits").withColumn("place", F.struct("draw", ROW)), ends, ["source"])
    left = left.where(~_taken_second() & F.expr("abs(gap_2 - size) < gap_2"))
    last = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap_2") - F.col("size")), "draw", ROW))[ROW].alias("last_row"))
    limits = null_safe_join(null_safe_join(targets, ends, ["source"], "left"), last, ["source"], "left")
    return materialise(limits, "limits")


def _taken_second() -> Column:
    return F.coalesce((F.col("size") <= F.col("gap_1")) & (F.col("place") <= F.col("end_2")), F.lit(False))


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED,
               carry: list[str] | None = None, **parameters) -> DataFrame:
    """Per row: _id, _source, size, source_size, target, copies and taken, with the columns in `carry` as _c0, _c1, ...

    The draw is reduced to a few values per source, so the rows themselves, and what they carry, are not shuffled.
    """
    text = F.col(f"`{text_col}`")
    carried = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry or [])]
    rows = materialise(
        with_row(
            docs.select(
                *carried, F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"),
                F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_md5"),
            )
        ),
        "sizes",
    )
    targets = materialise(source_targets(rows.select("source", "size"), **parameters), "targets")
    result = _drawn(rows, _draw_limits(rows, targets, seed), seed)
    taken = (F.col("place") <= F.col("end_1")) | _taken_second() | (F.col(ROW) == F.col("last_row"))
    extra = F.coalesce(F.col("draw").isNotNull() & taken, F.lit(False)).cast("long")
    copies = F.when(F.col("size") > 0, F.floor("rate") + extra).otherwise(0).cast("long")
    return result.select(
        *[F.col(f"_c{i}") for i in range(len(carried))], F.col("id").alias("_id"), F.col("source").alias("_source"), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of `docs` as often as the mix takes it, with its columns and `copy` from 1 on."""
    columns = docs.columns
    drawn = pareto_mix(docs, carry=columns, **options).where("copies > 0")
    copy = "copy" if "copy" not in columns else "mix_copy"
    named = [F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)]
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*named, F.col("_copy").alias(copy))
