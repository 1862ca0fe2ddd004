"""Benchmark decontamination by spaced-seed hashing.  DataFrame operations only.

Words are folded (A-Z) and hashed.  Two fixed masks pick five of the next 6 and 9 words and ignore the
others; the hashes of the picked words of test items are joined with those of the documents.  For any 15
aligned words with at most 3 substitutions one of the masks fits between the substitutions (a test tries
all cases), so such overlaps are never missed.  Items of up to 10 words, where fewer words have to agree, have
masks of their own length that miss no substitution that the rule allows; items of up to four words, which
allow none, are sought whole.  Only masks of lengths that the benchmark has are laid over documents.  Every hit names a diagonal of one document and one item;
on it the item is laid over the document and the best 15 words (all words of a shorter item) are counted.
With 80 % equal words the document holds a part of the item.

Null and empty texts match nothing.  A document is its id and text: equal rows are one document in the result, a null id stays null.
Items with a null id are kept; other columns are ignored.  The seeds of the benchmark are broadcast when
their counted size is small and joined by a shuffle beyond.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from cellsight.llm.common import WORD, materialise, sized

#: Positions that the masks pick.
MASKS = ((0, 1, 3, 4, 5), (0, 1, 5, 7, 8))
WINDOW = 15
EQUAL_PERCENT = 80
#: Masks for items of so few words that MASKS would miss some; other items have MASKS.
SHORT_MASKS = {
    1: ((0,),),
    2: ((0, 1),),
    3: ((0, 1, 2),),
    4: ((0, 1, 2, 3),),
    5: ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4)),
    6: (MASKS[0], (0, 1, 2, 3, 4), (0, 2, 3, 4, 5), (0, 1, 2, 4, 5), (0, 1, 2, 3, 5)),
    7: (MASKS[0], (0, 1, 2, 3, 4), (0, 1, 2, 3, 5)),
    8: (MASKS[0], (0, 1, 2, 3, 4)),
    10: (*MASKS, (0, 1, 2, 3, 4)),
}
_ALL_MASKS = tuple(dict.fromkeys([*MASKS, *[m for masks in SHORT_MASKS.values() for m in masks]]))
#: Items from this many words on have equal masks.
_LONG = max(SHORT_MASKS) + 1
#: Items of up to this many words allow no substitution.
_WHOLE = max(n for n in range(1, _LONG) if (n - 1) * 100 < n * EQUAL_PERCENT)
_STRIDE = 16
_SPAN = max(m[-1] for m in MASKS) + 1


def hashed_words(text: Column) -> Column:
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.regexp_extract_all(folded, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def masks_of(size: int) -> tuple[tuple[int, ...], ...]:
    return SHORT_MASKS.get(size, MASKS)


def _seeds(words: DataFrame, keys: list[str], numbers: list[int]) -> DataFrame:
    """`words` has an array _words of word hashes; one row per mask and position: keys, _at, _mask, _seed."""
    start = F.sequence(F.lit(0), F.greatest(F.size("_words") - 1, F.lit(0)), F.lit(_STRIDE))
    pieces = words.where(F.size("_words") > 0).select(*keys, "_words", F.explode(start).alias("_start"))
    pieces = pieces.select(*keys, "_start", F.slice("_words", F.col("_start") + 1, _STRIDE + _SPAN - 1).alias("_piece"))
    hashes = [
        F.when(F.get("_piece", F.lit(k + _ALL_MASKS[number][-1])).isNotNull(), F.xxhash64(F.lit(number), *[F.get("_piece", F.lit(k + p)) for p in _ALL_MASKS[number]]))
        for number in numbers
        for k in range(_STRIDE)
    ]
    found = pieces.select(*keys, "_start", F.posexplode(F.array(*hashes)).alias("_place", "_seed"))
    mask = F.get(F.array(*[F.lit(n) for n in numbers]), (F.col("_place") / _STRIDE).cast("int"))
    return found.where("_seed IS NOT NULL").select(*keys, (F.col("_start") + F.col("_place") % _STRIDE).alias("_at"), mask.alias("_mask"), "_seed")


def _item_seeds(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """The seeds of each item under the masks of its length, and the numbers of the masks that any item has."""
    cut = items.select("_item_key", F.col("_item_words").alias("_words"), F.least(F.size("_item_words"), F.lit(_LONG)).alias("_length"))
    lengths = [r["_length"] for r in cut.where("_length > 0").select("_length").distinct().collect()]
    having = {k: [n for n in lengths if m in masks_of(n)] for k, m in enumerate(_ALL_MASKS)}
    numbers = [k for k, sizes in having.items() if sizes] or list(range(len(MASKS)))
    own = F.lit(False)
    for k in numbers:
        own = own | ((F.col("_mask") == k) & F.col("_length").isin(having[k]))
    seeds = _seeds(cut, ["_item_key", "_length"], numbers).where(own)
    return seeds.select("_item_key", (F.col("_length") <= _WHOLE).alias("_whole"), F.col("_at").alias("_item_at"), "_seed"), numbers


def document_key(id_col: Column, text: Column) -> Column:
    return F.xxhash64(id_col.cast("string"), id_col.isNull(), text.cast("string"), text.isNull())


def _overlaps(hits: DataFrame) -> DataFrame:
    """Count equal words of the item laid over the document on the diagonal."""
    equal = F.expr("transform(_item_words, (w, i) -> IF(w <=> get(_words, i + _diagonal), 1, 0))")
    laid = hits.withColumn("_equal", equal).withColumn("_size", F.size("_item_words")).withColumn("_window", F.least("_size", F.lit(WINDOW)))
    best = F.expr(
        "array_max(transform(sequence(0, _size - _window), s -> struct("
        "aggregate(slice(_equal, s + 1, _window), 0, (a, x) -> a + x) AS equal, -s AS start)))"
    )
    laid = laid.withColumn("_best", best)
    return laid.where(F.col("_best.equal") * 100 >= F.col("_window") * EQUAL_PERCENT)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds a part of.

    n_equal of n_window words are equal in the best window, which starts at word doc_word of the document
    and item_word of the item; n_overlap words are equal on its diagonal.  _key identifies the document.
    """
    items = benchmark.select(F.col(f"`{item_col}`").alias("_item"), hashed_words(F.col(f"`{item_text}`")).alias("_item_words"))
    items = materialise(items.withColumn("_item_key", F.xxhash64(F.col("_item").cast("string"), F.to_json("_item_words"))).dropDuplicates(["_item_key"]), "items")
    seeds, numbers = _item_seeds(items)
    seeds = materialise(seeds, "seeds")
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    words = docs.select(doc_id.alias("_id"), document_key(doc_id, text).alias("_key"), hashed_words(text).alias("_words"))
    met = _seeds(words.select("_key", "_words"), ["_key"], numbers).join(sized(seeds, 40), "_seed")
    # Every hit of an item sought whole is as good as the first.
    diagonal = F.col("_at") - F.col("_item_at")
    hits = met.groupBy("_key", "_item_key", F.when(~F.col("_whole"), diagonal).alias("_each")).agg(F.min(diagonal).alias("_diagonal"))
    hits = materialise(hits.drop("_each"), "hits")
    keys = materialise(hits.select("_key").distinct(), "keys")
    texts = words.join(sized(keys, 16), "_key", "left_semi").dropDuplicates(["_key"])
    checked = _overlaps(hits.join(texts, "_key").join(sized(items, 600), "_item_key"))
    found = checked.select(
        "_key", F.col("_id").alias("_id"), F.col("_item").alias("_item"), "_item_key",
        F.struct(
            F.col("_best.equal").alias("n_equal"), F.aggregate("_equal", F.lit(0), lambda a, x: a + x).alias("n_overlap"),
            (-F.col("_diagonal")).alias("order"), F.col("_window").alias("n_window"),
            (F.col("_diagonal") - F.col("_best.start")).alias("doc_word"), (-F.col("_best.start")).alias("item_word"),
        ).alias("best"),
    )
    each = found.groupBy("_key", "_id", "_item", "_item_key").agg(F.max("best").alias("best"))
    return each.select("_key", F.col("_id").alias(id_col), F.col("_item").alias(item_col), *[F.col("best")[c].alias(c) for c in ("n_equal", "n_window", "n_overlap", "doc_word", "item_word")])


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no part of an item, with all their columns."""
    columns = docs.columns
    found = materialise(contaminated(docs, benchmark, id_col, text_col).select("_key").distinct(), "contaminated")
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    id_at, text_at = (F.col(f"c{columns.index(c)}") for c in (id_col, text_col))
    kept = plain.withColumn("_key", document_key(id_at, text_at)).join(sized(found, 16), "_key", "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
