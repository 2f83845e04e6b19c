"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key.  Inside a source the keys are cut into equal
ranges (of about ``RANGE_ROWS`` documents, so a source with a third of all rows has
proportionally more of them); word counts are summed per range, prefix sums over the
few range totals give each range its offset, and only inside a range are documents
sorted.  A source is cut where its running sum meets its budget, after as many whole
passes as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in one sorted range.
RANGE_ROWS = 2_000
#: Weights dealt to the sources in code-point order, again and again.
WEIGHTS = (3, 1, 2)


def word_count(text) -> F.Column:
    """Number of words, 0 for null: every word starts after white space or at the start."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size, ...)`` with ``target`` added.

    ``share`` of all words is dealt by weight; no target passes ``most`` times its
    source, and what is above goes to the others by weight.  With the sources ordered
    by cap over weight, those that end at their cap are a prefix, so one running sum
    finds the level of the rest.  One row per source is handled, never one per document.
    """
    n = len(weights)
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % n + 1).cast("int"))
    ranked = sizes.select("*", rank.alias("source_rank"), weight.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(F.lit(1))
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - (F.sum("cap").over(upto) - F.col("cap"))
    level = ranked.withColumn("level", left / (F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight")))
    # the first source whose cap holds its share sets the level for itself and all after it
    fits = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    chosen = F.first(fits, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(chosen.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), chosen * F.col("weight")))
    return level.withColumn("target", target).drop("weight", "cap", "level", "source_rank")


def order_key(id_col: str = "doc_id", text_col: str = "text", seed: str = "mix") -> F.Column:
    """What orders documents inside a source: the MD5 of seed and id, of seed and the text's MD5 where the id is null."""
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def _placed(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...], share: float, most: float, seed: str) -> DataFrame:
    """Documents with ``size``, ``before`` (words ahead of them in their source), ``passes`` and ``rest`` of the source, and ``taken``."""
    key = order_key(id_col, text_col, seed)
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranges = F.ceil(F.col("n_docs") / F.lit(RANGE_ROWS))
    budgets = source_targets(sizes, weights, share, most).select(F.col("source").alias("s"), "source_size", "target", ranges.alias("n_ranges"))
    budget = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    budgets = budgets.withColumn("passes", passes).withColumn("rest", budget - F.col("passes") * F.col("source_size"))
    # a hot source only repeats one small row: the side with one row per source is hashed, and AQE broadcasts or splits
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    ranged = sized.join(budgets, F.col("source").eqNullSafe(F.col("s"))).withColumn("range", F.floor(spot * F.col("n_ranges")))
    totals = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("s2"), F.col("range").alias("r2"), F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("offset"))
    placed = ranged.join(offsets, F.col("source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")))
    inside = W.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.col("offset") + F.sum("size").over(inside) - F.col("size")
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return placed.select("id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "key", "passes", "rest", before.alias("before"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """``(id_col, source, size, source_size, target, taken)``, one row for each row of ``docs``.

    ``taken`` counts the words that the mix takes of the document, repeats counted:
    ``size`` for every whole pass over its source and, in the last pass, what lies
    before the source's cut (one document per source may be cut inside).  A null
    source is a source of its own, last in order; null and blank texts have size 0 and
    nothing is taken of them; an empty table gives an empty mix.  Documents are
    ordered by the MD5 of seed and id, then by id and size, so reruns agree; where the
    id is null the MD5 of the text stands in for it, so rows without id spread over the
    ranges too.  Equal rows are interchangeable.  Other columns are ignored.
    """
    placed = _placed(docs, id_col, source_col, text_col, weights, share, most, seed)
    return placed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken")


def mix_rules(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``mix_sources`` takes, told by few rows, so that texts need no shuffle to meet it: ``(cuts, shared)``.

    ``cuts(__source, __passes, __at, __part)`` has a row for each source with words: documents whose ``order_key`` is
    less than ``__at`` are taken once more than ``__passes`` times, and ``__part`` words of the one at it.  The rows of
    an id that has several, or of the null id, stand in ``shared(__id, __size, __taken)`` with the greatest of what is
    taken of one of them instead.
    """
    placed = _placed(docs, "doc_id", "source", "text", WEIGHTS, 1.5, 2.0, "mix")
    cut = (F.col("size") > 0) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size"))
    known = [F.when(cut, F.col("key")).alias("at"), F.when(cut, F.col("rest") - F.col("before")).alias("part")]
    placed = materialize(placed.select("id", "source", "size", "taken", "passes", *known), "placed")
    cuts = placed.where("at IS NOT NULL").select(F.col("source").alias("__source"), F.col("passes").alias("__passes"), F.col("at").alias("__at"), F.col("part").alias("__part"))
    ids = placed.groupBy(F.col("id").alias("__id")).agg(F.max(F.when(F.col("taken") > 0, F.col("size"))).alias("__size"), F.max("taken").alias("__taken"), F.count(F.lit(1)).alias("n"))
    return cuts, ids.where("n > 1 OR __id IS NULL").drop("n")
