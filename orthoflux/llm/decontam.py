"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask names the words of a short span that count; the others may differ.  Every span
of the training texts and of the test items is hashed under each mask, equal hashes
are joined (an item shorter than all masks is hashed as a whole), and every hit proposes an alignment (a document, an item, a shift).  The
words of document and item are then compared along the shift: +1 for an equal word,
-1 for another, and the best-scoring stretch decides, so substituted words cost a
little and do not hide an overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Positions that count, three masks of weight 6 that span 11, 10 and 8 words.
MASKS = ((0, 1, 3, 6, 7, 10), (0, 2, 3, 5, 8, 9), (0, 1, 2, 4, 5, 7))
SPAN = 1 + min(max(m) for m in MASKS)
#: A stretch of this score (equal less unequal words) is an overlap; of an item with fewer words, three quarters of its words.
MIN_SCORE = 12
#: Test hashes up to which they are broadcast (about 24 bytes each); beyond, the join is shuffled.
BROADCAST_SEEDS = 500_000


def _words(text) -> F.Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(rows: DataFrame, keep: list[str], masks=MASKS) -> DataFrame:
    """``keep``, ``pos`` and ``seed`` of every span under every mask that fits there; ``rows`` has ``words``."""
    least = 1 + min(max(m) for m in masks)
    hashed = rows.where(F.size("words") >= least).select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    used = sorted({p for m in masks for p in m})
    # the slice of position 0 is the longest; what lies beyond the last word is null
    spans = F.arrays_zip(*[F.slice("h", p + 1, F.size("h") - (least - 1)).alias(f"c{p}") for p in used])
    each = hashed.select(*keep, F.posexplode(spans).alias("pos", "c"))
    masked = F.array(*[F.when(F.col(f"c.c{max(m)}").isNotNull(), F.xxhash64(F.lit("-".join(map(str, m))), *[F.col(f"c.c{p}") for p in m])) for m in masks])
    return each.select(*keep, "pos", F.explode(masked).alias("seed")).where("seed IS NOT NULL")


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: int = MIN_SCORE) -> DataFrame:
    """``(id_col, item_col, doc_word, n_words, n_equal)``: the best overlap of each pair that has one.

    ``doc_word`` is the first word of the stretch in the document (words are runs of
    letters and digits, lower case, from 0).  Null and blank texts and rows without id
    have no overlaps; an item of fewer than ``SPAN`` words overlaps where all its words
    stand in a row; repeated rows count once; empty tables give an empty result.  Other
    columns are ignored.
    """
    tests = materialize(items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), _words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0).distinct(), "items")
    # the lengths of short items, SPAN - 1 numbers at most, each a mask without gaps
    short = {r["n"]: tuple(range(r["n"])) for r in tests.select(F.size("words").alias("n")).where(F.col("n") < SPAN).distinct().orderBy("n").collect()}
    item_seeds = _seeds(tests, ["item"])
    for n, mask in short.items():
        item_seeds = item_seeds.unionByName(_seeds(tests.where(F.size("words") == n), ["item"], (mask,)))
    seeds = materialize(item_seeds.select("seed", "item", F.col("pos").alias("item_pos")).distinct(), "item-seeds")
    small = seeds.count() <= BROADCAST_SEEDS
    hint = F.broadcast if small else (lambda x: x)
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ours = _seeds(base.select("id", _words(F.col("text")).alias("words")), ["id"], (*MASKS, *short.values()))
    # of a passage every position hits the same shift: partial aggregation leaves one row
    hits = materialize(ours.join(hint(seeds), "seed").groupBy("id", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.count(F.lit(1)).alias("n_hits")), "hits")
    placed = hits.join(base, "id").select("id", "item", "shift", _words(F.col("text")).alias("words"))
    paired = placed.join(hint(tests.select("item", F.col("words").alias("item_words"))), "item")
    lo = F.greatest(F.lit(0), -F.col("shift"))
    n = F.least(F.size("item_words"), F.size("words") - F.col("shift")) - lo
    lined = paired.select("id", "item", "shift", lo.alias("lo"), F.size("item_words").alias("n_item"), "words", "item_words", n.alias("n")).where("n > 0")
    same = F.zip_with(F.slice("words", F.col("lo") + F.col("shift") + 1, F.col("n")), F.slice("item_words", F.col("lo") + 1, F.col("n")), lambda a, b: a == b)
    zero = F.struct(*[F.lit(0).alias(x) for x in ("at", "score", "start", "equal", "best", "first", "last", "n_equal")])

    def step(s, equal):
        fresh = s["score"] <= 0
        score = F.when(fresh, 0).otherwise(s["score"]) + F.when(equal, 1).otherwise(-1)
        start = F.when(fresh, s["at"]).otherwise(s["start"])
        hits_ = F.when(fresh, 0).otherwise(s["equal"]) + F.when(equal, 1).otherwise(0)
        more = score > s["best"]
        pick = lambda a, b: F.when(more, a).otherwise(b)
        return F.struct((s["at"] + 1).alias("at"), score.alias("score"), start.alias("start"), hits_.alias("equal"), pick(score, s["best"]).alias("best"), pick(start, s["first"]).alias("first"), pick(s["at"], s["last"]).alias("last"), pick(hits_, s["n_equal"]).alias("n_equal"))

    scored = lined.select("id", "item", "shift", "lo", "n_item", F.aggregate(same, zero, step).alias("s"))
    whole = F.when(F.col("n_item") < SPAN, F.col("n_item")).otherwise(F.ceil(F.col("n_item") * 0.75))
    passed = scored.where(F.col("s.best") >= F.least(F.lit(min_score), whole))
    best = passed.groupBy("id", "item").agg(F.max(F.struct(F.col("s.best").alias("score"), (-F.col("shift")).alias("order"), (F.col("lo") + F.col("shift") + F.col("s.first")).alias("doc_word"), (F.col("s.last") - F.col("s.first") + 1).alias("n_words"), F.col("s.n_equal").alias("n_equal"))).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), *[F.col(f"b.{c}").cast("long").alias(c) for c in ("doc_word", "n_words", "n_equal")])


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that overlap an item; rows without id stay, and are not dealt to one task for the look-up."""
    found = find_overlaps(docs, items, id_col=id_col, **options).select(F.col(id_col)).distinct()
    known = docs.where(F.col(id_col).isNotNull()).join(found, id_col, "left_anti")
    return known.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
