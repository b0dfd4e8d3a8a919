"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A seed is the hash of some of the tokens of a window, chosen by a fixed mask; tokens under the holes of the
mask may differ. Windows of documents meet windows of benchmark items by seed; each meeting fixes an
alignment, and along it the best local match is scored: a point for an equal token, two off for a
different one. A document is contaminated by an item if that score is high enough for the item's length. Two off
undo what the masks tolerate, so `near` also scores with half a point off, against a floor that chance does not reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir.llm.common import few, materialize

#: The masks hold under a substitution of every third, fourth, fifth or later token: for each such period
#: one of them leaves out a whole residue class.
MASKS = ((0, 1, 3, 4, 7, 9), (0, 2, 3, 5, 8, 9))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _span(masks: tuple[tuple[int, ...], ...]) -> int:
    return 1 + max(k for m in masks for k in m)


def _seeds(frame: DataFrame, key: str, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """A row (key, at, seed) per window and mask; `at` is the window's first token.

    The windows are laid out as shifted slices and exploded, so that hashing runs in generated code. The
    words themselves are not carried along: a long text would be copied for each of its windows.
    """
    span = _span(masks)
    used = sorted({k for m in masks for k in m})
    n = F.greatest(F.size("words") - F.lit(span - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice("words", F.lit(k + 1), n).alias(f"w{k}") for k in used])
    windows = frame.select(key, F.posexplode(shifted).alias("at", "_w"))
    seed = F.explode(F.array(*[F.xxhash64(F.lit(i), *[F.col("_w")[f"w{k}"] for k in m]) for i, m in enumerate(masks)]))
    return windows.select(key, "at", seed.alias("seed"))


def best_score(a: Column, b: Column, equal: int = 1, different: int = -2) -> Column:
    """The highest sum over a run of aligned tokens: `equal` or `different` for each."""
    points = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.when(p["a"] == p["b"], equal).otherwise(different))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    step = lambda s, p: F.struct(F.greatest(s["now"] + p, F.lit(0)).alias("now"), F.greatest(s["best"], s["now"] + p).alias("best"))
    return F.aggregate(points, zero, step, lambda s: s["best"])


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    masks: tuple[tuple[int, ...], ...] = MASKS, min_score: int = 13, min_share: float = 0.6, max_broadcast_rows: int = 1_000_000,
    near: bool = False,
) -> DataFrame:
    """Rows doc_id, item_id, score, item_words of the contaminated pairs, one per pair.

    A pair counts if its best score is at least the lesser of `min_score` and `min_share` times the item's
    number of tokens (rounded up). An item with fewer tokens than the longest mask (10) has no window; it is met by the hash of
    its whole token sequence and counts where a document has all of it in order. Null or empty texts match nothing; texts are
    read whole, however long. Of equally good places either counts, the pair once. Rows that share an id are one document; null ids
    pair up as one. An empty table on either side gives no rows. Extra columns are ignored.

    With `near` a pair also counts if its best score at half a point off is at least the lesser of `min_score` and
    half the item's number of tokens, and at least 7.5: a whole item of 15 tokens or more with every third, fourth,
    fifth or later token replaced reaches that. The score given stays the one above, so such pairs show low ones.

    Seeds of the benchmark, its items and the alignments found are counted: up to `max_broadcast_rows` rows
    and MAX_BROADCAST_BYTES they are broadcast to the documents; beyond it the joins shuffle, and Spark splits the partition of a
    common seed.
    """
    items = materialize(benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("words")), "items")
    words = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("words"))
    item_seeds = materialize(_seeds(items, "item_id", masks).select("seed", "item_id", F.col("at").alias("item_at")).distinct(), "seeds")
    # where the item's first token falls in the document; below 0 if the document begins later
    start = (F.col("at") - F.col("item_at")).alias("start")
    span = _span(masks)
    lengths = sorted(r[0] for r in items.select(F.size("words")).where(F.size("words").between(1, span - 1)).distinct().collect())  # span - 1 rows at most
    hits = _seeds(words, "doc_id", masks).join(few(item_seeds, max_broadcast_rows), "seed").select("doc_id", "item_id", start)
    for n in lengths:
        short = items.where(F.size("words") == n)
        whole = _seeds(short, "item_id", (tuple(range(n)),)).select("seed", "item_id", F.col("at").alias("item_at")).distinct()
        hits = hits.unionByName(_seeds(words, "doc_id", (tuple(range(n)),)).join(few(whole, max_broadcast_rows), "seed").select("doc_id", "item_id", start))
    met = materialize(hits.distinct(), "alignments")
    both = words.join(few(met.withColumnRenamed("doc_id", "_id"), max_broadcast_rows), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    skipped = F.greatest(-F.col("start"), F.lit(0))
    region = F.slice("words", F.greatest("start", F.lit(0)) + 1, F.col("item_size"))
    sizes = items.select("item_id", F.size("words").alias("item_size"), F.col("words").alias("item_words"))
    aligned = both.join(few(sizes, max_broadcast_rows), "item_id").select("doc_id", "item_id", "item_size", F.slice("item_words", skipped + 1, F.col("item_size")).alias("a"), region.alias("b"))
    shorter = F.least(F.size("a"), F.size("b"))
    sides = F.slice("a", F.lit(1), shorter), F.slice("b", F.lit(1), shorter)
    halves = best_score(*sides, 2, -1) if near else F.lit(0)
    scored = aligned.select("doc_id", "item_id", F.col("item_size").cast("long").alias("item_words"), best_score(*sides).cast("long").alias("score"), halves.alias("halves"))
    enough = F.col("score") >= F.least(F.lit(min_score), F.ceil(F.lit(min_share) * F.col("item_words")))
    if near:
        enough |= F.col("halves") >= F.greatest(F.lit(15), F.least(F.lit(2 * min_score), F.col("item_words")))
    enough = F.when(F.col("item_words") < span, F.col("score") == F.col("item_words")).otherwise(enough)
    return scored.where(enough).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("item_words").alias("item_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose id has no overlap; a null id counts as an id."""
    hits = few(materialize(find_overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_hit")).distinct(), "hits"))
    return docs.join(hits, docs[id_col].eqNullSafe(hits["_hit"]), "left_anti")
