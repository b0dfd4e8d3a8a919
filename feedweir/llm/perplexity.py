"""Quality rules: simple counts, and the perplexity of a modified Kneser-Ney model per language.

The model runs over characters (n-grams of order 5 in lower case, white space as one blank), so its size is set
by the languages, not by the corpus. An n-gram is a 60-bit number, twelve bits per character: exact up to U+0FFF, while
characters beyond share the 2,048 upper codes by their low bits, so that for scripts such as Chinese it counts classes of characters.
Spark counts the highest order over all documents and derives the lower orders, the discounts and the
interpolated probabilities; scoring reads sorted arrays of n-grams. A model beyond the stated size is joined
with the documents' own n-gram counts instead. Perplexity is per word: the characters' negative log
probabilities over the number of words. A document is rejected if its perplexity lies outside
the band of its language, which the quartiles of all documents that pass the counts define. The lower bound
has its own spread, for low values are near; it widens for short texts, whose means scatter more.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir.llm.common import few, frugal, materialize, settled, prepare_workers
from feedweir.llm.ngram_join import MIX

ORDER, BITS = 5, 12
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Languages whose parameters are broadcast.
MAX_LANGUAGES = 10_000
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    if len(words) < 4:
        return 0
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - 2
    mixed = np.zeros(n, np.uint64)
    for k in range(3):
        mixed = (mixed + each[k : k + n]) * np.uint64(MIX[k])
        mixed ^= mixed >> np.uint64(31)
    order = np.argsort(mixed, kind="stable")
    equal = mixed[order][1:] == mixed[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def counts_of(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()
    seen: set[str] = set()
    copies = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            copies += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), copies, repeated_words(words)


def char_grams(text: str) -> np.ndarray:
    """The n-grams that end in each character of the normalised text; 0 stands before its begin.

    Code points from 4,096 on share the upper half of the codes."""
    plain = b" ".join(text.encode().split()).decode().lower()
    codes = np.frombuffer(plain.encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(codes < 1 << BITS, codes, (1 << BITS - 1) + (codes & (1 << BITS - 1) - 1))
    padded = np.concatenate([np.zeros(ORDER - 1, np.int64), codes])
    grams = np.zeros(len(codes), np.int64)
    for k in range(ORDER):
        grams = grams << BITS | padded[k : k + len(codes)]
    return grams


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: pre-aggregated in a task, in bounded blocks."""
    held: dict[str, tuple[list, int]] = {}

    def out(lang: str, parts: list) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            parts, size = held.get(lang, ([], 0))
            grams = char_grams(text.as_py())
            parts.append(grams)
            size += len(grams)
            if size > 1_000_000:
                yield out(lang, parts)
                parts, size = [], 0
            held[lang] = (parts, size)
    for lang, (parts, size) in held.items():
        if size:
            yield out(lang, parts)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from counts of counts, kept within [0, count]."""
    if not n1:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = [i - (i + 1) * y * more / less if less else i * y for i, less, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))


def _by_language(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 (the discounts), v (grams) of one order: a row a language, broadcast if they are few."""
    n = [F.count_if(F.col("a") == i).cast("double") for i in (1, 2, 3, 4)]
    counted = level.groupBy("lang").agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)], F.count("*").alias("v"))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    found = ["lang", "v"]
    for i in (1, 2, 3):
        less, more = F.col(f"n{i}"), F.col(f"n{i + 1}")
        raw = F.when(less > 0, i - (i + 1) * y * more / less).otherwise(i * y)
        found.append(F.when(F.col("n1") > 0, F.least(F.greatest(raw, F.lit(0.05)), F.lit(i - 0.05))).otherwise(0.5).alias(f"d{i}"))
    return few(materialize(counted.select(*found), "languages"), MAX_LANGUAGES)


def fit(docs: DataFrame) -> dict[int, DataFrame]:
    """order -> (lang, gram, p, gamma): interpolated probabilities, and the weight of a gram as a context of the
    order above (null if it never is one). `docs` has lang and text without nulls."""
    spark = docs.sparkSession
    top = docs.select("lang", "text").mapInArrow(frugal(_count), "lang string, gram long, n long")
    levels = {ORDER: materialize(top.groupBy("lang", "gram").agg(F.sum("n").alias("a")), "grams")}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
        levels[k] = materialize(levels[k + 1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("a")), "grams")
    model: dict[int, DataFrame] = {}
    for k in range(1, ORDER + 1):
        level = levels[k]
        context = F.shiftright("gram", BITS)
        joined = level.join(_by_language(level), "lang").withColumn("context", context)
        sums = joined.groupBy("lang", "context").agg(
            F.sum("a").alias("total"),
            F.sum(F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))).alias("taken"),
        )
        given = joined.join(sums, ["lang", "context"]).withColumn("gamma_of", F.col("taken") / F.col("total"))
        own = F.greatest(F.col("a") - F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3")), F.lit(0.0)) / F.col("total")
        if k == 1:
            p = given.select("lang", "gram", (own + F.col("gamma_of") / F.col("v")).alias("p"))
        else:
            lower = model[k - 1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            with_suffix = given.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)))
            p = with_suffix.join(lower, ["lang", "suffix"]).select("lang", "gram", (own + F.col("gamma_of") * F.col("q")).alias("p"))
            gammas = sums.select("lang", F.col("context").alias("gram"), (F.col("taken") / F.col("total")).alias("gamma"))
            model[k - 1] = materialize(model[k - 1].join(gammas, ["lang", "gram"], "left"), "model")
        model[k] = materialize(p, "model")
    model[ORDER] = model[ORDER].withColumn("gamma", F.lit(None).cast("double"))
    return model


@dataclass
class Arrays:
    """Sorted n-grams of one language with their log probabilities and back-off weights, per order."""

    grams: list[np.ndarray]
    logs: list[np.ndarray]
    gammas: list[np.ndarray]
    unseen: float

    def log_sum(self, grams: np.ndarray) -> float:
        """Sum of the log probabilities; shorter contexts are tried where an n-gram is unknown."""
        todo, total = np.sort(grams), 0.0
        for k in range(ORDER, 0, -1):
            keys = self.grams[k - 1]
            at = np.minimum(np.searchsorted(keys, todo), len(keys) - 1)
            known = keys[at] == todo
            total += self.logs[k - 1][at[known]].sum()
            todo = todo[~known]
            if not len(todo):
                return total
            if k > 1:
                contexts, below = todo >> BITS, self.grams[k - 2]
                at = np.minimum(np.searchsorted(below, contexts), len(below) - 1)
                hit = below[at] == contexts
                total += np.nan_to_num(self.gammas[k - 2][at[hit]]).sum()
                todo = np.sort(todo & (1 << BITS * (k - 1)) - 1)
        return total + len(todo) * self.unseen


def to_arrays(model: dict[int, DataFrame]) -> dict[str, Arrays]:
    """The model as sorted arrays on the driver; it comes as Arrow columns, never as rows."""
    parts: dict[str, list] = {}
    for k in sorted(model):
        table = model[k].sort("lang", "gram").toArrow()
        langs = table["lang"].combine_chunks().dictionary_encode()
        columns = [table[c].to_numpy() for c in ("gram", "p", "gamma")]
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            at = np.flatnonzero(langs.indices.to_numpy() == i)
            gram, p, gamma = (c[at[0] : at[-1] + 1].copy() for c in columns)
            parts.setdefault(lang, []).append((gram.astype(np.int64), np.log(p.astype(float)), np.log(gamma.astype(float))))
        del table, columns
    return {lang: Arrays(*map(list, zip(*x)), unseen=-math.log(len(x[0][0]) + 1)) for lang, x in parts.items()}


def log_perplexities(docs: DataFrame, model: dict[int, DataFrame], max_entries: int) -> DataFrame:
    """The rows of `docs` (doc_id, lang, text), counted: doc_id, lang, the five counts, log_ppl (null without words)."""
    return _scored(docs, model, max_entries)[0]


def _scored(docs: DataFrame, model: dict[int, DataFrame], max_entries: int) -> tuple[DataFrame, Broadcast | None]:
    """The same, and the model where it was broadcast, to be given back when the rows are written."""
    spark = docs.sparkSession
    schema = f"doc_id long, lang string, {COUNTS}, log_ppl double"
    fits = sum(model[k].count() for k in model) <= max_entries
    shared = spark.sparkContext.broadcast(to_arrays(model)) if fits else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = shared.value
        types = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.float64()]
        for batch in batches:
            rows = []
            for doc_id, lang, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = value.as_py()  # one text at a time
                counts = counts_of(text)
                rows.append((doc_id, lang, *counts, -arrays[lang].log_sum(char_grams(text)) / counts[0] if counts[0] else None))
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in schema.split(", ")])

    if fits:
        return docs.select("doc_id", "lang", "text").mapInArrow(frugal(score), schema), shared

    def parts(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, at = TaskContext.get().partitionId() << 33, 0
        for f in frames:
            for doc_id, lang, text in zip(f["doc_id"].astype(object), f["lang"], f["text"]):
                grams, n = np.unique(char_grams(text), return_counts=True)
                yield _typed([(doc_id, lang, *counts_of(text), None)]).assign(row=base + at, gram=None, times=1)
                if len(grams):
                    yield _typed([(None, lang, *[None] * 5, None)] * len(grams)).assign(row=base + at, gram=grams, times=n)
                at += 1

    rows = materialize(docs.mapInPandas(parts, f"{schema}, row long, gram long, times long"), "document-grams")
    logs = rows.where("gram is not null").join(model[ORDER].select("lang", "gram", F.log("p").alias("l")), ["lang", "gram"]).groupBy("row").agg(F.sum(F.col("l") * F.col("times")).alias("total"))
    whole = rows.where("gram is null").drop("log_ppl", "gram").join(logs, "row", "left")
    return whole.withColumn("log_ppl", -F.col("total") / F.col("n_words")).drop("row", "times", "total"), None


def _typed(rows: list[tuple]) -> pd.DataFrame:
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl"]
    return settled(pd.DataFrame(rows, columns=names)).astype({"doc_id": "Int64", "log_ppl": float} | {c: "Int64" for c in names[2:7]})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fence: float = 5.0, least_width: float = 0.5, max_entries: int = 5_000_000) -> DataFrame:
    """Rows doc_id, lang, the five counts, log_ppl, base_failed, kept for every row.

    kept is false if the counts fail; else it says whether log_ppl lies in its language's band, from all rows of
    that language that pass the counts. Upper bound: the upper quartile and `fence` times the quartiles' distance.
    Lower bound: the median less `fence` times s / sqrt(n_words), where s is the upper quartile of
    (median - log_ppl) * sqrt(n_words). Either margin is `least_width` at least. Null texts count as empty, null languages as one language "". Repeated
    rows and null ids are judged as they come; an empty table gives no rows; extra columns are ignored.
    """
    prepare_workers(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, shared = _scored(named, fit(named), max_entries)
    scored = materialize(rows.withColumn("base_failed", base_failed()), "scored")
    if shared is not None:
        shared.destroy()
    passed = scored.where("not base_failed")
    bands = materialize(passed.groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10_000).alias("q")), "bands")
    small = bands.count() <= MAX_LANGUAGES
    below = (F.col("q")[1] - F.col("log_ppl")) * F.sqrt("n_words")
    spreads = passed.join(F.broadcast(bands) if small else bands, "lang").groupBy("lang").agg(F.percentile_approx(below, 0.75, 10_000).alias("s"))
    margin = F.greatest(F.lit(fence) * (F.col("q")[2] - F.col("q")[0]), F.lit(least_width))
    bounds = materialize((F.broadcast(bands) if small else bands).join(spreads, "lang", "right").select("lang", F.col("q")[1].alias("mid"), "s", (F.col("q")[2] + margin).alias("upper")), "bounds")
    lower = F.col("mid") - F.greatest(F.lit(fence) * F.col("s") / F.sqrt(F.greatest("n_words", F.lit(1))), F.lit(least_width))
    judged = scored.join(F.broadcast(bounds) if small else bounds, "lang", "left").withColumn("lower", lower)
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "lang", "log_ppl", "lower", "upper")
