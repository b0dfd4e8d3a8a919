"""Language identification by Bayesian fusion of evidence.

For each record and language the log posterior sums: the likelihood of the text under hashed character
trigrams, counted by Spark over all labelled documents and tempered to a bounded number of trigrams; the
likelihood of the language that the markup declares; that of the address suffix (the last label of the host);
and the prior of the host, smoothed towards its parent domain and that towards the whole corpus. All but the
text model come from grouped counts of the text's own verdicts. An extra class "und" spreads its trigrams
evenly, so text like none of the languages is undetermined.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir.llm.common import ascii_lower, frugal, materialize, salted_lookup, prepare_workers

BUCKETS = 1 << 15
UND = "und"
#: At most so many trigrams' worth of text evidence counts.
TEMPER = 60


def trigram_buckets(text: str) -> np.ndarray:
    """Hashed trigrams of letters in lower case; each run of other characters counts as one blank."""
    codes = np.frombuffer(" ".join(re.findall(r"[^\W\d_]+", text.lower())).encode("utf-32-le"), np.uint32)
    if not len(codes):
        return np.empty(0, np.int64)
    padded = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    h = padded[:-2] * np.uint64(0x9E3779B1) + padded[1:-1] * np.uint64(0x85EBCA77) + padded[2:] * np.uint64(0xC2B2AE3D)
    h ^= h >> np.uint64(15)
    return (h * np.uint64(0x27D4EB2F) >> np.uint64(13) & np.uint64(BUCKETS - 1)).astype(np.int64)


def train(labelled: DataFrame, *, max_languages: int = 1000) -> tuple[list[str], np.ndarray]:
    """Languages and log P(bucket | language) of rows (lang, text); the last row is "und".

    Null or empty languages and texts teach nothing. All languages are trained; their table takes 128 KB each on the driver and
    in each worker, so labels of more than `max_languages` kinds are an error, not cut short. Texts count whole,
    repeated rows as often as they come."""
    prepare_workers(labelled.sparkSession)

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                if lang not in seen:
                    seen[lang] = np.zeros(BUCKETS, np.int64)
                seen[lang] += np.bincount(trigram_buckets(text), minlength=BUCKETS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": pd.Series([lang] * len(at), dtype=object), "bucket": at, "n": n[at]})

    clean = labelled.select("lang", "text").where("lang <> '' and text <> ''")
    counted = materialize(clean.mapInPandas(frugal(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages, if the labels are languages")
    table = np.full((len(languages) + 1, BUCKETS), 0.1)
    rows = counted.toArrow()  # BUCKETS rows a language at most
    place = np.searchsorted(np.array(languages, dtype=object), np.array(rows["lang"].to_pylist(), dtype=object)) if languages else []
    np.add.at(table, (place, rows["bucket"].to_numpy()), rows["n"].to_numpy())
    table[-1] = 1.0
    return [*languages, UND], np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _argmax(values: Column, names: Column) -> Column:
    return F.get(names, (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def identify(
    records: DataFrame, languages: list[str], table: np.ndarray, *, keep: list[str] | None = None, least_confidence: float = 0.5, strength: float = 20.0, und_prior: float = 1e-4
) -> DataFrame:
    """The key columns of `records`, and lang, confidence, text_lang, kept.

    `records` has text, markup (declared language or null), host (or null) and any key columns besides; a key named like a
    result comes back with `_key` behind its name. A language code counts by its first part in lower case. Without any trained
    language all is "und". A record without letters has only the other evidence and is "und" if that is absent as well. kept: the
    language is one of `keep` (default: all trained) with at least `least_confidence`. Of equally likely languages the first by
    name wins. Texts are read whole. Nulls are missing evidence; repeated rows are judged alike; an empty table gives no rows.
    """
    prepare_workers(records.sparkSession)
    given = [c for c in records.columns if c not in ("text", "markup", "host")]
    keys = [f"_key{i}" for i in range(len(given))]  # whatever they are called, they clash with nothing in here
    records = records.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(given, keys)], "text", "markup", "host")
    results = ("lang", "confidence", "text_lang", "kept")
    named_again = lambda out: out.select(*[F.col(k).alias(f"{c}_key" if c.lower() in results else c) for c, k in zip(given, keys)], *results)
    if len(languages) == 1:  # nothing was learnt
        return named_again(records.select(*keys, F.lit(UND).alias("lang"), F.lit(1.0).alias("confidence"), F.lit(UND).alias("text_lang"), F.lit(False).alias("kept")))
    real, size = languages[:-1], len(languages)
    shared = records.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))
    types = ", ".join(f"`{c}` {t}" for c, t in records.dtypes if c in keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, others = shared.value, [*keys, "markup", "host"]
        for batch in batches:
            text = []
            for t in batch.column("text"):  # one text at a time
                buckets = trigram_buckets(t.as_py())
                n = len(buckets)
                total = logs[buckets].sum(axis=0, dtype=np.float64) * (min(n, TEMPER) / n) if n else np.zeros(size)
                text.append((total - total.max()).tolist())
            made = [pa.array(text, pa.list_(pa.float64())), pa.array([any(x) for x in text], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *made], [*others, "logs", "has_text"])

    named = records.select(*keys, F.coalesce("text", F.lit("")).alias("text"), F.substring_index(F.substring_index(ascii_lower(F.coalesce("markup", F.lit(""))), "-", 1), "_", 1).alias("markup"), F.coalesce("host", F.lit("")).alias("host"))
    scored = materialize(named.mapInArrow(frugal(read), f"{types}{', ' if types else ''}markup string, host string, logs array<double>, has_text boolean"), "text-evidence")
    shared.destroy()
    names = F.array(*map(F.lit, languages))
    heard = scored.withColumn("text_lang", F.when(F.col("has_text"), _argmax(F.col("logs"), names)).otherwise(F.lit(UND)))

    # counts of the text's verdicts by host, parent domain and suffix
    votes = [F.sum(F.when(F.col("text_lang") == x, 1.0).otherwise(0.0)).alias(f"c{i}") for i, x in enumerate(real)]
    host = heard.groupBy("host").agg(*votes)
    vector = lambda: F.array(*[F.col(f"c{i}") for i in range(size - 1)])
    summed = lambda: [F.sum(f"c{i}").alias(f"c{i}") for i in range(size - 1)]
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    has_dot = F.col("host").contains(".")
    host = materialize(host.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.when(has_dot, F.substring_index("host", ".", -1)).otherwise(F.lit(""))}), "hosts")
    row = host.agg(*summed()).first()
    overall = np.array([row[i] or 0.0 for i in range(size - 1)])
    overall = (overall + 1) / (overall.sum() + size - 1)
    smooth = lambda v, towards: F.zip_with(v, towards, lambda c, p: c + F.lit(strength) * p)
    share = lambda v: F.transform(v, lambda x: x / (total(v) + F.lit(0.0)))
    flat = F.array(*[F.lit(float(p)) for p in overall])
    domain = host.groupBy("domain").agg(*summed()).select("domain", share(smooth(vector(), flat)).alias("domain_share"))
    # of the languages, how their records spread over suffixes, relative to the whole corpus
    suffix = host.groupBy("suffix").agg(*summed())
    lang_sums = np.array([row[i] or 0.0 for i in range(size - 1)]) + 1.0
    whole = float(lang_sums.sum())
    ratio = F.array(*[F.log((F.col(f"c{i}") + F.lit(1.0) * (total(vector()) + 1) / whole) / F.lit(float(lang_sums[i])) * whole / (total(vector()) + 1)) for i in range(size - 1)])
    suffix = suffix.select("suffix", F.when(F.col("suffix") == "", F.array(*[F.lit(0.0)] * (size - 1))).otherwise(ratio).alias("suffix_logs"))
    prior = host.join(domain, "domain").join(suffix, "suffix").select("host", F.zip_with(F.transform(share(smooth(vector(), F.col("domain_share"))), lambda p: F.log(p)), F.col("suffix_logs"), lambda a, b: a + b).alias("host_logs"))

    # how often each language's records declare each language, in one small table
    known = F.when(F.col("markup").isin(*real), F.col("markup")).otherwise(F.lit(UND))
    declared = {(r["m"], r["text_lang"]): r["n"] for r in heard.where("markup <> ''").groupBy(known.alias("m"), "text_lang").agg(F.count("*").alias("n")).collect()}
    says = {m: [] for m in languages}
    for m in languages:
        for x in real:
            spoken = sum(declared.get((k, x), 0) for k in languages)
            says[m].append(float(np.log((declared.get((m, x), 0) + (5.0 if m == x else 0.1)) / (spoken + 5.0 + 0.1 * (size - 1)))))
    zeros = F.array(*[F.lit(0.0)] * (size - 1))
    markup_logs = zeros
    for m in languages:
        markup_logs = F.when((F.col("markup") != "") & (known == m), F.array(*map(F.lit, says[m]))).otherwise(markup_logs)

    joined = salted_lookup(heard, prior, ["host"])
    fused = F.zip_with(F.zip_with(F.slice("logs", 1, size - 1), F.coalesce("host_logs", zeros), lambda a, b: a + b), markup_logs, lambda a, b: a + b)
    none = F.lit(float(np.log(und_prior))) + F.when(F.col("has_text"), F.element_at("logs", -1)).when(F.col("markup") != "", F.lit(-5.0)).otherwise(F.lit(20.0))
    both = joined.withColumn("post", F.concat(fused, F.array(none)))
    top = F.array_max("post")
    confidence = 1 / F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    lang = _argmax(F.col("post"), names)
    out = both.select(*keys, lang.alias("lang"), confidence.alias("confidence"), "text_lang")
    return named_again(out.withColumn("kept", F.col("lang").isin(*(keep or real)) & (F.col("confidence") >= least_confidence)))


def page_records(pages: DataFrame, host: Column) -> DataFrame:
    """page_id, text, markup, host of raw pages: tags, scripts and styles blanked out, the language of <html lang>."""
    page = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&#?\w+;", " ")
    return pages.select("page_id", bare.alias("text"), F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1).alias("markup"), host.alias("host"))
