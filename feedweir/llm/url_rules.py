"""Allow and block rules for addresses, joined by a sorted sweep.

The canonical key of an address is its host with reversed labels, each followed by a dot, then a space
and the path. All hosts under `example.com` have keys in the interval from `com.example.` up to
`com.example/` ("/" follows "." in code order), and such intervals nest or are disjoint. Keys are dealt
to ranges; each rule goes to the ranges that its interval meets; a sweep over a sorted range keeps the
stack of the rules whose intervals are open and judges each address by the longest of them whose path fits.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir.llm.common import ascii_lower, settled, prepare_workers

#: Keys that are sampled to find the bounds of the ranges; they only balance the work.
MAX_SAMPLE = 20_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_interval(host: str) -> tuple[str, str]:
    """The keys of a host and all its subdomains: from the first string up to, but without, the second."""
    prefix = ".".join(reversed(host.split("."))) + "."
    return prefix, prefix[:-1] + "/"


class _Host:
    """The rules of one host whose interval is open, by path; an address looks up as many paths as there are lengths of them."""

    def __init__(self, end: str):
        self.end, self.rules, self.lengths = end, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        rank = (len(rule), verdict == "block", rule, verdict)
        self.rules[path] = max(self.rules.get(path, rank), rank)
        self.lengths = sorted({len(p) for p in self.rules}, reverse=True)

    def best(self, path: str) -> tuple | None:
        return next((self.rules[path[:n]] for n in self.lengths if n <= len(path) and path[:n] in self.rules), None)


def _sweep(default: str):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[_Host] = []
        part = None
        for frame in frames:
            rules, verdicts = [], []
            addresses = frame["is_rule"].to_numpy() == 0
            for p, key, is_rule, path, end, rule, verdict in zip(frame["part"], frame["key"], frame["is_rule"], frame["path"], frame["end"], frame["rule"], frame["verdict"]):
                if p != part:
                    part, stack = p, []
                while stack and stack[-1].end.encode() <= key.encode():
                    stack.pop()
                if is_rule:
                    if not stack or stack[-1].end != end:
                        stack.append(_Host(end))
                    stack[-1].add(path, rule, verdict)
                    continue
                best = max(filter(None, (h.best(path) for h in stack)), default=None)
                rules.append(best[2] if best else None)
                verdicts.append(best[3] if best else default)
            yield settled(frame.loc[addresses, ["page_id", "host", "path"]].assign(rule=pd.Series(rules, dtype=object).to_numpy(), verdict=verdicts))

    return run


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", rows_per_range: int = 200_000, min_ranges: int = 12
) -> DataFrame:
    """Rows page_id, host, path, rule, verdict for every row of `pages`.

    `rules` are (host, path, verdict) with a non-empty lower-case host. The longest fitting rule wins; of
    equally long ones a block wins, then the greater text. A null or malformed address has empty host and
    path, fits no rule and gets `default`. Repeated rows and ids are each judged; an empty table gives none.
    Extra columns are ignored. A hot host is spread over ranges by its paths, and one address that repeats (null and
    malformed ones are alike) by a hash of the ids, which follows the key where ranges are cut. Very long addresses are kept whole.
    """
    prepare_workers(pages.sparkSession)
    for host, _, verdict in rules:
        if not host or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {host!r}, {verdict!r}")
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    keyed = named.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")).withColumn("key", F.concat(host_key(F.col("host")), F.lit(" "), F.col("path")))

    keyed = keyed.withColumn("cut", F.concat("key", F.lit("\x01"), F.lpad(F.hex(F.pmod(F.xxhash64("page_id"), F.lit(65_536))), 4, "0")))
    total = keyed.count()
    one_in = max(1, math.ceil(total / MAX_SAMPLE))
    sample = sorted((r["cut"] for r in keyed.where(F.pmod(F.xxhash64("key", "page_id"), F.lit(one_in)) == 0).select("cut").limit(4 * MAX_SAMPLE).collect()), key=str.encode)
    ranges = max(min_ranges, math.ceil(total / rows_per_range))
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}, key=str.encode) if sample else []
    encoded = [b.encode() for b in bounds]

    rows = []
    for host, path, verdict in sorted(set(rules)):
        start, end = rule_interval(host)
        for part in range(bisect_right(encoded, start.encode()), bisect_left(encoded, end.encode()) + 1):
            rows.append((part, start, 1, path, end, host + path, verdict))
    spark = pages.sparkSession
    as_rows = spark.createDataFrame(rows, "part int, key string, is_rule int, path string, end string, rule string, verdict string")

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(encoded, k.encode())).astype("int32")

    both = keyed.withColumns({"part": part_of("cut"), "is_rule": F.lit(0)}).drop("cut").unionByName(as_rows, allowMissingColumns=True)
    swept = both.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "key", F.desc("is_rule"), F.desc("end"))
    return swept.mapInPandas(_sweep(default), "page_id long, host string, path string, rule string, verdict string")
