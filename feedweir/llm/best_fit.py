"""Best-fit-decreasing packing of token sequences into fixed windows.

The lengths are small integers, so the packing of any corpus is decided on their histogram (at most
`capacity` rows on the driver): bins with equal contents are one class, and a segment tree over the
remaining capacities finds the tightest open class in logarithmic time. Pieces of a length are
interchangeable, so each then computes its bin and offset from its rank among the pieces of its length.
The result is exactly that of best-fit decreasing over all pieces, whatever the number of partitions.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweir.llm.common import frugal, materialize, prepare_workers

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, rank long"


class CapacityTree:
    """Counts of open bin classes by remaining capacity; finds the least capacity of at least `need`."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, by: int) -> None:
        at = self.leaves + remaining
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        at = self.leaves + need
        if self.count[at]:
            return need
        while at > 1 and not (at % 2 == 0 and self.count[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first bin, pieces a bin, offset) of best-fit decreasing.

    The piece of rank r in a run goes to bin `first bin + (r - first rank) // pieces a bin`.
    """
    tree, classes, runs, bins = CapacityTree(capacity), defaultdict(deque), [], 0

    def put(remaining: int, first: int, number: int) -> None:
        if number and remaining:
            classes[remaining].append((first, number))
            tree.add(remaining, 1)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, number = capacity, bins, -(-left // (capacity // length))
                bins += number
            else:
                first, number = classes[room].popleft()
                tree.add(room, -1)
            each = room // length
            taken = min(left, number * each)
            full, rest = divmod(taken, each)
            offset = capacity - room
            if full:
                runs.append((length, rank, rank + full * each, first, each, offset))
                put(room - each * length, first, full)
            if rest:
                runs.append((length, rank + full * each, rank + taken, first + full, rest, offset))
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), number - full - bool(rest))
            left, rank = left - taken, rank + taken
    return runs


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def load_encoder(path: str):
    """A function text -> ids, equal to that of the tokenizer file.

    A byte-level BPE whose ids follow the order of its merges gives the same ids in the faster tiktoken
    library; texts that hold an added token, and files of another kind, go to the tokenizers library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec.get("added_tokens", [])]

    def plain(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    vocab = {t: i for t, i in model.get("vocab", {}).items() if t not in added}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    ids = [vocab.get(m, -1) for m in merges]
    if not (
        model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not spec.get("normalizer") and not model.get("ignore_merges") and ids == sorted(ids) and set(ids) | {vocab.get(c) for c in _byte_of_char()} == set(vocab.values())
    ):
        return plain
    alphabet = _byte_of_char()
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return plain(text)
        return fast.encode_ordinary(text)

    return encode


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces: all but the first are full."""
    first = (len(ids) - 1) % capacity + 1
    return [(0, ids[:first])] + [(at, ids[at : at + capacity]) for at in range(first, len(ids), capacity)]


def _pieces(tokenizer: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, chunk, seen = load_encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            kept: list[np.ndarray] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for piece, (start, part) in enumerate(cut(ids, capacity)):
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), chunk, seen[len(part)]))
                    seen[len(part)] += 1
                    if keep_ids:
                        kept.append(part.astype("<i4"))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 1024, keep_ids: bool = False, max_broadcast_runs: int = 200_000
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept).

    A null or empty text is its end id alone. Repeated rows and ids are packed as they come; null ids stay
    null. An empty table gives no rows. Other columns are ignored. Sequence ids are 0 to the number of bins
    less one; which of several pieces of one length takes which place depends on the partitioning, the
    number of bins and their fill do not.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    pieces = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(_pieces(tokenizer, end_id, capacity, keep_ids)), schema), "pieces")

    by_chunk = materialize(pieces.groupBy("length", "chunk").agg(F.count("*").alias("n")), "lengths")
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = by_chunk.select("length", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows

    runs = pack_histogram(counts, capacity)
    placed = spark.createDataFrame(runs, "length long, first long, end long, bin long, each long, at long")
    if len(runs) <= max_broadcast_runs:
        placed = F.broadcast(placed)
    within = F.col("global_rank") - F.col("first")
    numbered = pieces.join(base, ["length", "chunk"]).withColumn("global_rank", F.col("rank") + F.col("base"))
    joined = numbered.join(placed, (numbered["length"] == placed["length"]) & (F.col("global_rank") >= F.col("first")) & (F.col("global_rank") < F.col("end"))).drop(placed["length"])
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(within / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (within % F.col("each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids, doc_ids, lengths) from pieces that kept their ids; a row holds `capacity` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
