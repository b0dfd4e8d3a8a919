"""Exact Jaccard self-join of documents on their 5-word shingles, as connected components.

Only documents with nearly all their shingles in other documents can have a partner, so three steps go
from cheap to dear:

1. Each document keeps the smallest hashes of its set, so many that a partner must share a known number of
   them; sets with fewer shared hashes are out. Copies of a set are one class from here on.
2. Of the remaining sets, those with fewer shingles in other sets than a partner would need are out.
3. The size-aware join proper, on sets whose shingles are ordered from rare to common. Sets up to a
   boundary size (light) enumerate all pairs of the shingles that lead their order; larger ones (heavy)
   scan the inverted lists of the single leading shingles, together with the light sets of comparable size.
   The boundary is where a histogram of both costs has its minimum.

Members of a list are first compared with two hubs of it, for as many rounds as that closes a good part of the lists;
a list that one component holds as a whole needs no comparison, so a group of near copies costs what its members
cost, not its pairs. The size-aware join takes the lists that are still open, so that no link is lost. In a list, the
smaller set of a linked pair has it among its first ninth, so texts around a common passage are no
candidates just because each has it further back. Pairs that lonely elements or parity bits prove too different are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir.llm.common import few, frugal, materialize, salted_lookup, prepare_workers
from feedweir.llm.components import connected_components

#: Odd multipliers that mix the word hashes of a window (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
#: Nodes of classes without an id lie from here on.
NO_ID = 1 << 62
SEVERAL = 0
#: Members beyond which a list is hot, and so many tasks that share it.
HOT, SALTS = 2000, 16


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs without ASCII white space."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows; fewer words than a window are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    rows = len(words) - span + 1
    mixed = np.full(rows, span, np.uint64)
    for k in range(span):
        mixed ^= mixed >> np.uint64(31)
        mixed = (mixed + each[k : k + rows]) * np.uint64(MIX[k % len(MIX)])
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(MIX[1])
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs; the second is never the mark SEVERAL."""
    whole = xxhash.xxh3_128_intdigest(hashes.tobytes())
    low = whole & (2**64 - 1) or 1
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    return signed(whole >> 64), signed(low)


def leading(n: int) -> tuple[int, int]:
    """How many of the smallest hashes a set of n shows, and how many of them a partner must share.

    A partner shares at least 0.8 n, so it lacks n // 5 at most; both show the same first shared ones.
    """
    depth = max(1, n // 5)
    return n // 5 + depth, depth


def _scan(buckets: int, block: int, width: int):
    """Rows of two kinds: a document (bucket null), and a block's shown hashes of a bucket of hash space.

    Hashes that several sets of the block show are counted there and leave it once, marked SEVERAL.
    """
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None

    def flush(sets: dict) -> Iterator[dict]:
        if not sets:
            return
        keys = np.array(list(sets), np.int64)
        sizes = np.array([len(s) for s in sets.values()])
        shown, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(shown)
        shown, owner = shown[order], owner[order]
        first = np.concatenate([[True], shown[1:] != shown[:-1]])
        alone = first & np.concatenate([first[1:], [True]])
        local = np.bincount(owner[~alone], minlength=len(sets))
        yield {"low": keys, "local": local}
        hashes = shown[first]
        owners = np.where(alone[first], owner[first], -1)
        where = (hashes >> shift).astype(np.int64) if shift is not None else np.zeros(len(hashes), np.int64)
        by_owner = np.lexsort((owners, where))
        hashes, owners, where = hashes[by_owner], owners[by_owner], where[by_owner]
        edges = np.flatnonzero(np.diff(where)) + 1
        for a, b in zip([0, *edges], [*edges, len(where)]):
            changes = np.flatnonzero(np.diff(owners[a:b])) + 1
            starts = np.concatenate([[0], changes])
            who = owners[a:b][starts]
            yield {"bucket": int(where[a]), "hashes": hashes[a:b].tobytes(), "owners": np.where(who < 0, SEVERAL, keys[who]).tobytes(), "runs": np.diff(np.append(starts, b - a)).astype("<u4").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            docs = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(words_of(text.as_py()), width)
                if not len(s):
                    docs.append((doc_id, 0, None, None))
                    continue
                high, low = signature(s)
                docs.append((doc_id, len(s), high, low))
                if low not in sets and len(s) > 3:
                    sets[low] = s[: leading(len(s))[0]]
                    held += len(sets[low])
            yield _rows(docs=docs)
            if held >= block:
                yield from (_rows(**x) for x in flush(sets))
                sets, held = {}, 0
        yield from (_rows(**x) for x in flush(sets))

    return run


SCAN = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary()), ("runs", pa.binary())])
SCAN_DDL = "kind byte, doc_id long, n long, high long, low long, bucket int, hashes binary, owners binary, runs binary"


def _rows(docs=None, low=None, local=None, bucket=None, hashes=None, owners=None, runs=None) -> pa.RecordBatch:
    if docs is not None:
        ids, n, high, lows = zip(*docs) if docs else ((), (), (), ())
        made = {"kind": [0] * len(docs), "doc_id": ids, "n": n, "high": high, "low": lows}
    elif low is not None:
        made = {"kind": [1] * len(low), "n": local, "low": low}
    else:
        made = {"kind": [2], "bucket": [bucket], "hashes": [hashes], "owners": [owners], "runs": [runs]}
    size = len(made["kind"])
    return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else pa.nulls(size, f.type) for f in SCAN], schema=SCAN)


def _unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, owner) of one bucket, sorted; SEVERAL may stand there more than once."""
    parts = [(np.frombuffer(h.as_py(), np.uint64), np.repeat(np.frombuffer(o.as_py(), np.int64), np.frombuffer(r.as_py(), "<u4"))) for h, o, r in zip(group["hashes"], group["owners"], group["runs"])]
    hashes, owners = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])]) | (owners == SEVERAL)  # a set's copies in other blocks go
    return hashes[new], owners[new]


def _dealt(owners: np.ndarray, parts: int) -> np.ndarray:
    return (owners.view(np.uint64) * np.uint64(MIX[0]) >> np.uint64(40)).astype(np.int64) % parts


def _count_shared(parts: int):
    """Of one bucket: how many hashes of each set some other set shows as well, packed by a hash of the set."""

    def run(group: pa.Table) -> pa.Table:
        hashes, owners = _unpacked(group)
        first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        alone = first & np.concatenate([first[1:], [True]])
        low, n = np.unique(owners[~alone & (owners != SEVERAL)], return_counts=True)
        to = _dealt(low, parts)
        rows = [(int(p), low[to == p].tobytes(), n[to == p].astype("<i4").tobytes()) for p in np.unique(to)]
        columns = list(zip(*rows)) or [()] * 3
        return pa.table({"part": pa.array(columns[0], pa.int32()), "lows": pa.array(columns[1], pa.binary()), "counts": pa.array(columns[2], pa.binary())})

    return run


def _sum_shared(group: pa.Table) -> pa.Table:
    low = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group["lows"]])
    n = np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in group["counts"]])
    each, at = np.unique(low, return_inverse=True)
    return pa.table({"low": pa.array(each, pa.int64()), "n": pa.array(np.bincount(at, n).astype(np.int64))})


def parity_bits(hashes: np.ndarray) -> tuple[int, ...]:
    """256 bits, each the parity of the hashes that fall on it: the bits that differ between two sets are at most as
    many as the elements that do."""
    odd = (np.bincount((hashes >> np.uint64(9) & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)
    return tuple(int(x) for x in np.packbits(odd).view(np.int64))


def _post(buckets: int, block: int, width: int):
    """Whole sets, posted: a row per set with its size and parity bits, and packed hashes by bucket of hash space."""
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None
    empty = lambda n: {"high": [None] * n, "low": [None] * n, "bits": [None] * n}

    def flush(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, sizes = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()])
        hashes, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets)), sizes)
        where = (hashes >> shift).astype(np.int64) if shift is not None else np.zeros(len(hashes), np.int64)
        order = np.lexsort((owner, where))
        hashes, owner, where = hashes[order], owner[order], where[order]
        edges = np.flatnonzero(np.diff(where)) + 1
        for a, b in zip([0, *edges], [*edges, len(where)]):
            starts = np.concatenate([[0], np.flatnonzero(np.diff(owner[a:b])) + 1])
            yield row(empty(1) | {"bucket": [int(where[a])], "hashes": [hashes[a:b].tobytes()], "owners": [keys[owner[a:b][starts]].tobytes()], "runs": [np.diff(np.append(starts, b - a)).astype("<u4").tobytes()]})

    def row(made: dict) -> pa.RecordBatch:
        size = len(made["low"])
        return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else pa.nulls(size, f.type) for f in POST], schema=POST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            made: dict = {"high": [], "low": [], "bits": []}
            for text in batch.column(0):
                s = shingles(words_of(text.as_py()), width)
                if len(s) <= 3:
                    continue
                high, low = signature(s)
                if low not in sets:
                    made["high"].append(high)
                    made["low"].append(low)
                    made["bits"].append(parity_bits(s))
                    sets[low] = s
                    held += len(s)
            yield row(made)
            if held >= block:
                yield from flush(sets)
                sets, held = {}, 0
        if sets:
            yield from flush(sets)

    return run


POST = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("bits", pa.list_(pa.int64())), ("bucket", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary()), ("runs", pa.binary())])
POST_DDL = "high long, low long, bits array<long>, bucket int, hashes binary, owners binary, runs binary"


def _frequencies(parts: int):
    """Of one bucket: the hashes that two sets or more have, with the number of sets, packed by a hash of the owner."""

    def run(group: pa.Table) -> pa.Table:
        hashes, owners = _unpacked(group)
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        sets = np.repeat(np.diff(np.append(first, len(hashes))), np.diff(np.append(first, len(hashes))))
        hashes, owners, sets = hashes[sets > 1], owners[sets > 1], sets[sets > 1]
        to = _dealt(owners, parts)
        order = np.lexsort((owners, to))
        hashes, owners, sets, to = hashes[order], owners[order], sets[order], to[order]
        edges = np.flatnonzero(np.diff(to)) + 1
        rows = []
        for a, b in zip([0, *edges], [*edges, len(to)]) if len(to) else ():
            starts = np.concatenate([[0], np.flatnonzero(np.diff(owners[a:b])) + 1])
            rows.append((int(to[a]), owners[a:b][starts].tobytes(), np.diff(np.append(starts, b - a)).astype("<u4").tobytes(), hashes[a:b].tobytes(), sets[a:b].astype("<u4").tobytes()))
        columns = list(zip(*rows)) or [()] * 5
        names = ["part", "owners", "runs", "hashes", "sets"]
        return pa.table([pa.array(c, pa.int32() if n == "part" else pa.binary()) for c, n in zip(columns, names)], names)

    return run


def _rank(group: pa.Table) -> pa.Table:
    """Of some sets: their shared hashes from rare to common, and the frequencies of the leading ones."""
    parts = [(np.repeat(np.frombuffer(o.as_py(), np.int64), np.frombuffer(r.as_py(), "<u4")), np.frombuffer(h.as_py(), np.int64), np.frombuffer(s.as_py(), "<u4")) for o, r, h, s in zip(group["owners"], group["runs"], group["hashes"], group["sets"])]
    owners, hashes, sets = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((hashes, sets, owners))
    owners, hashes, sets = owners[order], hashes[order], sets[order]
    starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
    offsets = pa.array(np.append(starts, len(owners)).astype(np.int32))
    ends = np.append(starts[1:], len(owners))
    lead = [sets[a : min(b, a + (b - a) // 3 + 2)].astype(np.int32) for a, b in zip(starts, ends)]
    return pa.table([pa.array(owners[starts], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(hashes)), pa.array(lead, pa.list_(pa.int32()))], ["low", "ranked", "sets"])


def _live_classes(docs: DataFrame, block: int, width: int) -> tuple[DataFrame, DataFrame, int]:
    """All documents (doc_id, n, high, low), the classes that step 1 leaves (high, low, n, node, sample_id), and a number of
    buckets for their hashes."""
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(4, (int(text_bytes / 15) // 1_000_000).bit_length())
    scan = materialize(docs.select("doc_id", "text").mapInArrow(frugal(_scan(buckets, block, width)), SCAN_DDL), "scan")
    documents = scan.where("kind = 0").select("doc_id", "n", "high", "low")
    within = scan.where("kind = 1").groupBy("low").agg(F.max("n").alias("n"))
    across = scan.where("kind = 2").select("bucket", "hashes", "owners", "runs").groupBy("bucket").applyInArrow(_count_shared(buckets), "part int, lows binary, counts binary")
    summed = across.groupBy("part").applyInArrow(_sum_shared, "low long, n long")
    shared = within.unionByName(summed).groupBy("low").agg(F.sum("n").alias("shared"))
    node = F.coalesce("sample_id", F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("high", "low"), 3))
    classes = documents.where("n > 3").groupBy("high", "low").agg(F.min("doc_id").alias("sample_id"), F.max("n").alias("n"))
    live = classes.join(shared, "low").where(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    return documents, materialize(live.select("high", "low", "n", "sample_id", node.alias("node")), "classes"), buckets


def _ordered_sets(docs: DataFrame, live: DataFrame, buckets: int, block: int, width: int, max_broadcast_ids: int) -> DataFrame:
    """node, n, bits, ranked, sets, lonely, spare: the shingles that other sets have as well, from rare to common; how many
    (lonely) are no one else's; and how many of the ranked ones a partner may lack. Only sets that can have a partner."""
    ids = few(live.select(F.col("sample_id").alias("_id")).distinct(), max_broadcast_ids)
    wanted = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    posted = materialize(wanted.select("text").mapInArrow(frugal(_post(buckets, block, width)), POST_DDL), "posted")
    meta = posted.where("low is not null").select("high", "low", "bits").dropDuplicates(["high", "low"])
    packed = posted.where("bucket is not null").select("bucket", "hashes", "owners", "runs").groupBy("bucket").applyInArrow(_frequencies(buckets), "part int, owners binary, runs binary, hashes binary, sets binary")
    ranked = packed.groupBy("part").applyInArrow(_rank, "low long, ranked array<long>, sets array<int>")
    found = live.select("high", "low", "n", "node").join(meta, ["high", "low"]).join(ranked, "low")
    lonely = (F.col("n") - F.size("ranked")).cast("int")
    spare = F.floor(F.col("n") / 5).cast("int") - F.col("lonely")
    return materialize(found.select("node", "n", "bits", "ranked", "sets", lonely.alias("lonely")).withColumn("spare", spare).where("spare >= 0"), "ranked")


def _lists(ranked: DataFrame) -> DataFrame:
    """key, node, n, lonely, bits, at, most, later: the inverted lists of the leading shingles.

    `at` is the shingle's place in the set's order, in which the lonely ones come first. Linked sets share four ninths
    of both sizes together, all from the first shared shingle on; so if that is this one, a partner has
    `most` elements at most. An entry whose set is the smaller one of a pair has `most` >= n. `later` counts the
    shingles that can follow this one in a pair of them.
    """
    about = ("node", "n", "lonely", "bits")
    pairable = F.least(F.size("ranked"), F.col("spare") + 2).alias("pairable")
    rows = ranked.select(F.posexplode(F.slice("ranked", F.lit(1), F.col("spare") + 1)).alias("i", "key"), *about, pairable)
    at = F.col("lonely") + F.col("i")
    return rows.select("key", *about, at.alias("at"), _most(at).alias("most"), (F.col("pairable") - F.col("i") - 1).alias("later"))


def _most(at: Column) -> Column:
    return F.floor((F.col("n") - at) * 9 / 4) - F.col("n")


def _smaller() -> Column:
    """The set can be the smaller one of a pair that meets first at this entry."""
    return F.col("most") >= F.col("n")


def _labelled(entries: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        return entries.withColumn("component", F.col("node"))
    return entries.drop("component").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open(entries: DataFrame) -> DataFrame:
    """The lists that can still hide links: those with members of two components, one of which can be a pair's smaller set.

    Sets that share a passage, but have more than a ninth of their own before it, close their list here."""
    least = F.min(F.when(_smaller(), F.col("n")))
    several = entries.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), least.alias("least"), F.max("most").alias("reach"), F.count("*").alias("members"))
    lists = materialize(several.where("low <> high and least <= reach").select("key", "members"), "open-lists")
    hot = few(lists.where(F.col("members") > HOT).select("key", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(0)
    marked = entries.drop("salt").join(hot, "key", "left").withColumn("salt", salt).drop("hot")
    return marked.join(lists.select("key", _salts(F.col("members") > HOT)), ["key", "salt"], "left_semi")


def _salts(hot: Column) -> Column:
    """The salts of a list: all, if it is hot."""
    return F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")


def _hub_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """Candidates (a, b): members of each list against two of its smaller sets, the one with most in common with others, and any."""
    about = ("node", "n", "lonely", "bits", "at", "most", "component")
    any_one = F.xxhash64(F.lit(turn), "node").alias("h")
    central, other = F.min(F.struct("lonely", any_one, *(c for c in about if c != "lonely"))), F.min(F.struct(any_one, *about))
    hubs = entries.where(_smaller()).groupBy("key").agg(central.alias("c"), other.alias("o"))
    salted = entries.groupBy("key").agg(F.max("salt").alias("top")).select("key", _salts(F.col("top") > 0))
    hubs = hubs.join(salted, "key").select("key", "salt", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"{x}.{c}").alias(c) for c in about]) for x in "co"]))).alias("hub"))
    met = entries.join(hubs, ["key", "salt"]).where((F.col("component") != F.col("hub.component")) & _may_link("", "hub."))
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def choose_boundary(entries: DataFrame, comparison: float = 1 / 128) -> int:
    """The size up to which enumerating pairs of shingles costs less than scanning lists, of open lists alone.

    Costs are in rows made: light sets make a row for each pair of an open leading shingle and a later one; heavy ones a
    row for each open shingle, compared with the rest of its list at `comparison` of a row each (measured: 15.8 million comparisons
    take 0.9 s where 430 thousand rows made and shuffled take 3.1 s). Sizes are binned by eighths of a power of two, so
    the driver reads a few hundred rows at most.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    sized = entries.groupBy("key", step.alias("step")).agg(F.max("n").alias("n"), F.sum("later").alias("later"), F.count("*").alias("rows"), F.count_if(_smaller()).alias("small"))
    listed = sized.groupBy("key").agg(F.sum("rows").alias("listed"))
    heavy = F.col("rows") + comparison * F.col("small") * F.col("listed")
    rows = sorted(map(tuple, sized.join(listed, "key").groupBy("step").agg(F.max("n"), F.sum("later"), F.sum(heavy)).collect()))
    boundary, cost = 0, sum(h for *_, h in rows)
    best = cost
    for _, top, l, h in rows:
        cost += l - h
        if cost < best:
            best, boundary = cost, top
    return boundary


def _size_aware_pairs(entries: DataFrame, ranked: DataFrame, boundary: int) -> DataFrame:
    """Candidates (a, b) of open lists: all pairs that can be linked.

    Heavy sets, those above the boundary, meet whatever shares a leading shingle; two light ones share a pair of shingles,
    whose first is of an open list. Members are dealt by bands of a quarter in size, and the smaller set of a pair
    must be one that its place allows, so no list is joined with itself as a whole.
    """
    about = ("key", "node", "n", "lonely", "bits", "at", "most", "component")
    heavy = F.col("n") > boundary
    lists = entries.where(heavy | (F.col("n") >= 0.8 * boundary)).select(*about, heavy.alias("heavy"), F.lit(False).alias("pairs"))
    opened = entries.where(~heavy).join(ranked.select("node", F.slice("ranked", F.lit(1), F.col("spare") + 2).alias("f")), "node")
    i = F.col("at") - F.col("lonely")
    both = opened.select("key", "node", "n", "lonely", "bits", "component", i.alias("i"), F.posexplode(F.slice("f", i + 2, F.greatest(F.size("f") - i - 1, F.lit(0)))).alias("j", "b"))
    at = F.col("lonely") + F.col("i") + F.col("j")  # the second shingle's place less one: what may still be shared besides the first
    subsets = both.select(F.xxhash64("key", "b").alias("key"), "node", "n", "lonely", "bits", at.alias("at"), _most(at).alias("most"), "component", F.lit(False).alias("heavy"), F.lit(True).alias("pairs"))
    every = lists.unionByName(subsets)
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.25)).cast("int")
    small = every.where(_smaller()).withColumn("band", band)
    large = every.withColumn("band", F.explode(F.array(band, band - 1)))
    x, y = small.alias("x"), large.alias("y")
    ordered = "x.component <> y.component and (x.n < y.n or x.n = y.n and x.node < y.node) and (x.pairs or x.heavy or y.heavy) and x.pairs = y.pairs and y.n <= x.most and x.n <= y.most"
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band")) & F.expr(ordered) & _may_link("x.", "y."))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _verified(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Of distinct candidate pairs (a, b), those with 100 * intersection >= 80 * union, as links (u, v)."""
    side = lambda c: ranked.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("ranked").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(100 * common >= 80 * (F.col("n_a") + F.col("n_b") - common)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _may_link(a: str, b: str) -> Column:
    """What the size, the order and the parity bits of two sets with a common key allow.

    Linked sets share four ninths of both sizes together, so no more than a ninth differs: for sure the lonely ones
    of both do, and as many elements as parity bits. And they share a key within the first places of either order
    that a set can spare; a key further back proves nothing, and the pair meets at another.
    """
    n = F.col(f"{a}n") + F.col(f"{b}n")
    bits = sum((F.bit_count(F.col(f"{a}bits")[i].bitwiseXOR(F.col(f"{b}bits")[i])) for i in range(4)), F.lit(0))
    shared = F.floor((4 * n + 8) / 9)
    leads = (F.col(f"{a}at") <= F.col(f"{a}n") - shared) & (F.col(f"{b}at") <= F.col(f"{b}n") - shared)
    sizes = F.least(F.col(f"{a}n"), F.col(f"{b}n")) * 5 >= F.greatest(F.col(f"{a}n"), F.col(f"{b}n")) * 4
    return sizes & leads & (9 * (F.col(f"{a}lonely") + F.col(f"{b}lonely")) <= n) & (9 * bits <= n)


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, hub_rounds: int | None = None, block: int = 400_000, max_broadcast_ids: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are A-Z lower-cased runs without ASCII white space. A document with fewer words than `width` has
    its whole sequence as one shingle; a null or blank text has none and is linked with nothing, so its
    component is its own id. Equal sets are linked, however small. Rows that share an id are one document in
    the links, each with a row of its own; a null id is never a component's name, a component of null ids alone is null.
    Ids must lie below 2**62. Extra columns are ignored; an empty table gives no rows.

    Texts are read whole, however long; a task holds the shingles of `block` places of text and of one text more. Repeated
    rows are linked with each other. Sets are compared by 64-bit hashes of their shingles. `hub_rounds` bounds the rounds in
    which lists are compared with hubs alone; the result does not depend on it.
    """
    prepare_workers(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    documents, live, buckets = _live_classes(named, block, width)
    ranked = _ordered_sets(named, live, buckets, block, width, max_broadcast_ids)
    entries, links, components = _lists(ranked), None, None
    before, turn = math.inf, 0
    while True:
        entries = materialize(_open(_labelled(entries, components)), "lists")
        left = entries.count()
        if not left:
            break
        last = left > 0.7 * before or turn == hub_rounds  # hubs close few lists by now: compare what is left
        pairs = _size_aware_pairs(entries, ranked, choose_boundary(entries)) if last else _hub_pairs(entries, turn)
        found = materialize(_verified(pairs, ranked), "verified")
        links = found if links is None else links.unionByName(found)
        components = connected_components(links)
        if last:
            break
        before, turn = left, turn + 1

    node = F.coalesce("least", F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("high", "low"), 3))
    classes = documents.where("n > 0").groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).withColumn("node", node)
    text = F.struct("high", "low")
    reused = documents.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select("doc_id")
    if not reused.isEmpty():  # ids that stand for several texts join their classes
        through = documents.join(reused, "doc_id").join(classes, ["high", "low"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
        links = through if links is None else links.unionByName(through)
        components = connected_components(links)
    if components is not None:
        classes = classes.join(components, "node", "left")
    else:
        classes = classes.withColumn("component", F.lit(None).cast("long"))
    name = F.coalesce("component", "least")
    special = classes.where("copies > 1 or component is not null").select("high", "low", F.when(name < NO_ID, name).alias("component_id"), F.lit(True).alias("found"))
    out = salted_lookup(documents, special, ["high", "low"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
