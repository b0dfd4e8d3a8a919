import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedweir.llm import best_fit

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_bins(lengths, capacity):
    """Best-fit decreasing, one piece at a time; the fills of the bins, sorted."""
    room, full = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect_left(room, n)
        left = (room.pop(i) if i < len(room) else capacity) - n
        if left:
            insort(room, left)
        else:
            full += 1
    return sorted(capacity - r for r in room) + [capacity] * full


@pytest.mark.parametrize("seed", range(6))
def test_histogram_packing_equals_piece_by_piece(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 64, 100])
    lengths = [draw.randint(1, capacity) for _ in range(draw.choice([1, 50, 400]))]
    runs, used, slots = best_fit.pack_histogram(Counter(lengths), capacity), Counter(), {}
    for length, first, end, bin_, each, at in runs:
        for rank in range(first, end):
            b, offset = bin_ + (rank - first) // each, at + (rank - first) % each * length
            used[b] += length
            slots.setdefault(b, []).append((offset, length))
    assert sorted(used.values()) == sorted(plain_bins(lengths, capacity)) and set(used) == set(range(len(used)))
    for parts in slots.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert Counter(n for parts in slots.values() for _, n in parts) == Counter(lengths)


def test_ids_equal_the_tokenizer():
    slow, draw = Tokenizer.from_file(PATH), random.Random(0)
    alphabet = ["a", "B", "é", "ß", "中", "\U0001f600", " ", "  ", "\n", "\t", "'s", "'ll", "12", "…", "\u00a0", "\u3000", "\x00", "<|", "endoftext", "<|endoftext|>", "###"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(60))) for _ in range(3000)]
    encode = best_fit.load_encoder(PATH)
    assert all(encode(t) == slow.encode(t, add_special_tokens=False).ids for t in texts)


def test_pieces_round_trip(spark):
    texts = [None, "", "short text", "word " * 3000, "x", "x", "longer text here " * 20] * 2
    docs = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(3)
    rows = best_fit.pack_documents(docs, PATH, keep_ids=True).collect()
    slow = Tokenizer.from_file(PATH)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        parts = sorted(by_doc[i if i else None], key=lambda r: r["piece"])
        assert [x for r in parts for x in r["ids"]] == ids and [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])
        assert all(r["length"] == 1024 for r in parts[1:]) and all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in parts)
    fills = Counter()
    for r in rows:
        fills[r["sequence_id"]] += r["length"]
    assert sorted(fills.values()) == sorted(plain_bins([r["length"] for r in rows], 1024))
    whole = {r["sequence_id"]: r for r in best_fit.sequences(best_fit.pack_documents(docs, PATH, keep_ids=True)).collect()}
    assert sum(len(r["ids"]) for r in whole.values()) == sum(fills.values())
    assert best_fit.pack_documents(docs.limit(0), PATH).collect() == []
