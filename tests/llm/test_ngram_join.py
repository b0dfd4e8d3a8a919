import random

import pytest

from feedweir.llm import components, ngram_join


def brute(texts):
    """Components by comparing every pair."""
    sets = []
    for t in texts:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    """Groups of copies with few and many edits, passages that many texts share, short and empty texts."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(3000)}"
    passage = [word() for _ in range(40)]
    texts = [None, "", " \t\n", "one", "One", "one two", "a b c d e", "A B C D E", "a b c d e f", "a b c d e f"]
    for size, copies in ((12, 6), (30, 12), (80, 25), (200, 25), (600, 8)):
        for _ in range(3):
            base = [word() for _ in range(size)]
            for _ in range(copies):
                t = list(base)
                for _ in range(draw.randrange(0, max(2, size // 25))):
                    t[draw.randrange(len(t))] = word()
                if draw.random() < 0.3:
                    t = t[: len(t) - draw.randrange(len(t) // 6 + 1)]
                if draw.random() < 0.3:
                    t += passage[: draw.randrange(40)]
                texts.append(" ".join(t))
    texts += [" ".join(passage + [word() for _ in range(8)]) for _ in range(30)]
    draw.shuffle(texts)
    return texts


def run(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = ngram_join.similar_components(docs, **options).collect()
    return [(r["n_shingles"], r["component_id"]) for r in sorted(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    assert run(spark, texts, block=4000) == brute(texts)


def test_equals_brute_force_with_light_sets_and_shuffled_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda ranked: 60)
    texts = corpus(3)
    assert run(spark, texts, hub_rounds=0, max_broadcast_ids=0) == brute(texts)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, extra string")
    assert ngram_join.similar_components(none).collect() == []
    rows = [(7, "a b c d e f g"), (None, "a b c d e f g"), (None, "x y z"), (None, "x y z"), (5, None), (9, "k l m"), (9, "q r s"), (3, "k l m"), (2, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as low")
    found = ngram_join.similar_components(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in found) == [(-1, 1, -1), (-1, 1, -1), (-1, 3, 7), (2, 1, 2), (3, 1, 2), (5, 0, 5), (7, 3, 7), (9, 1, 2), (9, 1, 2)]


def test_parity_bits_bound_the_difference():
    import numpy as np

    draw = np.random.default_rng(0)
    a = draw.integers(0, 2**63, 500).astype(np.uint64)
    for k in (0, 3, 40, 300):
        b = np.concatenate([a[k:], draw.integers(0, 2**63, k).astype(np.uint64)])
        bits = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(ngram_join.parity_bits(a), ngram_join.parity_bits(b)))
        assert bits <= 2 * k


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (7, None)], "u long, v long")
    found = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.connected_components(links.where("u = 5 and v = 5")).collect() == []


def test_texts_around_a_common_passage_are_no_candidates(spark, monkeypatch):
    """850 words in common and 150 of its own each: about 0.74, linked with nothing, however many there are."""
    compared, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, ranked: compared.append(pairs.count()) or verified(pairs, ranked))
    shared = [f"s{i}" for i in range(850)]
    texts = [" ".join(shared + [f"d{d}w{i}" for i in range(150)]) for d in range(80)]
    assert run(spark, texts) == [(996, d) for d in range(80)] and sum(compared) == 0


def test_a_large_group_of_near_copies_costs_what_its_members_cost(spark, monkeypatch):
    compared, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, ranked: compared.append(pairs.count()) or verified(pairs, ranked))
    texts = [" ".join("x" + str(d) if i == d % 190 else f"s{i}" for i in range(200)) for d in range(400)]
    assert {c for _, c in run(spark, texts)} == {0} and sum(compared) <= 4 * len(texts)


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    assert run(spark, [long, long + " more", "short", ""]) == [(299_996, 0), (299_997, 0), (1, 2), (0, 3)]
