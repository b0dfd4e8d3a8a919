"""Chat formatting and benchmark decontamination."""

import hashlib
import random

from pyspark.sql import functions as F

from feedweir.llm import chat_format, decontaminate

SCHEMA = "conv_id long, turn long, role string, text string"


def formatted(spark, rows, schema=SCHEMA):
    out = chat_format.format_conversations(spark.createDataFrame(rows, schema))
    return out.select("conv_id", "formatted", "valid", chat_format.parsed_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"), "segments").collect()


def test_round_trip_of_hostile_texts(spark):
    draw = random.Random(5)
    parts = ["<|im_start|>", "<|im_end|>", "\n", "<", "|", "\\", "<\\|", "assistant", "é\U0001f600", "%0A", "%", " ", "<|"]
    rows = [(c, t, draw.choice(["user", "assistant", "a\nb", "%3C|x", "<|im_end|>", ""]), "".join(draw.choice(parts) for _ in range(draw.randrange(14)))) for c in range(60) for t in range(draw.randint(1, 5))]
    for r in formatted(spark, rows):
        turns = [(role, text) for c, _, role, text in sorted(rows, key=lambda x: x[1]) if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss"] == "".join(text for role, text in turns if role == "assistant")
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>\n") == len(turns)
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"] and len(r["segments"]) == 3 * len(turns)


def test_turn_order(spark):
    orders = {1: "ua", 2: "sua", 3: "au", 4: "u", 5: "uaua", 6: "uata", 7: "suu", 8: "sa"}
    roles = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    rows = [(c, i, roles[x], "t") for c, order in orders.items() for i, x in enumerate(order)]
    assert {r["conv_id"]: r["valid"] for r in formatted(spark, rows)} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: False, 8: False}


def test_chat_edges(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, "assistant", "z" * 200_000)]
    found = {r["conv_id"]: r for r in formatted(spark, [(*r, 1, 2) for r in rows], SCHEMA + ", segments int, formatted int")}
    assert [(t["role"], t["text"]) for t in found[None]["turns"]] == [("", ""), ("assistant", "x")]
    assert [t["text"] for t in found[1]["turns"]] == ["a", "a", "b"] and len(found[2]["loss"]) == 200_000
    assert formatted(spark, []) == []


def overlaps(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as words", "2 as seed", "3 as item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as at", "2 as doc_id")
    return sorted((r["doc_id"] or -1, r["item_id"] or -1, r["score"], r["item_words"]) for r in decontaminate.find_overlaps(d, b, **options).collect())


def brute(docs, items, min_score=13, min_share=0.6):
    import math
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = {}
    for i, it in items:
        b = words(it)
        for d, dt in docs:
            a = words(dt)
            for shift in range(-len(b), len(a)):
                pairs = [(a[shift + j], b[j]) for j in range(len(b)) if 0 <= shift + j < len(a)]
                if len(b) < 10:
                    if len(pairs) == len(b) and b and all(x == y for x, y in pairs):
                        found[d, i] = len(b)
                    continue
                seeds = any(
                    all(0 <= shift + p + k < len(a) and p + k < len(b) and a[shift + p + k] == b[p + k] for k in m) and 0 <= shift + p and shift + p + 9 < len(a) and p + 9 < len(b)
                    for m in decontaminate.MASKS for p in range(len(b))
                )
                now = best = 0
                for x, y in pairs:
                    now = max(0, now + (1 if x == y else -2))
                    best = max(best, now)
                if seeds and best >= min(min_score, math.ceil(min_share * len(b))):
                    found[d, i] = max(found.get((d, i), 0), best)
    return sorted((d, i, s, len(words(dict(items)[i]))) for (d, i), s in found.items())


def planted(seed):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(draw.randint(8, 45)))) for i in range(12)]
    docs = []
    for d in range(40):
        text = [word() for _ in range(draw.randint(0, 80))]
        if d % 2:
            part = draw.choice(items)[1].split()
            cut = part[draw.randrange(0, len(part) // 2 + 1) :] if d % 3 == 0 else list(part)
            every = draw.choice([3, 4, 5, 8, 1000])
            cut = [word() if j % every == every - 1 else w for j, w in enumerate(cut)]
            at = draw.randint(0, len(text))
            text[at:at] = cut
        docs.append((d, ", ".join(text).title() if d % 5 == 0 else " ".join(text)))
    return docs, items


def test_overlaps_equal_brute_force(spark):
    docs, items = planted(1)
    want = brute(docs, items)
    assert len(want) >= 5 and overlaps(spark, docs, items) == want == overlaps(spark, docs, items, max_broadcast_rows=-1)


def test_substitutions_at_every_third_or_later_token_are_caught(spark):
    item = [f"t{i}" for i in range(40)]
    docs = [(p, " ".join("zz" if j % p == p - 1 else w for j, w in enumerate(item))) for p in (4, 5, 6, 9)]
    assert {d for d, *_ in overlaps(spark, docs, [(1, " ".join(item))], min_score=8)} == {4, 5, 6, 9}


def test_near_copies_of_items_are_caught_at_the_default_scores(spark):
    items = [(n, " ".join(f"i{n}t{j}" for j in range(n))) for n in (15, 16, 17, 18, 20, 25, 28, 43, 59)]
    cases = [(n, t, p, r) for n, t in items for p in (3, 4, 5, 6) for r in range(p)]
    docs = [(d, "before this " + " ".join("zz" if j % p == r else w for j, w in enumerate(t.split())) + " and after") for d, (_, t, p, r) in enumerate(cases, 1)]
    docs += [(1000 + n, "before " + " ".join(t.split()[:7]) + " after " * 60) for n, t in items]  # seven equal tokens: chance
    found = {(d, n) for d, n, *_ in overlaps(spark, docs, items, near=True)}
    assert found == {(d, n) for d, (n, *_) in enumerate(cases, 1)}
    assert {d for d, *_ in overlaps(spark, docs, items)} < set(range(1, len(cases) + 1))
    assert found == {(d, n) for d, n, *_ in overlaps(spark, docs, items, near=True, max_broadcast_rows=-1)}


def test_decontamination_edges(spark):
    item = " ".join(f"t{i}" for i in range(20))
    docs = [(None, item), (None, "fine"), (1, item.upper()), (1, item), (2, None), (3, ""), (4, "x " * 30_000 + item), (5, "clean text here")]
    assert overlaps(spark, docs, [(7, item), (None, None), (8, "short"), (9, "Clean, TEXT"), (10, "clean here")]) == [(-1, 7, 20, 20), (1, 7, 20, 20), (4, 7, 20, 20), (5, 9, 2, 2)]
    assert overlaps(spark, docs, []) == [] and overlaps(spark, [], [(7, item)]) == []
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(d, b).collect()) == [2, 3, 5]


def test_queries_equal_sql_on_the_smallest_tables(spark):
    import duckdb

    from feedweir.llm import queries

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        frame, found = queries.queries()[name](spark, folder), con.sql(sql)
        at = [found.columns.index(c) for c in frame.columns]
        assert sorted(map(repr, (tuple(r) for r in frame.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall()), name
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_overlap_sql_states_the_rule_of_the_query(spark):
    """On planted items with substituted words and short ones, which the given tables lack."""
    import duckdb
    import pandas as pd

    from feedweir.llm import queries

    docs, items = planted(3)
    draw = random.Random(9)
    for d in range(40, 90):
        words = draw.choice(items)[1].split()
        docs.append((d, "so " + " ".join("zz" if draw.random() < 0.22 else w for w in words) + " end"))
    items += [(50, "w1 w2"), (51, docs[1][1].split(", ")[0])]
    documents, benchmark = pd.DataFrame(docs, columns=["doc_id", "text"]), pd.DataFrame(items, columns=["item_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    want = sorted((d or -1, i or -1, s, n) for d, i, s, n in con.sql(queries.oracle_sql()["op10_decontamination"]).fetchall())
    strict = overlaps(spark, docs, items)
    assert overlaps(spark, docs, items, near=True) == want and len(want) > len(strict)
