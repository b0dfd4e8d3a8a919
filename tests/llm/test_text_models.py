"""Language identification, quality rules and toxicity."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedweir.llm import language_id, perplexity, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_brute_force():
    draw = random.Random(0)
    for _ in range(300):
        text = "".join(draw.choice(["a ", "b ", "a b c ", "é", "#", "\n", "\t", "\x0b", "\u00a0", "|", " \n", "dup line\n"]) for _ in range(draw.randrange(60)))
        assert perplexity.counts_of(text) == brute_counts(text)
    assert perplexity.counts_of("") == (0, 0, 0, 0, 0)


def brute_model(texts):
    """Interpolated modified Kneser-Ney over character 5-grams, from the definition."""
    order = perplexity.ORDER
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = ["^"] * (order - 1) + list(" ".join(t.split()).lower())
        for i in range(order - 1, len(s)):
            counts[order][tuple(s[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    off = {k: perplexity.discounts(*(sum(1 for c in counts[k].values() if c == i) for i in (1, 2, 3, 4))) for k in range(1, order + 1)}
    by = [defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            by[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / len(counts[1])
        c, row = counts[k][g], by[k][g[:-1]]
        if not row:
            return p(g[1:])
        d = lambda x: off[k][min(x, 3) - 1] if x else 0.0
        return max(c - d(c), 0) / sum(row) + sum(map(d, row)) / sum(row) * p(g[1:])

    return lambda t: sum(math.log(p(tuple((["^"] * (order - 1) + list(" ".join(t.split()).lower()))[i : i + order]))) for i in range(len(" ".join(t.split()))))


def small_corpus():
    draw = random.Random(4)
    return ["".join(draw.choice(["the ", "cat ", "sat ", "on ", "a ", "mat. "]) for _ in range(draw.randint(3, 40))) for _ in range(60)]


def test_model_equals_definition_on_seen_and_unseen_text(spark):
    texts = small_corpus()
    docs = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").repartition(3)
    model, want = perplexity.fit(docs), brute_model(texts)
    arrays = perplexity.to_arrays(model)["x"]
    for t in [*texts[:10], "the cat on the", "tam eht no", "satsat mat."]:
        assert arrays.log_sum(perplexity.char_grams(t)) == pytest.approx(want(t), rel=1e-9)
    total = sum(r["p"] for r in model[1].collect())
    assert total == pytest.approx(1.0)
    fast = {r["doc_id"]: r["log_ppl"] for r in perplexity.log_perplexities(docs, model, 10**9).collect()}
    slow = {r["doc_id"]: r["log_ppl"] for r in perplexity.log_perplexities(docs, model, 0).collect()}
    assert fast.keys() == slow.keys() and all(fast[i] == pytest.approx(slow[i]) == pytest.approx(-want(texts[i]) / len(texts[i].split())) for i in fast)


def test_bands_equal_brute_force(spark):
    draw = random.Random(12)
    rows = [(i, "x" if i % 3 else "y", " ".join(draw.choice(["lo", "la", "li", "ke", "ki"]) * draw.randint(1, 3) for _ in range(draw.randint(40, 200))) + (" zqw" * 70 if i % 40 == 7 else "")) for i in range(240)]
    found = perplexity.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)).collect()
    assert len(found) == len(rows)
    models = {lang: brute_model([t for _, x, t in rows if x == lang]) for lang in "xy"}
    texts = {i: (lang, t) for i, lang, t in rows}
    for r in found[::12]:
        lang, t = texts[r["doc_id"]]
        assert r["log_ppl"] == pytest.approx(-models[lang](t) / len(t.split()))
    for lang in "xy":
        passed = [r for r in found if r["lang"] == lang and not r["base_failed"]]
        values = sorted(r["log_ppl"] for r in passed)
        at = lambda xs, q: xs[max(0, math.ceil(q * len(xs)) - 1)]
        low, mid, high = (at(values, q) for q in (0.25, 0.5, 0.75))
        spread = at(sorted((mid - r["log_ppl"]) * math.sqrt(r["n_words"]) for r in passed), 0.75)
        for r in found:
            if r["lang"] == lang:
                inside = mid - max(5 * spread / math.sqrt(max(1, r["n_words"])), 0.5) <= r["log_ppl"] <= high + max(5 * (high - low), 0.5)
                assert r["kept"] == (not r["base_failed"] and inside), r
    assert any(not r["kept"] and not r["base_failed"] for r in found)


def test_quality_edges(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en"), (1, words, "en"), (None, None, None), (2, "", "en"), (3, "a b c " * 30, None), (4, "中" * 50 + " " + words, "zh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as kept", "2 as n_words")
    found = sorted(((r["doc_id"] or 0, r["n_words"], r["base_failed"], r["kept"]) for r in perplexity.judge(docs).collect()))
    assert found == [(0, 0, True, False), (1, 60, False, True), (1, 60, False, True), (2, 0, True, False), (3, 90, True, False), (4, 61, False, True)]
    assert perplexity.judge(docs.limit(0)).collect() == []


@needs_data
def test_quality_keeps_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    judged = perplexity.judge(docs).join(labels, "doc_id").where("not base_failed")
    rows = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert rows.get((1, False), 0) <= 0.01 * rows[1, True]


def test_a_too_predictable_document_is_rejected(spark):
    draw = random.Random(8)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    vocabulary = ["".join(draw.choice(syllables) for _ in range(draw.randint(2, 4))) for _ in range(3000)]
    common = [1 / (i + 1) for i in range(3000)]
    # a third of the texts has rarer words, so the quartiles lie far apart, as in real corpora
    rows = [(i, " ".join(draw.choices(vocabulary, None if i % 3 == 0 else common, k=draw.randint(60, 600)))) for i in range(300)]
    rows += [(1000, " ".join(draw.choices(vocabulary[:40], k=400)))]
    judged = perplexity.judge(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"] for r in judged if not r["kept"]} == {1000}
    low = next(r for r in judged if r["doc_id"] == 1000)
    assert not low["base_failed"] and low["log_ppl"] < low["lower"]


@needs_data
def test_the_lower_band_rejects_junk(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    low = perplexity.judge(docs).where("not base_failed and log_ppl < lower").join(labels, "doc_id").groupBy("quality").count()
    assert {r["quality"]: r["count"] for r in low.collect()}.get(0, 0) >= 4


@needs_data
def test_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, table = language_id.train(docs)
    assert names == ["de", "en", "es", "fr", "und"]
    brute = np.full((5, language_id.BUCKETS), 0.1)
    for r in docs.select("lang", "text").collect():
        brute[names.index(r["lang"])] += np.bincount(language_id.trigram_buckets(r["text"]), minlength=language_id.BUCKETS)
    brute[-1] = 1
    assert np.allclose(table, np.log(brute / brute.sum(axis=1, keepdims=True)), atol=1e-4)
    # text alone, without any other evidence
    bare = docs.select("doc_id", "text", F.lit(None).cast("string").alias("markup"), F.lit(None).cast("string").alias("host"))
    rows = language_id.identify(bare, names, table).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert sum(r["lang"] == r["truth"] for r in rows) >= 0.99 * len(rows) and sum(not r["kept"] for r in rows) <= 0.005 * len(rows)
    odd = [(1, None, None, None), (2, "", "fr-CA", "x"), (3, "??? 123", None, "h.example.de"), (4, "zqxj vkzq wxqz kqzx jvqx zzkq xqwv qzjx vqkz", None, None), (4, "the", "EN_us", "a.b")]
    found = language_id.identify(spark.createDataFrame(odd, "id long, text string, markup string, host string").selectExpr("*", "1 as logs", "2 as LANG", "3 as has_text", "4 as _salt", "5 as kept", "6 as post", "7 as domain"), names, table).orderBy("id", "lang").collect()
    assert [(r["id"], r["lang"], r["kept"]) for r in found] == [(1, "und", False), (2, "fr", True), (3, "und", False), (4, "en", True), (4, "und", False)]
    assert {(r["logs"], r["LANG_key"], r["has_text"], r["kept_key"], r["post"], r["domain"]) for r in found} == {(1, 2, 3, 5, 6, 7)}
    assert language_id.identify(bare.limit(0), names, table).collect() == []


def brute_identify(records, names, table, strength=20.0, und_prior=1e-4):
    """(lang, posterior) by the formulas, in plain Python."""
    real = names[:-1]
    rows = []
    for text, markup, host in records:
        b = language_id.trigram_buckets(text or "")
        logs = [float(table[i, b].sum()) * min(len(b), language_id.TEMPER) / len(b) for i in range(len(names))] if len(b) else None
        heard = names[max(range(len(names)), key=lambda i: logs[i])] if logs else "und"
        rows.append((logs, heard, (markup or "").lower().split("-")[0].split("_")[0], host or ""))
    votes = lambda pick: [sum(h == x and pick(host) for _, h, _, host in rows) for x in real]
    share = lambda c, towards: [(a + strength * p) / (sum(c) + strength * sum(towards)) for a, p in zip(c, towards)]
    overall = votes(lambda h: True)
    flat = [(c + 1) / (sum(overall) + len(real)) for c in overall]
    domain, suffix = lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1] if "." in h else ""
    whole, out = sum(overall) + len(real), []
    for logs, _, markup, host in rows:
        prior = share(votes(lambda h: h == host), share(votes(lambda h: domain(h) == domain(host)), flat))
        of_suffix = votes(lambda h: suffix(h) == suffix(host))
        size = sum(of_suffix) + 1
        score = []
        for i, x in enumerate(real):
            s = math.log(prior[i]) + (logs[i] if logs else 0.0)
            s += math.log((of_suffix[i] + size / whole) / (overall[i] + 1) * whole / size) if suffix(host) else 0.0
            if markup:
                said = markup if markup in real else "und"
                spoken = [sum(1 for _, h, m, _ in rows if m and h == x and (m if m in real else "und") == k) for k in names]
                s += math.log((spoken[names.index(said)] + (5.0 if said == x else 0.1)) / (sum(spoken) + 5.0 + 0.1 * (len(names) - 1)))
            score.append(s)
        score.append(math.log(und_prior) + (logs[-1] if logs else -5.0 if markup else 20.0))
        top = max(score)
        weights = [math.exp(s - top) for s in score]
        out.append((names[score.index(top)], max(weights) / sum(weights)))
    return out


def test_fusion_equals_brute_force(spark):
    draw = random.Random(7)
    vocabulary = {"aa": ["ba", "bo", "bi"], "bb": ["ka", "bo", "ku"], "cc": ["xe", "ky", "bi"]}
    said = lambda lang, n: " ".join(draw.choice(vocabulary[lang]) + draw.choice(["t", "r", "ba"]) for _ in range(n))
    docs = spark.createDataFrame([(lang, said(lang, 30)) for lang in vocabulary for _ in range(8)], "lang string, text string")
    names, table = language_id.train(docs)
    hosts, marks = ["a.x.com", "b.x.com", "y.org", "z.y.org", "plain", None], ["aa", "BB-US", "cc_X", "zz", "", None]
    records = [(draw.choice([said(draw.choice("abc") * 2, draw.randint(1, 4)), "", None, "123 !!", "qqq www zzz"]), draw.choice(marks), draw.choice(hosts)) for _ in range(90)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(records)], "id long, text string, markup string, host string").repartition(3)
    found = language_id.identify(frame, names, table).orderBy("id").collect()
    for r, (lang, confidence), record in zip(found, brute_identify(records, names, table), records):
        assert r["confidence"] == pytest.approx(confidence, rel=1e-4), record
        assert r["lang"] == lang or confidence == pytest.approx(0.5, abs=1e-3), record


def test_label_model_recovers_accuracies():
    draw = np.random.default_rng(0)
    y = draw.random(40_000) < 0.15
    rates = [(0.8, 0.02), (0.6, 0.05), (0.7, 0.01), (0.3, 0.3)]
    votes = np.stack([np.where(y, draw.random(len(y)) < a, draw.random(len(y)) < b) for a, b in rates], axis=1)

    def fit(votes):
        patterns, n = np.unique(votes, axis=0, return_counts=True)
        return toxicity.fit_label_model(patterns, n.astype(float), np.full(len(patterns), np.nan), 0.15)

    alone = fit(votes)
    assert np.allclose(alone.accuracies[:3], [0.15 * a + 0.85 * (1 - b) for a, b in rates[:3]], atol=0.05)
    assert ((alone.posterior(votes) > 0.5) == y).mean() > 0.95
    twice = np.column_stack([votes, votes[:, 0] ^ (draw.random(len(y)) < 0.03)])  # a near copy of the first voter
    parent = toxicity._correlation_tree(twice, np.ones(len(y)), y.astype(float), 0.004)
    assert parent == [-1, -1, -1, -1, 0]


def test_label_model_with_voters_that_abstain():
    """Lexicon-like voters, which never call a text clean, and patterns that do; the labelled rows anchor the classes."""
    draw = np.random.default_rng(1)
    y = draw.random(30_000) < 0.1
    hit = lambda a, b: np.where(y, draw.random(len(y)) < a, draw.random(len(y)) < b)
    lexicons = [np.where(hit(a, b), toxicity.TOXIC, toxicity.ABSTAIN) for a, b in ((0.7, 0.01), (0.5, 0.03), (0.4, 0.02))]
    pattern = np.where(hit(0.8, 0.05), toxicity.TOXIC, np.where(draw.random(len(y)) < 0.6, toxicity.CLEAN, toxicity.ABSTAIN))
    votes = np.stack([*lexicons, pattern], axis=1)
    known = np.where(np.arange(len(y)) < 3000, y.astype(float), np.nan)
    model = toxicity.fit_label_model(votes, np.ones(len(y)), known, 0.1)
    of = lambda j: np.mean((votes[:, j] == y)[votes[:, j] != toxicity.ABSTAIN])
    assert np.allclose(model.accuracies, [of(j) for j in range(4)], atol=0.05)
    # the posterior is Bayes' rule over the true shares
    shares = [[[np.mean(votes[y == label, j] == v) for v in range(3)] for label in (False, True)] for j in range(4)]
    odds = [0.1 / 0.9 * math.prod((shares[j][1][v] + 1e-9) / (shares[j][0][v] + 1e-9) for j, v in enumerate(row)) for row in votes[:500]]
    assert np.mean(np.abs(model.posterior(votes[:500]) - np.array(odds) / (1 + np.array(odds)))) < 0.03


def test_votes():
    stems = ["vile$", "scum$", "nast"]
    match, tiers = toxicity.StemMatcher(stems), toxicity.tiers_of(stems)
    assert list(tiers) == [0, 1, 3]

    def votes(text):
        hits = list(match.hits(text.lower()))
        return "".join("ct."[v] for v in toxicity.votes_of(match.counts(text.lower()), sorted({at for _, at in hits}), tiers, text, len(text.split())))

    assert votes("fine words " * 20) == "......cc....."
    assert votes("short") == "............."
    assert votes("You vile scum! Nasty!! " + "and so on " * 10) == "tt.t..tt.t.t."
    assert votes("VILE, WHAT A VILE V*LE THING") == "t......tttt.t"
    assert votes("") == "............."


def test_stem_matcher_equals_brute_force():
    stems = ["idiot$", "achlich", "trash$", "tra"]
    match = toxicity.StemMatcher(stems)
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice(["idiot", "achlich", "er", "trash", "tra", " ", ".", "x", "_", "é"]) for _ in range(draw.randrange(12)))
        words = toxicity.WORD.findall(text)
        want = [sum(w == s[:-1] if s.endswith("$") else w.startswith(s) and len(w) > len(s) for w in words) for s in stems]
        assert list(match.counts(text)) == want, text


@needs_data
def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r["predicted"] for r in rows if r["toxic"])
    assert hit >= 0.85 * sum(r["toxic"] for r in rows) and sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.01 * len(rows)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string").selectExpr("*", "1 as score", "0 as held_out")
    assert sorted((r["doc_id"] or 0, r["held_out"], r["predicted"]) for r in toxicity.score(odd, model).collect()) == [(0, False, 0), (1, False, 0), (1, False, 0)]
    none = toxicity.fit(docs.limit(5), labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(odd, none).collect()} == {0}
