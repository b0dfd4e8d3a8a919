"""Toxicity scores from weak supervision.

Stems (words and word beginnings) that set toxic training rows apart are mined from a bounded labelled
sample. They make lexicons, by kind and strength; with patterns of use (how many, how dense, how near to each other, how often
again) and of writing (capitals, exclamation marks, masked letters) these are voters, which call every document toxic or
clean, or abstain. A generative model over the votes, with a tree of the strongest correlations given the label, is fitted by
expectation maximisation to the counts of vote patterns of all training rows; the votes on the mined rows, whose labels are known,
anchor its two classes. A linear classifier is then trained on its posterior labels alone and scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweir.llm.common import materialize, settled, prepare_workers

WORD = re.compile(r"\w+")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIXES = (5, 6, 7, 8)
#: Lexicons of whole words and of word beginnings, from strong to weak.
TIERS = 3
LEXICONS = 2 * TIERS
#: Votes of a document: one per lexicon, then these (see `votes_of`).
PATTERNS = ("several", "dense", "again", "near", "shouting", "exclaiming", "masked")
CLEAN, TOXIC, ABSTAIN = 0, 1, 2
VALUES = 3
MASKED = re.compile(r"[^\W\d_][*@$#]+[^\W\d_]")
#: Stems so many characters apart are near.
REACH = 40


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def stems_of(text: str) -> set[str]:
    """Whole words as "word$", beginnings of longer words as they are."""
    found = set()
    for w in set(WORD.findall(text.lower())):
        found.add(w + "$")
        found.update(w[:k] for k in PREFIXES if len(w) > k)
    return found


class StemMatcher:
    """Counts of each stem in a text, in one pass over it."""

    def __init__(self, stems: list[str]):
        self.stems, self.automaton = stems, ahocorasick.Automaton()
        by_text: dict[str, list[tuple[int, bool]]] = {}
        for i, s in enumerate(stems):
            by_text.setdefault(s.removesuffix("$"), []).append((i, s.endswith("$")))
        for text, uses in by_text.items():
            self.automaton.add_word(text, (len(text), uses))
        self.automaton.make_automaton()

    def counts(self, lower: str) -> np.ndarray:
        out = np.zeros(len(self.stems))
        for i, _ in self.hits(lower):
            out[i] += 1
        return out

    def hits(self, lower: str) -> Iterator[tuple[int, int]]:
        """(stem, place) of every stem in a text."""
        if not self.stems:
            return
        inside = lambda c: c.isalnum() or c == "_"
        for end, (length, uses) in self.automaton.iter(lower):
            begin = end - length
            if begin >= 0 and inside(lower[begin]):
                continue
            more = end + 1 < len(lower) and inside(lower[end + 1])
            for i, whole in uses:
                if whole != more:
                    yield i, end


def tiers_of(stems: list[str]) -> np.ndarray:
    """The lexicon of each stem; stems come from strong to weak."""
    out = np.zeros(len(stems), int)
    for kind in (True, False):
        at = [i for i, s in enumerate(stems) if s.endswith("$") == kind]
        for nth, i in enumerate(at):
            out[i] = nth * TIERS // len(at) + (0 if kind else TIERS)
    return out


def votes_of(counts: np.ndarray, places: list[int], tiers: np.ndarray, text: str, words: int) -> list[int]:
    """Every voter's vote on one text. What no stem tells, only `several` and `dense` call clean, and only of 20 words or more."""
    per_lexicon = np.bincount(tiers, counts, LEXICONS) if len(tiers) else np.zeros(LEXICONS)
    hits, kinds = counts.sum(), (counts > 0).sum()
    none = CLEAN if not hits and words >= 20 else ABSTAIN
    raw = text.encode()
    upper = len(raw) - len(raw.translate(None, CAPITALS))
    near = any(b - a <= REACH for a, b in zip(places, places[1:]))
    marks = text.count("!")
    return [
        *np.where(per_lexicon > 0, TOXIC, ABSTAIN),
        TOXIC if kinds >= 3 else none,
        TOXIC if hits >= max(2, 0.01 * words) else none,
        TOXIC if counts.max(initial=0) >= 2 else ABSTAIN,
        TOXIC if near else CLEAN if hits == 1 else ABSTAIN,
        TOXIC if 2 * upper > len(raw) else ABSTAIN,
        TOXIC if marks >= max(3, 0.03 * words) else ABSTAIN,
        TOXIC if MASKED.search(text) else ABSTAIN,
    ]


def features(counts: np.ndarray, words: int) -> np.ndarray:
    """The classifier's inputs: saturating stem counts and rates, and what they sum to."""
    hits, kinds = counts.sum(), (counts > 0).sum()
    rate = 100 * hits / max(words, 20)
    return np.concatenate([np.minimum(counts, 3) / 3, np.minimum(100 * counts / max(words, 20), 4) / 4, [min(rate, 10) / 3, np.log1p(hits), np.log1p(kinds), hits > 0, np.log1p(words) / 10]])


@dataclass
class LabelModel:
    """Naive Bayes over votes (clean, toxic, abstaining), but each may depend on one other (a tree of correlations)."""

    prior: float
    parent: list[int]
    #: P(vote | label, parent's vote): [voter, label, parent's vote, vote]; without a parent all of its votes are alike.
    table: np.ndarray = field(repr=False)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        votes = votes.astype(int)
        odds = np.full(len(votes), np.log(self.prior) - np.log1p(-self.prior))
        for j, p in enumerate(self.parent):
            given = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            like = self.table[j][:, given, votes[:, j]]
            odds += np.log(like[1]) - np.log(like[0])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    @property
    def accuracies(self) -> np.ndarray:
        """Of each voter, where it doesn't abstain and without regard to its parent: P(vote = label)."""
        of, share = self.table.mean(axis=2), np.array([1 - self.prior, self.prior])
        right = share[0] * of[:, 0, CLEAN] + share[1] * of[:, 1, TOXIC]
        return right / (of[:, :, [CLEAN, TOXIC]].sum(axis=2) @ share)


def _correlation_tree(votes: np.ndarray, weights: np.ndarray, post: np.ndarray, least: float) -> list[int]:
    """Parents of the strongest dependences given the label (a maximum spanning forest of mutual information)."""
    votes, m = votes.astype(int), votes.shape[1]
    pairs = []
    for i in range(m):
        for j in range(i):
            info = 0.0
            for w in (weights * post, weights * (1 - post)):
                if w.sum() <= 0:
                    continue
                both = np.bincount(votes[:, i] * VALUES + votes[:, j], w, VALUES * VALUES).reshape(VALUES, VALUES) / w.sum()
                apart = both.sum(axis=1, keepdims=True) * both.sum(axis=0, keepdims=True)
                seen = both > 0
                info += w.sum() / weights.sum() * (both[seen] * np.log(both[seen] / apart[seen])).sum()
            if info > least:
                pairs.append((info, i, j))
    near: dict[int, list[int]] = {i: [] for i in range(m)}
    root = list(range(m))
    find = lambda x: x if root[x] == x else find(root[x])
    for _, i, j in sorted(pairs, reverse=True):
        if find(i) != find(j):
            root[find(i)] = find(j)
            near[i].append(j)
            near[j].append(i)
    parent, seen = [-1] * m, set()
    for start in range(m):
        todo = [] if start in seen else [start]
        seen.update(todo)
        while todo:
            at = todo.pop()
            for x in near[at]:
                if x not in seen:
                    seen.add(x)
                    parent[x] = at
                    todo.append(x)
    return parent


def fit_label_model(votes: np.ndarray, weights: np.ndarray, known: np.ndarray, prior: float, rounds: int = 80, least_information: float = 0.004) -> LabelModel:
    """Expectation maximisation. `known` is 0 or 1 where a row's label is given, else NaN. The correlation
    tree is estimated once voters are told apart as if they were independent, and once more later."""
    votes = votes.astype(int)
    toxic, clean = (votes == TOXIC).sum(axis=1), (votes == CLEAN).sum(axis=1)
    post = np.where(np.isnan(known), np.clip((toxic + prior) / (toxic + clean + 1.0), 0.02, 0.98), known)
    parent = [-1] * votes.shape[1]
    first = np.array([[0.45, 0.05, 0.5], [0.25, 0.25, 0.5]])  # half a row of each label that voters mostly get right
    model = None
    for turn in range(rounds):
        if turn in (40, 60):
            parent = _correlation_tree(votes, weights, post, least_information)
        table = np.empty((votes.shape[1], 2, VALUES, VALUES))
        for j, p in enumerate(parent):
            for label, share in ((0, 1 - post), (1, post)):
                for given in range(VALUES):
                    w = weights * share * ((votes[:, p] == given) if p >= 0 else 1)
                    table[j, label, given] = (np.bincount(votes[:, j], w, VALUES) + 0.5 * first[label]) / (w.sum() + 0.5)
        model = LabelModel(prior, parent, np.clip(table, 1e-4, 1 - 1e-4))
        post = np.where(np.isnan(known), model.posterior(votes), known)
    return model


def fit_linear(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weights * (p - y)) + penalty * w
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


@dataclass
class ToxicityModel:
    stems: list[str]
    label_model: LabelModel | None
    weights: np.ndarray

    def scorer(self):
        match = StemMatcher(self.stems)

        def score(text: str) -> float:
            lower = text.lower()
            x = features(match.counts(lower), len(lower.split()))
            return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40))))

        return score


def _mine(sample: DataFrame, rows: DataFrame, max_candidates: int, max_stems: int) -> list[str]:
    """Stems by how far their share among toxic rows exceeds that among others, best first."""

    def sketch(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            least = []
            for t in f["text"]:
                w = t.lower().split()
                least.append(min(xxhash.xxh3_64_intdigest(" ".join(w[i : i + 3])) >> 1 for i in range(max(1, len(w) - 2))))
            yield settled(pd.DataFrame({"doc_id": f["doc_id"], "toxic": f["toxic"], "sketch": least}))

    # copies, near ones mostly too, share the least hash of their word windows: one of them is enough
    single = sample.mapInPandas(sketch, "doc_id long, toxic int, sketch long").groupBy("toxic", "sketch").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    sample = materialize(sample.join(F.broadcast(single), "doc_id", "left_semi"), "distinct-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []

    def counted(allowed: set[str] | None):
        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for f in frames:
                for t in f["text"]:
                    s = stems_of(t)
                    seen.update(s if allowed is None else s & allowed)
            every = list(seen.items())
            for at in range(0, len(every), 50_000):
                stems, n = zip(*every[at : at + 50_000])
                yield pd.DataFrame({"stem": pd.Series(stems, dtype=object), "n": n})

        return run

    schema = "stem string, n long"
    ones = sample.where("toxic = 1").mapInPandas(counted(None), schema).groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, 0.004 * n1))
    toxic = {r["stem"]: r["n"] for r in ones.orderBy(F.desc("n"), "stem").limit(max_candidates).collect()}
    zeros = sample.where("toxic = 0").mapInPandas(counted(set(toxic)), schema).groupBy("stem").agg(F.sum("n").alias("n"))
    clean = {r["stem"]: r["n"] for r in zeros.collect()}  # max_candidates at most

    def strength(s: str) -> tuple[float, float]:
        p1, p0 = (toxic[s] + 0.1) / (n1 + 1), (clean.get(s, 0) + 0.5) / (n0 + 1)
        p = (toxic[s] + clean.get(s, 0)) / (n1 + n0)
        return (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12), p1 / p0

    scored = {s: strength(s) for s in toxic}
    chosen: list[str] = []
    for s, (z, lift) in sorted(scored.items(), key=lambda x: (-round(x[1][0], 6), -len(x[0]), x[0])):
        if len(chosen) == max_stems or z < 4.5:
            break
        bare = s.removesuffix("$")
        if lift >= 3 and not any(bare.startswith(c.removesuffix("$")) or c.removesuffix("$").startswith(bare) for c in chosen if not (c.endswith("$") and s.endswith("$"))):
            chosen.append(s)
    return chosen


def fit(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 4000, max_clean: int = 8000, max_fit: int = 20_000, max_candidates: int = 20_000, max_stems: int = 48) -> ToxicityModel:
    """Fit on rows that are not held out. Mining reads `max_toxic` + `max_clean` labelled rows at most, chosen by
    a hash of their ids, and keeps the `max_stems` strongest of the `max_candidates` most frequent stems; votes are counted over all
    training rows; the linear classifier is fitted on the posterior labels of `max_fit` of them, chosen alike, and of the rows that
    were mined. Rows that share an id share its label, which is toxic if any is; ties of a hash are broken by the id, stems that are
    equally strong by length and name. Null texts count as empty, null ids and labels teach nothing, texts are read whole.
    Without labels of both kinds, or stems, the model scores 0 everywhere."""
    prepare_workers(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = materialize(marks.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(marks.where("toxic = 0").orderBy(*order).limit(max_clean)), "chosen")
    sample = materialize(texts.join(F.broadcast(chosen), "doc_id"), "labelled")
    n1 = sample.where("toxic = 1").count()
    stems = _mine(sample, texts, max_candidates, max_stems) if n1 else []
    if not stems:
        return ToxicityModel([], None, np.array([0.0] * 5 + [-40.0]))
    tiers = tiers_of(stems)

    def vote(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = StemMatcher(stems)
        for f in frames:
            votes, xs = [], []
            for t in f["text"]:
                lower = t.lower()
                hits, words = list(match.hits(lower)), len(lower.split())
                counts = np.bincount([i for i, _ in hits], minlength=len(stems)).astype(float) if hits else np.zeros(len(stems))
                votes.append(sum(int(v) * VALUES**i for i, v in enumerate(votes_of(counts, sorted({at for _, at in hits}), tiers, t, words))))
                xs.append(features(counts, words).astype(np.float32))
            yield settled(pd.DataFrame({"doc_id": f["doc_id"], "votes": votes, "x": xs}))

    training = texts.where(~held_out())
    voted = materialize(training.mapInPandas(vote, "doc_id long, votes long, x array<float>").withColumn("pick", F.xxhash64("doc_id")), "votes")
    counted = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()  # patterns of votes: a few thousand, whatever the rows

    voters = LEXICONS + len(PATTERNS)
    values = lambda codes: np.asarray(codes, np.int64)[:, None] // VALUES ** np.arange(voters) % VALUES
    known = voted.join(F.broadcast(chosen), "doc_id").groupBy("votes", "toxic").agg(F.count("*").alias("n")).collect()
    rate = marks.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    rows = [*counted, *known]
    given = np.array([np.nan] * len(counted) + [float(r["toxic"]) for r in known])
    # the labelled rows weigh as much as all others, or the classes would drift to whatever splits the corpus best
    all_rows, labelled = (max(1.0, float(sum(r["n"] for r in x))) for x in (counted, known))
    weights = np.array([float(r["n"]) for r in counted] + [r["n"] * all_rows / labelled for r in known])
    model = fit_label_model(values([r["votes"] for r in rows]), weights, given, float(np.clip(rate, 0.001, 0.5)))

    # rows with a stem are rare but decide; the mined rows bring more of them. All have posterior labels only
    picked = voted.orderBy("pick", "doc_id").limit(max_fit).select("votes", "x")
    mined = voted.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").select("votes", "x").limit(2 * (max_toxic + max_clean))
    rows = picked.unionByName(mined).toArrow()  # bounded by the two limits
    x = np.concatenate([c.flatten().to_numpy() for c in rows["x"].chunks]).reshape(rows.num_rows, -1).astype(float)
    target = model.posterior(values(rows["votes"].to_numpy()))
    return ToxicityModel(stems, model, fit_linear(x, target, np.ones(len(x)), ridge=0.3))


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, held_out, score, predicted for every row; a null text counts as empty, a null id is not held out.
    Repeated rows are each scored, extra columns ignored."""
    prepare_workers(docs.sparkSession)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rate = model.scorer()
        for f in frames:
            yield settled(pd.DataFrame({"doc_id": f["doc_id"], "score": [rate(t) for t in f["text"]]}))

    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = named.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
