"""Toxicity scores: a lexicon learned from labels, found in spite of misspelling, read in context.

Terms are whole words or word stems that labelled toxic rows have far oftener than others. They
stand in a trie; its intersection with a Levenshtein automaton is determinised as words are read,
so that each word costs one table step a character and most words end after two or three. A hit
counts in the window of words around it: within quotation marks or after a word of reporting it
adds to another sum than a plain one. A logistic regression on these few sums gives the score.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prioscope.llm.tables import drop, durable, fresh

#: Characters that stand for a letter, marks of quotation, words of reporting.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
OPENING = "\"“„«'‘"
CLOSING = "\"”“»'’"
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes term word sagte nannte dit dijo llamó".split())
LONGEST = 64
#: Over the most edits that a term allows; a node and its edits are one number.
EDITS = 8
EDGES = ".,;:?!\"'“”„«»‘’()[]{}<>#*&%$|_-"


@dataclass(frozen=True)
class ToxicityConfig:
    """``sample_rows`` bounds the labelled rows used for fitting, ``terms`` the lexicon.

    A term needs ``evidence``: the log likelihood ratio (nats) of its rows' labels against
    chance; and ``purity``: its rate in toxic rows over the sum of its rates in both. A task
    forgets what it has looked up beyond ``known_words`` words or ``known_states`` automaton states.
    """

    sample_rows: int = 12_000
    terms: int = 512
    evidence: float = 12.0
    purity: float = 0.85
    stem_lengths: tuple[int, int] = (4, 10)
    window: int = 8
    known_words: int = 100_000
    known_states: int = 100_000


class LexiconAutomaton:
    """Finds the term within a few edits of a word. Terms: (text, whether it is a stem, weight)."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]  # the most edits that any term at or below a node allows
        for k, (text, stem, _) in enumerate(terms):
            at, most = 0, self.edits(text, stem)
            self.reach[0] = max(self.reach[0], most)
            for ch in text:
                if ch not in self.children[at]:
                    self.children[at][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                at = self.children[at][ch]
                self.reach[at] = max(self.reach[at], most)
            self.ends[at].append(k)
        self.forget()

    def forget(self) -> None:
        """Drop all states determinised so far; they are made again as words are read."""
        self.states: list[bytes] = []
        self.numbers: dict[bytes, int] = {}
        self.steps: list[dict[str, int]] = []
        self.whole: list[tuple[int, int] | None] = []
        self.stems: list[tuple[int, int] | None] = []
        self.start = self.state({(0, 0)})

    @staticmethod
    def edits(text: str, stem: bool) -> int:
        """Edits a term allows: none for a short one, and fewer for a stem than for a word."""
        return (len(text) >= 7) if stem else (len(text) >= 5) + (len(text) >= 9)

    def state(self, items: set) -> int:
        """The number of a set of (node, edits so far); characters left out are followed first."""
        best: dict[int, int] = {}
        todo = list(items)
        while todo:
            node, e = todo.pop()
            if e > self.reach[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        if not best:
            return -1
        key = array("q", sorted(EDITS * node + e for node, e in best.items())).tobytes()
        if key not in self.numbers:
            ends = sorted(
                (e, k) for node, e in best.items() for k in self.ends[node] if e <= self.edits(*self.terms[k][:2])
            )
            first = lambda stem: next(((k, e) for e, k in ends if self.terms[k][1] == stem), None)
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.whole.append(first(False))
            self.stems.append(first(True))
        return self.numbers[key]

    def step(self, state: int, ch: str) -> int:
        out = set()
        for item in array("q", self.states[state]):
            node, e = divmod(item, EDITS)
            out.add((node, e + 1))
            for c, child in self.children[node].items():
                out.add((child, e + (c != ch)))
        self.steps[state][ch] = after = self.state(out)
        return after

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest whole word, else of the nearest stem the word begins with."""
        at, stem = self.start, None
        for ch in word:
            after = self.steps[at].get(ch)
            at = self.step(at, ch) if after is None else after
            if at < 0:
                return stem
            if self.stems[at] and (stem is None or self.stems[at][1] < stem[1]):
                stem = self.stems[at]
        return self.whole[at] or stem


class Words(dict):
    """Word as written -> (term, edits) or None; forgets when it holds too many.

    A word is looked up without the marks around it, then with letters for lookalikes; then the parts that
    marks, digits or dashes join in it are, as they are spelled.
    """

    def __init__(self, automaton: LexiconAutomaton, most: int, most_states: int = 100_000):
        super().__init__()
        self.automaton, self.most, self.most_states = automaton, most, most_states

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        if len(self.automaton.states) > self.most_states:
            self.automaton.forget()
        bare = word.strip(EDGES)
        found = self.automaton.find(bare) if bare else None
        if found is None and bare and not bare.isalpha():
            found = self.automaton.find(bare.translate(LOOKALIKES))
            if found is None:
                hits = map(self.automaton.find, re.findall(r"[^\W\d_]{3,}", bare))
                found = next((hit for hit in hits if hit and not hit[1]), None)
        if len(word) <= LONGEST:  # longer ones hardly come again
            self[word] = found
        return found


def quoted(words: list[str], i: int, window: int) -> bool:
    """Whether the word at ``i`` stands in quotation marks or just after a word of reporting."""
    before, after = words[max(0, i - window) : i], words[i + 1 : i + 1 + window]
    if any(w.strip(EDGES) in REPORTING for w in before[-3:]):
        return True
    opened = words[i][0] in OPENING or any(w[0] in OPENING for w in before)
    closed = words[i][-1] in CLOSING or words[i].rstrip(".,;:?!")[-1:] in CLOSING and words[i].rstrip(".,;:?!") != "" or any(
        w.rstrip(".,;:?!")[-1:] and w.rstrip(".,;:?!")[-1] in CLOSING for w in after
    )
    return opened and closed


def measures(text: str | None, known: Words, window: int) -> list[float]:
    """Sums over hits: plain exact, plain misspelled, quoted; the largest weight; hits a word."""
    words = (text or "").lower().split()
    hits = [i for i, w in enumerate(words) if known[w] is not None]
    if not hits:
        return [0.0] * 5
    sums: list[Counter] = [Counter(), Counter(), Counter()]
    for i in hits:
        term, edits = known[words[i]]
        sums[2 if quoted(words, i, window) else min(edits, 1)][term] += 1
    weight = known.automaton.terms
    out = [sum(weight[t][2] * math.log1p(n) for t, n in s.items()) for s in sums]
    plain = [weight[t][2] for s in sums[:2] for t in s]
    return [*out, max(plain, default=0.0), 100 * math.log1p(len(hits)) / (len(words) + 20)]


def _term_counts(batches: Iterator[pd.DataFrame], lengths: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """Rows with each word and stem, of either label; counted before the shuffle."""
    rows: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pd.DataFrame:
        terms = list({**rows[0], **rows[1]})
        made = pd.DataFrame({"term": terms, "clean": [rows[0][t] for t in terms], "toxic": [rows[1][t] for t in terms]})
        for r in rows:
            r.clear()
        return made

    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            words = set(re.findall(r"[^\W\d_]{3,40}", (text or "").lower()))
            stems = {f"{w[:k]}*" for w in words for k in range(lengths[0], min(len(w), lengths[1] + 1))}
            rows[int(label)].update(words)
            rows[int(label)].update(stems)
        if len(rows[0]) + len(rows[1]) > 500_000:
            yield out()
    yield out()


def chosen(rows: list, clean: int, toxic: int, config: ToxicityConfig) -> list[tuple[str, bool, float]]:
    """The lexicon out of counted terms: most rows first, the longer of two that nest."""
    terms: list[tuple[str, bool, float]] = []
    for r in sorted(rows, key=lambda r: (-r.toxic, -len(r.term.rstrip("*")), r.term)):
        stem, text = r.term.endswith("*"), r.term.rstrip("*")
        if any(s and text.startswith(t) or stem and t.startswith(text) or t == text for t, s, _ in terms):
            continue
        weight = math.log((r.toxic + 0.5) / (toxic + 1)) - math.log((r.clean + 0.5) / (clean + 1))
        terms.append((text, stem, min(max(weight, 0.1), 8.0)))
        if len(terms) >= config.terms:
            break
    return terms


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, the intercept first (Newton steps)."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    """A lexicon and the weights of the five measures; ``prior`` alone if labels have one class."""

    terms: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    prior: float = 0.0
    config: ToxicityConfig = field(default_factory=ToxicityConfig)

    def known(self) -> Words:
        return Words(LexiconAutomaton(self.terms), self.config.known_words, self.config.known_states)

    def score(self, text: str | None, known: Words) -> float:
        if not self.weights:
            return self.prior
        z = self.weights[0] + sum(
            w * x for w, x in zip(self.weights[1:], measures(text, known, self.config.window), strict=True)
        )
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, extra: Column | None = None) -> DataFrame:
    """(doc_id, label, text, extra) of at most ``most`` labelled documents, chosen by hash of the id.

    Held-out ids (crc32 of the id as text mod 5 is 0) take no part. An id with several labels
    has the largest, an id with several texts the smallest.
    """
    ids = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
        .filter("id is not null and label in (0, 1) and crc32(cast(cast(id as string) as binary)) % 5 != 0")
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(most)
    )
    texts = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.lit(0) if extra is None else extra).alias("extra")
    )
    return (
        texts.join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"), F.max("extra").alias("extra"))
    )


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Learn lexicon and weights from ``labels.toxic`` (0/1) of the rows that are not held out.

    No labelled row: every score is 0. One class only: every score is that class's smoothed share.
    """
    rows = durable(labelled_rows(docs, labels, "toxic", config.sample_rows))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    clean, toxic = counts.get(0, 0), counts.get(1, 0)
    if not clean or not toxic:
        drop(rows)
        return ToxicityModel(prior=(toxic + 1) / (toxic + 2) if toxic else 0.0, config=config)
    lengths = config.stem_lengths
    share = F.col("toxic") / toxic
    n = F.col("toxic") + F.col("clean")
    evidence = F.col("toxic") * F.log(F.col("toxic") * (toxic + clean) / (n * toxic)) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") * (toxic + clean) / (n * clean))
    ).otherwise(0.0)
    found = (
        rows.mapInPandas(lambda b: _term_counts(b, lengths), "term string, clean long, toxic long")
        .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter("toxic > 0").filter(evidence >= config.evidence)
        .filter(share / (share + F.col("clean") / clean) >= config.purity)
        .orderBy(F.desc("toxic"), F.desc(F.length("term")), "term").limit(40 * config.terms).collect()
    )
    model = ToxicityModel(terms=chosen(found, clean, toxic, config), config=config)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = model.known()
        for batch in batches:
            x = [measures(t, known, config.window) for t in batch["text"]]
            made = pd.DataFrame(x, columns=list("abcde"), dtype=float)
            made["label"] = batch["label"].to_numpy()
            yield made

    data = rows.mapInPandas(measured, "a double, b double, c double, d double, e double, label int").toPandas()
    drop(rows)
    data = data.sort_values(list(data.columns))  # the same sums whatever order rows arrive in
    model.weights = [float(w) for w in logistic(data[list("abcde")].to_numpy(), data["label"].to_numpy(float))]
    return model


def scorer(model: ToxicityModel):
    """A column function text -> score; the automaton is built once a task."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = model.known()
        for batch in batches:
            yield pd.Series([model.score(t, known) for t in batch], dtype=float)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    Null and empty texts score like a text without hits. Repeated rows get a row each. A null id
    is not held out. An empty table gives no rows; other columns are not looked at.
    """
    model = fit(docs, labels, config)
    return docs.select(
        F.col("doc_id"),
        F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(False)).alias("held_out"),
        scorer(model)(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns.

    Null and empty texts score like a text without hits, and so stay wherever most labelled rows are clean.
    Repeated rows are kept or go alike; null ids do not matter; an empty table stays empty. Columns of any
    name are kept.
    """
    score = fresh(docs, "score")
    model = fit(docs, labels, config)
    return docs.withColumn(score, scorer(model)(F.col("text"))).filter(F.col(score) < 0.5).drop(score)
