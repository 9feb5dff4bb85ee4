"""Toxicity by a weighted grammar of composed finite-state transducers over clauses.

A clause is a run of words between marks such as ``. , ; : ! ?`` or line ends.
A lexical step turns each word into a symbol: insult, threat verb, intent
(``will``, ``going``), target, negation, verb of saying or other.  Small
transducers read the symbols and mark what they are near to:

* target: nearer than :data:`NEAR` words to a target, before or after it;
* negation: within :data:`NEAR` words after a negation;
* report: after a verb of saying, up to the clause's end and, over a colon, a comma or a quotation mark, in the next clause;
* intent: within :data:`NEAR` words after an intent.

:func:`compose` builds their product; one is read from left to right, one,
of the target alone, from right to left.  An insult matches by itself; a
threat is several words: its verb matches only with an intent or a target.
What matches is asserted, negated or reported, and aimed at a target or not.
A document is scored by these clauses, never by isolated words: a logistic
model over the weights that each path gathers gives the score, and so learns
what a negation, a report or a target is worth.

Insults are a small hand-written list and what the labelled training rows
show: whole words and stems (the first 4 to 10 letters) that occur in toxic
rows more often than in others beyond doubt, weighted by that ratio.  Each is
tested by its own counts, not against the best one, so that a language with
few labelled rows keeps its insults.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import Memo, Scratch, cut, map_batches

#: Labelled rows used for fitting, at most (those with the smallest hash of the id); the bound of the classifier's sample.
TRAIN_ROWS = 20_000
#: A learned stem (all of them go to the executors; the training rows bound them) lies in that many toxic rows, and its weight (log ratio) less so many standard errors reaches that of twice as often.
LEAST_ROWS, ERRORS, LEAST_WEIGHT = 4, 3.0, math.log(2)
STEM_CHARS = tuple(range(4, 11))
#: Ends a learned whole word.
END = " "
NEAR = 4
THRESHOLD = 0.3

CLAUSE = re.compile(r"([.,;:!?\n\r()\"“”«»]+)")
#: Marks over which a report goes on, and those that end it wherever they stand.
GOES_ON, ENDS = frozenset(":,\"“«"), frozenset(".!?;\n\r")
WORD = re.compile(r"[^\W\d_]+")

# Symbols of the lexical step.
INSULT = {"idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "vermin", "filth", "freak", "scumbag", "bastard", "idioten", "dummkopf", "abschaum", "imbécile", "ordure", "estúpido", "basura"}
THREAT = {"kill", "murder", "strangle", "stab", "shoot", "hang", "burn", "beat", "crush", "töten", "umbringen", "tuer", "matar"}
TARGET = {"you", "your", "yours", "they", "them", "these", "those", "he", "she", "him", "her", "du", "dich", "dein", "ihr", "euch", "tu", "toi", "ton", "vous", "tú", "usted", "ustedes", "ellos"}
NEGATION = {"not", "never", "no", "nobody", "isn", "aren", "wasn", "don", "doesn", "nicht", "nie", "kein", "keine", "pas", "jamais", "nunca", "jamás"}
INTENT = {"will", "gonna", "going", "shall", "ll", "must", "should", "werde", "werden", "sollte", "vais", "va", "allons", "voy", "vamos"}
OTHER = (".", 0.0)
REPORT = {"said", "says", "say", "called", "calls", "quoted", "quotes", "wrote", "writes", "claimed", "reported", "sagte", "nannte", "schrieb", "déclaré", "disait", "dijo", "escribió"}


@dataclass(frozen=True)
class Transducer:
    """Reads symbols; a state is a small number.  ``arcs``: symbol -> next state (others fall by one towards 0); a state over 0 marks what matches in it."""

    arcs: dict[str, int]
    holds: bool = False  # whether the state stays up to the clause's end

    def step(self, state: int, symbol: str) -> int:
        return max(self.arcs.get(symbol, 0), state if self.holds else state - 1, 0)


TARGETED = Transducer({"T": NEAR + 1})
NEGATED = Transducer({"N": NEAR + 1})
REPORTED = Transducer({"R": 1}, holds=True)
INTENDED = Transducer({"F": NEAR + 1})
FORWARD, BACKWARD = (TARGETED, NEGATED, REPORTED, INTENDED), (TARGETED,)
SYMBOLS = "IHFTNR."


def compose(parts: tuple[Transducer, ...] = FORWARD) -> dict[tuple, dict[str, tuple]]:
    """The product automaton, ``next[state][symbol]``, over the states reachable from the start; each part's state over 0 is its mark."""
    nexts, todo = {}, [(0,) * len(parts), tuple(int(p.holds) for p in parts)]
    while todo:
        state = todo.pop()
        if state in nexts:
            continue
        nexts[state] = {c: tuple(p.step(s, c) for p, s in zip(parts, state, strict=True)) for c in SYMBOLS}
        todo += nexts[state].values()
    return nexts


class Clause(NamedTuple):
    """Weights of what matched, by path; a negated report counts as negated.  ``words``: what is asserted."""

    asserted: float = 0.0
    targeted: float = 0.0  # the part of ``asserted`` that has a target
    negated: float = 0.0
    reported: float = 0.0
    words: tuple[str, ...] = ()


@dataclass
class Model:
    """Stems with weights, and the logistic model over :func:`features`; without ``composed``, the transducers are off and every match is asserted."""

    stems: dict[str, float] = field(default_factory=dict)
    coef: list[float] = field(default_factory=lambda: [-5.0, 1.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.0, 0.0])
    composed: bool = True


def stems_of(word: str) -> list[str]:
    """What can be learned from a word: the word itself and its stems."""
    return [word + END, *(word[:n] for n in STEM_CHARS if len(word) >= n)]


def lexicon(stems: dict[str, float]):
    """The lexical step: word -> (symbol, weight), through a bounded cache."""

    def look(word: str) -> tuple[str, float]:
        best = max(stems.get(s, 0.0) for s in stems_of(word))
        if word in INSULT or best:
            return "I", max(best, 3.0 if word in INSULT else 0.0)
        for symbol, group, weight in (("H", THREAT, 2.0), ("T", TARGET, 0.0), ("N", NEGATION, 0.0), ("R", REPORT, 0.0), ("F", INTENT, 0.0)):
            if word in group:
                return symbol, weight
        return OTHER

    return Memo(look, 200_000, chars=40)


def grammar(stems: dict[str, float], composed: bool = True):
    """A function from text to its matched clauses and the number of its words."""
    lex, forward, backward = lexicon(stems), compose(FORWARD), compose(BACKWARD)
    told = (0, 0, 1, 0)  # the state in which a report goes on

    def clause(found: list[str], state: tuple) -> Clause:
        symbols = [lex[w] for w in found]
        behind, after = (0,), []
        for symbol, _ in reversed(symbols):
            after.append(behind)
            behind = backward[behind][symbol]
        sums, words = [0.0] * 4, []
        for word, (symbol, weight), (target_after,) in zip(found, symbols, reversed(after), strict=True):
            target, negated, reported, intent = state
            target = target or target_after
            state = forward[state][symbol]
            if not weight:
                continue
            if not composed:
                target = negated = reported = 0
            elif symbol == "H" and not (target or intent):
                continue
            sums[2 if negated else 3 if reported else 0] += weight
            if not negated and not reported:
                sums[1] += weight if target else 0.0
                words.append(word)
        return Clause(*sums, tuple(words))

    def match(text: str | None) -> tuple[list[Clause], int]:
        low = (text or "").lower()
        every = WORD.findall(low)
        hits = {w for w in set(every) if lex[w][1]}
        if not hits:
            return [], len(every)
        found, report = [], False
        parts = CLAUSE.split(low)
        for part, mark in zip(parts[::2], [*parts[1::2], ""], strict=True):
            inside = WORD.findall(part)
            if not hits.isdisjoint(inside):
                c = clause(inside, told if report else (0, 0, 0, 0))
                if any(c[:4]):
                    found.append(c)
            says = report or not REPORT.isdisjoint(inside)
            report = says and not GOES_ON.isdisjoint(mark) and ENDS.isdisjoint(mark)
        return found, len(every)

    return match


def features(clauses: list[Clause], n_words: int) -> list[float]:
    """What the asserted clauses gather (sum, two highest, distinct words, rate), then each other path's sum."""
    asserted = sorted((c.asserted for c in clauses if c.asserted), reverse=True)
    top = [*asserted[:2], 0.0, 0.0]
    distinct = len({w for c in clauses for w in c.words})
    paths = [sum(c.targeted for c in clauses), sum(c.negated for c in clauses), sum(c.reported for c in clauses)]
    return [1.0, *(math.log1p(v) for v in (sum(asserted), top[0], top[1], distinct, 1000.0 * len(asserted) / max(n_words, 50), *paths))]


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``_text, _y`` of at most ``rows`` labelled documents outside the held-out quarter."""
    ids = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("_doc"), "_y"))
    # `ids` has at most `rows` rows of two numbers.
    return docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).join(F.broadcast(ids), "_doc").select("_text", "_y")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_stems(train: DataFrame) -> dict[str, float]:
    """Whole words and stems by how much oftener they occur in toxic rows."""

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        seen = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(b["_text"], b["_y"], strict=True):
                every = set(WORD.findall((text or "").lower()))
                seen[y].update({s for w in every for s in stems_of(w)})
                seen[y][""] += 1
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield from out(seen)
        yield from out(seen)

    def out(seen) -> Iterator[dict]:
        for y, c in seen.items():
            yield {"_stem": list(c), "_t": [n * y for n in c.values()], "_c": [n * (1 - y) for n in c.values()]}
            c.clear()

    # A text that was copied a thousand times is evidence once.
    train = train.where("_text IS NOT NULL").dropDuplicates(["_text", "_y"])
    sums = map_batches(train, work, "_stem string, _t bigint, _c bigint").groupBy("_stem").agg(F.sum("_t").alias("t"), F.sum("_c").alias("c"))
    sums = cut(sums.where("t > 0"), "stems")
    toxic = sums.where("_stem = ''").first()
    if toxic is None:
        return {}
    clean = train.where("_y = 0").count()
    if not clean:
        return {}
    weight = F.log(((F.col("t") + 0.5) / (toxic["t"] + 1.0)) / ((F.col("c") + 1.0) / (clean + 1.0)))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 1.0))
    ranked = sums.where((F.col("_stem") != "") & (F.col("t") >= LEAST_ROWS) & (weight - ERRORS * error >= LEAST_WEIGHT)).select("_stem", weight.alias("w"))
    kept = {r["_stem"]: r["w"] for r in ranked.collect()}  # stems of at most `rows` training rows
    # What a kept shorter stem of no less weight covers adds nothing.
    return {s: w for s, w in kept.items() if not any(kept.get(q, -1.0) >= w for q in stems_of(s.rstrip(END)) if len(q) < len(s))}


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, composed: bool = True) -> Model:
    """Learn stems and the logistic model from a bounded sample; without toxic or without other rows, the fixed lists and default weights serve."""
    with Scratch(docs.sparkSession):
        return _fit(cut(training_rows(docs, labels, rows), "toxic-train"), composed)


def _fit(train: DataFrame, composed: bool) -> Model:
    model = Model(learn_stems(train), composed=composed)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        match = grammar(model.stems, model.composed)
        for b in batches:
            yield {"x": [features(*match(t)) for t in b["_text"]], "y": b["_y"]}

    got = map_batches(train, work, "x array<double>, y int").collect()  # at most `rows` short rows
    y = np.array([r["y"] for r in got], float)
    if len(got) and 0 < y.sum() < len(y):
        model.coef = logistic(np.array([r["x"] for r in got]), y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> list[float]:
    """Ridge logistic regression by Newton's method, steps halved until the loss falls; the intercept carries hardly any ridge."""
    w, penalty = np.zeros(x.shape[1]), np.array([1e-3] + [ridge] * (x.shape[1] - 1))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        step = np.clip(step, -5, 5)
        while (new := loss(w + step)) > now and np.abs(step).max() >= 1e-8:
            step /= 2
        if np.abs(step).max() < 1e-8:
            break
        w, now = w + step, new
    return [float(v) for v in w]


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Score every whole text.

    Returns ``id_col, score`` (0 to 1), ``predicted`` (1 if ``score >=
    threshold``) and ``n_clauses`` (matched clauses, on any path), a row per input row; with
    ``keep``, instead, the rows of ``docs`` whose score is lower than the
    threshold, with all their columns.  Null and empty texts match no clause
    and get the lowest score.  Only the text is an input of the score.
    """
    def scored(texts: list, match) -> list[tuple[float, int]]:
        out = []
        for t in texts:
            found = match(t)
            z = float(np.dot(features(*found), model.coef))
            out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(found[0])))
        return out

    if keep:
        def few(batches: Iterator[dict]) -> Iterator[dict]:
            match = grammar(model.stems, model.composed)
            for b in batches:
                good = [i for i, (s, _) in enumerate(scored(b[text_col], match)) if s < threshold]
                yield {c: [v[i] for i in good] for c, v in b.items()}

        return map_batches(docs, few, docs.schema)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        match = grammar(model.stems, model.composed)
        for b in batches:
            got = scored(b["_text"], match)
            yield {"_id": b["_id"], "score": [s for s, _ in got], "n_clauses": [n for _, n in got]}

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), work, f"_id {kind}, score double, n_clauses bigint")
    return out.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses")
