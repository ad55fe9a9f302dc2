"""Toxicity scores (operator 7).

A lexicon of terms that mark toxic texts is learned from labelled rows. Its trie is intersected with Levenshtein automata of distance one; the
product is determinised lazily, so a word costs one table step per letter until no term is near. Hits are weighed in a window of their context:
quotation marks and reporting words around a term make it quotation, address words make it abuse. A logistic regression turns the sums into scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean, slices, staged, thin_batches

SAMPLE_DOCS, TERMS, LEAST_DOCS, LEAST_RATIO, WINDOW, CACHE = 20_000, 4000, 4, 12.0, 5, 500_000
STEMS = (5, 6)
FOLDS, HELD = 5, 0
REPORTING = frozenset("said says wrote writes called quote quoted quoting word term reported claims claimed dit écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your yours u tu toi vous du dich ihr tú usted eres vosotros".split())
FEATURES = 8
#: Log odds of the prior where labels don't tell: texts are taken as not toxic.
PRIOR = 4.0

_WORD = re.compile(r"\w+")
_QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}


class TrieAutomaton:
    """Terms within one edit of a word, by a lazily determinised product of the terms' trie and a Levenshtein automaton.

    A state is the set of (trie node, edits so far). Terms shorter than FUZZY_FROM letters match exactly only; a term that ends in * is a stem
    and matches every word that begins with it, without edits.
    """

    FUZZY_FROM = 5

    def __init__(self, terms: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.longest = [0]
        self.stem: dict[int, int] = {}
        for k, t in enumerate(terms):
            node, path, stem = 0, [0], t.endswith("*")
            t = t.rstrip("*")
            for c in t:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.term.append(-1)
                    self.longest.append(0)
                node = self.child[node][c]
                path.append(node)
            if stem:
                self.stem[node] = k
                continue
            self.term[node] = k
            for x in path:
                self.longest[x] = max(self.longest[x], len(t))
        self.size = [len(t) for t in terms]
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stems: list[int | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, nodes: set) -> int:
        """Skipping a letter of the term costs an edit; a node with an edit is dropped where the same node has none."""
        for node, e in list(nodes):
            if e == 0 and self.longest[node] >= self.FUZZY_FROM:
                nodes |= {(x, 1) for x in self.child[node].values()}
        key = frozenset((n, e) for n, e in nodes if e == 0 or (n, 0) not in nodes)
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and (e == 0 or self.size[self.term[n]] >= self.FUZZY_FROM)]
            self.accepts.append(min(ends, default=None))
            self.stems.append(min((self.stem[n] for n, e in key if e == 0 and n in self.stem), default=None))
        return self.states[key]

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, the first of equals; None beyond one edit."""
        state = self.start
        for c in word:
            if (to := self.moves[state].get(c)) is None:
                new = set()
                for node, e in self.sets[state]:
                    kids = self.child[node]
                    if c in kids:
                        new.add((kids[c], e))
                    if e == 0 and self.longest[node] >= self.FUZZY_FROM:
                        new.add((node, 1))
                        new |= {(x, 1) for x in kids.values()}
                to = self.moves[state][c] = self._state(new)
            state = to
            if state < 0:
                return None
            if self.stems[state] is not None:
                return 0, self.stems[state]
        return self.accepts[state]


class Model:
    def __init__(self, terms: list[str], weights: list[float]):
        self.terms, self.weights = terms, weights
        self.beta, self.bias = np.zeros(FEATURES), -PRIOR

    def featurise(self, text: str, words: list[str], found: list[tuple | None]) -> list[float]:
        """Log sums of exact, misspelled, quoted and addressed hits, distinct terms, density, the best weight, and text length."""
        exact = fuzzy = quoted = aimed = best = 0.0
        terms = set()
        if any(found):
            spans = [m.span() for m in _WORD.finditer(text)]
            for i, hit in enumerate(found):
                if not hit:
                    continue
                edits, term = hit
                w = self.weights[term]
                around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
                lo, hi = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
                before, after = text[lo : spans[i][0]], text[spans[i][1] : hi]
                if any(a in before and b in after for a, b in _QUOTES.items()) or not REPORTING.isdisjoint(around):
                    quoted += 1
                    continue
                terms.add(term)
                best = max(best, w * (1 - 0.5 * edits))
                exact, fuzzy = exact + (not edits) * w, fuzzy + bool(edits) * w
                aimed += not ADDRESS.isdisjoint(around)
        hits = sum(1 for x in found if x)
        return [float(x) for x in (np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), np.log1p(aimed), np.log1p(len(terms)), 20 * hits / (20 + len(words)), best, 0.1 * np.log1p(len(words)))]

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, l2: float = 1e-2) -> Model:
        """Newton steps with a ridge."""
        if not len(y) or y.min() == y.max():
            self.bias = -PRIOR if not len(y) or y.max() == 0 else PRIOR
            return self
        a = np.column_stack((x, np.ones(len(x))))
        b = np.zeros(a.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + l2 * np.eye(len(b)), a.T @ (y - p) - l2 * b)
            b += step
            if np.abs(step).max() < 1e-6:
                break
        self.beta, self.bias = b[:-1], float(b[-1])
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.beta + self.bias, -30, 30)))


def _featured(model: Model, finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TrieAutomaton(model.terms)
        known: dict[str, tuple | bool] = {}
        for batch in slices(batches, 2, 1 << 21):
            out = []
            for text in batch.column(2).to_pylist():
                text = (text or "").lower()
                words = _WORD.findall(text)
                found = list(map(known.get, words))
                if None in found:
                    if len(known) > CACHE:
                        known = {}
                    for i, hit in enumerate(found):
                        if hit is None:
                            w = words[i]
                            if w not in known:
                                known[w] = automaton.match(w) or False
                            found[i] = known[w]
                out.append(model.featurise(text, words, found))
            yield finish(batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.array(out).reshape(batch.num_rows, FEATURES))

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w for w in _WORD.findall(text.lower()) if len(w) >= 3}
            counts[toxic].update(words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k})
        words = list(counts[0] | counts[1])
        bad, good = (pa.array([counts[k][w] for w in words], pa.int64()) for k in (1, 0))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), bad, good], names=["word", "bad", "good"])


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def fit_toxicity(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fitted on at most about sample_docs labelled rows that aren't held out: half of them for the lexicon, half for the regression.

    The ids of the sample, whose number sample_docs bounds at any input size, are broadcast to the documents, so no text is shuffled; the
    sampled rows are written once. Without labels the model has no terms and the prior of texts that aren't toxic."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marks = staged(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out()), "marks")
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if not counts:
        return Model([], [])
    share = F.when(F.col("toxic") == 1, min(1.0, sample_docs / 2 / counts.get(1, 1))).otherwise(min(1.0, sample_docs / 2 / counts.get(0, 1)))
    roll = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_000)) / 1_000_000
    chosen = staged(marks.where(share > roll).withColumn("half", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(2))), "chosen")
    # a hash decides who is drawn; should it ever draw far more than asked for, the join shuffles instead
    small = F.broadcast(chosen) if chosen.count() <= 2 * sample_docs else chosen
    rows = staged(documents.where("text is not null").join(small, "doc_id").select("toxic", "half", "text"), "sample")
    size = {r["toxic"]: r["count"] for r in rows.where("half = 0").groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0) + 1.0, size.get(0, 0) + 1.0
    ratio = ((F.col("bad") + 0.1) / bad) / ((F.col("good") + 0.1) / good)
    words = rows.where("half = 0").select("toxic", "text").mapInArrow(lean("toxicity", _word_counts), "word string, bad long, good long")
    words = words.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= LEAST_DOCS)
    best = words.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("bad"), "word").limit(TERMS).collect()
    top = sorted((r["word"], float(np.log(r["ratio"]) / np.log(LEAST_RATIO))) for r in best)
    model = Model([w for w, _ in top], [min(4.0, s) for _, s in top])

    def finish(_, toxic, x):
        return pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), *(pa.array(x[:, k]) for k in range(FEATURES))], names=["y", *(f"f{k}" for k in range(FEATURES))])

    schema = "y int, " + ", ".join(f"f{k} double" for k in range(FEATURES))
    sample = rows.where("half = 1").select(F.lit(None).cast("long").alias("doc_id"), "toxic", "text")
    got = sample.mapInArrow(lean("toxicity", _featured(model, finish)), schema).toPandas()
    return model.fit(got.drop(columns="y").to_numpy(float), got["y"].to_numpy(float))


def score_toxicity(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """documents (doc_id, text, ...), labels (doc_id, toxic, ...) -> doc_id, held_out, score, predicted; one row for each document row.

    Null and empty texts have no hits and get the score of such texts. Without labels, and with labels that are all 0, every text gets the prior of
    texts that aren't toxic: a score of 0.018, predicted 0. Repeated rows get equal results; repeated labels count once, a toxic one wins; an empty
    table gives an empty result. Texts are read whole. Other columns are ignored.
    """
    docs = thin_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = model or fit_toxicity(docs, labels)

    def finish(ids, held, x):
        s = model.score(x)
        cols = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    scored = docs.select("doc_id", held_out().alias("held_out"), "text")
    return scored.mapInArrow(lean("toxicity", _featured(model, finish)), "doc_id long, held_out boolean, score double, predicted int")
