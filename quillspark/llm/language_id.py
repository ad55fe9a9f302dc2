"""Language identification by a linear-chain conditional random field over words (operator 9).

Each word has affix, character n-gram and lexicon features (hashed); transitions between languages are learned, so the words of code-switched
texts get labels of their own by forward-backward (`word_labels`). A document's language is that of the largest share of word posteriors.
The model is fitted on a bounded sample: at most SAMPLE_DOCS labelled documents of each language and SPAN words of each. Prediction reads whole
texts. Forward-backward runs over all words of a batch at once: blocks of words are reduced to transfer matrices, which chain exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean, slices, thin_batches

SAMPLE_DOCS, SPAN, LEXICON, BITS, CACHE, GROUP = 400, 60, 1000, 16, 250_000, 4096
RUN_BYTES = 1 << 20
FOLDS, HELD = 4, 2
UND = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_FIXED = 8


def _cells(h: np.ndarray, kind: int) -> np.ndarray:
    """Places of 64-bit hashes of one kind among the hashed weights."""
    h = (h + np.uint64(kind) * _C) * _A
    return (((h ^ (h >> np.uint64(29))) * _B) >> np.uint64(64 - BITS)).astype(np.int64)


class Features:
    """Of each word: prefixes and suffixes of one to three letters, the word, its place in the lexicon (`fixed`, _FIXED columns); and its letter pairs and
    triples with both ends marked, for all words in turn, with the place where each word's begin."""

    def __init__(self, words: list[str], lexicon: dict[str, int], labels: int):
        low = [w.lower() for w in words]
        code = np.frombuffer("".join([f"^{w}$" for w in low]).encode("utf-32-le"), "<u4").astype(np.uint64)
        size = np.fromiter(map(len, low), np.int64, len(low))
        begin = np.cumsum(size + 2) - size - 2
        first, last = begin + 1, begin + size
        cells = []
        for side, kinds in ((1, (1, 2, 3)), (-1, (4, 5, 6))):
            h = np.zeros(len(low), np.uint64)
            for k, kind in enumerate(kinds):
                at = np.minimum(first + k, last) if side > 0 else np.maximum(last - k, first)
                h = np.where(size > k, (h + code[at]) * _B, h)
                cells.append(_cells(h, kind))
        power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(size.max()) + 1, _A))))
        place = np.arange(len(code)) - np.repeat(begin, size + 2)
        whole = np.add.reduceat(code * power[place], begin)
        cells.append(_cells(whole, 7))
        cells.append((1 << BITS) + np.fromiter((lexicon.get(w, labels) for w in low), np.int64, len(low)))
        self.fixed = np.stack(cells, 1)
        twos, threes = np.ones(len(code), bool), np.ones(len(code), bool)
        twos[last + 1] = threes[last + 1] = threes[last] = False
        pair = code[:-1] * _B + code[1:]
        self.pairs = _cells(pair, 8)[twos[:-1]]
        self.triples = _cells(pair[:-1] * _B + code[2:], 9)[threes[:-2]]
        self.n_pairs, self.n_triples = size + 1, size
        self.pair_begin, self.triple_begin = np.cumsum(self.n_pairs) - self.n_pairs, np.cumsum(self.n_triples) - self.n_triples

    def score(self, weights: np.ndarray) -> np.ndarray:
        grams = np.add.reduceat(weights[self.pairs], self.pair_begin, axis=0) + np.add.reduceat(weights[self.triples], self.triple_begin, axis=0)
        return weights[self.fixed].sum(1) + grams

    def add_to(self, grad: np.ndarray, per_word: np.ndarray) -> None:
        np.add.at(grad, self.fixed.ravel(), np.repeat(per_word, _FIXED, axis=0))
        np.add.at(grad, self.pairs, np.repeat(per_word, self.n_pairs, axis=0))
        np.add.at(grad, self.triples, np.repeat(per_word, self.n_triples, axis=0))


class Crf:
    """Weights of hashed features, lexicon features and transitions; labels in sorted order."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon = labels, lexicon
        n = len(labels)
        self.weights = np.zeros(((1 << BITS) + n + 1, n), np.float32)
        self.trans, self.start = np.zeros((n, n), np.float64), np.zeros(n, np.float64)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word, made for GROUP words at a time so that arrays of features stay short."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        parts = (words[lo : lo + GROUP] for lo in range(0, len(words), GROUP))
        return np.concatenate([Features(part, self.lexicon, len(self.labels)).score(self.weights) for part in parts])

    def fit(self, spans: list[tuple[list[str], int]], rounds: int = 40, rate: float = 0.3, l2: float = 1e-4, seed: int = 7) -> Crf:
        """Full-batch AdaGrad on spans of equal labels, half of them joined in pairs so that transitions are seen."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(spans))
        half, seqs = len(order) // 2 // 2 * 2, []
        for a, b in zip(order[0:half:2], order[1:half:2]):
            (wa, ya), (wb, yb) = spans[a], spans[b]
            ca, cb = -(-len(wa) // 2), -(-len(wb) // 2)
            seqs.append((wa[:ca] + wb[:cb], [ya] * ca + [yb] * cb))
        seqs += [(w, [y] * len(w)) for w, y in (spans[i] for i in order[half:])]
        seqs = [s for s in seqs if s[0]]
        if not seqs:
            return self
        vocab = {w: i for i, w in enumerate(dict.fromkeys(w for s, _ in seqs for w in s))}
        feats = Features(list(vocab), self.lexicon, len(self.labels))
        steps, n = max(len(s) for s, _ in seqs), len(self.labels)
        ids, gold = np.full((len(seqs), steps), -1), np.full((len(seqs), steps), -1)
        for k, (s, y) in enumerate(seqs):
            ids[k, : len(s)], gold[k, : len(s)] = [vocab[w] for w in s], y
        live, total = ids >= 0, (ids >= 0).sum()
        onehot = np.eye(n)[np.maximum(gold, 0)] * live[:, :, None]
        sums = [np.zeros_like(self.weights, np.float64), np.full_like(self.trans, 1e-8), np.full_like(self.start, 1e-8)]
        sums[0] += 1e-8
        for _ in range(rounds):
            e = feats.score(self.weights)[np.maximum(ids, 0)].astype(np.float64)
            e = np.exp(e - e.max(2, keepdims=True))
            t = np.exp(self.trans)
            alpha, beta = np.empty_like(e), np.ones_like(e)
            a = np.exp(self.start) * e[:, 0]
            alpha[:, 0] = a / a.sum(1, keepdims=True)
            for k in range(1, steps):
                a = np.where(live[:, k, None], (alpha[:, k - 1] @ t) * e[:, k], alpha[:, k - 1])
                alpha[:, k] = a / a.sum(1, keepdims=True)
            for k in range(steps - 2, -1, -1):
                b = np.where(live[:, k + 1, None], (e[:, k + 1] * beta[:, k + 1]) @ t.T, 1.0)
                beta[:, k] = b / b.sum(1, keepdims=True)
            post = alpha * beta
            post = post / post.sum(2, keepdims=True) * live[:, :, None]
            diff = post - onehot
            per_word = np.zeros((len(vocab), n))
            np.add.at(per_word, ids[live], diff[live])
            grad_w = np.zeros_like(self.weights, np.float64)
            feats.add_to(grad_w, per_word)
            pair = alpha[:, :-1, :, None] * t * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair = pair / np.maximum(pair.sum((2, 3), keepdims=True), 1e-300) * live[:, 1:, None, None]
            seen = (onehot[:, :-1, :, None] * onehot[:, 1:, None, :]).sum((0, 1))
            for value, grad, s in ((self.weights, grad_w, sums[0]), (self.trans, pair.sum((0, 1)) - seen, sums[1]), (self.start, diff[:, 0].sum(0), sums[2])):
                grad = grad / total + l2 * value / total
                s += grad * grad
                value -= (rate * grad / np.sqrt(s)).astype(value.dtype)
        return self

    def posteriors(self, emissions: np.ndarray, first: np.ndarray, blocks: int | None = None) -> np.ndarray:
        """Marginals of each word. first: true where a text begins. Exact for any number of blocks; as many as a block has words cost least."""
        total, n = emissions.shape
        if not total:
            return emissions
        width = -(-total // min(blocks or int(total**0.5) + 1, max(1, total // 16)))
        count = -(-total // width)
        pad = count * width - total
        e = np.exp(emissions - emissions.max(1, keepdims=True)).astype(np.float32)
        e = np.concatenate((e, np.ones((pad, n), np.float32))).reshape(count, width, n)
        cut = np.concatenate((first, np.ones(pad, bool))).reshape(count, width)
        t, start = np.exp(self.trans).astype(np.float32), np.exp(self.start - self.start.max()).astype(np.float32)
        reach = np.broadcast_to(np.eye(n, dtype=np.float32), (count, n, n))
        e, cut = np.ascontiguousarray(e.transpose(1, 0, 2)), np.ascontiguousarray(cut.T)
        for s in range(width):
            step = np.where(cut[s][:, None, None], reach.sum(2, keepdims=True) * start, reach @ t) * e[s][:, None, :]
            reach = step / step.max((1, 2), keepdims=True)
        enter, leave = np.empty((count, n), np.float32), np.empty((count, n), np.float32)
        v = np.ones(n, np.float32) / n
        for k in range(count):
            enter[k] = v
            v = v @ reach[k]
            v = v / v.sum()
        v = np.ones(n, np.float32)
        for k in range(count - 1, -1, -1):
            leave[k] = v
            v = reach[k] @ v
            v = v / v.max()
        alpha = np.empty_like(e)
        a = enter
        for s in range(width):
            a = np.where(cut[s][:, None], start, a @ t) * e[s]
            a = a / a.sum(1, keepdims=True)
            alpha[s] = a
        b = leave
        # leave[k] already holds what follows block k, its transition included, for the state after the block's last word
        for s in range(width - 1, -1, -1):
            alpha[s] *= b
            inner = np.where(cut[s][:, None], (start * e[s] * b).sum(1, keepdims=True), (e[s] * b) @ t.T)
            b = inner / inner.max(1, keepdims=True)
        out = alpha.transpose(1, 0, 2).reshape(-1, n)[:total]
        return out / out.sum(1, keepdims=True)


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def fit_crf(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Crf:
    """documents (doc_id, text, lang) -> Crf fitted on labelled documents that aren't held out, at most about sample_docs of each language.

    Every lang value becomes a label; memory grows with their number and, in forward-backward, with its square."""
    own = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not counts:
        return Crf([], {})
    share = F.create_map(*(x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / v)))))
    roll = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000)) / 1_000_000
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1000)) / 1000
    room = F.greatest(F.length("text") - 20 * SPAN, F.lit(0))
    part = F.substring(F.col("text"), (1 + start * room).cast("int"), F.lit(20 * SPAN))
    chosen = own.where(F.element_at(share, F.col("lang")) > roll).select("lang", "doc_id", part.alias("text"))
    rows = chosen.limit(2 * sample_docs * len(counts)).collect()
    labels = sorted(counts)
    spans = sorted((r["doc_id"] is None, r["doc_id"] or 0, words_of(r["text"])[:SPAN], labels.index(r["lang"])) for r in rows)
    spans = [(w, y) for _, _, w, y in spans if w]
    freq = [Counter() for _ in labels]
    for w, y in spans:
        freq[y].update(x.lower() for x in w)
    lexicon: dict[str, int] = {}
    for y, c in enumerate(freq):
        for w, k in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if k >= 2 and all(4 * freq[z][w] < k for z in range(len(labels)) if z != y):
                lexicon[w] = y
    return Crf(labels, lexicon).fit(spans)


def _posteriors(model: Crf):
    """Over batches and the number of their text column: runs of rows with their words, how many each row has, where they begin, and the posteriors."""
    memory: dict = {}

    def run(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
        n = len(model.labels)
        known: dict[str, int] = memory.get("known", {})
        table = memory.get("table", np.zeros((1 << 16, n), np.float32))
        for batch in slices(batches, column, RUN_BYTES):
            words = [words_of(t or "") if n else [] for t in batch.column(column).to_pylist()]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            # each distinct word of the run is looked up once
            coded = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(known) > CACHE:
                known = {}
            fresh = [w for w in distinct if w not in known]
            if fresh:
                lo = len(known)
                while lo + len(fresh) > len(table):
                    table = np.concatenate((table, np.zeros_like(table)))
                table[lo : lo + len(fresh)] = model.emissions(fresh)
                known.update(zip(fresh, range(lo, lo + len(fresh))))
            number = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
            flat = number[coded.indices.to_numpy(zero_copy_only=False)]
            begin = np.cumsum(sizes) - sizes
            first = np.zeros(len(flat), bool)
            first[begin[sizes > 0]] = True
            memory.update(known=known, table=table)
            yield batch, words, sizes, begin, model.posteriors(table[flat], first)

    return run


def _predict(model: Crf):
    """Rows (doc_id, held_out, text) -> doc_id, held_out, lang_pred, score."""
    posteriors = _posteriors(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, sizes, begin, post in posteriors(batches, 2):
            langs, scores = [], []
            for text, lo, size in zip(batch.column(2).to_pylist(), begin.tolist(), sizes.tolist()):
                share = post[lo : lo + size].mean(0) if size else None
                if share is None or not any(map(str.isalpha, text)):
                    langs.append(UND)
                    scores.append(0.0)
                else:
                    langs.append(model.labels[int(share.argmax())])
                    scores.append(min(1.0, float(share.max())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def word_labels(documents: DataFrame, model: Crf | None = None) -> DataFrame:
    """documents (doc_id, text, lang, ...) -> doc_id, at (place of the word from 0), word, label, posterior: a row for each word of letters, by
    forward-backward over the whole text, so that the words of code-switched texts get labels of their own.

    Null texts and texts without letters give no rows, nor does a table without any labelled document; repeated rows give theirs each. Other columns
    are ignored."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = model or fit_crf(docs)
    posteriors = _posteriors(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, sizes, begin, post in posteriors(batches, 1):
            if not len(post):
                continue
            row, best = np.repeat(np.arange(len(sizes)), sizes), post.argmax(1)
            at = np.arange(len(row)) - np.repeat(begin, sizes)
            cols = [
                batch.column(0).take(pa.array(row)), pa.array(at, pa.int32()), pa.array(list(chain.from_iterable(words)), pa.string()), pa.array(model.labels).take(pa.array(best)),
                pa.array(post.max(1).astype(np.float64)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "at", "word", "label", "posterior"])

    return thin_batches(docs).select("doc_id", "text").mapInArrow(lean("language_id", run), "doc_id long, at int, word string, label string, posterior double")


def identify_languages(documents: DataFrame, model: Crf | None = None) -> DataFrame:
    """documents (doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score; one row for each row. lang is read for fitting alone.

    Null texts and texts without a letter are `und` with score 0, as are all where no labelled document exists. Repeated rows get equal
    results; an empty table gives an empty result. Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = model or fit_crf(docs)
    return thin_batches(docs).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lean("language_id", _predict(model)), "doc_id long, held_out boolean, lang_pred string, score double")


REJECT_BELOW = 0.3


def with_known_language(documents: DataFrame, reject_below: float = REJECT_BELOW, model: Crf | None = None) -> DataFrame:
    """documents without those of which no language can be told: texts without letters, and texts whose best language has under reject_below of
    the word posteriors (near an even split of four; with more languages the bound falls as their even split does). Where no labelled document
    exists, only texts without letters are left out. All columns stay."""
    model = model or fit_crf(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    at = documents.columns.index("text")
    predict = _predict(model)
    least = reject_below * 4 / max(4, len(model.labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not model.labels:
                yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in batch.column(at).to_pylist()], pa.bool_()))
                continue
            plain = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), batch.column(at)], names=["doc_id", "held_out", "text"])
            good = [lang != UND and score >= least for out in predict(iter([plain])) for lang, score in zip(out.column(2).to_pylist(), out.column(3).to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))

    return thin_batches(documents).mapInArrow(lean("language_id", run), documents.schema)
