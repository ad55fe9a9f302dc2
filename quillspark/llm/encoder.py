"""Token ids of whole columns of texts, shared by the operators that count or pack tokens."""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

CACHE = 600_000
#: Signs that the tokenizer cuts off behind a letter or digit, apostrophes (parts of contractions) and angle brackets (of special tokens) left out.
TAIL = b".,!?;:#*$%&"


class Ids:
    """Runs of token ids, one after the other in one growing array; a run is known by its number."""

    def __init__(self):
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append runs of the given sizes; the number of the first."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(self.used + 2 * len(ids), np.uint32)))
        if self.count + len(sizes) > len(self.start):
            room = np.empty(self.count + 2 * len(sizes), np.int64)
            self.start, self.size = np.concatenate((self.start[: self.count], room)), np.concatenate((self.size[: self.count], room))
        first, upto = self.count, self.count + len(sizes)
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first:upto], self.size[first:upto] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.count = self.used + len(ids), upto
        return first

    def joined(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs in turn, and the size of each run."""
        size = self.size[runs]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[runs] - ends + size, size)
        return self.flat[at], size


class WordTokenizer:
    """Ids of a lower-casing tokenizer with word ends whose pieces never span white space, remembered by word.

    Texts are cut at ASCII white space and dictionary-encoded as Arrow columns, so each distinct word of a batch is looked up once and ids are
    gathered by number. A new word is looked up without capitals and the signs of TAIL at its end, which are pieces of their own behind a letter or
    digit; letters-only words are encoded many at a time and told apart by their word ends. About CACHE words are remembered at a time; beyond
    that those that fewest batches had are forgotten.
    """

    GROUP = 200

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, int] = {}
        self.ids, self.hits = Ids(), np.zeros(1 << 14, np.uint32)

    def _forget(self) -> None:
        """Keep the words that more batches had, half of CACHE at most."""
        words, numbers = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        hits, least = self.hits[numbers], 2
        while (hits >= least).sum() > CACHE // 2:
            least += 1
        stay = np.flatnonzero(hits >= least)
        ids, sizes = self.ids.joined(numbers[stay])
        self.known, self.ids, self.hits = {}, Ids(), np.zeros(1 << 14, np.uint32)
        self._keep([words[i] for i in stay.tolist()], [ids], [sizes])

    def _keep(self, words: list[bytes], ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        if words:
            first = self.ids.add(np.concatenate(ids), np.concatenate(sizes))
            self.known.update(zip(words, range(first, first + len(words))))

    def _encode(self, words: list[bytes]) -> None:
        """Remember the ids of words that the tokenizer sees as they are."""
        texts = [w.decode() for w in words]
        plain = [(w, t) for w, t in zip(words, texts) if t.isalpha()]
        rest = [(w, t) for w, t in zip(words, texts) if not t.isalpha()]
        groups = [plain[i : i + self.GROUP] for i in range(0, len(plain), self.GROUP)]
        done, ids, sizes = [], [], []
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join([t for _, t in g]) for g in groups], add_special_tokens=False)):
            own = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(self.ends[own]) + 1
            if len(stops) != len(group) or stops[-1] != len(own):
                rest += group
            else:
                done += [w for w, _ in group]
                ids.append(own)
                sizes.append(np.diff(stops, prepend=0))
        for lo in range(0, len(rest), 10_000):
            part = rest[lo : lo + 10_000]
            own = [e.ids for e in self.tokenizer.encode_batch([t for _, t in part], add_special_tokens=False)]
            done += [w for w, _ in part]
            ids.append(np.fromiter((i for x in own for i in x), np.uint32))
            sizes.append(np.fromiter(map(len, own), np.int64))
        self._keep(done, ids, sizes)

    def _learn(self, words: list[bytes]) -> None:
        known, new, twin, twin_of, cut, halves = self.known, {}, [], [], [], []
        for w in words:
            core = w if b"<" in w else w.lower()
            stem = core.rstrip(TAIL)
            if stem == core or not stem[-1:].isalnum():
                stem = core
            else:
                halves += (stem, core[len(stem) :])
                cut.append(w)
                if halves[-1] not in known:
                    new[halves[-1]] = None
            if stem not in known:
                new[stem] = None
            if stem is core and core != w:
                twin.append(w)
                twin_of.append(core)
        self._encode(list(new))
        if twin:
            known.update(zip(twin, [known[c] for c in twin_of]))
        if cut:
            ids, size = self.ids.joined(np.fromiter(map(known.__getitem__, halves), np.int64, len(halves)))
            self._keep(cut, [ids], [size.reshape(-1, 2).sum(1)])

    def runs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers in `ids` of the words of all texts in turn, where each text's words begin and end). Null texts are empty."""
        if len(self.known) > CACHE:
            self._forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        empty = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) == 0
        holes = np.flatnonzero((found < 0) & ~empty)
        if len(holes):
            fresh = [words[i] for i in holes.tolist()]
            self._learn(fresh)
            found[holes] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        if len(self.hits) < self.ids.count:
            self.hits = np.concatenate((self.hits, np.zeros(2 * self.ids.count, np.uint32)))
        self.hits[found[~empty]] += 1
        numbers = found[coded.indices.to_numpy(zero_copy_only=False)]
        offsets = split.offsets.to_numpy().astype(np.int64)
        if empty.any():
            # white space at the ends of a text leaves empty words there
            full = numbers >= 0
            offsets, numbers = np.concatenate(([0], np.cumsum(full)))[offsets], numbers[full]
        return numbers, offsets

    def lengths(self, texts: pa.Array) -> np.ndarray:
        numbers, offsets = self.runs(texts)
        return np.diff(np.concatenate(([0], np.cumsum(self.ids.size[numbers])))[offsets])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, each closed by end_id, where each text's ids begin and end)."""
        numbers, offsets = self.runs(texts)
        ids, size = self.ids.joined(numbers)
        begin = np.concatenate(([0], np.cumsum(size)))[offsets]
        return np.insert(ids, begin[1:], end_id).astype("<u4"), begin + np.arange(len(begin))


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this process: words that a worker learns in one task serve its next ones."""
    return kept("tokens", path, lambda: WordTokenizer(path))
