"""N-gram Jaccard join (operator 1).

Exact set-similarity join on 5-word shingles. Documents with equal sets form one class. Classes meet in tiles: one tile holds the
classes of one size band (and the next) that share a shingle of their prefix, the shingles being ordered from rare to frequent. In a tile, hashed
bitmap signatures bound each overlap from above by bit counts; only pairs that the bound admits reach the exact intersection of sorted arrays.
Shingles are 64-bit hashes and classes 128-bit ones, so "exact" and "equal" hold up to their collisions.

Completeness: sets with J >= t share one of the first n - ceil(t n) + 1 shingles under any total order, and their sizes lie in the same or in
neighbouring bands. The order comes from a count sketch of fixed size (`SKETCH_BITS`), so what is broadcast does not grow with the data; a
coarse sketch costs time, never links. Round 1 verifies a spanning forest of each tile's admitted pairs; round 2 verifies all admitted
pairs whose classes are still in different components. Pairs inside a component cannot change it, so none need be made.

Hot shingles: rows of a shingle in a cell of the sketch that is above its mean go by (shingle, salt), so no step gathers one shingle's rows in one
task. A group of more than TILE classes is dealt at random to tiles of about 3/4 TILE, twice over with different dealings: mutual near copies
become one component in work that grows with their number. Classes that stay apart are compared by bitmaps, tile against tile; that
alone is quadratic in the classes of one shingle and band that are not linked.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.column import Column

from .common import free_name, lean, shuffles_end, slices, staged, thin_batches, unstage
from .graph import components

WORDS, PERCENT = 5, 80
SKETCH_BITS, SKETCH_BLOCKS = 20, 16
TILE, SALTS = 1024, 16
LONG_TEXT = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(WORDS)], dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        full = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        full[0] = 1
        _powers[key] = np.multiply.accumulate(full)
    return _powers[key][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beginnings, hashes, hashes of WORDS words from each on) of the words of lower-cased bytes that end in white space."""
    space = _SPACE[buf]
    word = ~space
    begins = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(word[:-1] & space[1:]) + 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), dtype=np.uint64)))
    words = _mix((total[ends] - total[begins]) * _power(_INVERSE, len(buf))[begins])
    n = len(words)
    grams = np.zeros(0, np.uint64)
    if n >= WORDS:
        grams = words[: n - WORDS + 1] * _STEP[0]
        for k in range(1, WORDS):
            grams = grams + words[k : n - WORDS + 1 + k] * _STEP[k]
        grams = _mix(grams)
    return begins, words, grams


def _long_set(text: bytes) -> np.ndarray:
    """The set of a long text, made piece by piece: what is held at a time is some 40 bytes for each byte of a piece. Pieces end in white space and
    begin WORDS - 1 words before the end of the piece before, so that every shingle lies in one."""
    text, found, at, size = text.lower(), [], 0, LONG_TEXT // 2
    while True:
        blank = _BLANK.search(text, at + size) if at + size < len(text) else None
        stop = blank.start() if blank else len(text)
        begins, words, grams = _grams(np.frombuffer(text[at:stop] + b"\n", np.uint8))
        if stop == len(text):
            if not found and len(words) < WORDS:
                return _few(words)
            return np.unique(np.concatenate([*found, grams]))
        if len(words) < WORDS + 1:
            size *= 2
            continue
        found.append(np.unique(grams))
        at += int(begins[1 - WORDS])


def _few(words: np.ndarray) -> np.ndarray:
    n = len(words)
    return _mix((words * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the WORDS-word shingles of each text; a shorter text is one shingle, an empty one none."""
    if len(texts) == 1 and len(texts[0]) > LONG_TEXT:
        return [_long_set(texts[0])]
    begins, words, grams = _grams(np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8))
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(begins, at)
    return [np.unique(grams[lo : hi - WORDS + 1]) if hi - lo >= WORDS else _few(words[lo:hi]) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist())]


def class_of(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits as two numbers."""
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def bitmap_of(hashes: np.ndarray) -> bytes:
    """A power of two of bits, at least four for each shingle: bit (hash mod size), so that halving a bitmap is an OR of its halves."""
    bits = 1 << max(6, int(4 * len(hashes) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, column, 1 << 19):
        yield batch, shingle_sets([t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()])


_MARKED = [("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bits", pa.binary()), ("block", pa.int32())]
_MARKED_TYPE = "doc_id long, th long, n_shingles long, h1 long, h2 long, bits binary, block int"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, held, n_held = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
    shift = np.uint64(64 - SKETCH_BITS)
    schema = pa.schema(_MARKED)

    def flush() -> None:
        nonlocal counts, held, n_held
        if held:
            counts += np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            held, n_held = [], 0

    for batch, sets in _texts(batches, 2):
        classes = [class_of(s) if len(s) else (None, None) for s in sets]
        cols = [batch.column(0), batch.column(1), [len(s) for s in sets], [c[0] for c in classes], [c[1] for c in classes], [bitmap_of(s) if len(s) else None for s in sets], [None] * len(sets)]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(cols, _MARKED)], schema=schema)
        held += sets
        n_held += sum(map(len, sets))
        if n_held > 1 << 19:
            flush()
    flush()
    if counts.any():
        parts = np.split(np.minimum(counts, 65535).astype("<u2"), SKETCH_BLOCKS)
        empty = pa.nulls(SKETCH_BLOCKS, pa.int64())
        bits, block = pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(range(SKETCH_BLOCKS), pa.int32())
        yield pa.RecordBatch.from_arrays([empty] * 5 + [bits, block], schema=schema)


def _sum_blocks(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(bits, width).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in sums.values()], pa.binary())], names=["block", "bits"])

    return run


def _levels(marked: DataFrame) -> bytes:
    """Rarity level of each sketch cell: 0 up to four times the mean, then one more for each doubling. 2**SKETCH_BITS bytes at any size."""
    once = marked.where("block is not null").select("block", "bits").mapInArrow(_sum_blocks("<u2"), "block int, bits binary")
    with shuffles_end(marked.sparkSession):
        rows = once.repartition(SKETCH_BLOCKS, "block").mapInArrow(_sum_blocks("<u4"), "block int, bits binary").collect()
    cells = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS))
    for r in rows:
        cells[r["block"]] = np.frombuffer(bytes(r["bits"]), "<u4")
    cells = cells.ravel()
    return np.clip(np.floor(np.log2(np.maximum(cells, 1) / max(1.0, 4 * cells.mean()))) + 1, 0, 40).astype(np.uint8).tobytes()


def _class_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Over rows (cls, h1, h2, text): the classes and sets of those rows whose text is of that class."""
    for batch, sets in _texts(batches, 3):
        known = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets)
        own = [(c, s) for c, h1, h2, s in known if class_of(s) == (h1, h2)]
        yield [c for c, _ in own], [s for _, s in own]


def _prefixes(levels: bytes, percent: int):
    """key, cls, and in one number, as a shuffled row has 8 bytes for each: 256 n (size of the set) + salt (0 but for keys of cells above the mean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels, np.uint8)
        for own, sets in _class_sets(batches):
            out = []
            for c, s in zip(own, sets):
                take = len(s) - -(-percent * len(s) // 100) + 1
                rarity = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(rarity, kind="stable")[:take]
                salt = np.where(rarity[order] > 0, c % SALTS + 1, 0)
                out.append((s[order].view(np.int64), np.full(take, c, np.int64), len(s) * 256 + salt))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "cls", "of"])

    return run


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own, sets in _class_sets(batches):
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "hashes"])


def _stack(bits: list[bytes]) -> np.ndarray:
    least = min(map(len, bits))
    rows = []
    for b in bits:
        row = np.frombuffer(b, "<u8")
        while row.nbytes > least:
            row = row[: len(row) // 2] | row[len(row) // 2 :]
        rows.append(row)
    return np.stack(rows)


def admitted(sizes: np.ndarray, bits: np.ndarray, i: int, later: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows `later`, those whose overlap with row i may reach the threshold by size and by bit counts, and the bound on that overlap."""
    later = later[(sizes[later] * 100 >= percent * sizes[i]) & (sizes[i] * 100 >= percent * sizes[later])]
    both = sizes[later] + sizes[i]
    if not len(later):
        return later, both
    most = (both - np.bitwise_count(bits[later] ^ bits[i]).sum(1, dtype=np.int64)) // 2
    ok = (100 + percent) * most >= percent * both
    return later[ok], most[ok] / both[ok]


def _tile_pairs(rows: list[tuple], forest: bool, percent: int) -> list[tuple[int, int]]:
    """rows: (cls, n, bits, guest, comp, side). Pairs need a host, different components and, if sides differ at all, different sides."""
    rows = list({r[0]: r for r in sorted(rows, key=lambda r: -r[3])}.values())
    if len(rows) < 2:
        return []
    cls, sizes = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
    guest, side = np.array([r[3] for r in rows], bool), np.array([r[5] for r in rows])
    comp, bits = np.array([r[4] for r in rows], np.int64), _stack([r[2] for r in rows])
    mixed = side.min() != side.max()
    found = []
    for i in range(len(rows) - 1):
        later = np.arange(i + 1, len(rows))
        later = later[(comp[later] != comp[i]) & ~(guest[later] & guest[i]) & ((side[later] != side[i]) if mixed else True)]
        js, score = admitted(sizes, bits, i, later, percent)
        found += [(-s, i, j) for s, j in zip(score.tolist(), js.tolist())]
    if forest:
        parent = list(range(len(rows)))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        kept = []
        for _, i, j in sorted(found):
            if (a := top(i)) != (b := top(j)):
                parent[a] = b
                kept.append((0, i, j))
                if len(kept) == len(rows) - 1:
                    break
        found = kept
    return [(min(cls[i], cls[j]), max(cls[i], cls[j])) for _, i, j in found]


def _tiles(forest: bool, percent: int):
    """Over partitions sorted by tile: pairs of each tile in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, out = None, [], []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(10)]
            for r in zip(*cols):
                if r[:4] != tile:
                    out += _tile_pairs(rows, forest, percent)
                    tile, rows = r[:4], []
                rows.append(r[4:])
            if out:
                yield made(out)
                out = []
        if out := _tile_pairs(rows, forest, percent):
            yield made(out)

    def made(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _tile_order(df: DataFrame, forest: bool, percent: int) -> DataFrame:
    tile = ["key", "band", "t1", "t2"]
    df = df.select(*tile, "cls", "n", "bits", "guest", "comp", "side")
    return df.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_tiles(forest, percent), "a long, b long").distinct()


def _of_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, h1, h2 and the text of the row that represents the class: found by id and text hash, or by the hash alone where it has no id. Rows that agree
    in these without being of the class may come along."""
    want = classes.select("doc_id", "th", "cls", "h1", "h2")
    named = docs.where("doc_id is not null").join(want.where("doc_id is not null"), ["doc_id", "th"])
    alone = docs.where("doc_id is null").select("th", "text").dropDuplicates(["th", "text"]).join(want.where("doc_id is null").drop("doc_id"), "th")
    return named.select("cls", "h1", "h2", "text").unionByName(alone.select("cls", "h1", "h2", "text"))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets meet the threshold, by exact intersection of their sorted hash arrays; staged."""
    need = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    texts = _of_classes(docs, reps.join(need, "cls", "left_semi"))
    arrays = staged(texts.mapInArrow(lean("ngram_jaccard", _arrays), "cls long, hashes binary").dropDuplicates(["cls"]), "arrays")
    left, right = arrays.select(F.col("cls").alias("a"), F.col("hashes").alias("ha")), arrays.select(F.col("cls").alias("b"), F.col("hashes").alias("hb"))
    wide = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = staged(wide.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long"), "links")
    unstage(arrays)
    return found


def _salted(groups: DataFrame) -> DataFrame:
    """groups (hot, ...) with the salts that rows of their key have: 0, or each of 1 to SALTS."""
    salts = F.when(F.col("hot"), F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    return groups.withColumn("salt", F.explode(salts)).drop("hot")


def _tiles_for(size: Column) -> Column:
    """Tiles of a group: one up to TILE classes, else as many as make about 3/4 TILE each."""
    return F.when(size <= TILE, F.lit(1)).otherwise(F.ceil(size / (TILE * 3 // 4))).cast("int")


def _dealt(tiles: Column, *by) -> Column:
    return F.pmod(F.xxhash64("cls", *by), tiles).cast("int")


def ngram_jaccard_components(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """documents (doc_id long, text string, ...) -> doc_id, n_shingles, component_id, class_id, class_rows, component, text_hash; a row for each input row.

    component_id is the smallest doc_id of the component; component names it too, also where no row of it has an id. Null, empty and blank texts have
    no shingles, null class_id and component, and are their own component. Repeated rows share a class; rows with the same doc_id and different
    texts, and rows without a doc_id, are treated by their texts. An empty table gives an empty result. Other columns are ignored.

    Of what is staged on the way, only tables of a few numbers for each row, class or link are left, from which the result is read.
    """
    docs = thin_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    marked = staged(docs.mapInArrow(lean("ngram_jaccard", _signatures), _MARKED_TYPE), "signatures")
    levels = _levels(marked)
    # classes are numbered, as numbers are half as wide as their hashes and never collide
    spot = F.struct("doc_id", "th")
    reps = marked.where("block is null and h1 is not null").groupBy("h1", "h2").agg(
        F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), spot)), F.min(spot)).alias("r"), F.count(F.lit(1)).alias("class_rows"), F.any_value("bits").alias("bits")
    )
    wide = staged(reps.select(F.monotonically_increasing_id().alias("cls"), "h1", "h2", "r.doc_id", "r.th", "class_rows", "bits"), "bitmaps")
    rows = staged(marked.where("block is null").select("doc_id", "th", "n_shingles", "h1", "h2"), "rows")
    unstage(marked)
    reps, bits = staged(wide.drop("bits"), "classes"), wide.select("cls", "bits")

    prefixes = _of_classes(docs, reps).mapInArrow(lean("ngram_jaccard", _prefixes(levels, percent)), "key long, cls long, of long")
    # a key of one class alone links nothing; rows of hot keys, spread by salt, are kept without that test
    salt = F.col("of") % 256
    prefixes = prefixes.repartition("key", salt).withColumn("salt", salt)
    by_key = Window.partitionBy("key", "salt")
    hits = prefixes.withColumns({"lo": F.min("cls").over(by_key), "hi": F.max("cls").over(by_key)}).where("lo <> hi or salt > 0")
    hits = hits.select("key", "salt", "cls", "of").dropDuplicates(["key", "salt", "cls"])
    hits = staged(hits.select("key", F.col("salt").cast("int").alias("salt"), "cls", F.floor(F.col("of") / 256).cast("int").alias("n")), "hits")

    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    places = F.array(F.struct(band.alias("band"), F.lit(0).alias("guest")), F.struct((band - 1).alias("band"), F.lit(1).alias("guest")))
    banded = hits.withColumn("at", F.explode(places)).select("key", "salt", "at.band", "at.guest", "cls", "n")
    groups = banded.groupBy("key", "band").agg(
        F.count(F.lit(1)).alias("size"),
        F.min("guest").alias("host"),
        F.bit_xor(F.xxhash64("cls", "guest")).alias("x"),
        F.bit_xor(F.xxhash64("guest", "cls")).alias("y"),
        (F.max("salt") > 0).alias("hot"),
    )
    # keys with the same classes say the same: one of them stays
    groups = groups.where("size > 1 and host = 0").groupBy("band", "size", "x", "y").agg(F.min(F.struct("hot", "key")).alias("k"))
    groups = _salted(groups.select("k.key", "band", "k.hot", "size"))
    member = staged(banded.join(groups, ["key", "band", "salt"]), "members")
    unstage(hits)

    # large groups are dealt twice: each dealing links what meets in a tile, and both together link mutual near copies across tiles
    dealings = F.when(F.col("size") > TILE, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    first = member.withColumn("t2", F.explode(dealings))
    first = first.withColumns({"t1": _dealt(_tiles_for(F.col("size")), "key", "t2"), "comp": F.col("cls"), "side": F.lit(0)}).join(bits, "cls")
    tried = staged(_tile_order(first, True, percent), "pairs")
    links = _verified(tried, docs, reps, percent)
    comp = components(links)

    named = member.join(comp.withColumnRenamed("node", "cls").withColumnRenamed("root", "comp"), "cls", "left")
    named = staged(named.withColumn("comp", F.coalesce("comp", "cls")), "named")
    unstage(member)
    spread = named.groupBy("key", "band", "comp").agg(F.count(F.lit(1)).alias("c"), (F.max("salt") > 0).alias("hot"))
    spread = spread.groupBy("key", "band").agg(F.max(F.struct("c", "comp")).alias("major"), F.count(F.lit(1)).alias("comps"), F.max("hot").alias("hot")).where("comps > 1")
    spread = _salted(spread.select("key", "band", F.col("major.comp").alias("big"), F.col("major.c").alias("big_n"), "hot"))
    # a group that fills one tile at most stays whole; in others the largest component's classes, in tiles of their own, meet the rest but not each other
    open_ = named.join(spread, ["key", "band", "salt"])
    one = F.col("size") <= TILE
    open_ = open_.withColumns({"others": _tiles_for(F.col("size") - F.col("big_n")), "bigs": _tiles_for(F.col("big_n")), "is_big": F.col("comp") == F.col("big")})
    open_ = open_.withColumn("k", F.when(one, F.lit(0)).when(F.col("is_big"), F.col("others") + _dealt(F.col("bigs"))).otherwise(_dealt(F.col("others"))))
    facing = F.sequence(F.lit(0), F.when(one, F.lit(1)).when(F.col("is_big"), F.col("others")).otherwise(F.col("others") + F.col("bigs")) - 1)
    second = open_.withColumn("o", F.explode(facing)).withColumns({"t1": F.least("k", "o"), "t2": F.greatest("k", "o"), "side": F.col("k")}).join(bits, "cls")
    more = staged(_tile_order(second, False, percent).join(tried, ["a", "b"], "left_anti"), "pairs2")
    unstage(named, tried, wide)
    late = _verified(more, docs, reps, percent)
    root = components(staged(links.unionByName(late), "all_links")).withColumnRenamed("node", "cls")
    unstage(more, links, late)

    owned = reps.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = owned.join(lowest, "root").select("h1", "h2", "cls", "component_id", "class_rows", "root")
    cols = [
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("cls").alias("class_id"), "class_rows",
        F.col("root").alias("component"), F.col("th").alias("text_hash"),
    ]
    none = {"component_id": F.lit(None).cast("long"), "cls": F.lit(None).cast("long"), "class_rows": F.lit(1).cast("long"), "root": F.lit(None).cast("long")}
    full = rows.where("h1 is not null").join(found, ["h1", "h2"])
    return full.select(*cols).unionByName(rows.where("h1 is null").withColumns(none).select(*cols))


def without_near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """documents with one of each group of linked ones, that with the smallest doc_id; all columns stay. Rows of one doc_id count as one document:
    it goes if any of its rows goes, and of its rows with equal text one stays. Rows without a doc_id go if a document of their group has one; of
    groups without any, rows of one text stay, one of them. Texts without words all stay; an empty table stays empty."""
    found = staged(ngram_jaccard_components(documents, percent).select("doc_id", "component_id", "component", "text_hash"), "components")
    mark = free_name("_mark", documents)
    own, own_hash = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(mark)).distinct()
    kept = documents.join(gone, own == F.col(mark), "left_anti")
    twice = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(mark))
    if not twice.isEmpty():
        same = own == F.col(mark)
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    nameless = found.where("doc_id is null and component is not null").select("component", "text_hash", "component_id").distinct()
    if not nameless.isEmpty():
        stay = nameless.where("component_id is null").groupBy("component").agg(F.min("text_hash").alias("text_hash"))
        every, one = nameless.select(F.col("text_hash").alias(mark)).distinct(), stay.select(F.col("text_hash").alias(mark)).distinct()
        rest = kept.where(own.isNull())
        chosen = rest.join(one, own_hash == F.col(mark), "left_semi").dropDuplicates(["text"])
        kept = kept.where(own.isNotNull()).unionByName(rest.join(every, own_hash == F.col(mark), "left_anti")).unionByName(chosen)
    return kept


#: The same in DuckDB, pair by pair; for small tables.
SQL = r"""
with recursive w as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct rid, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ') || ' .'] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) end) as g from w),
n as (select rid, count(*) as n from s group by rid),
p as (select a.rid as x, b.rid as y, count(*) as c from s a join s b on a.g = b.g and a.rid <> b.rid group by 1, 2),
e as (select x, y from p join n nx on nx.rid = x join n ny on ny.rid = y where 100 * c >= 80 * (nx.n + ny.n - c)),
r as (select rid as a, rid as b from w union select r.a, e.y from r join e on e.x = r.b),
m as (select r.a, min(w.doc_id) as low from r join w on w.rid = r.b group by r.a)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.low as component_id from w left join n using (rid) join m on m.a = w.rid
"""
