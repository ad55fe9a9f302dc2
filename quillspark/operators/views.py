"""Split views: map, filter, limit, shuffle, slice, concatenation over a dense position."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.column import Column

from ..session import written

POS = "_pos"
BROADCAST_ROWS, EXACT_ROWS = 100_000, 1_000_000


def with_positions(df: DataFrame, *order: str) -> DataFrame:
    """Adds dense positions in the order of `order` (unique together). A range sort, written once; only one count per partition is gathered."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    rows = written(ranged, "positions").withColumns({"_part": F.shiftrightunsigned(F.col("_mid"), 33), "_own": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(POS, F.col("_own") + F.col("_before")).select(*df.columns, POS)


class Unplaced:
    """Rows and their order (unique together); positions are made when first asked for, once for all views that share this."""

    def __init__(self, df: DataFrame, order: tuple[str, ...]):
        self.df, self.order = df, order

    @cached_property
    def rows(self) -> DataFrame:
        return with_positions(self.df, *self.order)

    def first(self, n: int) -> Unplaced:
        """The first n rows: the least n of each task, and of these the least n, so that the others are neither sorted nor written."""
        return Unplaced(self.df.orderBy(*self.order).limit(n), self.order)


class View:
    """An ordered, immutable view of a DataFrame that has a dense position column. Views share their base; nothing runs until a frame is used."""

    def __init__(self, base: DataFrame | Unplaced, transforms: tuple[Callable[[DataFrame], DataFrame], ...] = ()):
        self._base, self.transforms = base, transforms

    @classmethod
    def of(cls, df: DataFrame, *order: str) -> View:
        return cls(Unplaced(df, order))

    @property
    def base(self) -> DataFrame:
        return self._base.rows if isinstance(self._base, Unplaced) else self._base

    @property
    def frame(self) -> DataFrame:
        """The transformed rows."""
        out = self.base
        for f in self.transforms:
            out = f(out)
        return out

    def with_transform(self, f: Callable[[DataFrame], DataFrame]) -> View:
        return View(self._base, (*self.transforms, f))

    def limit(self, n: int) -> View:
        if n < 0:
            raise ValueError("a limit is not negative")
        if isinstance(self._base, Unplaced) and n <= BROADCAST_ROWS:
            return View(self._base.first(n), self.transforms)
        return View(self.base.where(F.col(POS) < n), self.transforms)

    def filter(self, predicate: Column | str) -> View:
        """Keeps rows by their transformed values and numbers what is left anew."""
        kept = self.frame.where(predicate)
        return View(with_positions(kept.withColumnRenamed(POS, "_was"), "_was").drop("_was"))

    def slice(self, start: int | None = None, stop: int | None = None, step: int = 1) -> View:
        """What a list's slice holds, numbered anew: bounds below 0 count from the end, a step below 0 goes backwards. Rows are counted only for these."""
        if step == 0:
            raise ValueError("a step is not zero")
        if step < 0 or (start or 0) < 0 or (stop or 0) < 0:
            lo, hi, _ = slice(start, stop, step).indices(len(self))
        else:
            lo, hi = start or 0, stop
        gone = (F.col(POS) - lo) if step > 0 else (F.lit(lo) - F.col(POS))
        rows = self.base.where(F.col(POS) >= lo if step > 0 else F.col(POS) <= lo)
        if hi is not None:
            rows = rows.where(F.col(POS) < hi if step > 0 else F.col(POS) > hi)
        rows = rows.where(gone % abs(step) == 0) if abs(step) > 1 else rows
        return View(rows.withColumn(POS, F.floor(gone / abs(step)).cast("long")), self.transforms)

    def take(self, indices: list[int]) -> DataFrame:
        """Rows at the given positions, in their order; negative ones count from the end, those outside are an IndexError."""
        size = len(self)
        if outside := [i for i in indices if not -size <= i < size]:
            raise IndexError(f"{outside[:5]} of {size} rows")
        want = self.base.sparkSession.createDataFrame(list(enumerate(i % size for i in indices)), f"_at long, {POS} long")
        # the list is the caller's own; beyond a bound it is joined as any table
        want = F.broadcast(want) if len(indices) <= BROADCAST_ROWS else want
        return self.frame.join(want, POS).orderBy("_at").drop("_at")

    def __getitem__(self, index: int | slice) -> DataFrame:
        if isinstance(index, slice):
            return self.slice(index.start, index.stop, 1 if index.step is None else index.step).frame
        size = len(self)
        if not -size <= index < size:
            raise IndexError(index)
        return self.frame.where(F.col(POS) == index % size)

    def __len__(self) -> int:
        return (self._base.df if isinstance(self._base, Unplaced) else self._base).count()

    def shuffle(self, seed: int, exact: bool = False) -> View:
        """A permutation that the seed fixes. exact: numpy's default_rng(seed).permutation, made on the driver, for views of EXACT_ROWS rows at most."""
        if exact:
            if len(self) > EXACT_ROWS:
                raise ValueError(f"numpy's permutation is made on the driver, for {EXACT_ROWS} rows at most; leave exact out")
            order = np.random.default_rng(seed).permutation(len(self))
            places = self.base.sparkSession.createDataFrame([(int(p), i) for i, p in enumerate(order)], f"{POS} long, _new long")
            return View(self.base.join(places, POS).withColumn(POS, F.col("_new")).drop("_new"), self.transforms)
        keyed = self.base.withColumn("_roll", F.xxhash64(F.col(POS), F.lit(seed))).withColumnRenamed(POS, "_was")
        return View(with_positions(keyed, "_roll", "_was").drop("_roll", "_was"), self.transforms)

    @staticmethod
    def concat(views: list[View]) -> View:
        """All rows of the first view, then of the next: union with offsets; columns that a view lacks are null."""
        out, offset = None, 0
        for v in views:
            part = v.frame.withColumn(POS, F.col(POS) + offset)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
            offset += len(v)
        return View(out)


def compose(*fs: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One function of many, nested compositions flattened."""
    flat = [g for f in fs for g in getattr(f, "parts", (f,))]

    def run(df: DataFrame) -> DataFrame:
        for f in flat:
            df = f(df)
        return df

    run.parts = tuple(flat)
    return run
