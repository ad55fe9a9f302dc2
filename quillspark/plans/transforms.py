"""Transforms with an identity: parameters, code and captured values make the hash that names a cache."""

from __future__ import annotations

import functools
import hashlib
import json
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.column import Column

from .config import plain


def _digest(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def identity(value: Any, seen: tuple[int, ...] = ()) -> str:
    """A text that is equal for values that do the same: functions by code, constants, defaults and captured values; columns by their expression."""
    if id(value) in seen:
        return "recursive"
    seen = (*seen, id(value))
    inner = lambda v: identity(v, seen)
    if isinstance(value, Transform):
        return value.hash()
    if parts := getattr(value, "parts", None):
        return _digest("parts", *map(inner, parts))
    if isinstance(value, functools.partial):
        return _digest("partial", inner(value.func), inner(value.args), inner(value.keywords))
    if isinstance(value, types.MethodType):
        return _digest("method", inner(value.__func__), inner(vars(value.__self__) if hasattr(value.__self__, "__dict__") else repr(value.__self__)))
    if isinstance(value, types.FunctionType):
        code = value.__code__
        cells = [c.cell_contents for c in value.__closure__ or ()]
        used = {n: value.__globals__[n] for n in code.co_names if isinstance(value.__globals__.get(n), (types.FunctionType, str, int, float, bool, tuple))}
        return _digest("function", inner(code), inner(value.__defaults__), inner(value.__kwdefaults__), inner(cells), inner(used))
    if isinstance(value, types.CodeType):
        names = [value.co_names, value.co_varnames[: value.co_argcount], value.co_freevars]
        return _digest("code", value.co_code.hex(), *map(repr, names), *map(inner, value.co_consts))
    if isinstance(value, dict):
        return _digest("dict", *(f"{k!r}={inner(v)}" for k, v in sorted(value.items(), key=lambda x: repr(x[0]))))
    if isinstance(value, (list, tuple)):
        return _digest(type(value).__name__, *map(inner, value))
    if isinstance(value, (set, frozenset)):
        return _digest("set", *sorted(map(inner, value)))
    if isinstance(value, DataFrame):
        return _digest("frame", value._jdf.queryExecution().logical().toString())
    if isinstance(value, Column):
        return _digest("column", str(value))
    if isinstance(value, (types.ModuleType, type)):
        return value.__name__
    if value is None or isinstance(value, (str, bytes, int, float, bool, complex)):
        return repr(value)
    if hasattr(value, "__dict__"):
        return _digest(type(value).__qualname__, inner(vars(value)))
    return repr(value)


def transform_hash(f: Callable) -> str:
    return f.hash() if hasattr(f, "hash") else _digest(identity(f))[:8]


def provenance(f: Callable | None) -> list[dict[str, Any]]:
    """What a manifest says of a transform: a list with the name, the parameters and the hash of each part."""
    if f is None:
        return []
    if parts := getattr(f, "parts", None):
        return [entry for p in parts for entry in provenance(p)]
    own = f.config() if isinstance(f, Transform) else {"name": getattr(f, "__qualname__", type(f).__name__), "params": {}}
    return [{**own, "hash": transform_hash(f)}]


class Transform:
    """A DataFrame function of parameters: subclasses implement apply()."""

    def __init__(self, **params: Any):
        self.params = plain(params)

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)

    def config(self) -> dict[str, Any]:
        return {"name": type(self).__name__, "params": self.params}

    def hash(self) -> str:
        return _digest(json.dumps(self.config(), sort_keys=True))[:8]


class Compose(Transform):
    """Transforms in turn, nested ones flattened."""

    def __init__(self, *parts: Callable[[DataFrame], DataFrame]):
        self.parts = [q for p in parts for q in getattr(p, "parts", None) or [p]]
        super().__init__()

    def apply(self, df: DataFrame) -> DataFrame:
        for p in self.parts:
            df = p(df)
        return df

    def config(self) -> dict[str, Any]:
        return {"name": "Compose", "params": [transform_hash(p) for p in self.parts]}
