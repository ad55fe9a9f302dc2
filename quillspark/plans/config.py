"""Frozen, hashed configurations and a registry of named modules."""

from __future__ import annotations

import difflib
import hashlib
import importlib
import json
import pkgutil
import types
import typing
from enum import Enum
from pathlib import PurePath
from typing import Any, Union


def plain(value: Any) -> Any:
    """What JSON can hold: enums by value, paths as text, tuples and sets as lists, mappings by sorted text keys."""
    if isinstance(value, Enum):
        return plain(value.value)
    if isinstance(value, PurePath):
        return str(value)
    if isinstance(value, Config):
        return value.to_dict()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted(plain(v) for v in value)
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    raise TypeError(f"{type(value).__name__} is not configuration")


def _json_safe(hint: Any) -> bool:
    """Whether all values of an annotation can be put in JSON."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if hint in (Any, None, type(None), str, int, float, bool, list, tuple, dict, set, frozenset):
        return True
    if origin is typing.Literal:
        return True
    if origin in (Union, types.UnionType, list, tuple, set, frozenset):
        return all(_json_safe(x) for x in args if x is not Ellipsis)
    if origin is dict:
        return args[0] is str and _json_safe(args[1])
    return isinstance(hint, type) and issubclass(hint, (Enum, PurePath, Config))


def _is_of(value: Any, hint: Any) -> bool:
    """Whether a value is of an annotated type; an int serves as a float, a bool as no number."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if hint is Any:
        return True
    if hint in (None, type(None)):
        return value is None
    if origin is typing.Literal:
        return value in args
    if origin in (Union, types.UnionType):
        return any(_is_of(value, x) for x in args)
    if hint in (int, float):
        return isinstance(value, (int, float) if hint is float else int) and not isinstance(value, bool)
    if origin is tuple and args and args[-1] is not Ellipsis:
        return isinstance(value, (tuple, list)) and len(value) == len(args) and all(map(_is_of, value, args))
    if origin in (list, tuple, set, frozenset):
        return isinstance(value, (list, tuple) if origin in (list, tuple) else (set, frozenset)) and all(_is_of(v, args[0]) for v in value)
    if origin is dict:
        return isinstance(value, dict) and all(_is_of(k, args[0]) and _is_of(v, args[1]) for k, v in value.items())
    if isinstance(hint, type) and issubclass(hint, PurePath):
        return isinstance(value, (str, PurePath))
    return isinstance(value, hint)


class Config:
    """Subclasses declare fields by annotation, with or without defaults. Instances are frozen; unknown and missing fields and values of another type are
    errors. A class whose annotations JSON cannot hold is refused when it is defined."""

    def __init_subclass__(cls, **kwargs: Any):
        super().__init_subclass__(**kwargs)
        for name, hint in cls.fields().items():
            if not _json_safe(hint):
                raise TypeError(f"{cls.__name__}.{name}: {hint} is no type that JSON can hold")

    def __init__(self, **values: Any):
        fields = self.fields()
        if extra := sorted(set(values) - set(fields)):
            raise ValueError(f"unknown fields {extra}; valid: {sorted(fields)}")
        for name, hint in fields.items():
            if name not in values and not hasattr(type(self), name):
                raise ValueError(f"field {name} is missing; valid: {sorted(fields)}")
            value = values.get(name, getattr(type(self), name, None))
            if isinstance(hint, type) and issubclass(hint, Enum) and isinstance(value, str):
                value = hint(value)
            if not _is_of(value, hint):
                raise TypeError(f"field {name} is {getattr(hint, '__name__', hint)}, not {value!r}")
            object.__setattr__(self, name, value)
        self.to_dict()

    @classmethod
    def fields(cls) -> dict[str, Any]:
        return typing.get_type_hints(cls)

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError(f"{type(self).__name__} is frozen")

    def to_dict(self) -> dict[str, Any]:
        return {k: plain(getattr(self, k)) for k in self.fields()}

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()[:8]

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.to_dict() == other.to_dict()

    def __hash__(self) -> int:
        return int(self.hash(), 16)


class Registry:
    """Named classes of one base, given as classes or as import paths that load when first asked for."""

    def __init__(self, base: type = object):
        self.base, self.known = base, {}

    def register(self, name: str, target: type | str) -> None:
        if name in self.known:
            raise ValueError(f"{name} is registered already")
        if isinstance(target, type) and not issubclass(target, self.base):
            raise TypeError(f"{target.__name__} is not a {self.base.__name__}")
        self.known[name] = target

    def get(self, name: str) -> type:
        if name not in self.known:
            raise KeyError(f"no {name!r}; close: {difflib.get_close_matches(name, self.known, 3)}")
        target = self.known[name]
        if isinstance(target, str):
            module, _, attr = target.partition(":")
            target = getattr(importlib.import_module(module), attr)
            if not issubclass(target, self.base):
                raise TypeError(f"{name} is not a {self.base.__name__}")
            self.known[name] = target
        return target

    def names(self) -> list[str]:
        return sorted(self.known)

    def to_dict(self) -> dict[str, str]:
        return {k: v if isinstance(v, str) else f"{v.__module__}:{v.__qualname__}" for k, v in self.known.items()}

    @classmethod
    def from_dict(cls, entries: dict[str, str], base: type = object) -> Registry:
        out = cls(base)
        for k, v in entries.items():
            out.register(k, v)
        return out

    def create(self, name: str, config: Any = None, **params: Any) -> Any:
        """An instance with a config or with parameters for one, not both."""
        if config is not None and params:
            raise ValueError("a config or parameters, not both")
        cls = self.get(name)
        if not hasattr(cls, "Config"):
            return cls(**params)
        return cls(self.config_of(name, config, params))

    def config_of(self, name: str, config: Any, params: dict[str, Any]) -> Config:
        """The config of a named class from a config, a mapping or parameters; errors name the class and its valid fields."""
        wanted = self.get(name).Config
        if isinstance(config, Config):
            if not isinstance(config, wanted):
                raise TypeError(f"{name} takes a {wanted.__qualname__}, not a {type(config).__qualname__}")
            return config
        try:
            return wanted(**(config if isinstance(config, dict) else params))
        except (TypeError, ValueError) as e:
            raise ValueError(f"{name}: {e}; valid fields: {sorted(wanted.fields())}") from e

    def dump(self, path: str) -> None:
        """Entries as JSON."""
        with open(path, "w") as f:
            json.dump(self.to_dict(), f, indent=1, sort_keys=True)

    @classmethod
    def load(cls, path: str, base: type = object) -> Registry:
        with open(path) as f:
            return cls.from_dict(json.load(f), base)


class Module:
    """A named thing with a config of its own class: subclasses say `class X(Module, name="x")` and nest a Config. Abstract ones have no name and
    cannot be made."""

    Config: type[Config] = Config
    name: str | None = None

    def __init_subclass__(cls, name: str | None = None, abstract: bool = False, **kwargs: Any):
        super().__init_subclass__(**kwargs)
        cls.name = None if abstract else name or cls.__dict__.get("name") or None
        if not abstract and not cls.name:
            raise TypeError(f"{cls.__name__} needs a name")
        if not (isinstance(cls.Config, type) and issubclass(cls.Config, Config)):
            raise TypeError(f"{cls.__name__}.Config is no Config")

    def __init__(self, config: Config | None = None, **params: Any):
        if type(self).name is None:
            raise TypeError(f"{type(self).__name__} is abstract")
        if config is not None and params:
            raise ValueError("a config or parameters, not both")
        if config is not None and not isinstance(config, self.Config):
            raise TypeError(f"{self.name} takes a {self.Config.__qualname__}")
        self.config = config if config is not None else self.Config(**params)

    def __repr__(self) -> str:
        return represented(self)


def represented(value: Any, most: int = 4) -> str:
    """Public fields only; arrays by shape and type, long sequences by their first entries."""
    if hasattr(value, "shape") and hasattr(value, "dtype"):
        return f"{type(value).__name__}(shape={tuple(value.shape)}, dtype={value.dtype})"
    if isinstance(value, bytes):
        return f"bytes({len(value)})"
    if isinstance(value, dict):
        own = [f"{k!r}: {represented(v, most)}" for k, v in list(value.items())[:most]]
        return "{" + ", ".join(own + ["..."] * (len(value) > most)) + "}"
    if isinstance(value, (list, tuple)):
        own = [represented(v, most) for v in value[:most]]
        return "[" + ", ".join(own + [f"... {len(value)} in all"] * (len(value) > most)) + "]"
    if isinstance(value, Config) or (hasattr(value, "__dict__") and not isinstance(value, (type, types.FunctionType, Enum))):
        own = [f"{k}={represented(v, most)}" for k, v in vars(value).items() if not k.startswith("_")]
        return f"{type(value).__name__}({', '.join(own)})"
    return repr(value)


def import_submodules(package: str) -> list[str]:
    """Import all modules below a package, so that what they register is known; their names in order."""
    root = importlib.import_module(package)
    names = sorted(m.name for m in pkgutil.walk_packages(getattr(root, "__path__", []), f"{package}."))
    for name in names:
        importlib.import_module(name)
    return names
