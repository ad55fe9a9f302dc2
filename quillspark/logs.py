"""Logging on the driver: one library root, quiet on other ranks, files that are not overwritten, errors that reach them."""

from __future__ import annotations

import logging
import os
import sys
import threading
from pathlib import Path

ROOT = "quillspark"
FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


class RankFilter(logging.Filter):
    """Passes records of rank 0, and warnings of all."""

    def __init__(self, rank: int | None = None):
        super().__init__()
        self.rank = int(os.environ.get("RANK", 0)) if rank is None else rank

    def filter(self, record: logging.LogRecord) -> bool:
        return self.rank == 0 or record.levelno >= logging.WARNING


def get_logger(name: str = "", level: int | str = logging.INFO) -> logging.Logger:
    """A logger below the library's root, which gets one handler for the console."""
    root = logging.getLogger(ROOT)
    if not root.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter(FORMAT))
        handler.addFilter(RankFilter())
        root.addHandler(handler)
        root.propagate = False
        root.setLevel(level)
    return logging.getLogger(f"{ROOT}.{name}" if name else ROOT)


def attach_file(path: str | Path) -> Path:
    """Log to a file too; where it exists, to the first of path.1, path.2, ... that does not. The path that is used."""
    path, k = Path(path), 0
    path.parent.mkdir(parents=True, exist_ok=True)
    while True:
        own = path if not k else path.with_name(f"{path.name}.{k}")
        try:
            own.open("x").close()
            break
        except FileExistsError:
            k += 1
    handler = logging.FileHandler(own)
    handler.setFormatter(logging.Formatter(FORMAT))
    get_logger().addHandler(handler)
    return own


def log_uncaught() -> None:
    """Errors that end the program or a thread are logged first; interrupts are not."""

    def say(kind, value, trace) -> None:
        if not issubclass(kind, KeyboardInterrupt):
            get_logger().critical("uncaught", exc_info=(kind, value, trace))

    before = sys.excepthook

    def hook(kind, value, trace) -> None:
        say(kind, value, trace)
        before(kind, value, trace)

    sys.excepthook = hook
    threading.excepthook = lambda args: say(args.exc_type, args.exc_value, args.exc_traceback)


def banner(text: str, width: int = 60) -> str:
    line = "=" * width
    return f"{line}\n{text.center(width).rstrip()}\n{line}"
