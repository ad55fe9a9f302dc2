"""Downloads on the driver: resolve, fetch, merge parts, unpack, publish. What is there already is not fetched again."""

from __future__ import annotations

import fcntl
import hashlib
import os
import re
import shutil
import tarfile
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from .readers import ARCHIVES, PART, with_token

RETRIES, WAIT, TIMEOUT = 3, 2.0, 10


@dataclass(frozen=True)
class Source:
    """A URL and the paths that its download gets."""

    url: str

    @property
    def name(self) -> str:
        return urllib.parse.unquote(urllib.parse.urlsplit(self.url).path.rpartition("/")[2]) or "download"

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.url.encode()).hexdigest()

    @property
    def part(self) -> int | None:
        found = re.search(PART, self.name)
        return int(found[1]) if found else None

    @property
    def whole_name(self) -> str:
        """The name without a part's number."""
        return re.sub(PART, "", self.name)

    @property
    def is_archive(self) -> bool:
        return any(self.whole_name.lower().endswith(f".{s}") for s in ARCHIVES)

    @property
    def stem(self) -> str:
        """The name without an archive's suffix."""
        for s in sorted(ARCHIVES, key=len, reverse=True):
            if self.whole_name.lower().endswith(f".{s}"):
                return self.whole_name[: -len(s) - 1]
        return self.whole_name

    def path(self, root: Path) -> Path:
        return root / "files" / self.digest[:16] / self.name


@contextmanager
def locked(path: Path):
    """One process at a time."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(f"{path}.lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def _stream(url: str, target: Path) -> None:
    scheme = urllib.parse.urlsplit(url).scheme
    if scheme in ("", "file"):
        local = urllib.parse.unquote(urllib.parse.urlsplit(url).path) if scheme else url
        with open(local, "rb") as src, open(target, "wb") as out:
            shutil.copyfileobj(src, out, 1 << 20)
    elif scheme in ("http", "https", "ftp"):
        with urllib.request.urlopen(url, timeout=TIMEOUT) as src, open(target, "wb") as out:
            shutil.copyfileobj(src, out, 1 << 20)
    else:
        raise ValueError(f"no way to fetch {scheme}://")


def fetch(url: str, target: Path, token: str | None = None, retries: int = RETRIES, wait: float = WAIT) -> Path:
    """url into target: under a lock, into a file beside it that is renamed when whole. Network failures are tried again after wait, 2 wait, 4 wait."""
    with locked(target):
        if target.exists():
            return target
        temp = target.with_name(f"{target.name}.incomplete")
        for attempt in range(retries + 1):
            try:
                _stream(with_token(url, token), temp)
                os.replace(temp, target)
                return target
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt == retries:
                    raise
                time.sleep(wait * 2**attempt)
            finally:
                temp.unlink(missing_ok=True)
    return target


def merge(parts: list[Path], target: Path) -> Path:
    """Parts in the order of their numbers, one after the other."""
    number = lambda p: int(re.search(PART, p.name)[1])
    temp = target.with_name(f"{target.name}.incomplete")
    with open(temp, "wb") as out:
        for p in sorted(parts, key=number):
            with open(p, "rb") as src:
                shutil.copyfileobj(src, out, 1 << 20)
    os.replace(temp, target)
    return target


def unpack(archive: Path, folder: Path) -> Path:
    """A tar or zip archive into a folder that appears when whole; names that lead out of it are refused."""
    temp = folder.with_name(f"{folder.name}.incomplete")
    shutil.rmtree(temp, ignore_errors=True)
    temp.mkdir(parents=True)
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for name in z.namelist():
                if not (temp / name).resolve().is_relative_to(temp.resolve()):
                    raise ValueError(f"{name} leads out of the archive")
            z.extractall(temp)
    elif tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            t.extractall(temp, filter="data")
    else:
        raise ValueError(f"{archive.name} is no archive that can be unpacked here")
    shutil.rmtree(folder, ignore_errors=True)
    os.replace(temp, folder)
    return folder


class Downloads:
    """Files and unpacked folders under a root that driver and executors share, if Spark is to read them."""

    def __init__(self, root: str | Path, token: str | None = None):
        self.root, self.token = Path(root), token

    def get(self, urls: list[str], extract: bool = True) -> dict[str, Path]:
        """The path of each whole file by its name: parts are merged, archives unpacked. What exists is left as it is."""
        groups: dict[str, list[Source]] = {}
        for s in map(Source, urls):
            groups.setdefault(s.whole_name if s.part is not None else f"{s.digest[:16]}/{s.name}", []).append(s)
        out = {}
        for sources in groups.values():
            first = sources[0]
            final = self.root / "unpacked" / f"{first.stem}-{first.digest[:8]}"
            if extract and first.is_archive and final.is_dir():
                out[first.whole_name] = final
                continue
            paths = [fetch(s.url, s.path(self.root), self.token) for s in sources]
            whole = paths[0]
            if first.part is not None:
                whole = self.root / "merged" / f"{first.digest[:8]}-{first.whole_name}"
                whole.parent.mkdir(parents=True, exist_ok=True)
                if not whole.exists():
                    merge(paths, whole)
            out[first.whole_name] = unpack(whole, final) if extract and first.is_archive else whole
        return out
