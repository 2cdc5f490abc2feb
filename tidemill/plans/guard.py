"""Driver-side guard: while a stage runs, files of the tree may be opened or listed only as declared, and written nowhere else.

What Spark reads is checked by the plan of the result (Pipeline._guard). This is for the rest: open(),
listings, removals and renames by Python code of the body, seen by an audit hook. Outside the tree reading
is free unless `reads` is given; writing needs `writes`, or the system's temporary folder.
"""

from __future__ import annotations

import os
import sys
import tempfile
import threading
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from tidemill.errors import StateError

_now = threading.local()
_hooked = False
#: Audit events whose arguments are paths that are read or listed, and those that are changed.
LOOKS = {"os.listdir", "os.scandir", "glob.glob", "glob.glob/2"}
CHANGES = {"os.remove": 1, "os.rename": 2, "os.rmdir": 1, "os.mkdir": 1, "os.truncate": 1, "os.link": 2, "os.symlink": 2, "shutil.rmtree": 1, "shutil.move": 2, "shutil.copyfile": 2}


def plain(path: object) -> str | None:
    """The real path of what was given, links followed, so that none leads out of a folder; None for file descriptors and other schemes."""
    if isinstance(path, bytes):
        path = os.fsdecode(path)
    if not isinstance(path, str | os.PathLike):
        return None
    text = os.fspath(path)
    if "://" in text or text.startswith("file:"):
        uri = urlparse(text)
        if uri.scheme != "file":
            return None
        text = unquote(uri.path)
    return os.path.realpath(text)


def below(path: str, folders: Iterable[str]) -> bool:
    return any(path == f or path.startswith(f.rstrip("/") + "/") for f in folders)


def _hook(event: str, args: tuple) -> None:
    guard = getattr(_now, "guard", None)
    if guard is None or getattr(_now, "busy", False):
        return
    looks, changes = [], []
    if event == "open" and args and isinstance(args[0], str | bytes | os.PathLike):
        writes = (isinstance(args[1], str) and any(c in args[1] for c in "wax+")) or (isinstance(args[2], int) and args[2] & (os.O_WRONLY | os.O_RDWR | os.O_CREAT))
        (changes if writes else looks).append(args[0])
    elif event in LOOKS:
        looks = list(args[:1])
    elif event in CHANGES:
        changes = list(args[: CHANGES[event]])
    if not looks and not changes:
        return
    _now.busy = True
    try:
        for p in map(plain, looks):
            if p is not None:
                guard.look(p)
        for p in map(plain, changes):
            if p is not None:
                guard.change(p)
    finally:
        _now.busy = False


class Guard:
    def __init__(self, stage: str, tree: str | None, given: Iterable[str], out: Iterable[str], reads: Iterable[str] | None, writes: Iterable[str]):
        real = lambda paths: [p for p in map(plain, paths) if p is not None]
        self.stage, self.tree, self.given, self.out = stage, plain(tree) if tree else None, real(given), real(out)
        self.reads = None if reads is None else [*real(reads), *real([sys.prefix, sys.base_prefix, tempfile.gettempdir(), "/dev", "/proc", "/etc", "/usr", "/opt", os.path.dirname(os.__file__)]), *real(p for p in sys.path if p)]
        self.writes = [*real(writes), *real([tempfile.gettempdir(), "/dev"])]

    def look(self, path: str) -> None:
        if below(path, self.out) or below(path, self.given):
            return
        if self.tree and below(path, [self.tree]):
            raise StateError(f"{self.stage} looks at {path} without declaring it")
        if self.reads is not None and not below(path, self.reads):
            raise StateError(f"{self.stage} looks at {path}, which allow_reads doesn't name")

    def change(self, path: str) -> None:
        if below(path, self.out):
            return
        if below(path, self.given) or (self.tree and below(path, [self.tree])):
            raise StateError(f"{self.stage} changes {path}, which isn't its output")
        if not below(path, self.writes) and "__pycache__" not in path:
            raise StateError(f"{self.stage} changes {path}, which allow_writes doesn't name")


@contextmanager
def guarded(guard: Guard) -> Iterator[None]:
    global _hooked
    if not _hooked:
        sys.addaudithook(_hook)
        _hooked = True
    before, _now.guard = getattr(_now, "guard", None), guard
    try:
        yield
    finally:
        _now.guard = before


@contextmanager
def unguarded() -> Iterator[None]:
    """For the engine's own reading and writing while a stage runs."""
    before, _now.guard = getattr(_now, "guard", None), None
    try:
        yield
    finally:
        _now.guard = before
