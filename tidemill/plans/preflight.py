"""Checks that need no data: names that a stage's body uses and nobody defines, modules that can't be found."""

from __future__ import annotations

import builtins
import dis
import importlib.util
import types
from collections.abc import Iterator


def codes(code: types.CodeType) -> Iterator[types.CodeType]:
    """A function's code and that of the functions inside it."""
    yield code
    for x in code.co_consts:
        if isinstance(x, types.CodeType):
            yield from codes(x)


def problems(body) -> list[str]:
    known, out = set(vars(builtins)) | set(body.__globals__), []
    for code in codes(body.__code__):
        for step in dis.get_instructions(code):
            if step.opname in ("LOAD_GLOBAL", "LOAD_NAME") and step.argval not in known:
                out.append(f"line {code.co_firstlineno}: {step.argval} isn't defined")
            elif step.opname == "IMPORT_NAME" and step.argval:
                try:
                    found = importlib.util.find_spec(step.argval) is not None
                except (ImportError, ValueError):
                    found = False
                if not found:
                    out.append(f"line {code.co_firstlineno}: module {step.argval} isn't there")
    return list(dict.fromkeys(out))
