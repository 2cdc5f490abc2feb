"""python -m tidemill.cli MODULE:PIPELINE COMMAND ...; the pipeline may be left out where pyproject.toml names it ([tool.tidemill] pipeline)."""

from __future__ import annotations

import argparse
import contextlib
import importlib
import io
import os
import sys
import tomllib
from collections.abc import Iterable, Iterator
from pathlib import Path

from tidemill.errors import ConfigError, TideError
from tidemill.functions.natural import natural_key
from tidemill.plans import picture
from tidemill.sources.store import decode

COMMANDS = ("run", "status", "plan", "why", "graph", "stage", "impact", "preflight", "check", "drift", "verify", "gc", "determinism", "fetch", "viz")


def named_in(folder: Path) -> str:
    """The pipeline that the next pyproject.toml from here upwards names."""
    for at in [folder, *folder.parents]:
        if (at / "pyproject.toml").is_file():
            found = tomllib.loads((at / "pyproject.toml").read_text()).get("tool", {}).get("tidemill", {}).get("pipeline")
            if found:
                sys.path.insert(0, str(at))
                return found
    raise ConfigError("name the pipeline as MODULE:NAME, or in pyproject.toml")


def load(name: str):
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute or "pipeline")
    return found() if callable(found) and not hasattr(found, "stages") else found


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemill")
    top.add_argument("pipeline")
    top.add_argument("--dev", help="write outputs to this tree instead")
    sub = top.add_subparsers(dest="command", required=True)
    made = {name: sub.add_parser(name) for name in COMMANDS}
    for flag in ("--up-to", "--up-to-excluding", "--from", "--only", "--log"):
        made["run"].add_argument(flag, dest=flag.strip("-").replace("-", "_"))
    for name in ("run", "determinism"):
        made[name].add_argument("--part", action="append", default=[])
    made["run"].add_argument("--force", action="store_true")
    made["run"].add_argument("--unchecked", action="store_true", help="build even if what isn't selected upstream is stale")
    for name in ("why", "impact", "stage", "determinism", "fetch"):
        made[name].add_argument("name")
    for name in ("verify", "gc"):
        made[name].add_argument("name", nargs="?")
    made["impact"].add_argument("--tick", action="store_true", help="as if the stage came out anew")
    made["impact"].add_argument("--tick-part", action="append", default=[])
    made["determinism"].add_argument("--sample", action="store_true", help="the last partition only")
    made["gc"].add_argument("--partition-key", action="append", default=[], help="keep this layout too")
    made["gc"].add_argument("--orphans", action="store_true", help="datasets that nothing declares too")
    made["gc"].add_argument("--dry", action="store_true")
    made["graph"].add_argument("--focus")
    made["fetch"].add_argument("--replace", action="store_true")
    made["viz"].add_argument("--html")
    made["viz"].add_argument("--svg")
    made["viz"].add_argument("--plain", action="store_true")
    return top


def coloured(text: str, code: int) -> str:
    return f"\x1b[{code}m{text}\x1b[0m" if sys.stderr.isatty() and "NO_COLOR" not in os.environ else text


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    try:
        if argv and argv[0] in COMMANDS:
            argv.insert(0, named_in(Path.cwd()))
        args = parser().parse_args(argv)
        p = load(args.pipeline)
        if args.dev:
            p.redirect(args.dev)
        return act(p, args)
    except TideError as e:
        print(coloured(f"error: {e}", 31), file=sys.stderr)
        return 1


class Tee(io.TextIOBase):
    def __init__(self, *to):
        self.to = to

    def write(self, text: str) -> int:
        for x in self.to:
            x.write(text)
        return len(text)

    def flush(self) -> None:
        for x in self.to:
            x.flush()


@contextlib.contextmanager
def logged(path: str | None) -> Iterator[None]:
    """What stages and the engine print goes to the log as well."""
    if not path:
        yield
        return
    with open(path, "a") as log, contextlib.redirect_stdout(Tee(sys.stdout, log)), contextlib.redirect_stderr(Tee(sys.stderr, log)):
        yield


def spelled(part: list[str]) -> dict[str, str]:
    return dict(x.split("=", 1) for x in part)


def ranges(some: Iterable[str], every: Iterable[str], most: int = 3) -> str:
    """The first runs of neighbouring partitions, as a..b."""
    order = sorted(every, key=natural_key)
    place = {p: k for k, p in enumerate(order)}
    runs: list[list[str]] = []
    for p in sorted(some, key=natural_key):
        if runs and p in place and place.get(runs[-1][-1], -2) + 1 == place[p]:
            runs[-1].append(p)
        else:
            runs.append([p])
    said = [r[0] or "(one shard)" if len(r) == 1 else f"{r[0]}..{r[-1]}" for r in runs]
    return ", ".join(said[:most]) + (f" +{len(said) - most} more" if len(said) > most else "")


def act(p, args) -> int:
    if args.command == "run":
        p.force = p.force or args.force
        with logged(args.log):
            try:
                done = p.run(args.up_to, args.__dict__["from"], args.only, spelled(args.part), print, args.up_to_excluding, not args.unchecked)
            except Exception as e:
                print(f"failed: {e}")
                raise
            print(f"{len(done)} built")
    elif args.command == "status":
        rows = p.status()
        for d, n in rows.items():
            print(f"{d}: {n['current']} current, {n['maybe']} maybe, {n['stale']} stale")
        return int(any(n["stale"] for n in rows.values()))
    elif args.command == "plan":
        state = p.staleness()
        for (d, why), of in p.reasons().items():
            print(f"rebuild {d} {ranges(of, state[d])}: {why}")
        stale = {d: {x for x, why in of.items() if why} for d, of in state.items()}
        for d, of in p.downstream(stale, state).items():
            print(f"maybe {d} {ranges(of, state.get(d, of))}")
    elif args.command == "why":
        names = p.find(args.name).datasets if args.name not in p.catalog else [args.name]
        for d in names:
            stored, retired = p.store.shards(d), set(p.retired(d))
            state = p.staleness().get(d, {})
            for part in dict.fromkeys([*state, *stored]):
                why = "retired" if part in retired else state.get(part) or "current"
                s = stored.get(part)
                print(f"{part or '(one shard)'}: {why}" + (f" fp={s.fp} key={s.key}" if s else ""))
            if (stage := p.owner(d, decode(next(iter(stored), "")))) is not None:
                for r in stage.reads.values():
                    shards = p._shards(r.dataset).values()
                    print(f"  reads {r.dataset}: {r.text()}, of {len(shards)} shards {p.store.id_of(list(shards))}")
    elif args.command == "impact":
        print("stages:", *sorted(p.closure([p.find(args.name).name])))
        for d, of in p.impact(args.name, args.tick, spelled(args.tick_part) if args.tick_part else None).items():
            print(f"{d}: {len(of)} partitions may follow: {ranges(of, of)}")
    elif args.command == "graph":
        nodes, edges = p.focus(args.focus) if args.focus else ([s.name for s in p.order()], p.edges())
        print(picture.text(nodes, edges))
    elif args.command == "stage":
        s = p.find(args.name)
        print(f"{s.label}: writes {', '.join(s.datasets) or 'nothing'} {s.why}".rstrip(), *(f"  reads {r.dataset}: {r.text()} {r.why}".rstrip() for r in s.reads.values()), sep="\n")
    elif args.command == "viz":
        nodes, edges = [s.name for s in p.order()], p.edges()
        if args.html:
            Path(args.html).write_text(p.page())
        elif args.svg:
            Path(args.svg).write_text(picture.svg(nodes, edges))
        else:
            print(picture.text(nodes, edges) if args.plain else picture.dot(nodes, edges))
    elif args.command == "fetch":
        files, size = p.fetch(args.name, args.replace)
        print(f"{files} files, {size / 1e6:.1f} MB")
    elif args.command == "gc":
        for d, names in p.collect(not args.dry, args.name, args.partition_key, args.orphans).items():
            print(f"{d}: {'would remove' if args.dry else 'removed'} {len(names)}")
        for d in [] if args.orphans else p.orphans():
            print(f"{d}: nothing declares it")
    elif args.command == "drift":
        found = p.drift()
        lines = [f"{side}: {stage} {op}s {d}" for side, rows in found.items() for stage, op, d in rows]
        print(*lines, sep="\n")
        return int(bool(found["undeclared"]))
    else:
        if args.command == "verify":
            found = [x for d in ([args.name] if args.name else p.store.datasets()) for x in p.verify(d)]
        elif args.command == "determinism":
            found = p.determinism(args.name, spelled(args.part) or None, args.sample)
        else:
            found = {"check": p.check, "preflight": p.preflight}[args.command]()
        print(*found, sep="\n")
        return int(bool(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
