"""Pictures of the graph: columns by depth, text, DOT, SVG and one self-contained page."""

from __future__ import annotations

import html
import json
from statistics import mean

SWEEPS = 8


def columns(nodes: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Nodes by the length of the longest path to them; inside a column near the mean place of their neighbours."""
    depth = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for a, b in edges:
            depth[b] = max(depth[b], depth[a] + 1)
    out = [[n for n in nodes if depth[n] == d] for d in range(max(depth.values(), default=-1) + 1)]
    for sweep in range(SWEEPS):
        place = {n: k for col in out for k, n in enumerate(col)}
        side = [(b, a) for a, b in edges] if sweep % 2 == 0 else edges
        near = {n: [place[y] for x, y in side if x == n] for n in nodes}
        out = [sorted(col, key=lambda n: mean(near[n]) if near[n] else place[n]) for col in out]
    return out


def text(nodes: list[str], edges: list[tuple[str, str]]) -> str:
    """One line per node, indented by depth, with what it reads."""
    lines = []
    for depth, col in enumerate(columns(nodes, edges)):
        for n in col:
            before = sorted(a for a, b in edges if b == n)
            lines.append("  " * depth + n + (f"  <- {', '.join(before)}" if before else ""))
    return "\n".join(lines)


def dot(nodes: list[str], edges: list[tuple[str, str]]) -> str:
    q = json.dumps
    return "\n".join(["digraph {", "  rankdir=LR;", *[f"  {q(n)};" for n in nodes], *[f"  {q(a)} -> {q(b)};" for a, b in edges], "}"])


def svg(nodes: list[str], edges: list[tuple[str, str]]) -> str:
    cols = columns(nodes, edges)
    wide = 60 + 8 * max((len(n) for n in nodes), default=0)
    at = {n: (20 + d * (wide + 60), 20 + k * 50) for d, col in enumerate(cols) for k, n in enumerate(col)}
    size = (max((x for x, _ in at.values()), default=0) + wide + 20, max((y for _, y in at.values()), default=0) + 50)
    lines = [f'<path class="edge" data-a="{html.escape(a)}" data-b="{html.escape(b)}" d="M{at[a][0] + wide},{at[a][1] + 15} C{at[a][0] + wide + 30},{at[a][1] + 15} {at[b][0] - 30},{at[b][1] + 15} {at[b][0]},{at[b][1] + 15}" fill="none" stroke="#888"/>' for a, b in edges]
    boxes = [f'<g class="node" data-name="{html.escape(n)}"><rect x="{x}" y="{y}" width="{wide}" height="30" rx="4" fill="#eef" stroke="#446"/><text x="{x + 10}" y="{y + 20}" font-family="monospace" font-size="13">{html.escape(n)}</text></g>' for n, (x, y) in at.items()]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size[0]}" height="{size[1]}">{"".join(lines + boxes)}</svg>'


SCRIPT = """
const g = JSON.parse(document.getElementById('graph').textContent), $ = id => document.getElementById(id);
const reach = (n, a, b) => { const s = new Set([n]); let more = true; while (more) { more = false; for (const e of g.edges) if (s.has(e[a]) && !s.has(e[b])) { s.add(e[b]); more = true; } } return s; };
function show(cone) {
  const find = $('find').value.toLowerCase(), key = $('key').value, rule = $('rule').value;
  for (const x of document.querySelectorAll('.node')) {
    const n = g.nodes[x.dataset.name];
    const ok = n.name.toLowerCase().includes(find) && (!key || n.keys.includes(key)) && (!rule || n.reads.some(r => r.kind === rule)) && (!cone || cone.has(n.name));
    x.style.opacity = ok ? 1 : 0.15;
  }
  for (const x of document.querySelectorAll('.edge')) x.style.opacity = !cone || (cone.has(x.dataset.a) && cone.has(x.dataset.b)) ? 1 : 0.1;
}
for (const id of ['find', 'key', 'rule']) $(id).addEventListener('input', () => show());
for (const x of document.querySelectorAll('.node')) x.addEventListener('click', () => {
  const n = g.nodes[x.dataset.name];
  $('side').textContent = [n.name, n.why, 'keys: ' + n.keys.join(', '), 'writes: ' + n.writes.join(', '), ...n.reads.map(r => 'reads ' + r.dataset + ': ' + r.text)].join('\\n');
  show(new Set([...reach(n.name, 0, 1), ...reach(n.name, 1, 0)]));
});
"""


def page(nodes: dict[str, dict], edges: list[tuple[str, str]]) -> str:
    """A page with a search box, filters by key and rule, a legend, and the cone and card of the node that is clicked."""
    keys = sorted({k for n in nodes.values() for k in n["keys"]})
    rules = sorted({r["kind"] for n in nodes.values() for r in n["reads"]})
    choose = lambda name, values: f'<select id="{name}"><option value="">any {name}</option>{"".join(f"<option>{html.escape(v)}</option>" for v in values)}</select>'
    data = json.dumps({"nodes": nodes, "edges": edges}).replace("<", "\\u003c")
    legend = "all: every partition; same: the same one; range: by bounds; in: by values; own: the last copy"
    return f'<!DOCTYPE html><meta charset="utf-8"><title>pipeline</title><p><input id="find" placeholder="find"> {choose("key", keys)} {choose("rule", rules)} <small>{legend}</small></p><div style="display:flex">{svg(list(nodes), edges)}<pre id="side"></pre></div><script type="application/json" id="graph">{data}</script><script>{SCRIPT}</script>'
