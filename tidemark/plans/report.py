"""The report of a run: Markdown, and one self-contained HTML page with its charts inline."""

from __future__ import annotations

import html
from pathlib import Path
from typing import Any

from .findings import Finding

_STYLE = "body{max-width:60rem;margin:2rem auto;font:15px/1.5 sans-serif;color:#222}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2rem .5rem;text-align:left}pre{background:#f4f4f4;padding:.6rem;overflow-x:auto}svg{max-width:100%}"


def line_chart(points: list[tuple[str, float]], title: str, width: int = 860, height: int = 260) -> str:
    """A line over periods as SVG; empty for no points."""
    if not points:
        return ""
    top, left = max(max(v for _, v in points), 1e-9), 50
    x = lambda i: left + i * (width - left - 20) / max(1, len(points) - 1)
    y = lambda v: height - 40 - max(v, 0) / top * (height - 80)
    path = " ".join(f"{x(i):.1f},{y(v):.1f}" for i, (_, v) in enumerate(points))
    return _svg(f'<polyline points="{path}" fill="none" stroke="#1f6f8b" stroke-width="2"/>', [(x(i), p) for i, (p, _) in enumerate(points)], title, width, height, top)


def bar_chart(points: list[tuple[str, float]], title: str, width: int = 860, height: int = 260) -> str:
    """Bars over periods as SVG, the last two set off; empty for no points."""
    if not points:
        return ""
    top, left, step = max(max(v for _, v in points), 1e-9), 50, (860 - 70) / len(points)
    bars = ""
    for i, (_, v) in enumerate(points):
        h = max(v, 0) / top * (height - 80)
        bars += f'<rect x="{left + i * step + 2:.1f}" y="{height - 40 - h:.1f}" width="{max(step - 4, 1):.1f}" height="{h:.1f}" fill="{"#c8553d" if i >= len(points) - 2 else "#1f6f8b"}"/>'
    return _svg(bars, [(left + (i + 0.5) * step, p) for i, (p, _) in enumerate(points)], title, width, height, top)


def _svg(body: str, labels: list[tuple[float, str]], title: str, width: int, height: int, top: float) -> str:
    every = -(-len(labels) // 12)
    marks = "".join(f'<text x="{x:.1f}" y="{height - 20}" font-size="10" text-anchor="middle">{html.escape(p)}</text>' for x, p in labels[::every])
    return f'<svg viewBox="0 0 {width} {height}" xmlns="http://www.w3.org/2000/svg"><text x="10" y="16" font-size="13">{html.escape(title)} (most: {top:,.0f})</text>{body}{marks}</svg>'


def _number(key: str, value: Any) -> str:
    if isinstance(value, float):
        return f"{value:+.1%}" if key == "delta_pct" else f"{value:,.2f}" if abs(value) >= 100 else f"{value:.3f}"
    return str(value)


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    clean = lambda r: " | ".join(c.replace("|", "/").replace("\n", " ") for c in r)
    return [f"| {clean(head)} |", "|" + "---|" * len(head), *(f"| {clean(r)} |" for r in rows), ""]


def finding_lines(f: Finding) -> list[str]:
    """A finding as Markdown lines: numbers, drill-down, tests, causal check, caveats and evidence."""
    out = [f"## {f.rank}. {f.title}", ""]
    if f.confidence is not None:
        out += [f"Confidence {f.confidence:.0%}, score {f.score:.3f}.", ""]
    if f.narrative:
        out += [f.narrative, ""]
    if f.headline:
        out += _table(["number", "value"], [[k, _number(k, v)] for k, v in f.headline.items()])
    if f.drill_down:
        share = lambda d: "n/a" if d["contribution_pct"] is None else f"{d['contribution_pct']:.0%}"
        out += _table(["dimension", "value", "change", "share of the change", "orders"], [[d["dimension"], d["entity"], f"{d['delta_pct']:+.1%}", share(d), str(d["n"])] for d in f.drill_down])
    if f.stats:
        show = lambda v, spec: "-" if v is None else format(v, spec)
        out += _table(["test", "statistic", "p", "effect"], [[t.name, show(t.statistic, ".3g"), show(t.p_value, ".2e"), show(t.effect_size, ".3f")] for t in f.stats])
    if f.causal is not None:
        c = f.causal
        out += [f"Causal check: {c.verdict} ({c.method})", ""]
        if c.effect is not None:
            out += [f"- effect {c.effect:,.1f}, p = {c.p_value:.3g}" + (f", 95 % interval {c.interval[0]:,.1f} to {c.interval[1]:,.1f}" if c.interval else "")]
        out += [*(f"- {d}" for d in c.details), ""]
    if f.caveats:
        out += ["Caveats: " + "; ".join(f.caveats), ""]
    for e in f.evidence:
        title = f"Evidence in SQL ({'verified' if e.verified else 'not verified'}):" if e.kind == "sql" else "Evidence in PySpark:"
        out += [title, "", f"```{e.kind}", e.code, "```", ""]
        if e.preview:
            out += ["```text", e.preview, "```", ""]
    return out


def to_html(lines: list[str], charts: dict[str, str]) -> str:
    """The subset of Markdown that the report uses, as a page: headings, tables, fences, lists, charts by name and paragraphs."""
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        if line.startswith("```"):
            stop = next((j for j in range(i + 1, len(lines)) if lines[j].startswith("```")), len(lines))
            out.append("<pre>" + html.escape("\n".join(lines[i + 1 : stop])) + "</pre>")
            i = stop
        elif line.startswith("#"):
            level = len(line) - len(line.lstrip("#"))
            out.append(f"<h{level}>{html.escape(line[level:].strip())}</h{level}>")
        elif line.startswith("|"):
            rows = []
            while i < len(lines) and lines[i].startswith("|"):
                rows.append([c.strip() for c in lines[i].strip("|").split("|")])
                i += 1
            body = [r for r in rows[1:] if any(c.strip("-") for c in r)]
            out.append("<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in rows[0]) + "</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in r) + "</tr>" for r in body) + "</table>")
            continue
        elif line.startswith("!["):
            name = line[line.index("(") + 1 : -1]
            out.append(charts.get(name, ""))
        elif line.startswith("- "):
            out.append(f"<li>{html.escape(line[2:])}</li>")
        elif line:
            out.append(f"<p>{html.escape(line)}</p>")
        i += 1
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Report</title><style>{_STYLE}</style></head><body>' + "\n".join(out) + "</body></html>"


def write(result: Any, folder: str) -> dict[str, Path]:
    """report.md, report.html and the charts as .svg of a run (plans.pipeline.Result); returns their paths."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    charts = {"monthly_revenue.svg": line_chart(result.monthly, "Revenue per month"), "quarterly_revenue.svg": bar_chart(result.quarterly, "Revenue per quarter")}
    lines = ["# Report", "", f"{len(result.findings)} findings over {result.source} in {result.seconds:.1f} s.", "", "## Tables", ""]
    lines += _table(["table", "rows", "columns", "most missing"], [[p.name, f"{p.n_rows:,}", str(len(p.dtypes)), f"{max(p.missing.values(), default=0):.0%}"] for p in result.profiles.values()])
    lines += ["## Joins", "", "```text", *(f"{j.left}.{j.column} = {j.right}.{j.column} ({j.overlap:.0%})" for j in result.joins), "```", ""]
    lines += ["## Summary", "", result.summary, "", *(x for name in charts for x in (f"![{name}]({name})", "")), "# Findings", ""]
    for f in result.findings:
        lines += finding_lines(f)
    paths = {"markdown": root / "report.md", "html": root / "report.html"}
    paths["markdown"].write_text("\n".join(lines))
    paths["html"].write_text(to_html(lines, charts))
    for name, svg in charts.items():
        paths[name] = root / name
        paths[name].write_text(svg)
    return paths
