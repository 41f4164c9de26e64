"""Renderers: JSON, Markdown, HTML, charts, Parquet, the data dictionary, model, batch, comparison and history reports."""

from __future__ import annotations

import html
import json
import math
import re
from typing import Any

from pyspark.sql import SparkSession

from ..sources.xlsx import write_workbook

Payload = dict[str, Any]


def safe_names(names: list[str]) -> list[str]:
    """Names that any file system takes, each once."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[^0-9A-Za-z._-]+", "_", n).strip("._") or "table"
        name, i = base, 2
        while name.lower() in {x.lower() for x in out}:
            name, i = f"{base}_{i}", i + 1
        out.append(name)
    return out


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def to_json(payload: Any, pretty: bool = True) -> str:
    return json.dumps(_plain(payload), ensure_ascii=False, indent=2 if pretty else None, allow_nan=False)


def _cell(v: Any) -> str:
    text = "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return text.replace("|", "\\|").replace("\n", " ")


def table(rows: list[dict], columns: list[str] | None = None) -> str:
    if not rows:
        return "_none_\n"
    columns = columns or list(rows[0])
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(_cell(r.get(c)) for c in columns) + " |" for r in rows)]) + "\n"


_SECTIONS = (
    ("Personal data", "exposure", None), ("Quality", "score", None), ("Most damaged columns", "damage", None),
    ("Columns", "columns", ["column", "logical_type", "primary", "n_null", "n_distinct", "characteristic"]), ("Numbers", "numbers", None), ("Dates", "dates", None), ("Outliers", "outliers", None),
    ("Recommendations", "recommendations", ["priority", "column", "action", "rows_affected"]), ("Dependencies", "dependencies", None), ("Redundant columns", "redundancy", None), ("Correlations", "correlations", None), ("Associations", "associations", None),
    ("Rules", "rules", None), ("Derivations", "derivations", None), ("Conditional nullity", "conditional_nullity", None), ("What drives the measures", "drivers", None), ("KPI gap", "kpi_gap", None),
)


def to_markdown(p: Payload) -> str:
    m = p["metadata"]
    parts = [f"# Profile of {m['table']}\n", f"{m['n_rows']} rows, {m['n_columns']} columns.\n", *(f"- {x}" for x in p.get("insights", []))]
    if layout := m.get("layout"):
        parts += [f"- layout: {w}" for w in layout["warnings"]]
    for title, key, columns in _SECTIONS:
        rows = p.get(key) or []
        rows = [rows] if isinstance(rows, dict) else rows
        if key == "damage":
            rows = sorted((r for r in rows if r["damage"] > 0), key=lambda r: -r["damage"])[:10]
        if rows:
            parts += [f"\n## {title}\n", table(rows, columns)]
    if p.get("hierarchies"):
        parts += ["\n## Hierarchies\n", *(f"- {' > '.join(h)}" for h in p["hierarchies"])]
    if p.get("series"):
        parts += [f"\n## Series by {p['series']['grain']} of {p['series']['date']}\n", table(p["series"]["tests"]), *(f"- {explain_series(t)}" for t in p["series"]["tests"])]
    return "\n".join(parts) + "\n"


def explain_score(damage: float, share: float) -> str:
    """What a column takes from the score, in words."""
    points = round(100 * damage * share, 1)
    return "no effect on the score" if points == 0 else f"costs about {points} points of the score"


def explain_series(t: dict) -> str:
    steady = "keeps its level" if t["stationary"] else "drifts or trends"
    memory = "follows its own past" if t["autocorrelated"] else "does not follow its own past"
    return f"{t['column']} {steady} and {memory}"


# --- charts ------------------------------------------------------------------


def bars_svg(values: list[float], labels: list[str] | None = None, width: int = 240, height: int = 60) -> str:
    """A small bar chart."""
    if not values:
        return ""
    top, w = max(values) or 1, width / len(values)
    rects = "".join(f'<rect x="{i * w:.1f}" y="{height - height * v / top:.1f}" width="{max(1, w - 1):.1f}" height="{height * v / top:.1f}"><title>{html.escape(labels[i] if labels else str(v))}</title></rect>' for i, v in enumerate(values))
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}" role="img">{rects}</svg>'


def line_svg(values: list[float], width: int = 240, height: int = 60) -> str:
    if len(values) < 2:
        return ""
    lo, hi = min(values), max(values)
    points = " ".join(f"{i * width / (len(values) - 1):.1f},{height - (height * (v - lo) / (hi - lo) if hi > lo else height / 2):.1f}" for i, v in enumerate(values))
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}"><polyline fill="none" stroke="currentColor" points="{points}"/></svg>'


def completeness_svg(filled: float, width: int = 120) -> str:
    return f'<svg viewBox="0 0 {width} 8" width="{width}" height="8"><rect width="{width}" height="8" opacity=".2"/><rect width="{width * filled:.1f}" height="8"/></svg>'


def column_chart(p: Payload, column: str) -> str:
    """The histogram of a number, the frequent values of others; nothing for personal data."""
    record = next(c for c in p["columns"] if c["column"] == column)
    if record.get("pattern") or record["role"] == "person name":
        return ""
    bins = sorted((h for h in p.get("histograms", []) if h["column"] == column), key=lambda h: h["bin"])
    if bins:
        counts = {h["bin"]: h["cnt"] for h in bins}
        return bars_svg([counts.get(i, 0) for i in range(1, 19)])
    top = sorted((t for t in p.get("top_values", []) if t["column"] == column), key=lambda t: t["rnk"])
    return bars_svg([t["cnt"] for t in top], [f"{t['value']}: {t['cnt']}" for t in top])


# --- HTML --------------------------------------------------------------------

_STYLE = "body{font:15px/1.5 system-ui,sans-serif;max-width:70em;margin:2em auto;padding:0 1em}table{border-collapse:collapse;width:100%}td,th{border-bottom:1px solid #8884;padding:.3em .5em;text-align:left}svg rect{fill:#47a}@media(prefers-color-scheme:dark){body{background:#111;color:#ddd}}@media print{input{display:none}}"
_SCRIPT = "document.querySelectorAll('th').forEach(h=>h.onclick=()=>{const b=h.closest('table').tBodies[0],i=h.cellIndex,s=h.dataset.s=-(h.dataset.s||-1);[...b.rows].sort((x,y)=>s*x.cells[i].textContent.localeCompare(y.cells[i].textContent,undefined,{numeric:true})).forEach(r=>b.append(r))});const f=document.querySelector('#f');if(f)f.oninput=()=>document.querySelectorAll('tbody tr').forEach(r=>r.hidden=!r.textContent.toLowerCase().includes(f.value.toLowerCase()))"


def _html_table(rows: list[dict], columns: list[str] | None = None, raw: tuple[str, ...] = ()) -> str:
    if not rows:
        return "<p>none</p>"
    columns = columns or list(rows[0])
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{r.get(c, '') if c in raw else html.escape(_cell(r.get(c)))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def page(title: str, body: str) -> str:
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style><h1>{html.escape(title)}</h1><input id="f" placeholder="filter">{body}<script>{_SCRIPT}</script></html>'


def to_html(p: Payload) -> str:
    """One page without outside parts: sorted by clicking, filtered by typing; all data escaped."""
    m = p["metadata"]
    columns = [c | {"chart": column_chart(p, c["column"]), "filled": completeness_svg(1 - c["pct_null"])} for c in p["columns"]]
    body = f"<p>{m['n_rows']} rows, {m['n_columns']} columns. Score {p['score']['score']} ({p['score']['grade']}).</p>" + "".join(f"<p>{html.escape(x)}</p>" for x in p.get("insights", []))
    body += "<h2>Columns</h2>" + _html_table(columns, ["column", "logical_type", "primary", "n_null", "n_distinct", "characteristic", "filled", "chart"], ("filled", "chart"))
    for title, key, names in _SECTIONS:
        if key != "columns" and (rows := p.get(key)):
            body += f"<h2>{title}</h2>" + _html_table([rows] if isinstance(rows, dict) else rows, names)
    return page(f"Profile of {m['table']}", body)


def to_pdf(page_: str) -> bytes:
    """Needs the optional package weasyprint."""
    try:
        from weasyprint import HTML
    except ImportError as e:
        raise RuntimeError("PDF output needs the package weasyprint") from e
    return HTML(string=page_).write_pdf()


# --- other reports -----------------------------------------------------------


def dictionary(profiles: list[Payload]) -> bytes:
    """A workbook: a sheet a table, and one that sums up."""
    fields = ["column", "physical_type", "logical_type", "primary", "n_rows", "n_null", "pct_null", "n_distinct", "characteristic", "pattern"]
    sheets: dict[str, list[list]] = {"summary": [["table", "rows", "columns", "score", "grade"], *([p["metadata"]["table"], p["metadata"]["n_rows"], p["metadata"]["n_columns"], p["score"]["score"], p["score"]["grade"]] for p in profiles)]}
    for i, p in enumerate(profiles):
        name = p["metadata"]["table"]
        sheets[name if name not in sheets else f"{name}_{i}"] = [fields, *([c.get(f) for f in fields] for c in p["columns"])]
    return write_workbook(sheets)


def to_parquet(spark: SparkSession, p: Payload, folder: str) -> list[str]:
    """A Parquet table for each section that has rows."""
    written = []
    for key in ("columns", "recommendations", "dependencies", "correlations", "kpi_gap", "damage", "top_values"):
        if rows := p.get(key):
            flat = [{k: json.dumps(_plain(v), ensure_ascii=False) if isinstance(v, (dict, list, tuple)) else v for k, v in r.items()} for r in rows]
            names = sorted({k for r in flat for k in r})
            kinds = _kinds(flat, names)
            spark.createDataFrame([tuple(_as(r.get(k), kinds[k]) for k in names) for r in flat], ", ".join(f"`{k}` {kinds[k]}" for k in names)).write.mode("overwrite").parquet(f"{folder}/{key}")
            written.append(key)
    spark.createDataFrame([(to_json(p["metadata"], False),)], "metadata string").write.mode("overwrite").parquet(f"{folder}/metadata")
    return [*written, "metadata"]


def _kinds(rows: list[dict], names: list[str]) -> dict[str, str]:
    """A Spark type that holds each column's values."""
    order = ("boolean", "bigint", "double", "string")
    kind = lambda v: "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
    return {n: max((kind(r[n]) for r in rows if r.get(n) is not None), key=order.index, default="string") for n in names}


def _as(v: Any, kind: str) -> Any:
    return v if v is None else float(v) if kind == "double" else str(v) if kind == "string" else v


def batch_html(rows: list[Payload]) -> str:
    worst = next((r for r in rows if r["error"] is None), None)
    reading = f"<p>Lowest score: {html.escape(str(worst['table']))} ({worst['score']}).</p>" if worst else "<p>No file could be read.</p>"
    return page("Batch, worst first", reading + _html_table(rows))


def mermaid(model: Payload) -> str:
    """The links as an entity diagram."""
    name = lambda x: re.sub(r"\W", "_", x)
    return "erDiagram\n" + "".join(f"  {name(r['dst_table'])} {'||--||' if r['cardinality'] == '1:1' else '||--o{'} {name(r['src_table'])} : {name(r['src_col'])}\n" for r in model["relationships"])


def model_markdown(m: Payload) -> str:
    loading = [r["table"] for r in m["tables"] if r["role"].endswith("dimension")] + [r["table"] for r in m["tables"] if not r["role"].endswith("dimension")]
    parts = ["# Model\n", "Load in this order: " + ", ".join(loading) + "\n", "## Tables\n", table(m["tables"]), "## Links\n", table(m["relationships"]), "## Grain\n", table(m["grain"]), "## Coverage\n", table(m["coverage"]), "## Warnings\n", table(m["warnings"]), "```mermaid\n" + mermaid(m) + "```\n", "## Analyses\n", *(f"### {a['title']}\n\n```sql\n{a['sql']}\n```\n" for a in m["analyses"])]
    return "\n".join(parts)


def comparison_markdown(c: Payload) -> str:
    return "\n".join(["# Two versions\n", *(f"## {t}\n\n{table(c[k])}" for t, k in (("Warnings", "warnings"), ("Schema", "schema"), ("Columns that behave otherwise", "behaviour"), ("Numbers", "numeric_drift"), ("Categories", "categorical_drift"), ("Records", "records")))])


def history_markdown(h: Payload) -> str:
    return "\n".join(["# History\n", table(h["summary"]), "## Alerts\n", table(h["alerts"])])


def validation_markdown(v: Payload) -> str:
    return "\n".join([f"# Validation: {'approved' if v['approved'] else 'rejected'}\n", *(f"- {n}" for n in v["notes"]), table(v["violations"])])
