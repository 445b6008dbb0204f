"""One result as JSON, terminal text, Markdown or HTML; ``render`` does a table.

A result is a dict: base, head, score, classification, files, evidence,
findings, contributions and limitations. Integral numbers print without a fraction.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame

Result = Mapping[str, object]
# Markdown escapes, and the sizes at which lists are cut.
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "|": "&#124;", "\\": "&#92;", "`": "&#96;", "*": "&#42;", "_": "&#95;", "[": "&#91;", "]": "&#93;"}
FINDINGS_END, CONTRIBUTIONS_END, REPORT_END, PATHS_SHOWN = 52_000, 56_000, 60_000, 5
# Fixed values too: the sentences of the reports below.
NOTE = "_Heuristic review aid; this classification is not a safety guarantee._"


def plain(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def signed(x: float) -> str:
    return ("+" if x >= 0 else "") + plain(x)


def _clean(value: object) -> object:
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, Mapping):
        return {k: _clean(v) for k, v in value.items()}
    return [_clean(v) for v in value] if isinstance(value, (list, tuple)) else value


def as_json(result: Result) -> str:
    """K1; the data of evidence are objects, not text."""
    opened = [{**e, "data": _data(e)} for e in result.get("evidence", ())]
    return json.dumps(_clean({**result, **({"evidence": opened} if opened else {})}), indent=2, ensure_ascii=False) + "\n"


def _data(evidence: Mapping) -> object:
    return json.loads(evidence["data"]) if isinstance(evidence["data"], str) else evidence["data"]


def terminal(result: Result) -> str:
    """K2."""
    files = result["files"]
    added, removed = (sum(f[k] for f in files) for k in ("additions", "deletions"))
    out = [
        f"Change risk: {result['classification'].upper()} ({plain(result['score'])})",
        f"Revisions: {result['base']}..{result['head']}",
        f"Changed files: {len(files)} (+{added} -{removed}; {sum(bool(f.get('binary')) for f in files)} binary)",
    ]
    lists = {
        "Findings:": [f"- [{f['severity'].upper()}] {f['title']} ({signed(f['weight'])}): {f['explanation']}" for f in result["findings"]],
        "Score contributions:": [f"- {c['rule_id']}: {signed(c['weight'])} ({len(c['finding_ids'])} finding{'s' * (len(c['finding_ids']) != 1)})" for c in result["contributions"]],
        "Limitations:": [f"- {x}" for x in result["limitations"]],
    }
    for title, rows in lists.items():
        out += [title, *rows] if rows else []
    return "\n".join(out) + "\n"


def escape(text: str) -> str:
    """P25: escapes, and runs of line ends as one space."""
    return re.sub(r"[\r\n]+", " ", "".join(ESCAPES.get(c, c) for c in text))


def _code(texts: list[str]) -> str:
    return ", ".join(f"`{escape(t)}`" for t in texts)


def _until(lines: list[str], rows: Iterator[str], end: int, more: str) -> None:
    for row in rows:
        lines.append(row)
        if sum(map(len, lines)) + len(lines) - 1 > end:
            lines.append(more)
            return


def markdown(result: Result, marker: str = "<!-- change-impact-report -->") -> str:
    """K3: a comment of bounded size; lists are cut with a pointer to the JSON report."""
    verdict = f"**{result['classification'].upper()}** — score {plain(result['score'])}"
    lines = [marker, "## Change risk report", "", verdict, "", f"Analyzed `{escape(result['base'])}..{escape(result['head'])}` with {len(result['files'])} changed file(s).", ""]

    def finding(f: Mapping) -> str:
        shown = _code(f["affected_paths"][:PATHS_SHOWN])
        where = f"<br>Paths: {shown}" if shown else ""
        return f"| {f['severity'].upper()} | `{escape(f['rule_id'])}` | {escape(f['title'])} — {escape(f['explanation'])}{where}<br>Evidence: {_code(f['evidence_ids'])} | {signed(f['weight'])} |"

    if result["findings"]:
        lines += ["| Severity | Rule | Finding | Weight |", "| --- | --- | --- | ---: |"]
        _until(lines, map(finding, result["findings"]), FINDINGS_END, "| … | … | Remaining findings are available in the JSON artifact. | … |")
        lines.append("")
    else:
        lines += ["No risk-rule findings.", ""]
    if result["contributions"]:
        lines += ["<details>", "<summary>Effective score contributions</summary>", "", "| Rule | Findings | Effective contribution |", "| --- | ---: | ---: |"]
        rows = (f"| `{escape(c['rule_id'])}` | {len(c['finding_ids'])} | {signed(c['weight'])} |" for c in result["contributions"])
        _until(lines, rows, CONTRIBUTIONS_END, "| … | … | Remaining contributions are available in the JSON artifact. |")
        lines += ["", "</details>", ""]
    if result["limitations"]:
        lines += ["<details>", "<summary>Analysis limitations</summary>", "", *(f"- {escape(x)}" for x in result["limitations"]), "", "</details>", ""]
    out = "\n".join([*lines, NOTE]) + "\n"
    if len(out) > REPORT_END:
        out = "\n".join([marker, "## Change risk report", "", verdict, "", "The detailed comment exceeded the safe size limit. See the JSON artifact.", "", NOTE]) + "\n"
    return out


def _svg(nodes: list[Mapping], edges: list[Mapping]) -> str:
    at, rows = {}, {}
    for n in sorted(nodes, key=lambda n: (n["distance"], n["path"])):
        row = rows[n["distance"]] = rows.get(n["distance"], -1) + 1
        at[n["path"]] = (30 + 260 * n["distance"], 55 + 72 * row)
    lines = [f'<line x1="{at[e["src"]][0]}" y1="{at[e["src"]][1]}" x2="{at[e["dst"]][0]}" y2="{at[e["dst"]][1]}"/>' for e in edges if e["src"] in at and e["dst"] in at]
    boxes = [f'<text x="{x}" y="{y}">{html.escape(p if len(p) <= 34 else "…" + p[-33:])}</text>' for p, (x, y) in at.items()]
    wide, high = (max((v[k] for v in at.values()), default=0) + (260, 72)[k] for k in (0, 1))
    return f'<svg viewBox="0 0 {wide} {high}" role="img">{"".join(lines + boxes)}</svg>'


def page(result: Result, blast: Mapping | None = None) -> str:
    """K4: a page without scripts or outside references."""
    e = lambda x: html.escape(str(x))
    listed = lambda rows: "".join(f"<li>{r}</li>" for r in rows)
    part = lambda title, rows: f"<h2>{title}</h2><ul>{items}</ul>" if (items := listed(rows)) else ""
    most = max((abs(c["weight"]) for c in result["contributions"]), default=0) or 1
    evidence = result.get("evidence", ())
    number = {x["id"]: k for k, x in enumerate(evidence, 1)}

    def finding(f: Mapping) -> str:
        known = [f"<a href='#evidence-{number[x]}'>{e(x)}</a>" if x in number else e(x) for x in f["evidence_ids"]]
        guidance = f"<br>Review guidance: {e(f['remediation'])}" if f.get("remediation") else ""
        return f"<b>{e(f['severity'].upper())}</b> {e(f['title'])} ({signed(f['weight'])}): {e(f['explanation'])}<br>{e(', '.join(f['affected_paths']))}<br>Evidence: {' '.join(known)}{guidance}"

    body = [
        f"<h1>{e(result['classification'].upper())} ({plain(result['score'])})</h1><p>{e(result['base'])}..{e(result['head'])}</p>",
        part("Contributions", [f'{e(c["rule_id"])} {signed(c["weight"])} <meter min="0" max="1" value="{abs(c["weight"]) / most:.3f}"></meter>' for c in result["contributions"]]),
        part("Findings", map(finding, result["findings"])),
        part("Changed files", [f"<code>{e(f['path'])}</code> {e(f['status'])}{' from ' + e(f['previous_path']) if f.get('previous_path') else ''}{' · binary' if f.get('binary') else ''} [{e(', '.join(f.get('categories', ())))}] +{f['additions']} −{f['deletions']}" for f in result["files"]]),
        part("Evidence", [f"<details id='evidence-{number[x['id']]}'><summary><code>{e(x['id'])}</code> {e(x['summary'])}</summary><p>{e(x['kind'])}: {e(', '.join(x.get('source_paths') or ()))}</p><pre>{e(json.dumps(_data(x), indent=2, ensure_ascii=False))}</pre></details>" for x in evidence]),
        part("Limitations", [e(x) for x in result["limitations"]]),
        f"<h2>Blast radius</h2>{_svg(blast['nodes'], blast['edges'])}{'<p>This graph is incomplete.</p>' if blast.get('truncated') else ''}" if blast else "",
        part("Changed source paths not indexed", [f"<code>{e(x)}</code>" for x in (blast or {}).get("unindexed", ())]),
    ]
    policy = "default-src 'none'; style-src 'unsafe-inline'"
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}"><title>Change risk report</title></head><body>{"".join(body)}</body></html>\n'


def render(results: DataFrame, formatter: Callable[[Result], str] = terminal) -> DataFrame:
    """change_id, report for every row of a result table (see plans.analyze)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"change_id": frame["change_id"].astype(str), "report": [formatter(json.loads(x)) for x in frame["result"]]})

    from pyspark.sql import functions as F

    return results.select(F.col("change_id").cast("string"), F.to_json(F.struct("*")).alias("result")).mapInPandas(run, "change_id string, report string")
