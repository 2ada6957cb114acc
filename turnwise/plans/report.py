"""Reports as HTML with inline SVG, drawn from small aggregates: a point per bucket, never a row of data."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame

from turnwise.operators import judge
from turnwise.plans.progress import duration_text as format_duration  # noqa: F401  a name of the reports

COLOURS = ("#1f5fa8", "#d97706", "#15803d", "#b91c1c", "#7c3aed", "#0e7490", "#a16207", "#be185d", "#4d7c0f", "#334155", "#ea580c", "#0369a1", "#94a3b8")
STYLE = "body{font:14px/1.5 sans-serif;max-width:860px;margin:2em auto}figure{margin:1.5em 0}svg{width:100%;touch-action:none}table{border-collapse:collapse}td,th{border:1px solid #ddd;padding:2px 8px}blockquote{color:#475569}"
# wheel zooms a chart around the pointer, dragging moves it, a double click brings it back
ZOOM = """<script>document.querySelectorAll('svg').forEach(s=>{const o=s.getAttribute('viewBox'),b=()=>s.getAttribute('viewBox').split(' ').map(Number);let d=null;
s.onwheel=e=>{e.preventDefault();const v=b(),r=s.getBoundingClientRect(),f=e.deltaY<0?.8:1.25,x=v[0]+(e.clientX-r.left)/r.width*v[2];s.setAttribute('viewBox',[x-(x-v[0])*f,v[1],v[2]*f,v[3]].join(' '))};
s.onpointerdown=e=>{d=[e.clientX,b()]};s.onpointermove=e=>{if(d){const r=s.getBoundingClientRect();s.setAttribute('viewBox',[d[1][0]-(e.clientX-d[0])/r.width*d[1][2],...d[1].slice(1)].join(' '))}};
window.addEventListener('pointerup',()=>d=null);s.ondblclick=()=>s.setAttribute('viewBox',o)})</script>"""


def slug(name: str) -> str:
    """A name for files: everything but letters of ASCII, digits, dot, dash and underscore becomes an underscore."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name)


def title(metric: str) -> str:
    """A metric's name without its layer, as words."""
    return re.sub(r"^(?:layer_[ab]|content)_", "", metric).replace("_", " ")


def metric_names(columns: list[str]) -> list[str]:
    """Metrics of an aggregate that have a median and both quartiles."""
    return [m for m in (c[: -len("_median")] for c in columns if c.endswith("_median")) if f"{m}_q1" in columns and f"{m}_q3" in columns]


def _frame(name: str, inner: str, labels: list[str], width: int, height: int) -> str:
    ends = f'<text x="40" y="{height - 4}" font-size="10">{html.escape(labels[0][:10])}</text><text x="{width - 80}" y="{height - 4}" font-size="10">{html.escape(labels[-1][:10])}</text>' if labels else ""
    return f'<figure><figcaption>{html.escape(name)}</figcaption><svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img">{inner}{ends}</svg></figure>'


def line_chart(points: list[tuple], name: str, width: int = 760, height: int = 200) -> str:
    """Median line with its quartile band and, where points carry a fifth value, bars of the number of rows; points without a
    median are left out. Empty text without points."""
    drawn = [p for p in points if p[1] is not None]
    if not drawn:
        return ""
    values = [v for p in drawn for v in p[1:4] if v is not None]
    low, high = min(values), max(values)
    x = lambda i: 40 + i * (width - 60) / max(1, len(drawn) - 1)
    y = lambda v: height - 45 - (v - low) * (height - 70) / ((high - low) or 1)
    band = [f"{x(i):.1f},{y(p[3]):.1f}" for i, p in enumerate(drawn) if p[3] is not None] + [f"{x(i):.1f},{y(p[2]):.1f}" for i, p in reversed(list(enumerate(drawn))) if p[2] is not None]
    line = " ".join(f"{x(i):.1f},{y(p[1]):.1f}" for i, p in enumerate(drawn))
    counts = [p[4] if len(p) > 4 and p[4] else 0 for p in drawn]
    wide = max(1.0, 0.7 * (width - 60) / len(drawn))
    bars = "".join(f'<rect class="n" x="{x(i) - wide / 2:.1f}" y="{height - 18 - 20 * n / max(counts):.1f}" width="{wide:.1f}" height="{20 * n / max(counts):.1f}" fill="#cbd5e1"><title>N={n}</title></rect>' for i, n in enumerate(counts) if n)
    inner = f'<polygon points="{" ".join(band)}" fill="#cfe3f7"/>{bars}<polyline points="{line}" fill="none" stroke="{COLOURS[0]}" stroke-width="1.5"/><text x="4" y="{y(high):.0f}" font-size="10">{high:.4g}</text><text x="4" y="{y(low):.0f}" font-size="10">{low:.4g}</text>'
    return _frame(name, inner, [str(p[0]) for p in drawn], width, height)


def stacked_chart(shares: list[tuple[str, str, float]], name: str, width: int = 760, height: int = 220) -> str:
    """Shares (bucket, category, share) as one stacked bar a bucket with a legend; empty text without shares."""
    buckets = sorted({str(b) for b, _, _ in shares})
    totals: dict[str, float] = {}
    for _, c, v in shares:
        totals[c] = totals.get(c, 0.0) + (v or 0.0)
    order = sorted(totals, key=lambda c: (-totals[c], c))
    if not buckets:
        return ""
    colour = {c: COLOURS[i % len(COLOURS)] for i, c in enumerate(order)}
    cell = {(str(b), c): v or 0.0 for b, c, v in shares}
    wide, out = (width - 170) / len(buckets), []
    for i, b in enumerate(buckets):
        top = height - 20.0
        for c in order:
            tall = cell.get((b, c), 0.0) * (height - 30)
            top -= tall
            if tall > 0:
                out.append(f'<rect x="{40 + i * wide:.1f}" y="{top:.1f}" width="{0.9 * wide:.1f}" height="{tall:.1f}" fill="{colour[c]}"><title>{html.escape(f"{b[:10]} {c}: {100 * cell[b, c]:.1f} %")}</title></rect>')
    out += [f'<rect x="{width - 120}" y="{10 + 14 * i}" width="9" height="9" fill="{colour[c]}"/><text x="{width - 107}" y="{18 + 14 * i}" font-size="10">{html.escape(c)}</text>' for i, c in enumerate(order)]
    return _frame(name, "".join(out), buckets, width - 120, max(height, 24 + 14 * len(order)))


def bar_chart(bars: list[tuple[str, float]], name: str, width: int = 760) -> str:
    """Horizontal bars with their values; empty text without any."""
    if not bars:
        return ""
    most = max(abs(v or 0) for _, v in bars) or 1
    out = "".join(f'<text x="4" y="{16 + 18 * i}" font-size="11">{html.escape(str(k))}</text><rect x="220" y="{6 + 18 * i}" width="{abs(v or 0) / most * (width - 290):.1f}" height="12" fill="{COLOURS[0]}"/><text x="{226 + abs(v or 0) / most * (width - 290):.0f}" y="{16 + 18 * i}" font-size="10">{v:.4g}</text>' for i, (k, v) in enumerate(bars))
    return _frame(name, out, [], width, 18 * len(bars) + 12)


def table(rows: list[dict], columns: list[str]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else html.escape(str(v))
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(r.get(c))}</td>" for c in columns) + "</tr>" for r in rows) + "</table>"


def markdown_table(rows: list[dict], columns: list[str]) -> list[str]:
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "/").replace("\n", " ")
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)]


def page(name: str, parts: list[str], lang: str = "en") -> str:
    return f'<!doctype html><html lang="{lang}"><head><meta charset="utf-8"><title>{html.escape(name)}</title><style>{STYLE}</style></head><body><h1>{html.escape(name)}</h1>{"".join(parts)}{ZOOM}</body></html>'


def _list(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict() for r in df.orderBy(*order).collect()]


def trend_figures(wide: DataFrame, bucket: str, texts: dict[str, str] | None = None) -> dict[str, str]:
    """A chart per metric of a rollup (a row a bucket): median, quartiles and number of rows, captioned with the metric's text."""
    rows = _list(wide, bucket)
    return {m: line_chart([(str(r[bucket]), r[f"{m}_median"], r[f"{m}_q1"], r[f"{m}_q3"], r["n_rows"]) for r in rows], f"{title(m)}. {(texts or {}).get(m, '')}".strip()) for m in metric_names(wide.columns)}


def share_figure(shares: DataFrame, bucket: str, name: str) -> str:
    """Stacked shares of a categorical rollup, the rarer categories already folded."""
    return stacked_chart([(str(r[bucket]), r["_category"], r["share"]) for r in shares.collect()], name)


def run_report(manifest: dict, figures: dict[str, str], language: str, totals: DataFrame, warnings: list[str] | None = None) -> str:
    """The report of a run, in Russian: facts, daily length, shares of languages and a chart per metric by day."""
    facts = table([{"показатель": k, "значение": v} for k, v in manifest.items() if not isinstance(v, dict)], ["показатель", "значение"])
    days = [(str(r["bucket_day"]), r["total_seconds"] / 60, None, None, r["n_rows"]) for r in _list(totals, "bucket_day")]
    notes = [f"<p>Внимание: {html.escape(w)}</p>" for w in warnings or []]
    return page(f"Отчёт о прогоне {manifest.get('run_id')}", [facts, *notes, line_chart(days, "Суммарная длительность за день, минуты"), language, *[figures[m] for m in sorted(figures) if figures[m]]], "ru")


def duration_report(months: DataFrame, bins: DataFrame, shares: DataFrame | None = None) -> str:
    """Monthly duration summaries, the histogram of minutes and the shares of short and long ones."""
    rows, counts = _list(months, "month"), _list(bins, "bin")
    parts = [line_chart([(r["month"], r["median"], r["p25"], r["p75"], r["n"]) for r in rows], "median seconds"), bar_chart([(f"{r['left']} to {r['right']} min", r["count"]) for r in counts], "transcripts by minutes"), table(rows, months.columns), table(counts, bins.columns)]
    if shares is not None:
        parts.append(table(_list(shares, "month"), shares.columns))
    return page("Durations", parts)


def research_report(language: DataFrame, categories: DataFrame, movers: dict, months: DataFrame, movements: DataFrame) -> str:
    """The closing report: shares of languages and categories over months, what moves most, the months that stand out and durations."""
    rows = _list(months, "month")
    facts = [f"<p>{html.escape(k)}: {html.escape(str(v))}</p>" for k, v in movers.items() if v is not None]
    return page(
        "Findings",
        ["<h2>Languages</h2>", share_figure(language, "bucket_month", "share of languages by month"), "<h2>Categories</h2>", share_figure(categories, "bucket_month", "share of categories by month"), "<h2>What moves</h2>", bar_chart([(r["_category"], r["span"]) for r in _list(movements, "_category")], "largest change of a monthly share"), *facts,
         "<h2>Durations</h2>", line_chart([(r["month"], r["median"], r["p25"], r["p75"], r["n"]) for r in rows], "median seconds by month"), table(rows, ["month", "n", "median", "p25", "p75", "p95"])],
    )


SCORE = "confidence_weighted_mean_transcription_quality_score"


def judge_report(summaries: DataFrame, cards: DataFrame, deltas: DataFrame | None = None, worst: DataFrame | None = None, top: DataFrame | None = None) -> str:
    """Monthly review scores, how they moved, failure modes and the weakest transcript of each month, as Markdown."""
    months = _list(summaries, "month", "sample_group")
    out = ["# Review of transcripts", "", "## Scores by month", "", *markdown_table(months, summaries.columns)]
    if deltas is not None:
        out += ["", "## First to last month", ""] + [f"- {r['sample_group']}: {r['delta']:+.3f}" for r in _list(deltas, "sample_group")]
    if top is not None:
        out += ["", "## Most frequent failure modes", ""] + [f"- {r['failure_mode']}: {r['n']}" for r in top.collect()]
    out += ["", "## Failure modes by month", ""] + [f"- {r['month']}: {r['failure_mode']} ({r['count']}, {r['pct_of_mentions']:.0f} % of mentions)" for r in _list(cards, "month", "place")]
    if worst is not None:
        out += ["", "## Weakest transcript of each month", ""] + [f"- {r['month']} {r['transcript_id']}: " + ", ".join(f"{c.removesuffix('_score')} {r[c]}" for c in judge.SCORES) + f". {r['evidence']}" for r in _list(worst, "month")]
    return "\n".join(out) + "\n"


def judge_page(summaries: DataFrame, cards: DataFrame, panel: DataFrame, worst: DataFrame, low: DataFrame, reasons: DataFrame) -> str:
    """The review as a page: a chart per score, the last month against the one before, failure modes and examples of low scores."""
    months = _list(summaries.filter(f"sample_group = '{judge.REPRESENTATIVE}'"), "month")
    charts = [line_chart([(r["month"], r[f"confidence_weighted_mean_{c}"], None, None, r["n_evaluated"]) for r in months], title(c)) for c in judge.SCORES]
    last = _list(panel, "month")
    modes: dict[str, float] = {}
    for r in _list(cards, "month", "place"):
        modes[r["failure_mode"]] = modes.get(r["failure_mode"], 0) + r["count"]
    examples = [f"<blockquote><b>{html.escape(r['month'])} {html.escape(r['transcript_id'])}</b> {html.escape(r['evidence'] or '')}</blockquote>" for r in _list(low, "month", "place")]
    return page(
        "Review of transcripts",
        ["<h2>Scores</h2>", *charts, "<h2>Last month</h2>", table(last, panel.columns), "<h2>Failure modes</h2>", bar_chart(sorted(modes.items(), key=lambda x: (-x[1], x[0])), "mentions"), "<h2>Why transcripts were picked</h2>", bar_chart([(r["selection_reason"] or "?", r["n"]) for r in _list(reasons, "selection_reason")], "transcripts"),
         "<h2>Weakest transcript of each month</h2>", table(_list(worst, "month"), ["month", "transcript_id", *judge.SCORES, "judge_confidence", "evidence"]), "<h2>Low scores</h2>", *examples],
    )


# what each score from 1 to 5 means, worst to best
RUBRIC = {
    "transcription_quality_score": ("unusable or empty", "parts can be understood, many recognition errors", "the gist is clear, errors are easy to see", "clear and readable, few errors", "reads like natural speech"),
    "diarization_quality_score": ("no usable speakers where several talk", "labels jump or break up turns", "speakers can be told apart with some mistakes", "turns mostly right", "turns right throughout"),
    "timestamp_structure_score": ("no readable times", "times often broken", "times mostly there, some broken", "times regular and readable", "times fine and in step with the turns"),
    "artifact_severity_score": ("artefacts outweigh the speech", "artefacts often get in the way", "artefacts are visible, the text is usable", "few artefacts", "no artefacts worth a mention"),
    "judge_confidence": ("far too little to judge by", "weak", "moderate", "high", "very high"),
}


def prompt() -> str:
    """What a reviewer is asked: the task, the scores and the form of the answer."""
    form = {
        "rubric_version": "llm_judge_v1", "overall_notes": "text",
        "per_transcript": [{"transcript_id": "text", "month": "YYYY-MM", **{c: 1 for c in RUBRIC}, "primary_failure_modes": ["short label"], "evidence": "one sentence that rests on the text"}],
        "monthly_summary": [{"month": "YYYY-MM", "n_evaluated": 0, **{f"mean_{c}": 0.0 for c in judge.SCORES}, "confidence_weighted_takeaway": "text"}],
        "trend_assessment": {"direction": "improved | worsened | mixed | no_clear_change", "strongest_evidence": "text", "main_limitations": ["text"]},
    }
    out = [
        "# Review of transcription and diarization quality", "",
        "Score each transcript below on its own and only by what it shows. Topic, speakers and outside knowledge do not count.",
        "Where `excerpt_limited` is true the text is a part of a longer one: judge what is there and lower the confidence if it is too little.",
        "Answer with JSON in the form given and nothing else.", "", "## Form of the answer", "", "```json", json.dumps(form, indent=2), "```", "", "## Scores", "",
    ]
    for score, meanings in RUBRIC.items():
        out += [f"`{score}`", *(f"- {i}: {m}" for i, m in enumerate(meanings, 1)), ""]
    return "\n".join(out)


def packet(sample: DataFrame, seed: int, per_month: int, max_chars: int) -> str:
    """The prompt packet of a sample with excerpts: the task, metadata as JSON and one section per transcript with what is known of it."""
    rows = [r.asDict() for r in sample.orderBy("month", "transcript_id").toLocalIterator()]
    months: dict[str, int] = {}
    for r in rows:
        months[r["month"]] = months.get(r["month"], 0) + 1
    meta = {"sampling_seed": seed, "target_samples_per_month": per_month, "max_transcript_chars": max_chars, "selected_transcripts": len(rows), "selected_by_month": months}
    parts = [prompt(), "## Packet Metadata", "", "```json", json.dumps(meta, indent=2, ensure_ascii=False), "```", ""]
    for r in rows:
        known = {k: v for k, v in r.items() if k not in ("excerpt", "created_at")}
        parts += [f"## {r['transcript_id']} ({r['month']}, {r['selection_reason']})", "", "```json", json.dumps(known, ensure_ascii=False, default=str), "```", "", "```text", r["excerpt"], "```", ""]
    return "\n".join(parts)
