"""Reports: levels of detail, filters, Markdown and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeproof.functions.text import basename, blank_as_null, escape_html

COMPACT = ["doc_id", "citation_id", "raw_text", "status", "risk", "verified_doi", "evidence_status", "claim", "evidence_text", "evidence_granularity"]
DETAILED = [*COMPACT, "reference_confidence", "claim_alignment_score", "alignment_state"]
DEBUG = [*DETAILED, "verified_title", "match_margin", "failure_reason"]


def disclose(results: DataFrame, level: str | None = "compact") -> DataFrame:
    """The columns of a level of detail; an unknown level shows the compact ones."""
    columns = {"detailed": DETAILED, "debug": DEBUG}.get((level or "compact").lower(), COMPACT)
    return results.select(*[c for c in columns if c in results.columns])


def shown_title(verified: Column, title: Column, raw: Column, length: int) -> Column:
    return F.coalesce(blank_as_null(verified), blank_as_null(title), F.substring(raw, 1, length))


def doi_link(doi: Column) -> Column:
    """local, web or none."""
    return F.when(F.coalesce(doi, F.lit("")) == "", "none").when(F.startswith(doi, F.lit("cnki.local")), "local").otherwise("web")


def filtered(results: DataFrame, risk: str = "all", search: str = "") -> DataFrame:
    """Rows of a risk (or all) whose title and id contain the search text."""
    text = F.lower(F.concat_ws(" ", "title", "citation_id"))
    return results.where((F.lit(risk) == "all") | (F.col("risk") == risk)).where(F.contains(text, F.lit(search.strip().lower())))


def badge(risk: Column) -> Column:
    marks = {"DANGER": "🔴", "WARNING": "🟡", "NOTICE": "🔵", "PASS": "🟢"}
    out = F.lit("")
    for name, mark in marks.items():
        out = F.when(risk == name, mark).otherwise(out)
    return out


def _document(results: DataFrame, one: Column, row: Column) -> DataFrame:
    """(doc_id, counts, cards, rows): texts of the results of each document, in line order; a document's results are few."""
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", c.alias("t")))), lambda s: s["t"]), "\n")
    counts = [F.count_if(F.col("risk") == r).alias(r.lower()) for r in ("PASS", "NOTICE", "WARNING", "DANGER")]
    return results.groupBy("doc_id").agg(F.count("*").alias("total"), *counts, ordered(F.when(F.col("risk") != "PASS", one).otherwise("")).alias("cards"), ordered(row).alias("rows"))


def markdown(results: DataFrame) -> DataFrame:
    """(doc_id, markdown): counts, what needs attention, and a table of all citations."""
    title = shown_title(F.col("verified_title"), F.col("title"), F.col("raw_text"), 30)
    doi = F.coalesce("verified_doi", "doi")
    one = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), badge(F.col("risk")), F.lit(" ["), F.col("risk"), F.lit("] "), F.coalesce(blank_as_null(F.col("title")), F.substring("raw_text", 1, 50))),
        F.concat(F.lit("- place: "), F.coalesce("location_info", F.lit("unknown"))),
        F.concat(F.lit("- status: `"), F.col("status"), F.lit("`")),
        F.when(doi.isNotNull(), F.concat(F.lit("- DOI: ["), doi, F.lit("](https://doi.org/"), doi, F.lit(")"))),
        F.concat(F.lit('- claim: *"'), F.col("claim"), F.lit('"*')),
        F.when(F.col("evidence_text") != "", F.concat(F.lit("- evidence: "), F.substring("evidence_text", 1, 200), F.lit("..."))),
    )
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "citation_id", title, "status", "risk"), F.lit(" |"))
    df = _document(results, one, row)
    head = F.concat(F.lit("# Citation audit\n**file**: `"), basename(F.col("doc_id").cast("string")), F.lit("`\n**citations**: "), F.col("total"), F.lit(" | 🟢 "), F.col("pass"), F.lit(" | 🔵 "), F.col("notice"), F.lit(" | 🟡 "), F.col("warning"), F.lit(" | 🔴 "), F.col("danger"), F.lit("\n\n---\n## Needs attention\n"))
    cards = F.when(F.col("total") == F.col("pass"), "> 🟢 nothing\n").otherwise(F.regexp_replace("cards", r"\n{2,}", "\n"))
    return df.select("doc_id", F.concat(head, cards, F.lit("\n---\n## All citations\n| ID | title | status | risk |\n|---|---|---|---|\n"), F.col("rows")).alias("markdown"))


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Citation audit</title><style>
body{font-family:sans-serif;margin:2em}.bar{display:flex;height:8px}.bar div{height:8px}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px}
.PASS{background:#2a2}.NOTICE{background:#28c}.WARNING{background:#ca2}.DANGER{background:#c22}</style></head><body>"""
_SCRIPT = """<script>const q=document.getElementById('q'),r=document.getElementById('r');function go(){for(const e of document.querySelectorAll('tr[data-risk]'))
e.hidden=!((r.value==='all'||e.dataset.risk===r.value)&&e.dataset.search.includes(q.value.trim().toLowerCase()))}q.oninput=r.onchange=go</script></body></html>"""


def html(results: DataFrame) -> DataFrame:
    """(doc_id, html): a page by itself, with a bar of the risks and a table to filter by risk and text."""
    title = shown_title(F.col("verified_title"), F.col("title"), F.col("raw_text"), 70)
    cells = [escape_html(F.coalesce(c.cast("string"), F.lit(""))) for c in (F.col("citation_id"), title, F.col("status"), F.col("risk"), F.coalesce("verified_doi", "doi"), F.col("claim"), F.col("evidence_text"))]
    search = escape_html(F.lower(F.concat_ws(" ", title, "citation_id")))
    row = F.concat(F.lit('<tr data-risk="'), F.col("risk"), F.lit('" data-search="'), search, F.lit('"><td>'), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))
    df = _document(results, F.lit(""), row)
    bar = F.concat(*[F.concat(F.lit(f'<div class="{r}" style="width:'), F.round(100 * F.col(r.lower()) / F.greatest("total", F.lit(1)), 1), F.lit('%"></div>')) for r in ("PASS", "NOTICE", "WARNING", "DANGER")])
    head = F.concat(F.lit(_PAGE + "<h1>"), escape_html(F.col("doc_id").cast("string")), F.lit("</h1><p>"), F.col("total"), F.lit(' citations, pass rate '), F.round(100 * F.col("pass") / F.greatest("total", F.lit(1)), 1), F.lit('%</p><div class="bar">'), bar, F.lit('</div><select id="r"><option>all<option>PASS<option>NOTICE<option>WARNING<option>DANGER</select><input id="q"><table>'))
    return df.select("doc_id", F.concat(head, F.col("rows"), F.lit("</table>" + _SCRIPT)).alias("html"))


def terminal(results: DataFrame) -> DataFrame:
    return results.select("citation_id", F.substring("raw_text", 1, 40).alias("citation"), "status", "risk", F.substring("evidence_text", 1, 40).alias("evidence"))
