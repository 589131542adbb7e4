"""From files to reports, with a provider that runs in the test."""

from __future__ import annotations

import json
import os
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

import pytest
from pyspark.sql import functions as F

from citeproof.__main__ import main
from citeproof.app import audit_path, verify_text
from citeproof.operators.cache import Table
from citeproof.sources.connectors import Connection
from citeproof.sources.fetch import Client, Pace, Policy
from citeproof.sources.reports import file_name, write_reports

ABSTRACT = {"Deep": [0], "networks": [1], "improve": [2], "protein": [3], "folding": [4], "accuracy.": [5]}
WORKS = {
    "10.1000/fold": {"title": "Deep networks for protein folding", "doi": "https://doi.org/10.1000/fold", "publication_year": 2021, "abstract_inverted_index": ABSTRACT, "authorships": [{"author": {"display_name": "Jane Roe"}}]},
    "10.1000/bad": {"title": "RETRACTED: Cold fusion in a jar", "doi": "https://doi.org/10.1000/bad", "publication_year": 2010, "authorships": []},
}
TITLED = {"Graph sampling at large scale": {"title": "Graph sampling at large scale", "doi": "10.1000/graph", "publication_year": 2019, "authorships": [{"author": {"display_name": "Ann Lee"}}]}}


class Provider(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def do_GET(self):
        at = urlsplit(self.path)
        self.server.asked[self.path] += 1
        self.server.connections.add(self.client_address)
        asked = {k: v[0] for k, v in parse_qs(at.query).items()}
        who, _, rest = unquote(at.path).lstrip("/").partition("/")
        status, out = 200, None
        if who in self.server.down:
            status = 429
        elif who == "openalex" and rest:
            out = WORKS.get(rest.removeprefix("doi:"))
        elif who == "openalex":
            out = {"results": [w for t, w in TITLED.items() if t.lower() in asked["search"].lower()] + ([{"title": "An arXiv paper", "doi": None}] if asked["search"] == "2101.00001" else [])}
        elif who == "crossref" and rest:
            out = {"message": {"title": ["Deep networks for protein folding"], "DOI": rest}} if rest == "10.1000/fold" else None
        elif who == "crossref":
            out = {"message": {"items": []}}
        else:
            out = {"data": []}
        body = b"" if status == 429 or out is None else json.dumps(out).encode()
        self.send_response(status if status == 429 or out is not None else 404)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture()
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Provider)
    s.asked, s.down, s.connections = Counter(), set(), set()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()
    s.server_close()


def net(server, **more):
    at = f"http://127.0.0.1:{server.server_port}"
    return Connection(openalex=f"{at}/openalex", crossref=f"{at}/crossref", semantic=f"{at}/semantic", mailto="a b@c.org", policy=Policy(retries=1, least_s=0.0, most_asked_s=0.01), **more)


PAPER = """Deep networks improve protein folding accuracy [1].
Cold fusion works in a jar [2].
Sampling keeps the structure of graphs [3].
Nobody wrote this [4].

[1] Roe J. Deep networks for protein folding[J]. Nature Methods, 2021. https://doi.org/10.1000/FOLD.
[2] Doe J. Cold fusion in a jar[J]. Energy, 2010. https://doi.org/10.1000/bad
[3] Lee A. Graph sampling at large scale[J]. KDD, 2019.
[4] Noone X. A paper that nobody ever wrote anywhere[J]. Nowhere, 2001.
"""


def folder(tmp_path):
    root = tmp_path / "papers"
    (root / "more").mkdir(parents=True)
    (root / "one.md").write_text(PAPER)
    (root / "more" / "one.md").write_text(PAPER.replace("[4] Noone X. A paper", "[4] Noone X. Another paper"))
    (root / "none.txt").write_text("no citations here")
    (root / "broken.docx").write_bytes(b"not a zip file")
    return str(root)


def test_folder_to_reports(spark, server, tmp_path, capsys):
    """One call from a folder to report files: each key is asked for once, and not at all when the cache knows it."""
    path, out = folder(tmp_path), str(tmp_path / "out")
    cache = str(tmp_path / "cache")
    at = net(server)
    code = main(["audit", path, "-o", out, "--cache", cache, "-e", "a b@c.org"], spark, openalex=at.openalex, crossref=at.crossref, semantic=at.semantic, policy=at.policy)
    shown = capsys.readouterr()
    assert code == 1 and "8 citations in 3 manuscripts" in shown.out and "[PARSER_ERROR]" in shown.err and "broken.docx" in shown.err
    assert server.asked and max(server.asked.values()) == 1, server.asked.most_common(3)
    assert all("mailto=a%20b%40c.org" in p for p in server.asked if not p.startswith("/semantic"))
    files = sorted(os.listdir(out))
    assert len(files) == 2 and all(f.startswith("one.md-") and f.endswith(".md") for f in files)
    text = Path(out, files[0]).read_text()
    assert "Cold fusion" in text and "🔴" in text and "4" in text
    before = sum(server.asked.values())
    done = audit_path(spark, path, net=net(server, cache=Table(spark, cache)))
    rows = {(os.path.relpath(r.doc_id.removeprefix("file:"), path), r.citation_id): r for r in done.results.collect()}
    one = lambda i: rows["one.md", f"cit_{i}"]
    assert (one(1).status, one(1).risk, one(1).evidence_text) == ("VALID", "PASS", "Deep networks improve protein folding accuracy")
    assert (one(2).status, one(2).risk) == ("RETRACTED", "DANGER")
    assert one(3).verified_doi == "10.1000/graph" and one(3).evidence_status == "ARTICLE_MATCHED"
    assert one(4).evidence_status == "NOT_FOUND" and one(4).risk == "WARNING"
    # Answers that there is no record aren't kept; what was found is.
    again = {p: n for p, n in server.asked.items() if n > 1}
    assert sum(server.asked.values()) - before == len(again) < before and not any("fold" in p.lower() and "openalex" in p for p in again)
    totals = {os.path.basename(r.doc_id): (r.total, r.danger) for r in done.summary.collect()}
    assert totals == {"one.md": (4, 1), "none.txt": (0, 0)}


def test_providers_that_are_down(spark, server, tmp_path):
    server.down = {"openalex", "crossref", "semantic"}
    done = audit_path(spark, folder(tmp_path), net=net(server))
    got = {r.citation_id: (r.evidence_status, r.failure_reason) for r in done.results.collect()}
    assert got["cit_4"] == ("PROVIDER_UNAVAILABLE", "HTTP_429")
    errors = {(os.path.basename(r.doc_id), r.status) for r in done.errors.collect()}
    assert errors == {("broken.docx", "PARSER_ERROR"), ("one.md", "RATE_LIMIT")}


def test_one_citation(spark, server):
    assert verify_text(spark, "Graph sampling at large scale", net(server)).first().doi == "10.1000/graph"
    doi = verify_text(spark, " 10.1000/bad ", net(server)).first()
    assert doi.is_retracted and doi.source == "DOI lookup"
    assert verify_text(spark, "10.48550/arxiv.2101.00001", net(server)).first().title == "An arXiv paper"
    assert main(["verify", "10.1126/science.1112286"], spark) == 1  # a known retraction is told without asking anybody


def test_client_keeps_its_connection(server):
    client = Client()
    url = f"http://127.0.0.1:{server.server_port}/openalex/doi:10.1000/fold"
    assert [client(url, 5)[0] for _ in range(4)] == [200] * 4 and len(server.connections) == 1
    next(iter(client.kept.values())).sock.close()
    with pytest.raises(OSError):
        client(url, 5)
    assert client(url, 5)[0] == 200
    client.close()
    assert not client.kept


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    paced = Pace(lambda url, timeout: (200, {}, b""), 4, sleep, lambda: now[0])
    for _ in range(5):
        paced("u", 1)
    assert slept == [0.25] * 4
    now[0] += 10
    paced("u", 1)
    assert len(slept) == 4


def test_reports_are_published_at_once(spark, tmp_path):
    """A task that fails leaves no file, of its own or of others; overwriting drops the reports that are gone."""
    out = str(tmp_path / "reports")
    texts = spark.createDataFrame([(f"/data/{i}/p.md", f"text {i}") for i in range(20)], "doc_id string, text string").repartition(4)
    write_reports(texts, out)
    first = sorted(os.listdir(out))
    assert len(first) == 20 and Path(out, file_name("/data/3/p.md", ".md")).read_text() == "text 3"

    fails = F.udf(lambda d: 1 // 0 if d == "/data/7/p.md" else "new", "string")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        write_reports(texts.select("doc_id", fails("doc_id").alias("text")), out, mode="overwrite")
    assert sorted(os.listdir(out)) == first and Path(out, file_name("/data/3/p.md", ".md")).read_text() == "text 3"
    with pytest.raises(Exception, match="several"):
        write_reports(texts.unionByName(texts.limit(1)), out)
    assert sorted(os.listdir(out)) == first
    Path(out, "kept.html").write_text("x")
    write_reports(texts.where("doc_id < '/data/2'").selectExpr("doc_id", "upper(text) text"), out, mode="overwrite")
    left = sorted(os.listdir(out))
    assert "kept.html" in left and len(left) == 1 + texts.where("doc_id < '/data/2'").count()
    assert Path(out, file_name("/data/1/p.md", ".md")).read_text() == "TEXT 1"
