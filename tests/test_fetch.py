"""Polite fetching, against servers on this machine: one for each host name."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from docmill.errors import FetchError
from docmill.sources import fetch
from docmill.sources.pages import fetched


class Sites:
    """Servers on several ports, hence hosts; notes requests that overlap."""

    def __init__(self, n):
        self.now, self.most, self.asked, self.times = {}, {}, {}, {}
        lock, sites = threading.Lock(), self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                port = self.server.server_port
                with lock:
                    sites.now[port] = sites.now.get(port, 0) + 1
                    sites.most[port] = max(sites.most.get(port, 0), sites.now[port])
                    seen = sites.asked[port, self.path] = sites.asked.get((port, self.path), 0) + 1
                    sites.times.setdefault(port, []).append(time.monotonic())
                time.sleep(0.02)
                code = 404 if "gone" in self.path else 503 if "busy" in self.path and seen < 2 or "down" in self.path else 200
                body = f"<h1>é {self.path}</h1>".encode()
                with lock:
                    sites.now[port] -= 1
                self.send_response(code)
                self.send_header("Content-Type", "text/html; charset=utf-8")
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.servers = [ThreadingHTTPServer(("127.0.0.1", 0), Handler) for _ in range(n)]
        for server in self.servers:
            threading.Thread(target=server.serve_forever, daemon=True).start()
        self.ports = [s.server_port for s in self.servers]

    def close(self):
        for server in self.servers:
            server.shutdown()


@pytest.fixture
def sites():
    made = Sites(3)
    yield made
    made.close()


def urls(sites):
    return [f"http://127.0.0.1:{p}/{k}" for k in range(5) for p in sites.ports] + [
        f"http://127.0.0.1:{sites.ports[0]}/gone",
        f"http://127.0.0.1:{sites.ports[1]}/busy",
        f"http://127.0.0.1:{sites.ports[2]}/down",
        "http://127.0.0.1:9/refused",
        "ftp://x/y",
    ]


def check(sites, rows, wanted):
    got = {r["url"]: r for r in rows}
    assert sorted(r["url"] for r in rows) == sorted(set(wanted))
    for url, r in got.items():
        if url.endswith("gone"):
            assert (r["status"], r["html"], r["error"][:8]) == (404, None, "HTTP 404")
        elif url.endswith("down"):
            assert (r["status"], r["html"]) == (503, None) and r["error"]
        elif url.endswith("refused"):
            assert r["status"] is None and r["html"] is None and "refused" in r["error"].lower()
        elif url.startswith("ftp"):
            assert (r["status"], r["html"], r["error"]) == (None, None, "no web address")
        else:
            assert (r["status"], r["error"]) == (200, None) and r["html"].startswith("<h1>é /")
    assert set(sites.most.values()) == {1}  # no host was ever asked twice at once
    asked = {path: n for (_, path), n in sites.asked.items()}
    assert (asked["/gone"], asked["/busy"], asked["/down"]) == (1, 2, 2)
    for times in sites.times.values():
        assert min(b - a for a, b in zip(times, times[1:])) >= 0.04  # and rested in between


def test_data_source_reads_a_list(spark, sites, tmp_path):
    (tmp_path / "urls.txt").write_text("\n".join(urls(sites)) + "\n\n")
    spark.dataSource.register(fetch.WebPages)
    reader = spark.read.format("webpages").option("delay", "0.05").option("attempts", "2").option("least", "0.1").option("most", "0.2")
    rows = reader.option("path", str(tmp_path / "urls.txt")).option("partitions", "2").load().collect()
    check(sites, rows, urls(sites))
    assert reader.option("urls", "").load().count() == 0


def test_stream_fetches_what_was_added(spark, sites, tmp_path):
    spark.dataSource.register(fetch.WebPages)
    listed = tmp_path / "urls.txt"
    first = [f"http://127.0.0.1:{p}/{k}" for p in sites.ports for k in range(2)]
    more = [f"http://127.0.0.1:{sites.ports[0]}/gone", f"http://127.0.0.1:{sites.ports[1]}/new"]

    def run():
        stream = spark.readStream.format("webpages").option("path", str(listed)).option("delay", "0.01").load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        query.trigger(once=True).start().awaitTermination(120)
        return sorted(r["url"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    listed.write_text("\n".join(first) + "\n")
    assert run() == sorted(first)
    listed.write_text("\n".join([*first, *more]) + "\n")
    assert run() == sorted([*first, *more])
    assert set(sites.asked.values()) == {1} and set(sites.most.values()) == {1}


def test_table_of_urls(spark, sites):
    wanted = urls(sites)
    df = spark.createDataFrame([(u,) for u in [*wanted, *wanted[:5], None]], "url string").repartition(3)
    rows = fetch.polite_pages(df, how=fetch.Politeness(0.05, 2, 0.1, 0.2), tasks=3).collect()
    assert [r["error"] for r in rows if r["url"] is None] == ["no web address"]
    check(sites, [r for r in rows if r["url"] is not None], wanted)
    assert fetch.polite_pages(df.limit(0)).count() == 0


def test_hosts_take_turns_while_others_rest():
    now, log = [0.0], []

    def get(url, timeout):
        log.append((now[0], url))
        if "b/1" in url and len([u for _, u in log if u == url]) < 3:
            raise FetchError("later")
        return "x"

    def sleep(seconds):
        now[0] += seconds

    wanted = ["http://a/1", "http://a/2", "http://A/3", "http://b/1", "http://b/2"]
    rows = list(fetch.polite(wanted, fetch.Politeness(1.0, 3, 4.0, 10.0), get, lambda: now[0], sleep))
    assert [r[0] for r in rows] == ["http://a/1", "http://a/2", "http://A/3", "http://b/1", "http://b/2"]
    assert [t for t, u in log if "a" in u.lower()] == [0, 1, 2]
    assert [t for t, u in log if "/b/" in u] == [0, 4, 8, 9]


def test_lasting_errors_are_not_tried_again(spark):
    def get(url):
        raise FetchError("HTTP 404: gone", 404, lasting=True)

    df = spark.createDataFrame([("http://a",)], "url string")
    start = time.monotonic()
    row = fetched(df, "url", get, attempts=4).first()
    assert (row["html"], row["error"]) == (None, "HTTP 404: gone") and time.monotonic() - start < 15
