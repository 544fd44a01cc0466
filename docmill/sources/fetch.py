"""Web pages fetched politely: one request at a time to each host, with pauses.

``polite_pages`` fetches the urls of a table: rows are dealt by host, so a host's
urls lie in one task, which takes its hosts in turn and lets each rest between
two requests.  ``WebPages`` is a data source for lists of urls,

    spark.dataSource.register(WebPages)
    spark.read.format("webpages").option("path", "urls.txt").load()
    spark.readStream.format("webpages").option("path", "urls.txt").load()

whose stream fetches what was added to the end of the list since the last batch.
A page that can't be fetched is a row with its error.  Answers that won't change
(not found, forbidden and the like) aren't asked for again; others are, with
growing pauses.

The hosts' requests are serial within a job; a host that holds most urls takes as
long as its politeness demands, whatever the cluster.  A task that is run again
fetches its hosts again.  Urls that are null or no web addresses have an error;
repeated urls are fetched once in a task; an empty list gives no rows.
"""

from __future__ import annotations

import heapq
import os
import time
import urllib.error
import urllib.request
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import FetchError
from ..functions.retry import waits

PAGE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("html", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

#: Answers of the 400s that may change when asked again.
_PASSING = {408, 425, 429}


def http_get(url: str, timeout: float = 30.0) -> str:
    """The body of a web page; ``FetchError`` says what went wrong."""
    request = urllib.request.Request(url, headers={"User-Agent": "docmill"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as error:
        lasting = 400 <= error.code < 500 and error.code not in _PASSING
        raise FetchError(f"HTTP {error.code}: {error.reason}", error.code, lasting) from error
    except (urllib.error.URLError, OSError, LookupError) as error:
        raise FetchError(f"{type(error).__name__}: {error}") from error
    except ValueError as error:
        raise FetchError(f"no web address: {error}", lasting=True) from error


def host_of(url: str | None) -> str:
    """Where requests for a url go, in lower case; empty for what is no url."""
    try:
        return urlsplit(url or "").netloc.rpartition("@")[2].lower()
    except ValueError:
        return ""


@dataclass
class Politeness:
    """Seconds between two requests to a host; attempts for a page, and the least
    and most seconds before another."""

    delay: float = 1.0
    attempts: int = 3
    least: float = 4.0
    most: float = 10.0
    timeout: float = 30.0


def polite(
    urls: Iterable[str | None],
    how: Politeness = Politeness(),
    get: Callable[[str, float], str] = http_get,
    clock: Callable[[], float] = time.monotonic,
    sleep: Callable[[float], None] = time.sleep,
) -> Iterator[tuple]:
    """Rows of ``PAGE``, hosts in turn: of those with pages left the one that has
    rested longest is next.  A page that is to be tried again waits its pause while
    other hosts go on."""
    queues: dict[str, deque] = defaultdict(deque)
    for url in dict.fromkeys(urls):
        host = host_of(url)
        if url is None or not host or urlsplit(url).scheme.lower() not in ("http", "https"):
            yield url, host or None, None, None, "no web address"
        else:
            queues[host].append((url, 0))
    now = clock()
    ready = [(now, k, host) for k, host in enumerate(queues)]
    heapq.heapify(ready)
    pauses = waits(how.attempts, how.least, how.most)
    while ready:
        at, k, host = heapq.heappop(ready)
        if at > clock():
            sleep(at - clock())
        url, tried = queues[host].popleft()
        rest = how.delay
        try:
            yield url, host, 200, get(url, how.timeout), None
        except FetchError as error:
            if error.lasting or tried >= len(pauses):
                yield url, host, error.status, None, str(error)
            else:
                queues[host].appendleft((url, tried + 1))
                rest = max(rest, pauses[tried])
        if queues[host]:
            heapq.heappush(ready, (clock() + rest, k, host))


def polite_pages(
    urls: DataFrame,
    url_col: str = "url",
    how: Politeness = Politeness(),
    get: Callable[[str, float], str] = http_get,
    tasks: int | None = None,
) -> DataFrame:
    """The pages of a table's distinct urls, dealt over ``tasks`` tasks by host."""
    host = F.regexp_extract(F.lower(url_col), r"\A[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1)
    dealt = urls.select(F.col(url_col).cast("string").alias("url")).distinct().withColumn("host", host)
    dealt = dealt.repartition(tasks, "host") if tasks else dealt.repartition("host")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # All of a task's urls, so that none of its hosts is asked in two turns.
        wanted = [u if isinstance(u, str) else None for batch in batches for u in batch["url"]]
        for row in polite(wanted, how, get):
            yield pd.DataFrame([row], columns=PAGE.fieldNames()).astype({"status": "Int32"})

    return dealt.select("url").mapInPandas(run, PAGE)


# -- data source ------------------------------------------------------------


@dataclass
class _Hosts(InputPartition):
    """The urls of some hosts."""

    urls: list[str]


def _listed(path: str) -> Iterator[str]:
    """The lines of a file, or of a folder's files in the order of their names."""
    files = sorted(os.path.join(path, f) for f in os.listdir(path) if f[0] not in "._") if os.path.isdir(path) else [path]
    for name in files:
        with open(name, encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    yield line.strip()


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.options = options
        number = lambda key, default: float(options.get(key, default))
        self.how = Politeness(
            number("delay", 1.0), int(number("attempts", 3)), number("least", 4.0), number("most", 10.0), number("timeout", 30.0)
        )

    def urls(self) -> list[str]:
        if "urls" in self.options:
            return self.options["urls"].split()
        return list(_listed(self.options["path"]))

    def dealt(self, urls: list[str]) -> list[InputPartition]:
        """The urls over ``partitions`` partitions, each host in one of them; the
        hosts with most urls first, each to the partition that has fewest."""
        hosts: dict[str, list[str]] = defaultdict(list)
        for url in urls:
            hosts[host_of(url)].append(url)
        parts: list[list[str]] = [[] for _ in range(min(int(self.options.get("partitions", 8)), len(hosts)))]
        for own in sorted(hosts.values(), key=len, reverse=True):
            min(parts, key=len).extend(own)
        return [_Hosts(p) for p in parts] or [_Hosts([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return polite(partition.urls, self.how)


class _BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.dealt(self.urls())


class _StreamReader(_Reader, DataSourceStreamReader):
    """Offsets are numbers of urls in a list that only grows at its end."""

    def initialOffset(self) -> dict:
        return {"urls": 0}

    def latestOffset(self) -> dict:
        return {"urls": len(self.urls())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.dealt(self.urls()[start["urls"] : end["urls"]])

    def commit(self, end: dict) -> None:
        pass


class WebPages(DataSource):
    """The pages of a list of urls: ``path``, a file or folder of lines that driver
    and workers can open, or ``urls``, the list itself.  Further options:
    ``partitions``, ``delay``, ``attempts``, ``least``, ``most``, ``timeout``."""

    @classmethod
    def name(cls) -> str:
        return "webpages"

    def schema(self) -> T.StructType:
        return PAGE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)
