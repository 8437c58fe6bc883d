"""Pages and files from the web, as a data source of Spark with partitions, pace and retries of its own.

Addresses are written to the shared folder by (host, lane), a file a task, and each file is a partition of the source: no
list of addresses passes the driver. A host has `lanes` lanes at most, in which its addresses are read one after the other,
each lane at its share of the host's rate. So the load on a server is bounded however many executors there are, and the
addresses of one large host are still read by several tasks. What can't be read is a row with `error`.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..tables import new_folder

NAME = "graphloom_web"
SCHEMA = "url string, content binary, calls int, error string"


class Fetcher(Protocol):
    def fetch(self, url: str) -> bytes: ...


def quoted(url: str) -> str:
    """An address with everything percent-encoded that may not stand in one; what is encoded or separates stays."""
    return quote(url.strip(), safe="%/:=&?~#+!$,;'@()*[]")


class HttpFetcher:
    def __init__(self, agent: str = "graphloom", timeout: float = 15.0) -> None:
        self.agent, self.timeout = agent, timeout

    def fetch(self, url: str) -> bytes:
        request = urllib.request.Request(quoted(url), headers={"User-Agent": self.agent})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return answer.read()  # raises for a bad status


@dataclass(frozen=True)
class Pace:
    """`rate`: calls a second to a host, over all of its `lanes`; without one, as fast as it answers. `delay`: seconds, between
    which a random time passes before a call. `tries` of a call, `backoff` seconds after the first, doubled each time."""

    rate: float | None = None
    lanes: int = 4
    delay: tuple[float, float] = (0.0, 0.0)
    tries: int = 3
    backoff: float = 1.0


def passing(error: Exception) -> float | None:
    """Whether a call may succeed later: the seconds to wait at least, or None."""
    if isinstance(error, urllib.error.HTTPError):
        if error.code in (408, 425, 429) or error.code >= 500 and error.code != 501:
            after = (error.headers or {}).get("Retry-After", "")
            return float(after) if after.isdigit() else 0.0
        return None
    return 0.0 if isinstance(error, (urllib.error.URLError, TimeoutError, ConnectionError)) else None


class Lane:
    """Calls of one task, at each host's pace."""

    def __init__(self, fetcher: Fetcher, pace: Pace) -> None:
        self.fetcher, self.pace = fetcher, pace
        self.free: dict[str, float] = defaultdict(float)
        self.calls = 0

    def _call(self, url: str) -> bytes:
        host = urlsplit(url).netloc
        time.sleep(max(0.0, self.free[host] - time.monotonic()) + random.uniform(*self.pace.delay))
        if self.pace.rate:
            self.free[host] = time.monotonic() + self.pace.lanes / self.pace.rate
        self.calls += 1
        return self.fetcher.fetch(url)

    def read(self, url: str | None, forms: tuple[str, ...]) -> tuple[str | None, bytes | None, int, str | None]:
        """The first of the address's forms that answers. `{url}` is the address, `{file}` its last part."""
        self.calls, error = 0, "no url"
        for form in forms if url else ():
            target = form.format(url=url, file=url.rpartition("/")[2])
            for turn in range(self.pace.tries):
                try:
                    return url, bytes(self._call(target)), self.calls, None
                except Exception as e:  # noqa: BLE001  one bad address must not end the task
                    error = f"{type(e).__name__}: {e}"
                    wait = passing(e)
                    if wait is None:
                        break
                    if turn + 1 < self.pace.tries:
                        time.sleep(max(wait, self.pace.backoff * 2**turn))
        return url, None, self.calls, error


@dataclass
class Addresses(InputPartition):
    file: str


def web_source(fetcher: Fetcher, forms: tuple[str, ...], pace: Pace) -> type[DataSource]:
    """The source for one way of fetching; its option `path` is a folder of Parquet files with a column `url`."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.folder = options["path"]

        def partitions(self) -> list[Addresses]:
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(self.folder)
            files = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            return [Addresses(f.path) for f in files if f.path.endswith(".parquet")] or [Addresses("")]

        def read(self, partition: Addresses) -> Iterator[tuple]:
            import pyarrow.parquet as pq
            from pyarrow import fs

            store, _ = fs.FileSystem.from_uri(self.folder)
            lane = Lane(fetcher, pace)
            if partition.file:
                with store.open_input_file(partition.file) as f:
                    for batch in pq.ParquetFile(f).iter_batches(1000, columns=["url"]):
                        for url in batch.column(0).to_pylist():
                            yield lane.read(url, forms)

    class Web(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader(self.options)

    return Web


def fetched(urls: DataFrame, fetcher: Fetcher, forms: tuple[str, ...] = ("{url}",), pace: Pace = Pace()) -> DataFrame:
    """(`url`, `content`, `calls`, `error`), one row for each of `urls`, repeated ones too. Each reading of the result reads the web
    again, so materialise it. Null and empty addresses are rows with the error `no url`."""
    spark = urls.sparkSession
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    lane = F.pmod(F.xxhash64("url"), F.lit(pace.lanes))
    folder = new_folder(spark)
    urls.select("url").repartition(host, lane).write.parquet(folder)
    spark.dataSource.register(web_source(fetcher, forms, pace))
    return spark.read.format(NAME).load(folder)
