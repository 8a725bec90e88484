"""A stream over recorded pages of log streams, read as ranges of time from a cursor.

Pages lie under first_ns=<a>/last_ns=<b>/ below a folder that all machines see, each file with payloads, one JSON
body a line. The offset is a cursor: the time of the last entry delivered. A batch asks for (cursor - overlap, end],
the end staying `settle` short of the newest entry recorded, so lines that are recorded late, with times before the
cursor, are still found; only pages whose range meets the question are opened, one task for each. What the overlap
reads again is dropped by `dedup_entries`, whose memory is as long as the overlap and is kept with the checkpoint. So a
stream that stops anywhere in a page and starts again gives each entry once.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .sources import dedup_entries

_RANGE = re.compile(r"first_ns=(-?\d+)/last_ns=(-?\d+)/[^/_.][^/]*$")
SECOND = 1_000_000_000


def write_pages(entries: DataFrame, path: str, page: str = "12 hours") -> None:
    """Record entries (labels, ts_ns, line) as pages, one for each stretch of time; may be called again for more."""
    at = F.timestamp_micros(F.call_function("div", "ts_ns", F.lit(1000)))
    paged = entries.withColumn("page", F.window(at, page)["start"])
    ranges = paged.groupBy("page").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
    stream = F.struct(F.col("labels").alias("stream"), F.array(F.array(F.col("ts_ns").cast("string"), "line")).alias("values"))
    (paged.join(ranges, "page").select(F.to_json(F.struct(F.array(stream).alias("streams"))).alias("value"), "first_ns", "last_ns")
     .hint("rebalance", "first_ns", "last_ns").write.mode("append").partitionBy("first_ns", "last_ns").text(path))


@dataclass
class PageRange(InputPartition):
    """One page's file, and the times asked for: after `after`, up to `until`."""
    file: str
    after: int
    until: int


def _folder(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), re.sub("^file:/+", "/", path))


def _entries(line: str) -> Iterator[tuple]:
    """(labels, ts_ns, line) of a body, push or query shape; one that is no such body gives none."""
    try:
        body = json.loads(line)
        streams = body.get("streams") or (body.get("data") or {}).get("result") or []
    except (ValueError, AttributeError):
        return
    for stream in streams:
        labels = {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in (stream.get("stream") or {}).items()}
        for entry in stream.get("values") or []:
            if len(entry) >= 2 and re.fullmatch(r"[+-]?\d+", str(entry[0])):
                yield labels, int(entry[0]), str(entry[1])


class PageReader(DataSourceStreamReader):
    """Offsets are {"cursor": ns}; -1 stands before every entry."""

    def __init__(self, path: str, start: int, overlap: int, settle: int):
        self.path, self.start, self.overlap, self.settle = path, start, overlap, settle

    def _pages(self) -> list[tuple[int, int, str]]:
        from pyarrow import fs
        system, root = _folder(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        at = [(_RANGE.search(f.path), f.path) for f in found if f.is_file]
        return sorted((int(m[1]), int(m[2]), path) for m, path in at if m)

    def initialOffset(self) -> dict:
        return {"cursor": self.start}

    def latestOffset(self) -> dict:
        newest = max((last for _, last, _ in self._pages()), default=self.start)
        return {"cursor": max(self.start, newest - self.settle)}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        if end["cursor"] <= start["cursor"]:
            return []
        after = max(start["cursor"] - self.overlap, self.start)
        return [PageRange(path, after, end["cursor"]) for first, last, path in self._pages()
                if last > after and first <= end["cursor"]]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        system, _ = _folder(self.path)
        with system.open_input_stream(partition.file) as raw:
            for line in io.TextIOWrapper(io.BufferedReader(raw), "utf-8", errors="replace", newline="\n"):
                for labels, ts_ns, text in _entries(line):
                    if partition.after < ts_ns <= partition.until:
                        yield labels, ts_ns, text

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the cursor."""


class LogPages(DataSource):
    """Options: path; start_ns (before every entry); overlap_s (30); settle_s (2)."""

    @classmethod
    def name(cls) -> str:
        return "log_pages"

    def schema(self) -> str:
        return "labels map<string,string>, ts_ns bigint, line string"

    def streamReader(self, schema) -> PageReader:
        ns = lambda name, default: int(float(self.options.get(name, default)) * SECOND)
        return PageReader(self.options["path"], int(self.options.get("start_ns", -1)), ns("overlap_s", 30), ns("settle_s", 2))


def page_stream(spark: SparkSession, path: str, as_of=None, overlap_s: int = 30, settle_s: float = 2, start_ns: int = -1) -> DataFrame:
    """Entries (labels, ts_ns, line, timestamp, line_hash, suspect) of recorded pages, each once."""
    spark.dataSource.register(LogPages)
    pages = (spark.readStream.format("log_pages").option("path", path).option("overlap_s", str(overlap_s))
             .option("settle_s", str(settle_s)).option("start_ns", str(start_ns)).load())
    return dedup_entries(pages, as_of, f"{overlap_s} seconds")
