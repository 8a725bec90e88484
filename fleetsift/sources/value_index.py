"""An index of the stored table by value: which rows of which files hold a value, under which key.

The table under a folder has one row for each distinct (value, key) of a stored row, with the row's file, place in the
file, id and time. Its files are cut by value and time and sorted, and carry bloom filters on the value, so a look-up
reads a few row groups. A value that a third of all rows hold is spread over many files, because time takes part in
the cut. `commits` names the files of the table that have been indexed: a refresh adds those that came since, and
one that failed half-way leaves entries that the next one writes again; look-ups take each place once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.times import as_timestamp, seconds
from ..operators.search import clamp_limit, log_filter, search_logs
from ..session import cut_lineage

ENTRY = ("value string, key string, by_key boolean, any boolean, timestamp timestamp, id long, file string, "
         "place long, event_date date")
#: Filters that the index answers alone, and those that only bound the time.
INDEXED, TIMES = ("value", "kv", "port", "process"), ("start_time", "end_time", "since_s", "as_of")


def _found(key: Column, value: Column, by_key: bool, any_: bool) -> Column:
    return F.struct(key.alias("key"), value.alias("value"), F.lit(by_key).alias("by_key"), F.lit(any_).alias("any"))


def value_entries(log: DataFrame) -> DataFrame:
    """ENTRY of every row of a stored table: what a filter on a key sees (by_key) and one on any key (any).

    Where a row has typed fields, any-key search sees their texts and the texts in their lists, and plain fields
    only under keys that have no typed one. Null values have no entry; a row without fields has none.
    """
    plain = lambda any_: F.transform(F.map_entries("kv"), lambda e: _found(e["key"], e["value"], True, any_))
    pairs = plain(True)
    if "kv_v" in log.columns:
        text = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))
        items = lambda v: F.coalesce(F.transform(F.try_variant_get(v, "$", "array<variant>"), text), F.array(text(v)))
        typed = F.flatten(F.transform(F.map_entries("kv_v"), lambda e: F.transform(
            items(e["value"]), lambda v: _found(e["key"], v, False, True))))
        untyped = F.transform(F.filter(F.map_entries("kv"), lambda e: ~F.map_contains_key("kv_v", e["key"])),
                              lambda e: _found(e["key"], e["value"], False, True))
        pairs = F.when(F.col("kv_v").isNull(), pairs).otherwise(F.concat(plain(False), typed, untyped))
    rows = log.select(F.explode(pairs).alias("e"), "timestamp", "id", F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.row_index").alias("place"), F.col("event_date").cast("date").alias("event_date"))
    return rows.where("e.value IS NOT NULL").select("e.value", "e.key", "e.by_key", "e.any", "timestamp", "id", "file", "place", "event_date")


def _asked(filters: dict) -> dict:
    """The filters that log_filter heeds."""
    given = {k: v for k, v in filters.items() if v is not None and v is not False and str(v) != ""}
    return {k: v for k, v in given.items() if k != "port" or str(v).strip()}


def _same_form(file: str) -> str:
    """Listings and rows spell the local scheme with one slash or three."""
    return "file:/" + file[5:].lstrip("/") if file.startswith("file:") else file


class ValueIndex:
    """Look-ups in a stored table (a folder of write_events) by the values of its fields."""

    def __init__(self, spark: SparkSession, table: str, path: str):
        self.spark, self.table, self.path, self._known = spark, table, path.rstrip("/"), set()
        spark.createDataFrame([], ENTRY).write.mode("ignore").parquet(f"{self.path}/entries")
        spark.createDataFrame([], "file string").write.mode("ignore").parquet(f"{self.path}/commits")

    def log(self) -> DataFrame:
        return self.spark.read.parquet(self.table)

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries")

    def indexed(self) -> DataFrame:
        """(file) of every file that is indexed."""
        return self.spark.read.schema("file string").parquet(f"{self.path}/commits").distinct()

    def _files(self, log: DataFrame) -> DataFrame:
        """(file) of the table's files now: a listing, as any read of the table makes it."""
        return self.spark.createDataFrame([(_same_form(f),) for f in log.inputFiles()], "file string")

    def _read(self, files: list[str], like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).option("basePath", self.table).parquet(*files)

    def behind(self, log: DataFrame | None = None) -> list[str]:
        """Files of the table that no refresh has seen. A file once indexed stays so, hence names are read again only
        when the listing has one that is not known."""
        live = {_same_form(f) for f in (log if log is not None else self.log()).inputFiles()}
        if live - self._known:
            self._known = {r[0] for r in self.indexed().collect()} & live
        return sorted(live - self._known)

    def refresh(self) -> int:
        """Index the files that came since the last refresh; returns how many.

        Entries of files that are gone (retention) are taken out first: the rest is written again, which is why
        retention and not every refresh should remove files.
        """
        log = self.log()
        live = self._files(log)
        gone = self.indexed().join(live, "file", "left_anti")
        if not gone.isEmpty():
            kept, names = cut_lineage(self._entries().join(live, "file", "left_semi").select(*self._entries().columns)), cut_lineage(
                self.indexed().join(live, "file", "left_semi"))
            names.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits")  # nothing counts until the entries stand
            self._write(kept, "overwrite")
            names.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        new = self.behind(log)
        if new:
            self._write(value_entries(self._read(new, log)), "append")
            self.spark.createDataFrame([(f,) for f in new], "file string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return len(new)

    def _write(self, entries: DataFrame, mode: str) -> None:
        (entries.repartitionByRange("value", "timestamp").sortWithinPartitions("value", "timestamp")
         .write.mode(mode).option("parquet.bloom.filter.enabled#value", "true").option("parquet.block.size", str(16 << 20))
         .parquet(f"{self.path}/entries"))

    def _held(self, value=None, kv=None, port=None, process=None, start_time=None, end_time=None, since_s=None, as_of=None) -> DataFrame:
        """Distinct places whose rows pass one indexed filter and the time bounds."""
        key, _, wanted = (kv or "").partition(":")
        if value:
            keep = F.col("any") & (F.col("value") == value)
        elif kv:
            keep = F.col("by_key") & (F.col("value") == wanted) & (F.col("key") == key)
        elif process:
            keep = F.col("by_key") & (F.col("value") == process) & (F.col("key") == "process")
        else:
            keep = F.col("by_key") & (F.col("value") == str(port).strip()) & F.col("key").isin("local_port", "peer_port")
        lower = as_timestamp(start_time) if start_time is not None else as_timestamp(as_of) - seconds(since_s) if since_s else None
        keep = keep if lower is None else keep & (F.col("timestamp") >= lower)
        keep = keep if end_time is None else keep & (F.col("timestamp") <= as_timestamp(end_time))
        return self._entries().where(keep).select("file", "place", "timestamp", "id").distinct()

    def search(self, limit: int | None = None, most_files: int = 10_000, **filters) -> DataFrame:
        """The rows and order of search_logs on the table, read only from files that hold the value.

        Filters are those of log_filter, one of value, kv, port and process among them. If no other filter is given,
        the index alone names the newest `limit` rows, and only their files are read; else all files with the value
        are. Files not indexed yet are read as well. A value that more than most_files files hold is searched by a
        scan: the names of that many files no longer help. Without one of the four it is a scan too. If files were
        removed, refresh first.
        """
        if limit is not None and limit < 1:
            raise ValueError("a limit is at least 1")
        log = self.log()
        asked = _asked(filters)
        by = [k for k in INDEXED if k in asked]
        log_filter(log, **filters)  # raises on what a scan would refuse
        if not by:
            return search_logs(log, limit, **filters)
        held = self._held(**{k: v for k, v in asked.items() if k == by[0] or k in TIMES})
        if limit is not None and not set(asked) - {by[0], *TIMES}:
            held = held.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
        files = [r[0] for r in held.select("file").distinct().limit(most_files + 1).collect()]
        if len(files) > most_files:
            return search_logs(log, limit, **filters)
        files += self.behind(log)
        found = self._read(files, log) if files else log.limit(0)
        return search_logs(found, limit, **filters)

    def surface_search(self, limit: int, cap: int, **filters) -> DataFrame:
        """search with the cap of a request from outside."""
        return self.search(clamp_limit(limit, cap), **filters)

    def count(self, **filters) -> DataFrame:
        """One row: how many rows match. With one indexed filter and time bounds it is a count of entries."""
        asked = _asked(filters)
        by = [k for k in INDEXED if k in asked]
        log = self.log()
        log_filter(log, **filters)
        if len(by) == 1 and not set(asked) - {by[0], *TIMES}:
            fresh = self.behind(log)
            held = self._held(**asked)
            if not fresh:
                return held.agg(F.count("*").alias("matched"))
            more = self._read(fresh, log).where(log_filter(log, **filters)).agg(F.count("*").alias("matched"))
            return held.agg(F.count("*").alias("matched")).unionByName(more).agg(F.sum("matched").alias("matched"))
        return self.search(None, **filters).agg(F.count("*").alias("matched"))
