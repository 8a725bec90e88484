"""Registered streaming queries: the derived log staged as files and read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetsift import fixed_values as V
from fleetsift.operators import search as SR, templates as TP, threats as TH
from fleetsift.session import scratch_path
from fleetsift.sources import feed as FD, lines as LN
from fleetsift.streaming import evaluation as SE, ingest as SI, mixed as MX, pages as PG, sources as SS, stateful as ST, upkeep as SU

from .derived import events_table as _events, flat_log, restless_sql, to_events
from .oracle import (AS_OF as SQL_AS_OF, AUTH, CLOG, DECLARED, LIVE, MATCH, OF, SOCK, SQL, TICKS, UNEXPECTED, VIEW, actors, compressed, hits, people,
                     real, reasons, words)
from .queries import AS_OF, _ecs_docs, _stream_bodies, _unit_lines, _verdicts, base_rules, fleet, owner_table, rdns_table, us

_STAGED: dict[tuple, tuple[str, int]] = {}
#: Rows of a staged file.
FILE_ROWS = 50000


def _staged(s, rows: DataFrame, name: str, d: str, slices: int = 3) -> tuple[str, int]:
    """rows written once per session in slices of time, one after the other, and how many files each slice has.

    A stream that takes that many files at a time reads a slice in each batch. Files are dealt rows in turn by tasks of which
    at least one has as many rows as there are files, so every slice has all of them.
    """
    key = (s.sparkContext.applicationId, name, d)
    if key not in _STAGED:
        path = scratch_path(s, f"staged-{name}")
        lo, hi = rows.agg(F.min(us("timestamp")), F.max(us("timestamp"))).first()
        part = F.least(F.floor((us("timestamp") - lo) * slices / F.lit(hi - lo + 1)), F.lit(slices - 1))
        held = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
        sizes = [held.get(i, 0) for i in range(slices)]
        files = max(1, min(-(-max(sizes) // FILE_ROWS), min(sizes) // (4 * s.sparkContext.defaultParallelism)))
        for i in range(slices):
            rows.filter(part == i).repartition(files).write.mode("append").parquet(path)
        _STAGED[key] = path, files
    return _STAGED[key]


def _drain(s, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a table and read the table back."""
    out, state = scratch_path(s, name), scratch_path(s, f"{name}-state")
    SS.finish(stream.writeStream.format("parquet").outputMode(mode).option("path", out)
              .option("checkpointLocation", state).trigger(availableNow=True).start())
    return s.read.schema(stream.schema).parquet(out)


def _log_stream(s, d, clock="compressed") -> DataFrame:
    rows = to_events(flat_log(s, d, clock))
    path, files = _staged(s, rows, clock, d)
    return SS.event_stream(s, path, files_per_trigger=files)


def _rocksdb(s) -> None:
    s.conf.set("spark.sql.streaming.stateStore.providerClass", SS.ROCKSDB)


def stream_ingest(s, d):
    """Lines to stored rows: filtered, matched, named, clamped."""
    rules = TP.read_rules(base_rules(s))
    lines = _log_stream(s, d, "real").select("id", "raw", "labels", F.col("timestamp").alias("ts"))
    stored = _drain(s, SI.ingest_stream(lines, rules, AS_OF), "ingested")
    return stored.groupBy("event", F.col("event_date").cast("string").alias("day")).agg(F.count("*").alias("n"))


def stream_dedup(s, d):
    """Every payload delivered twice, each entry kept once."""
    bodies = _stream_bodies(s, d)
    twice = bodies.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("timestamp", F.col("copy").cast("timestamp"))
    path, _ = _staged(s, twice, "payloads", d, 2)
    stream = SS.file_stream(s, path, twice.schema)
    kept = SS.dedup_entries(LN.log_stream_entries(stream), AS_OF, "40 days")
    out = _drain(s, kept.select("ts_ns", "line"), "deduped")
    return out.groupBy("line").agg(F.count("*").alias("n"), F.count_distinct("ts_ns").alias("instants"))


def stream_pages(s, d):
    """Entries of recorded pages over a stop in mid-page: some of those before the cursor are recorded after the stop."""
    _rocksdb(s)
    entries = _events(s, d).select(
        F.create_map(F.lit("job"), F.concat(F.lit("j"), (F.col("user_id") % 3).cast("string"))).alias("labels"),
        (us(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("ts_ns"), F.concat(F.lit("line "), F.col("user_id").cast("string")).alias("line"))
    path, out, state = (scratch_path(s, n) for n in ("pages", "page-entries", "page-state"))
    half = F.lit("2024-01-15 06:00:00").cast("timestamp")
    half_ns = us(half) * 1000
    hour = 3600 * PG.SECOND
    newest = entries.where(F.col("ts_ns") <= half_ns).agg(F.max("ts_ns")).first()[0]
    cursor = newest - 7 * hour
    late = (F.col("ts_ns") > cursor - 2 * hour) & (F.col("ts_ns") < cursor) & (F.col("ts_ns") % 2 == 0)
    parts = [(entries.where((F.col("ts_ns") <= half_ns) & ~late), 7 * 3600), (entries.where((F.col("ts_ns") > half_ns) | late), 0)]
    for recorded, settle_s in parts:
        PG.write_pages(recorded, path)
        read = PG.page_stream(s, path, AS_OF, overlap_s=3 * 3600, settle_s=settle_s).select("labels", "ts_ns", "line")
        SS.finish(read.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start())
    return s.read.schema(read.schema).parquet(out).groupBy(F.col("labels")["job"].alias("job"), "line").agg(
        F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.sum(F.col("ts_ns") % 1000003).alias("check_ns"))


def stream_clamped(s, d):
    """A clock in 2031 on some rows: they are kept, and do not hold up the others."""
    rows = _log_stream(s, d, "real")
    odd = rows.withColumn("timestamp", F.when(F.col("id") % 40 == 1, F.lit("2031-01-01").cast("timestamp")).otherwise(F.col("timestamp")))
    timed = SS.timed(odd, as_of=AS_OF, delay="1 hour").select(
        "event", F.to_date("timestamp").cast("string").alias("day"), F.col("suspect").isNotNull().cast("int").alias("suspect"))
    return _drain(s, timed, "clamped").groupBy("event", "day", "suspect").agg(F.count("*").alias("n"))


def stream_anomalies(s, d):
    """Anomaly state per key and tick, folded over the stream.

    Ticks the watermark has not passed when the input ends stay open.
    """
    _rocksdb(s)
    timed = SS.timed(_log_stream(s, d), as_of=AS_OF, delay="0 seconds")
    states = ST.anomaly_stream(timed, raise_z=1.0, clear_z=0.0, min_count=3, min_buckets=5, min_ratio=0.0,
                               raise_share=7.0, clear_share=5.0, min_total=20, min_surge=3)
    out = _drain(s, states, "anomalies")
    return out.select("kind", "instance", "event", us("tick").alias("tick_us"), "n", F.col("active").cast("int").alias("active"))


def stream_unit_alerts(s, d):
    """Failed units, one alert per unit and cooldown."""
    _rocksdb(s)
    from fleetsift.operators.alerts import failed_units
    lines = _unit_lines(s, d)
    path, files = _staged(s, lines, "units", d)
    stream = SS.file_stream(s, path, lines.schema, files_per_trigger=files)
    timed = SS.timed(failed_units(stream).select("key", "timestamp"), as_of=AS_OF, delay="1 minute")
    return _drain(s, ST.cooldown_stream(timed, V.UNIT_COOLDOWN_SECONDS), "alerts")


def stream_skeletons(s, d):
    """Clusters as their buckets fill."""
    _rocksdb(s)
    clusters = ST.skeleton_stream(_log_stream(s, d, "real").select("id", "timestamp", "raw"))
    return _drain(s, clusters, "clusters").groupBy("skeleton").agg(
        F.count("*").alias("emitted"), F.sum(F.size("samples")).alias("lines"))


def _thirds(s, d):
    """The compressed log, and its rows of the first third."""
    rows = to_events(flat_log(s, d, "compressed"))
    lo, hi = rows.agg(F.min(us("timestamp")), F.max(us("timestamp"))).first()
    return rows, rows.filter(F.floor((us("timestamp") - lo) * 3 / F.lit(hi - lo + 1)) < 1)


def stream_findings(s, d):
    """Findings of three sweeps: one, then verdicts, then a stream with another checkpoint that goes on over all files.

    Sweeps are further apart than their window is long, so the window reaches back to the last one.
    """
    rows, first = _thirds(s, d)
    path, whole = scratch_path(s, "findings"), _staged(s, rows, "compressed", d)
    verdicts = scratch_path(s, "verdicts")
    own = dict(topology=fleet(s), owners=owner_table(s, d), rdns=rdns_table(s, d), window_s=100, presence_window_s=50)

    def go(folder, files, **more):
        SS.finish(SS.event_stream(s, folder, files_per_trigger=files).writeStream.foreachBatch(SU.findings_sweeper(whole[0], path, **own, **more))
                  .option("checkpointLocation", scratch_path(s, "findings-state")).trigger(availableNow=True).start())

    go(*_staged(s, first, "first-third", d, 1))
    judged = _verdicts(SU.findings_table(s, path).read()).withColumn("at", F.lit("2024-01-01 00:20:00").cast("timestamp"))
    judged.write.parquet(verdicts)
    go(*whole, verdicts_path=verdicts)
    return SU.findings_table(s, path).read().select(
        "kind", "subject", "instance", "state", "verdict", "occurrences", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"),
        F.get_json_object("evidence", "$.reason").alias("reason"))


#: Limits that the derived log's incidents reach, and the moment its clock starts.
STARTED = "2024-01-01 00:00:00"
ANOMALY = dict(raise_z=2.0, clear_z=1.0, min_count=10, min_minutes=3, min_ratio=1.2, raise_share=8.0, clear_share=5.0, min_total=20,
               min_surge=3, window_s=300, warmup_s=180, cooldown_s=120)
SHIFT = dict(min_rate=30.0, min_z=2.0, min_ratio=1.5, heavy=20.0, drop=0.5, silent_s=120.0, window_s=300, cooldown_s=300)


def _restless(s, d) -> DataFrame:
    _rocksdb(s)
    return SS.timed(_log_stream(s, d, "restless"), as_of=AS_OF, delay="0 seconds")


def _anomaly_turns(s, d) -> DataFrame:
    return _drain(s, SE.anomaly_turns(_restless(s, d), STARTED, **ANOMALY), "anomaly-turns")


def stream_anomaly_alerts(s, d):
    """Alerts of anomalies judged every 15 seconds, with hosts that surge, fade and fall silent for good."""
    return _anomaly_turns(s, d).where("sent").select("kind", "instance", "event", us("turn").alias("turn_us"), "n", F.round("measure", 6).alias("measure"))


def stream_anomaly_changes(s, d):
    """When alarms were raised, cleared, or aged out."""
    return _anomaly_turns(s, d).where("change IS NOT NULL").select(
        "kind", "instance", "event", us("turn").alias("turn_us"), "change", F.col("armed").cast("int").alias("armed"))


def _shift_turns(s, d) -> DataFrame:
    return _drain(s, SE.shift_turns(_restless(s, d), fleet(s), STARTED, **SHIFT), "shift-turns")


def stream_shifts(s, d):
    """Shifts of every edge as they come and go, judged every 15 seconds."""
    return _shift_turns(s, d).where("change IS NOT NULL").select(
        "edge_id", "type", "severity", us("turn").alias("turn_us"), "change", "rate_1m", F.round(F.col("baseline_15m") * 100).cast("long").alias("baseline_x100"))


def shift_alerts(s, d):
    """Critical shifts that are sent, again while they last."""
    return _shift_turns(s, d).where("sent").select("edge_id", "type", us("turn").alias("turn_us"), F.floor(F.col("quiet_s") * 10).cast("long").alias("quiet_x10"))


def graph_upkeep(s, d):
    """Undeclared edges after each staged file, from the edges kept as counts per interval."""
    stream = _log_stream(s, d)
    state, shifts = scratch_path(s, "edges"), scratch_path(s, "shifts")
    run = SU.shift_watcher(state, shifts, fleet(s), min_rate=10, min_z=0.0, min_ratio=1.0, heavy=1.0, drop=0.5)
    SS.finish(stream.writeStream.foreachBatch(run).option("checkpointLocation", scratch_path(s, "shift-state"))
              .trigger(availableNow=True).start())
    return s.read.parquet(f"{shifts}/v=3").filter("type = 'NOVEL_EDGE'").select("edge_id", "type", "severity")


_FEEDS: dict[tuple, str] = {}
FEED_LABELS = {"text": {"source": "files"}, "json": None, "streams": None, "ecs": None}


def _feeds(s, d) -> str:
    """The log as files of bodies, a quarter of it each as lines, JSON bodies, log-stream payloads (delivered twice) and
    ECS documents, with some of the collector's own lines and some bodies that are no use."""
    key = (s.sparkContext.applicationId, d)
    if key not in _FEEDS:
        path, rows = scratch_path(s, "feeds"), flat_log(s, d, "real")
        rows = rows.withColumn("g", F.floor(F.col("id") / 4) % 4).withColumn("odd", F.col("id") % 50)
        labels = F.struct("instance", "source")
        ns = F.concat(us("timestamp").cast("string"), F.lit("000"))
        entry = F.array(F.array(ns, F.col("raw")), F.array(F.lit("1")))
        bodies = {
            "text": F.when(F.col("odd") < 4, F.concat(F.lit("  [Graph] "), "raw")).otherwise(F.col("raw")),
            "json": F.when(F.col("odd").between(4, 7), F.lit("{not json")).otherwise(F.to_json(F.struct(labels.alias("labels"), F.array("raw").alias("lines")))),
            "streams": F.when(F.col("odd").between(8, 11), F.lit('{"other": 1}')).otherwise(
                F.to_json(F.struct(F.array(F.struct(labels.alias("stream"), entry.alias("values"))).alias("streams"))))}
        for k, (name, body) in enumerate(bodies.items()):
            for _ in range(2 if name == "streams" else 1):
                rows.where(F.col("g") == k).select(body.alias("value")).repartition(2).write.mode("append").text(f"{path}/{name}")
        _ecs_docs(s, d, "floor(event_id / 4) % 4 = 3").repartition(2).write.text(f"{path}/ecs")
        _FEEDS[key] = path
    return _FEEDS[key]


_MIXED: dict[tuple, str] = {}


def _mixed(s, d) -> str:
    """All feeds read as streams into one table, two files at a time."""
    key = (s.sparkContext.applicationId, d)
    if key not in _MIXED:
        path, rules = scratch_path(s, "mixed"), TP.read_rules(base_rules(s))
        for kind in FD.KINDS:
            feed = FD.read_feed(FD.read_bodies(s, f"{_feeds(s, d)}/{kind}", True, files_per_trigger=2), kind, FEED_LABELS[kind])
            SS.finish(feed.writeStream.foreachBatch(MX.mixed_writer(rules, path, kind, AS_OF, kind=kind))
                      .option("checkpointLocation", scratch_path(s, f"mixed-{kind}")).trigger(availableNow=True).start())
        _MIXED[key] = path
    return _MIXED[key]


def ingested_all_sources(s, d):
    """Stored rows of text, JSON, log-stream and ECS files from streams, and how many of them a batch does not have alike."""
    path, rules = scratch_path(s, "mixed-batch"), TP.read_rules(base_rules(s))
    for kind in FD.KINDS:
        MX.write_outcomes(FD.read_feed(FD.read_bodies(s, f"{_feeds(s, d)}/{kind}"), kind, FEED_LABELS[kind]), rules, path, kind, AS_OF, kind)
    stream, batch = MX.stored_log(s, _mixed(s, d)), MX.stored_log(s, path)
    own = ["id", "timestamp", "event", "raw"]
    both = stream.join(batch.select(*own, F.lit(1).alias("same")), own, "left")
    return both.groupBy("event", "instance", F.col("event_date").cast("string").alias("day")).agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("same").isNull()).alias("differ"))


def mixed_rejects(s, d):
    """What was refused, by reason."""
    return MX.rejects(s, _mixed(s, d)).groupBy("kind", "reason").agg(F.count("*").alias("n"))


def mixed_accounting(s, d):
    """Counts observed while the streams ran."""
    return MX.accounts(s, _mixed(s, d)).select("total", "matched", "unstructured", "structured", "filtered", "rejected", "ts_clamped",
                                               F.round("hit_rate", 4).alias("hit_rate"))


def mixed_search(s, d):
    """A search for a value over rows of all feeds."""
    rows = MX.stored_log(s, _mixed(s, d))
    return SR.search_logs(rows, None, value="198.51.100.8").select("event", "instance", us("timestamp").alias("at_us"), "raw")


def mixed_actors(s, d):
    """Actors behind hostile requests in rows of all feeds."""
    actors = TH.threat_actors(TH.access_hits(MX.stored_log(s, _mixed(s, d))))
    return actors.select("ip", "hits", "hostile_hits", "threat_tier", "score")


STREAMS = {f.__name__: f for f in [stream_ingest, stream_dedup, stream_pages, stream_clamped, stream_anomalies, stream_unit_alerts,
                                   stream_skeletons, stream_findings, stream_shifts, shift_alerts, graph_upkeep,
                                   stream_anomaly_alerts, stream_anomaly_changes, ingested_all_sources, mixed_rejects, mixed_accounting,
                                   mixed_search, mixed_actors]}

START = 1704067200
#: The turns the watermark passes before the input ends.
LAST_TURN = "(SELECT epoch_us(max(timestamp)) // 1000000 FROM log)"
MINUTES = lambda window: f"least(greatest((t - {START}) / 60.0, 1.0), {window / 60.0})"


def restless(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join([CLOG.replace("log AS", "flat AS", 1), f"log AS ({restless_sql('duckdb')})", *ctes]) + "\n" + body


def _grid(keys: str) -> str:
    """Every turn of every key from its first interval on, with the counts of the interval that ends there."""
    return f"""span AS (SELECT {keys}, unnest(generate_series(min(t), {LAST_TURN}, 15)) AS t FROM cnt GROUP BY {keys}),
grid AS (SELECT * FROM span LEFT JOIN cnt USING ({keys}, t))"""


def _sent(keys: str, gap: int, strict: bool) -> str:
    """Greedy: the first turn, then the next one at least (or more than) `gap` later."""
    later = f"c.t > s.t + {gap}" if strict else f"c.t >= s.t + {gap}"
    same = " AND ".join(f"c.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    return f"""sent AS (SELECT {keys}, min(t) AS t FROM due GROUP BY {keys}
  UNION ALL SELECT {", ".join("s." + k.strip() for k in keys.split(","))}, (SELECT min(c.t) FROM due c WHERE {same} AND {later}) FROM sent s WHERE s.t IS NOT NULL)"""


_A, _K = ANOMALY, "kind, instance, event"
ANOMALY_TURNS = f"""each AS (SELECT instance, event, epoch_us(timestamp) AS us FROM log),
cnt AS (SELECT 'rate_spike' AS kind, instance, event, (us // 15000000 + 1) * 15 AS t, count(*) AS n, count(*) AS total FROM each GROUP BY ALL
  UNION ALL SELECT 'unstructured_surge', instance, 'unstructured_surge', (us // 15000000 + 1) * 15 AS t, count(*) FILTER (WHERE event = 'unstructured'), count(*) FROM each GROUP BY ALL),
{_grid(_K)},
sums AS (SELECT {_K}, t, coalesce(sum(n) OVER m, 0)::BIGINT AS c, coalesce(sum(total) OVER m, 0)::BIGINT AS c_total, coalesce(sum(n) OVER w, 0) AS held, count(n) OVER w AS filled,
    len(list_distinct(list((t - 15) // 60) FILTER (WHERE n IS NOT NULL) OVER w)) AS minutes FROM grid
  WINDOW m AS (PARTITION BY {_K} ORDER BY t RANGE BETWEEN 45 PRECEDING AND CURRENT ROW), w AS (PARTITION BY {_K} ORDER BY t RANGE BETWEEN {_A["window_s"] - 15} PRECEDING AND CURRENT ROW)),
rated AS (SELECT *, CASE WHEN kind = 'rate_spike' THEN (c - average) / greatest(sqrt(average), 1.0) WHEN c_total > 0 THEN c / c_total * 100 ELSE 0 END AS measure
  FROM (SELECT *, held / {MINUTES(_A["window_s"])} AS average FROM sums)),
high AS (SELECT *, filled > 0 AND CASE WHEN kind = 'rate_spike' THEN minutes >= {_A["min_minutes"]} AND c >= {_A["min_count"]} AND measure >= {_A["raise_z"]} AND c >= average * {_A["min_ratio"]}
    ELSE c_total >= {_A["min_total"]} AND measure > {_A["raise_share"]} AND c >= {_A["min_surge"]} END AS high,
    CASE WHEN kind = 'rate_spike' THEN minutes >= {_A["min_minutes"]} AND measure < {_A["clear_z"]} ELSE c_total >= {_A["min_total"]} AND measure < {_A["clear_share"]} END AS low,
    t - {START} >= {_A["warmup_s"]} AS armed FROM rated),
folded AS (SELECT *, coalesce(last_value(CASE WHEN high THEN 1 WHEN low OR filled = 0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY {_K} ORDER BY t
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS active FROM high),
turns AS (SELECT *, CASE WHEN active > was THEN 'raised' WHEN active < was THEN CASE WHEN filled = 0 THEN 'aged' ELSE 'cleared' END END AS change
  FROM (SELECT *, lag(active, 1, 0) OVER (PARTITION BY {_K} ORDER BY t) AS was FROM folded))"""

_S, _E = SHIFT, "source, target, protocol"
SHIFT_TURNS = f"""cnt AS (SELECT {_E}, (epoch_us(timestamp) // 15000000 + 1) * 15 AS t, count(*) AS n, max(epoch_us(timestamp)) AS last FROM live GROUP BY ALL),
{_grid(_E)},
sums AS (SELECT {_E}, t, coalesce(sum(n) OVER (PARTITION BY {_E} ORDER BY t RANGE BETWEEN 45 PRECEDING AND CURRENT ROW), 0)::BIGINT AS rate,
    round(coalesce(sum(n) OVER (PARTITION BY {_E} ORDER BY t RANGE BETWEEN {_S["window_s"] - 15} PRECEDING AND CURRENT ROW), 0) / {MINUTES(_S["window_s"])}, 2) AS base,
    t - max(last) OVER (PARTITION BY {_E} ORDER BY t) / 1e6 AS quiet FROM grid),
known AS (SELECT s.*, d.source IS NOT NULL AS declared, coalesce(expected_min_rate, 0) AS expected FROM sums s LEFT JOIN declared d USING ({_E})),
judged AS (SELECT *, declared AND expected > 0 AND quiet > {_S["silent_s"]} AND rate = 0 AS silent,
    rate >= {_S["min_rate"]} AND base > 0 AND (rate - base) / greatest(sqrt(base), 1.0) >= {_S["min_z"]} AND rate >= base * {_S["min_ratio"]} AS surge,
    base >= {_S["heavy"]} AND rate < base * {_S["drop"]} AND quiet <= {_S["silent_s"]} AS starved FROM known),
kinds AS (SELECT *, unnest([{{'type': 'SILENT_LINK', 'found': silent, 'severity': CASE WHEN expected >= 2 THEN 'critical' ELSE 'warning' END}},
    {{'type': 'NOVEL_EDGE', 'found': NOT silent AND NOT declared, 'severity': 'warning'}}, {{'type': 'FLOW_SURGE', 'found': NOT silent AND surge, 'severity': 'warning'}},
    {{'type': 'STARVATION', 'found': NOT silent AND NOT surge AND starved, 'severity': 'notice'}}], recursive := true) FROM judged),
turns AS (SELECT *, source || '->' || target || ':' || protocol AS edge_id, CASE WHEN found AND NOT was THEN 'raised' WHEN was AND NOT found THEN 'cleared' END AS change
  FROM (SELECT *, lag(found, 1, false) OVER (PARTITION BY {_E}, type ORDER BY t) AS was FROM kinds))"""



def _sweep(name: str, clock: str, last: str | None) -> str:
    """Detections of one sweep, which looks back 100 seconds (50 for logins), or to the sweep before it."""
    back = lambda s: f"to_seconds({s if last is None else f'greatest({s}, ceil(epoch({clock}) - epoch({last})))'}::BIGINT)"
    web = tuple(c.replace("raw ILIKE '%HTTP/1.1%')", f"raw ILIKE '%HTTP/1.1%' AND timestamp >= {clock} - {back(100)})") for c in VIEW)
    logins = lambda name, sign: people(name, f"event = 'auth_ssh_accepted' AND timestamp {sign} {clock} - {back(50)}")
    parts = ", ".join([f"log AS (SELECT * FROM flat WHERE timestamp <= {clock})", *web, reasons(), AUTH, logins("recent", ">="), logins("past", "<"), UNEXPECTED[3]])
    return f"""{name} AS (WITH RECURSIVE {parts}
  SELECT 'threat_actor' AS kind, subject, instance, severity_hint, CASE WHEN reason LIKE 'attempted%' OR reason LIKE 'repeated%' THEN reason
    WHEN inconsistency >= 40 THEN 'claimed to be something it is not (inconsistency ' || inconsistency || ')' ELSE reason END AS reason
    FROM raised LEFT JOIN profile ON ip = subject WHERE reason IS NOT NULL OR inconsistency >= 40
  UNION ALL SELECT 'unexpected_login', usr || '@' || src_ip, host, CASE WHEN kind = 'new-host-user' THEN 'high' ELSE 'medium' END,
    kind || ': ' || usr || ' on ' || host || ' from ' || src_ip FROM novel)"""


_CLOCK = lambda k: f"(SELECT c{k} FROM clocks)"
FINDINGS = "WITH RECURSIVE " + ", ".join([
    CLOG.replace("log AS", "flat AS MATERIALIZED", 1),
    """parts AS (SELECT timestamp, floor((epoch_us(timestamp) - lo) * 3 / (hi - lo + 1)) AS part FROM flat, (SELECT min(epoch_us(timestamp)) AS lo, max(epoch_us(timestamp)) AS hi FROM flat)),
clocks AS MATERIALIZED (SELECT max(timestamp) FILTER (WHERE part = 0) AS c1, max(timestamp) FILTER (WHERE part = 1) AS c2, max(timestamp) AS c3 FROM parts)""",
    _sweep("s1", _CLOCK(1), None), _sweep("s2", _CLOCK(2), _CLOCK(1)), _sweep("s3", _CLOCK(3), _CLOCK(2)),
    f"""hit AS (SELECT *, 1 AS k, {_CLOCK(1)} AS c FROM s1 UNION ALL SELECT *, 2, {_CLOCK(2)} FROM s2 UNION ALL SELECT *, 3, {_CLOCK(3)} FROM s3),
folded AS (SELECT kind, subject, instance, count(*) AS occurrences, min(k) AS k1, max(k) AS k3, min(c) AS first, max(c) AS last, arg_max(reason, k) AS reason FROM hit GROUP BY ALL),
judged AS (SELECT *, CASE WHEN k1 = 1 AND nn % 5 <> 4 AND v IN {OF(V.VERDICTS)} THEN v END AS verdict FROM (
  SELECT *, CAST(regexp_extract(subject, '[0-9]+$', 0) AS INT) AS nn, {words(V.VERDICTS + ['maybe'])}[CAST(regexp_extract(subject, '[0-9]+$', 0) AS INT) % 6 + 1] AS v FROM folded))"""])

#: The feeds' rows as stored: what the rules make of lines, and what ECS documents say.
_EMPTY = ", ".join(f"NULL::VARCHAR AS {c}" for c in ("f_peer_ip", "f_ip", "f_path", "f_url"))
MIXED = f"""part AS (SELECT *, (id // 4) % 4 AS g, id % 50 AS odd FROM ruled),
e AS (SELECT *, regexp_extract(props, '[0-9]+', 0) AS k, user_id::VARCHAR AS n FROM events WHERE (event_id // 4) % 4 = 3),
lines AS (SELECT 'text' AS kind, rule AS event, NULL AS instance, {SQL_AS_OF} AS timestamp, raw FROM part WHERE g = 0 AND odd >= 4
  UNION ALL SELECT 'json', rule, instance, {SQL_AS_OF}, raw FROM part WHERE g = 1 AND odd NOT BETWEEN 4 AND 7
  UNION ALL SELECT 'streams', rule, instance, timestamp, raw FROM part WHERE g = 2 AND odd NOT BETWEEN 8 AND 11),
documents_in AS (SELECT 'ecs' AS kind, CASE WHEN event_id % 2 = 0 THEN 'web.access' ELSE 'unstructured' END AS event, CASE WHEN event_id % 2 = 0 THEN 'host-' ELSE 'h' END || n AS instance,
    CASE WHEN event_id % 5 = 0 AND event_id % 2 = 1 THEN {SQL_AS_OF} ELSE ts END AS timestamp,
    CASE WHEN event_id % 2 = 0 THEN '198.51.100.' || n || ' - - [-] "GET /p/' || k || ' HTTP/1.1" 404 0 "-" "-"' ELSE 'line ' || k END AS raw, event_id FROM e WHERE event_id % 10 NOT IN (7, 9)),
mixed AS (SELECT *, {_EMPTY} FROM (SELECT * FROM lines UNION ALL SELECT kind, event, instance, timestamp, raw FROM documents_in))"""
MIXED_REJECTS = """refused AS (SELECT 'json' AS kind, 'not JSON' AS reason, count(*) AS n FROM part WHERE g = 1 AND odd BETWEEN 4 AND 7
  UNION ALL SELECT 'streams', 'no stream', 2 * count(*) FROM part WHERE g = 2 AND odd BETWEEN 8 AND 11
  UNION ALL SELECT 'streams', 'short entry', 2 * count(*) FROM part WHERE g = 2 AND odd NOT BETWEEN 8 AND 11
  UNION ALL SELECT 'ecs', 'no object', count(*) FROM e WHERE event_id % 10 = 7 UNION ALL SELECT 'ecs', 'nothing to store', count(*) FROM e WHERE event_id % 10 = 9)"""

STREAM_SQL = {
    "ingested_all_sources": real("""SELECT event, instance, strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n, count(*) AS ids, 0::BIGINT AS differ FROM mixed GROUP BY ALL""", MATCH, MIXED),
    "mixed_rejects": real("SELECT kind, reason, n FROM refused WHERE n > 0", MATCH, MIXED, MIXED_REJECTS),
    "mixed_accounting": real("""SELECT m + u + s AS total, m AS matched, u AS unstructured, s AS structured, f AS filtered, r AS rejected, c AS ts_clamped, round(m / (m + u + s) * 100, 4) AS hit_rate FROM
        (SELECT sum(CASE WHEN event <> 'unstructured' THEN times ELSE 0 END)::BIGINT AS m, sum(CASE WHEN event = 'unstructured' THEN times ELSE 0 END)::BIGINT AS u
         FROM (SELECT event, CASE WHEN kind = 'streams' THEN 2 ELSE 1 END AS times FROM lines)), (SELECT count(*) AS s, count(*) FILTER (WHERE event_id % 5 = 0 AND event_id % 2 = 1) AS c FROM documents_in),
        (SELECT count(*) AS f FROM part WHERE g = 0 AND odd < 4), (SELECT sum(n)::BIGINT AS r FROM refused)""", MATCH, MIXED, MIXED_REJECTS),
    "mixed_search": real("""SELECT event, instance, epoch_us(timestamp) AS at_us, raw FROM mixed WHERE (event = 'socket_line' AND contains(raw, 'peer=198.51.100.8 '))
        OR (event = 'key_accepted' AND contains(raw, 'from 198.51.100.8 ')) OR (event = 'any_info' AND contains(raw, ' 198.51.100.8:'))
        OR (event = 'web.access' AND starts_with(raw, '198.51.100.8 '))""", MATCH, MIXED),
    "mixed_actors": real("SELECT ip, hits, hostile_hits, threat_tier, score FROM actors", MATCH, MIXED,
                         "seen_rows AS (SELECT row_number() OVER () AS id, * REPLACE (coalesce(instance, 'unknown') AS instance) FROM mixed)", hits("seen_rows"), actors("hits")),
    "stream_findings": FINDINGS + f""" SELECT kind, subject, instance, CASE WHEN verdict IN {OF(V.DISMISSING_VERDICTS)} THEN 'dismissed'
        WHEN verdict IS NOT NULL AND k3 = 1 THEN 'triaged' ELSE 'new' END AS state, verdict, occurrences, epoch_us(first) AS first_us, epoch_us(last) AS last_us, reason FROM judged""",
    "stream_ingest": real("SELECT rule AS event, strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n FROM ruled GROUP BY ALL", MATCH),
    "stream_pages": """SELECT job, line, count(*) AS n, min(ts_ns) AS first_ns, sum(ts_ns % 1000003)::BIGINT AS check_ns FROM (
        SELECT DISTINCT 'j' || (user_id % 3) AS job, 'line ' || user_id AS line, epoch_us(ts) * 1000 + event_id % 1000 AS ts_ns FROM events) GROUP BY ALL""",
    "stream_dedup": "SELECT 'line ' || user_id AS line, count(DISTINCT epoch_us(ts)) AS n, count(DISTINCT epoch_us(ts)) AS instants FROM events GROUP BY ALL",
    "stream_clamped": real(f"""SELECT event, strftime(CASE WHEN id % 40 = 1 THEN {SQL_AS_OF} ELSE timestamp END, '%Y-%m-%d') AS day,
        (id % 40 = 1)::INT AS suspect, count(*) AS n FROM log GROUP BY ALL"""),
    "stream_anomalies": compressed("""SELECT kind, instance, event, epoch_us(tick) AS tick_us, n, active::INT AS active FROM states
        WHERE tick <= (SELECT max(timestamp) FROM log)""", TICKS),
    "stream_unit_alerts": SQL["unit_alerts"],
    "stream_anomaly_alerts": restless(f"""SELECT kind, instance, event, t * 1000000 AS turn_us, c AS n, round(measure, 6) AS measure
        FROM turns JOIN sent USING (kind, instance, event, t)""", ANOMALY_TURNS, "due AS (SELECT * FROM turns WHERE high AND armed)", _sent(_K, _A["cooldown_s"], False)),
    "stream_anomaly_changes": restless("SELECT kind, instance, event, t * 1000000 AS turn_us, change, armed::INT AS armed FROM turns WHERE change IS NOT NULL", ANOMALY_TURNS),
    "stream_shifts": restless("""SELECT edge_id, type, CASE WHEN change = 'raised' THEN severity END AS severity, t * 1000000 AS turn_us, change, rate AS rate_1m,
        round(base * 100)::BIGINT AS baseline_x100 FROM turns WHERE change IS NOT NULL""", SOCK, LIVE, DECLARED, SHIFT_TURNS),
    "shift_alerts": restless("""SELECT edge_id, type, t * 1000000 AS turn_us, floor(quiet * 10)::BIGINT AS quiet_x10 FROM turns JOIN sent USING (edge_id, t) WHERE type = 'SILENT_LINK'""",
        SOCK, LIVE, DECLARED, SHIFT_TURNS, "due AS (SELECT * FROM turns WHERE found AND severity = 'critical')", _sent("edge_id", _S["cooldown_s"], True)),
    "graph_upkeep": SQL["topology_shifts"].replace("SELECT edge_id, type, severity, rate_1m FROM shift", "SELECT edge_id, type, severity FROM shift WHERE type = 'NOVEL_EDGE'"),
}
STREAM_SQL["stream_skeletons"] = ("SELECT skeleton, (n // 3)::BIGINT AS emitted, (n // 3 * 3)::BIGINT AS lines FROM ("
                                  + SQL["skeletons"] + ") WHERE n >= 3")
