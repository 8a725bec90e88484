"""A log table derived from the `events` table, the same in Spark and DuckDB.

The given tables hold no log lines, so every event becomes one: an access line in
one of two dialects, a socket snapshot, a resolver or ssh line, or an auth event.
Integer arithmetic only; the clock and the access-line stamp are the two places
where the dialects differ.

`real` keeps the table's own timestamps (thirty days). `compressed` puts ten
events in a second, so that rates, cadences and shifts have something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetsift.session import scratch_path
from fleetsift.sources.events import write_events

PATHS = [
    "/.env", "/.ssh/id_rsa", "/.git/config", "/Jenkinsfile",
    "/fetch?url=http://169.254.169.254/latest/meta-data/", "/proxy", "/vendor/phpunit/eval-stdin.php",
    "/?file=../../etc/passwd", "/shell.php", "/phpinfo.php", "/mcp", "/graphql",
    "/SDK/webLanguage", "/wp-login.php", "/site.zip", "/admin", "/robots.txt", "/",
    "/health", "/static/app.js", "/blog/post-1", "//0.php", "/config/app.json", "/sa.json",
]
AGENTS = [
    "curl/8.4.0",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:60.0) Gecko/20100101 Firefox/60.0",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_5) AppleWebKit/605.1.15 Version/17.5 Safari/605.1.15",
]
FIELDS = ["ip", "path", "method", "status", "ua", "url", "user", "src_ip", "service", "actor",
          "command", "proto", "state", "local_ip", "local_port", "peer_ip", "peer_port",
          "process", "pid"]


def _choose(index: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


def flat_sql(dialect: str, clock: str) -> str:
    """SELECT with one row per event: id, timestamp, event, instance, source, raw, f_* fields."""
    spark = dialect == "spark"
    micros = "1704067200000000 + event_id * 100000"
    if clock == "compressed":
        stamp = f"timestamp_micros({micros})" if spark else f"make_timestamp({micros})"
    else:
        stamp = "CAST(ts AS TIMESTAMP)"
    clf = ("date_format(stamp, 'dd/MMM/yyyy:HH:mm:ss')" if spark
           else "strftime(stamp, '%d/%b/%Y:%H:%M:%S')")
    digits = r"regexp_extract(props, '[0-9]+', 0)"
    return f"""
SELECT event_id AS id, stamp AS timestamp,
  CASE family WHEN 'uvicorn' THEN CASE WHEN k % 4 = 0 THEN 'unstructured' ELSE 'uvicorn_access' END
    WHEN 'nginx' THEN 'nginx_access' WHEN 'netsnap' THEN 'netsnap_socket'
    WHEN 'sshd' THEN 'publickey_accepted' WHEN 'dnsmasq' THEN 'query_result'
    ELSE CASE event_type WHEN 'view' THEN 'auth_ssh_accepted' WHEN 'click' THEN 'auth_session_opened'
      WHEN 'purchase' THEN 'auth_session_closed' WHEN 'signup' THEN 'auth_sudo_command'
      ELSE 'auth_sudo_failed' END END AS event,
  instance, family AS source,
  CASE family
    WHEN 'uvicorn' THEN 'INFO:     ' || ip || ':' || sport || ' - "GET ' || path || ' HTTP/1.1" ' || status || ' Done'
    WHEN 'nginx' THEN ip || ' - - [' || {clf} || ' +0000] "GET ' || path || ' HTTP/' || proto || '" ' || status
      || ' 134 "' || referer || '" "' || ua || '"'
    WHEN 'netsnap' THEN 'netsnap proto=tcp state=established local=' || local_ip || ' local_port=' || local_port
      || ' peer=' || peer_ip || ' peer_port=' || peer_port || ' process=' || process || ' pid=' || (1000 + k)
    WHEN 'sshd' THEN 'Accepted publickey for ' || account || ' from ' || ip || ' port ' || (50000 + k) || ' ssh2'
    WHEN 'dnsmasq' THEN 'query[A] ' || domain || ' from ' || ip
    ELSE 'auth event for ' || account || ' on ' || instance || ' seq ' || event_id END AS raw,
  CASE WHEN full_kv OR family IN ('sshd', 'dnsmasq') THEN ip WHEN family = 'netsnap' THEN local_ip END AS f_ip,
  CASE WHEN full_kv THEN path END AS f_path, CASE WHEN full_kv THEN 'GET' END AS f_method,
  CASE WHEN full_kv THEN status END AS f_status, CASE WHEN full_kv THEN ua END AS f_ua,
  CASE WHEN family = 'dnsmasq' THEN domain END AS f_url,
  CASE WHEN family = 'auth' AND event_type IN ('view', 'click', 'purchase') THEN account END AS f_user,
  CASE WHEN family = 'auth' AND event_type = 'view' THEN ip END AS f_src_ip,
  CASE WHEN family = 'auth' AND event_type IN ('click', 'purchase') THEN
    CASE WHEN k % 4 = 0 THEN 'cron' ELSE 'sshd' END END AS f_service,
  CASE WHEN family = 'auth' AND event_type IN ('signup', 'error') THEN account END AS f_actor,
  CASE WHEN family = 'auth' AND event_type = 'signup' THEN '/usr/bin/id' END AS f_command,
  CASE WHEN family = 'netsnap' THEN 'tcp' END AS f_proto,
  CASE WHEN family = 'netsnap' THEN 'established' END AS f_state,
  CASE WHEN family = 'netsnap' THEN local_ip END AS f_local_ip,
  CASE WHEN family = 'netsnap' THEN local_port END AS f_local_port,
  CASE WHEN family = 'netsnap' THEN peer_ip END AS f_peer_ip,
  CASE WHEN family = 'netsnap' THEN peer_port END AS f_peer_port,
  CASE WHEN family = 'netsnap' THEN process END AS f_process,
  CASE WHEN family = 'netsnap' THEN CAST(1000 + k AS STRING) END AS f_pid
FROM (
  SELECT *, family = 'nginx' AND k % 5 = 0 AS full_kv FROM (
    SELECT event_id, event_type, k, {stamp} AS stamp,
      'host-' || (user_id % 6) AS instance, '198.51.100.' || (user_id % 40) AS ip,
      CAST(40000 + user_id % 7 AS STRING) AS sport,
      {_choose(f"(event_id * 7 + k) % {len(PATHS)}", PATHS)} AS path,
      CASE WHEN event_type IN ('error', 'signup') THEN '404' WHEN event_type = 'click' THEN '304' ELSE '200' END AS status,
      {_choose("(CASE WHEN k = 99 THEN 4 ELSE user_id % 5 END)", AGENTS)} AS ua,
      CASE WHEN user_id % 5 = 4 AND k % 10 = 0 THEN 'https://example.test/' ELSE '-' END AS referer,
      CASE WHEN k = 98 THEN '1.0' ELSE '1.1' END AS proto,
      'u' || (user_id % 9) AS account, 'd' || (user_id % 12) || '.example.com' AS domain,
      CASE event_id % 4 WHEN 0 THEN 'uvicorn' WHEN 1 THEN 'nginx' WHEN 3 THEN 'auth'
        ELSE CASE k % 10 WHEN 9 THEN 'sshd' WHEN 8 THEN 'dnsmasq' ELSE 'netsnap' END END AS family,
      '10.0.0.' || (10 + user_id % 6) AS local_ip,
      CAST(CASE WHEN k < 50 THEN 22 ELSE 40000 + k END AS STRING) AS local_port,
      CASE WHEN user_id % 10 = 0 THEN '10.0.0.' || (10 + k % 6) ELSE '198.51.100.' || (user_id % 40) END AS peer_ip,
      CAST(CASE WHEN k < 50 THEN 50000 + k ELSE 443 END AS STRING) AS peer_port,
      {_choose("k % 3", ["sshd", "nginx", "-"])} AS process
    FROM (SELECT event_id, user_id, event_type, ts, CAST({digits} AS INT) AS k FROM events) AS numbered
  ) AS picked
) AS rows
"""


def restless_sql(dialect: str) -> str:
    """The compressed log with incidents: every row stays, but some hosts' rows are dealt out in time unevenly.

    host-0 sends all its rows in the first two fifths and is silent for good; host-1 sends 15 percent of its rows in
    the first half and the rest in the second; host-2 sends 95 percent in the first three fifths.
    """
    div = "div" if dialect == "spark" else "//"
    at = (f"CASE instance WHEN 'host-0' THEN o * 2 {div} 5 "
          f"WHEN 'host-1' THEN CASE WHEN o < span * 15 {div} 100 THEN o * 50 {div} 15 ELSE span {div} 2 + (o - span * 15 {div} 100) * 50 {div} 85 END "
          f"WHEN 'host-2' THEN CASE WHEN o < span * 95 {div} 100 THEN o * 60 {div} 95 ELSE span * 60 {div} 100 + (o - span * 95 {div} 100) * 8 END ELSE o END")
    make = "timestamp_micros" if dialect == "spark" else "make_timestamp"
    drop = "* EXCEPT (timestamp, o, span)" if dialect == "spark" else "* EXCLUDE (timestamp, o, span)"
    return (f"SELECT {drop}, {make}(1704067200000000 + {at}) AS timestamp FROM (SELECT *, CAST(id AS BIGINT) * 100000 AS o, "
            "(SELECT CAST(max(event_id) AS BIGINT) * 100000 FROM events) AS span FROM flat) AS timed")


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, spread evenly: a small file is one split."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").repartition(spark.sparkContext.defaultParallelism)


def flat_log(spark: SparkSession, sf_dir: str, clock: str = "real") -> DataFrame:
    events = events_table(spark, sf_dir)
    if clock == "restless":
        return spark.sql(restless_sql("spark").replace("FROM events)", "FROM {events})").replace("FROM flat)", "FROM {flat})"),
                         events=events, flat=flat_log(spark, sf_dir, "compressed"))
    return spark.sql(flat_sql("spark", clock).replace("FROM events)", "FROM {events})"), events=events)


def to_events(flat: DataFrame) -> DataFrame:
    """The flat rows as stored events with label and field maps."""
    kv = F.map_filter(F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f"f_{f}"))]),
                      lambda _, v: v.isNotNull())
    return flat.select(
        "id", "timestamp", "event",
        F.create_map(F.lit("instance"), F.col("instance"), F.lit("source"), F.col("source"),
                     F.lit("protocol"), F.lit("http")).alias("labels"),
        kv.alias("kv"), F.lit(0.0).alias("latency_us"), "raw")


_TABLES: dict[tuple, str] = {}


def log(spark: SparkSession, sf_dir: str, clock: str = "real") -> DataFrame:
    """The derived log as a stored table, written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, clock)
    if key not in _TABLES:
        path = scratch_path(spark, f"log-{clock}")
        write_events(to_events(flat_log(spark, sf_dir, clock)), path, mode="overwrite")
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])
