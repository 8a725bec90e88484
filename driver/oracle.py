"""DuckDB SQL for the registered queries, written against the derived rows."""

from __future__ import annotations

from fleetsift import fixed_values as V

from .derived import FIELDS, PATHS, flat_sql
from .queries import ORGS, RULES

q = lambda text: "'" + text.replace("'", "''") + "'"
LOG = f"log AS ({flat_sql('duckdb', 'real')})"
CLOG = f"log AS ({flat_sql('duckdb', 'compressed')})"
LAST = "(SELECT make_timestamp(1704067200000000 + max(event_id) * 100000) FROM events)"
US = lambda c: f"epoch_us({c})"


def real(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join([LOG, *ctes]) + "\n" + body


def compressed(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join([CLOG, *ctes]) + "\n" + body


# ---- requests and techniques -------------------------------------------------------

def _first(pattern: str) -> str:
    return f"regexp_matches(clean, {q('(?i)' + pattern)})"


def _rule(pattern: str) -> str:
    if "google(?!-services)|" not in pattern:
        return _first(pattern)
    rest = pattern.replace("google(?!-services)|", "")
    return (f"({_first(rest)} OR ({_first('(?:^|/)google[^/]*[.]json$')} "
            f"AND NOT {_first('(?:^|/)google-services[^/]*[.]json$')}))")


TECHNIQUE = ("CASE WHEN clean = '' THEN 'unknown' WHEN " + _first(V.DEFAULT_BENIGN_PATHS) + " OR "
             + _first(V.ALWAYS_BENIGN_PATHS) + " THEN 'benign' "
             + " ".join(f"WHEN {_rule(p)} THEN '{n}'" for n, _, p in V.TECHNIQUE_RULES) + " ELSE 'unknown' END")
TACTIC = ("CASE technique WHEN 'benign' THEN 'none' "
          + " ".join(f"WHEN '{n}' THEN '{t}'" for n, t in {n: t for n, t, _ in V.TECHNIQUE_RULES}.items())
          + " ELSE 'unknown' END")


def hits(source: str = "log") -> str:
    u, n = q(V.UVICORN_LOOSE_LINE), q(V.COMBINED_LINE)
    pick = lambda iu, i_n, other: (f"CASE WHEN u THEN regexp_extract(raw, {u}, {iu}) "
                                   f"WHEN n THEN regexp_extract(raw, {n}, {i_n}) ELSE {other} END")
    return f"""hits AS (
  SELECT *, {TECHNIQUE} AS technique FROM (
    SELECT *, regexp_replace(split_part(path, '?', 1), '/{{2,}}', '/', 'g')
      || substr(path, length(split_part(path, '?', 1)) + 1) AS clean FROM (
      SELECT id, timestamp, instance AS target, {pick(1, 1, 'coalesce(f_peer_ip, f_ip)')} AS ip,
        {pick(4, 4, 'coalesce(f_path, f_url)')} AS path, {pick(3, 3, "'GET'")} AS method,
        {pick(5, 6, "''")} AS status
      FROM (SELECT *, regexp_matches(raw, {u}) AS u, regexp_matches(raw, {n}) AS n FROM {source}))
    WHERE ip IS NOT NULL AND path IS NOT NULL))"""


def words(items) -> str:
    return "[" + ", ".join(q(w) for w in items) + "]"


WEIGHT = "CASE technique " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in V.TECHNIQUE_WEIGHTS.items()) + " ELSE 3 END"
OF = lambda names: "(" + ", ".join(q(n) for n in names) + ")"


def actors(hit_table: str = "hits", paths: int = 40, min_hits: int = 1) -> str:
    """CTEs up to `actors`: facts, identity and score per address."""
    return f"""tech AS (SELECT ip, technique, count(*) AS n FROM {hit_table} WHERE technique <> 'benign' GROUP BY ALL),
techs AS (SELECT ip, string_agg(technique || '=' || n, ',' ORDER BY technique) AS techniques,
    coalesce(string_agg(technique, '+' ORDER BY technique) FILTER (WHERE technique <> 'unknown'), '') AS fingerprint,
    string_agg(technique, ',' ORDER BY technique) AS names,
    sum({WEIGHT}) AS breadth, sum(n) AS hostile_hits,
    bool_or(technique IN {OF(V.CRITICAL_TIER)}) AS crit, bool_or(technique IN {OF(V.HIGH_TIER)}) AS high,
    bool_or(technique <> 'recon') AS wider FROM tech GROUP BY ip),
tacs AS (SELECT ip, string_agg(DISTINCT {TACTIC}, ',' ORDER BY {TACTIC}) AS tactics FROM tech GROUP BY ip),
base AS (SELECT ip, count(*) AS hits, count(*) FILTER (WHERE technique = 'benign') AS benign_hits,
    count(DISTINCT target) AS n_targets, string_agg(DISTINCT target, ',' ORDER BY target) AS targets,
    min(timestamp) AS first_seen, max(timestamp) AS last_seen, max((timestamp, id)) AS newest FROM {hit_table} GROUP BY ip),
stat AS (SELECT ip, string_agg(status || '=' || n, ',' ORDER BY status || '=' || n) AS statuses
    FROM (SELECT ip, status, count(*) AS n FROM {hit_table} GROUP BY ALL) GROUP BY ip),
seen AS (SELECT ip, path, row_number() OVER (PARTITION BY ip ORDER BY max((timestamp, id)) DESC) AS place
    FROM {hit_table} WHERE technique <> 'benign' GROUP BY ip, path),
kept AS (SELECT ip, path, row_number() OVER (PARTITION BY ip ORDER BY path) AS i FROM seen WHERE place <= {paths}),
pths AS (SELECT ip, count(*) AS distinct_paths, string_agg(path, ',' ORDER BY path) FILTER (WHERE i <= 8) AS sample_paths FROM kept GROUP BY ip),
actors AS (SELECT base.ip, hits, benign_hits, hostile_hits::BIGINT AS hostile_hits, techniques, names, tactics, fingerprint, targets,
    distinct_paths, sample_paths, statuses, first_seen, last_seen, newest,
    (breadth + least(hostile_hits, 50) // 5 + 10 * (n_targets - 1))::BIGINT AS score,
    CASE WHEN fingerprint = '' THEN 'LOW' WHEN crit THEN 'CRITICAL' WHEN high THEN 'HIGH' WHEN wider THEN 'ELEVATED' ELSE 'RECON' END AS threat_tier,
    CASE WHEN fingerprint = '' THEN 'ACTOR-0000' ELSE 'ACTOR-' || upper(substr(sha256(fingerprint), 1, 4)) END AS actor_id,
    {NAME('fingerprint')} AS actor_name
  FROM base JOIN techs USING (ip) JOIN tacs USING (ip) JOIN stat USING (ip) JOIN pths USING (ip) WHERE hostile_hits >= {min_hits})"""


def NAME(mark: str) -> str:
    number = f"CAST('0x' || substr(sha256({mark}), 1, 8) AS BIGINT)"
    return (f"CASE WHEN {mark} = '' THEN 'UNKNOWN ACTOR' ELSE {words(V.CODENAME_ADJECTIVES)}[{number} % 64 + 1] || ' ' || "
            f"{words(V.CODENAME_NOUNS)}[({number} // 64) % 64 + 1] END")


DAY_HITS = "dayhits AS (SELECT * REPLACE (ip || '/' || strftime(timestamp, '%d') AS ip) FROM hits)"
LASTOCT = "CAST(regexp_extract(ip, '[0-9]+$', 0) AS INT)"
OWNERS = f"""owned AS (SELECT ip, CASE WHEN n % 7 = 6 THEN NULL ELSE 'AS' || (64500 + n % 4) END AS asn,
    '198.51.100.' || (n - n % 8) || '/29' AS prefix, CASE WHEN n % 2 = 0 THEN 'NL' ELSE 'US' END AS country,
    {words(ORGS)}[n % 4 + 1] AS org FROM (SELECT DISTINCT ip, {LASTOCT} AS n FROM allhits) WHERE n % 9 <> 8),
named AS (SELECT ip, CASE WHEN n % 10 = 2 THEN 'crawl-' || n || '.googlebot.com'
    WHEN n % 10 = 7 THEN 'host-' || n || '.example.net.' END AS rdns FROM (SELECT DISTINCT ip, {LASTOCT} AS n FROM allhits))"""
ALLHITS = "allhits AS (SELECT * FROM hits)"

ACTOR_COLUMNS = (f"ip, actor_id, actor_name, threat_tier, hits, hostile_hits, benign_hits, techniques, tactics, fingerprint, "
                 f"targets, distinct_paths, sample_paths, statuses, {US('first_seen')} AS first_us, {US('last_seen')} AS last_us, score")
ROWS = f"id, {US('timestamp')} AS at_us, event, instance, raw"
NEWEST = "ORDER BY timestamp DESC, id DESC LIMIT"
ANY_FIELD = lambda v: "(" + " OR ".join(f"f_{f} = {q(v)}" for f in FIELDS) + ")"
NETWORK = f"(event LIKE 'netsnap%' OR source = 'netsnap' OR event IN {OF(V.NETWORK_EVENTS)})"
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

SQL: dict[str, str] = {}

SQL["search_value"] = real(f"SELECT {ROWS} FROM log WHERE {ANY_FIELD('198.51.100.8')} AND timestamp >= {AS_OF} - INTERVAL 20 DAY {NEWEST} 50")
SQL["search_text"] = real(f"SELECT {ROWS} FROM log WHERE raw ILIKE '%WP-login%' {NEWEST} 40")
SQL["search_field"] = real(f"SELECT {ROWS} FROM log WHERE f_user = 'u3' {NEWEST} 30")
SQL["search_port_process"] = real(f"SELECT {ROWS} FROM log WHERE '443' IN (f_local_port, f_peer_port) AND f_process = 'nginx' {NEWEST} 200000")
SQL["search_value_indexed"], SQL["search_field_indexed"] = SQL["search_value"], SQL["search_field"]
SQL["search_port_indexed"] = SQL["search_port_process"]
SQL["count_values_indexed"] = real(" UNION ALL ".join(
    f"SELECT '{v}' AS term, count(*) AS matched FROM log WHERE {ANY_FIELD(v)} AND timestamp >= {AS_OF} - INTERVAL 7 DAY"
    for v in ("198.51.100.8", "198.51.100.21", "203.0.113.1")))
SQL["search_window"] = real(f"""SELECT {ROWS} FROM log WHERE event = 'nginx_access' AND instance = 'host-2' AND source = 'nginx'
  AND timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00' {NEWEST} 1000""")
SQL["search_by_shape"] = real(f"""SELECT '198.51.100.8' AS term, count(*) AS matched FROM log WHERE {ANY_FIELD('198.51.100.8')}
  UNION ALL SELECT 'process:sshd', count(*) FROM log WHERE f_process = 'sshd' UNION ALL SELECT 'phpinfo', count(*) FROM log WHERE raw ILIKE '%phpinfo%'""")
SQL["count_text"] = real(f"SELECT count(*) AS matched FROM log WHERE raw ILIKE '%HTTP/1.1%' AND timestamp >= {AS_OF} - INTERVAL 7 DAY")
SQL["search_truncation"] = real("""SELECT m AS matched, least(m, 100) AS returned, m > 100 AS truncated, CASE WHEN m > 100 THEN
  'showing the most recent 100 of ' || m || ' requests in this window; raise ?limit= to widen it' END AS note
  FROM (SELECT count(*) AS m FROM log WHERE raw ILIKE '%HTTP/1.1%')""")
SQL["recent_logins"] = real(f"SELECT {ROWS} FROM log WHERE event = 'auth_ssh_accepted' {NEWEST} 25")
SQL["network_rows"] = real(f"SELECT {ROWS} FROM log WHERE {NETWORK} AND {ANY_FIELD('198.51.100.8')} {NEWEST} 1000")
SQL["network_dns"] = real(f"SELECT {ROWS} FROM log WHERE {NETWORK} AND event = 'query_result' AND instance = 'host-1' {NEWEST} 300")
SQL["instances"] = real(f"SELECT DISTINCT instance FROM log WHERE timestamp >= {AS_OF} - INTERVAL 30 DAY")

SQL["technique_counts"] = real(f"SELECT technique, {TACTIC} AS tactic, method, status, count(*) AS n, count(DISTINCT ip) AS ips FROM hits GROUP BY ALL", hits())
SQL["threat_actors"] = real(f"SELECT {ACTOR_COLUMNS} FROM actors", hits(), actors())
SQL["actor_hostile_paths"] = real("SELECT ip, count(DISTINCT path) AS hostile_paths FROM hits WHERE technique <> 'benign' GROUP BY ip", hits())
SQL["actor_paths_capped"] = real("SELECT ip, distinct_paths, sample_paths, score FROM actors", hits(), actors(paths=5, min_hits=20))
SQL["campaigns"] = real(f"""SELECT m.fingerprint, any_value(actor_id) AS actor_id, any_value(actor_name) AS actor_name,
    arg_max(threat_tier, (score, hostile_hits, newest)) AS threat_tier, count(*) AS actor_count,
    string_agg(ip, ',' ORDER BY place) FILTER (WHERE place <= 25) AS actors, sum(hostile_hits)::BIGINT AS hits, any_value(t.targets) AS targets,
    {US('min(first_seen)')} AS first_us, {US('max(last_seen)')} AS last_us
  FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC, hostile_hits DESC, newest DESC, ip) AS place
        FROM actors WHERE fingerprint NOT IN {OF(V.NOT_A_CAMPAIGN)}) m
  JOIN (SELECT fingerprint, string_agg(DISTINCT t, ',' ORDER BY t) AS targets
        FROM (SELECT fingerprint, unnest(string_split(targets, ',')) AS t FROM actors) GROUP BY fingerprint) t USING (fingerprint)
  GROUP BY m.fingerprint""", hits(), DAY_HITS, actors("dayhits"))
SQL["technique_totals"] = real("SELECT technique, count(*) AS hits FROM hits WHERE technique <> 'benign' GROUP BY ALL", hits())
INTERNAL = "('10.0.0.250', '192.0.2.10', '10.0.0.10', '10.0.0.11', '10.0.0.12', '10.0.0.13', '198.51.100.3')"
SQL["internal_addresses_left_out"] = real(f"SELECT ip, CASE WHEN ip IN {INTERNAL} THEN -1 ELSE count(*) END AS hits FROM hits GROUP BY ip", hits())
SQL["owners"] = real("""SELECT grp AS asn, first(org ORDER BY place) AS org, first(country ORDER BY place) AS country,
    count(*) AS actor_count, string_agg(ip, ',' ORDER BY place) FILTER (WHERE place <= 25) AS actors, sum(hostile_hits)::BIGINT AS hits,
    coalesce(any_value(p.prefixes), '') AS prefixes, any_value(t.techniques) AS techniques
  FROM ranked JOIN (SELECT grp, string_agg(DISTINCT t, ',' ORDER BY t) AS techniques FROM
      (SELECT grp, unnest(string_split(names, ',')) AS t FROM ranked) GROUP BY grp) t USING (grp)
  LEFT JOIN (SELECT grp, string_agg(prefix, ',' ORDER BY prefix) AS prefixes FROM
      (SELECT grp, prefix, row_number() OVER (PARTITION BY grp ORDER BY prefix) AS i FROM (SELECT DISTINCT grp, prefix FROM ranked WHERE prefix IS NOT NULL)) WHERE i <= 6 GROUP BY grp) p USING (grp)
  GROUP BY grp""", hits(), actors(), ALLHITS, OWNERS,
  """ranked AS (SELECT a.*, asn, prefix, country, org, coalesce(asn, 'unknown') AS grp,
    row_number() OVER (PARTITION BY coalesce(asn, 'unknown') ORDER BY score DESC, hostile_hits DESC, newest DESC, a.ip) AS place
    FROM actors a LEFT JOIN owned USING (ip))""")
SQL["owner_by_prefix"] = real("""SELECT ip, 'AS-' || prefix AS asn, prefix FROM (
    SELECT DISTINCT ip, '198.51.100.' || CASE WHEN n - n % 8 <> 8 THEN (n - n % 8) || '/29' ELSE (n - n % 16) || '/28' END AS prefix
    FROM (SELECT ip, CAST(regexp_extract(ip, '[0-9]+$', 0) AS INT) AS n FROM hits))""", hits())

# ---- behaviour -----------------------------------------------------------------------

def requests(source: str = "log") -> str:
    u, n = q(V.UVICORN_LINE), q(V.COMBINED_LINE)
    pick = lambda kv, i_n, iu: (f"CASE WHEN k THEN {kv} WHEN n THEN {f'regexp_extract(raw, {n}, {i_n})' if i_n else 'NULL'} "
                                f"ELSE {f'regexp_extract(raw, {u}, {iu})' if iu else 'NULL'} END")
    return f"""req AS (SELECT id, timestamp, {pick('f_ip', 1, 1)} AS ip, {pick('f_path', 4, 4)} AS path, {pick('f_status', 6, 6)} AS status,
    {pick('f_method', 3, 3)} AS method, {pick('NULL', 5, 5)} AS proto, {pick('f_ua', 8, 0)} AS ua, {pick('NULL', 7, 0)} AS referer,
    {pick('NULL', 0, 2)} AS sport, CASE WHEN n AND NOT k THEN date_trunc('second', timestamp) ELSE timestamp END AS atime
  FROM (SELECT *, f_ip IS NOT NULL AND f_path IS NOT NULL AND f_status IS NOT NULL AS k,
          regexp_matches(raw, {n}) AS n, regexp_matches(raw, {u}) AS u FROM {source}) WHERE k OR n OR u)"""


GAPS = """gaps AS (SELECT ip, (epoch_us(atime) - epoch_us(lag(atime) OVER w) + 500) // 1000 AS gap_ms FROM req WINDOW w AS (PARTITION BY ip ORDER BY atime, id))"""
MEDIAN = """med AS (SELECT ip, count(*) AS gaps, list_sort(list(gap_ms))[count(*) // 2 + 1] AS median_gap_ms FROM gaps WHERE gap_ms IS NOT NULL GROUP BY ip)"""
RUN404 = """runs AS (SELECT ip, coalesce(max(n), 0) AS longest_404_run FROM (SELECT DISTINCT ip FROM req) LEFT JOIN (
    SELECT ip, count(*) AS n FROM (SELECT ip, status, row_number() OVER (PARTITION BY ip ORDER BY timestamp, id)
        - row_number() OVER (PARTITION BY ip, coalesce(status, '') = '404' ORDER BY timestamp, id) AS island FROM req) WHERE status = '404' GROUP BY ip, island) USING (ip) GROUP BY ip)"""
BROWSER, CANDID = (f"regexp_matches(ua, {q('(?i)' + p)})" for p in (V.BROWSER_AGENT, V.CANDID_AGENT))
CRAWLER = "CASE " + " ".join(f"WHEN contains(lower(ua), '{c}') THEN '{c}'" for c in V.VERIFIABLE_CRAWLERS) + " END"
OLD = ("coalesce(" + ", ".join(
    f"CASE WHEN TRY_CAST(nullif(regexp_extract(ua, {q('(?i)' + p)}, 1), '') AS INT) < {floor} THEN 'claims {n} ' || regexp_extract(ua, {q('(?i)' + p)}, 1) || ', a build no current user runs' END"
    for p, floor, n in V.OLDEST_LIVING_BROWSER)
    + f", CASE WHEN regexp_matches(ua, {q('(?i)' + V.ANCIENT_PLATFORM)}) THEN 'claims a platform or engine that is long out of service' END)")
PROFILE = f"""agent AS (SELECT ip, count(*) AS agents, bool_or({BROWSER}) AS browser, bool_or({CANDID}) AS tool,
    arg_min({OLD}, ua) FILTER (WHERE {OLD} IS NOT NULL) AS old, arg_min({CRAWLER}, ua) FILTER (WHERE {CRAWLER} IS NOT NULL) AS claimed_crawler
  FROM (SELECT DISTINCT ip, ua FROM req WHERE ua <> '') GROUP BY ip),
fact AS (SELECT ip, count(*) AS requests, count(sport) AS port_seen, count(DISTINCT sport) AS ports, count(*) FILTER (WHERE referer NOT IN ('-', '')) AS referers,
    count(*) FILTER (WHERE regexp_matches(path, {q('(?i)' + V.ASSET_PATH)})) AS asset_fetches, bool_or(status IN ('200', '304')) AS got_page,
    bool_or(coalesce(proto = '1.0', false)) AS old_protocol, string_agg(DISTINCT method, ',' ORDER BY method) AS methods,
    (epoch_us(max(atime)) - epoch_us(min(atime))) / 1e6 AS span FROM req GROUP BY ip),
prof AS (SELECT *, browser AND NOT tool AS posing, CASE WHEN span > 0 THEN requests / span ELSE 0 END AS rate,
    CASE WHEN claimed_crawler IS NULL THEN NULL ELSE coalesce(ends_with(rdns, '.googlebot.com'), false) END AS ok
  FROM (SELECT fact.*, coalesce(agents, 0) AS agents, coalesce(browser, false) AS browser, coalesce(tool, false) AS tool, old, claimed_crawler,
      coalesce(gaps, 0) AS gaps, median_gap_ms, longest_404_run, rdns
    FROM fact LEFT JOIN agent USING (ip) LEFT JOIN med USING (ip) LEFT JOIN runs USING (ip) LEFT JOIN named USING (ip))),
profile AS (SELECT *, (CASE WHEN posing AND got_page AND asset_fetches = 0 THEN 40 ELSE 0 END + CASE WHEN posing AND requests > 5 AND referers = 0 THEN 20 ELSE 0 END
    + CASE WHEN posing AND rate >= 2 THEN 20 ELSE 0 END + CASE WHEN posing AND longest_404_run >= 20 THEN 20 ELSE 0 END
    + CASE WHEN posing AND old IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN NOT ok THEN 60 ELSE 0 END)::BIGINT AS inconsistency,
  (CASE WHEN posing AND got_page AND asset_fetches = 0 THEN 1 ELSE 0 END + CASE WHEN posing AND requests > 5 AND referers = 0 THEN 1 ELSE 0 END
    + CASE WHEN old IS NOT NULL AND NOT tool THEN 1 ELSE 0 END + CASE WHEN ok IS NOT NULL THEN 1 ELSE 0 END
    + CASE WHEN tool AND claimed_crawler IS NULL THEN 1 ELSE 0 END + CASE WHEN agents > 1 THEN 1 ELSE 0 END
    + CASE WHEN agents = 0 AND requests > 20 THEN 1 ELSE 0 END + CASE WHEN rate >= 2 THEN 1 ELSE 0 END
    + CASE WHEN median_gap_ms <= 250 AND gaps >= 8 THEN 1 ELSE 0 END + CASE WHEN ports = 1 AND port_seen >= 10 THEN 1 ELSE 0 END
    + CASE WHEN longest_404_run >= 20 THEN 1 ELSE 0 END + CASE WHEN old_protocol THEN 1 ELSE 0 END)::BIGINT AS tells FROM prof)"""
BEHAVIOUR = (requests(), GAPS, MEDIAN, RUN404, PROFILE)
SQL["behaviour_profiles"] = compressed("""SELECT ip, requests, gaps, median_gap_ms, longest_404_run, nullif(ports, 0) AS connections, agents,
    browser::INT AS browser, tool::INT AS tool, asset_fetches, referers, methods, claimed_crawler, ok::INT AS verified, inconsistency,
    (old IS NOT NULL)::INT AS old, tells FROM profile""", hits(), ALLHITS, OWNERS, *BEHAVIOUR)
SQL["request_gaps"] = real("SELECT ip, gap_ms, count(*) AS n FROM gaps WHERE gap_ms IS NOT NULL GROUP BY ALL", requests(), GAPS)
SQL["longest_404_runs"] = real("SELECT ip, longest_404_run FROM runs", requests(), RUN404)
SQL["client_claims"] = real(f"SELECT ua, count(*) AS requests, {BROWSER}::INT AS browser, {CANDID}::INT AS candid, {CRAWLER} AS crawler, {OLD} AS old FROM req WHERE ua <> '' GROUP BY ua", requests())

# threat view: only rows with HTTP/1.1, strangers only
VIEW = ("web AS (SELECT * FROM log WHERE raw ILIKE '%HTTP/1.1%')", hits("web"),
        f"outside AS (SELECT * FROM hits WHERE ip NOT IN {INTERNAL})", actors("outside"),
        hits("log").replace("hits AS (", "allhits AS (", 1), OWNERS, requests("web"), GAPS, MEDIAN, RUN404, PROFILE)
CLOUD = " OR ".join(f"contains(upper(org), {q(o)})" for o in V.CLOUD_ORGS)
RESEARCH = " OR ".join(f"contains(upper(org), {q(o)})" for o in V.RESEARCH_ORGS)
HAS = lambda *t: "(" + " OR ".join(f"contains(',' || names || ',', ',{x},')" for x in t) + ")"
TAGGED = f"""tagged AS (SELECT a.ip, a.hits, a.score, inconsistency, org, a.actor_id, a.first_seen, list_sort(list_filter([
    CASE WHEN len(list_filter(string_split(names, ','), lambda x: x <> 'unknown')) >= 8 THEN 'mass-scanner' END,
    CASE WHEN {HAS('rce-attempt', 'webshell-probe')} THEN 'exploit-attempt' END,
    CASE WHEN {HAS('private-key-theft', 'secret-file-harvest')} THEN 'credential-harvester' END,
    CASE WHEN {HAS('mcp-probe')} THEN 'mcp-hunter' END, CASE WHEN inconsistency >= 40 THEN 'deceptive' END,
    CASE WHEN longest_404_run >= 20 THEN 'wordlist-walker' END, CASE WHEN rate >= 5 THEN 'burst' END,
    CASE WHEN NOT ok THEN 'crawler-impostor' END, CASE WHEN {RESEARCH} THEN 'research-scanner' END,
    CASE WHEN {CLOUD} THEN 'cloud-hosted' END], lambda x: x IS NOT NULL)) AS tags
  FROM actors a LEFT JOIN owned USING (ip) LEFT JOIN profile USING (ip))"""
# the registry holds the identities of the uncompressed log, which are the same names
REG_ACTORS = (hits("log").replace("hits AS (", "rhits AS (", 1),
              "rfp AS (SELECT ip, coalesce(string_agg(DISTINCT technique, '+' ORDER BY technique) FILTER (WHERE technique NOT IN ('benign', 'unknown')), '') AS fp "
              "FROM rhits GROUP BY ip HAVING count(*) FILTER (WHERE technique <> 'benign') > 0)",
              "reg AS (SELECT CASE WHEN fp = '' THEN 'ACTOR-0000' ELSE 'ACTOR-' || upper(substr(sha256(fp), 1, 4)) END AS actor_id, "
              f"{NAME('fp')} AS codename, 'seen-' || count(*) AS seen FROM rfp GROUP BY ALL)")
SQL["threat_view_actors"] = compressed(f"""SELECT ip, hits, score, inconsistency, org, array_to_string(tags, ',') AS auto_tags,
    CASE WHEN seen IS NULL THEN '' ELSE 'watch,' || seen END AS followup_tags, CASE WHEN seen IS NULL THEN '' ELSE 'keep an eye on it' END AS notes,
    {US("CASE WHEN seen IS NULL THEN first_seen ELSE least(first_seen, TIMESTAMP '2023-12-01 00:00:00') END")} AS first_us
  FROM tagged LEFT JOIN reg USING (actor_id)""", *VIEW, TAGGED, *REG_ACTORS)
SQL["threat_view_tags"] = compressed("SELECT tag, count(*) AS actors FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY tag", *VIEW, TAGGED)
SQL["threat_view_scan_all"] = compressed("SELECT count(*) AS matched, count(*) AS returned, FALSE AS truncated, CAST(NULL AS VARCHAR) AS note FROM log WHERE raw ILIKE '%HTTP/1.1%'")
SQL["threat_view_scan"] = compressed("""SELECT m AS matched, least(m, 500) AS returned, m > 500 AS truncated, CASE WHEN m > 500 THEN
  'showing the most recent 500 of ' || m || ' requests in this window; raise ?limit= to widen it' END AS note
  FROM (SELECT count(*) AS m FROM log WHERE raw ILIKE '%HTTP/1.1%')""")

# ---- findings -----------------------------------------------------------------------------
N_OF = lambda t: f"coalesce(max(n) FILTER (WHERE technique = '{t}'), 0)"


def reasons(score: str = "score") -> str:
    once = "concat_ws(', ', " + ", ".join(f"CASE WHEN {N_OF(t)} > 0 THEN '{t}' END" for t in V.ESCALATE_ONCE) + ")"
    often = "concat_ws(', ', " + ", ".join(f"CASE WHEN {N_OF(t)} >= 3 THEN '{t} x' || {N_OF(t)} END" for t in V.ESCALATE_REPEATED) + ")"
    return f"""why AS (SELECT ip, {once} AS once, {often} AS often FROM tech GROUP BY ip),
raised AS (SELECT ip AS subject, split_part(targets, ',', 1) AS instance, CASE WHEN once <> '' THEN 'high' ELSE 'medium' END AS severity_hint, score,
    CASE WHEN once <> '' THEN 'attempted ' || once WHEN often <> '' THEN 'repeated ' || often
      WHEN score >= 40 THEN 'breadth of technique (score ' || score || ')' END AS reason FROM actors JOIN why USING (ip))"""


KEY = "substr(sha256('threat_actor|' || subject || '|' || instance), 1, 32)"
SQL["raise_reasons"] = real("SELECT subject, instance, severity_hint, reason FROM raised WHERE reason IS NOT NULL", hits(), DAY_HITS, actors("dayhits"), reasons())
EARLY = "early AS (SELECT * FROM hits WHERE timestamp < TIMESTAMP '2024-01-16')"
FIRST = f"found AS (SELECT {KEY} AS fingerprint, subject, instance, severity_hint, score, reason FROM raised WHERE reason IS NOT NULL)"
NN = "CAST(regexp_extract(subject, '[0-9]+$', 0) AS INT)"
JUDGED = f"""judged AS (SELECT *, CASE WHEN v IN {OF(V.VERDICTS)} AND NOT short THEN v END AS verdict FROM (
    SELECT *, {words(V.VERDICTS + ['maybe'])}[{NN} % 6 + 1] AS v, {NN} % 5 = 4 AS short FROM found)),
ruled AS (SELECT *, CASE WHEN verdict IS NULL THEN 'new' WHEN verdict IN {OF(V.DISMISSING_VERDICTS)} THEN 'dismissed' ELSE 'triaged' END AS state FROM judged)"""
HALF = (hits(), EARLY, actors("early"), reasons(), FIRST, JUDGED)


def _renamed(cte: str, suffix: str) -> str:
    import re
    for name in ("tech", "techs", "tacs", "base", "stat", "seen", "kept", "pths", "actors", "why", "raised"):
        cte = re.sub(rf"\b{name}\b(?= AS \(|\s+(?:GROUP|JOIN|WHERE|USING|FROM|\)))|(?<=FROM ){name}\b|(?<=JOIN ){name}\b", f"{name}{suffix}", cte)
    return cte.replace("base.ip", f"base{suffix}.ip")


ALL_RAISED = (_renamed(actors("hits"), "2"), _renamed(reasons(), "2"))
SQL["findings_upserted"] = real(f"""SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, 'threat_actor' AS kind, coalesce(a.subject, b.subject) AS subject,
    coalesce(a.instance, b.instance) AS instance, coalesce(a.severity_hint, b.severity_hint) AS severity_hint,
    CASE WHEN b.fingerprint IS NULL THEN a.state WHEN a.state = 'dismissed' THEN 'dismissed' ELSE 'new' END AS state, verdict,
    CASE WHEN verdict IS NOT NULL THEN CASE WHEN CAST(regexp_extract(a.subject, '[0-9]+$', 0) AS INT) % 3 = 0 THEN 'low' ELSE a.severity_hint END END AS severity,
    CASE WHEN verdict IS NOT NULL THEN 'seen before on this fleet' END AS rationale,
    (CASE WHEN a.fingerprint IS NULL THEN 0 ELSE 1 END + CASE WHEN b.fingerprint IS NULL THEN 0 ELSE 1 END)::BIGINT AS occurrences,
    {US("CASE WHEN a.fingerprint IS NULL THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-16' END")} AS first_us,
    {US("CASE WHEN b.fingerprint IS NULL THEN TIMESTAMP '2024-01-16' ELSE TIMESTAMP '2024-01-31' END")} AS last_us,
    {US("CASE WHEN verdict IS NOT NULL THEN TIMESTAMP '2024-01-20' END")} AS triaged_us
  FROM ruled a FULL JOIN (SELECT {KEY} AS fingerprint, * FROM raised2 WHERE reason IS NOT NULL) b USING (fingerprint)""", *HALF, *ALL_RAISED)
SQL["findings_listed"] = real("SELECT fingerprint, subject, state FROM ruled ORDER BY state = 'new' DESC, fingerprint LIMIT 15", *HALF)
SQL["findings_summed"] = real(f"""SELECT state, count(*) AS n, count(*) FILTER (WHERE state = 'new') AS awaiting,
    {US("CASE WHEN state = 'new' THEN TIMESTAMP '2024-01-16' END")} AS oldest_us FROM ruled GROUP BY state""", *HALF)
SQL["finding_evidence"] = real("SELECT subject, reason, score::VARCHAR AS score FROM found WHERE subject = '198.51.100.4' AND instance = 'host-0'", *HALF)
SQL["rejected_verdicts"] = real(f"""SELECT v AS verdict, CASE WHEN v NOT IN {OF(V.VERDICTS)} THEN 'verdict must be one of {', '.join(V.VERDICTS)}'
    ELSE 'rationale is required and must explain the judgement' END AS problem, count(*) AS n FROM judged WHERE verdict IS NULL GROUP BY ALL""", *HALF)
SQL["campaign_registry"] = real(f"""SELECT actor_id, codename, CASE WHEN again THEN '*' ELSE '' END AS emoji, '' AS fingerprint, 'HIGH' AS threat_tier,
    CASE WHEN again THEN 'block' ELSE 'watch,' || seen END AS followup_tags, 'keep an eye on it' AS notes, {US("TIMESTAMP '2023-12-01'")} AS first_us,
    {US(f"CASE WHEN again THEN {AS_OF} ELSE TIMESTAMP '2023-12-01' END")} AS last_us FROM (SELECT *, seen <> 'seen-1' AS again FROM reg)""", *REG_ACTORS)

# ---- presence --------------------------------------------------------------------------------
AUTH = f"""auth AS (SELECT id, timestamp, instance AS host, event, coalesce(f_user, f_actor) AS usr, f_src_ip FROM log
    WHERE event IN {OF(V.AUTH_EVENTS)} AND coalesce(f_user, f_actor) IS NOT NULL
      AND NOT (event IN ('auth_session_opened', 'auth_session_closed') AND coalesce(f_service, '') IN {OF(V.AUTOMATED_SERVICES)}))"""


def people(name: str, where: str) -> str:
    return f"""{name}_u AS (SELECT host, usr, arg_max(f_src_ip, (n, newest)) AS usual FROM (
    SELECT host, usr, f_src_ip, count(*) AS n, max((timestamp, id)) AS newest FROM auth WHERE event = 'auth_ssh_accepted' AND {where} GROUP BY ALL) GROUP BY ALL),
{name} AS (SELECT host, usr, CASE WHEN event = 'auth_ssh_accepted' THEN f_src_ip ELSE usual END AS src_ip,
    count(*) FILTER (WHERE event = 'auth_ssh_accepted') AS logins, count(*) FILTER (WHERE event = 'auth_session_opened') AS sessions_open,
    count(*) FILTER (WHERE event = 'auth_session_closed') AS sessions_closed, count(*) FILTER (WHERE event = 'auth_sudo_command') AS sudo,
    count(*) FILTER (WHERE event = 'auth_sudo_failed') AS sudo_failed, min(timestamp) AS first_seen, max(timestamp) AS last_seen
  FROM auth LEFT JOIN {name}_u USING (host, usr) WHERE {where} GROUP BY ALL)"""


SQL["presence"] = real(f"""SELECT host, usr AS "user", src_ip, logins, sessions_open, sessions_closed, sudo, sudo_failed,
    (sessions_open > sessions_closed OR (logins > 0 AND sessions_closed = 0))::INT AS active, {US('first_seen')} AS first_us, {US('last_seen')} AS last_us
  FROM people""", AUTH, people("people", "true"))
CUT = f"({AS_OF} - INTERVAL 6 DAY)"
UNEXPECTED = (AUTH, people("recent", f"event = 'auth_ssh_accepted' AND timestamp >= {CUT}"),
              people("past", f"event = 'auth_ssh_accepted' AND timestamp < {CUT} AND timestamp >= {AS_OF} - INTERVAL 30 DAY"),
              """novel AS (SELECT CASE WHEN NOT EXISTS (FROM past p WHERE p.host = r.host AND p.usr = r.usr) THEN 'new-host-user' ELSE 'new-source' END AS kind, *
                FROM recent r WHERE NOT EXISTS (FROM past p WHERE p.host = r.host AND p.usr = r.usr AND p.src_ip IS NOT DISTINCT FROM r.src_ip))""")
SQL["unexpected_logins"] = real(f'SELECT kind, host, usr AS "user", src_ip, logins, sudo, {US("last_seen")} AS last_us FROM novel', *UNEXPECTED)
SQL["login_findings"] = real("""SELECT 'unexpected_login' AS kind, usr || '@' || src_ip AS subject, host AS instance,
    CASE WHEN kind = 'new-host-user' THEN 'high' ELSE 'medium' END AS severity_hint, kind || ': ' || usr || ' on ' || host || ' from ' || src_ip AS reason FROM novel""", *UNEXPECTED)

# ---- anomalies and alerts ------------------------------------------------------------------------
WINDOWED = f"""counted AS (SELECT instance, event, count(*) AS total, count(*) FILTER (WHERE timestamp >= {LAST} - INTERVAL 60 SECOND) AS count_1m,
    count(DISTINCT date_trunc('minute', timestamp)) AS minutes FROM log WHERE timestamp >= {LAST} - INTERVAL 900 SECOND GROUP BY ALL),
measured AS (SELECT *, (count_1m - total / 15.0) / greatest(sqrt(total / 15.0), 1.0) AS z FROM counted)"""
SQL["rate_windows"] = compressed("SELECT instance, event, total, count_1m, minutes, round(z, 6) AS z FROM measured", WINDOWED)
SQL["rate_spikes"] = compressed("SELECT instance, event, count_1m, minutes FROM measured WHERE minutes >= 5 AND count_1m >= 5 AND z >= 1.0", WINDOWED)
SQL["rate_series"] = compressed("""SELECT instance, event, epoch_us(minute) AS minute_us, n AS count_1m, total, minutes,
    round((n - total / 15.0) / greatest(sqrt(total / 15.0), 1.0), 6) AS z FROM (SELECT *, (sum(n) OVER w)::BIGINT AS total, count(*) OVER w AS minutes
    FROM (SELECT instance, event, date_trunc('minute', timestamp) AS minute, count(*) AS n FROM log GROUP BY ALL)
    WINDOW w AS (PARTITION BY instance, event ORDER BY minute RANGE BETWEEN INTERVAL 14 MINUTE PRECEDING AND CURRENT ROW))""")
SQL["unstructured_surges"] = compressed(f"""SELECT instance, total_1m, count_1m, round(count_1m / total_1m * 100, 6) AS ratio FROM (
    SELECT instance, count(*) AS total_1m, count(*) FILTER (WHERE event = 'unstructured') AS count_1m FROM log
    WHERE timestamp >= {LAST} - INTERVAL 60 SECOND GROUP BY ALL) WHERE total_1m >= 20 AND count_1m / total_1m * 100 > 5.0 AND count_1m >= 1""")
TICKS = """cnt AS (SELECT instance, event, make_timestamp((epoch_us(timestamp) // 60000000 + 1) * 60000000) AS tick, count(*) AS n FROM log GROUP BY ALL),
rate AS (SELECT 'rate_spike' AS kind, instance, event, tick, n, buckets, (n - avg_1m) / greatest(sqrt(avg_1m), 1.0) AS measure FROM (
    SELECT *, sum(n) OVER w * (60.0 / 900) AS avg_1m, count(*) OVER w AS buckets FROM cnt
    WINDOW w AS (PARTITION BY instance, event ORDER BY tick RANGE BETWEEN INTERVAL 840 SECOND PRECEDING AND CURRENT ROW))),
surge AS (SELECT 'unstructured_surge' AS kind, instance, 'unstructured_surge' AS event, tick, coalesce(sum(n) FILTER (WHERE event = 'unstructured'), 0)::BIGINT AS n,
    sum(n) AS buckets, coalesce(sum(n) FILTER (WHERE event = 'unstructured'), 0) / sum(n) * 100 AS measure FROM cnt GROUP BY instance, tick),
turns AS (SELECT *, CASE WHEN kind = 'rate_spike' THEN CASE WHEN buckets >= 5 AND n >= 3 AND measure >= 1.0 THEN 1 WHEN buckets >= 5 AND measure < 0.0 THEN 0 END
    ELSE CASE WHEN buckets >= 20 AND measure > 7.0 AND n >= 3 THEN 1 WHEN buckets >= 20 AND measure < 5.0 THEN 0 END END AS turn
  FROM (SELECT * FROM rate UNION ALL SELECT * FROM surge)),
aged AS (SELECT * REPLACE (coalesce(turn, CASE WHEN epoch(tick) - epoch(lag(tick) OVER (PARTITION BY kind, instance, event ORDER BY tick)) > 900 THEN 0 END) AS turn) FROM turns),
states AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY kind, instance, event ORDER BY tick
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS active FROM aged)"""
SQL["anomaly_states"] = compressed("SELECT kind, instance, event, epoch_us(tick) AS tick_us, n, active::INT AS active FROM states", TICKS)


def cooldown(candidates: str, seconds: int) -> tuple[str, str]:
    """Greedy: the first of a key, then the next one at least `seconds` later."""
    return (f"cand AS ({candidates})", f"""sent AS (SELECT key, min(second) AS second FROM cand GROUP BY key
  UNION ALL SELECT s.key, (SELECT min(c.second) FROM cand c WHERE c.key = s.key AND c.second >= s.second + {seconds}) FROM sent s WHERE s.second IS NOT NULL)""")


SENT = "SELECT key, second FROM sent WHERE second IS NOT NULL"
SQL["anomaly_alerts"] = compressed(SENT, TICKS, *cooldown(
    "SELECT DISTINCT instance || ':' || event AS key, epoch(tick)::BIGINT AS second FROM states WHERE active = 1 AND tick >= TIMESTAMP '2024-01-01 00:05:00'", 300))
SQL["unit_alerts"] = "WITH RECURSIVE " + ", ".join(cooldown(
    "SELECT DISTINCT 'host-' || (user_id % 6) || '|svc-' || (user_id % 5) || '.service' AS key, floor(epoch(ts))::BIGINT AS second "
    "FROM events WHERE event_type = 'purchase' AND event_id % 3 <> 0", V.UNIT_COOLDOWN_SECONDS)) + " " + SENT
SQL["critical_lines"] = "SELECT 'host-' || (user_id % 6) AS instance, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_type = 'error' GROUP BY ALL"

# ---- graph -----------------------------------------------------------------------------------------
IDS = "('hub', 'hub:ingest', 'hub:dnsmasq', 'host-0', 'host-1', 'host-2', 'host-3', 'host-0:sshd', 'host-1:nginx', 'gw')"
NODE_OF = lambda c: (f"CASE {c} WHEN '10.0.0.250' THEN 'hub' WHEN '192.0.2.10' THEN 'hub' WHEN '10.0.0.10' THEN 'host-0' WHEN '10.0.0.11' THEN 'host-1' "
                     f"WHEN '10.0.0.12' THEN 'host-2' WHEN '10.0.0.13' THEN 'host-3' WHEN '198.51.100.3' THEN 'gw' END")
SOCK = f"""sock AS (SELECT *, lp::INT AS l, pp::INT AS p, pp::INT <= lp::INT AS outward, coalesce({NODE_OF('f_peer_ip')}, 'external:' || f_peer_ip) AS far
    FROM (SELECT *, f_local_port AS lp, f_peer_port AS pp FROM log WHERE event = 'netsnap_socket'))"""
FOLD = lambda c, host: f"CASE WHEN {c} IN {IDS} THEN {c} ELSE {host} END"
LIVE = f"""live AS (
  SELECT id, timestamp, instance AS source, 'hub:ingest' AS target, 'http' AS protocol, source AS channel, NULL::INT AS port, strlen(raw) AS bytes FROM log
  UNION ALL SELECT id, timestamp, CASE WHEN outward THEN proc ELSE far END, CASE WHEN outward THEN far ELSE proc END, 'tcp',
    'port_' || CASE WHEN outward THEN p ELSE l END, CASE WHEN outward THEN p ELSE l END, strlen(raw)
    FROM (SELECT *, {FOLD("instance || ':' || f_process", "instance")} AS proc FROM sock) WHERE f_process <> '-'
  UNION ALL SELECT id, timestamp, coalesce({NODE_OF('f_ip')}, f_ip), {FOLD("instance || ':sshd'", "instance")}, 'ssh', 'remote_access', NULL, strlen(raw) FROM log WHERE event = 'publickey_accepted'
  UNION ALL SELECT id, timestamp, coalesce({NODE_OF('f_ip')}, f_ip), 'hub:dnsmasq', 'dns', 'dns_query', NULL, strlen(raw) FROM log WHERE event = 'query_result'
  UNION ALL SELECT id, timestamp, 'hub:dnsmasq', 'external:' || f_url, 'dns', 'dns_upstream', NULL, strlen(raw) FROM log WHERE event = 'query_result')"""
PAST = f"""past AS (
  SELECT id, timestamp, CASE WHEN outward THEN proc ELSE far END AS source, CASE WHEN outward THEN far ELSE proc END AS target, 'tcp' AS protocol,
    'port_' || CASE WHEN outward THEN p ELSE l END AS channel, CASE WHEN outward THEN p ELSE l END AS port, f_process AS process, raw
    FROM (SELECT *, CASE WHEN f_process = '-' THEN instance ELSE instance || ':' || f_process END AS proc FROM sock)
  UNION ALL SELECT id, timestamp, coalesce({NODE_OF('f_ip')}, 'external:' || f_ip), instance || ':sshd', 'ssh', 'remote_access', 22, 'sshd', raw FROM log WHERE event = 'publickey_accepted'
  UNION ALL SELECT id, timestamp, coalesce({NODE_OF('f_ip')}, 'external:' || f_ip), 'hub:dnsmasq', 'dns', 'dns_query', 53, 'dnsmasq', raw FROM log WHERE event = 'query_result'
  UNION ALL SELECT id, timestamp, 'hub:dnsmasq', 'external:' || f_url, 'dns', 'dns_upstream', 53, 'dnsmasq', raw FROM log WHERE event = 'query_result'
  UNION ALL SELECT id, timestamp, instance, 'hub:ingest', 'http', source, 9514, 'alloy', raw FROM log WHERE event NOT IN ('netsnap_socket', 'publickey_accepted', 'query_result'))"""
SQL["observed_flows"] = compressed("SELECT source, target, protocol, channel, count(*) AS n, sum(bytes)::BIGINT AS bytes, max(port)::BIGINT AS port FROM live GROUP BY source, target, protocol, channel", SOCK, LIVE)
SQL["history_flows"] = compressed("SELECT source, target, protocol, channel, count(*) AS n, max(port)::BIGINT AS port, max(process) AS process FROM past GROUP BY source, target, protocol, channel", SOCK, PAST)
DECLARED = """declared(source, target, protocol, channel, expected_min_rate) AS (VALUES ('host-0', 'hub:ingest', 'http', 'telemetry_ingest', 2.0),
  ('host-1', 'hub:ingest', 'http', 'telemetry_ingest', 1.0), ('host-2', 'hub:ingest', 'http', 'telemetry_ingest', 1.0), ('host-3', 'hub:ingest', 'http', 'default', 0.0),
  ('host-1', 'gw', 'tcp', 'socket', 2.0), ('gw', 'host-0:sshd', 'tcp', 'port_22', 0.5), ('hub', 'gw', 'dns', 'dns_query', 0.0))"""


def edge_tables(plus_s: int = 0) -> tuple:
    now = f"({LAST} + INTERVAL {plus_s} SECOND)"
    return (SOCK, LIVE, DECLARED, f"""obs AS (SELECT source, target, protocol, count(*) AS total_volume, sum(bytes)::BIGINT AS total_bytes, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
    count(*) FILTER (WHERE timestamp >= {now} - INTERVAL 60 SECOND) AS rate_1m, coalesce(sum(bytes) FILTER (WHERE timestamp >= {now} - INTERVAL 60 SECOND), 0)::BIGINT AS bytes_1m,
    count(*) FILTER (WHERE timestamp >= {now} - INTERVAL 900 SECOND) AS n15, first(channel ORDER BY timestamp, id) AS first_channel,
    first(channel ORDER BY timestamp, id) FILTER (WHERE channel LIKE 'port\\_%' ESCAPE '\\') AS port_channel,
    last(port ORDER BY timestamp, id) FILTER (WHERE port > 0) AS port FROM live GROUP BY source, target, protocol)""",
    f"""edge AS (SELECT source || '->' || target || ':' || protocol AS edge_id, source, target, protocol,
    CASE WHEN d.channel LIKE 'port\\_%' ESCAPE '\\' THEN d.channel ELSE coalesce(port_channel, d.channel, first_channel) END AS channel, port AS own_port,
    d.expected_min_rate IS NOT NULL AS declared, coalesce(expected_min_rate, 0.0)::DOUBLE AS expected_min_rate, coalesce(total_volume, 0) AS total_volume,
    coalesce(total_bytes, 0) AS total_bytes, coalesce(rate_1m, 0) AS rate_1m, coalesce(bytes_1m, 0) AS bytes_1m, round(coalesce(bytes_1m, 0) / 60.0, 2) AS bytes_per_sec,
    round(coalesce(n15, 0) / 15.0, 2) AS baseline, first_seen, last_seen, coalesce(date_diff('microsecond', last_seen, {now}) / 1e6, 0) AS quiet
  FROM declared d FULL JOIN obs USING (source, target, protocol))""")


PORT = "coalesce(own_port, TRY_CAST(CASE WHEN channel LIKE 'port\\_%' ESCAPE '\\' THEN substr(channel, 6) END AS INT), 0)::BIGINT"
SQL["edges"] = compressed(f"""SELECT edge_id, channel, {PORT} AS port, declared::INT AS declared, expected_min_rate, total_volume, total_bytes, rate_1m, bytes_1m,
    round(bytes_per_sec * 100)::BIGINT AS bytes_per_sec_x100, round(baseline * 100)::BIGINT AS baseline_x100, {US('last_seen')} AS last_us FROM edge""", *edge_tables())


def shifts(min_rate, min_z, min_ratio, heavy, drop) -> str:
    return f"""judged AS (SELECT *, declared AND expected_min_rate > 0 AND total_volume > 0 AND quiet > 120 AND rate_1m = 0 AS silent,
    rate_1m >= {min_rate} AND baseline > 0 AND (rate_1m - baseline) / greatest(sqrt(baseline), 1.0) >= {min_z} AND rate_1m >= baseline * {min_ratio} AS surge,
    baseline >= {heavy} AND rate_1m < baseline * {drop} AND quiet <= 120 AND total_volume > 0 AS starved FROM edge),
shift AS (SELECT edge_id, source, target, 'SILENT_LINK' AS type, CASE WHEN expected_min_rate >= 2 THEN 'critical' ELSE 'warning' END AS severity, rate_1m FROM judged WHERE silent
  UNION ALL SELECT edge_id, source, target, 'NOVEL_EDGE', 'warning', rate_1m FROM judged WHERE NOT silent AND NOT declared
  UNION ALL SELECT edge_id, source, target, 'FLOW_SURGE', 'warning', rate_1m FROM judged WHERE NOT silent AND surge
  UNION ALL SELECT edge_id, source, target, 'STARVATION', 'notice', rate_1m FROM judged WHERE NOT silent AND NOT surge AND starved)"""


USUAL = shifts(30, 4.0, 2.5, 20, 0.2)
SQL["topology_shifts"] = compressed("SELECT edge_id, type, severity, rate_1m FROM shift", *edge_tables(), shifts(10, 0.0, 1.0, 1.0, 0.5))
SQL["silent_links"] = compressed("SELECT edge_id, type, severity, rate_1m FROM shift", *edge_tables(130), USUAL)
DECLARED_TYPE = "declnode(id, t) AS (VALUES ('hub', 'server'), ('hub:ingest', 'service'), ('hub:dnsmasq', 'service'), ('host-0', 'server'), ('host-1', 'server'), ('host-2', 'server'), ('host-3', 'workstation'), ('host-0:sshd', 'service'), ('host-1:nginx', 'service'), ('gw', 'gateway'))"
NODES = """node AS (SELECT id, coalesce(t, CASE WHEN id LIKE 'external:%' THEN 'external' WHEN dials THEN 'client' ELSE 'service' END) AS type, t IS NOT NULL AS declared
  FROM declnode FULL JOIN (SELECT id, dials FROM (SELECT source AS id, true AS dials, first_seen FROM edge UNION ALL SELECT target, false, first_seen FROM edge)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY first_seen, dials DESC) = 1) USING (id))"""
SQL["node_states"] = compressed("""SELECT id, any_value(type) AS type, any_value(node.declared)::INT AS declared,
    CASE WHEN bool_or(silent AND expected_min_rate >= 2) THEN 'DEGRADED' WHEN bool_or(surge AND NOT silent) THEN 'SURGING' ELSE 'HEALTHY' END AS status
  FROM node LEFT JOIN judged ON id = source OR id = target GROUP BY id""", *edge_tables(130), USUAL, DECLARED_TYPE, NODES)


def walk(seed: str, depth: int, table: str = "edge") -> str:
    return f"""walk AS (SELECT {seed} AS id, 0 AS hops UNION SELECT CASE WHEN e.source = w.id THEN e.target ELSE e.source END, hops + 1
  FROM walk w JOIN {table} e ON e.source = w.id OR e.target = w.id WHERE hops < {depth}), near AS (SELECT id, min(hops) AS hops FROM walk GROUP BY id)"""


SQL["subgraph"] = compressed("SELECT id, hops::BIGINT AS hops FROM near", *edge_tables(), walk("'gw'", 2))
SQL["subgraph_edges"] = compressed("SELECT edge_id, total_volume FROM edge WHERE source IN (SELECT id FROM near) AND target IN (SELECT id FROM near)", *edge_tables(),
                                   walk("(SELECT min(x) FROM (SELECT CASE WHEN source = '198.51.100.5' OR target = '198.51.100.5' THEN '198.51.100.5' ELSE 'external:198.51.100.5' END AS x FROM edge))", 1))
MATCHED = f"""matched AS (SELECT edge_id, source, target, protocol, channel, total_volume, declared FROM edge WHERE lower(protocol) = 'tcp'
    AND (contains(edge_id, '22') OR contains(channel, '22') OR {PORT} = 22) AND (contains(lower(source), 'host-1') OR contains(lower(target), 'host-1'))),
hist AS (SELECT source || '->' || target || ':' || channel AS edge_id, source, target, channel, count(*) AS n, min(protocol) AS protocol FROM past
    WHERE lower(protocol) = 'tcp' AND port = 22 AND (contains(lower(source), 'host-1') OR contains(lower(target), 'host-1')) GROUP BY ALL)"""
SQL["subgraph_search"] = compressed("""SELECT coalesce(m.edge_id, h.edge_id) AS edge_id, coalesce(m.protocol, h.protocol) AS protocol, coalesce(m.channel, h.channel) AS channel,
    (coalesce(m.total_volume, 0) + coalesce(h.n, 0))::BIGINT AS total_volume, coalesce(m.declared, false)::INT AS declared FROM matched m FULL JOIN hist h USING (edge_id)""",
    *edge_tables(), PAST, MATCHED)
SQL["subgraph_search_reach"] = compressed("""SELECT 'edge_count' AS metric, count(*) AS value FROM inside UNION ALL SELECT 'total_volume', coalesce(sum(total_volume), 0)::BIGINT FROM inside
  UNION ALL SELECT 'node_count', count(*) FROM (SELECT source FROM inside UNION SELECT target FROM inside)""", *edge_tables(),
    "hit AS (SELECT * FROM edge WHERE protocol = 'tcp' AND (contains(source, 'host-2') OR contains(target, 'host-2')))", walk("'host-2'", 2, "hit"),
    "inside AS (SELECT * FROM hit WHERE source IN (SELECT id FROM near) AND target IN (SELECT id FROM near))")
SQL["host_flows"] = compressed("""SELECT direction, count(*) AS flows, sum(rate_1m)::BIGINT AS rate, round(round(sum(bytes_per_sec), 2) * 100)::BIGINT AS bytes_x100,
    array_to_string(list_sort(list_distinct(list_filter(flatten(list(ends)), lambda x: x <> ''))), ',') AS processes FROM (
    SELECT *, CASE WHEN s AND t THEN 'internal' WHEN t THEN 'inbound' WHEN s THEN 'outbound' END AS direction,
      [CASE WHEN s AND source LIKE 'host-1:%' THEN substr(source, 8) ELSE '' END, CASE WHEN t AND target LIKE 'host-1:%' THEN substr(target, 8) ELSE '' END] AS ends
    FROM (SELECT *, source = 'host-1' OR source LIKE 'host-1:%' AS s, target = 'host-1' OR target LIKE 'host-1:%' AS t FROM edge)) WHERE direction IS NOT NULL GROUP BY direction""", *edge_tables())
SQL["time_lapse"] = compressed(f"""SELECT r.range AS slice_index, count(i) AS total_edges, count(i) FILTER (WHERE prev IS NULL OR prev <> i - 1) AS new_edges, coalesce(sum(n), 0)::BIGINT AS total_volume,
    round(round(coalesce(sum(n), 0) * 128 / 100.0, 2) * 100)::BIGINT AS bytes_x100 FROM range(9) r LEFT JOIN (SELECT *, lag(i) OVER (PARTITION BY edge_id ORDER BY i) AS prev FROM (
    SELECT source || '->' || target || ':' || channel AS edge_id, (epoch_us(timestamp) - epoch_us({LAST}) + 900000000) // 100000000 AS i, count(*) AS n
    FROM past WHERE timestamp >= {LAST} - INTERVAL 900 SECOND AND timestamp < {LAST} GROUP BY ALL)) AS c ON c.i = r.range GROUP BY r.range""", SOCK, PAST)
SQL["retired_externals"] = compressed("""SELECT id FROM node WHERE type = 'external' AND id IN (SELECT id FROM pair GROUP BY id HAVING sum(v) <= 1
    AND count(DISTINCT CASE WHEN other NOT LIKE 'external:%' THEN other END) <= 1)""", *edge_tables(), DECLARED_TYPE, NODES,
    """rare AS (SELECT source, target, CASE WHEN contains(target, 'd1') THEN 1 ELSE total_volume END AS v FROM edge)""",
    """pair AS (SELECT source AS id, target AS other, v FROM rare UNION ALL SELECT target, source, v FROM rare WHERE source <> target)""")
SQL["dangling_edges"] = compressed("SELECT edge_id, CASE WHEN source LIKE 'external:198%' OR target LIKE 'external:198%' THEN 'dropped' ELSE 'kept' END AS fate FROM edge", *edge_tables())
SQL["folded_addresses"] = compressed("""SELECT 'node ' || id AS item, (len(ips) + CASE WHEN id = 'gw' THEN (SELECT count(*) FROM stale) ELSE 0 END)::BIGINT AS n FROM (VALUES
    ('hub', ['10.0.0.250', '192.0.2.10']), ('hub:ingest', []), ('hub:dnsmasq', []), ('host-0', ['10.0.0.10']), ('host-1', ['10.0.0.11']), ('host-2', ['10.0.0.12']),
    ('host-3', ['10.0.0.13']), ('host-0:sshd', []), ('host-1:nginx', []), ('gw', ['198.51.100.3'])) t(id, ips)
  UNION ALL SELECT 'edges', count(*) FROM edge WHERE source NOT IN (FROM stale) AND target NOT IN (FROM stale)""", *edge_tables(), DECLARED_TYPE, NODES,
    "stale AS (SELECT id FROM node WHERE id LIKE 'external:198.51.100.1%')")
SQL["merged_history"] = compressed("SELECT edge_id, total_volume, 0::BIGINT AS rate_1m, round(baseline * 100)::BIGINT AS baseline_x100, declared::INT AS declared FROM edge", *edge_tables())
SQL["graph_summary"] = compressed("""SELECT 'total_nodes' AS metric, count(*)::VARCHAR AS value FROM node UNION ALL SELECT 'total_edges', count(*)::VARCHAR FROM edge
  UNION ALL SELECT 'active_shifts', count(*)::VARCHAR FROM shift UNION ALL SELECT 'fleet_status', CASE WHEN bool_or(severity = 'critical') THEN 'DEGRADED' ELSE 'HEALTHY' END FROM shift""",
    *edge_tables(130), USUAL, DECLARED_TYPE, NODES)
SQL["graph_filtered"] = compressed("SELECT 'external' AS kind, id FROM node WHERE type = 'external' UNION ALL SELECT 'edge', edge_id FROM edge WHERE declared AND source = 'host-1'",
                                   *edge_tables(), DECLARED_TYPE, NODES)

# ---- templates ---------------------------------------------------------------------------------------
COVER = lambda p: f"length(regexp_extract(raw, {q(p)}, 0)) >= 0.7 * length(trim(raw))"
MATCH = ("ruled AS (SELECT *, CASE " + " ".join(f"WHEN {COVER(p)} THEN '{e}'" for e, p in RULES) + " ELSE 'unstructured' END AS rule FROM log)")
CAP = {e: p for e, p in RULES}
G = lambda rule, i: f"regexp_extract(raw, {q(CAP[rule])}, {i})"
SQL["matched_lines"] = real(f"""SELECT rule AS event, process, usr AS "user", keys, count(*) AS n, min(ip) AS min_ip, max(ip) AS max_ip FROM (SELECT rule,
    CASE rule WHEN 'socket_line' THEN {G('socket_line', 7)} END AS process,
    CASE rule WHEN 'key_accepted' THEN {G('key_accepted', 1)} WHEN 'auth_line' THEN {G('auth_line', 1)} END AS usr,
    CASE rule WHEN 'socket_line' THEN 'ip,local_ip,local_port,peer_ip,peer_port,pid,process,proto,state' WHEN 'key_accepted' THEN 'ip,port,src_ip,user'
      WHEN 'auth_line' THEN 'host,seq,user' WHEN 'any_info' THEN 'client_ip,client_port,ip,port' ELSE '' END AS keys,
    CASE rule WHEN 'socket_line' THEN {G('socket_line', 3)} WHEN 'key_accepted' THEN {G('key_accepted', 2)}
      WHEN 'any_info' THEN split_part({G('any_info', 1)}, ':', 1) END AS ip FROM ruled) GROUP BY ALL""", MATCH)
SQL["matched_lines_many_rules"] = real("""SELECT event, count(*) AS n, sum(done)::BIGINT AS done FROM (
    SELECT CASE WHEN source <> 'uvicorn' THEN 'unstructured' WHEN status = '304' AND (octet * """ + str(len(PATHS)) + """ + p) * 3 + s >= 1000 THEN 'any_304'
      ELSE 'u' || octet || '_' || p || '_' || status END AS event, CASE WHEN source = 'uvicorn' AND NOT (status = '304' AND (octet * """ + str(len(PATHS)) + """ + p) * 3 + s >= 1000) THEN 1 ELSE 0 END AS done
    FROM (SELECT source, regexp_extract(raw, '198\\.51\\.100\\.([0-9]+)', 1) AS o, regexp_extract(raw, '"GET (.*) HTTP/', 1) AS path, regexp_extract(raw, '" ([0-9]+) Done', 1) AS status FROM log) AS l
    LEFT JOIN paths USING (path) LEFT JOIN statuses USING (status), LATERAL (SELECT try_cast(o AS INT) AS octet)) GROUP BY event""",
    "paths(p, path) AS (VALUES " + ", ".join(f"({i}, {q(p)})" for i, p in enumerate(PATHS)) + ")", "statuses(s, status) AS (VALUES (0, '404'), (1, '304'), (2, '200'))")
RULE_TABLE = "rules(priority, event, pattern) AS (VALUES " + ", ".join(f"({i}, {q(e)}, {q(p)})" for i, (e, p) in enumerate(RULES)) + ")"
SQL["template_usage"] = real("SELECT r.event, count(l.rule) AS hits FROM rules r LEFT JOIN ruled l ON l.rule = r.event GROUP BY r.event", MATCH, RULE_TABLE)
LEARNED = f"""learned AS (SELECT min(event_id) AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'auth_line' ELSE 'new_line' END AS event,
    CASE WHEN event_type = 'signup' THEN {q(RULES[1][1])} ELSE event_type || ' (?P<n>\\d+)' END AS pattern FROM events GROUP BY event_type),
fresh AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY seq) AS i FROM learned WHERE pattern NOT IN (SELECT pattern FROM rules))"""
SQL["added_rules"] = "WITH " + RULE_TABLE + ", " + LEARNED + """ SELECT event, pattern, 'base' AS origin FROM rules UNION ALL
  SELECT CASE WHEN event = 'auth_line' THEN 'auth_line_' || (i + 1) WHEN i = 1 THEN event ELSE event || '_' || i END, pattern, 'runtime' FROM fresh"""
SQL["loaded_rules"] = "WITH " + RULE_TABLE + ", " + LEARNED + """ SELECT event, 'base' AS origin, (priority + 1000000000)::BIGINT AS priority FROM rules
  UNION ALL SELECT event || '-' || seq, 'runtime', seq FROM fresh"""
SQL["merged_rules"] = "WITH " + RULE_TABLE + ", " + LEARNED + """ SELECT event, pattern, 0 AS merged FROM rules
  UNION ALL SELECT event, pattern, 1 FROM fresh WHERE event NOT IN (SELECT event FROM rules) AND i = 1"""
# The masks without lookaround; the derived lines hold nothing the hex mask would take.
MASKS = [(p, m.replace("$1", "\\1")) for p, m in V.SKELETON_MASKS if "<HEX>" not in m]


def skeleton_sql(column: str) -> str:
    out = column
    for p, m in MASKS:
        if p.endswith(r"(?=\s|$)"):
            p, m = p.replace(r"(?=\s|$)", r"(\s|$)"), m + "\\3"
        out = f"regexp_replace({out}, {q(p)}, {q(m)}, 'g')"
    return out


SQL["skeletons"] = real(f"SELECT {skeleton_sql('raw')} AS skeleton, count(*) AS n FROM log GROUP BY ALL")
SQL["clusters"] = real("""SELECT skeleton, count(*) AS n, count(*) // 3 AS emitted, string_agg(raw, '|' ORDER BY i) FILTER (WHERE i <= 3) AS samples
  FROM (SELECT *, row_number() OVER (PARTITION BY skeleton ORDER BY timestamp, id) AS i FROM masked) GROUP BY skeleton HAVING count(*) >= 3""",
  f"masked AS (SELECT *, {skeleton_sql('raw')} AS skeleton FROM log)")

# ---- fields and documents --------------------------------------------------------------------------
EV = "e AS (SELECT *, regexp_extract(props, '[0-9]+', 0) AS k, user_id::VARCHAR AS n FROM events)"
SHAPES = [("'10.0.0.' || n", "CASE WHEN user_id < 256 THEN 'ip' END"), ("'10.1.0.' || n || ':' || k", "CASE WHEN user_id < 256 THEN 'ip_port' END"),
          ("'/var/log/' || n", "'path'"), ("k || 'ms'", "'duration'"), ("k || ' KB'", "'bytes'"), ("'web' || n || '.example.com'", "'host'"),
          ("'http://x/' || k", "'url'"), ("k", "'num'"), ("k || '.5'", "'num'"), ("'web-' || n", "'host_or_word'"),
          ("'00:11:22:33:44:' || lpad(substr(k, 1, 2), 2, '0')", "'mac'"), ("'dead' || lpad(k, 4, '0')", "'hex'"),
          ("'two words ' || k", "NULL"), ("''", "NULL"), ("'fe80::' || k", "'ipv6'")]
SQL["value_shapes"] = "WITH " + EV + " SELECT v, count(*) AS n, any_value(shape) AS shape FROM (" + " UNION ALL ".join(
    f"SELECT {v} AS v, {s} AS shape FROM e" for v, s in SHAPES) + ") GROUP BY v"
# An octet above 255 is no address: the field then keeps its key, and the first address is a later one.
SQL["normalized_fields"] = "WITH " + EV + """ SELECT event_id, unnest(CASE WHEN user_id < 256 THEN ['remote_ip', 'src_ip', 'src_port', 'host', 'duration', 'pid', 'ip', 'port']
      ELSE ['remote_addr', 'src', 'host', 'duration', 'pid', 'remote_ip', 'ip'] END) AS key,
    unnest(CASE WHEN user_id < 256 THEN ['10.9.9.' || k, '10.1.0.' || n, k, 'web-' || n, k || 'ms', k, '10.0.0.' || n, k]
      ELSE ['10.0.0.' || n, '10.1.0.' || n || ':' || k, 'web-' || n, k || 'ms', k, '10.9.9.' || k, '10.9.9.' || k] END) AS value FROM e"""
SQL["text_lines"] = """SELECT 'http' AS protocol, 'documents' AS source, count(*) AS n, sum(length(l))::BIGINT AS chars FROM (
  SELECT trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS l FROM documents) WHERE l <> ''"""
SQL["json_lines"] = "WITH " + EV + """ SELECT raw, protocol, instance, count(*) AS n FROM (
    SELECT 'a' || n AS raw, 'http' AS protocol, NULL AS instance FROM e WHERE event_id % 4 = 0 UNION ALL SELECT 'b' || n, 'http', NULL FROM e WHERE event_id % 4 = 0
    UNION ALL SELECT 'l' || n, 'x', 'i' || n FROM e WHERE event_id % 4 = 1 UNION ALL SELECT 'one' || n, 'http', NULL FROM e WHERE event_id % 4 = 2) GROUP BY ALL"""
SQL["stream_entries"] = "SELECT 'j' || (user_id % 3) AS job, epoch_us(ts) * 1000 AS ts_ns, 'line ' || user_id AS line, epoch_us(ts) AS at_us FROM events"
SQL["stream_regrouped"] = """SELECT '{"job":"j' || (user_id % 3) || '","unit":"u","via":"tail"}' AS key, epoch_us(date_trunc('hour', ts)) AS block_us, count(*) AS n,
    min(epoch_us(ts)) * 1000 AS first_ns, arg_min('line ' || user_id, (ts, 'line ' || user_id)) AS first_line FROM events GROUP BY key, block_us"""
SQL["stream_chunks"] = """SELECT key, chunk, count(*) AS n, min(ns) AS first_ns, max(ns) AS last_ns FROM (
    SELECT *, (row_number() OVER (PARTITION BY key ORDER BY ns, line) - 1) // 100 AS chunk FROM (
      SELECT '{"job":"j' || (user_id % 3) || '","unit":"u"}' AS key, epoch_us(ts) * 1000 AS ns, 'line ' || user_id AS line FROM events)) GROUP BY ALL"""
SQL["stream_labels"] = "SELECT 'b' || (user_id % 4) AS job, 'i' || user_id AS instance, 2::BIGINT AS size, count(*) AS n FROM events GROUP BY ALL"
SQL["socket_snapshot"] = "WITH " + EV + """ SELECT 'tcp' AS proto, 'established' AS state, '10.0.0.1' AS local, peer, peer_port, process, pid, count(*) AS n, min(lp) AS min_local_port FROM (
    SELECT CASE WHEN user_id % 10 = 2 THEN '2001:db8::' || n ELSE '198.51.100.' || n END AS peer, CASE WHEN user_id % 10 = 2 THEN '443' ELSE k END AS peer_port,
      CASE WHEN event_id % 3 = 0 THEN 'nginx' ELSE '-' END AS process, CASE WHEN event_id % 3 = 0 THEN k ELSE '-' END AS pid, (user_id + 1000)::VARCHAR AS lp
    FROM e WHERE user_id % 10 NOT IN (0, 1)) GROUP BY ALL"""
SQL["logfmt_fields"] = real("""SELECT split_part(w, '=', 1) AS key, split_part(w, '=', 2) AS value, count(*) AS n FROM (
    SELECT unnest(string_split(raw, ' ')) AS w FROM log WHERE event = 'netsnap_socket') WHERE contains(w, '=') GROUP BY ALL""")
SQL["timestamps"] = f"""SELECT event_id, p AS parsed_us, CASE WHEN NOT bad THEN p END AS kept_us, CASE WHEN bad THEN p END AS suspect_us,
    epoch_us(date_trunc('second', ts)) - CASE WHEN event_id % 2 = 0 THEN 5400000000 ELSE 0 END AS clf_us FROM (
  SELECT *, p > epoch_us({AS_OF}) + 300000000 OR p < 946684800000000 AS bad FROM (SELECT event_id, ts, CASE event_id % 6 WHEN 0 THEN epoch_us(ts)
    WHEN 1 THEN epoch_us(ts) // 1000 * 1000 WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 3 THEN NULL WHEN 4 THEN 4102444800000000 ELSE 3600000000 END AS p FROM events))"""
SQL["structured_requests"] = real("SELECT id, f_ip AS ip, f_path AS path, f_status AS status, f_ua AS ua, 'structured' AS source FROM log WHERE f_status IS NOT NULL")
SQL["address_parts"] = """SELECT CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || user_id ELSE '2001:db8::' || user_id END AS host, CASE WHEN event_id % 2 = 0 THEN '80' ELSE '22' END AS port,
    CASE WHEN event_id % 5 = 0 THEN 8080 WHEN event_id % 3 = 0 THEN 443 ELSE 9100 END::BIGINT AS edge_port, count(*) AS n FROM events GROUP BY ALL"""
SQL["finding_keys"] = real("SELECT DISTINCT ip, target, substr(sha256('threat_actor|' || ip || '|' || CASE WHEN target = 'host-0' THEN '' ELSE target END), 1, 32) AS finding_key FROM hits", hits())
STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"
ECS = "ecs AS (SELECT *, event_id % 10 NOT IN (7, 9) AS usable, event_id % 2 = 0 AS nested, event_id % 5 = 0 AND event_id % 2 = 1 AS future FROM e)"
SQL["ecs_rows"] = "WITH " + EV + ", " + ECS + """ SELECT event, instance, ip, http_status, action, pid, tags, suspect, count(*) AS n, min(raw) AS raw, max(atime) AS last_us FROM (
    SELECT CASE WHEN nested THEN 'web.access' ELSE 'unstructured' END AS event, CASE WHEN nested THEN 'host-' || n ELSE 'h' || n END AS instance,
      CASE WHEN nested THEN '198.51.100.' || n END AS ip, CASE WHEN nested THEN '404' END AS http_status, CASE WHEN nested THEN event_type END AS action,
      CASE WHEN NOT nested THEN k END AS pid, CASE WHEN nested THEN '["a","' || k || '"]' END AS tags, future::INT AS suspect,
      CASE WHEN nested THEN '198.51.100.' || n || ' - - [-] "GET /p/' || k || ' HTTP/1.1" 404 0 "-" "-"' ELSE 'line ' || k END AS raw,
      CASE WHEN NOT future THEN epoch_us(ts) END AS atime FROM ecs WHERE usable) GROUP BY ALL"""
SQL["ecs_accounting"] = "WITH " + EV + ", " + ECS + """ SELECT count(*) FILTER (WHERE usable) AS total, count(*) FILTER (WHERE usable) AS structured,
    count(*) FILTER (WHERE NOT usable) AS rejected, count(*) FILTER (WHERE usable AND future) AS ts_clamped FROM ecs"""
SQL["ecs_value_search"] = "WITH " + EV + ", " + ECS + """ SELECT v AS value, count(*) FILTER (WHERE usable AND CASE v WHEN '17' THEN nested AND k = '17'
    WHEN 'click' THEN nested AND event_type = 'click' ELSE nested END) AS matched FROM ecs, (VALUES ('17'), ('click'), ('404')) t(v) GROUP BY v"""
SQL["flattened_documents"] = "WITH " + EV + ", " + ECS + f""" SELECT key, count(*) AS n, count(DISTINCT value) AS values FROM (
    SELECT unnest(['@timestamp', 'host.name', 'event.dataset', 'event.action', 'source.ip', 'source.port', 'url.path', 'http.request.method', 'http.response.status_code', 'tags']) AS key,
      unnest([{STAMP}, 'host-' || n, 'web.access', event_type, '198.51.100.' || n, (user_id + 40000)::VARCHAR, '/p/' || k, 'GET', '404', k]) AS value FROM ecs WHERE nested
    UNION ALL SELECT unnest(['@timestamp', 'host.hostname', 'message', 'process.pid']), unnest([CASE WHEN future THEN '4102444800000' ELSE {STAMP} END, 'h' || n, 'line ' || k, k]) FROM ecs WHERE usable AND NOT nested
    UNION ALL SELECT 'only', k FROM ecs WHERE event_id % 10 = 9) GROUP BY key"""

# ---- storage -----------------------------------------------------------------------------------------
STORED = """kept AS (SELECT *, id % 50 = 0 AS noise, CASE WHEN id % 40 = 1 THEN TIMESTAMP '2024-01-31' ELSE timestamp END AS atime FROM ruled)"""
SQL["ingest_accounting"] = real("""SELECT count(*) FILTER (WHERE NOT noise) AS total, count(*) FILTER (WHERE NOT noise AND rule <> 'unstructured') AS matched,
    count(*) FILTER (WHERE NOT noise AND rule = 'unstructured') AS unstructured, count(*) FILTER (WHERE noise) AS filtered, count(*) FILTER (WHERE id % 40 = 1) AS ts_clamped,
    round(count(*) FILTER (WHERE NOT noise AND rule <> 'unstructured') / count(*) FILTER (WHERE NOT noise) * 100, 4) AS hit_rate FROM kept""", MATCH, STORED)
SQL["stored_days"] = real("SELECT strftime(atime, '%Y-%m-%d') AS day, source, count(*) AS n FROM kept WHERE NOT noise GROUP BY ALL", MATCH, STORED)
CUT14 = "(TIMESTAMP '2024-01-31 06:00:00' - INTERVAL 14 DAY)"
SQL["retention"] = f"SELECT count(*) FILTER (WHERE ts >= {CUT14}) AS kept, epoch_us(min(ts) FILTER (WHERE ts >= {CUT14})) AS oldest_us, count(*) FILTER (WHERE ts < {CUT14}) AS deleted FROM events"
SQL["retention_days"] = f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 10 DAY) AS kept, count(*) FILTER (WHERE ts < {AS_OF} - INTERVAL 10 DAY) AS deleted FROM events GROUP BY ALL"
SQL["topology_aliases"] = real(f"""SELECT ip, node, count(*) AS n FROM (SELECT f_peer_ip AS ip, coalesce({NODE_OF('f_peer_ip')}, f_peer_ip) AS node FROM log WHERE f_peer_ip IS NOT NULL
  UNION ALL SELECT instance || ':22', CASE WHEN instance = 'host-0' THEN 'host-0:sshd' WHEN instance IN {IDS} THEN instance ELSE instance || ':22' END FROM log) GROUP BY ALL""")

# ---- sweep and metrics --------------------------------------------------------------------------------
LAST_LOGINS = (AUTH, people("recent", f"event = 'auth_ssh_accepted' AND timestamp >= {LAST} - INTERVAL 300 SECOND"),
               people("past", f"event = 'auth_ssh_accepted' AND timestamp < {LAST} - INTERVAL 300 SECOND"), UNEXPECTED[3])
HOUR = tuple(c.replace("raw ILIKE '%HTTP/1.1%')", f"raw ILIKE '%HTTP/1.1%' AND timestamp >= {LAST} - INTERVAL 600 SECOND)") for c in VIEW)
SQL["sweep"] = compressed("""SELECT 'threat_actor' AS kind, subject, instance, severity_hint, 'new' AS state, 1::BIGINT AS occurrences
    FROM raised LEFT JOIN profile ON ip = subject WHERE reason IS NOT NULL OR inconsistency >= 40
  UNION ALL SELECT 'unexpected_login', usr || '@' || src_ip, host, CASE WHEN kind = 'new-host-user' THEN 'high' ELSE 'medium' END, 'new', 1 FROM novel""",
    *HOUR, reasons(), *LAST_LOGINS)
SQL["fleet_metrics"] = compressed("""SELECT 'ingest_total' AS metric, 1::BIGINT AS series, count(*) FILTER (WHERE NOT noise) AS total FROM kept
  UNION ALL SELECT 'hotpath_matches_total', 1, count(*) FILTER (WHERE NOT noise AND rule <> 'unstructured') FROM kept
  UNION ALL SELECT 'coldpath_buffered_total', 1, count(*) FILTER (WHERE NOT noise AND rule = 'unstructured') FROM kept
  UNION ALL SELECT 'templates_active', 1, 5 UNION ALL SELECT 'events_by_instance', count(DISTINCT instance), sum(total)::BIGINT FROM counted
  UNION ALL SELECT 'anomaly_active', count(*), count(*) FROM measured WHERE minutes >= 5 AND count_1m >= 5 AND z >= 1.0 HAVING count(*) > 0
  UNION ALL SELECT 'graph_nodes_total', 1, count(*) FROM node UNION ALL SELECT 'graph_edges_total', 1, count(*) FROM edge
  UNION ALL SELECT 'graph_shifts_active', 1, count(*) FROM shift UNION ALL SELECT 'graph_edge_rate_1m', count(*), sum(rate_1m)::BIGINT FROM edge
  UNION ALL SELECT 'graph_edge_bytes_per_sec', count(*), round(sum(bytes_per_sec))::BIGINT FROM edge""",
    LOG.replace("log AS (", "rlog AS (", 1), MATCH.replace("FROM log)", "FROM rlog)"), STORED, WINDOWED, *edge_tables(), USUAL, DECLARED_TYPE, NODES)

# ---- orders and single rows ----------------------------------------------------------------------------
SQL["actors_ordered"] = real("SELECT ip, score, hostile_hits FROM actors ORDER BY score DESC, hostile_hits DESC, newest DESC, ip LIMIT 9", hits(), actors())
SQL["unexpected_ordered"] = real("""SELECT kind, host, usr AS "user", src_ip FROM novel ORDER BY kind <> 'new-host-user', last_seen DESC, host, usr, src_ip LIMIT 12""", *UNEXPECTED)
SQL["counts_by_window"] = real(f"""SELECT spec, count(*) AS matched FROM log JOIN (VALUES ('7d', 604800), ('36h', 129600), ('90000', 90000), ('later', NULL)) w(spec, s)
    ON raw ILIKE '%HTTP/1.1%' AND (s IS NULL OR timestamp >= {AS_OF} - to_seconds(s)) GROUP BY spec""")
SQL["one_finding"] = real("SELECT fingerprint, subject, instance, reason, score FROM found ORDER BY fingerprint LIMIT 1", *HALF[:5])
