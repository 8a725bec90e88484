from pyspark.sql import functions as F

from fleetsift.functions import techniques as TQ
from fleetsift.operators import findings as N, threats as T

EXPECTED = {
    "secret-file-harvest": ["/.env", "/.env.production", "/api/.env", "/env", "/env.txt", "/config.env", "/secrets.env",
                            "/config/database.yml", "/appsettings.json", "/wp-config.php.bak", "/.aws/credentials",
                            "/config/app.php", "/storage/logs/laravel.log", "/error_log", "/web.config", "/kubernetes.yml",
                            "/google-services.json", "/config/aws.json", "/aws-exports.js", "/app.log", "/var/log/syslog",
                            "/config/mail.php", "/twilio.env", "/aws.yml"],
    "private-key-theft": ["/.ssh/id_rsa", "/.ssh/authorized_keys", "/server.key", "/service-account.json", "/config/master.key",
                          "/terraform.tfstate", "/gcp-key.json", "/sa.json", "/keyfile.json", "/terraform.tfvars.json"],
    "ssrf-metadata": ["/fetch?url=http%3A%2F%2F169.254.169.254/latest/meta-data/", "/proxy?url=http://169.254.169.254/",
                      "/x?target=http://metadata.google.internal/computeMetadata/v1/", "/fetch?url=http://x"],
    "rce-attempt": ["/?x=php://input", "/vendor/phpunit/phpunit/src/Util/PHP/eval-stdin.php"],
    "proxy-probe": ["/fetch", "/proxy", "/proxy?x=1"],
    "benign": ["/app-ads.txt", "/ads.txt", "/static/app.js", "/health"],
    "ci-config-exposure": ["/cloudbuild.yaml", "/azure-pipelines.yml", "/values.yaml"],
    "info-disclosure": ["/_debugbar/open", "/horizon/dashboard", "/log-viewer", "/nginx_status", "/phpinfo.php"],
    "mcp-probe": ["/mcp", "/mcp-sse", "/sse", "/mcp/", "/.well-known/mcp"],
    "vcs-exposure": ["/.git/config"], "path-traversal": ["/?file=../../../../etc/passwd"],
    "webshell-probe": ["/i.php", "/8.php", "/2P.php", "/bnbfggf.php", "//0.php", "/fffm.php?p=1"],
    "cms-probe": ["/wp-login.php"], "admin-discovery": ["///admin"], "recon": ["/", "/robots.txt"],
    "appliance-probe": ["/SDK/webLanguage", "/ISAPI/Security/users"], "api-discovery": ["/api/v1/users"],
}
NOT = {"/error": "secret-file-harvest", "/query": "mcp-probe", "/data/products.json": "private-key-theft"}


def access(ip, path, inst="web", i=0):
    return (i, "2026-09-15 00:00:00", "x", {"instance": inst}, {},
            f'INFO:     {ip}:5000 - "GET {path} HTTP/1.1" 404 Not Found')


def events(spark, rows):
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    return (spark.createDataFrame(rows, "id long, timestamp string, event string, labels map<string,string>, "
                                        "kv map<string,string>, raw string")
            .withColumn("timestamp", F.col("timestamp").cast("timestamp")))


SEVEN = [access("198.51.100.1", "/.env"), access("198.51.100.1", "/.git/config"), access("198.51.100.2", "/.env"),
         access("198.51.100.2", "/.git/config"), access("198.51.100.3", "/wp-login.php"), access("203.0.113.5", "/"),
         access("203.0.113.5", "/user/me")]


def test_paths(spark):
    cases = [(p, t) for t, ps in EXPECTED.items() for p in ps]
    got = {r.p: r.t for r in spark.createDataFrame(cases, "p string, e string")
           .select("p", TQ.technique_of(F.col("p")).alias("t")).collect()}
    assert {p: got[p] for p, _ in cases} == dict(cases)
    bad = {r.p: r.t for r in spark.createDataFrame([(p,) for p in NOT], "p string")
           .select("p", TQ.technique_of(F.col("p")).alias("t")).collect()}
    assert all(bad[p] != t for p, t in NOT.items())


def test_actors_and_campaign(spark):
    hits = T.access_hits(events(spark, SEVEN), benign="^/user/")
    actors = T.threat_actors(hits)
    rows = {r.ip: r for r in actors.collect()}
    assert len(rows) == 4
    assert rows["203.0.113.5"].benign_hits == 1 and rows["203.0.113.5"].hostile_hits == 1
    camps = [c for c in T.campaigns(actors).collect() if c.actor_count > 1]
    assert len(camps) == 1 and set(camps[0].actors) == {"198.51.100.1", "198.51.100.2"}
    assert camps[0].fingerprint == "secret-file-harvest+vcs-exposure" and camps[0].actor_id.startswith("ACTOR-")
    assert not any(c.fingerprint == "recon" for c in T.campaigns(actors).collect())


def test_internal_addresses_are_reported(spark):
    hits = T.access_hits(events(spark, SEVEN))
    inside = spark.createDataFrame([("198.51.100.1",), ("198.51.100.2",), ("198.51.100.3",)], "ip string")
    strangers, excluded = T.split_internal(hits, inside)
    assert {r.ip for r in strangers.select("ip").collect()} == {"203.0.113.5"}
    assert excluded.count() == 3


def test_raw_line_beats_fields(spark):
    row = list(access("198.51.100.9", "/.env"))
    row[4] = {"path": "/Sep/2026", "ip": "1.1.1.1"}
    hit = T.access_hits(events(spark, [tuple(row)])).first()
    assert (hit.ip, hit.path) == ("198.51.100.9", "/.env")


def test_breadth_beats_volume(spark):
    many = [access("198.51.100.1", "/wp-login.php") for _ in range(200)]
    broad = [access("198.51.100.2", p) for p in ("/.env", "/.git/config", "/shell.php", "/site.zip")]
    wide = [access("198.51.100.3", "/.env", inst=h) for h in ("a", "b", "c")]
    score = {r.ip: r.score for r in T.threat_actors(T.access_hits(events(spark, many + broad + wide))).collect()}
    assert score["198.51.100.2"] > score["198.51.100.1"]
    assert score["198.51.100.3"] == 15 + 20


def test_paths_are_capped_newest_first(spark):
    rows = [(i, f"2026-09-15 00:{i:02d}:00", *access("198.51.100.1", f"/x{i:02d}.zip")[2:]) for i in range(50)]
    actor = T.threat_actors(T.access_hits(events(spark, rows))).first()
    assert actor.distinct_paths == 40 and actor.sample_paths[0] == "/x10.zip" and actor.hits == 50


def tags(spark, **a):
    base = dict(techniques={}, hits=5, org=None, tells=None, inconsistency=None, longest_404_run=None, peak_rate_per_s=None)
    df = spark.createDataFrame([tuple({**base, **a}.values())], "techniques map<string,long>, hits long, org string, "
                               "tells array<string>, inconsistency long, longest_404_run long, peak_rate_per_s double")
    return df.select(T.auto_tags().alias("t")).first().t


def test_auto_tags(spark):
    eight = {f"t{i}": 1 for i in range(8)}
    assert "mass-scanner" in tags(spark, techniques=eight)
    assert "mass-scanner" not in tags(spark, techniques={**{f"t{i}": 1 for i in range(7)}, "unknown": 1})
    assert tags(spark, techniques={"rce-attempt": 1}) == ["exploit-attempt"]
    assert tags(spark, techniques={"recon": 1}, inconsistency=40, longest_404_run=20, peak_rate_per_s=5.0) == [
        "burst", "deceptive", "wordlist-walker"]
    assert tags(spark, techniques={"recon": 1}, inconsistency=39, longest_404_run=19, peak_rate_per_s=4.9) == []
    assert tags(spark, techniques={"recon": 1}, tells=["claims googlebot but ..."]) == ["crawler-impostor"]
    assert tags(spark, techniques={"recon": 1}, org="Censys, Inc.") == ["research-scanner"]
    assert tags(spark, techniques={"recon": 1}, hits=1) == ["single-touch"]
    assert tags(spark, techniques={"cms-probe": 1}, hits=1) == []


def reason(spark, techniques, score=0, inconsistency=0):
    df = spark.createDataFrame([(techniques, score, inconsistency)], "techniques map<string,long>, score long, inconsistency long")
    return df.select(T.raise_reason().alias("r")).first().r


def test_escalation(spark):
    assert reason(spark, {"rce-attempt": 1}) == "attempted rce-attempt"
    assert reason(spark, {"webshell-probe": 2}) is None
    assert reason(spark, {"webshell-probe": 3}) == "repeated webshell-probe x3"
    assert reason(spark, {"recon": 1}, inconsistency=40).startswith("claimed to be something")
    assert reason(spark, {"recon": 1}, score=40) == "breadth of technique (score 40)"
    assert reason(spark, {"recon": 1}, score=39, inconsistency=39) is None


def test_verdicts_stick(spark):
    found = spark.createDataFrame([("threat_actor", "1.1.1.1", "a", "high", "{}"), ("threat_actor", "2.2.2.2", "a", "high", "{}")],
                                  "kind string, subject string, instance string, severity_hint string, evidence string")
    table = N.upsert_findings(N.empty_findings(spark), found, "2026-01-01")
    keys = {r.subject: r.fingerprint for r in table.collect()}
    verdicts = spark.createDataFrame([(keys["1.1.1.1"], "noise", "background of the internet", "sam", None, None),
                                      (keys["2.2.2.2"], "real", "an actual break-in", "sam", "critical", "block"),
                                      (keys["2.2.2.2"], "real", "short", "sam", None, None)],
                                     "fingerprint string, verdict string, rationale string, reviewer string, severity string, recommended_action string")
    judged = N.apply_verdicts(table, verdicts, "2026-01-02")
    again = {r.subject: r for r in N.upsert_findings(judged, found, "2026-01-03").collect()}
    assert (again["1.1.1.1"].state, again["1.1.1.1"].occurrences, again["1.1.1.1"].severity) == ("dismissed", 2, "high")
    assert (again["2.2.2.2"].state, again["2.2.2.2"].verdict, again["2.2.2.2"].severity) == ("new", "real", "critical")
    assert N.split_verdicts(verdicts)[1].count() == 1
