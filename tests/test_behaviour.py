import random

from pyspark.sql import functions as F

from fleetsift.functions import clients as C
from fleetsift.operators import behaviour as B, runs
from tests.test_techniques import events

CHROME = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 Chrome/126.0.0.0 Safari/537.36"
GOOGLE = "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)"


def uvicorn(ip, port, path, status, second):
    return (0, f"2026-09-15 06:00:{second:02d}", "x", {}, {}, f'INFO:     {ip}:{port} - "GET {path} HTTP/1.1" {status} Not Found')


def nginx(ip, path, status, ua, second, ref="-", row_second=0):
    return (0, f"2026-09-15 07:00:{row_second:02d}", "x", {}, {},
            f'{ip} - - [15/Sep/2026:06:00:{second:02d} +0000] "GET {path} HTTP/1.1" {status} 134 "{ref}" "{ua}"')


def profiles(spark, rows, rdns=None):
    names = spark.createDataFrame(list(rdns.items()), "ip string, rdns string") if rdns else None
    return {r.ip: r for r in B.behaviour_profiles(B.client_requests(events(spark, rows)), names).collect()}


def test_wordlist_on_one_connection(spark):
    p = profiles(spark, [uvicorn("10.1.1.1", 5000, f"/p{i}", 404, i) for i in range(25)])["10.1.1.1"]
    assert (p.requests, p.longest_404_run, p.connections, p.median_gap_ms) == (25, 25, 1, 1000)
    assert any("ONE connection (port 5000)" in t and t.startswith("all 25") for t in p.tells)
    assert any("25 consecutive 404s" in t for t in p.tells) and any("no User-Agent" in t for t in p.tells)
    assert p.inconsistency == 0


def test_browser_that_renders_nothing(spark):
    p = profiles(spark, [nginx("10.1.1.2", "/", 200, CHROME, i) for i in range(6)])["10.1.1.2"]
    assert p.claims_browser and not p.self_identified_tool and p.inconsistency == 60
    q = profiles(spark, [nginx("10.1.1.3", "/", 200, CHROME, 0, "https://a/"), nginx("10.1.1.3", "/a.css", 200, CHROME, 30, "https://a/")])
    assert q["10.1.1.3"].inconsistency == 0 and q["10.1.1.3"].tells == []


def test_backfill_uses_the_lines_clock(spark):
    p = profiles(spark, [nginx("10.1.1.4", "/x", 404, CHROME, i * 5, row_second=0) for i in range(10)])["10.1.1.4"]
    assert p.median_gap_ms == 5000 and p.peak_rate_per_s < 1


def test_crawler_claims_are_checked(spark):
    rows = [nginx(ip, "/", 200, GOOGLE, 0) for ip in ("10.2.0.1", "10.2.0.2", "10.2.0.3")]
    p = profiles(spark, rows, {"10.2.0.1": "crawl-1.googlebot.com", "10.2.0.2": "evil.example.com"})
    assert (p["10.2.0.1"].crawler_verified, p["10.2.0.1"].inconsistency) == (True, 0)
    assert (p["10.2.0.2"].crawler_verified, p["10.2.0.2"].inconsistency) == (False, 60)
    assert (p["10.2.0.3"].crawler_verified, p["10.2.0.3"].inconsistency) == (False, 60)


def test_fossil_agents(spark):
    cases = [("Mozilla/5.0 Firefox/60.0", True), ("Mozilla/5.0 Firefox/130.0", False), ("Mozilla/5.0 Chrome/99.0 Safari/537", True),
             ("Mozilla/4.0 (compatible; MSIE 6.0; Windows NT 5.1)", True), (CHROME, False), ("curl/8", False)]
    got = spark.createDataFrame(cases, "ua string, old boolean").select("old", C.ua_anachronism(F.col("ua")).isNotNull().alias("got")).collect()
    assert all(r.old == r.got for r in got)


def test_structured_and_raw_agree(spark):
    raw = [uvicorn("10.3.0.1", 6000, f"/p{i}", 404, i) for i in range(12)]
    fields = [(0, r[1], "x", {}, {"ip": "10.3.0.2", "path": f"/p{i}", "status": "404", "method": "GET", "proto": "1.1", "sport": "6000"}, "web")
              for i, r in enumerate(raw)]
    p = profiles(spark, raw + fields)
    keep = lambda r: {k: v for k, v in r.asDict().items() if k != "ip"}
    assert keep(p["10.3.0.1"]) == keep(p["10.3.0.2"])
    assert profiles(spark, [(0, "2026-01-01 00:00:00", "x", {}, {"ip": "10.3.0.9", "path": "/x"}, "no status")]) == {}


def test_longest_run_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abc") if rng.random() < 0.5 else "hot", rng.randrange(50), i, rng.random() < 0.8) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, s long, id long, flag boolean").withColumn("at", F.timestamp_seconds("s"))
    want = {}
    for key in {r[0] for r in rows}:
        best = run = 0
        for _, _, _, flag in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            run = run + 1 if flag else 0
            best = max(best, run)
        want[key] = best
    assert {r.key: r.longest_run for r in runs.longest_run(df).collect()} == want


def test_upper_median_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "b"]), rng.randrange(5_000_000_000)) for i in range(500)]
    rows += [(1000 + i, "b", 77) for i in range(9)]
    req = spark.createDataFrame(rows, "id long, ip string, us long").withColumn("at", F.timestamp_micros("us"))
    got = {r.ip: r.median_gap_ms for r in B.upper_median_gap(B.request_gaps(req)).collect()}
    for ip in "ab":
        times = sorted(r[2] for r in rows if r[1] == ip)
        gaps = sorted((b - a + 500) // 1000 for a, b in zip(times, times[1:]))
        assert got[ip] == gaps[len(gaps) // 2]
