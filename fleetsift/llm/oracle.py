"""DuckDB SQL for the queries of this folder that SQL can express, written from their contracts."""

from __future__ import annotations

from .common import LOWER, UPPER
from .licenses import NOTICES, normal_bigrams

quoted = lambda s: "'" + s.replace("'", "''") + "'"

#: Pattern rules as expressions on the address with A-Z lower-cased: (rule, verdict, expression).
_HOST = r"^[a-z0-9+.-]*://([^/?#]*\.)?"
_PATTERNS = [("||casino-", "block", _HOST + "casino-"), ("||free-bets.", "block", _HOST + r"free-bets\."), ("||cheap-pills.", "block", _HOST + r"cheap-pills\."),
             ("||ads-track.", "block", _HOST + r"ads-track\."), ("||spam-farm.", "block", _HOST + r"spam-farm\."), ("||adult-", "block", _HOST + "adult-"),
             ("||spam-farm.example.com/en/about^", "allow", _HOST + r"spam-farm\.example\.com/en/about([^a-z0-9_.%-]|\z)"),
             ("/wp-login.php", "block", r"/wp-login\.php"), ("/cgi-bin/", "block", "/cgi-bin/"), ("?sessionid=", "block", r"\?sessionid="),
             ("|data:", "block", "^data:"), (".exe|", "block", r"\.exe\z"), ("/search?*q=", "block", r"/search\?[\s\S]*q=")]

URL_FILTERS = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low FROM pages),
r AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
site(rule, domain, start, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
pattern(rule, verdict, expression) AS (VALUES {", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(c)})" for a, b, c in _PATTERNS)}),
s AS (SELECT page_id, rule, verdict FROM h JOIN site ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1),
p AS (SELECT page_id, rule, verdict FROM h JOIN pattern ON regexp_matches(low, expression)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY verdict, length(rule) DESC, rule DESC) = 1)
SELECT h.page_id, host, path, s.rule, coalesce(s.verdict, p.verdict, 'allow') AS verdict,
       CASE WHEN s.rule IS NULL THEN p.rule END AS pattern_rule
FROM h LEFT JOIN s ON s.page_id = h.page_id LEFT JOIN p ON p.page_id = h.page_id
"""


def jaccard_components(words: int, percent: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: {gram})) END AS grams FROM split),
sizes AS (SELECT doc_id, len(grams) AS n FROM sets),
each AS (SELECT doc_id, hash(g) AS h, g FROM (SELECT doc_id, unnest(grams) AS g FROM sets)),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM each a JOIN each b ON a.h = b.h AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= {percent} * (a.n + b.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(node, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT node, y FROM reached JOIN ways ON other = x)
SELECT s.doc_id, s.n AS n_shingles, c.component_id
FROM sizes s JOIN (SELECT node, min(other) AS component_id FROM reached GROUP BY node) c ON c.node = s.doc_id
"""


def license_scans(threshold: float = 0.8) -> str:
    known = ", ".join(f"({k}, {quoted(name)}, [{', '.join(map(quoted, normal_bigrams(body)))}])" for k, (name, body) in enumerate(NOTICES))
    least = f"(SELECT min(len(grams)) FROM known) * {threshold / (2 - threshold)!r}"
    most = f"(SELECT max(len(grams)) FROM known) * {(2 - threshold) / threshold!r}"
    return f"""
WITH known(k, license, grams) AS (VALUES {known}),
cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines,
               list_filter(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\n\\x0b\\f\\r]*\\n'), lambda b: contains(trim(b, chr(10)), chr(10))) AS blocks FROM documents),
numbered AS (SELECT doc_id, unnest(list_concat(lines, blocks)) AS unit_text, generate_subscripts(list_concat(lines, blocks), 1) - 1 AS unit FROM cut),
worded AS (SELECT doc_id, unit, regexp_extract_all(lower(unit_text), '[a-z0-9ß-öø-ÿ]+') AS w FROM numbered),
units AS (SELECT doc_id, unit, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS grams
          FROM worded WHERE len(w) > 0),
sized AS (SELECT doc_id, unit, grams, len(grams) AS n FROM units WHERE len(grams) >= {least} AND len(grams) <= {most}),
scored AS (SELECT doc_id, unit, k, license, len(list_intersect(s.grams, t.grams)) AS shared, n, len(t.grams) AS size FROM sized s JOIN known t
           ON n >= len(t.grams) * {threshold / (2 - threshold)!r} AND n <= len(t.grams) * {(2 - threshold) / threshold!r}),
found AS (SELECT *, unit || ':' || license || ':' || shared || ':' || n || ':' || size AS line FROM scored WHERE 2 * shared >= {threshold!r} * (n + size)),
listed AS (SELECT doc_id, count(*) AS n_found, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses,
                  string_agg(line, ',' ORDER BY unit, k) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(u.n, 0) AS n_units, coalesce(s.n, 0) AS n_sized, coalesce(n_found, 0) AS n_found,
       coalesce(licenses, '') AS licenses, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM units GROUP BY doc_id) u ON u.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM sized GROUP BY doc_id) s ON s.doc_id = d.doc_id
LEFT JOIN listed ON listed.doc_id = d.doc_id
"""


def decontamination(width: int = 10, reach: int = 20) -> str:
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
b AS (SELECT row_number() OVER () AS k, item_id, {split} AS w FROM benchmark),
held AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < {width} THEN [w] ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: w[i:i + {width - 1}]) END) AS g
         FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT len(g) AS n FROM held),
grams AS (SELECT r, p, n, w[p:p + n - 1] AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT r, p, n, item_id FROM grams JOIN held USING (g)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM found WHERE item_id IS NOT NULL) GROUP BY r),
tokens AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
counts AS (SELECT t, count(*) AS c FROM tokens GROUP BY t),
windows AS (SELECT g, list_distinct(g) AS words, row_number() OVER () AS i FROM (SELECT DISTINCT g FROM held)),
terms AS (SELECT i, t, c FROM (SELECT i, unnest(words) AS t FROM windows) LEFT JOIN counts USING (t)),
rarest AS (SELECT i, arg_min(t, struct_pack(c := c, t := t)) AS t FROM terms GROUP BY i HAVING bool_and(c IS NOT NULL)),
near AS (SELECT r, count(DISTINCT p) AS n_near FROM rarest JOIN tokens USING (t) JOIN windows USING (i) JOIN d USING (r)
         WHERE list_has_all(w[greatest(1, p - {reach}):p + {reach}], words) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)
"""


def collocations(least: int = 30, cover: int = 80, top: int = 2000) -> str:
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, m, w[p:p + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, g, count(*) AS c FROM grams GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE m > 1 AND c >= {least}),
cuts AS (SELECT lang, m, g, c, unnest(range(1, m)) AS k FROM candidates),
scored AS (SELECT x.lang, x.m, x.g, x.c, k, a.c AS l, b.c AS r, CAST((2000000::HUGEINT * x.c) // (a.c + b.c) AS BIGINT) AS score
           FROM cuts x JOIN f a ON a.lang = x.lang AND a.g = x.g[1:k] JOIN f b ON b.lang = x.lang AND b.g = x.g[k + 1:x.m]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, g[s:s + z - 1] AS g, max(c) AS around FROM (SELECT lang, g, c, z, unnest(range(1, m - z + 2)) AS s
           FROM (SELECT lang, m, g, c, unnest(range(2, m)) AS z FROM candidates WHERE m > 2)) GROUP BY ALL),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, c AS a, l, r, score FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g
         WHERE around IS NULL OR 100::HUGEINT * around < {cover}::HUGEINT * c)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN sizes USING (lang)
QUALIFY rank <= {top}
"""


SQL = {"op1_url_filters": URL_FILTERS, "op3_ngram_jaccard_join": jaccard_components(4, 85), "op5_license_scans": license_scans(),
       "op11_phrase_collocations": collocations(), "op13_benchmark_decontamination": decontamination()}
