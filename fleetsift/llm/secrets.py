"""Secret scans: patterns for parts of credentials, and links between weak parts that belong together.

Three base kinds are reported wherever they stand: assignments to a secret's name, access identifiers
and long hexadecimal strings. Weak candidates are long opaque strings, account names in an assignment
and addresses of services: each is common in harmless text. One is reported only if complementary parts
stand near it: an opaque string needs an identifier or an endpoint, an identifier or endpoint needs a
secret. Near means that the spans, widened by `reach`, overlap: an interval join within a text, made an
equi-join by the windows of that width that a span touches. A window holds few parts, as each takes six
code points or more, so no pair of parts is formed beyond a text's neighbourhoods.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from fleetsift.session import cut_lineage

from .common import map_batches

#: The base kinds, in the order spans are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "linked_access", "linked_endpoint", "linked_secret"]

WEAK_ACCESS = re.compile(r"""(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.A | re.I)
WEAK_ENDPOINT = re.compile(r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ssh)://[^\s"'<>]{4,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""", re.A | re.I)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")

#: What each role of a part makes reportable.
COMPLEMENTS = [("access", "linked_secret"), ("endpoint", "linked_secret"), ("secret", "linked_access"), ("secret", "linked_endpoint")]
_ROLE = {"assign": "secret", "access": "access", "hex": "secret", "linked_access": "access",
         "linked_endpoint": "endpoint", "linked_secret": "secret"}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches, leftmost and non-overlapping within a kind; end exclusive, in code points."""
    return ([("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
            + [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
            + [("hex", m.start(), m.end()) for m in HEX.finditer(text)])


def _opaque(s: str) -> bool:
    """Letters of both cases and digits, no run of one class over ten: random rather than written.

    Beyond 128 characters chance makes such runs, so there they may take up to a tenth of the string.
    """
    if not (re.search("[a-z]", s) and re.search("[A-Z]", s) and re.search("[0-9]", s)):
        return False
    return 10 * sum(map(len, re.findall("[a-z]{11,}|[A-Z]{11,}", s))) <= (len(s) if len(s) > 128 else 0)


def weak_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak candidates that no base match overlaps."""
    found = ([("linked_access", m.start(), m.end()) for m in WEAK_ACCESS.finditer(text)]
             + [("linked_endpoint", m.start(), m.end()) for m in WEAK_ENDPOINT.finditer(text)]
             + [("linked_secret", m.start(), m.end()) for m in WEAK_SECRET.finditer(text) if _opaque(m[0])])
    return [(k, a, b) for k, a, b in found if not any(a < d and c < b for _, c, d in base)]


def listed(spans: Iterable[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then by kind as listed in KINDS, then end."""
    ordered = sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def _as_spans(text: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in text.split(",") if x)]


def _parse(make_rows, names):
    def make():
        def work(batch: dict) -> dict:
            rows = [make_rows(*values) for values in zip(*batch.values())]
            return {name: [r[k] for r in rows] for k, name in enumerate(names)}
        return work
    return make


def _parts(listings: DataFrame) -> DataFrame:
    """(key, kind, start, end) from (key, spans), each text once."""
    at = F.split("span", ":")
    return (listings.distinct().select("key", F.explode(F.split("spans", ",")).alias("span"))
            .select("key", at[0].alias("kind"), at[1].cast("long").alias("start"), at[2].cast("long").alias("end")))


def linked_parts(parts: DataFrame, reach: int = 400) -> DataFrame:
    """(key, kind, start, end) of the weak parts that a complementary part of the same key comes near.

    parts: (key, kind, start, end) with base and weak kinds. Repeated parts count once. A null key
    links nothing. Empty parts give none.
    """
    role = F.element_at(F.create_map(*[F.lit(x) for pair in _ROLE.items() for x in pair]), F.col("kind"))
    spans = (parts.select("key", "kind", "start", "end").distinct().withColumn("role", role)
             .withColumn("window", F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach)))))
    needs = spans.sparkSession.createDataFrame(COMPLEMENTS, "role string, kind string")
    helpers = spans.select("key", "window", "role", F.col("start").alias("s"), F.col("end").alias("e")).join(needs, "role").drop("role")
    weak = spans.where(F.col("kind").startswith("linked_")).select("key", "window", "kind", "start", "end")
    near = (F.col("s") < F.col("end") + reach) & (F.col("start") < F.col("e") + reach)
    return weak.join(helpers, ["key", "window", "kind"]).where(near).select("key", "kind", "start", "end").distinct()


def scan_secrets(docs: DataFrame, reach: int = 400, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, n_linked, spans), one row for each row.

    spans lists base and linked spans. base_sha256 digests the base spans alone. A null text counts as
    empty: no spans. Repeated rows each get their row; equal texts are linked once. A null id stays
    null; other columns are not read; an empty table gives an empty table. Texts are scanned whole.
    """
    def rows(i, body):
        body = body or ""
        base = base_spans(body)
        weak = weak_spans(body, base)
        count = lambda kind: sum(k == kind for k, _, _ in base)
        mark = hashlib.md5(body.encode("utf-8", "surrogatepass")).hexdigest() if weak and len(base) + len(weak) > 1 else None
        at = listed(base)
        return i, count("assign"), count("access"), count("hex"), hashlib.sha256(at.encode()).hexdigest(), at, listed(weak), mark

    kind = dict(docs.select(id).dtypes)[id]
    scanned = cut_lineage(map_batches(
        docs.select(docs[id].alias("i"), docs[text].alias("t")),
        _parse(rows, ["i", "n_assign", "n_access", "n_hex", "base_sha256", "base", "weak", "key"]),
        f"i {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, base string, weak string, key string"))
    parts = _parts(scanned.where("key IS NOT NULL").select("key", F.concat_ws(",", F.nullif("base", F.lit("")), "weak").alias("spans")))
    linked = (linked_parts(parts, reach).groupBy("key")
              .agg(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "start", "end"))).alias("linked")))

    def merged(i, a, c, h, digest, base, extra):
        return i, a, c, h, digest, len(extra or []), listed(_as_spans(base) + _as_spans(",".join(extra or [])))

    joined = scanned.join(linked, "key", "left").select("i", "n_assign", "n_access", "n_hex", "base_sha256", "base", "linked")
    return map_batches(joined, _parse(merged, ["i", "n_assign", "n_access", "n_hex", "base_sha256", "n_linked", "spans"]),
                       f"i {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, n_linked long, spans string"
                       ).withColumnRenamed("i", id)


def redact_secrets(docs: DataFrame, reach: int = 400, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every reported span of the text replaced by the mask; spans that overlap share one.

    Other columns, repeated rows and the order of columns stay; null texts stay null.
    """
    def rows(body):
        base = base_spans(body) if body else []
        weak = weak_spans(body, base) if body else []
        found = weak and len(base) + len(weak) > 1
        return (hashlib.md5(body.encode("utf-8", "surrogatepass")).hexdigest(), listed(base + weak)) if found else (None, None)

    weak = map_batches(docs.select(docs[text].alias("t")), _parse(rows, ["key", "spans"]), "key string, spans string").where("key IS NOT NULL")
    linked = cut_lineage(linked_parts(_parts(weak), reach).groupBy("key").agg(F.collect_list(F.concat_ws(":", "kind", "start", "end")).alias("_linked")))
    names = docs.columns
    keyed = docs.withColumn("_key", F.md5(docs[text].cast("binary"))).join(linked.withColumnRenamed("key", "_key"), "_key", "left")
    staged = keyed.select(*names, F.concat_ws(",", "_linked").alias("_linked"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def make():
        def work(batch: dict) -> dict:
            out = []
            for body, extra in zip(batch[text], batch.pop("_linked")):
                if body:
                    kept, at = [], 0
                    for _, a, b in sorted(base_spans(body) + _as_spans(extra), key=lambda s: s[1:]):
                        if a >= at:
                            kept += [body[at:a], mask]
                        at = max(at, b)
                    body = "".join(kept) + body[at:] if kept else body
                out.append(body)
            return batch | {text: out}
        return work

    return map_batches(staged, make, schema)
