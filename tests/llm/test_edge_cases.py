"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from fleetsift.llm.components import components
from fleetsift.llm.fingerprints import fingerprint_documents
from fleetsift.llm.licenses import scan_licenses
from fleetsift.llm.nbest import decode_ids, encode_n_best
from fleetsift.llm.ngram_join import Settings, allowances, similarity_components
from fleetsift.llm.packing import pack_documents, sequences, pack, token_pieces
from fleetsift.llm.quality_classifier import keep_good, score_quality, train_quality
from fleetsift.llm.quality_rules import judge_quality
from fleetsift.llm.registered import PATTERN_RULES, SITE_RULES, tokenizer_file
from fleetsift.llm.secrets import redact_secrets, scan_secrets
from fleetsift.llm.shingles import shingle_set
from fleetsift.llm.toxicity import keep_clean, score_toxicity, train_toxicity
from fleetsift.llm.url_filters import Rule, filter_urls, rule_tokens

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, rule string, units int, i int, t int, "
          "bucket int, cls int, sequence_id int, offset string, spans int, `key` int, kind int, `_row` int")
LONG = "many words follow each other here " * 20_000
TEXTS = [(1, "one two three four five six"), (2, None), (3, ""), (4, "  \n\t "), (5, "one two three four five six"),
         (5, "one two three four five six"), (None, "one two three four five six"), (7, "solo"), (8, LONG), (None, None),
         (9, "Released under the MIT License."), (10, "token = 'abcdef123456' \U0001f642 é")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, None) + (None,) * 13 for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


def same_ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr) == sorted((i for i, _ in TEXTS), key=repr)


def test_row_operators_keep_every_row(docs, labels):
    model = train_toxicity(docs, labels)
    quality = train_quality(docs, labels)
    for df in (fingerprint_documents(docs), scan_licenses(docs), judge_quality(docs), scan_secrets(docs), redact_secrets(docs),
               score_toxicity(docs, model), score_quality(docs, quality), similarity_components(docs)):
        assert same_ids(df)
    assert redact_secrets(docs).columns == docs.columns == keep_clean(docs, model).columns == keep_good(docs, quality).columns


def test_results_on_odd_rows(docs):
    fingerprints = fingerprint_documents(docs).collect()
    same = {r["fingerprint"] for r in fingerprints if r["doc_id"] in (1, 5)}
    blank = {r["fingerprint"] for r in fingerprints if r["doc_id"] in (2, 3, 4)}
    assert len(same) == 1 and len(blank) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in fingerprints)
    joined = by_id(similarity_components(docs), "n_shingles", "component_id")
    assert joined.count((5, 3, 1)) == 2 and (None, 3, 1) in joined and (None, 0, None) in joined and (2, 0, 2) in joined and (7, 1, 7) in joined
    assert [(i, f[0]["license"]) for i, f in by_id(scan_licenses(docs), "found") if f] == [(9, "MIT")]
    assert {i: k for i, k in by_id(judge_quality(docs), "kept")}[8] is False
    assert {i: s for i, s in by_id(scan_secrets(docs), "spans")}[10].startswith("assign:0:")


def test_packing_of_odd_rows(docs):
    rows = pack_documents(docs, tokenizer_file("byte_bpe_50k.json")).collect()
    lengths = {}
    for r in rows:
        lengths.setdefault(r["doc_id"], []).append(r["length"])
    assert lengths[2] == [1] and len(lengths[5]) == 2 and len(lengths[None]) == 2 and len(lengths[8]) > 100
    pieces = token_pieces(docs, tokenizer_file("byte_bpe_50k.json"), with_ids=True)
    whole = sequences(pack(pieces)).agg(F.sum(F.size("ids"))).first()[0]
    assert whole == sum(r["length"] for r in rows)


def test_round_trip_of_odd_rows(docs):
    model = tokenizer_file("piece_bpe_32k.model")
    encoded = encode_n_best(docs, model, n=3)
    assert all(r["decodes"] for r in encoded.select("decodes").collect())
    texts = {(r["doc_id"], r["text"]) for r in decode_ids(encoded, model).select("doc_id", "text").collect()}
    assert texts == {(i, t or "") for i, t in TEXTS}


def test_empty_tables(docs, labels):
    none, no_labels = docs.limit(0), labels.limit(0)
    model, quality = train_toxicity(none, no_labels), train_quality(none, no_labels)
    for df in (fingerprint_documents(none), scan_licenses(none), judge_quality(none), scan_secrets(none), redact_secrets(none),
               score_toxicity(none, model), score_quality(none, quality), similarity_components(none),
               pack_documents(none, tokenizer_file("byte_bpe_50k.json")), encode_n_best(none, tokenizer_file("piece_bpe_32k.model")),
               filter_urls(none.withColumnRenamed("text", "url"), SITE_RULES)):
        assert df.collect() == []
    assert same_ids(score_toxicity(docs, train_toxicity(docs, no_labels))) and same_ids(score_quality(docs, train_quality(docs, no_labels)))


def test_urls(spark):
    urls = ["https://Sub.Example.ORG/en/1x?q", "http://example.org", "http://notexample.org/es/", "x.org/", None, "", "://a.com/fr/", "http://org/",
            "http://a.com/de/x", "http://www.adult-x.example.net/en/", "http://a.net/search?a=1&q=2", "http://a.net/search?q", "https://a.com/FR/", "data:text"]
    pages = spark.createDataFrame([(k, u, "old", None) for k, u in enumerate(urls + urls[:1])], "page_id long, url string, rule string, verdict int")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["pattern_rule"]) for r in filter_urls(pages, SITE_RULES + PATTERN_RULES).collect()}
    none = (None, "allow", None)
    assert got[0] == got[14] == ("example.org/en/1", "block", None) and got[1] == none and got[2] == ("org/", "allow", None)
    assert got[3] == got[4] == got[5] == got[11] == got[12] == none and got[6] == ("com/fr/", "allow", None) and got[7] == ("org/", "allow", None)
    assert got[8][1] == "block" and got[9] == (None, "block", "||adult-") and got[10] == (None, "block", "/search?*q=") and got[13] == (None, "block", "|data:")
    assert rule_tokens(Rule("*.exe*", "block")) == [""] and rule_tokens(Rule("||a-b.*c/d^", "block")) == ["a", "b", "d"]


def test_join_by_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    base = [[rng.choice(words) for _ in range(n)] for n in (6, 9, 14, 30, 80, 300) for _ in range(3)]
    texts = []
    for b in base:
        for _ in range(9):
            t = list(b)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    for s in (Settings(words=3, percent=70), Settings(words=2, percent=85), Settings(words=4, percent=85, small_group=2), Settings(words=5, percent=80)):
        sets = [set(shingle_set(t, s.words).tolist()) for _, t in rows]
        parent = list(range(len(rows)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= s.percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
        got = similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), s)
        assert by_id(got, "component_id") == sorted(((k, find(k)) for k in range(len(rows))), key=repr)


def test_shingles_against_sets_of_words():
    texts = ["A b  c\td e", "a B c d e", "a b c", "", "é Ä é", "a b c d a b c d a b c d", "x\x0by\x0cz\rw", "a\xa0b c d e"]
    for n in (1, 2, 4):
        for t in texts:
            w = __import__("re").findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
            want = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
            assert len(shingle_set(t, n)) == len(want)
    assert (shingle_set(texts[0], 4) == shingle_set(texts[1], 4)).all()


def test_allowances_reach_the_need():
    import numpy as np
    rng = np.random.default_rng(1)
    for need in (8, 20, 60):
        cost = rng.integers(1, 1000, need + 3).astype(float)
        v = allowances(cost, cost * rng.choice([0.2, 5.0], need + 3), need, 1)
        assert v.sum() >= need and set(v.tolist()) <= {0, 1, 2} and (v == 2).any()


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 140)) and got[301] == got[300] == 300
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sketches_bound_the_difference():
    import numpy as np
    from fleetsift.llm.ngram_join import least_difference, sketch
    rng = np.random.default_rng(2)
    for n, m, same in ((1, 1, 0), (5, 9, 4), (100, 90, 80), (700, 300, 250), (64, 64, 64), (1000, 1030, 1000)):
        pool = rng.permutation(np.unique(rng.integers(0, (1 << 64) - 1, n + m + same, dtype=np.uint64)))
        both = pool[:same]
        a, b = (np.sort(np.concatenate([both, own])) for own in (pool[same:same + n - same], pool[n + same:n + same + m - same]))
        bound = least_difference(sketch(a), sketch(b))
        assert bound <= len(np.setxor1d(a, b)) and bound == least_difference(sketch(b), sketch(a))
        assert len(a) < 90 or bound >= 0.6 * min(len(np.setxor1d(a, b)), len(sketch(a)) // 2, len(sketch(b)) // 2)


def test_segmentations_of_words_met_before_and_after_the_store_turns():
    import numpy as np
    import public_tokenizers
    from fleetsift.llm.nbest import Lattice, _runs
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["the cat sat on the mat", "", " two  blanks ", "naïve 漢字 ▁ x", "unbelievably antidisestablishmentarianism", "the mat"]
    fresh, small = Lattice(model), Lattice(model, keep=3)
    want = fresh.encode(texts, 4)
    assert [small.encode([t], 4)[0] for t in texts + texts] == want + want and small.elder
    for t, found in zip(texts, want):
        ids = [np.frombuffer(data, "<u4") for _, data in found]
        edges = np.cumsum([0] + [len(i) for i in ids])
        assert fresh.decoded(np.concatenate(ids), edges) == [t.encode()] * len(found) == [fresh.decode(i.tolist()).encode() for i in ids]
    assert fresh.begins.mean() < 0.05 and [*_runs([])] == [] and [*_runs(["a" * 6_000_001, "b", "c"])] == [(0, 1), (1, 3)]
