"""Secrets without a space before them, and parts longer than any bound."""

import random
import string

from fleetsift.llm import secrets as S

ID = "AKIA" + "ABCDEFGH23456789"
KEY = "wJ4lrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEK3y0"


def token(n, seed=5):
    return "aA1" + "".join(random.Random(seed).choices(string.ascii_letters + string.digits, k=n - 3))


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: S._as_spans(r["spans"]) for r in S.scan_secrets(docs).collect()}
    masked = {r["doc_id"]: r["text"] for r in S.redact_secrets(docs).collect()}
    return [{k: texts[i][a:b] for k, a, b in found[i]} for i in range(len(texts))], [masked[i] for i in range(len(texts))]


def test_values_right_after_an_equals_sign(spark):
    got, masked = spans(spark, [f"AWS_ACCESS_KEY_ID={ID}\nAWS_SECRET_ACCESS_KEY={KEY}\n", f"{ID} ACCOUNT_KEY={KEY}==",
                                f"https://store.example.net/a?sig={KEY}", f"AWS_SECRET_ACCESS_KEY={KEY}"])
    assert [g.get("linked_secret") for g in got] == [KEY, KEY + "==", KEY, None]
    assert not any(KEY in m for m in masked[:3]) and KEY in masked[3]


def test_long_parts_are_whole(spark):
    session, account, path = token(300), "u" * 70 + "@example.net", "p/" * 300
    run = token(2000) + "abcdefghijklm" + token(2000, 6)
    address = f"https://store.example.net/{path}end"
    got, masked = spans(spark, [f"{ID} {session} x", f"{address} password={KEY}", f"user={account} password={KEY}", f"{ID} {run}", f"{ID} {'Word9' + 'lowercaseword' * 30}"])
    assert got[0]["linked_secret"] == session and got[1]["linked_endpoint"] == address
    assert got[2]["linked_access"] == f"user={account}" and got[3]["linked_secret"] == run and "linked_secret" not in got[4]
    assert masked[0] == "[secret] [secret] x" and masked[1] == masked[2] == "[secret] [secret]"
