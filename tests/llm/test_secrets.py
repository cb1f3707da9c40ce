import hashlib
import re

from bazaarlens.llm.secrets import op5_secret_scan, secret_scan

BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def brute(text):
    got = [(m.start(), k, n, m.end()) for k, (n, p, good) in enumerate(BASE) for m in re.finditer(p, text or "") if good(m)]
    return [(n, s, e) for s, k, n, e in sorted(got)]


def spans(rows):
    return {r.doc_id: [(x["name"], x["start"], x["end"]) for x in r.secrets if x["kind"] <= 2] for r in rows}


def test_base_spans(docs):
    texts = ["", None, "é token = 'abcdef' PassWord:abc secret=token:abcdefgh api_key=\"A.b-c/d=e\"", "AKIA" + "A" * 16 + " AKIAB", "0" * 24 + " " + "f" * 23, "\U0001f600 apikey : 0123456789abcdef01234567" * 3, "x" * 30_000]
    got = spans(secret_scan(docs(texts)).collect())
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_ownership_separates_copied_from_live(docs):
    mine, theirs = "token=Zx81kQ0pLm34", "token=exampleexample9"
    rows = secret_scan(docs([theirs, theirs, theirs, theirs, mine])).collect()
    assert [[x["verdict"] for x in r.secrets] for r in sorted(rows)] == [["copied"]] * 4 + [["live"]]


def test_live_extra_kinds_only(docs):
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    rows = sorted(secret_scan(docs([jwt, "a", "b", "c"])).collect())
    assert [x["name"] for x in rows[0].secrets] == ["jwt"]
    rows = sorted(secret_scan(docs([jwt] * 4)).collect())
    assert [len(r.secrets) for r in rows] == [0] * 4


def test_query(spark, sample):
    got = {r.doc_id: r for r in op5_secret_scan(spark, "/root/testdata/sf0.001").collect()}
    for r in sample.collect():
        want = brute(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{n}:{s}:{e}" for n, s, e in want).encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k, _, _ in BASE] == [sum(n == k for n, _, _ in want) for k, _, _ in BASE]
    assert len(got) == sample.count()


def test_no_rows_and_repeats(docs):
    assert secret_scan(docs([])).count() == 0
    assert len(secret_scan(docs(["token=abcdef"] * 2, [1, 1])).collect()) == 2
