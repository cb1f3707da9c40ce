import hashlib
import random
import re

from pyspark.sql import functions as F

from bazaarlens.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
)


def brute(text):
    return [(n, m.start(), m.end()) for n, p, good in BASE for m in re.finditer(p, text or "") if good(m)]


def base(rows):
    return {r.doc_id: [(x["name"], x["start"], x["end"]) for x in r.spans if x["base"]] for r in rows}


def fuzz(n):
    rng = random.Random(9)
    parts = ["a@b.c", "@", ".", "..", "-", " ", "  ", "+1", "(017)", "555-7713", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "256.1.1.1", "00001.2.3.255", "x", "é", "_%", "a.b-c@d-e.f.g.", "12", "\n", "0", "@x.y", "\U0001f600", "0000000000000"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_base_spans(docs):
    texts = ["", None, "a@b.c_x@d.e a@b..c a@b.c. q@w", "1" * 3000 + ".1.1.1", "+1 (017) 555-7713", "4" * 13 + "0" * 7, "a." * 20_000 + "@" + "b." * 20_000 + "c", "1 " * 30_000, *fuzz(400)]
    assert base(pii.pii_spans(docs(texts)).collect()) == {i: brute(t) for i, t in enumerate(texts)}


def test_query(spark, sample):
    got = {r.doc_id: r for r in pii.op2_pii(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == sample.count()
    for r in sample.collect():
        want = brute(r.text)
        row = got[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{n}:{s}:{e}" for n, s, e in want).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(n == k for n, _, _ in want) for k, _, _ in BASE]


def test_trees_learn_an_interaction():
    rows = [((a, b, c), int(a > 1 and b > 0), 10.0) for a in range(4) for b in range(2) for c in range(3)]
    model = pii.boost(rows)
    for x, y, _ in rows:
        assert (model[0] + sum(pii.walk(t, x) for t in model[1]) > 0) == bool(y)
    cut = pii.thresholds(model, [((0, 0, 0), 0, 9.0), ((1, 1, 0), 1, 9.0)], 0.9)
    assert cut[0] == float("inf") and cut[1] < float("inf")


def test_scores_as_columns(spark):
    rows = [((a, b), int(a > b), 3.0) for a in range(3) for b in range(3)]
    model = pii.boost(rows)
    got = spark.createDataFrame([x for x, _, _ in rows], "f0 int, f1 int").withColumn("s", pii.scored(model)).collect()
    for r in got:
        assert abs(r.s - model[0] - sum(pii.walk(t, (r.f0, r.f1)) for t in model[1])) < 1e-9


def test_redaction(docs):
    texts = docs(["mail a.b@c.de or +1 (017) 555-7713!", "nothing"])
    got = {r.doc_id: r.text for r in pii.redacted(texts, pii.pii_spans(texts)).collect()}
    assert got == {0: "mail <email> or <phone>!", 1: "nothing"}


def test_no_rows_and_repeats(docs):
    assert pii.pii_spans(docs([])).count() == 0
    assert pii.pii_spans(docs(["a@b.c", "a@b.c", None], [1, 1, None])).select(F.size("spans").alias("n")).groupBy().sum("n").first()[0] == 2


def test_further_kinds_are_reported(docs):
    """Planted spelt-out addresses, local numbers and id numbers, none of them on a base span; order numbers and impossible ids stay."""
    n = 120
    planted = [f"we sat, jo{k} (at) ex{k} (dot) com, and then 555-123-{4000 + k} there, {123 + k}-45-{6000 + k} too" for k in range(n)]
    others = [f"order 555-123-{5000 + k} and what of 000-45-{6000 + k} there" for k in range(n)]
    texts = docs(planted + others + ["jo7 at ex7 dot org", "see jo8@ex8.org or 755-222-3434", "jo8 at ex8 dot org", "they meet at noon dot then"])
    spans = pii.pii_spans(texts)
    got = {r.doc_id: [x["name"] for x in r.spans] for r in spans.collect()}
    for k in range(n):
        assert got[k] == ["email_spelt", "phone_local", "id_number"], k
        assert got[n + k] == [], k
    clean = {r.doc_id: r.text for r in pii.redacted(texts, spans).collect()}
    assert clean[3] == "we sat, <email_spelt>, and then <phone_local> there, <id_number> too"
    assert clean[n] == texts.collect()[n].text


def test_further_kinds_in_a_small_corpus(docs):
    texts = docs(["write to jo (at) ex (dot) com, 123-45-6789, call 555-123-4567", "mail jo@ex.com", "jo at ex dot com", "order 555-123-4568"])
    got = {r.doc_id: r.text for r in pii.redacted(texts, pii.pii_spans(texts)).collect()}
    assert got == {0: "write to <email_spelt>, <id_number>, call <phone_local>", 1: "mail <email>", 2: "<email_spelt>", 3: "order 555-123-4568"}
