from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from bazaarlens.llm.line_dedup import chunks, line_dedup


def signed(n):
    return n - 2**64 if n >= 2**63 else n


def h64(s):
    return xxhash.xxh64(s.encode(), seed=42).intdigest()


def two(p, q):
    """Hash of two longs as Spark chains it: the first one's hash is the second one's seed."""
    pack = lambda n: n.to_bytes(8, "little")
    return signed(xxhash.xxh64(pack(h64(q)), seed=xxhash.xxh64(pack(h64(p)), seed=42).intdigest()).intdigest())


def cut(text):
    lines = text.split("\n")
    before = lambda k: lines[k] if 0 <= k < len(lines) else ""
    g = [two(before(i - 1), before(i - 2)) for i in range(len(lines) + 1)]
    out = []
    for i, x in enumerate(lines):
        if i == 0 or (i > 1 and g[i - 1] > g[i] <= g[i + 1]):
            out.append([x])
        else:
            out[-1].append(x)
    return ["\n".join(c) for c in out]


def brute(rows):
    """Texts by row, each row a document of its own; rows are ordered by id (null last), then place."""
    where = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for at, c in enumerate(cut(t or "")):
            if "\n" in c and c.strip():
                where[c].append((i is None, i or 0, n, at))
    out = []
    for n, (i, t) in enumerate(rows):
        keep = [c for at, c in enumerate(cut(t or "")) if not ("\n" in c and c.strip() and len(where[c]) > 1 and min(where[c]) != (i is None, i or 0, n, at))]
        out.append((i, "\n".join(keep)))
    return out


def test_chunks_are_the_text_again(docs):
    texts = ["", "a", "a\nb\nc\nd\ne\nf", "\n\n", "1\n10\n01\n\n0", "x\r\ny\r\n", "é\n" * 500]
    got = docs(texts).select("doc_id", chunks(F.coalesce("text", F.lit(""))).alias("c")).collect()
    assert {r.doc_id: r.c for r in got} == {i: cut(t) for i, t in enumerate(texts)}
    assert all("\n".join(r.c) == texts[r.doc_id] for r in got)


def test_repeated_passages_go_and_the_first_stays(docs):
    block = "\n".join(f"shared line {i}" for i in range(40))
    texts = ["own start\n" + block, "another\nway to begin\n" + block + "\nown end", "nothing shared\nat all here", "", None]
    got = {r.doc_id: r for r in line_dedup(docs(texts)).collect()}
    assert {i: r.text for i, r in got.items()} == dict(brute(list(enumerate(texts))))
    assert got[0].text == texts[0] and got[1].removed_lines >= 30 and got[2].removed_lines == 0


def test_against_brute_force(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    got = line_dedup(sample).collect()
    assert sorted(map(tuple, line_dedup(sample, stored=True).collect())) == sorted(map(tuple, got))
    assert {r.doc_id: r.text for r in got} == dict(brute(rows))
    for r in got:
        text = dict(rows)[r.doc_id]
        assert r.n_lines == text.count("\n") + 1
        assert r.removed_lines == r.n_lines - (r.text.count("\n") + 1 if r.text or not r.removed_chunks else 0)


def test_chunks_have_two_lines(sample):
    for r in sample.collect():
        parts = cut(r.text)
        assert all("\n" in c for c in parts[:-1])


def test_repeated_and_null_ids_of_different_texts(docs):
    """Each row loses chunks of its own text only."""
    a, b, c = ("\n".join(f"{x} line {i}" for i in range(40)) for x in "abc")
    rows = [(0, a), (1, a), (1, b), (None, c), (None, a + "\n" + b), (2**63 - 1, c), (2**63 - 1, "one"), (None, c)]
    got = line_dedup(docs([t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(brute(rows), key=str)
    texts = [r.text for r in got]
    assert b in texts and a in texts and c in texts and sum(len(t) for t in texts) < sum(len(t) for _, t in rows) / 2


def test_a_hot_chunk_is_dealt_out(docs, monkeypatch):
    from bazaarlens.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common.join_salted, "__defaults__", ("n", "inner", 0))
    monkeypatch.setattr(common.join_sized, "__defaults__", (0,))
    block = "\n".join(f"shared line {i}" for i in range(12))
    rows = [(i, f"own {i}\nand {i}\n" + block) for i in range(20)]
    got = {r.doc_id: r.text for r in line_dedup(docs([t for _, t in rows])).collect()}
    assert got == dict(brute(rows))


def test_no_rows_long_texts_and_repeats(docs):
    assert line_dedup(docs([])).count() == 0
    assert len(line_dedup(docs(["a\nb", "a\nb"], [None, None])).collect()) == 2
    long = "\n".join(f"line {i % 977}" for i in range(50_000))
    got = {r.doc_id: r for r in line_dedup(docs([long, "", long])).collect()}
    want = dict(brute([(0, long), (1, ""), (2, long)]))
    assert {i: r.text for i, r in got.items()} == want and got[2].removed_lines > 49_000
