import hashlib
import random
import zlib

import pytest

from bazaarlens.llm import prefix_trie as trie

ROWS = "conv_id long, turn long, role string, text string, path string, part int"


def brute(turns, rebuild=True):
    """Nodes from plain dictionaries of prefixes."""
    by = {}
    for c, t, r, x in turns:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", trie_token(r or "", x or ""), x or ""))
    convs = {c: [(r, x) for _, _, r, _, x in sorted(rows)] for c, rows in by.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
        convs = {c: convs.get(c - c % 100, [])[: h[c]] + own[h[c] :] for c, own in convs.items()}
    members = {}
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = set()
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, ())), sum(q not in kids for q in under), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def trie_token(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32] + f"{len(text):08X}"


def nodes(frame):
    return [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in frame.collect()]


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], ROWS)


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force_over_many_partitions(spark, monkeypatch, seed):
    """Few different turns, so conversations share long prefixes, end inside others and repeat; partitions of a few rows."""
    monkeypatch.setattr(trie, "PARTITION_BYTES", 600)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(700), 90):
        n = rng.choice([1, 2, 3, 6, 9])
        rows += [(c, t, rng.choice(["user", "assistant"][t % 2 :][:1]), rng.choice(["", "a", "bé", "ccc"][: 1 + rng.randrange(2)])) for t in range(n)]
    hot = rng.sample(range(1000, 2000), 60)
    rows += [(c, t, "user", "hot") for c in hot for t in range(7)]
    got = nodes(trie.prefix_trie(trie.shared_heads(trie.conversation_paths(turns_of(spark, rows)))))
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
    plain = nodes(trie.prefix_trie(trie.conversation_paths(turns_of(spark, rows))))
    assert set(plain) == brute(rows, rebuild=False)


def test_nulls_ties_empty_and_long_texts(spark):
    long = "x" * 100_000
    rows = [(5, None, None, None), (5, 1, "user", long), (5, 1, "user", "b"), (5, 1, "user", "b"), (None, 0, "user", "lost"), (7, 0, "", ""), (100, 0, "user", "only"), (130, 3, "user", long)]
    got = nodes(trie.prefix_trie(trie.shared_heads(trie.conversation_paths(turns_of(spark, rows)))))
    assert set(got) == brute(rows) and len(got) == len(brute(rows))


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)  # its base is absent
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "too")]
    got = nodes(trie.prefix_trie(trie.shared_heads(trie.conversation_paths(turns_of(spark, rows)))))
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert trie.prefix_trie(trie.shared_heads(trie.conversation_paths(turns_of(spark, [])))).count() == 0


def test_query_equals_brute_force(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = nodes(trie.op12_prefix_trie(spark, tables))
    assert set(got) == brute(rows) and len(got) == len(set(got))
