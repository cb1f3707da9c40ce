import pyarrow as pa
import pytest

import corpus_pipeline as cp
from bazaarlens.llm.sentencepiece import round_trip
from bazaarlens.llm.toxicity import score_texts, train
from tests.llm.test_decontaminate import brute as copied
from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_jaccard_join import brute as classes

AT = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    net = train(docs, spark.read.parquet(f"{AT}/labels.parquet"))
    ids = list(rows)
    keep = {i for i, s in zip(ids, score_texts(net, pa.array([rows[i] for i in ids])), strict=True) if s < cp.TOXIC}
    columns = docs.columns
    for name, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, AT)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "exact_dedup":
            keep = {r[0] for r in copies([(i, rows[i]) for i in sorted(keep)]) if r[3]}
        elif name == "jaccard_join":
            keep = {r[0] for r in classes([(i, rows[i]) for i in sorted(keep)]) if r[0] == r[1]}
        elif name == "decontaminate":
            keep = keep - {r[0] for r in copied([(i, rows[i]) for i in sorted(keep)], items)}
        got = {r.doc_id for r in docs.select("doc_id").collect()}
        assert got == keep
    last = cp.STAGES[4][1](spark, docs, AT).collect()
    assert {r.doc_id for r in last} == keep and all(r.same for r in last)


WORDS = [" ".join(f"{x}{i}" for i in range(60)) for x in "pqrst"]
SCHEMA = "doc_id long, text string, score double, row string, key int, __text string"


@pytest.fixture()
def odd(spark):
    """Rows that repeat an id or have none, null and empty texts, and columns named as inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, 9.0, f"r{n}", n, "own") for n, (i, t) in enumerate(rows)], SCHEMA)

    return make


def rows_left(df):
    assert df.columns == ["doc_id", "text", "score", "row", "key", "__text"]
    got = df.collect()
    assert all(r.score == 9.0 and r["__text"] == "own" and r.row == f"r{r.key}" for r in got)
    return {r.key for r in got}


def test_rows_go_by_their_own_text(spark, odd):
    a, b, c, d, _ = WORDS
    rows = [(0, a), (1, a.replace(" ", "  ")), (1, b), (None, c), (None, c), (None, d), (2, ""), (2, None), (1, b)]
    # of equal texts the one with most code points stays, then the least id, then the first row
    assert rows_left(cp.drop_copies(spark, odd(rows), AT)) == {1, 2, 3, 5, 6}
    near = [(0, a), (1, a + " more"), (1, b), (None, c), (None, c + " more"), (None, d), (2, ""), (2, None), (1, b)]
    assert rows_left(cp.drop_near_copies(spark, odd(near), AT)) == {0, 2, 3, 5, 6, 7}
    item = spark.read.parquet(f"{AT}/benchmark.parquet").filter("length(text) > 60").first().text
    full = [(1, a + " " + item), (1, b), (None, item), (None, c), (3, None), (3, "")]
    assert rows_left(cp.drop_contaminated(spark, odd(full), AT)) == {1, 3, 4, 5}
    assert rows_left(cp.drop_toxic(spark, odd(rows), AT)) == set(range(9))
    assert cp.encode(spark, odd(rows), AT).count() == 9


def test_written_tables_are_not_written_again(spark, odd):
    from bazaarlens.llm.common import numbered, written

    table = written(odd([(k % 3, WORDS[k % 5]) for k in range(40)]).repartition(4), "own")
    rows, _, row = cp.keyed(table)
    names = [r[row] for r in rows.collect()]
    assert len(set(names)) == 40 and all(len(n) == 2 for n in names)
    kept = cp.drop_copies(spark, table, AT).collect()
    assert len(kept) == 5 and all(r.doc_id == min(x.doc_id for x in table.collect() if x.text == r.text) for r in kept)
    assert len({r.n for r in numbered(odd([(1, "a")] * 30), "n").collect()}) == 30


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_no_rows(spark, odd, name):
    assert dict(cp.STAGES)[name](spark, odd([]), AT).count() == 0


def test_a_marker_in_a_text_comes_back_as_a_blank(spark, odd):
    import public_tokenizers

    got = round_trip(odd([(1, "a▁b"), (2, None), (3, "é" * 30_000)]), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert [r.same for r in sorted(got, key=lambda r: r.doc_id)] == [True] * 3
