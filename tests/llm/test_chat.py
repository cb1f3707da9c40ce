import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bazaarlens.llm import chat
from bazaarlens.llm.chat import Costs, Template, flatten, format_turns, read_back

T = Template()
ROWS = "conv_id long, turn long, role string, parts array<" + chat.PART + ">"


def text(t):
    return {"kind": "text", "text": t, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}


def part(kind, ref, **size):
    return text(None) | {"kind": kind, "ref": ref} | size


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*T.controls, "\\", "<", "[", ">", "]", "<\\", "|im_end|>", "a", "é", "\n"]), max_size=12).map("".join), st.text(max_size=8))
def test_escape_round_trip(a, b):
    for t in (a, b, a + b):
        safe = T.escape(t)
        assert not any(c in safe for c in T.controls)
        assert T.unescape(safe) == t
    made = flatten(a, [text(b), part("image", "x"), text(a)], T, Costs(), "none")["formatted"]
    assert T.parse(made) == (a, [b, None, a])


def test_visitor_places_parts_in_order():
    parts = [text("see "), part("image", "a.png", width=56, height=57), text(" and "), part("audio", "b.wav", seconds=2.0), part("document", "c.pdf", pages=3), part("hologram", "d"), None, text("<s>")]
    made = flatten("assistant", parts, T, Costs(patch=28, a_second=12.5, a_page=100), "assistant")
    body = made["formatted"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in made["attachments"]] == [("image", "a.png", 6), ("audio", "b.wav", 25), ("document", "c.pdf", 300), ("hologram", "d", 0)]
    assert [body[a["start"] :].startswith(p) for a, p in zip(made["attachments"], T.placeholders)] == [True] * 4
    assert [T.unescape(body[s["start"] : s["end"]]) for s in made["loss"]] == ["see ", " and ", "<s>"]
    assert made["expanded_tokens"] == 331
    assert T.parse(body) == ("assistant", ["see ", None, " and ", None, "", None, "", None, "<s>"])


def test_template_says_which_control_strings_it_cannot_escape():
    for bad in (dict(opens="<<a>"), dict(mark="<"), dict(mark=""), dict(closes="<|im_sep|>"), dict(reserved=("x",))):
        with pytest.raises(ValueError):
            Template(**bad)
    other = Template(opens="[INST]", divides="[/INST]", closes="</s>", reserved=("<s>", "<|im_start|>"))
    made = flatten("user", [text("</s>[INST] ok [/INST]")], other, Costs(), "assistant")["formatted"]
    assert made.count("[INST]") == made.count("[/INST]") == made.count("</s>") == 1
    assert other.parse(made) == ("user", ["</s>[INST] ok [/INST]"])


def test_rows_with_nulls_ties_long_texts_and_clashing_columns(spark):
    long = "<s>é" * 40_000
    rows = [
        (1, 2, "assistant", [text("b")]),
        (1, None, None, [text(None)]),
        (1, 1, "user", None),
        (1, 1, "user", None),
        (None, 0, "assistant", [text(long)]),
        (2, 0, "assistant", [text(""), text("x"), part("image", "i", width=28, height=28)]),
    ]
    turns = spark.createDataFrame(rows, ROWS).selectExpr("*", "'x' AS formatted", "7 AS LOSS", "'k' AS kind")
    made = format_turns(turns)
    assert made.columns == ["conv_id", "turn", "role", "parts", "kind", "formatted", "loss", "attachments", "expanded_tokens"]
    got = {r["conv_id"]: r for r in read_back(made).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("\n\nuser\n\nuser\n\nassistant\nb\n") and got[1]["n_turns"] == 4
    assert (got[None]["loss_chars"], got[None]["loss_sha256"]) == (len(long), sha(long))
    assert (got[2]["turns_sha256"], got[2]["loss_sha256"], got[2]["n_attachments"], got[2]["expanded_tokens"]) == (sha("assistant\nx\n"), sha("x"), 1, 1)
    assert read_back(format_turns(turns.limit(0))).count() == 0


def test_query_equals_sql(spark, tables):
    got = {tuple(sorted(r.asDict().items())) for r in chat.op11_chat_format(spark, tables).collect()}
    frame = duckdb.sql(f"WITH conversations AS (FROM '{tables}/conversations.parquet') {chat.ORACLE.replace('WITH turns', ', turns', 1)}").df()
    want = {tuple(sorted(r.items())) for r in frame.to_dict("records")}
    assert got == want
    own = next(dict(r) for r in got if dict(r)["conv_id"] == -7)
    said = "</s>[INST] ok [/INST]"
    assert own["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (own["loss_chars"], own["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
