"""Chat formatting: a visitor flattens typed content parts into text with placeholders, with a loss mask, and back."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from bazaarlens.llm.common import small_batches, written

#: A part of a turn: its kind, its text, or what an attachment refers to and how large it is.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_FORMATTED = "formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<kind:string,ref:string,start:long,tokens:long>>, expanded_tokens long"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, ``opens role divides content closes``, and the placeholders of attachments.

    ``reserved`` are control strings of other templates, which are escaped too. Each control string has to be two
    characters or more, and its first character may stand in no control string but as the first. Then no two control
    strings overlap in a text, and a mark behind the first character changes just that one.
    """

    opens: str = "<|im_start|>"
    divides: str = "<|im_sep|>"
    closes: str = "<|im_end|>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    other: str = "<|attachment|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>")
    mark: str = "\\"

    def __post_init__(self) -> None:
        firsts = {c[:1] for c in self.controls}
        if len(self.mark) != 1 or any(len(c) < 2 or self.mark in c or firsts & set(c[1:]) for c in self.controls):
            raise ValueError("the first character of a control string has to stand in none but as the first, and the mark in none at all")
        if len({self.opens, self.divides, self.closes, *self.placeholders}) < 7:
            raise ValueError("the marks and placeholders have to differ")

    @property
    def placeholders(self) -> tuple[str, ...]:
        return (self.image, self.audio, self.document, self.other)

    @cached_property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.opens, self.divides, self.closes, *self.placeholders, *self.reserved)))

    def _starts(self, behind: str) -> re.Pattern[str]:
        """First characters of control strings with any number of marks behind them, ``behind`` being matched too."""
        by = {c[0]: [re.escape(x[1:]) for x in self.controls if x[0] == c[0]] for c in self.controls}
        m = re.escape(self.mark)
        return re.compile("|".join(f"{re.escape(c)}{behind and m}(?={m}*(?:{'|'.join(rest)}))" for c, rest in by.items()))

    @cached_property
    def _plain(self) -> re.Pattern[str]:
        return self._starts("")

    @cached_property
    def _marked(self) -> re.Pattern[str]:
        return self._starts("mark")

    @cached_property
    def _held(self) -> re.Pattern[str]:
        return re.compile("|".join(re.escape(p) for p in self.placeholders))

    def escape(self, text: str) -> str:
        """``text`` without control strings: each gets one mark more behind its first character."""
        return self._plain.sub(lambda m: m[0] + self.mark, text)

    def unescape(self, text: str) -> str:
        return self._marked.sub(lambda m: m[0][0], text)

    def parse(self, formatted: str) -> tuple[str, list[str | None]]:
        """(role, contents) of one formatted turn: texts unescaped, None for each placeholder."""
        if not (formatted.startswith(self.opens) and formatted.endswith(self.closes)):
            raise ValueError("not a formatted turn")
        role, found, content = formatted[len(self.opens) : len(formatted) - len(self.closes)].partition(self.divides)
        if not found:
            raise ValueError("a formatted turn has to divide its role from its content")
        texts = self._held.split(content)
        return self.unescape(role), [x for t in texts for x in (None, self.unescape(t))][1:]


@dataclass(frozen=True)
class Costs:
    """Tokens that attachments expand to: of an image one a patch, of audio so many a second, of a document so many a page."""

    patch: int = 28
    a_second: float = 12.5
    a_page: int = 1024


class Flattener:
    """Visits the parts of a turn in order and gathers its text, its loss mask and its attachments."""

    def __init__(self, template: Template, costs: Costs, learn: bool, start: int) -> None:
        self.template, self.costs, self.learn, self.at = template, costs, learn, start
        self.pieces: list[str] = []
        self.loss: list[dict] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['kind']}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = self.template.escape(part["text"] or "")
        if self.learn and text:
            self.loss.append({"start": self.at, "end": self.at + len(text)})
        self._put(text)

    def visit_image(self, part: dict) -> None:
        side = self.costs.patch
        self._attach(part, self.template.image, math.ceil((part["width"] or 0) / side) * math.ceil((part["height"] or 0) / side))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, self.template.audio, math.ceil((part["seconds"] or 0) * self.costs.a_second))

    def visit_document(self, part: dict) -> None:
        self._attach(part, self.template.document, (part["pages"] or 0) * self.costs.a_page)

    def visit_other(self, part: dict) -> None:
        self._attach(part, self.template.other, 0)

    def _attach(self, part: dict, placeholder: str, tokens: int) -> None:
        self.attachments.append({"kind": part["kind"], "ref": part["ref"], "start": self.at, "tokens": tokens})
        self._put(placeholder)

    def _put(self, text: str) -> None:
        self.pieces.append(text)
        self.at += len(text)


def flatten(role: str, parts: list[dict] | None, template: Template, costs: Costs, learned: str) -> dict:
    """One turn: its formatted text, loss mask and attachments (code points from its start) and the tokens these expand to."""
    head = template.opens + template.escape(role) + template.divides
    v = Flattener(template, costs, role == learned, len(head))
    for part in parts or ():
        v.visit(part)
    return {"formatted": "".join([head, *v.pieces, template.closes]), "loss": v.loss, "attachments": v.attachments, "expanded_tokens": sum(a["tokens"] for a in v.attachments)}


def format_turns(turns: DataFrame, template: Template = Template(), costs: Costs = Costs(), learned: str = "assistant") -> DataFrame:
    """``turns`` (columns role and parts, an array of ``PART``) with each turn's formatted text, loss mask and attachments.

    Each row is formatted by itself, so nothing is shuffled; a conversation's text is that of its turns in order. The
    loss mask covers the texts of ``learned`` turns, not their marks or attachments. Placeholders stand where the parts
    stood; ``attachments`` names what they refer to, in order, and the tokens each expands to. Parts of an unknown kind
    are attachments without tokens. Null roles, texts and lists of parts count as empty, null parts as none. Long texts,
    repeated rows and extra columns are kept as they are; columns called as the new ones are replaced; no rows give none.
    """
    added = StructType.fromDDL(_FORMATTED)
    rest = [c for c in turns.columns if c.lower() not in {f.name for f in added}]
    schema = StructType([turns.schema[c] for c in rest] + added.fields)
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [flatten(r or "", p, template, costs, learned) for r, p in zip(b["role"].to_pylist(), b["parts"].to_pylist())]
            made = pa.RecordBatch.from_pylist(rows, schema=arrow)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), *made.columns], names=[*rest, *arrow.names])

    return turns.mapInArrow(run, schema)


class _Digest:
    """What is read back of one conversation, turn by turn: only hashes and counts are held."""

    def __init__(self, template: Template) -> None:
        self.template, self.turns, self.learnt = template, hashlib.sha256(), hashlib.sha256()
        self.out = {"n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_attachments": 0, "expanded_tokens": 0}

    def add(self, formatted: str, loss: list[dict], attachments: list[dict]) -> None:
        role, contents = self.template.parse(formatted)
        if contents.count(None) != len(attachments):
            raise ValueError("placeholders and attachments have to be as many")
        self.turns.update(f"{role}\n{''.join(t for t in contents if t is not None)}\n".encode())
        learnt = "".join(self.template.unescape(formatted[s["start"] : s["end"]]) for s in loss)
        self.learnt.update(learnt.encode())
        for k, v in (("n_turns", 1), ("loss_chars", len(learnt)), ("formatted_chars", len(formatted)), ("n_attachments", len(attachments)), ("expanded_tokens", sum(a["tokens"] for a in attachments))):
            self.out[k] += v

    def row(self, conv: object) -> dict:
        return self.out | {"conv": conv, "turns_sha256": self.turns.hexdigest(), "loss_sha256": self.learnt.hexdigest()}


def read_back(formatted: DataFrame, id_col: str = "conv_id", order: tuple[str, ...] = ("turn",), template: Template = Template()) -> DataFrame:
    """One row per conversation, from its formatted turns parsed in order: counts and digests of roles, texts and of the text under the loss mask.

    Turns are ordered by ``order`` (nulls first), ties by role and then by formatted text; rows with a null id are one
    conversation. A digest needs a conversation's turns one after the other, so they are dealt out by conversation; they
    pass through their task as a stream, of which hashes and counts are held and no text but one turn's.
    """
    columns = ["n_turns long", "turns_sha256 string", "loss_chars long", "loss_sha256 string", "formatted_chars long", "n_attachments long", "expanded_tokens long"]
    added = StructType.fromDDL(", ".join(columns))
    conv = StructField(id_col, formatted.schema[id_col].dataType)
    schema = StructType([conv, *added])
    arrow = to_arrow_schema(schema)
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in (id_col, *order, "role", "formatted")]
    dealt = formatted.select(*dict.fromkeys([id_col, *order, "role", "formatted", "loss", "attachments"])).repartition(F.col(f"`{id_col}`")).sortWithinPartitions(*keys)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r["conv" if f.name == id_col else f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []
        for b in batches:
            for c, text, loss, attached in zip(*(b[x].to_pylist() for x in (id_col, "formatted", "loss", "attachments"))):
                if digest is None or c != now:
                    if digest is not None:
                        done.append(digest.row(now))
                    now, digest = c, _Digest(template)
                digest.add(text, loss, attached)
            if len(done) >= 1000:
                yield batch(done)
                done = []
        if digest is not None:
            yield batch([*done, digest.row(now)])

    return dealt.mapInArrow(run, schema)


def text_parts(turns: DataFrame) -> DataFrame:
    """``turns`` with each text as its turn's only part, in a column parts."""
    none = F.lit(None)
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"))
    return turns.withColumn("parts", F.array(part))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 that says control strings, formatted into a table and read back from it."""
    columns = ["conv_id", "turn", "role", "text"]
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*columns)
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    with small_batches(spark, 1000):
        table = written(format_turns(text_parts(turns.unionByName(own)).drop("text")), "formatted")
    return read_back(table)


_T = Template()


def _sql_escaped(text: str) -> str:
    for first in dict.fromkeys(c[0] for c in _T.controls):
        rest = "|".join(re.escape(c[1:]) for c in _T.controls if c[0] == first)
        text = f"regexp_replace({text}, '({re.escape(first)})(\\\\*)({rest})', '\\1\\\\\\2\\3', 'g')"
    return text


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), said AS (
  SELECT *, '{_T.opens}' || {_sql_escaped("role")} || '{_T.divides}' || {_sql_escaped("text")} || '{_T.closes}' AS formatted FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, formatted)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, formatted)) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM said GROUP BY conv_id
"""
