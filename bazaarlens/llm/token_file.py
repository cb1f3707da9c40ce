"""Token ids as length-limited canonical Huffman codes in independent blocks."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.common import join_sized, shared_dir, written
from bazaarlens.llm.words import blocks, tidied

#: Longest code in bits (the decoding table has 2^16 entries), ids between checkpoints, ids in a block before the next starts.
MAX_BITS, STRIDE, BLOCK_IDS = 16, 64, 1 << 16
#: Ids of one file.
SHARD_IDS = 32_000_000
END_ID = 2
#: Texts are tokenised in blocks of about so many bytes; beyond so many bytes of pieces and their ids, those of the last block alone are kept.
TOKEN_BLOCK, KEPT = 12_000_000, 40_000_000


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal prefix code lengths of at most ``max_bits`` (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError("more symbols than codes of that length")
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    # each level: the weights of leaves and packages in order, and which are packages
    levels, packed = [], np.zeros(0)
    for _ in range(max_bits):
        both = np.concatenate([leaf, packed])
        rank = np.argsort(both, kind="stable")
        levels.append(rank >= len(leaf))
        both = both[rank]
        packed = both[0 : len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(leaf) - 2
    for is_package in reversed(levels):
        packages = int(is_package[:take].sum())
        lengths[order[: take - packages]] += 1
        take = 2 * packages
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        top = int(size.max())
        codes[order] = ((np.concatenate([[0], np.cumsum(1 << (top - size))[:-1]])) >> (top - size)).astype(np.uint32)
    return codes


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """The bits of all ids, first bit first, and the bit offset of every ``stride``-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ids) else 0
    out = np.zeros((total >> 3) + 4, np.uint8)
    # a code of at most 16 bits lies in 3 bytes; where codes share a byte, their bits are apart, so adding joins them
    value = codes[ids].astype(np.int64) << (24 - size - (starts & 7))
    first = starts >> 3
    for k in range(3):
        out += np.bincount(first + k, weights=((value >> (16 - 8 * k)) & 255), minlength=len(out))[: len(out)].astype(np.uint8)
    return out[: (total + 7) >> 3].tobytes(), starts[::stride].astype(np.uint32)


def decoding_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each ``max_bits``-bit window the id it starts with, and that code's length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = 1 << (max_bits - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << max_bits, np.uint32), np.ones(1 << max_bits, np.uint8)
    n = int(width.sum())
    ids[:n], size[:n] = np.repeat(order, width), np.repeat(lengths[order], width)
    return ids, size


def decode(data: bytes, marks: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], stride: int = STRIDE) -> np.ndarray:
    """The n ids of a block. All stretches between checkpoints are decoded side by side, one table look-up an id."""
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    ids, size = table
    at = marks.astype(np.int64)
    out = np.zeros((stride, len(at)), np.uint32)
    last = len(window) - 1
    for k in range(min(stride, n)):
        bits = (window[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[k] = ids[bits]
        at += size[bits]
    return out.T.ravel()[:n]


_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Texts with these are cut by _CUT; all others at each blank.
_ODD = "[\\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}|^\\s|\\s$|^$|[\\t\\r\u000b\u000c\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Stretches that do not follow each other in one call: empty ones, with a blank inside, or with white space at an end.
_WILD = "^$| |^[\\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[\\s\u000b\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]$|^\u000b"
#: Letters, then signs, then letters and signs of a next line: tokens of the pre-tokenizer start at each of the four (and a line end is one).
_PIECES = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ſ]+)(?P<signs>[!-/:-@\\[-`{-~]*)(?:(?P<next>\n[A-Za-zÀ-ÖØ-öø-ſ]+)(?P<more>[!-/:-@\\[-`{-~]*))?$"
_held: dict[str, tuple] = {}
#: By tokenizer: pieces, the first place and number of each one's ids, and all ids in a row.
_known: dict[str, tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = {}


def _encoder(path: str):
    """(tokenizer, bytes of each id, pattern of the special tokens) of this Python worker."""
    if path not in _held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        special = "|".join(re.escape(t.content) for t in made.get_added_tokens_decoder().values())
        size = np.zeros(made.get_vocab_size(), np.int64)
        for piece, i in made.get_vocab().items():
            size[i] = len(piece)  # a byte-level piece has a character for each byte
        _held[path] = (made, size, special)
    return _held[path]


def _ids_of(tokenizer, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _together(tokenizer, size: np.ndarray, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces, each with a blank or a line end before it, in a row, and their bounds: many in one call, cut by their bytes."""
    words = pieces.to_pylist()
    ids = _ids_of(tokenizer, ["".join(words[k : k + 1000]) for k in range(0, len(words), 1000)])
    flat = np.concatenate([np.zeros(0, "<u4"), *ids])
    ends = np.cumsum(np.asarray(pc.binary_length(pieces), np.int64))
    return flat, np.concatenate([[0], np.searchsorted(np.cumsum(size[flat]), ends, "right")])


def _spread(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``flat`` side by side, and their ends."""
    ends = np.cumsum(n)
    return flat[np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def _looked_up(path: str, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place and number of the ids of each of these distinct pieces, and the ids: only those that this worker does not know yet are encoded."""
    tokenizer, size, _ = _encoder(path)
    pieces = pieces.cast(pa.string())
    known, first, n, flat = _known.get(path) or (pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4"))
    where = np.array(pc.fill_null(pc.index_in(pieces, value_set=known), -1), np.int64)
    led = np.asarray(pc.match_substring_regex(pieces, "^[ \n]"), bool)
    led, bare = np.flatnonzero((where < 0) & led), np.flatnonzero((where < 0) & ~led)
    ids, at = _together(tokenizer, size, pieces.take(pa.array(led)))
    alone = _ids_of(tokenizer, pieces.take(pa.array(bare)).to_pylist())
    new = np.concatenate([led, bare])
    where[new] = len(known) + np.arange(len(new))
    known, flat = pa.concat_arrays([known, pieces.take(pa.array(new))]), np.concatenate([flat, ids, *alone])
    n = np.concatenate([n, np.diff(at), [len(x) for x in alone]]).astype(np.int64)
    first = np.cumsum(n) - n
    if known.nbytes + flat.nbytes + 16 * len(n) > KEPT:  # those of this block stay
        flat, ends = _spread(flat, first[where], n[where])
        known, n, where = pieces, n[where], np.arange(len(pieces))
        first = ends - n
    _known[path] = (known, first, n, flat)
    return first[where], n[where], flat


def _pieced(path: str, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of stretches, each with a blank before it, in a row, and their bounds; those of the form ``_PIECES`` are put together of their pieces."""
    found = pc.extract_regex(stretches, _PIECES)
    fits = found.is_valid()
    part = lambda name: pc.if_else(fits, pc.struct_field(found, name), "")
    lead = pc.binary_join_element_wise("", pc.if_else(fits, part("word"), stretches), " ")
    coded = pa.concat_arrays([lead, part("signs"), part("next"), part("more")]).dictionary_encode()
    first, n, flat = _looked_up(path, coded.dictionary)
    number = np.asarray(coded.indices, np.int64).reshape(4, -1).T.ravel()
    ids, ends = _spread(flat, first[number], n[number])
    return ids, np.concatenate([[0], ends[3::4]])


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokenizer's ids of whole texts in a row, as by encoding each text alone, and the texts' bounds in them.

    The pre-tokenizer always starts a new token at a single blank between two other characters, so texts are cut
    there, and each distinct stretch is put together once, of pieces whose ids a worker keeps from block to block.
    Texts that hold a special token go whole.
    """
    tokenizer, _, special = _encoder(path)
    if special and pc.any(whole := pc.match_substring_regex(texts, special)).as_py():
        flat, at = token_ids(texts.filter(pc.invert(whole)), path)
        plain = iter(flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
        direct = iter(_ids_of(tokenizer, texts.filter(whole).to_pylist()))
        ids = [next(direct) if w else next(plain) for w in whole.to_pylist()]
        return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    odd = pc.match_substring_regex(texts, _ODD)
    lists = pc.split_pattern(texts, " ")
    if pc.any(odd).as_py():
        lists = pa.array([[p[1:] if k and p[:1] == " " else p for k, p in enumerate(_CUT.split(t))] if o else x for t, o, x in zip(texts.to_pylist(), odd.to_pylist(), lists.to_pylist(), strict=True)], pa.list_(pa.string()))
    count = np.asarray(pc.list_value_length(lists), np.int64)
    bounds = np.concatenate([[0], np.cumsum(count)])
    coded = lists.flatten().dictionary_encode()
    number, words = np.asarray(coded.indices, np.int64), coded.dictionary
    # the first stretch of a text has no blank before it
    heads = bounds[:-1][count > 0]
    inner = np.ones(len(number), bool)
    inner[heads] = False
    used = np.zeros(len(words), bool)
    used[number[inner]] = True
    tame = used & ~np.asarray(pc.match_substring_regex(words, _WILD), bool) if len(words) else used
    flat, at = _pieced(path, words.filter(pa.array(tame)))
    wild = np.flatnonzero(used & ~tame)
    alone = _ids_of(tokenizer, [" " + w for w in words.take(pa.array(wild)).to_pylist()] + words.take(pa.array(number[heads])).to_pylist())
    length = np.array([len(x) for x in alone], np.int64)
    begin = len(flat) + np.cumsum(length) - length
    flat = np.concatenate([flat, *alone])
    start, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    start[tame], n[tame] = at[:-1], np.diff(at)
    start[wild], n[wild] = begin[: len(wild)], length[: len(wild)]
    first, own = start[number], n[number]
    first[heads], own[heads] = begin[len(wild) :], length[len(wild) :]
    ids, ends = _spread(flat, first, own)
    return ids, np.concatenate([[0], ends])[bounds]


def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column("text"), TOKEN_BLOCK):
                flat, at = token_ids(texts, path)
                ids = [np.append(flat[a:b], np.uint32(end_id)) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch({"id": batch.column("id").slice(first, len(texts)), "n": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([_packed(x) for x in ids], pa.binary())})

    return tidied(run)


def _packed(ids: np.ndarray) -> bytes:
    """Ids as 2 bytes each where they fit, else as 4; the first byte says which."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 65536 else b"\4" + ids.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        if len(batch):
            seen = np.bincount(np.concatenate([_unpacked(x) for x in batch.column("ids").to_pylist()]))
            total = np.pad(total, (0, max(0, len(seen) - len(total))))
            total[: len(seen)] += seen
    used = np.flatnonzero(total)
    yield pa.record_batch({"token": pa.array(used.astype(np.int64)), "n": pa.array(total[used])})


def _blocked(lengths: np.ndarray, block_ids: int):
    """Documents in order to blocks: a block ends with the first document that fills it, so documents are never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        held_ids, held_docs, number, before = [], [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal number, before
            sizes = np.array([len(x) for x in held_ids], np.int64)
            ids = np.concatenate(held_ids)
            data, marks = encode(ids, codes, lengths)
            out = pa.record_batch({"shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int64()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "docs": pa.array([held_docs[:]], pa.list_(kind)), "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())), "marks": pa.array([marks.tobytes()], pa.binary()), "data": pa.array([data], pa.binary())})
            held_ids.clear()
            held_docs.clear()
            number += 1
            before += len(ids)
            return out

        shard, kind, filled = 0, None, 0
        for batch in batches:
            kind = batch.schema.field("id").type
            for doc, where, x in zip(batch.column("id").to_pylist(), batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                shard = where
                ids = _unpacked(x)
                held_ids.append(ids)
                held_docs.append(doc)
                filled += len(ids)
                if filled >= block_ids:
                    yield block()
                    filled = 0
        if held_ids:
            yield block()

    return tidied(run)


def _read(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["data"], np.frombuffer(row["marks"], np.uint32), row["n_ids"], table)
                ends = np.cumsum(row["sizes"])
                kind = batch.schema.field("docs").type.value_type
                parts = np.split(ids, ends[:-1])
                yield pa.record_batch(
                    {
                        "shard": pa.array([row["shard"]] * len(parts), pa.int32()), "id": pa.array(row["docs"], kind), "before": pa.array(ends - row["sizes"] + row["before"]),
                        "n_tokens": pa.array(row["sizes"], pa.int64()), "ids": pa.array([x.astype("<u4").tobytes() for x in parts], pa.binary()),
                    }
                )

    return tidied(run)


def write_tokens(docs: DataFrame, path: str, to: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, max_bits: int = MAX_BITS, block_ids: int = BLOCK_IDS, shard_ids: int = SHARD_IDS) -> None:
    """Token ids of whole texts, each with ``end_id`` behind it, as a folder of coded blocks in ascending order of ids.

    ``to``/codes: rows (token, bits), the code lengths, from which the canonical codes follow; ``to``/blocks: rows
    (shard, block, before, n_ids, docs, sizes, marks, data), ``before`` being the ids before the block in its shard. Shards are ranges of ascending ids; blocks are numbered in a
    shard, and each can be decoded alone, from the checkpoint before any id (``marks``: bit offsets of every 64th id).

    Texts are tokenised once and the ids written; their counts are summed map-side, so what reaches the driver is one
    number for each id of the vocabulary. Only ids are shuffled, by ranges of document ids.

    Null texts are empty: they have the end id alone. Null ids come first. Rows that repeat an id lie next to each
    other in no particular order. An empty table makes an empty folder of blocks.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    held = written(base.mapInArrow(_tokenised(path, end_id), f"id {kind}, n long, ids binary"), "token-ids")
    counts = held.select("ids").mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max([r.token for r in counts], default=0) + 1, np.int64)
    for r in counts:
        total[r.token] = r.n
    lengths = code_lengths(total, max_bits)
    spark.createDataFrame([(t, int(b)) for t, b in enumerate(lengths) if b] or [(end_id, 1)], "token long, bits int").coalesce(1).write.parquet(f"{to}/codes")
    shards = max(1, int(-(-int(total.sum()) // shard_ids)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = held.repartitionByRange(shards, "id").sortWithinPartitions("id").select("id", "n", "ids", F.spark_partition_id().alias("shard"))
    dealt.mapInArrow(_blocked(lengths, block_ids), f"shard int, block long, before long, n_ids long, docs array<{kind}>, sizes array<long>, marks binary, data binary").write.option("parquet.enable.dictionary", "false").parquet(f"{to}/blocks")


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """Rows (id, start, n_tokens, ids) of a folder of coded blocks; ids are little-endian 32-bit, start counts all ids before."""
    codes = spark.read.parquet(f"{at}/codes").collect()  # one row for each id of the vocabulary
    lengths = np.zeros(max(r.token for r in codes) + 1, np.uint8)
    for r in codes:
        lengths[r.token] = r.bits
    blocks = spark.read.parquet(f"{at}/blocks")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    shards = sorted(tuple(r) for r in blocks.groupBy("shard").agg(F.sum("n_ids")).collect())  # one number for each shard
    starts = np.cumsum([0] + [n for _, n in shards])
    first = spark.createDataFrame([(s, int(a)) for (s, _), a in zip(shards, starts, strict=False)], "shard int, shard_start long")
    rows = blocks.mapInArrow(_read(lengths), f"shard int, id {kind}, before long, n_tokens long, ids binary")
    return join_sized(rows, first, "shard", "inner").select("id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    at = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), at)
    return read_tokens(spark, at).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
