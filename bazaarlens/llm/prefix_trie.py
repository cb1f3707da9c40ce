"""Prefix trie of conversations: union-find over sorted-neighbour LCP edges, partition forests merged across boundaries.

A conversation's path is the string of its turns' tokens, each of ``TOKEN`` characters: a digest of role and text, and
the text's length in code points. Sorted by path, conversations that share a prefix stand side by side, and the prefix
that two of them share is the least that neighbours between them share. In each partition of the sorted rows, edges
between neighbours are taken in descending depth; each merge of two components makes a branching node, or adds a child
to one of that depth. Nodes that reach over a partition's ends are contracted to one row each and merged by path.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bazaarlens.llm.common import join_salted, written
from bazaarlens.llm.words import tidied

#: Characters of a turn's token: 32 of its digest, 8 of its text's length.
TOKEN = 40
#: About so many bytes of paths come to one partition of the sorted rows; fewer, down to the second, where there are tasks for it.
PARTITION_BYTES, LEAST_BYTES = 16 << 20, 256 << 10
_NODE = "path string, part int, conv_id long, depth long, parent_path string, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, tokens long, ends_sha256 string, ends string"
_NONE = hashlib.sha256(b"").hexdigest()


def token_of(role: Column, text: Column) -> Column:
    """Fixed-width token of a turn: equal if and only if role and text are (by 128 bits of a digest and the length)."""
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.char_length(text).cast("long")), 8, "0"))


def conversation_paths(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, path) of ``turns``, ordered by turn (null first), ties by role and token. Rows without an id are left out; null roles and texts are empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("timed"), F.col("turn").alias("turn"), role.alias("role"), token_of(role, text).alias("token")).alias("t"))
    return said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["token"]), "").alias("path"))


def shared_heads(paths: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Each conversation's path with its first h turns replaced by those of the block's first; h is its id's crc32 modulo ``most``.

    A block's first conversation is read by at most ``block`` others, so no key of this join is hot.
    """
    heads = paths.filter(F.pmod("conv_id", F.lit(block)) == 0).select(F.col("conv_id").alias("base"), F.substring("path", 1, (most - 1) * TOKEN).alias("head"))
    own = paths.select("*", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most * TOKEN).cast("int").alias("h"))
    rebuilt = F.concat(F.coalesce(F.expr("substring(head, 1, h)"), F.lit("")), F.expr("substring(path, h + 1)"))
    return own.join(heads, "base", "left").select("conv_id", rebuilt.alias("path"))


def _shared(a: str, b: str) -> int:
    """How many turns two paths begin with in common."""
    return len(os.path.commonprefix((a, b))) // TOKEN


class _Forest:
    """The compact trie of one partition: its distinct paths, and the nodes that merges of components make over them."""

    def __init__(self, paths: list[str], counts: list[int], least: list[int]) -> None:
        n = len(paths)
        self.paths = paths
        self.depth = [len(p) // TOKEN for p in paths]
        self.through = list(range(n))  # a path that goes through the node
        self.parent, self.n, self.least = [-1] * n, list(counts), list(least)
        shared = np.array([_shared(a, b) for a, b in zip(paths, paths[1:])], np.int64)
        up, top = list(range(n)), list(range(n))  # union-find over paths; a component's upmost node

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for left in np.argsort(-shared, kind="stable").tolist():
            # Edges of one depth come from left to right: the right component was merged by deeper edges only, and its
            # paths are longer, so its upmost node lies deeper. The left one's may lie at this depth already.
            a, b, depth = find(left), find(left + 1), int(shared[left])
            if self.depth[top[a]] > depth:
                top[a] = self._over(top[a], depth)
            self._hang(top[b], top[a])
            up[b] = a
        self.root = top[find(0)]
        if self.depth[self.root]:
            self.root = self._over(self.root, 0)

    def _over(self, child: int, depth: int) -> int:
        for column, v in ((self.depth, depth), (self.through, self.through[child]), (self.parent, -1), (self.n, 0), (self.least, self.least[child])):
            column.append(v)
        self._hang(child, len(self.depth) - 1)
        return len(self.depth) - 1

    def _hang(self, child: int, node: int) -> None:
        self.parent[child] = node
        self.n[node] += self.n[child]
        self.least[node] = min(self.least[node], self.least[child])

    def opened(self, left: int, right: int) -> list[int]:
        """By node: down to which depth its prefixes may also be in the partition before or after; -1 if none."""
        out = [-1] * len(self.depth)
        for leaf, most in ((0, left), (len(self.paths) - 1, right)):
            v = leaf
            while v >= 0:
                out[v] = max(out[v], most)
                v = self.parent[v]
        out[self.root] = max(out[self.root], 0)
        return out


def _rows(part: int, paths: list[str], ids: list[list[int]], left: int, right: int) -> Iterator[dict]:
    """All nodes of a partition; of those that reach over its ends, what it adds to them (closed children, leaves and savings)."""
    f = _Forest(paths, [len(x) for x in ids], [min(x) for x in ids])
    opened = f.opened(left, right)
    until = [np.concatenate([[0], np.cumsum([int(p[i - 8 : i], 16) for i in range(TOKEN, len(p) + 1, TOKEN)], dtype=np.int64)]).astype(np.int64) for p in paths]
    nodes = len(f.depth)
    kids, closed_kids, leaves, saved = [0] * nodes, [0] * nodes, [0] * nodes, [0] * nodes
    for v in sorted(range(nodes), key=lambda v: -f.depth[v]):
        p = f.parent[v]
        above = f.depth[p] if p >= 0 else -1
        bottom, c = f.depth[v], until[f.through[v]]
        last_open = max(above, min(opened[v], bottom))  # of the node's own prefixes, depths above + 1 to bottom
        leaf = int(not kids[v] and bottom > last_open)
        joined = ",".join(map(str, ids[v])) if v < len(ids) else ""
        path = paths[f.through[v]]
        for d in range(above + 1, bottom + 1):
            is_open = d <= last_open
            end = joined if d == bottom else ""
            parent_open = d - 1 <= last_open if d > above + 1 else p >= 0 and above <= opened[p]
            yield {
                "path": path[: d * TOKEN] if is_open else None,
                "part": part,
                "conv_id": f.least[v],
                "depth": d,
                "parent_path": path[: (d - 1) * TOKEN] if not is_open and parent_open else None,
                "parent_conv_id": None if is_open or parent_open else f.least[v] if d > above + 1 else f.least[p],
                "n_convs": f.n[v],
                "n_children": int(d >= last_open) if d < bottom else closed_kids[v],
                "n_leaves": leaves[v] + leaf,
                "saved_tokens": saved[v] + (f.n[v] - 1) * int(c[bottom] - c[max(d - 1, last_open, 0)]),
                "tokens": int(c[d] - c[d - 1]) if d else 0,
                "ends_sha256": None if is_open else hashlib.sha256(end.encode()).hexdigest() if end else _NONE,
                "ends": end if is_open else None,
            }
        if p >= 0:
            kids[p] += 1
            closed_kids[p] += int(last_open == above)
            leaves[p] += leaves[v] + leaf
            saved[p] += saved[v] + (f.n[v] - 1) * int(c[bottom] - c[last_open])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each path's stretches of ids, comma-joined; they come sorted by path and partition."""
    now, digest, done = None, None, []
    for b in batches:
        for path, ends in zip(b["path"].to_pylist(), b["ends"].to_pylist()):
            if digest is not None and path == now:
                digest.update(b"," + ends.encode())
                continue
            if digest is not None:
                done.append({"path": now, "ends_sha256": digest.hexdigest()})
            now, digest = path, hashlib.sha256(ends.encode())
    if digest is not None:
        done.append({"path": now, "ends_sha256": digest.hexdigest()})
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("ends_sha256", pa.string())]))


def _merged(reach: DataFrame) -> DataFrame:
    """Nodes that reach over partitions' ends, each merged from what the partitions add to it."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    one = reach.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("tokens").alias("tokens"), *sums)
    above = F.when(F.col("depth") > 0, F.expr(f"substring(path, 1, (int(depth) - 1) * {TOKEN})"))
    one = written(one.withColumn("parent_path", above), "trie-merged")
    kids = one.filter("depth > 0").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("kids"))
    one = written(one.join(kids, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).withColumn("closed", F.col("n_children") - F.coalesce("kids", F.lit(0))).drop("kids"), "trie-children")
    own = one.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("depth"))).alias("d"), "path", ((F.col("n_convs") - 1) * F.col("tokens")).alias("own"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    under = own.groupBy(F.expr(f"substring(path, 1, int(d) * {TOKEN})").alias("path")).agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    ends = reach.filter("ends <> ''").select("path", "part", "ends").repartition("path").sortWithinPartitions("path", "part").mapInArrow(_ends, "path string, ends_sha256 string")
    parents = one.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    full = one.join(under, "path").join(ends, "path", "left").join(parents, "parent_path", "left")
    return written(full.select("path", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "closed", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256")), "trie-reach")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per node of the trie of all ``paths`` (columns conv_id and path, see ``token_of``): conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows are sorted by path and id over partitions, so equal paths, however many, are spread too. A partition's trie is
    built in one task from its own rows. Nodes that reach over a partition's ends are as many as the turns that its
    first or last path shares with its neighbour's; these alone are merged, by path, and their other nodes' parents
    looked up. The driver reads each partition's first and last path once, one after the other. Repeated ids count
    as often as they occur; an empty path ends at the root; no rows give no nodes. A path is held in one row, so 40
    bytes for each turn of a conversation.
    """
    spark = paths.sparkSession
    paths = written(paths.select("conv_id", "path"), "trie-paths")
    size = paths.agg(F.sum(F.length("path") + 16)).first()[0] or 0
    n = max(1, -(-size // PARTITION_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_BYTES)))
    # One row group a file, so that a file's rows are read by one task.
    ordered = paths.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").withColumn("part", F.spark_partition_id())
    ordered = written(ordered, "trie-sorted", **{"parquet.block.size": str(1 << 30)})
    bounds, before = {}, None
    for part, first, last in ordered.groupBy("part").agg(F.min("path"), F.max("path")).orderBy("part").toLocalIterator():
        left = _shared(before[1], first) if before else 0
        if before:
            bounds[before[0]][1] = left
        bounds[part], before = [left, 0], (part, last)
    schema = StructType.fromDDL(_NODE)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(part: int, seen: list[str], ids: list[list[int]]) -> Iterator[pa.RecordBatch]:
            held = []
            for row in _rows(part, seen, ids, *bounds[part]):
                held.append(row)
                if len(held) == 5000:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held = []
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

        now, seen, ids = None, [], []
        for b in batches:
            for part, path, conv in zip(b["part"].to_pylist(), b["path"].to_pylist(), b["conv_id"].to_pylist()):
                if part != now:
                    if seen:
                        yield from emit(now, seen, ids)
                    now, seen, ids = part, [], []
                if not seen or path != seen[-1]:
                    seen.append(path)
                    ids.append([])
                ids[-1].append(conv)
        if seen:
            yield from emit(now, seen, ids)

    forest = written(ordered.mapInArrow(tidied(run), schema), "trie-forest")
    reach = forest.filter("path is not null")
    if reach.filter("depth = 0").count() != len(bounds):
        raise RuntimeError("a partition of sorted paths was read by more than one task")
    merged = _merged(reach)
    looked = merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("reach_id"), F.col("closed").alias("n"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = forest.filter("path is null")
    hung = join_salted(inner.filter("parent_path is not null"), looked, ["parent_path"], ["conv_id"]).withColumn("parent_conv_id", F.col("reach_id"))
    return inner.filter("parent_path is null").select(*columns).union(hung.select(*columns)).union(merged.select(*columns))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each beginning with the first turns of its block of a hundred's first."""
    return prefix_trie(shared_heads(written(conversation_paths(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "conversation-paths")))


#: CRC-32 of a decimal id, bit by bit: each byte is added and shifted out over eight steps.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, s: xor(xor(a, s) >> 1, 3988292384 * (xor(a, s) & 1))), 4294967295)"
ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), told AS (
  SELECT *, substr(sha256(length(role) || ':' || role || text), 1, 32) || format('{{:08X}}', length(text)) AS token FROM said
), placed AS MATERIALIZED (
  SELECT conv_id, length(text) AS chars, token, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, token) AS place FROM told
), convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM placed)
), rebuilt AS (
  SELECT c.conv_id, p.place, p.token, p.chars FROM convs c JOIN placed p ON p.conv_id = c.base AND p.place <= c.h
  UNION ALL SELECT c.conv_id, p.place, p.token, p.chars FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h
), prefixes AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS depth, chars, string_agg(token, '') OVER w AS path FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), lengths AS (
  SELECT conv_id, max(depth) AS turns FROM prefixes GROUP BY conv_id
), nodes AS MATERIALIZED (
  SELECT path, depth, min(conv_id) AS conv_id, any_value(chars) AS chars, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN turns = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY path, depth
), kids AS (
  SELECT substr(path, 1, (depth - 1) * 40) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS MATERIALIZED (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)
), under AS (
  SELECT p.path, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved
  FROM full_nodes b JOIN prefixes p ON p.conv_id = b.conv_id AND p.depth <= b.depth GROUP BY p.path
)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN under u USING (path) LEFT JOIN full_nodes a ON n.depth > 0 AND a.path = substr(n.path, 1, (n.depth - 1) * 40)
"""
