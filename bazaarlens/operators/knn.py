"""Filtered exact nearest neighbours as a blocked join."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bazaarlens.functions.stats import cosine, similarity_rounded

#: Rows of either side in one product of matrices.
CHUNK = 2048
#: A block's cells are the root of its pairs of rows over so many chunks; a cell holds so many chunks of queries at most.
CELL, HELD = 4, 16
#: Partitions that cells are dealt out over, at most.
MOST_TASKS = 2000
#: Vectors of a block from which distances are taken, and what distances and similarities may be off by.
PIVOTS, SLACK = 8, 1e-6
#: Rows of a large block that show whether its rows lie in clusters, and the share of pairs of cells that must be apart in them for pruning.
PROBE, WORTH = 512, 0.1
#: Filters that a candidate also passes with an unknown value, where the query states one.
TOLERANT = ("completeness", "capacity_gb", "spec_generation", "form_factor")
#: Filters that a candidate passes only with the query's value, where the query states one: the blocking keys.
STRICT = ("category", "model_key")


def comparable(df: DataFrame) -> DataFrame:
    """Rows that are one whole working product at one price."""
    return df.filter(F.col("lot_size").isNull() & ~F.col("has_defect") & ~F.col("is_accessory") & ~F.col("price_is_from"))


def embedded(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embedding").isNotNull())


def assert_dimension(df: DataFrame, n: int, column: str = "embedding") -> DataFrame:
    """Fails on a vector of another length; null vectors pass."""
    ok = F.col(column).isNull() | (F.size(column) == n)
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.lit(f"vectors must have {n} numbers")).cast(df.schema[column].dataType)))


def l2_normalised(column: str = "embedding"):
    """A vector over its length; null for the zero vector."""
    v = F.col(column)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def _block(strict: tuple[str, ...]):
    """The stated keys of a query, written so that rows with other stated keys differ; null where none is stated counts too."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit(f"{c}="), F.col(c).cast("string")), F.lit(f"{c}?")) for c in strict])


def _best(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest finite values of each row, of equal ones those with the least ids: only what reaches a row's k-th value is sorted."""
    if sim.shape[1] > k:
        least = -np.partition(-sim, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero((sim >= least[:, None]) & np.isfinite(sim))
    else:
        row, col = np.nonzero(np.isfinite(sim))
    order = np.lexsort((ids[col], -sim[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


class _Nearest:
    """The ``k`` best candidates of each of some queries, kept while classes of candidates pass by.

    Numbers only: ``far`` holds similarities, negated, and ``ids`` the candidates, both sorted by (similarity, id).
    """

    def __init__(self, vectors: np.ndarray, codes: list[np.ndarray], k: int) -> None:
        self.vectors, self.codes, self.k = vectors, codes, k
        self.far = np.full((len(vectors), k), np.inf)
        self.ids = np.full((len(vectors), k), np.iinfo(np.int64).max)

    def meet(self, at: slice, vectors: np.ndarray, codes: list[np.ndarray], ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Queries ``at`` meet classes of candidates with equal vectors: ``ids`` in order, from ``start`` on ``size`` of each."""
        raw = self.vectors[at] @ vectors.T
        last = -self.far[at, -1]
        full = np.isfinite(last)
        row, col = np.nonzero(raw[full] >= last[full][:, None] - 1e-8)  # before rounding; what is below the last one kept needs no look
        row, sim = np.flatnonzero(full)[row], None
        if not full.all():
            some = np.flatnonzero(~full)
            sim = np.floor(raw[some] * 1e9 + 0.5) / 1e9
            sim[~np.isfinite(sim)] = -np.inf  # of vectors without length
            for q, c in zip(self.codes, codes, strict=True):
                mine = q[at][some][:, None]
                sim[(mine != -1) & (c != -1) & (mine != c)] = -np.inf
            r, c = _best(sim, ids[start], self.k)
            row, col = np.concatenate([row, some[r]]), np.concatenate([col, c])
        sim = np.floor(raw[row, col] * 1e9 + 0.5) / 1e9
        ok = sim >= last[row]
        for q, c in zip(self.codes, codes, strict=True):
            mine, other = q[at][row], c[col]
            ok &= (mine == -1) | (other == -1) | (mine == other)
        row, col, sim = row[ok], col[ok], sim[ok]
        if not len(row):
            return
        # a class that k others of its query are before, by similarity and least id, holds none of the k best
        order = np.lexsort((ids[start[col]], -sim, row))
        row, col, sim = row[order], col[order], sim[order]
        few = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        row, col, sim = row[few], col[few], sim[few]
        n = size[col]
        place = np.repeat(start[col] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row, far, found = np.repeat(row, n), np.repeat(-sim, n), ids[place]
        met = np.unique(row)
        mine = met + (at.start or 0)
        row = np.concatenate([row, np.repeat(met, self.k)])
        far, found = np.concatenate([far, self.far[mine].ravel()]), np.concatenate([found, self.ids[mine].ravel()])
        order = np.lexsort((found, far, row))
        row, far, found = row[order], far[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        row, place = row[keep] + (at.start or 0), place[keep]
        self.far[row, place], self.ids[row, place] = far[keep], found[keep]


def _unit(column: pa.Array) -> np.ndarray:
    v = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _coded(column: pa.Array, known: dict) -> np.ndarray:
    """Numbers of a filter's values, the same in all batches; -1 for null."""
    d = column.dictionary_encode()
    numbers = np.array([-1 if x is None else known.setdefault(x, len(known)) for x in d.dictionary.to_pylist()] + [-1], np.int32)
    return numbers[d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)]


_NEAR = "query_id long, near array<struct<far: double, listing_id: long>>"


def _told(ids: np.ndarray, best: _Nearest, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(ids), rows):
        far, found = best.far[i : i + rows], best.ids[i : i + rows]
        some = np.isfinite(far)
        ends = np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(far[some]), pa.array(found[some])], names=["far", "listing_id"]))
        hit = ends[1:] > ends[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + rows]), near], names=["query_id", "near"]).filter(pa.array(hit))


def _meetings(cell: list[str], tolerant: tuple[str, ...], k: int, chunk: int):
    """Arrow batches sorted by cell, queries first, to each query's ``k`` best in the cell.

    A cell's queries are held; its candidates pass by as they come, so any number of them can.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, best, known = None, [], None, [{} for _ in tolerant]
        for b in batches:
            if not len(b):
                continue
            same = np.ones(len(b) - 1, bool)
            for c in [*cell, "query"]:
                same &= np.asarray(pc.equal(b[c][1:], b[c][:-1]).to_numpy(zero_copy_only=False), bool)
            ends = [*(np.flatnonzero(~same) + 1).tolist(), len(b)]
            for i, j in zip([0, *ends[:-1]], ends, strict=True):
                part, at = b.slice(i, j - i), tuple(b[c][i].as_py() for c in cell)
                if at != now:
                    if best is not None:
                        yield from _told(ids, best)
                    now, asked, best = at, [], None
                vectors, codes = _unit(part["embedding"]), [_coded(part[t], x) for t, x in zip(tolerant, known, strict=True)]
                if part["query"][0].as_py():
                    asked.append((np.asarray(part["listing_id"]), vectors, codes))
                    continue
                if not asked:
                    continue
                if best is None:
                    ids = np.concatenate([x[0] for x in asked])
                    best = _Nearest(np.concatenate([x[1] for x in asked]), [np.concatenate(c) for c in zip(*(x[2] for x in asked), strict=True)], k)
                members, starts = np.asarray(part["ids"].flatten()), np.concatenate([[0], np.cumsum(np.asarray(part["ids"].value_lengths()))])
                for c in range(0, len(part), chunk):
                    c = slice(c, min(c + chunk, len(part)))
                    own = starts[c.start : c.stop + 1]
                    for q in range(0, len(ids), chunk):
                        best.meet(slice(q, min(q + chunk, len(ids))), vectors[c], [x[c] for x in codes], members[own[0] : own[-1]], own[:-1] - own[0], np.diff(own))
        if best is not None:
            yield from _told(ids, best)

    return run


def _distances(n: int):
    """Arrow batches with pivots (n unit vectors a row) to distances to them, and the nearest pivot's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [x for x in b.schema.names if x != "pivots"]
            if not len(b):
                continue
            v = np.asarray(b["embedding"].flatten(), np.float64).reshape(len(b), -1)
            v = v / np.sqrt((v * v).sum(1))[:, None]
            p = np.asarray(b["pivots"].flatten().flatten(), np.float64).reshape(len(b), n, -1)
            p = p / np.sqrt((p * p).sum(2))[:, :, None]
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,npd->np", v, p), 0))
            yield pa.RecordBatch.from_arrays([*(b[x] for x in names), pa.array(d.argmin(1).astype(np.int32)), *(pa.array(d[:, i]) for i in range(n))], names=[*names, "cell", *(f"d{i}" for i in range(n))])

    return run


def _dealt(rows: DataFrame, pivots: DataFrame, n: int, chunk: int, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with the chunk they are in: cell and part, each chunk's nearest and farthest distance from each pivot)."""
    schema = StructType([*rows.schema, *StructType.fromDDL("cell int, " + ", ".join(f"d{i} double" for i in range(n)))])
    far = keep(rows.join(pivots, "block").select(*rows.columns, "pivots").mapInArrow(_distances(n), schema))
    parts = far.groupBy("block", "cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    dealt = far.join(parts, ["block", "cell"]).withColumn("part", F.pmod(F.xxhash64("listing_id"), "parts").cast("int")).drop("parts")
    ranges = dealt.groupBy("block", "cell", "part").agg(*[f(f"d{i}").alias(f"{name}{i}") for i in range(n) for f, name in ((F.min, "lo"), (F.max, "hi"))])
    return dealt.select(*rows.columns, "cell", "part"), keep(ranges)


_PAIR = ["block", "qcell", "qpart", "ccell", "cpart"]


def _compared(qs: DataFrame, cs: DataFrame, cols: list[str], k: int, tolerant: tuple[str, ...], chunk: int, tasks: int) -> DataFrame:
    """Each cell (``_PAIR``) of queries and candidates by products of matrices, with its own k best of each query."""
    cols = [*cols, "ids"]
    none = F.lit(None).cast("array<bigint>")
    both = qs.withColumn("ids", none).select(*_PAIR, F.lit(True).alias("query"), *cols).unionByName(cs.select(*_PAIR, F.lit(False).alias("query"), *cols))
    dealt = both.repartition(min(MOST_TASKS, 1 + int(tasks)), *_PAIR).sortWithinPartitions(*_PAIR, F.desc("query"))
    return dealt.mapInArrow(_meetings(_PAIR, tolerant, k, chunk), _NEAR)


def _merged(near: DataFrame, k: int) -> DataFrame:
    """The k best of all of a query's lists, nearest first, then by id."""
    return near.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _probed(cs: DataFrame, n: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(block, pivots) of the large blocks that are worth pruning; ``cs`` has their candidates and in ``nc`` their number.

    Some ``PROBE`` candidates by their hash give n pivots. Where even among these rows hardly any two cells are apart,
    they are less so with all rows, and no pair of chunks could be skipped.
    """
    rows = keep(cs.withColumn("__h", F.xxhash64("listing_id")).filter(F.pmod("__h", F.greatest(F.lit(1), F.col("nc").cast("long") / PROBE).cast("long")) == 0).select("block", "listing_id", "embedding", "__h"))
    few = rows.withColumn("__r", F.row_number().over(Window.partitionBy("block").orderBy("__h", "listing_id"))).filter(F.col("__r") <= n)
    pivots = few.groupBy("block").agg(F.collect_list("embedding").alias("p")).select("block", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("p", i % F.size("p"))).alias("pivots"))
    pivots = keep(pivots)
    schema = StructType([*rows.schema, *StructType.fromDDL("cell int, " + ", ".join(f"d{i} double" for i in range(n)))])
    far = rows.join(pivots, "block").select(*rows.columns, "pivots").mapInArrow(_distances(n), schema)
    cells = keep(far.groupBy("block", "cell").agg(*[f(f"d{i}").alias(f"{name}{i}") for i in range(n) for f, name in ((F.min, "lo"), (F.max, "hi"))]))
    x, y = cells.alias("x"), cells.alias("y")
    apart = F.greatest(*[F.greatest(F.col(f"x.lo{i}") - F.col(f"y.hi{i}"), F.col(f"y.lo{i}") - F.col(f"x.hi{i}")) for i in range(n)]) > SLACK
    worth = x.join(y, F.col("x.block") == F.col("y.block")).groupBy(F.col("x.block").alias("block")).agg((F.count_if(apart) >= WORTH * F.count("*")).alias("worth")).filter("worth")
    return keep(pivots.join(worth.select("block"), "block"))


def _pruned(qs: DataFrame, cs: DataFrame, pivots: DataFrame, cols: list[str], k: int, tolerant: tuple[str, ...], chunk: int, n: int, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(neighbours within the blocks of ``pivots``, all pairs of chunks with ``compared``).

    Rows lie in chunks with those nearest to the same of n pivots. A query is first compared with its own pivot's
    chunks, which gives each of its chunk's queries a k-th similarity. By the triangle inequality two chunks are as far
    apart as their distances from any pivot differ; a pair that this puts below all those similarities is skipped.
    """
    (q, qr), (c, cr) = (_dealt(rows, pivots, n, chunk, keep) for rows in (qs, cs))
    side = lambda r, x: r.select("block", F.col("cell").alias(f"{x}cell"), F.col("part").alias(f"{x}part"), *[F.col(f"{v}{i}").alias(f"{x}{v}{i}") for i in range(n) for v in ("lo", "hi")])
    apart = F.greatest(F.lit(0.0), *[F.greatest(F.col(f"qlo{i}") - F.col(f"chi{i}"), F.col(f"clo{i}") - F.col(f"qhi{i}")) for i in range(n)])
    apart = F.greatest(F.lit(0.0), apart - SLACK)
    pairs = side(qr, "q").join(side(cr, "c"), "block").select(*_PAIR, (1 - apart * apart / 2).alias("most"), (F.col("qcell") == F.col("ccell")).alias("home"))
    q = q.withColumnsRenamed({"cell": "qcell", "part": "qpart"})
    c = c.withColumnsRenamed({"cell": "ccell", "part": "cpart"})
    pairs = keep(pairs)
    run = lambda own: _compared(q.join(own, ["block", "qcell", "qpart"]), c.join(own, ["block", "ccell", "cpart"]), cols, k, tolerant, chunk, own.count())
    first = keep(_merged(run(pairs.filter("home").select(*_PAIR)), k))
    reached = first.select(F.col("query_id").alias("listing_id"), F.when(F.size("near") == k, -F.element_at("near", -1)["far"]).alias("kth"))
    least = q.join(reached, "listing_id", "left").groupBy("block", "qcell", "qpart").agg(F.min(F.coalesce("kth", F.lit(-2.0))).alias("least"))
    told = keep(pairs.join(least, ["block", "qcell", "qpart"]).select(*_PAIR, (F.col("home") | (F.col("most") >= F.col("least") - SLACK)).alias("compared"), "home"))
    rest = run(told.filter("compared and not home").select(*_PAIR))
    return first.unionByName(rest), told


def _blocks(queries: DataFrame, candidates: DataFrame, strict: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the block of the strict keys that a query states: a candidate is in the block of each set of its keys."""
    patterns = [tuple(c for i, c in enumerate(strict) if stated >> i & 1) for stated in range(1 << len(strict))]
    named = [(on, F.concat(F.lit("/".join(on) + ":"), _block(on) if on else F.lit(""))) for on in patterns]
    stated = lambda on: reduce(lambda a, c: a & (F.col(c).isNotNull() if c in on else F.col(c).isNull()), strict, F.lit(True))
    known = lambda on: reduce(lambda a, c: a & F.col(c).isNotNull(), on, F.lit(True))
    q = queries.select(F.coalesce(*[F.when(stated(on), tag) for on, tag in named]).alias("block"), "*")
    return q, candidates.select(F.explode(F.array_compact(F.array(*[F.when(known(on), tag) for on, tag in named]))).alias("block"), "*")


def _spread(all_q: DataFrame, all_c: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt out over all pairs of the ``qs`` and ``cs`` parts of their block."""
    deal = lambda df, own, other: df.join(sizes.select("block", "qs", "cs"), "block").select(*df.columns, F.pmod(F.xxhash64("listing_id"), own).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs"))
    zero = [F.lit(0).alias("qcell"), F.lit(0).alias("ccell")]
    qs = deal(all_q, "qs", "cs").withColumnsRenamed({"mine": "qpart", "theirs": "cpart"}).select("*", *zero)
    return qs, deal(all_c, "cs", "qs").withColumnsRenamed({"mine": "cpart", "theirs": "qpart"}).select("*", *zero)


def _sizes(all_q: DataFrame, all_c: DataFrame, chunk: int) -> DataFrame:
    """Blocks that both sides have: rows (nc, nq), chunks (cn, qn) and parts (cs, qs) of candidates and queries.

    The cells of a block, pairs of parts, grow with the root of its pairs of rows: so do their number and their work,
    and a part of one side is repeated for each of the other's. A cell holds at most ``HELD`` chunks of queries.
    """
    n = all_c.groupBy("block").agg(F.count("*").alias("nc")).join(all_q.groupBy("block").agg(F.count("*").alias("nq")), "block")
    n = n.select("*", F.ceil(F.col("nc") / chunk).cast("int").alias("cn"), F.ceil(F.col("nq") / chunk).cast("int").alias("qn"))
    cells = F.ceil(F.sqrt(F.col("nc").cast("double") * F.col("nq")) / (CELL * chunk))
    n = n.withColumn("cs", F.greatest(F.lit(1), F.least(cells, F.ceil(F.sqrt(cells * F.col("nc") / F.col("nq"))), F.col("cn"))).cast("int"))
    return n.withColumn("qs", F.greatest(F.lit(1), F.ceil(cells / F.col("cs")), F.ceil(F.col("qn") / HELD)).cast("int"))


def _hash(column: str = "embedding"):
    return F.xxhash64(column)


def _vectors(queries: DataFrame, candidates: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides with ``vec``, which names their vector, in place of it, and the different vectors (vec, embedding).

    A vector's name is its hash, and its place among the vectors of the same hash where there are several.
    """
    q, c = (df.withColumn("__hash", _hash()) for df in (queries, candidates))
    some = q.select("__hash", "embedding").unionByName(c.select("__hash", "embedding")).filter(F.col("embedding").isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy("__hash").orderBy("embedding"))
    vectors = keep(some.withColumn("__place", place))
    twice = vectors.filter("__place > 1").select("__hash").distinct()
    if twice.limit(1).count():
        also = vectors.join(twice, "__hash").select(F.col("__hash").alias("__also"), F.col("embedding").alias("__own"), "__place")
        q, c = (df.join(also, (F.col("__hash") == F.col("__also")) & (F.col("embedding") == F.col("__own")), "left").drop("__also", "__own") for df in (q, c))
    else:
        q, c = (df.withColumn("__place", F.lit(1)) for df in (q, c))
    name = F.struct(F.col("__hash").alias("hash"), F.coalesce("__place", F.lit(1)).alias("place"))
    q, c = (df.withColumn("vec", F.when(F.col("embedding").isNotNull(), name)).drop("embedding", "__hash", "__place") for df in (q, c))
    return q, c, vectors.select(name.alias("vec"), "embedding")


def knn_lists(queries: DataFrame, candidates: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None, k: int = 10, strict: tuple[str, ...] = STRICT, tolerant: tuple[str, ...] = TOLERANT, chunk: int = CHUNK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries' listing_id and class_id, each class's nearest candidates, the pairs of chunks with whether they were ``compared``).

    Queries of equal vectors and keys are one class, and so are candidates. Each class of queries has one row (class_id,
    near), ``near`` being structs (far: similarity, negated, and listing_id) of the k + 1 nearest, in order: a query is
    no neighbour of its own, but may be among those of its class, so its k nearest are the first k others (``nearest``).
    """
    prune, keep = keep is not None, keep or (lambda df: df)
    own = ["vec", *strict, *tolerant]
    q, c, vectors = _vectors(queries, candidates, keep)
    key = F.struct(*own).alias("__key")  # equal where the same parts are null
    few = F.row_number().over(Window.partitionBy(*own).orderBy("listing_id"))
    c = c.filter(F.col("vec").isNotNull()).select("listing_id", *own).withColumn("__r", few).filter(F.col("__r") <= k + 1)
    c = keep(c.groupBy(*own).agg(F.min("listing_id").alias("__least"), F.array_sort(F.collect_list("listing_id")).alias("ids")).withColumnRenamed("__least", "listing_id"))
    classes = keep(q.filter(F.col("vec").isNotNull()).groupBy(*own).agg(F.min("listing_id").alias("listing_id")))
    all_q, all_c = _blocks(classes, c, strict)
    cols = ["listing_id", "embedding", *tolerant]
    sizes = keep(_sizes(all_q, all_c, chunk))
    all_q, all_c = (df.join(vectors, "vec").select("block", *cols, *(x for x in ("ids",) if x in df.columns)) for df in (all_q, all_c))
    large = sizes.filter((F.col("cn") > 1) | (F.col("qn") > 1))
    worth = None
    if prune and large.limit(1).count():
        worth = _probed(all_c.join(large.select("block", "nc"), "block"), pivots, keep)
        worth = worth if worth.limit(1).count() else None
    flat = sizes if worth is None else sizes.join(worth.select("block"), "block", "left_anti")
    parts, tasks = flat.agg(F.max("cs"), F.sum(F.col("nc").cast("double") * F.col("nq")) / (2 * chunk * chunk) + F.sum(F.col("nc") * F.col("qs") + F.col("nq") * F.col("cs")) / (16 * chunk)).first()
    near = _compared(*_spread(all_q, all_c, flat), cols, k + 1, tolerant, chunk, tasks or 0)
    part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = flat.select("block", "cn", part("qn").alias("qpart")).select("block", F.lit(0).alias("qcell"), "qpart", F.lit(0).alias("ccell"), part("cn").alias("cpart"), F.lit(True).alias("compared"))
    if worth is not None:
        blocks = worth.select("block")
        more, told = _pruned(all_q.join(blocks, "block"), all_c.join(blocks, "block"), worth, cols, k + 1, tolerant, chunk, pivots, keep)
        near, pairs = near.unionByName(more), pairs.unionByName(told.drop("home"))
    if worth is not None or (parts or 0) > 1:
        near = _merged(near, k + 1)
    asked = q.filter(F.col("vec").isNotNull()).select("listing_id", key).join(classes.select(key, F.col("listing_id").alias("class_id")), "__key").drop("__key")
    return asked, near.withColumnRenamed("query_id", "class_id"), pairs


def nearest(near, own, k: int):
    """Of a class's ``near``, the k nearest of the query ``own``: structs (far, listing_id), in order."""
    return F.slice(F.filter(near, lambda x: x["listing_id"] != own), 1, k)


def knn_with_pairs(queries: DataFrame, candidates: DataFrame, keep: Callable[[DataFrame], DataFrame] | None, k: int = 10, strict: tuple[str, ...] = STRICT, tolerant: tuple[str, ...] = TOLERANT, chunk: int = CHUNK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """``knn``, and the pairs of chunks with whether they were ``compared``."""
    cols = ["listing_id", "embedding", *strict, *tolerant]
    asked, near, pairs = knn_lists(queries.select(cols), candidates.select(cols), keep, k, strict, tolerant, chunk, pivots)
    rows = asked.join(near, "class_id").select(F.col("listing_id").alias("query_id"), F.posexplode(nearest(F.col("near"), F.col("listing_id"), k)).alias("place", "x"))
    return rows.select("query_id", F.col("x.listing_id").alias("listing_id"), (-F.col("x.far")).alias("similarity"), (F.col("place") + 1).alias("rank")), pairs


def knn(queries: DataFrame, candidates: DataFrame, k: int = 10, strict: tuple[str, ...] = STRICT, tolerant: tuple[str, ...] = TOLERANT, chunk: int = CHUNK, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (query_id, listing_id, similarity, rank): the k candidates most like each query, nearest first, then by id.

    Both sides have listing_id and embedding; queries without a vector have no rows. Rows of equal vectors and keys
    are compared as one (``knn_lists``), and what is found is dealt out to them last, without a shuffle. Each query is
    matched inside the block of the strict keys that it states: the queries are sorted by which keys those are, so
    every join is an equality. A block of many rows is dealt out over cells, pairs of a part of either side
    (``_sizes``); in a cell the queries are held while the candidates pass by, by products of matrices of bounded size,
    and the k best of a query's cells are the answer, as top-k of a union is. With ``keep``, which writes an
    intermediate result as a table and returns that, nothing is computed twice, and large blocks whose rows lie in
    clusters (``_probed``) have chunks of rows that are near each other, and pairs of chunks that cannot hold one of the
    k best are skipped (``_pruned``); the rows are the same.
    """
    return knn_with_pairs(queries, candidates, keep, k, strict, tolerant, chunk)[0]


def knn_expressions(queries: DataFrame, candidates: DataFrame, k: int = 10, strict: tuple[str, ...] = STRICT, tolerant: tuple[str, ...] = TOLERANT) -> DataFrame:
    """The same by a join and a ranked window, for queries that state all strict keys: for small inputs and as a check."""
    cols = ["listing_id", "embedding", *strict, *tolerant]
    q, c = embedded(queries).select(cols).alias("q"), embedded(candidates).select(cols).alias("c")
    on = [F.col(f"q.{s}") == F.col(f"c.{s}") for s in strict] + [F.col("q.listing_id") != F.col("c.listing_id")]
    on += [F.col(f"q.{t}").isNull() | F.col(f"c.{t}").isNull() | (F.col(f"q.{t}") == F.col(f"c.{t}")) for t in tolerant]
    rows = q.join(c, on).select(F.col("q.listing_id").alias("query_id"), F.col("c.listing_id").alias("listing_id"), similarity_rounded(cosine(F.col("q.embedding"), F.col("c.embedding"))).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "listing_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
