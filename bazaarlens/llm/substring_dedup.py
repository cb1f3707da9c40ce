"""Near-duplicate passages by compact windows over min-hashes of word runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.common import join_salted, join_sized, small_batches, written
from bazaarlens.llm.words import blocks, mix, seeds, shingles, tidied, word_hashes

#: Words in a run, words in the shortest passage, hash functions, and the similarity that a passage reaches.
WORDS, PASSAGE, HASHES, SIMILARITY = 5, 50, 2, 0.8
#: Different windows of one signature in a block; larger groups are dealt out over pairs of blocks.
BLOCK = 512
#: Windows of a group from which on they are compared by a product of matrices, not pair by pair.
LARGE = 32
_LOW = np.uint64(0xFFFF)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each stretch of ``width`` places, by its first place; empty where there is none.

    The running least from each multiple of ``width`` on, and that back to it, meet in every stretch.
    """
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, 1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def compact_windows(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (l, c, r) of at least ``width`` places in texts side by side: c has the least value of each stretch of ``width`` places between l and r that holds c.

    The c are the nodes of each text's Cartesian tree over the values whose subtree has ``width`` places or more; of
    equal values the first counts as the least. They are the least values of all stretches of ``width`` places, which a
    sliding minimum gives for all texts at once; windows reach no further from c than such a stretch does. ``r`` is
    exclusive. Each stretch of ``width`` places lies in the window of exactly one c in it, and longer ones in several.
    """
    n = len(values)
    held = (values & ~_LOW) | (np.arange(n, dtype=np.uint64) & _LOW)  # the place makes equal values differ, and is read off again
    least = sliding_least(held, width)
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    start = np.flatnonzero(text[: len(least)] == text[width - 1 :])
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    own = least[start]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (text[start[1:]] != text[start[:-1]])])
    lo = start[new]
    hi = start[np.concatenate([new[1:], [True]])] + width
    c = lo + ((own[new] - lo.astype(np.uint64)) & _LOW).astype(np.int64)
    return lo, c, hi


def longest(hit: np.ndarray, bounds: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of hits side by side: first place and end of each row's longest stretch that starts and ends with a hit and has ``cost`` hits for each miss; both 0 where it has no hit."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n + 1)
    inner = np.ones(len(row), bool)
    inner[bounds[:-1] + np.arange(len(n))] = False
    step = np.zeros(len(row))
    step[inner] = np.where(hit, 1.0, -cost)
    run = np.cumsum(step)
    # rows are moved down, each below all before it, so that lows of one row are never those of another
    run -= np.repeat(run[bounds[:-1] + np.arange(len(n))], n + 1) + row * ((cost + 1) * (2 * n.max(initial=0) + 2))
    where = np.flatnonzero(hit)
    if not len(where):
        return np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    node = np.flatnonzero(inner)[where]  # stretches end behind a hit
    own = row[node]
    begin = np.searchsorted(-np.minimum.accumulate(run), -run[node] - 1e-6, "left") - own
    begin = where[np.searchsorted(where, begin)]  # and start at the first hit from where they may
    size = where + 1 - begin
    lead = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    most = np.repeat(np.maximum.reduceat(size, lead), np.diff(np.append(lead, len(own))))
    best = np.flatnonzero(size == most)
    best = best[np.concatenate([[True], own[best][1:] != own[best][:-1]])]  # of equal ones the first
    first, end = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    first[own[best]], end[own[best]] = begin[best] - bounds[own[best]], where[best] + 1 - bounds[own[best]]
    return first, end


def segments(hit: np.ndarray, width: int, cost: float) -> list[tuple[int, int]]:
    """Disjoint stretches of at least ``width`` places that start and end with a hit and have ``cost`` hits for each miss: the longest, then those beside it."""
    out, todo = [], [(0, len(hit))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < width or hit[lo:hi].sum() * (1 + cost) < width * cost:
            continue
        (a,), (b,) = longest(hit[lo:hi], np.array([0, hi - lo]), cost)
        if b - a >= width:
            out.append((lo + int(a), lo + int(b)))
            todo += [(lo, lo + int(a)), (lo + int(b), hi)]
    return sorted(out)


def _windows(n: int, width: int, hashes: int):
    """Rows (sig, id, at): of each window, one for each side of c with half a passage of room; ``at`` packs c, and the room left and right of it.

    A passage that holds c holds half a passage on one side of it, or on the other. The signature joins the least value
    with the least of that side by another hash, so that windows that merely share a common line rarely meet.
    """
    half = (width + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (other,) = seeds(1, 11)
        for batch in batches:
            for first, texts in blocks(batch.column("text")):
                grams, at = shingles(*word_hashes(texts), n)
                if len(grams) < width:
                    continue
                side = sliding_least(mix((grams ^ (other >> np.uint64(9))) * other), half)
                for k, m in enumerate(seeds(hashes, 7)):
                    values = mix((grams ^ m) * m)
                    lo, c, hi = compact_windows(values, at, width)
                    for right in (False, True):
                        use = np.flatnonzero(hi - c >= half if right else c - lo + 1 >= half)
                        if not len(use):
                            continue
                        at_c = c[use]
                        sig = mix(values[at_c] + side[at_c if right else at_c - half + 1] * np.uint64(3) + np.uint64(2 * k + right))
                        row = np.searchsorted(at, at_c, "right") - 1
                        packed = ((at_c - at[row]) << 16) | ((at_c - lo[use]) << 8) | (hi[use] - at_c)
                        yield pa.record_batch({"sig": pa.array(sig.view(np.int64)), "id": batch.column("id").take(pa.array(row + first)), "at": pa.array(packed)})

    return tidied(run)


def _grams(n: int):
    """Rows (id, grams): 32 bits of the hash of each run, which are enough to compare two stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column("text")):
                grams, at = shingles(*word_hashes(texts), n)
                short = grams.astype("<u4")
                yield pa.record_batch({"id": batch.column("id").slice(first, len(texts)), "grams": pa.array([short[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    return tidied(run)


def _alike(one: np.ndarray, two: np.ndarray) -> float:
    one, two = np.unique(one), np.unique(two)
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both / (len(one) + len(two) - both)


def _within(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among ``some``."""
    held = np.sort(some)
    at = np.searchsorted(held, values)
    return (held[np.minimum(at, len(held) - 1)] == values) if len(held) else np.zeros(len(values), bool)


def _taken(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of stretches laid side by side, and the stretches' bounds in them."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1]), bounds


def _segments_of(hit: np.ndarray, bounds: np.ndarray, width: int, cost: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``segments`` (row, a, b) of rows of hits side by side: the longest of all rows at once, then those beside them."""
    hits = np.concatenate([[0], np.cumsum(hit)])
    row, lo, hi = np.arange(len(bounds) - 1), bounds[:-1], bounds[1:]
    out = []
    while len(row):
        may = (hi - lo >= width) & ((hits[hi] - hits[lo]) * (1 + cost) >= width * cost)
        row, lo, hi = row[may], lo[may], hi[may]
        places, at = _taken(lo, hi - lo)
        dense = _dense(hit[places], at, width, cost)
        row, lo, hi = row[dense], lo[dense], hi[dense]
        places, at = _taken(lo, hi - lo)
        a, b = longest(hit[places], at, cost)
        good = b - a >= width
        row, lo, hi, a, b = row[good], lo[good], hi[good], a[good], b[good]
        out.append((row, lo + a, lo + b))
        row, lo, hi = np.concatenate([row, row]), np.concatenate([lo, lo + b]), np.concatenate([lo + a, hi])
    row, a, b = (np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in range(3))
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    return row, a - bounds[row], b - bounds[row]


def _main_segments(hit: np.ndarray, bounds: np.ndarray, width: int, cost: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of hits side by side: the first of each row's ``segments`` to be found (both 0 where there is none), and whether others may lie beside it."""
    first, end = longest(hit, bounds, cost)
    none = end - first < width
    first[none] = end[none] = 0
    hits = np.concatenate([[0], np.cumsum(hit)])
    more = np.zeros(len(first), bool)
    for lo, hi in ((bounds[:-1], bounds[:-1] + first), (bounds[:-1] + end, bounds[1:])):
        more |= ~none & (hi - lo >= width) & ((hits[hi] - hits[lo]) * (1 + cost) >= width * cost)
    return first, end, more


def _side_by_side(some: list[np.ndarray], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``rows`` in a row, and the rows' bounds in them."""
    return np.concatenate([some[k] for k in rows]), np.concatenate([[0], np.cumsum([len(some[k]) for k in rows])])


def _dense(hit: np.ndarray, bounds: np.ndarray, width: int, cost: float) -> np.ndarray:
    """Of which rows of hits side by side the ``longest`` stretch has at least ``width`` places."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    down = row * (2.0 * n.max(initial=0) + 1)  # each row lies below all before it
    run = np.concatenate([[0], np.cumsum(np.where(hit, 1.0, -cost))])
    lows = np.minimum.accumulate(np.where(hit, run[:-1] - down, np.inf))
    last = np.flatnonzero(hit & (np.arange(len(row)) - bounds[row] >= width - 1))
    out = np.zeros(len(n), bool)
    out[row[last[lows[last - width + 1] <= (run[1:] - down)[last] + 1e-6]]] = True
    return out


def _may_hold(owns: list[np.ndarray], nears: list[np.ndarray], rows: list[int], width: int, cost: float) -> list[int]:
    """Rows of which own and near may each have a stretch of at least ``width`` places with ``cost`` values that the other holds for each that it does not.

    Values are told apart by their low bits only, so stretches may be seen where there are none, but none is left out.
    """
    (mine, at), (yours, there) = _side_by_side(owns, rows), _side_by_side(nears, rows)
    size, far = np.diff(at), np.diff(there)
    slots = np.left_shift(1, np.ceil(np.log2(np.maximum(np.maximum(size, far), 1) * 32)).astype(np.int64))
    begin = np.cumsum(slots) - slots
    one, two = (np.repeat(begin, n) + (some & np.repeat(slots - 1, n)) for some, n in ((mine, size), (yours, far)))
    held = []
    for some, other in ((one, two), (two, one)):
        table = np.zeros(int(slots.sum()), bool)
        table[other] = True
        held.append(table[some])
    return np.array(rows)[_dense(held[0], at, width, cost) & _dense(held[1], there, width, cost)].tolist()


def _moved(owns: list[np.ndarray], nears: list[np.ndarray], rows: list[int], width: int, similarity: float) -> list[tuple[int, int, int, int, int, float]]:
    """``passages_between`` of rows where words were put in or left out: stretches that own and near hold in any order.

    All rows are compared side by side by their longest stretches; those where others may lie beside these follow one by one.
    """
    loose, strict = similarity / (1 - similarity), 2 * similarity / (1 - similarity)  # misses on one side count, or on both
    rows = _may_hold(owns, nears, rows, width, loose)
    if not rows:
        return []
    per_row = lambda keys: np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=rows[-1] + 1)
    (mine, at), (yours, there) = _side_by_side(owns, rows), _side_by_side(nears, rows)
    mine, yours = (some.astype(np.uint64) | np.repeat(np.array(rows, np.uint64) << np.uint64(32), np.diff(bounds)) for some, bounds in ((mine, at), (yours, there)))
    held, back = _within(mine, yours), _within(yours, mine)
    # rows where those of either that the other holds lie too thin have no passage
    todo = np.flatnonzero(_dense(held, at, width, loose) & _dense(back, there, width, loose))
    out = []
    for cost in (loose, strict):
        if not len(todo):
            break
        places, bounds = _taken(at[todo], at[todo + 1] - at[todo])
        a, b, single = _main_segments(held[places], bounds, width, cost)
        by_one = todo[single]
        now, a, b = (v[(b > a) & ~single] for v in (todo, a, b))
        part, (places, bounds) = mine[_taken(at[now] + a, b - a)[0]], _taken(there[now], there[now + 1] - there[now])
        x, y, single = _main_segments(_within(yours[places], part), bounds, width, cost)
        by_one = np.concatenate([by_one, now[single]])
        now, a, b, x, y = (v[(y > x) & ~single] for v in (now, a, b, x, y))
        one, two = np.unique(mine[_taken(at[now] + a, b - a)[0]]), np.unique(yours[_taken(there[now] + x, y - x)[0]])
        k = np.array(rows)[now]
        both, any_of = per_row(one[_within(one, two)])[k], (per_row(one) + per_row(two))[k]
        score = both / (any_of - both)
        found = [v for v in zip(*(z.tolist() for z in (k, a, b, x, y, score)), strict=True) if v[5] >= similarity]
        for n in by_one.tolist():
            k = rows[n]
            for a, b in segments(held[at[n] : at[n + 1]], width, cost):
                for x, y in segments(np.isin(nears[k], owns[k][a:b]), width, cost):
                    if (score := _alike(owns[k][a:b], nears[k][x:y])) >= similarity:
                        found.append((k, a, b, x, y, score))
        out += found
        todo = todo[~np.isin(np.array(rows)[todo], [v[0] for v in found])]
    return out


def passages_between(owns: list[np.ndarray], nears: list[np.ndarray], aligned: np.ndarray, width: int, similarity: float) -> list[tuple[int, int, int, int, int, float]]:
    """Stretches (row, a, b, x, y, similarity) of a row's own runs from a to b that its near ones hold from x to y.

    Own's first place is aligned with near's place ``aligned``. All rows are compared side by side, place by place, and
    those where words were put in or left out then by what they hold anywhere (``_moved``).
    """
    size, far = np.array([len(x) for x in owns], np.int64), np.array([len(x) for x in nears], np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)])
    own, near = np.concatenate(owns), np.concatenate(nears)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(own)) - bounds[row] + aligned[row]
    inside = (place >= 0) & (place < far[row])
    hit = np.zeros(len(own), bool)
    hit[inside] = own[inside] == near[(np.cumsum(far) - far)[row[inside]] + place[inside]]
    strict = 2 * similarity / (1 - similarity)  # misses on both sides count
    hits = np.concatenate([[0], np.cumsum(hit)])
    k, a, b = _segments_of(hit, bounds, width, strict)
    full = hits[bounds[k] + b] - hits[bounds[k] + a] == b - a
    out = []
    for k, a, b, same, shift in zip(*(x.tolist() for x in (k, a, b, full, aligned[k])), strict=True):
        score = 1.0 if same else _alike(owns[k][a:b], nears[k][a + shift : b + shift])
        if score >= similarity:
            out.append((k, a, b, a + shift, b + shift, score))
    some = np.zeros(len(size), bool)
    some[[x[0] for x in out]] = True
    rest = np.flatnonzero(~some).tolist()
    if rest:
        out += _moved(owns, nears, rest, width, similarity)
    return out


def _verified(n: int, width: int, similarity: float):
    """Of rows (id, other, shift, lo, base, own, near): the passages of own (places from lo) that lie in near (places from base)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            shift, lo, base = (np.asarray(batch.column(c), np.int64) for c in ("shift", "lo", "base"))
            owns, nears = (_arrays(batch.column(c), "<u4") for c in ("own", "near"))
            found = passages_between(owns, nears, lo - shift - base, width, similarity)
            if found:
                k, a, b, x, y, score = (np.array(c) for c in zip(*found, strict=True))
                part = batch.take(pa.array(k))
                places = [pa.array(v, pa.int32()) for v in (lo[k] + a, lo[k] + b + n - 1, base[k] + x, base[k] + y + n - 1)]
                yield pa.record_batch([part.column("id"), part.column("shift"), *places[:2], part.column("other"), *places[2:], pa.array(score, pa.float64())], names=["id", "shift", "first_word", "end_word", "other", "other_first", "other_end", "similarity"])

    return tidied(run)


def _arrays(column: pa.Array, kind: str) -> list[np.ndarray]:
    """The values of a binary column without nulls as arrays over its own memory."""
    if not len(column):
        return []
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    flat = (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[ends[0] : ends[-1]].view(kind)
    ends = ((ends - ends[0]) // np.dtype(kind).itemsize).tolist()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column, body, has 32 bits of each run, with 16 bits of each."""
    for batch in batches:
        bodies = [b[::2].tobytes() for b in _arrays(batch.column("body"), "<u2")]
        yield pa.record_batch([*batch.columns[:-1], pa.array(bodies, pa.binary())], names=batch.schema.names)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches again, rows with equal ``keys`` never in two batches."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        new = np.any([np.asarray(rows.column(k))[1:] != np.asarray(rows.column(k))[:-1] for k in keys], axis=0)
        last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last)
    if held is not None:
        yield held


def _roots(parent: np.ndarray) -> np.ndarray:
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def _fewest(flat: np.ndarray, row: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Of rows of values (below 2048) side by side: the least number of different values in any ``width`` places of a row."""
    place = np.arange(len(flat)) - (np.cumsum(size) - size)[row]
    columns = int(size.max()) + 1
    order = np.sort((row * 2048 + flat) * columns + place)  # by row, value and place
    same = np.flatnonzero(order[1:] // columns == order[:-1] // columns)
    last = np.full(len(flat), -1)
    last[(np.cumsum(size) - size)[order[same] // (columns * 2048)] + order[same + 1] % columns] = order[same] % columns
    # a value counts where a stretch starts behind its last place before
    count = lambda at: np.bincount(row * columns + at, minlength=len(size) * columns)
    step = (count(np.maximum(last + 1, place - width + 1).clip(0)) - count(place + 1)).reshape(len(size), columns)
    return np.where(np.arange(columns) <= size[:, None] - width, np.cumsum(step, 1), 1 << 30).min(1)


def _pairs_in_small(code: np.ndarray, row: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, codes in common) of each row i with all rows from the ``first`` of its group up to it, pair by pair."""
    n = len(first)
    bits = np.zeros((n, 256), np.uint8)
    np.bitwise_or.at(bits, (row, code >> 3), (1 << (code & 7)).astype(np.uint8))
    bits = bits.view(np.uint64)
    before = np.arange(n) - first
    begin = 0
    while begin < n:
        stop = max(begin + 1, int(np.searchsorted(np.cumsum(before[begin:]), 100_000, "right")) + begin)
        i = np.repeat(np.arange(begin, stop), before[begin:stop])
        j = np.arange(len(i)) - np.repeat(np.cumsum(before[begin:stop]) - before[begin:stop] - first[begin:stop], before[begin:stop])
        yield i, j, np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
        begin = stop


def _pairs_in_large(code: np.ndarray, row: np.ndarray, side: np.ndarray, fewest: np.ndarray, chunk: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, codes in common) of the rows of one group with enough codes in common, by products of matrices; those of one side with the other only, where it has two."""
    held = np.zeros((len(side), 2048), np.float32)
    held[row, code] = 1
    whole = bool(side[0] == 2)
    ones, twos = (np.flatnonzero(side == k) for k in ((2, 2) if whole else (1, 0)))
    others = held[twos].T
    for begin in range(0, len(ones), chunk):
        i = ones[begin : begin + chunk]
        j = twos[: begin + len(i)] if whole else twos
        score = held[i] @ others[:, : len(j)]
        x, y = np.nonzero((score >= fewest[i][:, None] + (fewest[j] - 0.5)) & ((j < i[:, None]) | (not whole)))
        yield np.maximum(i[x], j[y]), np.minimum(i[x], j[y]), score[x, y].astype(np.int64)


def linked_pairs(bodies: list[np.ndarray], left: np.ndarray, doc: np.ndarray, group: np.ndarray, side: np.ndarray, linked: np.ndarray, width: int, similarity: float, few: int = 4) -> list[tuple[int, int]]:
    """Pairs (later row, earlier row) of windows with a passage in common that connect all windows of a group that such pairs connect.

    Rows of one ``group`` lie together; windows of one ``side`` of it are compared with those of the other (side 0 or 1),
    or all with each other where the group has one side (2). Rows that are ``linked`` count as connected already. All
    pairs are compared by how many different runs they have in common; a pair that has as many as the stretches of
    ``width`` places with the fewest need is verified, unless its windows are connected by then.
    """
    n = len(bodies)
    first = np.searchsorted(group, group, "left")
    size = np.array([len(b) for b in bodies], np.int64)
    row = np.repeat(np.arange(n), size)
    code = mix(np.concatenate(bodies).astype(np.uint64)).astype(np.int64) & 2047
    fewest = _fewest(code, row, size, width) * (similarity / (1 + similarity))
    ones, twos, scores = [], [], []

    def add(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
        use = ~(linked[i] & linked[j]) & (doc[i] != doc[j]) & ((side[i] == 2) | (side[i] != side[j]))
        use &= score >= fewest[i] + fewest[j] - 0.5  # k runs of a passage that share a bit with others take at most k / 9 off
        ones.append(i[use])
        twos.append(j[use])
        scores.append(score[use])

    at = np.concatenate([[0], np.cumsum(size)])
    lead = np.flatnonzero(first == np.arange(n))
    count = np.diff(np.append(lead, n))
    for begin, stop in zip(lead[count >= LARGE], (lead + count)[count >= LARGE]):
        own = slice(at[begin], at[stop])
        for i, j, score in _pairs_in_large(code[own], row[own] - begin, side[begin:stop], fewest[begin:stop]):
            add(i + begin, j + begin, score)
    some = np.flatnonzero(np.repeat(count < LARGE, count))
    if len(some):
        own = np.repeat(np.repeat(count < LARGE, count), size)
        for i, j, score in _pairs_in_small(code[own], np.repeat(np.arange(len(some)), size[some]), np.searchsorted(group[some], group[some], "left")):
            add(some[i], some[j], score)
    i, j, score = (np.concatenate(x) for x in (ones, twos, scores))
    order = np.lexsort((j, i, -score))
    i, j = i[order], j[order]
    parent = np.arange(n)
    some = np.flatnonzero(linked)
    parent[some] = some[np.searchsorted(group[some], group[some], "left")]
    out: list[tuple[int, int]] = []
    turn = 0
    while len(i):
        own, other = parent[i], parent[j]
        i, j, own = i[own != other], j[own != other], own[own != other]
        # the most alike of each component first; what still fails is then tried in bulk
        now = np.unique(own, return_index=True)[1] if turn < few else np.arange(min(len(i), 5_000))
        turn += 1
        if not len(now):
            break
        for k in sorted({x[0] for x in passages_between([bodies[x] for x in i[now]], [bodies[x] for x in j[now]], left[j[now]] - left[i[now]], width, similarity)}):
            x, y = int(i[now[k]]), int(j[now[k]])
            while parent[x] != x:
                x = int(parent[x])
            while parent[y] != y:
                y = int(parent[y])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(i[now[k]]), int(j[now[k]])))
        parent = _roots(parent)
        rest = np.ones(len(i), bool)
        rest[now] = False
        i, j = i[rest], j[rest]
    return out


def _links(width: int, similarity: float):
    """Of windows in cells (sig, x, y, side, id, at, linked, body), sorted by cell: links (id, at, other, there), those of ``linked_pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["sig", "x", "y"]):
            sig, x, y, side, at = (np.asarray(rows.column(c), np.int64) for c in ("sig", "x", "y", "side", "at"))
            group = np.concatenate([[0], np.cumsum((sig[1:] != sig[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))])
            doc = np.asarray(rows.column("id").dictionary_encode().indices)
            bodies = _arrays(rows.column("body"), "<u2")
            linked = np.asarray(rows.column("linked").to_numpy(zero_copy_only=False), bool)
            found = linked_pairs(bodies, at >> 8 & 255, doc, group, np.where(x == y, 2, side), linked, width, similarity)
            one, two = (pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1))
            yield pa.record_batch([rows.column("id").take(one), rows.column("at").take(one), rows.column("id").take(two), rows.column("at").take(two)], names=["id", "at", "other", "there"])

    return tidied(run)


def _among(tagged: DataFrame, grams: DataFrame, kind: str, width: int, similarity: float, block: int) -> DataFrame:
    """Links (id, at, other, there) among windows of one signature that the first window does not account for.

    ``tagged`` has all windows of shared signatures and whether they lie in a passage of the first one. Where one does
    not, the windows of its signature are compared with each other, but for equal ones (which are linked with the least
    of them) and those that are both linked with the first. Over ``block`` different windows are dealt out over pairs
    of blocks.
    """
    opened = written(tagged.groupBy("sig").agg(F.count_if(~F.col("linked")).alias("open"), F.count("*").alias("n")).filter("open > 0").select("sig", "n"), "open")
    pool = written(join_salted(tagged, opened, ["sig"], ["id", "at"]), "pool")
    uses = written(pool.groupBy("id").agg(F.count("*").alias("n")).join(grams, "id"), "pool-grams")
    left, right = F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    body = F.substring("grams", ((F.shiftright("at", 16) - left) * 4 + 1).cast("int"), ((left + right) * 4).cast("int"))
    pool = join_salted(pool, uses, ["id"], ["sig", "at"], bound=0).select("sig", "id", "at", "linked", body.alias("body"))
    pool = written(pool.mapInArrow(tidied(_bodies), f"sig long, id {kind}, at long, linked boolean, body binary"), "bodies")
    pool = pool.withColumn("content", F.xxhash64("body", left))
    firsts = pool.groupBy("sig", "content").agg(F.min(F.struct(~F.col("linked"), "id", "at", "body")).alias("o"), F.count_if(~F.col("linked")).alias("open"), F.count("*").alias("n"))
    firsts = written(firsts.select("sig", "content", F.col("o.id").alias("id"), F.col("o.at").alias("at"), (F.col("open") < F.col("n")).alias("linked"), "open", "n", F.col("o.body").alias("body")), "contents")
    equal = firsts.filter("open > 0 and n > 1").select("sig", "content", F.col("id").alias("other"), F.col("at").alias("there"), "n")
    copies = join_salted(pool.filter("not linked").select("sig", "content", "id", "at"), equal, ["sig", "content"], ["id", "at"]).filter("id <> other").select("id", "at", "other", "there")
    groups = written(firsts.groupBy("sig").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.sum("open").alias("open")).filter("n > 1 and open > 0").drop("open"), "blocks")
    own = F.pmod(F.xxhash64("id", "at"), F.col("blocks")).cast("int")
    dealt = join_salted(firsts.drop("n", "open", "content"), groups, ["sig"], ["id", "at"]).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("sig", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), (F.col("own") > F.col("with")).cast("int").alias("side"), "id", "at", "linked", "body")
    links = cells.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y").mapInArrow(_links(width, similarity), f"id {kind}, at long, other {kind}, there long")
    return copies.union(links)


def near_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, passage: int = PASSAGE, hashes: int = HASHES, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Rows (id, first_word, end_word, other, other_first, other_end, similarity): passages that other documents hold too.

    A passage has at least ``passage`` words (up to 131 for the default ``n``); two are near-duplicates when the Jaccard
    similarity of their n-word runs is at least ``similarity``. For each of ``hashes`` hash functions, the stretches of
    a document that share a signature are the compact windows of the Cartesian tree over the hashes of its n-word runs;
    a passage that two documents share in full lies in windows with the same signature in both, whatever the hash.

    A signature also holds the least value of half a passage beside c by another hash, which a shared passage shares on
    one side or the other. Windows that share a signature are joined with the group's first window (least id, then
    place), so rows grow with the windows. The two windows, aligned at their least value, must overlap by a passage;
    overlaps of all hashes that agree in document, partner and shift become one interval. The word runs of both
    documents are then compared inside that interval: the reported passages and their similarity come from the runs.

    Where windows of a signature lie in no passage of the first one, all its windows are compared with each other, unless
    they are equal or both lie in passages of the first one (``linked_pairs``): so passages that are alike are connected
    by rows, also where the first window holds none of them, a part of them, or is like one of them only. Rows are those
    that connect them, not all pairs: documents that are like the same one need no row of their own. Signatures that many
    windows share, and partners that many documents have, are dealt out over tasks.

    Null texts are empty; texts shorter than a passage give no rows; very long texts are windowed whole; a document is
    not compared with itself. Null ids give no rows. Rows that repeat an id count as one document. Ids may be of any
    type with an order. Empty tables give an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    kind = base.schema["id"].dataType.simpleString()
    width = passage - n + 1
    if not 1 < width < 128:
        raise ValueError("passages have 2 to 127 runs of words")
    rows = base.mapInArrow(_windows(n, width, hashes), f"sig long, id {kind}, at long")
    firsts = rows.groupBy("sig").agg(F.min(F.struct("id", "at")).alias("o"), F.max("id").alias("most"), F.count("*").alias("n"))
    firsts = written(firsts.filter("o.id < most").select("sig", F.col("o.id").alias("other"), F.col("o.at").alias("there"), "n"), "firsts")
    met = written(join_salted(rows, firsts, ["sig"], ["id", "at"], bound=0).select("sig", "id", "at", "other", "there"), "met")
    ids = written(met.select("id").distinct(), "passage-ids")
    grams = written(join_sized(base, ids, "id", "left_semi").mapInArrow(_grams(n), f"id {kind}, grams binary").groupBy("id").agg(F.first("grams").alias("grams")), "grams")
    found = _compared(_intervals(met.filter("id <> other"), width), grams, kind, n, width, similarity)
    # a window that lies in a passage of the first one is accounted for, others meet each other
    spans = found.groupBy("id", "other", "shift").agg(F.collect_list(F.struct("first_word", "end_word")).alias("spans"))
    c = F.shiftright("at", 16)
    held = (F.col("id") == F.col("other")) & (F.col("at") == F.col("there")) | F.exists("spans", lambda x: (x["first_word"] <= c) & (c + n <= x["end_word"]))
    tagged = met.withColumn("shift", (c - F.shiftright("there", 16)).cast("int")).join(spans, ["id", "other", "shift"], "left")
    tagged = written(tagged.select("sig", "id", "at", F.coalesce(held, F.lit(False)).alias("linked")), "tagged")
    links = _among(tagged, grams, kind, width, similarity, block)
    swap = F.col("id") < F.col("other")
    links = links.select(*(F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("id", "other"), ("at", "there"), ("other", "id"), ("there", "at"))))
    found = found.unionByName(_compared(_intervals(links, width), grams, kind, n, width, similarity))
    return found.drop("shift").distinct().withColumnsRenamed({"id": id_col, "other": f"other_{id_col}"})


def _intervals(met: DataFrame, width: int) -> DataFrame:
    """Rows (id, other, shift, lo, hi): all windows of two documents that are aligned alike, of the places both windows hold."""
    left, right, c = (lambda x: F.shiftright(x, 8).bitwiseAND(255)), (lambda x: F.col(x).bitwiseAND(255)), (lambda x: F.shiftright(x, 16))
    lo, hi = c("at") - F.least(left("at"), left("there")), c("at") + F.least(right("at"), right("there"))
    both = met.select("id", "other", (c("at") - c("there")).cast("int").alias("shift"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    return written(both.filter(F.col("hi") - F.col("lo") >= width).groupBy("id", "other", "shift").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "intervals")


def _compared(pairs: DataFrame, grams: DataFrame, kind: str, n: int, width: int, similarity: float) -> DataFrame:
    """Verified passages of ``pairs`` (id, other, shift, lo, hi); only the stretches compared are sent, not whole texts."""
    part = lambda lo, size: F.expr(f"substring(grams, ({lo}) * 4 + 1, ({size}) * 4)")
    one = pairs.join(grams, "id").select("id", "other", "shift", "lo", part("lo", "hi - lo").alias("own"), F.greatest(F.lit(0), F.col("lo") - F.col("shift") - width).alias("base"), (F.col("hi") - F.col("shift") + width).alias("stop"))
    uses = written(pairs.groupBy(F.col("other").alias("id")).agg(F.count("*").alias("n")).join(grams, "id").withColumnRenamed("id", "other"), "partners")
    both = join_salted(one, uses, ["other"], ["id", "shift"], bound=0).select("id", "other", "shift", "lo", "base", "own", part("base", "stop - base").alias("near"))
    with small_batches(pairs.sparkSession, 2_000):
        return written(both.mapInArrow(_verified(n, width, similarity), f"id {kind}, shift int, first_word int, end_word int, other {kind}, other_first int, other_end int, similarity double"), "passages")


def op4_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
