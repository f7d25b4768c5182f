"""Removal of repeated byte strings: merged Burrows-Wheeler transforms of shards.

Every byte that lies in a string of ``SPAN`` (100) bytes which also starts
earlier (smaller doc_id, or same doc_id and earlier start) is removed. Strings
are judged on the input; overlapping occurrences count.

**Parse.** Sorting a suffix at every byte would cost many times the input. The
string that starts at p belongs to the *anchor* a(p): among the 69 stretches of
32 bytes inside the string, the start of the one with the least hash (leftmost of
equal ones). It depends on the string alone, so equal strings have their anchors
at the same distance l = a - p <= 68; the strings of one anchor start side by
side. Suffixes start at anchors, about 35 bytes apart. A suffix's symbols are the
32 bytes of its anchor, then stretches of 17 bytes up to the end of the anchor's
last string; the symbols *before* it (its transform) are stretches of 17 bytes
back to the start of its first string.

**Shard transforms** (``_Shard``). A task sorts the suffixes of about 16 MB of
documents by their symbols. A suffix equal to an earlier one in all symbols
after and before it is a repetition as a whole: all strings of its anchor start
earlier as well. It is settled inside the shard and not passed on, so a passage
copied thousands of times leaves one row a shard.

**Merge** (``_interleave``). The sorted runs of all shards are dealt by their
first symbol. All common prefixes that matter have 32 bytes, so what can be
equal meets. The runs are interleaved by iterative refinement: all rows of a
first symbol start as one block, and each pass splits the blocks that are not
settled by one more symbol, stably, until rows of one block have the same
context (a 64-bit hash of all their bytes, beside the first symbol's). Where
neighbours part gives their common prefix; the final blocks are the repeated
intervals. No run is sorted again as a whole. The same refinement by the symbols
before gives the common suffix. (The textbook merge steps through the transforms
by their last-to-first map; its steps would leave the task, so a run carries
short hashes of its symbols along. They only bound the common prefix, so a clash
costs a look-up and no result.)

**Edges.** All but the first member of a repeated interval are settled. A first
member can still share some of its strings with another interval: those whose l
bytes before the anchor fit its longest common suffix and whose 100 - l other
bytes fit its longest common prefix. These stretches alone are cut from the
texts, dealt by first symbol again, and the first of each equal 100-byte string
(two 64-bit hashes) is found in the task.

**Hot first symbols.** If a shard holds more than ``HOT`` different suffixes with
one first symbol, it sends a marker in their place and passes their strings to
the look-up; the merge then passes on all other first members of that symbol.
Their strings are dealt by hash, one by one, the first of each shard only. So a
task meets at most ``HOT`` + 1 rows of a shard for one symbol, and nothing is
capped.

Memory: a task holds one shard's rows (about 100 bytes for 35 bytes of text), one
chunk of whole first symbols in the merge, or one row's text; long texts are
scanned in stretches of 4 MB.

Defined results: null and empty texts have no bytes and lose none; rows of one
doc_id count as one document whose starts are compared by number, so equal rows
lose the same bytes; a null doc_id comes after all others; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written
from .kernels import WordHasher, mix, pieces, text_buffers

SPAN = 100
#: Bytes of the first symbol, whose hash picks the anchor, and furthest string start before it.
HEAD = 32
REACH = SPAN - HEAD
#: Further symbols on either side, and their bytes.
SYMBOLS = 4
STEP = REACH // SYMBOLS
SHARD_BYTES = 16 << 20
STRETCH, MARGIN = 4 << 20, 256
HOT = 64
#: Rows that a merge handles at once, beyond the last first symbol among them.
CHUNK, LOOK_CHUNK = 1 << 18, 1 << 14

SUFFIX, REMOVED, STRING, STARTS, HOT_STARTS, MARK, STRETCHES = range(7)
ROWS = "kind byte, a long, b long, c long, doc_id long, key long, at long"
OUT = "kind byte, a long, doc_id long, key long, start long, stop long"
LOOK = "kind byte, a long, b long, doc_id long, key long, at long, body binary"


def _ranges(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [first, stop), and the range of each."""
    n = np.maximum(stop - first, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of], of


class _Prefix:
    """Hashes of byte ranges of one piece from one prefix sum."""

    def __init__(self, hasher: WordHasher, data: np.ndarray):
        hasher._grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * hasher.power[:len(data)], out=self.sums[1:])
        self.inverse = hasher.inverse

    def __call__(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[first]) * self.inverse[first])

    def every(self, width: int) -> np.ndarray:
        """Hash of each ``width`` consecutive bytes."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:-width]) * self.inverse[:n]) if n > 0 else np.empty(0, np.uint64)


def _anchors(prefix: _Prefix) -> np.ndarray:
    """a(p) of the string at each byte p."""
    x = prefix.every(HEAD)
    x = (x & ~np.uint64(0xFFFFFFFF)) | np.arange(len(x), dtype=np.uint64)  # equal hashes: the leftmost
    width = 1
    while 2 * width <= REACH + 1:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if width < REACH + 1:
        more = REACH + 1 - width
        x = np.minimum(x[:-more], x[more:])
    return (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _scan(size: int, lo: np.ndarray, hi: np.ndarray, own_lo: int, own_hi: int, prefix: _Prefix) -> dict:
    """Suffixes of a piece whose texts i fill [lo, hi); only anchors inside
    [own_lo, own_hi) are reported. A suffix's strings start from low to high."""
    if size < SPAN:
        empty = np.empty(0, np.int64)
        return {c: empty.view(np.uint64) for c in ("a", "b", "c")} | {c: empty for c in ("text", "low", "high", "anchor")}
    at = _anchors(prefix)
    p, text = _ranges(lo, hi - SPAN + 1)
    at = at[p]
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    anchor = at[first]
    own = (anchor >= own_lo) & (anchor < own_hi)
    anchor, text, low, high = anchor[own], text[first[own]], p[first[own]], p[last[own]]
    symbols = np.zeros(len(anchor), np.uint64)
    for side, room in ((0, high + SPAN - anchor - HEAD), (SYMBOLS, anchor - low)):
        for k in range(SYMBOLS):
            one, two = np.minimum(room, k * STEP), np.minimum(room, (k + 1) * STEP)
            x = prefix(anchor + HEAD + one, anchor + HEAD + two) if side == 0 else prefix(anchor - two, anchor - one)
            x = np.where(two > one, x % np.uint64(255) + np.uint64(1), np.uint64(0))
            symbols |= x << np.uint64(56 - 8 * (side + k))
    whole = prefix(low, high + SPAN) ^ mix(((anchor - low) * 256 + (anchor - high)).astype(np.uint64))
    return {"a": prefix(anchor, anchor + HEAD), "b": symbols, "c": whole, "text": text, "low": low, "high": high,
            "anchor": anchor}


def _strings(prefix: _Prefix, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the 100 bytes from each start on."""
    return prefix(starts, starts + SPAN), prefix(starts, starts + SPAN // 2)


def _runs(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each owner: overlapping and touching ones become one."""
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    if len(owner) == 0:
        return owner, start, stop
    # the furthest end so far inside an owner: ends are lifted by the owner's rank
    rank = np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]])).astype(np.int64)
    lift = int(stop.max()) + 1
    far = np.maximum.accumulate(stop + rank * lift)
    new = np.concatenate([[True], (start + rank * lift)[1:] > far[:-1]])
    at = np.flatnonzero(new)
    return owner[at], start[at], np.concatenate([far[at[1:] - 1], far[-1:]]) - rank[at] * lift


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the row before it in any column."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _repeats(groups: tuple, missing: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and place, and which rows of that order come after
    another place of their group."""
    order = np.lexsort((at, doc, missing, *groups[::-1]))
    new = _changes(*(g[order] for g in groups))
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (missing[order] != missing[first]) | (doc[order] != doc[first]) | (at[order] != at[first])
    return order, later


class _Shard:
    """Collects what the texts of a shard give, then emits its sorted run."""

    def __init__(self):
        self.parts: list[dict] = []
        self.size = 0

    def add(self, columns: dict, base, doc, missing, key) -> None:
        """Rows with ``text`` numbers; ``base`` is added to their places."""
        text = columns.pop("text")
        self.parts.append(columns | {"doc": doc[text], "missing": missing[text], "key": key[text]}
                          | {c: columns[c] + base for c in ("low", "high", "anchor") if c in columns})

    def _columns(self) -> dict:
        return {c: np.concatenate([x[c] for x in self.parts]) for c in self.parts[0]}

    def suffixes(self, hot: int):
        """The shard's run, its markers and what it settles."""
        if not self.parts:
            return
        s = self._columns()
        order, later = _repeats((s["a"], s["b"], s["c"]), s["missing"], s["doc"], s["anchor"])
        s = {c: v[order] for c, v in s.items()}
        left = np.flatnonzero(~later)
        head = _changes(s["a"][left])
        size = np.diff(np.append(np.flatnonzero(head), len(left)))
        many = np.repeat(size > hot, size)
        run, looked, marks = left[~many], left[many], left[many & head]
        at = s["anchor"] << 16 | (s["anchor"] - s["high"]) << 8 | (s["anchor"] - s["low"])
        yield _batch(ROWS, SUFFIX, s, run, a=s["a"], b=s["b"], c=s["c"], at=at)
        yield _batch(ROWS, HOT_STARTS, s, looked, a=s["key"], b=s["low"], c=s["high"] + 1)
        yield _batch(ROWS, MARK, s, marks, a=s["a"])
        yield _removed(s, np.flatnonzero(later), s["low"], s["high"] + SPAN, ROWS, "a", "b", "c")

    def strings(self):
        """The first of each string of the shard, and what it settles: equal
        strings of a shard need no other proof."""
        if not self.parts:
            return
        s = self._columns()
        order, later = _repeats((s["a"], s["b"]), s["missing"], s["doc"], s["low"])
        s = {c: v[order] for c, v in s.items()}
        yield _batch(LOOK, STRING, s, np.flatnonzero(~later), a=s["a"], b=s["b"], at=s["low"])
        yield _removed(s, np.flatnonzero(later), s["low"], s["low"] + SPAN, LOOK, "a", "b", "at")


def _removed(s, rows, start, stop, schema, owner_column, start_column, stop_column) -> pa.RecordBatch:
    """The spans of the given rows, joined per text."""
    number = np.cumsum(_changes(*(s[c][o] for c in ("key", "doc", "missing")))) - 1 if len(
        o := rows[np.lexsort((s["missing"][rows], s["doc"][rows], s["key"][rows]))]) else np.empty(0, np.int64)
    sample = o[np.searchsorted(number, np.arange(int(number.max(initial=-1)) + 1))]
    owner, start, stop = _runs(number, start[o], stop[o])
    rows = sample[owner]
    mine = {c: s[c][rows] for c in ("key", "doc", "missing")}
    columns = {owner_column: mine["key"], start_column: start, stop_column: stop}
    return _batch(schema, REMOVED, mine, np.arange(len(rows)), **columns)


def _batch(schema: str, kind: int, s: dict, rows: np.ndarray, **columns) -> pa.RecordBatch:
    """Rows of a shard; columns that are not given are zero (body: null)."""
    out = []
    names = [c.split()[0] for c in schema.split(", ")]
    for c in names:
        if c == "kind":
            out.append(pa.array(np.full(len(rows), kind, np.int8)))
        elif c == "doc_id":
            out.append(pa.array(s["doc"][rows], pa.int64(), mask=s["missing"][rows]))
        elif c == "body":
            out.append(columns[c] if c in columns else pa.nulls(len(rows), pa.binary()))
        else:
            x = s["key"] if c == "key" else columns.get(c)
            x = np.zeros(len(rows), np.int64) if x is None else np.ascontiguousarray(x[rows])
            out.append(pa.array(x.view(np.int64)))
    return pa.RecordBatch.from_arrays(out, names=names)


def _texts(batch: pa.RecordBatch):
    """doc_id, missing, key of a batch as arrays, and its text buffers."""
    missing = np.array(batch.column(0).is_null())
    return (np.array(batch.column(0).fill_null(0)), missing, np.array(batch.column(1)), *text_buffers(batch.column(2)))


def _lists(column, fields: tuple[str, ...]) -> tuple:
    """Bounds of the rows' lists of structs, and the structs' columns."""
    bounds = np.concatenate([[0], np.cumsum(np.array(column.value_lengths().fill_null(0)))])
    flat = column.flatten()
    return bounds, *(np.array(flat.field(c)) for c in fields)


def _stretches(off: np.ndarray, stretch: int):
    """(first row, last row, first byte, last byte, own first, own last) of
    pieces: some whole texts, or a stretch of a long one with its margins."""
    for first, last in pieces(off):
        lo, hi = int(off[first]), int(off[last])
        if last - first > 1 or hi - lo <= stretch:
            yield first, last, lo, hi, lo, hi
        else:
            for s in range(lo, hi, stretch):
                yield first, last, max(s - MARGIN, lo), min(s + stretch + MARGIN, hi), s, min(s + stretch, hi)


def _shards(shard_bytes: int, stretch: int, hot: int):
    """Texts to the sorted runs of their shards."""
    def run(batches):
        hasher, shard = WordHasher(), _Shard()
        for batch in batches:
            doc, missing, key, data, off = _texts(batch)
            for first, last, lo, hi, own_lo, own_hi in _stretches(off, stretch):
                begin = off[first:last] - lo  # negative for a later stretch of a long text
                found = _scan(hi - lo, np.maximum(begin, 0), np.minimum(off[first + 1:last + 1], hi) - lo,
                              own_lo - lo, own_hi - lo, _Prefix(hasher, data[lo:hi]))
                base = -begin[found["text"]]  # places count from the text's first byte
                found["text"] = found["text"] + first
                shard.add(found, base, doc, missing, key)
                shard.size += hi - lo
                if shard.size >= shard_bytes:
                    yield from shard.suffixes(hot)
                    shard = _Shard()
        yield from shard.suffixes(hot)

    return run


def _lookups(shard_bytes: int):
    """Texts with lists of starts to stretches, or to single strings for hot symbols."""
    def run(batches):
        hasher, shard = WordHasher(), _Shard()
        for batch in batches:
            doc, missing, key, data, off = _texts(batch)
            bounds, kind, a, start, stop = _lists(batch.column(3), ("kind", "a", "start", "stop"))
            of = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            raw = data.tobytes()
            cold = np.flatnonzero(kind == STARTS)
            at = off[of[cold]]
            body = [raw[x:y] for x, y in zip((at + start[cold]).tolist(), (at + stop[cold] - 1 + SPAN).tolist())]
            rows = {"doc": doc[of[cold]], "missing": missing[of[cold]], "key": key[of[cold]]}
            yield _batch(LOOK, STRETCHES, rows, np.arange(len(cold)), a=a[cold], at=start[cold],
                         body=pa.array(body, pa.binary()))
            for i in np.unique(of[kind == HOT_STARTS]).tolist():
                mine = slice(bounds[i], bounds[i + 1])
                hot = kind[mine] == HOT_STARTS
                _, x, y = _runs(np.zeros(int(hot.sum()), np.int64), start[mine][hot], stop[mine][hot])
                for lo, hi in zip(x.tolist(), y.tolist()):
                    piece = data[off[i] + lo:off[i] + hi - 1 + SPAN]
                    starts = np.arange(hi - lo)
                    one, two = _strings(_Prefix(hasher, piece), starts)
                    shard.add({"a": one, "b": two, "low": starts, "text": np.full(hi - lo, i)}, lo, doc, missing, key)
                    shard.size += 50 * (hi - lo)
                    if shard.size >= shard_bytes:
                        yield from shard.strings()
                        shard = _Shard()
        yield from shard.strings()

    return run


def _refine(block: np.ndarray, order: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Splits the blocks of an interleave by one more symbol, stably; blocks of
    one row are settled and stay. ``order`` is changed in place."""
    open_ = np.flatnonzero(np.bincount(block)[block] > 1)
    order[open_] = order[open_[np.lexsort((symbol[order[open_]], block[open_]))]]
    parts = _changes(block)
    value = symbol[order]
    parts[1:] |= value[1:] != value[:-1]
    return np.cumsum(parts) - 1


def _interleave(a: np.ndarray, symbols: list[np.ndarray], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge of sorted runs by refinement of their interleave, symbol by symbol.

    Returns the interleave (row numbers), the final block of each place (rows of
    one context), and how many symbols beyond ``a`` the row shares with a row of
    another final block (-1: no such row has its ``a``)."""
    order = np.argsort(a, kind="stable")
    block = np.cumsum(_changes(a[order])) - 1 if len(a) else np.empty(0, np.int64)
    levels = [block]
    for symbol in symbols:
        levels.append(block := _refine(block, order, symbol))
    block = _refine(block, order, whole)
    new = _changes(block)
    shared = np.full(len(a), -1)
    for depth, level in enumerate(levels):
        edge = np.flatnonzero(_changes(level))
        blocks = np.add.reduceat(new.astype(np.int64), edge) if len(edge) else np.empty(0, np.int64)
        shared[blocks[level] > 1] = depth
    return order, block, shared


def _settle_suffixes(t: dict, rows: np.ndarray) -> list:
    """(kind, rows, start, stop) of repeated suffixes and of starts to look up."""
    at = t["at"][rows]
    anchor, near, far = at >> 16, at >> 8 & 255, at & 255
    a, whole = t["a"][rows], t["c"][rows]
    code = t["b"][rows].view(np.uint64)
    symbols = [(code >> np.uint64(56 - 8 * k) & np.uint64(255)).astype(np.uint8) for k in range(2 * SYMBOLS)]
    order, block, after = _interleave(a, symbols[:SYMBOLS], whole)
    # the first member of every final block; other rows of its doc_id and place are no repetitions
    place = np.lexsort((anchor[order], t["doc_id"][rows][order], t["missing"][rows][order], block))
    order, after = order[place], after[place]
    first = order[np.maximum.accumulate(np.where(_changes(block), np.arange(len(order)), 0))]
    later = np.zeros(len(order), bool)
    for c in (t["doc_id"][rows], anchor, t["missing"][rows]):
        later |= c[order] != c[first]
    repeated, firsts, after = order[later], order[~later], after[~later]
    back, _, shared = _interleave(a, symbols[SYMBOLS:], whole)
    before = np.empty(len(rows), np.int64)
    before[back] = shared
    before = before[firsts]
    hot = np.isin(a[firsts], t["a"][t["kind"] == MARK])
    # symbols part somewhere inside the first that differs
    prefix = np.where(hot, SPAN, HEAD + (after + 1) * STEP)
    suffix = np.where(hot, SPAN, (before + 1) * STEP)
    start = np.maximum(anchor[firsts] - suffix, (anchor - far)[firsts])
    stop = np.minimum(anchor[firsts] + prefix - SPAN, (anchor - near)[firsts]) + 1
    out = [(REMOVED, rows[repeated], (anchor - far)[repeated], (anchor - near)[repeated] + SPAN)]
    for kind, some in ((STARTS, (after >= 0) & ~hot), (HOT_STARTS, hot)):
        some &= stop > start
        out.append((kind, rows[firsts[some]], start[some], stop[some]))
    return out


def _settle_stretches(t: dict, rows: np.ndarray, body) -> list:
    """Repeated strings of stretches with whole first symbols, by two hashes each."""
    data, off = text_buffers(body)
    starts, of = _ranges(off[:-1], off[1:] - SPAN + 1)
    one, two = _strings(_Prefix(WordHasher(), data), starts)
    each = rows[of]
    at = t["at"][each] + starts - off[of]
    order, later = _repeats((t["a"][each], one, two), t["missing"][each], t["doc_id"][each], at)
    some = order[later]
    owner, start, stop = _runs(of[some], at[some], at[some] + SPAN)
    return [(REMOVED, rows[owner], start, stop)]


def _settle(table: pa.Table) -> list[pa.RecordBatch]:
    """Removed spans, and starts to look up, of whole first symbols."""
    t = {c: np.array(table.column(c)) for c in table.column_names if c not in ("doc_id", "body")}
    doc = table.column("doc_id")
    t |= {"missing": np.array(doc.is_null()), "doc_id": np.array(doc.fill_null(0))}
    of_kind = {k: np.flatnonzero(t["kind"] == k) for k in range(STRETCHES + 1)}
    first_round = "c" in t
    found = [(REMOVED, of_kind[REMOVED], *(t[c][of_kind[REMOVED]] for c in (("b", "c") if first_round else ("b", "at")))),
             *((k, of_kind[k], t["b"][of_kind[k]], t["c"][of_kind[k]]) for k in (HOT_STARTS,) if first_round)]
    if first_round:
        found += _settle_suffixes(t, of_kind[SUFFIX])
    else:
        rows = of_kind[STRING]
        order, later = _repeats((t["a"][rows], t["b"][rows]), t["missing"][rows], t["doc_id"][rows], t["at"][rows])
        rows = rows[order[later]]
        found.append((REMOVED, rows, t["at"][rows], t["at"][rows] + SPAN))
        rows = of_kind[STRETCHES]
        if len(rows):
            found += _settle_stretches(t, rows, table.column("body").take(pa.array(rows)))
    return [pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(rows), kind, np.int8)), pa.array(t["a"][rows]),
         pa.array(t["doc_id"][rows], pa.int64(), mask=t["missing"][rows]), pa.array(t["key"][rows]),
         pa.array(start), pa.array(stop)], names=["kind", "a", "doc_id", "key", "start", "stop"])
        for kind, rows, start, stop in found if len(rows)]


def _merge(chunk: int):
    """Rows sorted by first symbol to removed spans and starts to look up."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                table = pa.Table.from_batches(held)
                a = np.array(table.column("a"))
                cut = int(np.searchsorted(a, a[-1]))  # the last first symbol may go on
                if cut:
                    yield from _settle(table.slice(0, cut))
                    held, n = table.slice(cut).to_batches(), len(a) - cut
        if n:
            yield from _settle(pa.Table.from_batches(held))

    return run


def _dealt(rows: DataFrame, chunk: int) -> DataFrame:
    return arrow_map(rows.repartition("a").sortWithinPartitions("a"), _merge(chunk), OUT)


def _remove(batches):
    """Texts with lists of removed spans to their results."""
    for batch in batches:
        _, _, _, data, off = _texts(batch)
        raw = data.tobytes()
        bounds, one, two = _lists(batch.column(3), ("start", "stop"))
        out = []
        for i in range(batch.num_rows):
            lo, hi = int(off[i]), int(off[i + 1])
            x, y = one[bounds[i]:bounds[i + 1]], two[bounds[i]:bounds[i + 1]]
            _, x, y = _runs(np.zeros(len(x), np.int64), x, y)
            edges = [0, *np.stack([x, y], axis=1).reshape(-1).tolist(), hi - lo]
            kept = b"".join(raw[lo + p:lo + q] for p, q in zip(edges[::2], edges[1::2]))
            out.append((hi - lo, int((y - x).sum()), x.tolist(), y.tolist(), kept, hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[c] for r in out], kind) for c, kind in enumerate(
                [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2, pa.binary(), pa.string()]))],
            names=["doc_id", "n_bytes", "n_removed", "starts", "stops", "kept", "kept_sha256"])


def drop_repeated_spans(docs: DataFrame, *, shard_bytes: int = SHARD_BYTES, stretch: int = STRETCH, hot: int = HOT,
                        chunk: int = CHUNK, look_chunk: int = LOOK_CHUNK) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, the removed runs (starts and stops in
    bytes), the kept bytes and their digest."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.select("doc_id", F.xxhash64("text").alias("key"), "text")
    long_ = src.where(F.octet_length("text") >= SPAN)
    found = written(_dealt(arrow_map(long_, _shards(shard_bytes, stretch, hot), ROWS), chunk), "repeats")
    asked = found.where(F.col("kind") != REMOVED).groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("kind", "a", "start", "stop")).alias("spans"))
    more = _dealt(arrow_map(_with(long_, asked, "inner"), _lookups(shard_bytes), LOOK), look_chunk)
    removed = found.where(F.col("kind") == REMOVED).unionByName(more).groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans"))
    return arrow_map(_with(src, removed, "left"), _remove,
                     "doc_id long, n_bytes long, n_removed long, starts array<long>, stops array<long>, "
                     "kept binary, kept_sha256 string")


def _with(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    lists = lists.withColumnRenamed("doc_id", "list_doc").withColumnRenamed("key", "list_key")
    return texts.join(lists, texts["key"].eqNullSafe(lists["list_key"])
                      & texts["doc_id"].eqNullSafe(lists["list_doc"]), how).select("doc_id", "key", "text", "spans")
