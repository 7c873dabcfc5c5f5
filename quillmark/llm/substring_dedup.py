"""Suffix-array dedup: bytes of long strings that occur earlier in the corpus.

The corpus is dealt out by content. Every 100-byte window picks one anchor in itself by
content alone (the least k-gram hash), so equal windows meet at equal anchors, and an
anchor's context, the bytes of all windows that pick it, goes to a shard by the anchor's
hash. Within a shard the contexts are aligned at their anchors and indexed by a positional
Burrows-Wheeler transform: a column for each distance to the anchor, holding the bytes
before that column's suffixes in the suffixes' order. Rank steps (LF) lead from a column
to the next. Intervals of equal suffixes are then extended backwards breadth first, from
a queue: extending an interval whose right border has a common prefix of l bytes yields
the borders of l + 1 bytes, so common prefixes come out by increasing value. The queue
stops at the minimum length; what has no border by then shares a window's whole length.
All but the first window of such an interval are repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import drop_settled, settle

GRAM = 32
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]  # one for each word of a gram
_POS_BITS = 23
_LOW = np.uint64((1 << _POS_BITS) - 1)


def _gram_hashes(code: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position; the buffer must be padded by GRAM + 8 bytes."""
    n = len(code) - GRAM - 8
    words = np.empty(n + GRAM, np.uint64)
    raw = code.tobytes()
    for o in range(8):
        part = words[o::8]
        part[:] = np.frombuffer(raw, "<u8", len(part), o)
    with np.errstate(over="ignore"):
        h = sum((words[8 * j : 8 * j + n] * _M[j] for j in range(GRAM // 8)), np.zeros(n, np.uint64))
        h ^= h >> np.uint64(31)
        h *= _M[1]
        h ^= h >> np.uint64(29)
        h *= _M[0]
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, x
    while step * 2 <= width:
        out = np.minimum(out[: len(out) - step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(text, hash, anchor, first, last, offset of the text) of every anchor; windows that start in first..last pick it. Positions are in the joined buffer, also returned."""
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer(b"".join(texts) + b"\x00" * (GRAM + 8 + window), np.uint8)
    total = int(sizes.sum())
    offset = np.cumsum(sizes) - sizes
    if not (sizes >= window).any():
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none, offset, code
    h = _gram_hashes(code)
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    pick = (_sliding_min(key, window - GRAM + 1) & _LOW).astype(np.int64)[:total]
    valid = np.zeros(total + 1, np.int64)
    long = sizes >= window
    valid[offset[long]] += 1
    np.add.at(valid, offset[long] + sizes[long] - window + 1, -1)
    ok = np.cumsum(valid[:total]) > 0
    pick = np.where(ok[: len(pick)], pick, -1)
    change = np.flatnonzero(np.diff(pick, prepend=-2))
    ends = np.append(change[1:], len(pick)) - 1
    real = pick[change] >= 0
    first, last = change[real], ends[real]
    at = pick[first]
    doc = np.searchsorted(offset, at, side="right") - 1
    # an empty text shares its offset with the next one: take the text that holds the anchor
    return doc, h[at], at, first, last, offset, code


def _batches(batch: pa.RecordBatch, chars: int = 1_500_000) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_id, text's hash, offset) and bytes of a few MB of texts at a time; a longer text comes in pieces (the joined buffer stays under 8 MB, see _POS_BITS)."""
    ids, texts, size = [], [], 0
    for i, t, k in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
        raw = t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else b""
        if i is None:
            continue
        for lo in range(0, max(1, len(raw)), chars):  # very long texts come in pieces that overlap by a window
            piece = raw[lo : lo + chars + 127]
            if ids and size + len(piece) > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append((i, k, lo))
            texts.append(piece)
            size += len(piece)
    if ids:
        yield ids, texts


def _hash_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _batches(batch):
                _, h, *_ = anchors(texts, window)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return run


_PACK = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("back", pa.uint8()), ("ahead", pa.uint8()), ("bytes", pa.binary())])
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PACK, options=_ZSTD) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(bodies: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in bodies]).combine_chunks()


def _in_filter(known: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    spot = h % np.uint64(bits)
    return ((known[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _context_rows(window: int, shared, passes: int, nth: int, shards: int, salts: int, pack_rows: int = 80_000, pack_bytes: int = 16 << 20):
    """Anchors that the filter knows, with the bytes of all windows that pick them: packed by shard, a compressed table a row.

    In a run of one byte every position is an anchor with a window of bytes of its own, so
    contexts are laid out ``pack_bytes`` at a time and packed once as many are held.

    ``shared`` holds (bytes, bits) of the filter and of the filter of crowded anchors,
    whose contexts are dealt over ``salts`` further shards (salt 0: not crowded).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, bits), (crowd, crowd_bits) = ((np.frombuffer(b, np.uint8), n) for b, n in shared.value)
        held: list[pa.Table] = []
        hashes: list[np.ndarray] = []
        count = weight = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, hashes, count, weight
            table, h = pa.concat_tables(held), np.concatenate(hashes)
            held, hashes, count, weight = [], [], 0, 0
            shard = (h // np.uint64(7) % np.uint64(shards)).astype(np.int64)
            place = (table["doc"].to_numpy().astype(np.uint64) * _M[0] + table["at"].to_numpy().astype(np.uint64)) * _M[1]
            salt = np.where(_in_filter(crowd, crowd_bits, h), 1 + ((place >> np.uint64(33)) % np.uint64(salts)).astype(np.int64), 0)
            group = shard * (salts + 1) + salt
            order = np.lexsort((h, group))
            table = table.take(pa.array(order)).combine_chunks()
            edges = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
            keys = group[order][edges[:-1]]
            bodies = [_packed(table.slice(lo, hi - lo)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys // (salts + 1)), pa.array(keys % (salts + 1)), pa.array(bodies, pa.binary())], ["shard", "salt", "body"])

        for batch in batches:
            for ids, texts in _batches(batch):
                doc, h, at, first, last, offset, code = anchors(texts, window)
                keep = _in_filter(known, bits, h)
                if passes > 1:
                    keep &= _slice_of(h, passes) == nth
                if not keep.any():
                    continue
                doc, h, at, first, last = doc[keep], h[keep], at[keep], first[keep], last[keep]
                name, text, base = np.array(ids, np.int64).T
                total = np.cumsum(last + window - first)
                for lo, hi in _stretches(total, pack_bytes):
                    size = last[lo:hi] + window - first[lo:hi]
                    index = np.repeat(first[lo:hi] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(code[index].tobytes())])
                    own, where = doc[lo:hi], at[lo:hi]
                    columns = [name[own], text[own], where - offset[own] + base[own], (where - first[lo:hi]).astype(np.uint8), (last[lo:hi] + window - where).astype(np.uint8)]
                    hashes.append(h[lo:hi])
                    held.append(pa.Table.from_arrays([*map(pa.array, columns), body], schema=_PACK))
                    count += hi - lo
                    weight += int(size.sum())
                    if count >= pack_rows or weight >= pack_bytes:
                        yield flush()
        if count:
            yield flush()

    return run


def _stretches(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows, given their running total, that reach ``most`` or the end."""
    at = 0
    while at < len(total):
        to = min(len(total), int(np.searchsorted(total, (total[at - 1] if at else 0) + most)) + 1)
        yield at, to
        at = to


def _slice_of(h: np.ndarray, passes: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(passes)).astype(np.int64)


_END = 0xFF  # stands for what lies outside of a context; no byte of UTF-8
_UNSET = 0xFF


class Transform:
    """Positional Burrows-Wheeler transform of contexts aligned at their anchors.

    Column j orders the suffixes that start ``window - j`` bytes after the anchor; the
    byte before each leads to its place in column j + 1 (``lf``). Places are numbered
    through all columns, ``stride`` to a column. ``after`` and ``before`` are the next and
    the previous place of a column with the same byte.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, back: np.ndarray, ahead: np.ndarray, window: int):
        n, self.columns = len(start), 2 * window - GRAM
        self.n, self.stride, self.window = n, n + 1, window
        size = self.columns * self.stride
        self.lf, self.after, self.before = np.empty(size, np.int32), np.empty(size, np.int32), np.empty(size, np.int32)
        self.rows = np.empty((window - GRAM + 1, n), np.int32)  # of the columns where windows start
        #: Common prefix of each place's suffix with the one before; found by ``extend``.
        self.prefix = np.full(size + self.stride, _UNSET, np.uint8)
        self.prefix[:: self.stride] = self.prefix[n :: self.stride] = 0
        self.queue: list[tuple[np.ndarray, np.ndarray]] = []
        order, anchor, places = np.arange(n, dtype=np.int32), start + back, np.arange(n, dtype=np.int32)
        for j in range(self.columns):
            at = window - 1 - j  # of the bytes before this column's suffixes
            inside = (at < ahead) & (at >= -back)
            byte = np.where(inside, data[np.where(inside, anchor + at, 0)], _END).astype(np.uint8)[order]
            rank = np.argsort(byte, kind="stable").astype(np.int32)  # a counting sort
            order, byte = order[rank], byte[rank]
            same = (byte[1:] == byte[:-1]) & (byte[1:] != _END)
            lo, hi = j * self.stride, (j + 1) * self.stride
            here = slice(lo, hi)
            self.lf[here][rank] = hi + places
            self.after[here], self.before[here] = lo + n, lo - 1
            self.after[here][rank[:-1][same]] = lo + rank[1:][same]
            self.before[here][rank[1:][same]] = lo + rank[:-1][same]
            borders = (np.flatnonzero(~same) + 1).astype(np.int32)
            self.prefix[hi + borders] = 0
            if j + 1 < self.columns:
                self.queue.append((hi + np.concatenate([[0], borders[:-1]]).astype(np.int32)[: len(borders)], hi + borders))
            if j + 1 >= window:
                self.rows[j + 1 - window] = order

    def extend(self) -> None:
        """Finds all common prefixes under ``window`` by increasing value.

        The queue holds the intervals of strings of ``value`` bytes whose right border was
        found last. Extended by each byte before one of its suffixes, an interval leads to
        an interval of the next column; if that one's right border is not known from a
        lesser value, it is one of ``value`` and joins the next queue.
        """
        lo, hi = (np.concatenate([q[i] for q in self.queue]) if self.queue else np.zeros(0, np.int32) for i in (0, 1))
        end = self.columns * self.stride
        for value in range(1, self.window):
            one = hi - lo == 1
            left = self.lf[lo[one]]
            wide_lo, wide_hi = lo[~one], hi[~one]
            size = wide_hi - wide_lo
            owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
            place = np.repeat(wide_lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            first, last = self.before[place] < wide_lo[owner], self.after[place] >= wide_hi[owner]
            a, b = self.lf[place[first]], self.lf[place[last]] + 1
            owners = owner[first]
            several = np.bincount(owners, minlength=len(size))[owners] > 1  # the bytes of an interval in one order on both sides
            if several.any():
                at = np.flatnonzero(several)
                a[at] = a[at][np.lexsort((a[at], owners[at]))]
                b[at] = b[at][np.lexsort((b[at], owner[last][at]))]
            lo, hi = np.concatenate([left, a]), np.concatenate([left + 1, b])
            new = self.prefix[hi] == _UNSET
            lo, hi = lo[new], hi[new]
            self.prefix[hi] = value
            more = hi < end
            lo, hi = lo[more], hi[more]
            if not len(lo):
                break

    def borders(self) -> np.ndarray:
        """Of the columns where windows start: the places whose window differs from that of the place before."""
        return self.prefix[self.window * self.stride :].reshape(-1, self.stride)[:, : self.n] != _UNSET


def _later(new: np.ndarray, rank: np.ndarray, doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which members of classes start later than another one: in a larger doc_id, or further on in the same text.

    Classes lie one after the other, ``new`` marks their first members. ``doc`` and ``text``
    are by rank, ranks follow (doc, text, place). Different texts of one doc_id do not precede each other.
    """
    starts = np.flatnonzero(new)
    lead = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(rank)))) if len(starts) else rank
    late = rank != lead
    odd = np.flatnonzero(late & (doc[rank] == doc[lead]) & (text[rank] != text[lead]))
    if len(odd):
        own, r = np.cumsum(new)[odd], rank[odd]
        order = np.lexsort((r, text[r], own))
        own, r = own[order], r[order]
        head = np.concatenate([[True], (own[1:] != own[:-1]) | (text[r[1:]] != text[r[:-1]])])
        late[odd[order]] = r != r[np.maximum.accumulate(np.where(head, np.arange(len(r)), 0))]
    return late


def _grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    words = data[at[:, None] + np.arange(GRAM)[None, :]].view("<u8")
    with np.errstate(over="ignore"):
        h = sum((words[:, j] * _M[j] for j in range(GRAM // 8)), np.zeros(len(at), np.uint64))
        return (h ^ (h >> np.uint64(31))) * _M[1]


def repeats(table: dict[str, np.ndarray], window: int) -> np.ndarray:
    """n x levels booleans: whether the window that starts ``level`` bytes before the anchor starts earlier too.

    ``table`` has doc, key, at, back, ahead, same (a number for each distinct context),
    data, start (of each row's bytes), sorted by (doc, key, at).
    """
    doc, key, at = table["doc"], table["key"], table["at"]
    n, levels = len(doc), window - GRAM + 1
    out = np.zeros((n, levels), bool)
    if not n:
        return out
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1])])
    rank = np.cumsum(fresh) - 1
    by_rank = doc[fresh], key[fresh]
    # equal contexts stand for each other: only those that start earliest are indexed
    order = np.argsort(table["same"], kind="stable")
    same = table["same"][order]
    late = np.zeros(n, bool)
    late[order] = _later(np.concatenate([[True], same[1:] != same[:-1]]), rank[order], *by_rank)
    x = np.arange(levels)[None, :]
    back, ahead = table["back"].astype(np.int32), table["ahead"].astype(np.int32)
    out[late] = ((x <= back[:, None]) & (x >= window - ahead[:, None]))[late]
    kept = np.flatnonzero(~late)
    # where all contexts of an anchor are equal, no other window can be one of theirs
    grams = _grams(table["data"], table["start"][kept] + back[kept])
    _, which, count = np.unique(grams, return_inverse=True, return_counts=True)
    kept = kept[count[which] > 1]
    index = Transform(table["data"], table["start"][kept], back[kept], ahead[kept], window)
    index.extend()
    rows = index.rows.reshape(-1)
    found = _later(index.borders().reshape(-1), rank[kept[rows]], *by_rank)
    level = np.repeat(np.arange(levels), len(kept))
    out[kept[rows[found]], level[found]] = True
    return out


_FOUND = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])
_FOUND_DDL = "doc long, key long, a long, b long, w1 long, w2 long"


def _window_hashes(data: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``window`` bytes from each place."""
    wide = -(-window // 8) * 8
    out = []
    for lo in range(0, len(at), 100_000):
        col = np.arange(wide)[None, :]
        part = np.where(col < window, data[np.where(col < window, at[lo : lo + 100_000, None] + col, 0)], 0).astype(np.uint8).view("<u8")
        with np.errstate(over="ignore"):
            both = []
            for seed in (0, 1):
                h = np.zeros(len(part), np.uint64)
                for i in range(part.shape[1]):
                    h = (h ^ part[:, i]) * _M[seed] + _M[2 + seed]
                    h ^= h >> np.uint64(29 + seed)
                h *= _M[4 + seed]
                both.append((h ^ (h >> np.uint64(32))).view(np.int64))
        out.append(both)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([b[i] for b in out]) if out else none for i in (0, 1))


def _resolve(window: int):
    """Spans of repeats within a shard and, of a salted one, the windows that are first there, by two hashes of their bytes."""

    def run(rows: pa.Table) -> pa.Table:
        table = _unpacked(rows["body"].to_pylist())
        table = table.sort_by([("doc", "ascending"), ("key", "ascending"), ("at", "ascending")]).combine_chunks()
        body = table["bytes"].chunk(0)
        _, offsets, data = body.buffers()
        start = np.frombuffer(offsets, np.int32)[body.offset : body.offset + len(body)].astype(np.int64)
        cols = {c: table[c].to_numpy() for c in ("doc", "key", "at", "back", "ahead")}
        same = body.dictionary_encode().indices.to_numpy().astype(np.int64) * 256 + cols["back"]
        data = np.frombuffer(data, np.uint8)
        found = repeats(cols | {"start": start, "data": data, "same": same}, window)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, near = np.nonzero(edge == 1)
        _, far = np.nonzero(edge == -1)
        at = cols["at"][row]
        none = pa.nulls(len(row), pa.int64())
        out = pa.Table.from_arrays([pa.array(cols["doc"][row]), pa.array(cols["key"][row]), pa.array(at - (far - 1)), pa.array(at - near + window), none, none], schema=_FOUND)
        if rows["salt"][0].as_py():
            x = np.arange(found.shape[1])[None, :]
            mine = (x <= cols["back"][:, None].astype(int)) & (x >= window - cols["ahead"][:, None].astype(int))
            row, level = np.nonzero(mine & ~found)
            w1, w2 = _window_hashes(data, start[row] + cols["back"][row] - level, window)
            begin = cols["at"][row] - level
            out = pa.concat_tables([out, pa.Table.from_arrays([pa.array(cols["doc"][row]), pa.array(cols["key"][row]), pa.array(begin), pa.array(begin + window), pa.array(w1), pa.array(w2)], schema=_FOUND)])
        return out

    return run


def _later_windows(firsts: DataFrame) -> DataFrame:
    """Of windows that are first within their salted shard, those that start later than one of another. A window comes at most once from a shard, so no group is large."""
    same = Window.partitionBy("w1", "w2")
    text = Window.partitionBy("w1", "w2", "doc", "key")
    marked = firsts.withColumn("first_doc", F.min("doc").over(same)).withColumn("first_a", F.min("a").over(text))
    return marked.where("doc > first_doc OR a > first_a").select("doc", "key", "a", "b")


def repeated_spans(docs: DataFrame, window: int = 100, shard_rows: int = 20_000, filter_keys: int = 16_000_000) -> DataFrame:
    """Rows ``(doc, key, a, b)``: byte spans covered by windows that occur earlier; spans may overlap. ``docs`` are ``doc_id, text, key``.

    Anchor hashes are counted first. Those that occur twice or more go into a bit filter
    of bounded size, which is all that is broadcast; more than ``filter_keys`` of them
    are taken in several passes, each over a slice of the hashes. The contexts of an
    anchor with a very large number of occurrences are dealt over salted shards, each
    resolved by itself; the windows that are first in one then meet those of the others
    by content, so that equal ones do and different ones, however many, don't.
    """
    spark = docs.sparkSession
    counts = docs.mapInArrow(_hash_rows(window), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = settle(counts)
    distinct, total, most = counts.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    passes = max(1, math.ceil(distinct / filter_keys))
    shards, salts = max(1, math.ceil((total or 0) / passes / shard_rows)), max(1, math.ceil(2 * (most or 0) / shard_rows))
    crowded = counts.where(F.col("n") > shard_rows)
    # some 6 MB of packed contexts a task, as far as a shuffle bears so many tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, math.ceil((total or 0) / passes / 100_000)))
    spans: DataFrame | None = None
    for nth in range(passes if distinct else 0):
        shared = spark.sparkContext.broadcast([_bit_filter(counts, distinct, passes, nth), _bit_filter(crowded, min(distinct, (total or 0) // shard_rows), passes, nth)])
        packed = docs.mapInArrow(_context_rows(window, shared, passes, nth, shards, salts), "shard long, salt long, body binary")
        found = settle(packed.repartition(tasks, "shard", "salt").groupBy("shard", "salt").applyInArrow(_resolve(window), _FOUND_DDL))
        here = found.where("w1 IS NULL").select("doc", "key", "a", "b")
        if most > shard_rows:
            here = here.unionByName(_later_windows(found.where("w1 IS NOT NULL")))
        spans = here if spans is None else spans.unionByName(here)
    drop_settled(spark, counts)
    return spans if spans is not None else spark.createDataFrame([], "doc long, key long, a long, b long")


_CHUNK = 1 << 22  # bits


def _bit_filter(counts: DataFrame, keys: int, passes: int, nth: int) -> tuple[bytes, int]:
    """A filter's bytes and bits, set in parallel chunk by chunk: at most 4 bytes for each of ``filter_keys``."""
    bits = 1 << max(20, math.ceil(math.log2(16 * max(1, keys / passes))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            if passes > 1:
                h = h[_slice_of(h, passes) == nth]
            spot = (h % np.uint64(bits)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spot // _CHUNK), pa.array(spot % _CHUNK)], ["chunk", "bit"])

    def pack(table: pa.Table) -> pa.Table:
        flags = np.zeros(_CHUNK, bool)
        flags[table["bit"].to_numpy()] = True
        return pa.table({"chunk": [table["chunk"][0].as_py()], "body": [np.packbits(flags, bitorder="little").tobytes()]})

    chunks = counts.select("h").mapInArrow(fill, "chunk long, bit long").distinct().groupBy("chunk").applyInArrow(pack, "chunk long, body binary")
    out = bytearray(max(bits, _CHUNK) // 8)
    for r in chunks.toLocalIterator():
        at = r["chunk"] * _CHUNK // 8
        out[at : at + _CHUNK // 8] = r["body"]
    return bytes(out), bits


def dedup_substrings(docs: DataFrame, window: int = 100, shard_rows: int = 20_000, filter_keys: int = 16_000_000) -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_removed, spans, kept)``, one for each row of ``docs``.

    Texts are taken as UTF-8 bytes (null: empty). A byte goes if a ``window``-byte string
    that covers it also starts earlier: in a smaller doc_id, or in the same document. The
    input decides, not what is left. ``spans`` are the maximal removed runs, ``kept`` the
    other bytes, which need not be whole characters. doc_ids must be longs. Rows are told
    apart by doc_id and text: rows that repeat both are treated alike, none as the
    other's repeat; different texts of one doc_id don't precede each other. Rows with a
    null doc_id are left whole and no other's first. Other columns are ignored.
    """
    if not GRAM <= window <= 127:
        raise ValueError(f"window must be in {GRAM}..127")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    spans = repeated_spans(docs, window, shard_rows, filter_keys).groupBy("doc", F.col("key").alias("of")).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("raw"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, runs, kept = [], [], [], []
            for body, raw in zip(batch.column("body").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                data = zstandard.decompress(body) if body is not None else b""
                merged: list[list[int]] = []
                for s in raw or ():
                    if merged and s["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["b"])
                    else:
                        merged.append([s["a"], s["b"]])
                out, last = [], 0
                for a, b in merged:
                    out.append(data[last:a])
                    last = b
                out.append(data[last:])
                kept.append(b"".join(out))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(kept[-1]))
                runs.append([{"start": a, "end": b} for a, b in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            body = [press.compress(t.as_py().encode("utf-8", "surrogatepass")) if t.is_valid else None for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(body, pa.binary())], ["doc_id", "key", "body"])

    squeezed = docs.mapInArrow(squeeze, "doc_id long, key long, body binary")  # texts are shuffled once, compressed
    full = squeezed.join(spans, (F.col("doc_id") == F.col("doc")) & (F.col("key") == F.col("of")), "left").select("doc_id", "body", "raw")
    return full.mapInArrow(rewrite, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM (
    SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d))
), again AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM win WHERE nth > 1
), run AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM again) GROUP BY doc_id, r
), gap AS (
  SELECT d.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY a), 0) AS z, h FROM d JOIN run ON run.doc_id = d.doc_id
), part AS (
  SELECT doc_id, z AS place, substr(h, 2 * z + 1, 2 * (a - z)) AS x FROM gap
  UNION ALL SELECT d.doc_id, coalesce(e, 0), substr(h, 2 * coalesce(e, 0) + 1, len(h)) FROM d LEFT JOIN (SELECT doc_id, max(b) AS e FROM run GROUP BY 1) AS l ON l.doc_id = d.doc_id
), kept AS (
  SELECT doc_id, string_agg(x, '' ORDER BY place) AS x FROM part GROUP BY 1
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(s, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS s FROM run GROUP BY 1) USING (doc_id)
"""


def brute_force(rows: list[tuple[int | None, str | None]], window: int = 100) -> list[tuple[int, int, int, bytes]]:
    """The contract read literally, row by row; for tests."""
    where: dict[bytes, list[tuple[int, str | None, int]]] = {}
    raw = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
    for (doc, text), data in zip(rows, raw, strict=True):
        for s in range(len(data) - window + 1) if doc is not None else ():
            where.setdefault(data[s : s + window], []).append((doc, text, s))
    out = []
    for (doc, text), data in zip(rows, raw, strict=True):
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - window + 1) if doc is not None else ():
            if any(d < doc or (d == doc and t == text and at < s) for d, t, at in where[data[s : s + window]]):
                gone[s : s + window] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((len(data), len(data) - len(kept), runs, kept))
    return out
