"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a document with at most k edits leaves at least one of its k + 1
pieces unchanged. Exact piece hits, found for all items in one pass over a text, give
the windows in which Myers' bit-parallel search then measures the edit distance. Short
items, which are also found inside of other words, count at word borders only.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import held, settle, unused


def normal(text: str) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their offsets."""
    n, parts = len(item), budget + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> int:
    """Smallest edit distance of the pattern to any substring of ``text``."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | (full & ~(xv | ph))
        mv = ph & xv
    return best


def _joins(c: str) -> bool:
    """Whether the character is part of a word; those of scripts that put no blanks between words stand alone."""
    alone = "\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or "\U00020000" <= c <= "\U0003ffff"
    return not alone and (c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M")


def border(text: str, at: int) -> bool:
    """Whether no word goes on across the place before ``text[at]``."""
    return not 0 < at < len(text) or not (_joins(text[at - 1]) and _joins(text[at]))


def bordered(item: str, text: str, lo: int, hi: int) -> int:
    """Smallest edit distance of the item to any substring of ``text[lo:hi]`` between word borders of ``text``."""
    n = len(item)
    row, best = [i if border(text, lo) else n + 1 + i for i in range(n + 1)], n
    for at in range(lo, hi):
        ends = border(text, at + 1)
        new = [0 if ends else row[0] + 1]
        for i in range(1, n + 1):
            new.append(min(row[i - 1] + (item[i - 1] != text[at]), row[i] + 1, new[i - 1] + 1))
        row = new
        if ends:
            best = min(best, row[n])
    return best


class Matcher:
    """The items of one block: an automaton over their pieces, and their bit masks (none for items under ``min_chars``)."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int = 0):
        self.items = [(i, t, int(len(t) * error_rate), masks(t) if len(t) >= min_chars else None) for i, t in items]
        self.machine = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k, _) in enumerate(self.items):
            for at, piece in pieces(t, k):
                where.setdefault(piece, []).append((n, at))
        for piece, spots in where.items():
            self.machine.add_word(piece, (len(piece), spots))
        self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item_id, distance) of every item within its budget."""
        if not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        whole: set[int] = set()
        for end, (size, spots) in self.machine.iter(text):
            for n, at in spots:
                _, t, k, peq = self.items[n]
                if peq is None and k == 0:
                    if n not in whole and border(text, end + 1 - size) and border(text, end + 1):
                        whole.add(n)
                    continue
                lo = end + 1 - size - at - k
                hi = lo + len(t) + 2 * k
                own = windows.setdefault(n, [])
                if own and lo <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], hi)
                    own[-1][0] = min(own[-1][0], lo)
                else:
                    own.append([lo, hi])
        out = [(self.items[n][0], 0) for n in whole]
        for n, spans in windows.items():
            ident, t, k, peq = self.items[n]
            if peq is None:
                best = min(bordered(t, text, max(0, lo), min(hi, len(text))) for lo, hi in spans)
            else:
                best = min(myers(peq, len(t), text[max(0, lo) : hi]) for lo, hi in spans)
            if best <= k:
                out.append((ident, best))
        return sorted(out)


def _blocks(benchmark: DataFrame, min_chars: int, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items, a bounded number of characters at a time, whatever the size of the benchmark."""
    block, size = [], 0
    for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        t = normal(r["text"])
        if not t:
            continue
        block.append((r["item_id"], t))
        size += max(len(t), min_chars)  # a short item takes no less memory
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, out: str = "leaks", error_rate: float = 0.05, min_chars: int = 24, block_chars: int = 4_000_000) -> DataFrame:
    """``docs`` with ``out array<struct<item_id, distance>>``, by item_id, one row for each row of ``docs``.

    Texts and items are compared in lower case with white space collapsed. An item of n
    characters leaks where some substring of the whole text is within int(error_rate n)
    edits; ``distance`` is the smallest. Of items under ``min_chars`` characters the
    substring must also start and end at word borders (see ``border``); under 1 /
    error_rate characters (20) that is the item word for word. Null, empty and blank
    items are left out; a null or empty text has no leaks. Repeated items each count. An
    earlier column named ``out`` is replaced.

    Items are broadcast in blocks of about ``block_chars`` characters; a worker builds a
    block's automaton once for its tasks. One block is matched in place. With more, the
    numbered documents are written once, each block reads them and hands on its hits
    alone, and these are joined back, so that no benchmark is too large.
    """
    spark, docs = docs.sparkSession, docs.drop(out)
    blocks = _blocks(benchmark, min_chars, block_chars)
    one, two = next(blocks, []), next(blocks, None)
    if two is None:
        return _matched(docs, spark.sparkContext.broadcast(one), out, error_rate, min_chars)
    (row,) = unused(docs, "__row")
    rows = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    hits: DataFrame | None = None
    for block in chain((one, two), blocks):
        part = _matched(rows.select(row, "text"), spark.sparkContext.broadcast(block), out, error_rate, min_chars)
        part = part.where(F.size(out) > 0).select(row, F.explode(out).alias("hit"))
        hits = part if hits is None else hits.unionByName(part)
    found = hits.groupBy(row).agg(F.array_sort(F.collect_list("hit")).alias(out))
    return rows.join(found, row, "left").select(*docs.columns, F.coalesce(out, F.expr(f"CAST(array() AS {_LEAKS})")).alias(out))


_LEAKS = "array<struct<item_id: bigint, distance: int>>"


def _matched(docs: DataFrame, shared, out: str, error_rate: float, min_chars: int) -> DataFrame:
    """``docs`` with the hits of one block of items."""
    state, name = docs.withColumn(out, F.expr(f"CAST(array() AS {_LEAKS})")), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = held(name, lambda: Matcher(shared.value, error_rate, min_chars), most=1)
        for batch in batches:
            at = batch.schema.get_field_index(out)
            leaks = [[{"item_id": i, "distance": d} for i, d in matcher.find(normal(t))] if (t := text.as_py()) else [] for text in batch.column("text")]
            yield batch.set_column(at, batch.schema.field(at), pa.array(leaks, batch.schema.field(at).type))

    return state.mapInArrow(run, state.schema)


def digest(found: DataFrame) -> DataFrame:
    pairs = F.transform("leaks", lambda x: F.concat_ws(":", x["item_id"], x["distance"]))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), F.array_join(pairs, ",").alias("items"))


def brute_force(docs: pd.DataFrame, benchmark: pd.DataFrame, error_rate: float = 0.05, min_chars: int = 24) -> dict[int, list[tuple[int, int]]]:
    """Every item against every text by the plain recurrence; for tests."""

    def distance(item: str, text: str) -> int:
        if len(item) < min_chars:  # every substring between two borders
            near = int(len(item) * error_rate)
            at = [i for i in range(len(text) + 1) if border(text, i)]
            return min((edits(item, text[a:b]) for a in at for b in at if abs(b - a - len(item)) <= near), default=len(item))
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            prev, row[0] = row[0], i
            for j, d in enumerate(text, 1):
                prev, row[j] = row[j], min(prev + (c != d), row[j] + 1, row[j - 1] + 1)
        return min(row)

    def edits(x: str, y: str) -> int:
        row = list(range(len(y) + 1))
        for c in x:
            prev, row[0] = row[0], row[0] + 1
            for j, d in enumerate(y, 1):
                prev, row[j] = row[j], min(prev + (c != d), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    items = [(i, normal(t)) for i, t in zip(benchmark["item_id"], benchmark["text"], strict=True) if t and normal(t)]
    return {d: [(i, b) for i, t in sorted(items) if (b := distance(t, normal(x or ""))) <= int(len(t) * error_rate)] for d, x in zip(docs["doc_id"], docs["text"], strict=True)}
