"""Source divergence audit over a byte-level tokenizer.

The texts of an Arrow batch lie in one UTF-8 buffer, so a table over byte values finds
every term boundary at once: letters of ASCII and all bytes of longer characters belong to
terms. Slices are grouped by xxhash and the grouping is verified byte by byte. Counts by
(lang, source, term) are added up by Spark, and so are the document frequencies that keep
a term. The kept counts then pass through the tasks as sparse rows, a row a term and a
column a source; what each pair of sources that share a term adds to their divergence
is summed by pair with ``reduceat``. What terms of one source alone add depends on their
count only, so it comes from each source's histogram of counts. All numbers are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import settle

SCALE = 1_000_000_000

_BYTE = np.arange(256)
#: Which bytes belong to a term, and what they become: only A-Z are lower-cased.
_TERM = (_BYTE >= 0x80) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 0x20, _BYTE).astype(np.uint8)


def term_slices(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every term in texts that lie one after another and end at ``ends``."""
    inside = _TERM[data]
    # a text's first byte begins a term whatever the text before it ends with
    fresh = np.zeros(len(data) + 1, bool)
    fresh[ends] = fresh[0] = True
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | fresh[:-1]))
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return start, end, np.searchsorted(ends, start, side="right")


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, portion: int = 1 << 18) -> np.ndarray:
    """Whether the slices of these sizes at ``a`` and at ``b`` are equal; about ``portion`` bytes are looked at at a time."""
    same, total = np.ones(len(a), bool), np.cumsum(size)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + portion, side="right")))
        n = size[at:to]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        differs = data[np.repeat(a[at:to], n) + within] != data[np.repeat(b[at:to], n) + within]
        same[at:to] = np.add.reduceat(differs, first) == 0
        at = to
    return same


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The terms at these slices, in order: what lies between is blanked out, so that the bytes can be split at blanks."""
    part = data[start[0] : end[-1]]
    part = np.where(_TERM[part], part, np.uint8(0x20))
    touching = start[1:][start[1:] == end[:-1]] - start[0]  # a text that ends in a term, before one that begins with one
    return np.insert(part, touching, 0x20).tobytes().split()


def group_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashed=xxhash.xxh64_intdigest, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group); slices are in one group if their bytes are equal. Slices are those of ``term_slices``; ``block`` of them are cut out at a time."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end - start
    keys = np.empty(len(start), np.uint64)
    for at in range(0, len(start), block):
        a, b = start[at : at + block], end[at : at + block]
        keys[at : at + block] = np.fromiter(map(hashed, _cut(data, a, b)), np.uint64, len(a))
    _, lead, group = np.unique(keys, return_index=True, return_inverse=True)
    del keys
    other = size != size[lead[group]]
    equal = np.flatnonzero(~other)
    other[equal] = ~_same_bytes(data, start[equal], start[lead[group[equal]]], size[equal])
    named: dict[bytes, int] = {}  # slices whose hash is that of another term
    for i in np.flatnonzero(other).tolist():
        term = data[start[i] : end[i]].tobytes()
        if term not in named:
            named[term] = len(lead)
            lead = np.append(lead, i)
        group[i] = named[term]
    return group, lead


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and where each text ends."""
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends[1:] - ends[0]


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices as strings; their bytes are taken as they are."""
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    raw = data.tobytes()
    joined = b"".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(joined))


def _count(batches: Iterator[pa.RecordBatch], portion: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by lang and source; a row without a term for each group.

    A portion takes some 20 times its bytes of memory while it is counted, in each worker.
    """
    for batch in batches:
        for rows in _portions(batch, portion):
            keys = pa.table({"lang": rows.column("lang"), "source": rows.column("source")}).group_by(["lang", "source"]).aggregate([])
            place = {k: i for i, k in enumerate(zip(keys["lang"].to_pylist(), keys["source"].to_pylist(), strict=True))}
            of = np.array([place[k] for k in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), strict=True)])
            data, ends = _texts(rows.column("text"))
            start, end, doc = term_slices(data, ends)
            data = _LOWER[data]
            group, lead = group_slices(data, start, end)
            terms = _strings(data, start[lead], end[lead])
            del data, start, end
            pair = doc * (len(lead) + 1) + group  # a document and a term
            del doc, group
            pair.sort()
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(pair)))
            where, term = np.divmod(pair[first], len(lead) + 1)
            cell = of[where] * (len(lead) + 1) + term
            del pair, where, term
            order = np.argsort(cell, kind="stable")
            cell, times = cell[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
            n = np.add.reduceat(times, first) if len(first) else first
            docs = np.diff(np.append(first, len(cell)))
            who, term = np.divmod(cell[first], len(lead) + 1)
            none = pa.nulls(len(place), pa.string())
            terms = pa.concat_arrays([terms.take(pa.array(term)), none])
            who = pa.array(np.concatenate([who, np.arange(len(place))]))
            zero = np.zeros(len(place), np.int64)
            yield pa.RecordBatch.from_arrays([keys["lang"].combine_chunks().take(who), keys["source"].combine_chunks().take(who), terms, pa.array(np.concatenate([n, zero]).astype(np.int64)), pa.array(np.concatenate([docs, zero]).astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def _portions(batch: pa.RecordBatch, portion: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about so many bytes of text; a longer text is one of its own."""
    _, ends = _texts(batch.column("text")) if len(batch) else (None, np.zeros(0, np.int64))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + portion, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)); decimals where a long would not hold the product."""
    fits = n < (1 << 63) // SCALE - 1
    short = F.call_function("div", (F.when(fits, n).otherwise(0) + 1) * SCALE, total + terms)
    up = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.when(fits, short).otherwise(F.call_function("div", up, (total + terms).cast("decimal(20,0)")).cast("long"))


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), in longs: p and q are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q).cast("long")


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("extra", pa.int64())])


def _shared(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """For each pair of sources, what the terms they share add to the sum over their terms taken one source at a time.

    Rows come ordered by lang and term, all rows of a term in one task. They are taken as
    sparse rows, a row a term; of the pairs of cells in a row about ``most`` are laid out
    at a time, and summed by pair before the next ones are.
    """
    held: pa.Table | None = None

    def added(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        langs, sources = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
        fresh = _changes(rows)
        indptr = np.append(np.flatnonzero(fresh), len(fresh))
        p, zero = (rows[c].to_numpy() for c in ("p", "zero"))
        width = np.repeat(np.diff(indptr), np.diff(indptr))  # cells in each cell's row
        begin = np.repeat(indptr[:-1], np.diff(indptr))
        total, at = np.cumsum(width), 0
        while at < len(width):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
            n = width[at:to]
            a = np.repeat(np.arange(at, to), n)
            b = np.repeat(begin[at:to], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            a, b = a[a != b], b[a != b]
            extra = _gaps(p[a], p[b]) - _gaps(p[a], zero[b]) - _gaps(zero[a], p[b]) + _gaps(zero[a], zero[b])
            key = (lang[a] * len(sources.dictionary) + source[a]) * len(sources.dictionary) + source[b]
            order = np.argsort(key, kind="stable")
            key, extra = key[order], extra[order]
            if len(key):
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                rest, other = np.divmod(key[first], len(sources.dictionary))
                where, one = np.divmod(rest, len(sources.dictionary))
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(where)), sources.dictionary.take(pa.array(one)), sources.dictionary.take(pa.array(other)), pa.array(np.add.reduceat(extra, first))], schema=_PAIRS)
            at = to

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        starts = np.flatnonzero(_changes(held)) if len(held) else np.zeros(0, np.int64)
        if len(starts) > 1:  # the last term may go on in the next batch
            yield from added(held.slice(0, int(starts[-1])))
            held = held.slice(int(starts[-1]))
    if held is not None and len(held):
        yield from added(held)


def _changes(rows: pa.Table) -> np.ndarray:
    """Where a term begins in rows ordered by lang and term."""
    out = np.ones(len(rows), bool)
    if len(rows) > 1:
        lang, term = (rows[c].combine_chunks() for c in ("lang", "term"))
        differs = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1]))
        out[1:] = differs.to_numpy(zero_copy_only=False)
    return out


def audit_sources(docs: DataFrame, least_docs: int = 3, top: int = 200, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Rows ``(lang, source, part, item, value, rank)``: how far each source of a language lies from the others (part ``pair``), and by which terms it stands out (part ``term``, the first ``top``).

    Every row of ``docs`` is a document, repeated rows too; null texts, langs and sources
    are ''. A language keeps the terms that at least ``least_docs`` of its documents hold.
    A language without kept terms has pairs of value 0 and no terms; an empty table gives
    no rows. A long text takes memory for its own bytes and terms; one term longer than a
    portion is compared by itself. Other columns are ignored.

    A row per (lang, source, term) is shuffled after each task has added up its own, so a
    word that is in every document costs a row a task. The rows of one term in one language
    meet in one task: as many as there are sources. Between sources the result itself has a
    row for every pair of one language; nothing is collected or broadcast by hand.
    """
    blank = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), blank).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    cells = counted.select("lang", "source", "term", "n", F.sum("docs").over(whole).alias("docs"), F.sum("n").over(whole).alias("n_lang"), F.row_number().over(whole.orderBy("source")).alias("nth"))
    cells = settle(cells.where((F.col("docs") >= least_docs) | F.col("term").isNull()))
    kept = F.col("term").isNotNull()
    groups = cells.groupBy("lang", "source").agg(F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("total"), F.sum(F.when(kept & (F.col("nth") == 1), 1).otherwise(0)).alias("firsts"))
    per_lang = groups.groupBy("lang").agg(F.sum("firsts").alias("terms"), F.sum("total").alias("lang_total"))
    groups = settle(groups.join(per_lang, "lang").select("lang", "source", "total", "terms", "lang_total", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).alias("zero")))

    named = cells.where(kept).join(groups, ["lang", "source"])
    named = named.select("lang", "source", "term", "n", "n_lang", "lang_total", "terms", "zero", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    return _pairs(named, groups).unionByName(_terms(named, top))


def _pairs(named: DataFrame, groups: DataFrame) -> DataFrame:
    cell = named.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term")
    both = cell.mapInArrow(_shared, "lang string, source string, item string, extra long").groupBy("lang", "source", "item").agg(F.sum("extra").alias("extra"))

    mine = groups.select("lang", "source", "terms", "zero")
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("their_zero"))
    pairs = mine.join(other, "lang").where("source <> item")
    p, zero, theirs, times = F.col("p"), F.col("zero"), F.col("their_zero"), F.col("times")
    # the terms of one source alone, by their counts
    spread = named.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("times"))
    spread = spread.join(other, "lang").where("source <> item")
    alone = spread.groupBy("lang", "source", "item").agg(F.sum(times * (_gap(p, theirs) - _gap(zero, theirs))).alias("as_p"), F.sum(times * (_gap(theirs, p) - _gap(theirs, zero))).alias("as_q"))
    as_p = alone.select("lang", "source", "item", "as_p")
    as_q = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "as_q")
    out = pairs
    for part in (both, as_p, as_q):
        out = out.join(part, ["lang", "source", "item"], "left")
    none = F.lit(0).cast("long")
    value = F.coalesce(F.col("terms") * _gap(zero, theirs), none) + F.coalesce("as_p", none) + F.coalesce("as_q", none) + F.coalesce("extra", none)
    out = out.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(named: DataFrame, top: int) -> DataFrame:
    rows = named.withColumn("q", _share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))).where((F.col("n") > 0) & (F.col("p") > F.col("q")))
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce("text", '') AS t FROM documents
), seen AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM seen GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), size AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), grp AS (
  SELECT DISTINCT lang, source FROM d
), cnt AS (
  SELECT grp.lang, grp.source, kept.term, count(seen.term) AS n FROM grp JOIN kept ON kept.lang = grp.lang
  LEFT JOIN seen ON seen.lang = grp.lang AND seen.source = grp.source AND seen.term = kept.term GROUP BY ALL
), tot AS (
  SELECT lang, source, sum(n) AS n FROM cnt GROUP BY ALL
), p AS (
  SELECT cnt.lang, cnt.source, cnt.term, cnt.n, 1 + (1000000000::HUGEINT * (cnt.n + 1)) // (tot.n + size.v) AS p FROM cnt JOIN tot USING (lang, source) JOIN size USING (lang)
), q AS (
  SELECT kept.lang, kept.term, 1 + (1000000000::HUGEINT * (kept.n + 1)) // (size.n + size.v) AS q FROM kept JOIN size USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value FROM grp AS a JOIN grp AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""
