"""Line dedup through a sharded minimal perfect hash.

One pass counts, for every line key, the documents that hold it. The keys that many
documents share go into shards by hash, each with a minimal perfect hash that leads
to a slot of compact arrays: a second hash as fingerprint, the document count and the
largest document. Documents then probe the arrays in place: no line is ever joined,
and no text is shuffled.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, drop_settled, held, settle

_STRIP = b" \t\n\x0b\x0c\r"
_SEED1, _SEED2 = 0x51, 0xA7
_GAMMA, _LEVELS = 2.0, 24
_ROW_BYTES = 21  # fingerprint 8, count 4, last document 8, two thirds of a byte of hash bits and ranks (a test measures it)


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()  # bytes.lower() changes A-Z alone


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(key, _SEED1), xxhash.xxh3_64_intdigest(key, _SEED2)


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser, one function for each level."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct uint64 keys: cascaded bit arrays; a key's slot is the rank of its bit.

    Bits are packed in 64-bit words, with one running count to a word. Keys that collide
    at every level (next to never) sit in a sorted tail.
    """

    def __init__(self, keys: np.ndarray):
        self.sizes: list[int] = []
        self.words: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        left = np.unique(keys.astype(np.uint64))
        self.n, self.total = len(left), 0
        for level in range(_LEVELS):
            if not len(left):
                break
            size = max(64, int(_GAMMA * len(left)))
            at = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.zeros(-(-size // 64) * 64, bool)
            alone[:size] = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int32)
            self.sizes.append(size)
            self.words.append(words)
            self.ranks.append(self.total + np.cumsum(counts, dtype=np.int32) - counts)
            self.total += int(counts.sum())
            left = left[~alone[at]]
        self.tail = left

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that is not in the set, any slot or -1."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(zip(self.sizes, self.words, self.ranks, strict=True)):
            at = _mix(keys[todo], level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = words[word]
            hit = ((here >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(here & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = ranks[word[hit]] + below[hit]
            todo = todo[~hit]
            if not len(todo):
                return out
        if len(self.tail):
            at = np.searchsorted(self.tail, keys[todo]).clip(max=len(self.tail) - 1)
            hit = self.tail[at] == keys[todo]
            out[todo[hit]] = self.total + at[hit]
        return out


class Shard:
    """One shard: the perfect hash and the arrays that its slots lead to."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, last: np.ndarray):
        _, first = np.unique(h1, return_index=True)
        later = np.setdiff1d(np.arange(len(h1)), first)  # distinct lines of one first hash, next to never: kept aside by both hashes
        self.twins = {(int(a), int(b)): int(d) for a, b, d in zip(h1[later], h2[later], last[later], strict=True)}
        h1, h2, count, last = h1[first], h2[first], count[first], last[first]
        self.hash = PerfectHash(h1)
        at = self.hash.slots(h1)
        self.finger, self.count, self.last = np.zeros(self.hash.n, np.uint64), np.zeros(self.hash.n, np.int32), np.zeros(self.hash.n, np.int64)
        self.finger[at], self.count[at], self.last[at] = h2, np.minimum(count, 2**31 - 1), last

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is a repeated line, its largest document)"""
        at = self.hash.slots(h1)
        known = (at >= 0) & (self.finger[at] == h2)
        doc = np.where(known, self.last[at], 0)
        for i, pair in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)) if self.twins else ():
            if pair in self.twins:
                known[i], doc[i] = True, self.twins[pair]
        return known, doc


def _count_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, n, last): doc_ids that hold a key and the largest. Distinct (key, doc_id) meet first, then their partial counts, so that no common line meets in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or doc is None:
                    continue
                keys = {k for line in text.encode("utf-8", "surrogatepass").split(b"\n") if len(line) >= min_chars and _long_enough(k := line_key(line), min_chars)}
                for k in keys:
                    x, y = _hashes(k)
                    a.append(x)
                    b.append(y)
                    ids.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), pa.array(ids, pa.int64())], ["h1", "h2", "doc"])

    lines = docs.select("doc_id", "text").mapInArrow(run, "h1 long, h2 long, doc long")
    return lines.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("last"))


def _shards(hot: DataFrame, shards: int) -> DataFrame:
    """(shard, pickled Shard): built in parallel; shards are even, since keys are distinct hashes."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h1 = pdf["h1"].to_numpy(np.int64).view(np.uint64)
        made = Shard(h1, pdf["h2"].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(np.int64), pdf["last"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "body": [pickle.dumps(made, protocol=5)]})

    return hot.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(build, "shard long, body binary")


def _probe(docs: DataFrame, index, shards: int, min_chars: int) -> DataFrame:
    """Adds to each document's ``hits`` the numbers of the lines that these shards tell to drop."""
    schema, name = docs.schema, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_shards = held(name, lambda: {s: pickle.loads(b) for s, b in index.value})
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            a, b, row, no = [], [], [], []
            for r, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                if not text or doc is None:
                    continue
                for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                    if len(line) >= min_chars and _long_enough(k := line_key(line), min_chars):
                        x, y = _hashes(k)
                        a.append(x)
                        b.append(y)
                        row.append(r)
                        no.append(i)
            h1, h2 = np.array(a, np.uint64), np.array(b, np.uint64)
            shard = np.mod(h1.view(np.int64), shards) if len(a) else np.array([], np.int64)
            drop = np.zeros(len(a), bool)
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
            docs_of = np.array([ids[r] for r in row], np.int64)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                at = order[lo:hi]
                if (s := known_shards.get(int(shard[at[0]]))) is not None:
                    known, last = s.probe(h1[at], h2[at])
                    drop[at] = known & (last != docs_of[at])
            hits: list[list[int]] = [x or [] for x in batch.column("hits").to_pylist()]
            for j in np.flatnonzero(drop):
                hits[row[j]].append(no[j])
            at = batch.schema.get_field_index("hits")
            yield batch.set_column(at, batch.schema.field(at), pa.array(hits, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 65_536, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Rows ``(doc_id, n_lines, n_dropped, text)``, one for each row of ``docs``, text being what is left.

    Lines are split at ``\\n``. A key is the line stripped of ASCII white space with A-Z
    lower-cased. A key of at least ``min_chars`` code points that at least ``min_docs``
    doc_ids hold loses all its lines, but those of the largest doc_id that holds it. A
    null or empty text is one empty line. Rows that repeat a doc_id are parts of one
    document: they count once and keep or lose a line alike. Rows with a null doc_id
    neither count nor lose lines. Columns of ``docs`` other than doc_id and text are
    ignored.

    The index is broadcast in passes of at most ``broadcast_bytes``; each holds whole
    shards. With more than one pass, documents are written between passes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hot = cut(_count_lines(docs, min_chars).where(F.col("n") >= min_docs))
    n = hot.count()
    state = docs.withColumn("hits", F.array().cast("array<int>"))
    old: DataFrame | None = None
    if n:
        shards = max(1, math.ceil(n / shard_keys))
        per_pass = max(1, broadcast_bytes // (_ROW_BYTES * shard_keys))
        built = _shards(hot, shards)
        if shards > per_pass:
            built = settle(built)
        for first in range(0, shards, per_pass):
            part = built.where((F.col("shard") >= first) & (F.col("shard") < first + per_pass))
            index = spark.sparkContext.broadcast([(r["shard"], bytes(r["body"])) for r in part.toLocalIterator()])
            state = _probe(state, index, shards, min_chars)
            if first + per_pass < shards:
                state = settle(state)
                if old is not None:
                    drop_settled(spark, old)
                old = state
    return _rewrite(state)


def _rewrite(state: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, out = [], [], []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                text = text or ""
                if not hits:
                    n_lines.append(text.count("\n") + 1)
                    out.append(text)
                else:
                    lines, gone = text.split("\n"), set(hits)
                    n_lines.append(len(lines))
                    out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
                n_dropped.append(len(hits or ()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    return state.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text string")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, line, pos, hot.k IS NOT NULL AND hot.last <> doc_id AS gone
  FROM keyed LEFT JOIN hot ON keyed.k = hot.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
