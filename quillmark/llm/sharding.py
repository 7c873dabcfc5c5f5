"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a 60-bit hash. It starts at the depth
just short of which shards would fit if bytes were even; only buckets over the byte
limit then split, each on the next bit. Splitting works on (hash prefix, bytes) sums,
not on documents, which are read again only for the few buckets that are still too
large at the summed depth. Where rows of one key overflow a bucket by themselves, their
hash takes in the text and, for equal texts, the row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, settle, unused

HASH_BITS = 60
_FINE = 6  # sums are kept at so many bits below the depth that splitting starts from


def _hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _among(h: Column, keys: DataFrame, docs: DataFrame, flag: str) -> DataFrame:
    """``docs`` with ``flag``: whether their hash is one of ``keys``, which are broadcast up to a million (8 MB)."""
    known = keys.select(F.col("lo").alias(f"{flag}h"), F.lit(True).alias(flag))
    out = docs.join(F.broadcast(known) if keys.count() <= 1_000_000 else known, h == F.col(f"{flag}h"), "left")
    return out.withColumn(flag, F.coalesce(flag, F.lit(False))).drop(f"{flag}h")


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, HASH_BITS - bits)


def _summed(rows: DataFrame, bits: int) -> DataFrame:
    sums = rows.groupBy(_prefix(F.col("h"), bits).alias("p"))
    return sums.agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))


def _split(cells: DataFrame, bits: int, base: int, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """From sums at ``bits``: the buckets that fit, each at its shallowest depth from ``base`` on, and the prefixes that don't."""
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(bits)))).withColumn("q", F.expr(f"shiftright(p, {bits} - depth)"))
    buckets = levels.groupBy("depth", "q").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    buckets = cut(buckets.withColumn("fits", (F.col("shard_bytes") <= max_bytes) | (F.col("lo") == F.col("hi"))))
    split = buckets.where("NOT fits").select((F.col("depth") + 1).alias("depth"), F.col("q").alias("parent"))
    fit = buckets.where("fits").withColumn("parent", F.shiftright("q", 1))
    found = fit.where(F.col("depth") == base).unionByName(fit.where(F.col("depth") > base).join(split, ["depth", "parent"], "left_semi"))
    return found.select("depth", "q", "shard_bytes", "shard_docs", "lo"), buckets.where(f"NOT fits AND depth = {bits}").select(F.col("q").alias("p"))


def build_directory(docs: DataFrame, max_bytes: int) -> DataFrame:
    """``depth, q, shard_bytes, shard_docs, lo`` (least hash) of every shard; input ``h, b`` (hash, bytes)."""
    total = docs.agg(F.sum("b")).first()[0] or 0
    start = max(0, math.ceil(math.log2(max(1.0, total / max_bytes))) - 1)
    bits, base, directory = min(HASH_BITS, start + _FINE), start, None
    while True:
        found, wide = _split(cut(_summed(docs, bits)), bits, base, max_bytes)
        directory = found if directory is None else directory.unionByName(found)
        if bits == HASH_BITS or wide.isEmpty():
            return directory
        docs = docs.join(cut(wide), _prefix(F.col("h"), bits) == F.col("p"), "left_semi")
        base, bits = bits + 1, min(HASH_BITS, bits + _FINE)


def shard_by_bytes(docs: DataFrame, max_bytes: int = 64 << 20, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes, shard_id, shard_depth, shard_bytes, shard_docs, oversized``.

    ``shard_id`` is the shard's hash prefix as a bit string ('' if one shard holds all).
    Bytes are those of the text in UTF-8 (null: 0). A shard exceeds ``max_bytes`` only if
    a single row does; ``oversized`` is then true. Rows of one key, null included, stay
    together unless they overflow a shard by themselves: then the text joins in the hash,
    and for rows equal in that too, which stand for each other, their place. Earlier
    columns of the added names are replaced. An empty input gives an empty result.

    The directory is joined, not broadcast: documents and directory are dealt by the
    shallowest prefix in use, under which a prefix's few entries travel as one array.
    """
    names = ("n_bytes", "shard_id", "shard_depth", "shard_bytes", "shard_docs", "oversized")
    docs = docs.drop(*names).withColumn("n_bytes", F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")))
    keep = docs.columns
    h, flag, row, p, own, entry = unused(docs, "__h", "__flag", "__row", "__p", "__dir", "__e")
    docs = docs.withColumn(h, _hash(F.col(key)))
    for more in (lambda: F.col(text_col), lambda: F.col(row)):
        directory = cut(build_directory(docs.select(F.col(h).alias("h"), F.col("n_bytes").alias("b")), max_bytes))
        crowded = directory.where((F.col("shard_bytes") > max_bytes) & (F.col("shard_docs") > 1)).select("lo")
        if crowded.isEmpty():
            break
        if row not in docs.columns:
            docs = docs.withColumn(row, F.monotonically_increasing_id())
        else:
            docs = settle(docs)  # a row keeps its place
        mixed = _hash(F.concat_ws("\u0000", F.col(h), more()))
        docs = _among(F.col(h), crowded, docs, flag).withColumn(h, F.when(F.col(flag), mixed).otherwise(F.col(h))).drop(flag)
    else:
        directory = cut(build_directory(docs.select(F.col(h).alias("h"), F.col("n_bytes").alias("b")), max_bytes))
    top = directory.agg(F.min("depth")).first()[0] or 0
    packed = directory.groupBy(F.expr(f"shiftright(q, depth - {top})").alias(p))
    packed = packed.agg(F.collect_list(F.struct("depth", "q", "shard_bytes", "shard_docs")).alias(own))
    hit = F.expr(f"filter({own}, e -> e.q = shiftright({h}, {HASH_BITS} - e.depth))[0]")
    e = F.col(entry)
    bits = F.when(e["depth"] > 0, F.lpad(F.bin(e["q"]), e["depth"], F.lit("0"))).otherwise("")
    joined = docs.withColumn(p, _prefix(F.col(h), top)).join(packed, p).withColumn(entry, hit)
    return joined.select(
        *keep,
        bits.alias("shard_id"),
        e["depth"].alias("shard_depth"),
        e["shard_bytes"].alias("shard_bytes"),
        e["shard_docs"].alias("shard_docs"),
        (e["shard_bytes"] > max_bytes).alias("oversized"),
    )


def oracle(max_bytes: int) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents
), t AS (
  SELECT greatest(0, CAST(ceil(log2(greatest(1.0, sum(n_bytes)::DOUBLE / {max_bytes}))) AS INT) - 1) AS start FROM d
), levels AS (
  SELECT doc_id, n_bytes, h, CAST(s AS INT) AS depth, h >> CAST({HASH_BITS} - s AS BIGINT) AS q
  FROM d, t, LATERAL unnest(range(t.start, {HASH_BITS + 1})) AS u(s)
), sums AS (
  SELECT *, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_docs, min(h) OVER w = max(h) OVER w AS single
  FROM levels WINDOW w AS (PARTITION BY depth, q)
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS rn FROM sums WHERE shard_bytes <= {max_bytes} OR single
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(q), depth, '0') END AS shard_id, depth AS shard_depth,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_docs AS BIGINT) AS shard_docs, shard_bytes > {max_bytes} AS oversized
FROM leaf WHERE rn = 1
"""
