"""Embedding near-dedup by an epsilon grid order join.

Unit vectors within a cosine of c are within a distance of sqrt(2 - 2c). Vectors are
rotated to principal axes and sorted by their grid cells of that width on the leading
axes; the sorted sequence is cut into blocks. Pairs of sequence intervals are then joined
recursively, from the top of a tree of intervals down to blocks: a pair whose bounding
boxes are provably farther apart than epsilon is dropped with everything below it. Only
block pairs that remain are compared vector by vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import components, cut, drop_settled, settle

_FAN = 3  # bits: intervals of eight


def _valid(vec: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & ok & F.exists(vec, lambda x: x != 0)


def _axes(vectors: DataFrame, leading: int, sample: int, seed: int = 11) -> dict[int, np.ndarray]:
    """For each vector length, orthonormal leading axes from a bounded sample; any orthonormal axes keep the join exact."""
    n = vectors.count()
    share = min(1.0, sample / max(1, n))
    rows = vectors.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vec").limit(2 * sample).toPandas()
    out: dict[int, np.ndarray] = {}
    for size, part in rows["vec"].groupby(rows["vec"].map(len)):
        m = np.stack(part.to_numpy()).astype(float)
        m /= np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        _, _, vt = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
        out[int(size)] = vt[:leading].T
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


_BLOCK = "label string, size int, part int, nth int, lo array<double>, hi array<double>, ids binary, counts binary, vecs binary"


def _blocks(vectors: DataFrame, axes: dict[int, np.ndarray], eps: float, leading: int, block: int) -> DataFrame:
    """The sorted sequence in blocks: vectors of one label and length each, with their bounding boxes."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros((len(pdf), leading))
            for size, rows in pdf.groupby(pdf["vec"].map(len)).indices.items():
                u = _unit(np.stack(pdf["vec"].to_numpy()[rows]).astype(float))
                basis = axes.get(int(size), np.eye(int(size))[:, :leading])
                out[rows, : basis.shape[1]] = u @ basis
            yield pdf.assign(at=list(out), cell=list(np.floor(out / eps).astype(np.int32)))

    placed = vectors.mapInPandas(project, "id long, label string, vec array<double>, n long, size int, at array<double>, cell array<int>")
    cells = [F.col("cell")[i] for i in range(leading)]
    order = ["label", "size", *cells, "id"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        nth = 0

        def full(pdf: pd.DataFrame) -> dict:
            nonlocal nth
            at = np.stack(pdf["at"].to_numpy())
            row = {"label": pdf["label"].iloc[0], "size": pdf["size"].iloc[0], "part": pdf["part"].iloc[0], "nth": nth, "lo": at.min(axis=0), "hi": at.max(axis=0)}
            row |= {"ids": pdf["id"].to_numpy(np.int64).tobytes(), "counts": pdf["n"].to_numpy(np.int64).tobytes(), "vecs": np.stack(pdf["vec"].to_numpy()).astype(np.float64).tobytes()}
            nth += 1
            return row

        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            out = []
            change = (held["label"] != held["label"].shift()) | (held["size"] != held["size"].shift())
            runs = [g for _, g in held.groupby(change.cumsum(), sort=False)]
            held = None
            for i, g in enumerate(runs):
                end = len(g) if i < len(runs) - 1 else len(g) // block * block
                out += [full(g.iloc[a : min(a + block, end)]) for a in range(0, end, block)]
                if end < len(g):
                    held = g.iloc[end:].reset_index(drop=True)
            if out:
                yield pd.DataFrame(out)
        if held is not None and len(held):
            yield pd.DataFrame([full(held)])

    return settle(dealt.mapInPandas(pack, _BLOCK))


def _near(eps: float) -> Column:
    """Whether two bounding boxes come within epsilon (a little more, for rounding)."""
    gap = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= (eps * (1 + 1e-9)) ** 2


def _block_pairs(blocks: DataFrame, eps: float, leading: int) -> DataFrame:
    """Pairs ``a <= b`` of block numbers that are not provably distant."""
    level = cut(blocks.select("label", "size", F.col("no").alias("node"), "lo", "hi"))
    box = [F.array(*[f(F.col(c)[i]) for i in range(leading)]).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]
    levels = [level]
    while _wide(levels[-1]):
        up = levels[-1].groupBy("label", "size", F.shiftright("node", _FAN).alias("node")).agg(*box)
        levels.append(cut(up))
    top = levels.pop()

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("label", "size", F.col("node").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))

    pairs = side(top, "a").join(side(top, "b"), ["label", "size"]).where("a <= b").where(_near(eps)).select("label", "size", "a", "b")
    while levels:
        below = levels.pop()
        for s in "ab":
            inner = side(below, "x").select("label", "size", F.shiftright("x", _FAN).alias(s), F.col("x").alias(f"{s}{s}"), F.col("lo_x").alias(f"lo_{s}"), F.col("hi_x").alias(f"hi_{s}"))
            pairs = pairs.join(inner, ["label", "size", s])
        pairs = cut(pairs.where("aa <= bb").where(_near(eps)).select("label", "size", F.col("aa").alias("a"), F.col("bb").alias("b")))
    return pairs.select("a", "b")


def _wide(level: DataFrame) -> bool:
    """Whether a label still has more nodes than one interval holds."""
    return level.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] > 1 << _FAN


def _compare(cosine: float):
    def links(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        return (x @ y.T) >= cosine * np.outer(nx, ny)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ia, ib = np.frombuffer(r.ids_a, np.int64), np.frombuffer(r.ids_b, np.int64)
                ca, cb = np.frombuffer(r.counts_a, np.int64), np.frombuffer(r.counts_b, np.int64)
                x, y = (np.frombuffer(v, np.float64).reshape(len(i), -1) for v, i in ((r.vecs_a, ia), (r.vecs_b, ib)))
                scale = [np.abs(m).max(axis=1, keepdims=True) for m in (x, y)]
                near = links(x / scale[0], y / scale[1])
                same = r.a == r.b
                if same:
                    np.fill_diagonal(near, False)
                deg = [(ia, near @ cb)] if same else [(ia, near @ cb), (ib, near.T @ ca)]
                ids, n = np.concatenate([i for i, _ in deg]), np.concatenate([d for _, d in deg])
                root = _roots(near, ia, ib, same)
                hit = n > 0
                if hit.any():
                    yield pd.DataFrame({"id": ids[hit], "links": n[hit], "root": root[hit]})

    return run


def _roots(near: np.ndarray, ia: np.ndarray, ib: np.ndarray, same: bool) -> np.ndarray:
    """Smallest id of each vector's component within a block pair: a search over rows of the link matrix."""
    full = near | near.T if same else None
    ids = ia if same else np.concatenate([ia, ib])
    left = np.ones(len(ids), bool)
    root = ids.copy()
    linked = full.any(axis=1) if same else np.concatenate([near.any(axis=1), near.any(axis=0)])
    for s in np.flatnonzero(linked):
        if not left[s]:
            continue
        group, front = np.zeros(len(ids), bool), np.array([s])
        group[s] = True
        while len(front):
            if same:
                reach = full[front].any(axis=0)
            else:
                a, b = front[front < len(ia)], front[front >= len(ia)] - len(ia)
                reach = np.concatenate([near[:, b].any(axis=1), near[a].any(axis=0)])
            new = reach & ~group
            group |= new
            front = np.flatnonzero(new)
        left[group] = False
        root[group] = ids[group].min()
    return root


def link_embeddings(vectors: DataFrame, cosine: float = 0.93, leading: int = 6, block: int = 512, sample: int = 4096) -> DataFrame:
    """Rows ``(vec_id, n_links, component_id, kept)``, one for each row of ``vectors`` (``vec_id, embedding, label``).

    Two vectors link if their labels are equal and not null, their lengths are equal and
    their cosine in double precision is at least ``cosine``. A vector that is null, zero
    or empty, or holds a null or non-finite component, links with nothing, as does one
    without a label: n_links 0, its own component, kept. Rows that repeat vec_id, label
    and components are one vector; different vectors of one vec_id each have links of
    their own. Equal vectors of a label are compared once and count with the number of
    their vec_ids. A row with a null vec_id links with nothing. Other columns are ignored.
    vec_ids must be longs. A vector that very many rows share is one row until the last
    join, whose hot side is split by adaptive execution.
    """
    eps = math.sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _valid(F.col("vec")))
    merged = good.groupBy("label", "vec").agg(F.min("id").alias("head"), F.count_distinct("id").alias("n"))
    heads = settle(merged.select(F.monotonically_increasing_id().alias("id"), "label", "vec", "n", F.size("vec").alias("size"), "head"))
    blocks = _blocks(heads.drop("head"), _axes(heads, leading, sample), eps, leading, block)
    starts = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("k")).collect()  # one row a partition
    base, total = {}, 0
    for r in sorted(starts, key=lambda r: r["part"]):
        base[r["part"]], total = total, total + r["k"]
    if not total:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    offsets = heads.sparkSession.createDataFrame(list(base.items()), "part int, base long")
    blocks = blocks.join(offsets, "part").withColumn("no", F.col("base") + F.col("nth"))
    pairs = _block_pairs(blocks, eps, leading)

    def side(s: str) -> DataFrame:
        return blocks.select(F.col("no").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "counts", "vecs")])

    # dealt anew by pair, so that the comparisons of one block are spread
    found = pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_compare(cosine), "id long, links long, root long")
    found = settle(found)
    degrees = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = comp.join(heads.select("id", "head"), "id")
    named = linked.join(linked.groupBy("component").agg(F.min("head").alias("c")), "component").select("id", "c")
    per_head = heads.join(degrees, "id", "left").join(named, "id", "left")
    per_head = per_head.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("l"), F.coalesce("c", "head").alias("c"))
    keyed = rows.withColumn("ok", F.col("id").isNotNull() & F.col("label").isNotNull() & _valid(F.col("vec")))
    one = keyed.where("ok").join(per_head, ["label", "vec"]).select(F.col("id").alias("vec_id"), F.col("l").alias("n_links"), F.col("c").alias("component_id"))
    rest = keyed.where("NOT ok OR ok IS NULL").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return one.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, * FROM (
    SELECT DISTINCT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
), l AS (
  SELECT a.r AS a, b.r AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), found AS (
  SELECT v.vec_id, v.label, v.e, (SELECT count(*) FROM l WHERE l.a = v.r) AS n, (SELECT min(w.vec_id) FROM reach JOIN v AS w ON w.r = reach.b WHERE reach.a = v.r) AS c FROM v
)
SELECT t.vec_id, coalesce(f.n, 0) AS n_links, coalesce(f.c, t.vec_id) AS component_id, coalesce(t.vec_id = coalesce(f.c, t.vec_id), true) AS kept
FROM embeddings AS t LEFT JOIN found AS f ON t.vec_id = f.vec_id AND t.label = f.label AND list_transform(t.embedding, lambda x: x::DOUBLE) = f.e
"""
