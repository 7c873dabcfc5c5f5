"""Hard negatives by one-dimensional distance keys.

Vectors are quantised to integers and augmented by one component that gives all of them
the length of the longest; an anchor gets 0 there, so a larger inner product is a smaller
distance. Every vector belongs to its nearest pivot, and the index holds the vectors sorted
by (pivot, distance) in blocks. A search looks at growing annuli: a vector within r of the
anchor has a key within r of the anchor's own distance to that pivot, so each round scans
the blocks of the next key intervals only, and a search ends when its k-th best distance is
within the radius that has been covered, or when the radius reaches the lowest score asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import drop_settled, settle

_TOP = 1 << 31  # of a component
_BLOCK = "block long, size int, pivot int, lo double, hi double, uids binary, ids binary, named binary, labels array<string>, vecs binary"


def _prepared(vectors: DataFrame, anchor: Column, scale: float) -> DataFrame:
    """The rows that take part: uid, id, label, vec (whole numbers as doubles), norm, size, anchor."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    held = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < _TOP - 1))
    rows = rows.where(F.col("label").isNotNull() & F.col("e").isNotNull() & held)
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "id", "label", "anchor", F.transform("e", lambda x: F.floor(x * scale).cast("double")).alias("vec"))
    rows = rows.withColumn("norm", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).withColumn("size", F.size("vec"))
    return settle(rows.where(F.col("norm") < float(1 << 62)))


def _pivots(sample: pd.DataFrame, most: float, count: int, steps: int = 6) -> dict[int, np.ndarray]:
    """Pivots of each vector length: centres of the augmented sample, started from points far from one another."""
    out: dict[int, np.ndarray] = {}
    for size, part in sample.groupby("size"):
        x = _augmented(np.stack(part["vec"].to_numpy()).reshape(len(part), int(size)), most)
        centres = [x[0]]
        away = np.linalg.norm(x - x[0], axis=1)
        while len(centres) < min(count, max(1, len(x) // 16)) and away.max() > 0:
            centres.append(x[away.argmax()])
            away = np.minimum(away, np.linalg.norm(x - centres[-1], axis=1))
        p = np.stack(centres)
        for _ in range(steps):
            near = _distances(x, p).argmin(axis=1)
            p = np.stack([x[near == i].mean(axis=0) if (near == i).any() else p[i] for i in range(len(p))])
        out[int(size)] = p
    return out


def _augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1) if len(x) else np.zeros((0, len(pivots)))


def _index(rows: DataFrame, pivots: dict[int, np.ndarray], most: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The blocks of the sorted index, and the anchors with their distances to every pivot."""
    small = most < float(1 << 30)

    def of(size: int) -> np.ndarray:
        return pivots.get(size, np.zeros((1, size + 1)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pivot, dist = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for size, at in pdf.groupby("size").indices.items():
                d = _distances(_augmented(np.stack(pdf["vec"].to_numpy()[at]).reshape(len(at), int(size)), most), of(int(size)))
                pivot[at] = d.argmin(axis=1)
                dist[at] = d.min(axis=1)
            yield pdf.assign(pivot=pivot, dist=dist)

    placed = rows.select("uid", "id", "label", "vec", "size").mapInPandas(place, "uid long, id long, label string, vec array<double>, size int, pivot int, dist double")
    order = ["size", "pivot", "dist", "uid"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None
        nth = 0

        def full(pdf: pd.DataFrame) -> dict:
            nonlocal nth
            nth += 1
            lo, hi = pdf["dist"].min(), pdf["dist"].max()
            named = pdf["id"].notna()
            pdf = pdf.assign(named=named, id=pdf["id"].fillna(0).astype(np.int64)).sort_values(["named", "id", "uid"], ascending=[False, True, True])
            vecs = np.stack(pdf["vec"].to_numpy()).astype(np.int16 if small else np.int32)
            return {"block": (pdf["part"].iloc[0] << 32) + nth, "size": pdf["size"].iloc[0], "pivot": pdf["pivot"].iloc[0], "lo": lo, "hi": hi, "uids": pdf["uid"].to_numpy(np.int64).tobytes(), "ids": pdf["id"].to_numpy(np.int64).tobytes(), "named": pdf["named"].to_numpy(bool).tobytes(), "labels": pdf["label"].tolist(), "vecs": vecs.tobytes()}

        for pdf in batches:
            left = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            runs = [g for _, g in left.groupby(["size", "pivot"], sort=False)]
            left, out = None, []
            for i, g in enumerate(runs):
                end = len(g) if i < len(runs) - 1 else len(g) // block * block
                out += [full(g.iloc[a : min(a + block, end)]) for a in range(0, end, block)]
                if end < len(g):
                    left = g.iloc[end:].reset_index(drop=True)
            if out:
                yield pd.DataFrame(out)
        if left is not None and len(left):
            yield pd.DataFrame([full(left)])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = [None] * len(pdf)
            for size, at in pdf.groupby("size").indices.items():
                x = np.stack(pdf["vec"].to_numpy()[at]).reshape(len(at), int(size))
                for i, d in zip(at, _distances(np.column_stack([x, np.zeros(len(x))]), of(int(size))), strict=True):
                    out[i] = d.tolist()
            yield pdf.assign(dists=out)

    anchors = rows.where("anchor").drop("anchor")
    anchors = anchors.mapInPandas(measure, "uid long, id long, label string, vec array<double>, norm double, size int, dists array<double>")
    return settle(dealt.mapInPandas(pack, _BLOCK)), settle(anchors)


def _scan(k: int, same: bool, small: bool, exact: bool, most: int = 256):
    """The best k of each block for the queries that follow it."""

    def best(b, queries: list) -> pd.DataFrame:
        uids, ids, named = np.frombuffer(b.uids, np.int64), np.frombuffer(b.ids, np.int64), np.frombuffer(b.named, bool)
        kind = np.float64 if exact else np.int64
        x = np.frombuffer(b.vecs, np.int16 if small else np.int32).reshape(len(uids), -1).astype(kind)
        q = np.array([r.vec for r in queries]).reshape(len(queries), -1).astype(kind)
        score = (q @ x.T).astype(np.int64)
        labels, own = np.array(b.labels, object), np.array([r.label for r in queries], object)
        fits = (labels[None, :] == own[:, None]) == same
        fits &= (uids[None, :] != np.array([r.uid for r in queries])[:, None]) & (score >= np.array([r.least for r in queries])[:, None]) & (score <= np.array([r.top for r in queries])[:, None])
        score[~fits] = np.iinfo(np.int64).min
        row, out = np.arange(len(queries)), []
        number = np.array([r.q for r in queries])
        for _ in range(min(k, len(uids))):
            at = score.argmax(axis=1)  # the first of equals: a block is sorted by id
            hit = fits[row, at]
            if not hit.any():
                break
            out.append(pd.DataFrame({"q": number[hit], "uid": uids[at[hit]], "id": pd.array(ids[at[hit]], "Int64").copy(), "score": score[row, at][hit], "named": named[at[hit]]}))
            score[row, at], fits[row, at] = np.iinfo(np.int64).min, False
        return pd.concat(out) if out else pd.DataFrame({"q": [], "uid": [], "id": [], "score": [], "named": []})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, waiting = None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if waiting and (r.kind == 0 or len(waiting) == most):
                    yield best(now, waiting)
                    waiting = []
                if r.kind == 0:
                    now = r
                else:
                    waiting.append(r)
        if waiting:
            yield best(now, waiting)

    return run


def _search(queries: DataFrame, blocks: DataFrame, k: int, same: bool, most: float, salted: int = 200_000) -> DataFrame:
    """Rows ``(q, uid, id, score, rank)``: the first k of each query.

    ``queries``: q, uid, label, vec, norm, size, dists, least and top (the scores asked for),
    radii (one a round; nothing that is asked for lies beyond the last one).
    """
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "uid")
    slack = 1e-6 * (1 + most**0.5)
    small, exact = most < float(1 << 30), most < float(1 << 52)
    directory = blocks.select("block", "size", "pivot", "lo", "hi")
    rounds = queries.select(F.max(F.size("radii"))).first()[0] or 0
    active, best, old = queries, None, []
    for t in range(rounds):
        count = active.count()
        if not count:
            break
        salts = 1 + count // salted
        now, before = F.col("radii")[t] + slack, F.col("radii")[t - 1] + slack if t else None
        at = active.select("q", "size", now.alias("now"), (before if t else F.lit(-1.0)).alias("before"), F.posexplode("dists").alias("pivot", "d"))

        def covered(r: str) -> Column:
            return (F.col("lo") <= F.col("d") + F.col(r)) & (F.col("hi") >= F.col("d") - F.col(r))

        pairs = at.join(directory, ["size", "pivot"]).where(covered("now"))
        if t:
            pairs = pairs.where(~covered("before"))
        asked = pairs.select("block", "q").join(active.select("q", "uid", "label", "vec", "least", "top"), "q")
        nulls = {n: F.lit(None).cast(c) for n, c in (("uids", "binary"), ("ids", "binary"), ("named", "binary"), ("labels", "array<string>"), ("vecs", "binary"))}
        asked = asked.select("block", F.pmod("q", F.lit(salts)).alias("salt"), F.lit(1).alias("kind"), "q", "uid", "label", "vec", "least", "top", *(c.alias(n) for n, c in nulls.items()))
        none = [F.lit(None).cast(c).alias(n) for n, c in (("q", "long"), ("uid", "long"), ("label", "string"), ("vec", "array<double>"), ("least", "long"), ("top", "long"))]
        shipped = blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"), *none, *nulls)
        dealt = shipped.unionByName(asked).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind")
        found = dealt.mapInPandas(_scan(k, same, small, exact), "q long, uid long, id long, score long, named boolean")
        found = found.select("q", "uid", F.when(F.col("named"), F.col("id")).alias("id"), "score")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = settle(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        kth = best.where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
        rest = active.join(kth, "q", "left")
        # certified: what has not been seen is farther away than the k-th best
        sure = F.col("kth").isNotNull() & (F.lit(most) + F.col("norm") - 2 * F.col("kth") <= F.col("radii")[t] * F.col("radii")[t])
        rest = rest.where(~sure).withColumn("least", F.greatest("least", F.coalesce("kth", "least"))).drop("kth")
        old.append((active, best))
        active = settle(rest) if t < rounds - 1 else rest
    for a, b in old[:-1]:
        drop_settled(queries.sparkSession, a if a is not queries else None, b)
    return best if best is not None else queries.select("q", "uid", F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)


def _start(sample: pd.DataFrame, most: float, k: int, probes: int = 256) -> float:
    """A radius within which most anchors should find k of their own label, judged by the sample against itself; it decides the number of rounds only."""
    found = []
    for _, part in sample.groupby(["size", "label"]):
        x = np.stack(part["vec"].to_numpy()).reshape(len(part), -1)
        if len(x) > k:
            score = np.sort(x[:probes] @ x.T, axis=1)[:, -k - 1]
            found += np.sqrt(np.maximum(most + (x[:probes] ** 2).sum(axis=1) - 2 * score, 0)).tolist()
    return float(np.median(found)) if found else 2 * most**0.5


def mine_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, pivots: int = 32, block: int = 512, sample: int = 4096) -> DataFrame:
    """Rows ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` over ``vectors`` (``vec_id, embedding, label``).

    A score is the inner product of vectors of floor(scale * x). An anchor's positives are
    the first other rows of its label, by score, then vec_id; a positive's negatives the
    first rows of other labels with low * positive <= 100 * negative <= high * positive.
    Rows with a null label or vector, or a null or non-finite component, take no part, nor
    do rows that a long can't score: a component of 2^31 or a squared length of 2^62 and
    more after scaling. Vectors meet those of their own length only; empty ones score 0.
    Repeated rows are rows of their own, as anchors too; a null vec_id comes last among equals.
    An anchor without positives, or a positive of negative score, gives no rows; an empty
    table none. Other columns are ignored.

    Pivots come from a sample of at most ``sample`` vectors; every vector is indexed, and
    results don't depend on the sample. A round ships each query to the blocks of its next
    key intervals, and blocks once for every 200,000 queries; equal keys are split by row.
    """
    rows = _prepared(vectors, anchor, scale)
    most = rows.agg(F.max("norm")).first()[0] or 0.0
    taken = rows.select("size", "label", "vec", F.xxhash64("vec").alias("h"), "uid").orderBy("h", "uid").limit(sample).toPandas()
    blocks, anchors = _index(rows, _pivots(taken, most, pivots), most, block)
    whole = F.lit(float("inf"))
    start = _start(taken, most, positives)
    asked = anchors.withColumn("q", F.col("uid")).withColumn("least", F.lit(-(1 << 62))).withColumn("top", F.lit(1 << 62)).withColumn("radii", F.array(F.lit(start), F.lit(1.15 * start), whole))
    near = _search(asked, blocks, positives, True, most)
    near = near.select(F.col("q").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0")
    exact = F.col("positive_score").cast("decimal(20,0)")  # times a percentage it may outgrow a long
    ceiling, floor = (F.call_function("div", x, F.lit(100)).cast("long") for x in (exact * high, exact * low + 99))
    pairs = anchors.join(near, anchors["uid"] == near["anchor"]).drop("anchor").withColumn("top", ceiling).withColumn("least", floor)

    def away(score: str) -> Column:
        return F.sqrt(F.greatest(F.lit(most) + F.col("norm") - 2.0 * F.col(score), F.lit(0.0)))

    radii = F.array(F.least(1.02 * away("top"), away("least")), F.least(1.15 * away("top"), away("least")), away("least"))
    pairs = settle(pairs.withColumn("q", F.monotonically_increasing_id()).withColumn("radii", radii))
    far = _search(pairs, blocks, negatives, False, most)
    out = pairs.select("q", F.col("id").alias("anchor_id"), "positive_id", "positive_score").join(far.select("q", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "q")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i]::BIGINT * b.e[i]::BIGINT))::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), pos AS (
  SELECT a, b, anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) <= 5
), neg AS (
  SELECT pos.anchor_id, pos.id AS positive_id, row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY s.score DESC, s.id NULLS LAST, s.b) AS rank, s.id AS negative_id, pos.score AS positive_score, s.score AS negative_score
  FROM pos JOIN s ON pos.a = s.a AND NOT s.same WHERE 50 * pos.score <= 100 * s.score AND 100 * s.score <= 95 * pos.score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""
