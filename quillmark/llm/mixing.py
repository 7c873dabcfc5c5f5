"""Mixing sources to target weights by entropy balancing.

Documents start at a rate of one copy each. The rates looked for are closest to that in
entropy, at most ``cap``, and meet one token constraint for each source: sum of (rate x
words) = target. The dual is one convex problem a source, in a multiplier lambda, and its
solution tilts every document exponentially: rate = min(cap, exp(lambda x words)).
Distributed Newton steps on sums over (source, size) cells find the multipliers. The rates
are then rounded into whole copies, so that a source's words stay within about one small
document of its constraint.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import ASCII_SPACE, cut, settle, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
_BUCKET_BITS = 10
_BROADCAST_CELLS = 250_000  # some 60 MB as they are hashed for the join


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{ASCII_SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size`` -> also ``target``, in doubles.

    Weights repeat over the sources by code point, null last. A target stops at ``cap``
    times its source's size; what is above is reshared by weight until none is. That
    fixed point is min(cap x size, weight x level), the level found from running sums
    over the sources in the order in which they reach their cap. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(WEIGHTS)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (rank + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    s = s.withColumn("at", F.col("most") / F.col("w"))
    full = Window.orderBy("at", F.col("source").asc_nulls_last())
    before, after, everything = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.coalesce(F.least("most", F.col("w") * F.col("level")), F.col("most")).alias("target"))


def balance(cells: DataFrame, goals: DataFrame, cap: float = CAP, tolerance: float = 1e-9, max_steps: int = 60) -> DataFrame:
    """``goals`` with ``lam``; ``cells`` are ``k, size, n`` (documents of a source and size), ``goals`` ``k, target, source_size, ...``.

    Newton on log(sum(n size min(cap, exp(lam size)))) = log(target), all sources at once.
    Each step re-sums the tilted cells; a step that leaves the bracket known so far, or
    that no uncapped document would answer, is replaced by the bracket's middle. A target
    of ``cap`` times the source needs no finite multiplier: lam is infinite, all rates are
    ``cap``. A source without words keeps lam = 0.
    """
    limit = math.log(cap)
    mean = cells.groupBy("k").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("mean"))
    full, none = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), (F.col("source_size") == 0) | (F.col("target") <= 0)
    start = F.when(none, 0.0).when(full, math.inf).otherwise(F.log(F.col("target") / F.col("source_size")) / F.col("mean"))
    state = goals.join(mean, "k").withColumn("lam", start).withColumn("done", full | none)
    state = cut(state.withColumn("lo", F.lit(-math.inf)).withColumn("hi", F.lit(math.inf)).drop("mean"))
    for _ in range(max_steps):
        if state.where("NOT done").isEmpty():
            return state.drop("lo", "hi", "done")
        z = F.col("lam") * F.col("size")
        tokens = F.col("n") * F.col("size") * F.exp(F.least(z, F.lit(limit)))
        tilted = cells.where("size > 0").join(state.where("NOT done").select("k", "lam"), "k")
        tilted = tilted.groupBy("k").agg(F.sum(tokens).alias("mass"), F.sum(F.when(z < limit, tokens * F.col("size")).otherwise(0.0)).alias("slope"))
        low, high = F.when(F.col("mass") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("mass") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.log(F.col("mass") / F.col("target")) * F.col("mass") / F.col("slope")
        # a bracket that is open on one side is doubled
        middle = F.when(F.col("hi") == math.inf, F.col("lo") + F.greatest(F.abs("lo"), F.lit(1e-6))).when(F.col("lo") == -math.inf, F.col("hi") - F.greatest(F.abs("hi"), F.lit(1e-6))).otherwise((F.col("lo") + F.col("hi")) / 2)
        near = F.abs(F.col("mass") / F.col("target") - 1) <= tolerance
        state = state.join(tilted, "k", "left").withColumn("done", F.col("done") | F.coalesce(near, F.lit(False)))
        state = state.withColumn("lo", F.when(F.col("done"), F.col("lo")).otherwise(low)).withColumn("hi", F.when(F.col("done"), F.col("hi")).otherwise(high))
        inside = F.coalesce((F.col("slope") > 0) & F.col("newton").between(F.col("lo"), F.col("hi")), F.lit(False))
        state = state.withColumn("newton", newton).withColumn("lam", F.when(F.col("done"), F.col("lam")).when(inside, F.col("newton")).otherwise(middle))
        state = cut(state.drop("mass", "slope", "newton"))
    return state.drop("lo", "hi", "done")  # as near as doubles of this size get


def _round_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's cells, largest documents first: whole extra copies, the rounding error carried to smaller ones."""
    pdf = pdf.sort_values("size", ascending=False, kind="stable")
    extras, carried = [], 0.0
    for size, n, part in zip(pdf["size"], pdf["n"], pdf["part"], strict=True):
        want = carried + n * part * size
        take = min(n, max(0, round(want / size))) if size else 0
        carried = want - take * size
        extras.append(take)
    return pd.DataFrame({"k": pdf["k"], "size": pdf["size"], "extra": extras})


def _plan(rows: DataFrame, share: float, cap: float) -> DataFrame:
    """From ``k, source, size, h`` of every document: a row a cell of ``k, size`` with ``source_size, target, rate, whole`` and which hashes get one copy more.

    These are the hashes under ``below``, and of the documents whose hash is ``below`` the
    share ``tied``. A cell's quota is found in counts over buckets of hashes; only the
    bucket that it ends in is looked into, its equal hashes counted first.
    """
    bucket = F.shiftright("h", 64 - _BUCKET_BITS)
    buckets = cut(rows.groupBy("k", "source", "size", bucket.alias("b")).agg(F.count(F.lit(1)).alias("m")))
    cells = buckets.groupBy("k", "source", "size").agg(F.sum("m").alias("n"))
    sizes = cells.groupBy("k", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = targets(sizes.drop("k"), share, cap).withColumn("k", _source_key()).drop("source")
    cells = cut(cells.drop("source"))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.exp(F.least(F.col("lam") * F.col("size"), F.lit(math.log(cap)))))
    whole = F.least(F.floor(F.col("rate") + 1e-9), F.lit(int(cap)))
    split = cells.join(balance(cells, goals, cap), "k").withColumn("rate", rate).withColumn("whole", whole.cast("long"))
    split = cut(split.withColumn("part", F.when(F.col("whole") >= int(cap), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))).drop("lam"))
    extra = split.select("k", "size", "n", "part").groupBy("k").applyInPandas(_round_cells, "k string, size long, extra long")
    split = cut(split.drop("part").join(extra, ["k", "size"]))
    before = F.sum("m").over(Window.partitionBy("k", "size").orderBy("b")) - F.col("m")
    open_cells = split.where("extra > 0 AND extra < n").select("k", "size", "extra")
    ends = buckets.drop("source").join(open_cells, ["k", "size"]).withColumn("need", F.col("extra") - before).where("need > 0 AND need <= m").select("k", "size", "b", "need")
    inner = rows.withColumn("b", bucket).join(ends, ["k", "size", "b"]).groupBy("k", "size", "need", "h").agg(F.count(F.lit(1)).alias("m"))
    inner = inner.withColumn("missing", F.col("need") - F.sum("m").over(Window.partitionBy("k", "size").orderBy("h")) + F.col("m")).where("missing > 0 AND missing <= m")
    inner = inner.select("k", "size", F.col("h").alias("below"), (F.col("missing") / F.col("m")).alias("tied"))
    out = split.join(inner, ["k", "size"], "left").withColumn("all", F.col("extra") >= F.col("n"))
    return cut(out.select("k", "size", F.col("source_size"), "target", "rate", "whole", "all", "below", "tied"))


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), "source"))


def _mixed(docs: DataFrame, names: dict[str, str], share: float, cap: float, seed: int) -> DataFrame:
    """``docs`` with the columns that ``names`` lists, under the names it gives."""
    keep = docs.columns
    k, size, h, row = unused(docs.drop(*names.values()), "__k", "__size", "__h", "__row")
    docs = docs.withColumn(k, _source_key()).withColumn(size, words(F.col("text"))).withColumn(h, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")))
    plan = _plan(settle(docs.select(F.col(k).alias("k"), "source", F.col(size).alias("size"), F.col(h).alias("h"))), share, cap)
    few = plan.count() <= _BROADCAST_CELLS
    plan = plan.select([F.col(c).alias(f"{k}{c}") for c in plan.columns])
    out = docs.withColumn(row, F.monotonically_increasing_id()).join(F.broadcast(plan) if few else plan, (F.col(k) == F.col(f"{k}k")) & (F.col(size) == F.col(f"{k}size")))
    of = lambda c: F.col(f"{k}{c}")
    tie = F.pmod(F.xxhash64(F.lit(seed), F.col(row)), F.lit(1 << 30)) < of("tied") * (1 << 30)
    more = of("all") | F.coalesce((F.col(h) < of("below")) | ((F.col(h) == of("below")) & tie), F.lit(False))
    copies = of("whole") + more.cast("long")
    values = {"size": F.col(size), "source_size": of("source_size"), "target": of("target"), "rate": of("rate"), "copies": copies, "taken": copies * F.col(size)}
    return out.select(*(c for c in keep if c not in names.values()), *(values[c].alias(n) for c, n in names.items()))


def mix_sources(docs: DataFrame, share: float = SHARE, cap: float = CAP, seed: int = 17) -> DataFrame:
    """``docs`` with ``size, source_size, target, rate, copies, taken``.

    Every row is decided by itself, repeated rows and repeated doc_ids included; null
    sources are one source. A null, empty or blank text has size 0 and is taken once.
    ``copies`` is at most ``cap``; ``taken`` = copies x size. Reruns agree: choices follow
    a hash of doc_id and text. Rows equal in both stand for each other; where a quota ends
    among them, about as many as it needs are chosen by their place. Earlier columns of
    the added names are replaced. An empty input gives an empty result.

    Of the documents only (source, size, hash) is written once and counted; the choices
    come back as one row a (source, size) cell, which is broadcast up to a checked number
    of cells and joined beyond it, so that texts are not shuffled.
    """
    return _mixed(docs, {c: c for c in ("size", "source_size", "target", "rate", "copies", "taken")}, share, cap, seed)


def take_copies(docs: DataFrame, out: str, share: float = SHARE, cap: float = CAP, seed: int = 17) -> DataFrame:
    """``docs``, no column touched, with ``out``: the copies that ``mix_sources`` takes of each row."""
    return _mixed(docs, {"copies": out}, share, cap, seed)


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")
