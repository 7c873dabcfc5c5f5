"""Near-duplicate classes by DartMinHash.

A document is a weighted set: its distinct shingles of five words, each weighing its
number of occurrences. Every shingle has a plane of weight by rank on which darts fall at
unit rate, the same for every document; a dart is the document's own if it lies below the
shingle's weight there. Each dart belongs to one coordinate, and the one of least rank of
each makes the signature, so that two signatures agree at a coordinate with the documents'
weighted Jaccard similarity. The plane is cut into cells, weight strips [0, 1), [1, 2),
[2, 4), [4, 8) ... by rank strips that are the narrower the wider the weight strip, so that
a cell holds few darts; cells are thrown only below the weight and only up to the rank that
fills a document's coordinates. Cost grows with the distinct shingles, not with their
weights. Bands of signatures propose pairs; exact similarity decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import components, cut, drop_settled, settle

BANDS, ROWS = 40, 6
COORDS = BANDS * ROWS
_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Rank strips of a weight strip one wide: dyadic to 4, then 4 wide. Of a strip w wide all is divided by w.
_EDGES = [0.0, 0.125, 0.25, 0.5, 1.0, 2.0, 4.0]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
        return x ^ (x >> np.uint64(31))


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(x + np.uint64(salt & 0xFFFFFFFFFFFFFFFF) * _C3)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word: lower-cased runs of anything but ASCII white space."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    code = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = ~_SPACE[code]
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    end = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = end - start
    at = np.flatnonzero(inside)
    place = (at - np.repeat(start, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        parts = _mix((code[at].astype(np.uint64) | (place << np.uint64(8))) * _C3)
        h = _mix(np.add.reduceat(parts, np.cumsum(size) - size) + size.astype(np.uint64))
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return np.searchsorted(bounds, start, side="right"), h


def elements(doc: np.ndarray, h: np.ndarray, n_docs: int, shingle: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, occurrences) of every distinct shingle of each text, by text and hash."""
    if len(h) < shingle:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - shingle + 1
    same = doc[:m] == doc[shingle - 1 :]
    with np.errstate(over="ignore"):
        s = np.zeros(m, np.uint64)
        for j in range(shingle):
            s = _mix(s * _C1 + h[j : m + j])
    s, d = s[same], doc[:m][same]
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    return d[first], s[first], np.diff(np.append(first, len(s)))


def _edge(j: int) -> float:
    return _EDGES[j] if j < len(_EDGES) else 4.0 * (j - len(_EDGES) + 2)


def _cdf(width: float) -> np.ndarray:
    p, out, total, k = math.exp(-width), [], 0.0, 0
    while total < 1 - 1e-15 and k < 64:
        total += p
        out.append(total)
        k += 1
        p *= width / k
    return np.array(out)


def _cells(doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, seed, width of the weight strip, part of it under the weight) of every weight strip that an element reaches into."""
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    floor = np.where(level > 0, width, 0.0)
    with np.errstate(over="ignore"):
        seed = _mix(element[at] + level.astype(np.uint64) * _C2)
    return doc[at], seed, width, np.minimum(weight[at] - floor, width)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, coords: int = COORDS) -> np.ndarray:
    """n_docs x coords dart identities (uint64); rows of texts without elements are 0."""
    best = np.full(n_docs * coords, np.inf)
    sig = np.zeros(n_docs * coords, np.uint64)
    total = np.bincount(doc, weight, minlength=n_docs)
    left = total > 0
    reach = np.where(left, coords * (math.log(coords) + 3) / np.maximum(total, 1), 0.0)
    cells = _cells(doc, element, weight)
    while left.any():
        live = left[cells[0]]
        d, seed, width, under = (x[live] for x in cells)
        limit = reach[d] * width
        j = 0
        while len(d):
            lo, hi = _edge(j), _edge(j + 1)
            on = lo < limit
            d, seed, width, under, limit = d[on], seed[on], width[on], under[on], limit[on]
            cell = _salted(seed, 2 * j + 1)
            u = (cell >> np.uint64(11)).astype(np.float64) * 2.0**-53
            n = np.searchsorted(_cdf(hi - lo), u, side="right")
            some = n > 0
            n, at = n[some], np.flatnonzero(some)
            at = np.repeat(at, n)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            with np.errstate(over="ignore"):
                dart = _mix(cell[at] + (nth.astype(np.uint64) + np.uint64(1)) * _C3)
                part = np.flatnonzero(under[at] < width[at])
                if len(part):  # strips that the weight ends in: darts above it are not the document's
                    high = (_mix(dart[part] + _C1) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                    below = np.ones(len(at), bool)
                    below[part] = high * width[at[part]] < under[at[part]]
                    at, dart = at[below], dart[below]
                rank = (lo + (hi - lo) * (dart >> np.uint64(11)).astype(np.float64) * 2.0**-53) / width[at]
                key = d[at] * coords + (_mix(dart + _C2) % np.uint64(coords)).astype(np.int64)
            np.minimum.at(best, key, rank)
            won = best[key] == rank
            sig[key[won]] = dart[won] | np.uint64(1)
            j += 1
        # a text is done when every coordinate has a dart within the rank that all its cells were thrown up to
        left &= ~(best.reshape(n_docs, coords).max(axis=1) <= reach)
        reach = np.where(left, 2 * reach, reach)
    return sig.reshape(n_docs, coords)


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros((len(sig), BANDS), np.uint64)
        for r in range(ROWS):
            out = _mix(out * _C1 + sig.reshape(len(sig), BANDS, ROWS)[:, :, r])
        return _mix(out + np.arange(BANDS, dtype=np.uint64) * _C3).view(np.int64)


def _slices(texts: list[str | None], chars: int = 600_000) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi] or "") <= chars):
            n += len(texts[hi] or "")
            hi += 1
        yield lo, hi
        lo = hi


def _text_hashes(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """t1, t2 (two hashes of the word sequence) and the number of words of each text."""
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        place = (np.arange(len(h)) - first[doc]).astype(np.uint64)
        t1, t2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        np.add.at(t1, doc, _mix(h + place * _C3))
        np.add.at(t2, doc, _mix((h ^ _C2) * _C1 + place))
        return _mix(t1 + count.astype(np.uint64)).view(np.int64), _mix(t2 ^ count.astype(np.uint64)).view(np.int64), count


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, k, t1, t2 (hashes of the word sequence; t1 null without a word), bands (null under five words)."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in _slices(texts):
            part = [t or "" for t in texts[lo:hi]]
            doc, h = word_hashes(part)
            n = len(part)
            t1, t2, count = _text_hashes(doc, h, n)
            d, e, w = elements(doc, h, n)
            keys = band_keys(signatures(d, e, w, n))
            has = np.bincount(d, minlength=n) > 0
            bands = pa.array([k if ok else None for k, ok in zip(keys, has, strict=True)], pa.list_(pa.int64()))
            own = [batch.column(c).slice(lo, hi - lo) for c in ("id", "k")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(t1, mask=count == 0), pa.array(t2), bands], ["id", "k", "t1", "t2", "bands"])


def _piece_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = list(pdf["text"])
        for lo, hi in _slices(texts):
            part = [t or "" for t in texts[lo:hi]]
            doc, h = word_hashes(part)
            t1, t2, _ = _text_hashes(doc, h, len(part))
            d, e, w = elements(doc, h, len(part))
            bounds = np.searchsorted(d, np.arange(len(part) + 1))
            yield pd.DataFrame({"t1": t1, "t2": t2, "set": [_packed(e[a:b], w[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]})


def _packed(element: np.ndarray, weight: np.ndarray) -> bytes:
    """Elements sorted, those that weigh more than 1 first, then their weights; the first word is their number."""
    heavy = weight > 1
    words = np.concatenate([[np.uint64(heavy.sum())], element[heavy], element[~heavy], weight[heavy].astype(np.uint64)])
    return words.astype(np.uint64).tobytes()


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(elements, weights); the elements are distinct."""
    words = np.frombuffer(body, np.uint64)
    heavy = int(words[0])
    element = words[1 : len(words) - heavy]
    weight = np.ones(len(element), np.int64)
    weight[:heavy] = words[len(words) - heavy :]
    return element, weight


def similar(p: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray], similarity: float) -> bool:
    """Whether the weighted Jaccard similarity of two sets is at least ``similarity``."""
    a, b = int(p[1].sum()), int(q[1].sum())
    if min(a, b) < similarity * max(a, b):
        return False
    both = np.concatenate([p[0], q[0]])
    order = np.argsort(both, kind="stable")
    both, weight = both[order], np.concatenate([p[1], q[1]])[order]
    twice = np.flatnonzero(both[1:] == both[:-1])
    common = int(np.minimum(weight[twice], weight[twice + 1]).sum())
    return common >= similarity * (a + b - common)


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs ``a, b``, those whose weighted Jaccard similarity is at least ``similarity``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = [similar(_unpacked(x), _unpacked(y), similarity) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)]
            yield pdf.loc[good, ["a", "b"]]

    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return full.mapInPandas(run, "a long, b long")


def _crowd_links(rows: DataFrame, similarity: float, chunk: int = 512) -> DataFrame:
    """Links within crowded buckets, found in blocks of two chunks; rows ``key, n, id, comp, set``.

    A block inverts its documents' pieces once and takes exact similarities from that.
    Only links between components come out, and of those a spanning forest, so that a
    block yields fewer rows than it has documents.
    """

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        ids, comp = pdf["id"].to_numpy(), pdf["comp"].to_numpy()
        root = {int(c): int(c) for c in comp}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out: list[tuple[int, int]] = []
        if len(root) > 1:
            sets = [_unpacked(x) for x in pdf["set"]]
            size = np.array([w.sum() for _, w in sets])
            count = np.array([len(e) for e, _ in sets])
            owner = np.repeat(np.arange(len(sets)), count)
            weight = np.concatenate([w for _, w in sets])
            _, piece = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True)
            order = np.argsort(piece, kind="stable")
            holders, weighs, bounds = owner[order], weight[order], np.concatenate([[0], np.cumsum(np.bincount(piece))])
            ends = np.cumsum(count)
            names, counts = np.unique(comp, return_counts=True)
            largest = names[counts.argmax()]
            for i in np.flatnonzero(comp != largest):
                mine = slice(ends[i] - count[i], ends[i])
                lens = bounds[piece[mine] + 1] - bounds[piece[mine]]
                at = np.repeat(bounds[piece[mine]], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
                common = np.bincount(holders[at], np.minimum(weighs[at], np.repeat(weight[mine], lens)), minlength=len(sets))
                for j in np.flatnonzero((common >= similarity * (size + size[i] - common)) & (comp != comp[i])):
                    x, y = find(int(comp[i])), find(int(comp[j]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((ids[i], ids[j]))
        return pd.DataFrame({"a": [x for x, _ in out], "b": [y for _, y in out]}, dtype="int64")

    chunks = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("c")).cast("int")
    dealt = rows.withColumn("c", chunks).withColumn("m", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    dealt = dealt.select("key", F.least("m", "o").alias("p"), F.greatest("m", "o").alias("q"), "id", "comp", "set")
    return dealt.groupBy("key", "p", "q").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, crowd: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, class_id, kept)``, one for each row of ``docs``: classes of documents linked at ``similarity`` or more.

    Words are lower-cased runs of anything but ASCII white space. Documents of the same
    words are one class; otherwise two documents link if their shingles of five words,
    weighted by occurrences, have a weighted Jaccard similarity of at least
    ``similarity``. ``class_id`` is the smallest id of a class, and ``kept`` marks the
    rows that bear it. A null, empty or blank text is a class of its own; texts under
    five words link by equality alone. What is linked are texts: rows of a repeated id
    are each of the class of their own text. Ids must be longs. A row with a null id has
    no class_id and is kept; its text links others all the same. Other columns are ignored.

    Copies are collapsed before any signature meets another: a node stands for all rows
    of one word sequence, whatever their ids. Links are verified first
    along stars: every document against the hub of its buckets, the one whose buckets
    hold the most documents, as an original's do among its edited copies. Only buckets
    that then still hold more than one component are searched further: small ones pair
    by pair, crowded ones in blocks that hand on a spanning forest of the links found.
    Pairs within a component are never formed.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("k"))
    marks = settle(rows.mapInArrow(_digest_rows, "id long, k long, t1 long, t2 long, bands array<long>"))
    worded = marks.where("t1 IS NOT NULL")
    # one row of each node, found again by (r, k); its words decide whether it is the node's
    lead = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "k"))
    nodes = worded.groupBy("t1", "t2").agg(lead.alias("lead"), F.first("bands").alias("bands"))
    nodes = nodes.select("t1", "t2", F.col("lead.id").alias("head"), F.col("lead.k").alias("k"), F.coalesce("lead.id", "lead.k").alias("r"), "bands")
    nodes = settle(nodes.withColumn("id", F.monotonically_increasing_id()))
    spread = nodes.where("bands IS NOT NULL").select("id", F.explode("bands").alias("key"))
    sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settle(spread.join(sizes, "key"))
    # the hub of a bucket: whose buckets hold the most documents, as an original's do among its edited copies
    fame = shared.groupBy("id").agg(F.sum("n").alias("fame"))
    famed = shared.select("key", "id").join(fame, "id")
    hubs = famed.groupBy("key").agg(F.max(F.struct("fame", (-F.col("id")).alias("neg"))).alias("hub"))
    mine = shared.select("key", "id").join(hubs, "key").groupBy("id").agg((-F.max("hub")["neg"]).alias("hub")).where("id <> hub")
    stars = mine.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    wanted = nodes.join(fame.select("id"), "id").select("r", "k", "t1", "t2", "id")
    found = rows.withColumn("r", F.coalesce("id", "k")).join(wanted.select("r", "k"), ["r", "k"], "left_semi").select("text")
    found = found.mapInPandas(_piece_rows, "t1 long, t2 long, set binary").dropDuplicates(["t1", "t2"])
    sets = settle(found.join(wanted.select("t1", "t2", "id"), ["t1", "t2"]).select("id", "set"))
    links = cut(_verify(stars, sets, similarity))
    comp = components(links)
    here = shared.join(comp, "id", "left").select("key", "n", "id", F.coalesce("component", "id").alias("comp"))
    open_keys = here.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    here = settle(here.join(open_keys, "key", "left_semi"))
    crowded = _crowd_links(here.where(F.col("n") > crowd).join(sets, "id"), similarity)
    few = here.where(F.col("n") <= crowd)
    other = few.select("key", F.col("id").alias("b"), F.col("comp").alias("comp2"))
    pairs = few.join(other, "key").where("id < b AND comp <> comp2").select(F.col("id").alias("a"), "b").distinct()
    links = cut(links.unionByName(_verify(pairs, sets, similarity)).unionByName(crowded))
    drop_settled(spark, here)
    comp = components(links)
    drop_settled(spark, shared, sets)
    classes = nodes.select("t1", "t2", "head", "id").join(comp, "id", "left").select("t1", "t2", "head", F.coalesce("component", "id").alias("c"))
    least = classes.groupBy("c").agg(F.min("head").alias("class_id"))
    heads = classes.join(least, "c").select("t1", "t2", "class_id")
    out = marks.select("id", "t1", "t2").join(heads, ["t1", "t2"], "left")
    out = out.select("id", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"))
    return out.withColumn("kept", F.col("id").isNull() | (F.col("id") == F.col("class_id"))).withColumnRenamed("id", id_col)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), node AS (
  SELECT min(doc_id) AS r, w FROM d WHERE len(w) > 0 GROUP BY w
), seen AS (
  SELECT r, k, count(*) AS n FROM (SELECT r, unnest(list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) AS k FROM node WHERE len(w) >= 5) GROUP BY 1, 2
), size AS (
  SELECT r, sum(n) AS n FROM seen GROUP BY 1
), pair AS (
  SELECT a.r AS a, b.r AS b, sum(least(a.n, b.n)) AS common FROM seen AS a JOIN seen AS b ON a.k = b.k AND a.r < b.r GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN size AS x ON x.r = a JOIN size AS y ON y.r = b WHERE 5 * common >= 4 * (x.n + y.n - common)
), way AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT r AS a, r AS b FROM node UNION SELECT reach.a, way.b FROM reach JOIN way ON reach.b = way.a
), class AS (
  SELECT a, min(b) AS c FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(c, doc_id) AS class_id, coalesce(c, doc_id) = doc_id AS kept FROM d LEFT JOIN node ON d.w = node.w LEFT JOIN class ON a = r
"""
