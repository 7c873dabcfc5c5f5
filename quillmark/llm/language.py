"""Language identification by a linear-chain conditional random field.

Words are labelled in sequence: hashed character n-grams, affixes and a learned lexicon
give emission scores, a learned matrix gives transitions, and forward-backward gives each
word's posterior. A document's language is the one with the largest expected share of
its words, so code-switched text is weighed word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
_SEGMENT = 64
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ALPHA: np.ndarray | None = None


def _alpha() -> np.ndarray:
    """Which code points are letters."""
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _ALPHA


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt)) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
        return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """The words of some texts: features as bucket numbers, laid out word after word."""

    doc: np.ndarray  # text number of each word
    grams: np.ndarray  # bucket of each n-gram or affix
    first: np.ndarray  # where each word's grams begin
    ident: np.ndarray  # hash of each whole word


def featurize(texts: list[str]) -> Words:
    """Letters' runs of the lower-cased texts. Each word gets bigrams and trigrams with its
    borders, which hold affixes of one and two letters, and affixes of three letters."""
    joined = "\x00".join(t.replace("\x00", " ") for t in texts).lower()
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc_at = np.cumsum(code == 0)
    letter = _alpha()[code]
    code = np.concatenate([[0], np.where(letter, code, 0), [0, 0]]).astype(np.uint64)
    letter = np.concatenate([[False], letter, [False, False]])
    start = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    end = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]])) + 1
    size = end - start
    word = np.repeat(np.arange(len(start)), size)
    at = np.flatnonzero(letter)
    s = np.uint64(21)
    prev, here, nxt = code[at - 1], code[at], code[at + 1]
    two = _hash((prev << s) | here, 1)
    two_end = _hash((code[end - 1] << s), 1)
    three = _hash((((prev << s) | here) << s) | nxt, 2)
    wide = size >= 3
    head = _hash((((code[start] << s) | code[np.minimum(start + 1, end - 1)]) << s) | code[np.minimum(start + 2, end - 1)], 3)
    tail = _hash((((code[np.maximum(end - 3, start)] << s) | code[np.maximum(end - 2, start)]) << s) | code[end - 1], 4)
    with np.errstate(over="ignore"):
        place = (at - np.repeat(start, size)).astype(np.uint64)
        parts = _hash(here | (place << s), 5)
        ident = np.add.reduceat(parts, np.cumsum(size) - size) if len(start) else parts
    grams = np.empty(int((2 * size + 3).sum()), np.int64)
    first = np.cumsum(2 * size + 3) - (2 * size + 3)
    spot = first[word] + (at - start[word])
    mask = np.uint64(BUCKETS - 1)
    grams[spot] = two & mask
    grams[spot + size[word]] = three & mask
    last = first + 2 * size
    grams[last] = two_end & mask
    grams[last + 1] = np.where(wide, head & mask, two_end & mask)
    grams[last + 2] = np.where(wide, tail & mask, two_end & mask)
    return Words(doc_at[start - 1], grams, first, ident)


@dataclass
class Crf:
    langs: list[str]
    emit: np.ndarray  # buckets x languages
    lexicon: np.ndarray  # sorted word hashes
    lex_row: np.ndarray  # row of each lexicon word in lex_emit; row 0 is for words outside
    lex_emit: np.ndarray
    trans: np.ndarray
    begin: np.ndarray

    def lex(self, ident: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(ident), np.int64)
        at = np.searchsorted(self.lexicon, ident).clip(max=len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == ident, self.lex_row[at], 0)

    def emissions(self, words: Words) -> np.ndarray:
        if not len(words.first):
            return np.zeros((0, len(self.langs)), np.float32)
        return np.add.reduceat(self.emit[words.grams], words.first, axis=0) + self.lex_emit[self.lex(words.ident)]


def posteriors(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over sequences laid end to end.

    Returns the words' posteriors, and the forward and backward messages (normalised).
    Sequences are cut into segments whose transfer matrices are multiplied for all
    segments at once; a scan over segments then gives each its incoming messages, so the
    result is exact at any length.
    """
    n, k = emit.shape
    if not n:
        return np.zeros((0, k)), np.zeros((0, k)), np.zeros((0, k))
    psi = np.exp((emit - emit.max(axis=1, keepdims=True)).clip(-60, 0).astype(np.float64))
    a = np.exp(trans - trans.max())
    segs = -(-sizes // _SEGMENT)
    seq = np.repeat(np.arange(len(sizes)), segs)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(segs) - segs, segs)
    offset = (np.cumsum(sizes) - sizes)[seq] + nth * _SEGMENT
    length = np.minimum(_SEGMENT, sizes[seq] - nth * _SEGMENT)
    m = len(seq)
    steps = int(length.max())
    index = np.where(np.arange(steps)[None, :] < length[:, None], offset[:, None] + np.arange(steps)[None, :], n)
    padded = np.vstack([psi, np.ones((1, k))])
    eye = np.eye(k)
    first, final = nth == 0, nth == segs[seq] - 1
    prod = np.broadcast_to(eye, (m, k, k)).copy()
    for t in range(steps):  # transfer of a whole segment: product of (transition, emission)
        live = length > t
        moved = prod[live] @ a
        if t == 0:
            moved[first[live]] = eye  # nothing comes before a first word but the start scores
        step = moved * padded[index[live, t]][:, None, :]
        prod[live] = step / step.sum(axis=(1, 2), keepdims=True)
    into, back = np.empty((m, k)), np.empty((m, k))
    order = np.argsort(nth, kind="stable")
    marks = np.searchsorted(nth[order], np.arange(int(segs.max()) + 1))
    into[first] = np.exp(begin - begin.max())
    for j in range(1, int(segs.max())):
        s = order[marks[j] : marks[j + 1]]
        v = np.einsum("ni,nij->nj", into[s - 1], prod[s - 1])
        into[s] = v / np.abs(v).sum(axis=1, keepdims=True)
    back[final] = 1.0
    for j in range(int(segs.max()) - 2, -1, -1):
        s = order[marks[j + 1] : marks[j + 2]] - 1
        v = np.einsum("nij,nj->ni", prod[s + 1], back[s + 1])
        back[s] = v / v.sum(axis=1, keepdims=True)
    alpha, beta = np.zeros((n + 1, k)), np.zeros((n + 1, k))
    v = into
    for t in range(steps):
        live = np.flatnonzero(length > t)
        moved = v[live] @ a
        if t == 0:
            moved[first[live]] = v[live][first[live]]
        w = moved.clip(1e-300) * padded[index[live, t]]
        w /= w.sum(axis=1, keepdims=True)
        alpha[index[live, t]] = w
        v = v.copy()
        v[live] = w
    v = back
    for t in range(steps - 1, -1, -1):
        live = np.flatnonzero(length > t)
        beta[index[live, t]] = v[live]
        w = (padded[index[live, t]] * v[live]) @ a.T
        v = v.copy()
        v[live] = w / w.sum(axis=1, keepdims=True)
    gamma = alpha[:n] * beta[:n]
    return gamma / gamma.sum(axis=1, keepdims=True), alpha[:n], beta[:n]


def _lexicon(words: Words, label: np.ndarray, langs: int, most: int, ident_rows: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The commonest words, each in a class by the language that prefers it and how strongly."""
    ids, at, counts = np.unique(words.ident, return_inverse=True, return_counts=True)
    by = np.bincount(at * langs + label, minlength=len(ids) * langs).reshape(-1, langs).astype(float)
    kept = np.flatnonzero(counts >= 2)
    kept = np.sort(kept[np.argsort(-counts[kept], kind="stable")[:most]])
    share = by[kept] / by.sum(axis=0).clip(1)
    share /= share.sum(axis=1, keepdims=True)
    level = np.digitize(share.max(axis=1), [0.6, 0.95])
    return ids[kept], 1 + share.argmax(axis=1) * ident_rows + level


def gradients(crf: Crf, grams: np.ndarray, cell: np.ndarray, lex: np.ndarray, gold: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Of the negative log-likelihood of the labels ``gold``, word after word in sequences of ``sizes``: expected less observed counts.

    ``grams`` are the words' buckets, ``cell`` the word that each belongs to, ``lex`` the words' lexicon rows.
    """
    k = len(crf.langs)
    emit = np.add.reduceat(crf.emit[grams], np.flatnonzero(np.diff(cell, prepend=-1)), axis=0) + crf.lex_emit[lex]
    gamma, alpha, beta = posteriors(emit, sizes, crf.trans, crf.begin)
    err = gamma.copy()
    err[np.arange(len(gold)), gold] -= 1
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(gold), bool)
    inner[starts] = False
    t = np.flatnonzero(inner)
    psi = np.exp((emit[t] - emit[t].max(axis=1, keepdims=True)).clip(-60, 0))
    xi = alpha[t - 1][:, :, None] * np.exp(crf.trans - crf.trans.max())[None] * (psi * beta[t])[:, None, :]
    xi /= xi.sum(axis=(1, 2), keepdims=True).clip(1e-300)
    g_trans = xi.sum(axis=0)
    np.subtract.at(g_trans, (gold[t - 1], gold[t]), 1)
    flat = err[cell]
    return {
        "trans": g_trans,
        "begin": err[starts].sum(axis=0),
        "emit": np.stack([np.bincount(grams, flat[:, j], len(crf.emit)) for j in range(k)], axis=1),
        "lex_emit": np.stack([np.bincount(lex, err[:, j], len(crf.lex_emit)) for j in range(k)], axis=1),
    }


def train(sample: pd.DataFrame, epochs: int = 6, batch: int = 64, rate: float = 0.15, decay: float = 1e-5, switch: float = 0.35, most_words: int = 20_000, seed: int = 5) -> Crf | None:
    """From windows ``text, lang``. Windows of different languages are joined at a rate of ``switch``, so that transitions are learned."""
    langs = sorted(sample["lang"].unique())
    k = len(langs)
    if not k:
        return None
    texts = list(sample["text"])
    gold = np.array([langs.index(x) for x in sample["lang"]])
    words = featurize(texts)
    crf = Crf(langs, np.zeros((BUCKETS, k)), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((1 + 3 * k, k)), np.zeros((k, k)), np.zeros(k))
    if not len(words.first):
        return crf
    crf.lexicon, crf.lex_row = _lexicon(words, gold[words.doc], k, most_words)
    lex = crf.lex(words.ident)
    bounds = np.searchsorted(words.doc, np.arange(len(texts) + 1))
    ends = np.append(words.first[1:], len(words.grams))
    rng = np.random.default_rng(seed)
    state = {name: np.full(getattr(crf, name).shape, 1e-8) for name in ("emit", "lex_emit", "trans", "begin")}
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(np.diff(bounds) > 0))
        for lo in range(0, len(order), batch):
            docs = order[lo : lo + batch]
            glue = rng.random(len(docs)) < switch
            glue[:1] = False
            rows = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs])
            sizes = bounds[docs + 1] - bounds[docs]
            seq_sizes = np.bincount(np.cumsum(~glue) - 1, weights=sizes).astype(np.int64)
            spans = ends[rows] - words.first[rows]
            cell = np.repeat(np.arange(len(rows)), spans)
            inside = np.arange(len(cell)) - np.repeat(np.cumsum(spans) - spans, spans)
            grads = gradients(crf, words.grams[words.first[rows][cell] + inside], cell, lex[rows], np.repeat(gold[docs], sizes), seq_sizes)
            grads = {name: g / len(docs) for name, g in grads.items()}
            for name, g in grads.items():  # Adagrad
                v = getattr(crf, name)
                g = g + decay * v
                state[name] += g * g
                v -= rate * g / np.sqrt(state[name])
    crf.emit = crf.emit.astype(np.float32)
    crf.lex_emit = crf.lex_emit.astype(np.float32)
    return crf


def _shares(crf: Crf, texts: list[str | None]) -> np.ndarray:
    """Expected share of words in each language; NaN for texts without a letter."""
    words = featurize([t or "" for t in texts])
    sizes = np.bincount(words.doc, minlength=len(texts)) if len(words.doc) else np.zeros(len(texts), np.int64)
    out = np.full((len(texts), len(crf.langs)), np.nan)
    full = np.flatnonzero(sizes > 0)
    if len(full):
        gamma, _, _ = posteriors(crf.emissions(words), sizes[full].astype(np.int64), crf.trans, crf.begin)
        at = np.cumsum(sizes[full]) - sizes[full]
        out[full] = np.add.reduceat(gamma, at, axis=0) / sizes[full][:, None]
    return out


def sample_windows(docs: DataFrame, per_lang: int, window_words: int) -> pd.DataFrame:
    """The bounded training sample: of each language at most about ``per_lang`` documents by a hash of doc_id, of each one window of words."""
    marked = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in marked.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    h = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(10_000_000))
    take = F.lit(False)
    for lang, n in counts.items():
        take = take | ((F.col("lang") == lang) & (h < math.ceil(min(1.0, per_lang / n) * 10_000_000)))
    ws = F.split("text", r"\s+")
    at = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.greatest(F.size(ws) - window_words, F.lit(1))).cast("int") + 1
    window = F.substring(F.array_join(F.slice(ws, at, F.lit(window_words)), " "), 1, 20 * window_words)  # texts without blanks too
    rows = marked.where(take).select("doc_id", "lang", window.alias("text"))
    return rows.toPandas().sort_values(["doc_id", "lang", "text"])[["text", "lang"]]


def label_languages(docs: DataFrame, learn=None, per_lang: int = 600, window_words: int = 60) -> DataFrame:
    """Rows ``(doc_id, lang_pred, score)``, one for each row of ``docs``.

    Learns from text and non-null lang of the documents for which ``learn`` holds
    (default: all), at most about ``per_lang`` windows of ``window_words`` words (and 20
    times as many characters) for each language (the documented bound of the fit); every
    whole text is labelled. ``score`` is
    the predicted language's expected share of words. A null text or one without letters
    is ``und`` with score 0, as is every text where nothing could be learned. Repeated
    rows agree; other columns are ignored. Narrow but for the sample: no shuffle.
    """
    crf = train(sample_windows(docs.where(learn) if learn is not None else docs, per_lang, window_words))
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # 65,536 buckets x languages: fixed size
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, lo = batch.column("text").to_pylist(), 0
            pred, score = [], []
            while lo < len(texts):  # about a million characters at a time
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= 400_000):
                    chars += len(texts[hi] or "")
                    hi += 1
                share = _shares(model, texts[lo:hi]) if model else np.full((hi - lo, 1), np.nan)
                for row in share:
                    und = bool(np.isnan(row[0]))
                    pred.append("und" if und else model.langs[int(row.argmax())])
                    score.append(0.0 if und else float(min(1.0, max(0.0, row.max()))))
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
