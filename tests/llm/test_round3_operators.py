"""SentencePiece, hard negatives and the divergence audit against the library, brute force and their SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.llm import divergence, negatives, pieces
from quillmark.llm.queries import ORACLE_SQL, QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    with open(MODEL, "rb") as f:
        return pieces.Pieces(f.read())


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def strange(rng, most=40):
    common = " ▁ab\n\t\x00é中\U0001f600e=.0123the ́​�<s>\r"
    return "".join(rng.choice(common) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x4E00, 0x5000), rng.randrange(0xE000, 0x11000)])) for _ in range(rng.randrange(most)))


def encoded(own, *texts):
    flat, ends = own.encode(list(texts))
    return [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_pieces_are_the_librarys(vocabulary, library):
    rng = random.Random(5)
    texts = ["", " ", "  ", "▁", " a", "a ", "a  b", "▁▁a", "\n\n", "<s></s><unk>", "<0x41>", "x" * 5000, "ab" * 4000, "= " * 3000, "中" * 3000, *(strange(rng) for _ in range(4000))]
    for t in texts:
        (ids,) = encoded(vocabulary, t)
        assert ids == library.encode(t), t
        assert vocabulary.decode(ids) == library.decode(ids), t


def test_any_ids_decode_as_the_librarys(vocabulary, library):
    rng = random.Random(6)
    for _ in range(4000):
        ids = [rng.randrange(32_000) if rng.random() < 0.3 else rng.randrange(270) for _ in range(rng.randrange(9))]
        assert vocabulary.decode(ids) == library.decode(ids), ids


def test_texts_are_encoded_together(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pieces, "_ROWS", 7)
    rng = random.Random(9)
    texts = [strange(rng, 60) for _ in range(300)] + ["", "w" * 31 + " " + "w" * 33 + "  é\u0101 " + "▁" * 40]
    assert encoded(vocabulary, *texts) == library.encode(texts)
    assert encoded(vocabulary) == []


def test_other_vocabularies_are_refused(library):
    from sentencepiece import sentencepiece_model_pb2 as proto

    def changed(change):
        spec = proto.ModelProto()
        spec.ParseFromString(library.serialized_model_proto())
        change(spec)
        return spec.SerializeToString()

    def unigram(m):
        m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM

    def squeezed(m):
        m.normalizer_spec.remove_extra_whitespaces = True

    def named(m):
        m.pieces[500].type = proto.ModelProto.SentencePiece.USER_DEFINED

    for change in (unigram, squeezed, named):
        with pytest.raises(ValueError):
            pieces.Pieces(changed(change))


def test_other_settings_of_a_vocabulary(library):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    rng = random.Random(8)
    texts = ["", "a b", " a", "中文", "\U0001f600\U0001f601 x", "  two  blanks ", *(strange(rng) for _ in range(500))]

    def bare(m):
        m.normalizer_spec.add_dummy_prefix = False

    def no_bytes(m):
        m.trainer_spec.byte_fallback = False
        for p in m.pieces:
            if p.type == proto.ModelProto.SentencePiece.BYTE:
                p.type = proto.ModelProto.SentencePiece.CONTROL

    def tied(m):
        for p in m.pieces:
            p.score = math.floor(p.score / 50)

    def spaced(m):
        m.pieces[600].piece = "a▁b"

    for change in (bare, no_bytes, tied, spaced):
        spec = proto.ModelProto()
        spec.ParseFromString(library.serialized_model_proto())
        change(spec)
        raw = spec.SerializeToString()
        own, theirs = pieces.Pieces(raw), SentencePieceProcessor(model_proto=raw)
        for t in texts:
            (ids,) = encoded(own, t)
            assert ids == theirs.encode(t), (change.__name__, t)
            assert own.decode(ids) == theirs.decode(theirs.encode(t)), (change.__name__, t)


def test_encode_pieces(spark, library):
    rng = random.Random(7)
    texts = [None, "", " ", "a b", "a b", "long " * 300_000, *(strange(rng) for _ in range(30))]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, agrees string")
    out = pieces.encode_pieces(docs, MODEL).collect()
    assert len(out) == len(texts) and all(r["agrees"] for r in out)
    for r in out:
        text = texts[3 if r["doc_id"] is None else r["doc_id"]] or ""
        assert r["ids"] == library.encode(text) and r["decoded"] == library.decode(library.encode(text))
    assert {r["agrees"] for r in pieces.encode_pieces(docs, MODEL, check=False).collect()} == {None}


def brute_negatives(rows):
    kept = [(i, lab, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, x) in enumerate(kept):
        if i is None or i % 50:
            continue
        scored = sorted((-int(x @ y), j is None, j or 0, other == lab, j) for b, (j, other, y) in enumerate(kept) if b != a and len(y) == len(x))
        for s, _, _, same, j in [r for r in scored if r[3]][:5]:
            fits = [r for r in scored if not r[3] and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(i, j, n, r[4], -s, -r[0]) for n, r in enumerate(fits, 1)]
    return sorted(out, key=str)


def vectors(rng, n, dims=12, labels=4):
    centres = rng.normal(size=(6, dims))
    x = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dims))
    return [(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(x / np.linalg.norm(x, axis=1, keepdims=True), rng.integers(0, labels, n), strict=True))]


ODD = [(None, [0.5] * 12, 1), (None, [0.4] * 12, 2), (1001, None, 1), (1002, [0.1] * 12, None), (1003, [float("nan")] * 12, 1), (1004, [float("inf")] + [0.0] * 11, 1), (1005, [None] + [0.1] * 11, 1), (1006, [], 1), (1050, [], 1), (1100, [0.0] * 12, 2), (1150, [0.3] * 5, 1), (1151, [0.3] * 5, 1), (1152, [0.2] * 5, 2), (1153, [1e30] * 12, 1)]
SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("block", [7, 512])
def test_hard_negatives(spark, block):
    rng = np.random.default_rng(3)
    rows = vectors(rng, 400)
    rows += [rows[50], rows[50], rows[3], *((2000 + i, rows[7][1], 1 + i % 2) for i in range(60))]
    rows += [r for r in ODD if r[0] != 1153]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows + [ODD[-1]]], SCHEMA + ", score string, q long").repartition(5)
    out = negatives.mine_negatives(frame, F.col("vec_id") % 50 == 0, block=block, sample=100, pivots=5)
    assert sorted(map(tuple, out.collect()), key=str) == brute_negatives(rows)


def test_hard_negatives_need_wide_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [x * 1e6 for x in v], lab) for i, v, lab in vectors(rng, 150, 5)]
    out = negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, out.collect()), key=str) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(50, None, 1)], [(50, [1.0], 1)], [(50, [1.0], 1), (51, [0.5], 1)]):
        assert negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect() == []


def test_searches_end_early(spark, monkeypatch):
    """Most anchors are certified before the last round, and later rounds scan rings, not what was scanned before."""
    rows = vectors(np.random.default_rng(5), 600, 3)
    seen = []
    real = negatives.settle

    def watch(df):
        out = real(df)
        if "radii" in df.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(negatives, "settle", watch)
    out = negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, block=16).collect()
    assert sorted(map(tuple, out), key=str) == brute_negatives(rows)
    assert seen and min(seen) < 12


def brute_audit(rows, top=200):
    docs = [(lang or "", source or "", Counter(t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))) for text, lang, source in rows]
    held, times, groups, out = defaultdict(int), defaultdict(int), defaultdict(set), []
    for lang, source, terms in docs:
        groups[lang].add(source)
        for t, n in terms.items():
            held[lang, t] += 1
            times[lang, source, t] += n
    for lang, sources in groups.items():
        kept = sorted(t for g, t in held if g == lang and held[g, t] >= 3)
        v, n = len(kept), {(s, t): times[lang, s, t] for s in sources for t in kept}
        if v:
            total = {s: sum(n[s, t] for t in kept) for s in sources}
            p = {(s, t): 1 + 10**9 * (n[s, t] + 1) // (total[s] + v) for s, t in n}
            every = {t: sum(n[s, t] for s in sources) for t in kept}
            q = {t: 1 + 10**9 * (every[t] + 1) // (sum(every.values()) + v) for t in kept}
        for s in sources:
            pair = sorted((-sum((p[s, t] - p[o, t]) ** 2 // p[o, t] for t in kept), o.encode(), o) for o in sources if o != s)
            term = sorted((-((p[s, t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if n[s, t] and p[s, t] > q[t])[:top]
            out += [(lang, s, part, x[2], -x[0], i) for part, found in (("pair", pair), ("term", term)) for i, x in enumerate(found, 1)]
    return sorted(out)


AUDITED = "text string, lang string, source string, term string, n long"


def audit_rows(n=120):
    rng = random.Random(2)
    words = ["The", "the", "of", "été", "ÉTÉ", "中文", "a1b", "x_y", "it's", "\U0001f600ok", "K", "z" * 300, *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))) + rng.choice(["", "\n", "é"]), rng.choice(["en", "de", None, ""]), rng.choice(["web", "books", None, "ünï", "b"])) for _ in range(n)]
    return rows + [(None, "en", "web"), ("", None, "code"), ("\x00a\x7fb", "en", "web"), ("word " * 50_000, "en", "web"), ("q" * 400_000, "en", "books"), ("rare terms only", "fr", "web"), ("nothing here", "fr", "code"), ("1 2 3", "it", "alone")] + [("Same same SAME", "en", "web")] * 4


def test_audit(spark):
    rows = audit_rows()
    out = divergence.audit_sources(spark.createDataFrame([(*r, "x", 1) for r in rows], AUDITED).repartition(7))
    assert sorted(map(tuple, out.collect())) == brute_audit(rows)
    assert divergence.audit_sources(spark.createDataFrame([], AUDITED)).collect() == []
    few = divergence.audit_sources(spark.createDataFrame([(*r, "x", 1) for r in rows], AUDITED), top=3).where("part = 'term'")
    assert few.agg(F.max("rank")).first()[0] == 3


def test_shares_beyond_a_long(spark):
    rows = [(n, t, v) for n in (0, 1, 9_223_372_034, 9_223_372_035, 9_223_372_036, 10**15) for t in (n, 10**16) for v in (1, 7)]
    out = spark.createDataFrame(rows, "n long, t long, v long").select("n", "t", "v", divergence._share(F.col("n"), F.col("t"), F.col("v")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // (r["t"] + r["v"]) for r in out)


def test_audit_when_hashes_collide(monkeypatch):
    texts = [t.encode() for t in ("aa bb aa cc", "bb b aa", "", "cc")]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    start, end, doc = divergence.term_slices(data, ends)
    found = [(bytes(data[a:b]), int(d)) for a, b, d in zip(start, end, doc, strict=True)]
    assert found == [(b"aa", 0), (b"bb", 0), (b"aa", 0), (b"cc", 0), (b"bb", 1), (b"b", 1), (b"aa", 1), (b"cc", 3)]
    for hashed in (lambda _: 1, lambda b: len(b), lambda b: b[0]):
        group, lead = divergence.group_slices(data, start, end, hashed)
        named = [bytes(data[start[i] : end[i]]) for i in lead]
        assert len(set(named)) == len(named) and [named[g] for g in group] == [t for t, _ in found]


def test_audit_rows_meet_across_batches():
    """Cells of a term that a batch splits are summed as if it did not; few pairs at a time make no difference."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    cells = [("en", f"t{t:03d}", s, int(rng.integers(1, 10**9)), int(rng.integers(1, 10**6))) for t in range(40) for s in "abcdefgh"[: 1 + t % 8]]
    whole = pa.RecordBatch.from_pylist([dict(zip(("lang", "term", "source", "p", "zero"), c, strict=True)) for c in cells])

    def total(batches, most):
        out = Counter()
        for b in divergence._shared(iter(batches), most):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["item"]] += r["extra"]
        return out

    want = total([whole], 1 << 20)
    assert want == total([whole.slice(i, 7) for i in range(0, len(cells), 7)], 5) and len(want) == 56


def test_counting_takes_little_memory():
    """Two workers an executor count at once; 9 MB of text in one batch took 145 MB beside the batch, and a worker 235 MB on check_s."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(0)
    words = np.array(["w" + "abcdefghij"[i % 10] * (i % 5) + "".join("abcdefghij"[int(c)] for c in str(i)) for i in range(60_000)])
    texts = [" ".join(words[(rng.random(300) ** 3 * len(words)).astype(int)]) for _ in range(4000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "source": [f"s{i % 20}" for i in range(len(texts))], "text": texts})
    tracemalloc.start()
    try:
        n = sum(int(x["n"].to_numpy().sum()) for x in divergence._count(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 300 * len(texts) and peak < 110e6


def test_slices_cut_in_blocks():
    """Texts that touch, blocks of any size and bytes of all kinds: the terms are those of the slices."""
    texts = [t.encode() for t in ("aB", "cd", "", "\x00é中", "中!aB aB", " cd\x85\xa0", "aB")]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    start, end, _ = divergence.term_slices(data, ends)
    assert divergence._cut(data, start, end) == [bytes(data[a:b]) for a, b in zip(start, end, strict=True)]
    want = divergence.group_slices(data, start, end)
    for block in range(1, len(start) + 2):
        assert all((a == b).all() for a, b in zip(divergence.group_slices(data, start, end, block=block), want, strict=True))


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_source_divergence"])
def test_against_sql(spark, name, tmp_path):
    rng = np.random.default_rng(8)
    spark.createDataFrame(vectors(rng, 200, 8, 10) + [(None, [0.1] * 8, 3), (7, None, 1), (201, [0.2] * 8, None)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, *r) for i, r in enumerate(audit_rows(60))], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got)
    rows = [sorted(map(str, df[cols].astype(object).where(pd.notna(df[cols]), None).to_numpy().tolist())) for df in (got, want)]
    assert [r.replace(".0", "") for r in rows[0]] == [r.replace(".0", "") for r in rows[1]]
