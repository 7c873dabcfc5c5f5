"""The queries as registered, over small tables with every odd row: columns, folds and digests against brute force."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import decontaminate, mixing, substring_dedup
from quillmark.llm.queries import QUERIES
from test_operators import brute_base, brute_classes, brute_lines, dense_rates, words

KINDS = "doc_id long, text string, lang string, source string, n_chars long, size string, id string, __row string, leaks string"


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(9), []
    line, item = "a line that many of these documents hold " + "x" * 20, words(20, 77)
    for i in range(60):
        text = f"{words(40 + i % 30, i % 45)}\n{line if i % 4 == 0 else 'short'}\n{words(30, 200 + i % 7)}"
        text += {0: f" token={rng.bytes(6).hex()} AKIA{'Q' * 16}", 1: f" {item.upper()}", 2: "!!! " * 9}.get(i % 10, "")
        out.append((i, text, ("en", "de", None)[i % 3], ("web", "books", None, "code")[i % 4]))
    out += [(100, None, "en", "web"), (101, "", None, None), (102, " \t\n\n", "de", "code"), (103, "w " * 30_000, "en", "web"), (None, out[0][1], None, "web"), (None, None, None, None), out[3], out[3], (104, "12 34 !", "en", "web")]
    return out


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(*r, 0, "s", "i", "r", "l") for r in rows], KINDS)
    labels = spark.createDataFrame([(i, int(i % 10 != 2), 0, "x") for i in range(0, 60, 2)] + [(None, 1, 0, "x"), (3, None, 1, "x"), (4, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    bench = spark.createDataFrame([(1, words(20, 77), "x"), (2, None, "x"), (None, "abc", "x"), (3, "", "x")], "item_id long, text string, leaks string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{top}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{top}/empty/{name}.parquet")
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    vectors.limit(0).write.parquet(f"{top}/empty/embeddings.parquet")
    return top


def got(spark, tables, name):
    return QUERIES[name](spark, f"{tables}/full").toPandas()


def key(x):
    return -1 if x is None or pd.isna(x) else int(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tables, name):
    assert QUERIES[name](spark, f"{tables}/empty").count() == 0


def test_mixing(spark, tables, rows):
    out = got(spark, tables, "op2_mixing")
    assert len(out) == len(rows) and (out["taken"] <= 2 * out["size"]).all()
    size = pd.Series([len((t or "").split()) for _, t, *_ in rows])
    source = pd.Series([s or "" for *_, s in rows])
    want = dict(zip(out["source_size"], out["target"], strict=True))
    for name, own in size.groupby(source):
        rates = dense_rates(own.to_numpy(float), want[own.sum()])
        assert abs((rates * own).sum() - want[own.sum()]) < 1e-6 * own.sum()
        mine = out[out["source_size"] == own.sum()]
        reach = 1  # bit n: some zero to two copies of each text have n words
        for n in own.tolist():
            reach |= reach << n | reach << 2 * n
        goal = mine["target"].iloc[0]
        nearest = min(abs(n - goal) for n, bit in enumerate(reversed(bin(reach)[2:])) if bit == "1")
        assert sorted(mine["size"]) == sorted(own) and abs(mine["taken"].sum() - goal) <= nearest + sorted(own)[-2], name
    again = got(spark, tables, "op2_mixing")
    assert sorted(map(tuple, out.fillna(-1).to_numpy().tolist())) == sorted(map(tuple, again.fillna(-1).to_numpy().tolist()))


def test_near_duplicates(spark, tables, rows):
    out = got(spark, tables, "op3_minhash")
    texts = {i: t for i, t, *_ in rows if i is not None}
    want = brute_classes(list(texts.items()))
    assert len(out) == len(rows) and {key(i): key(c) for i, c in zip(out["doc_id"], out["class_id"], strict=True) if key(i) >= 0} == want


def test_secrets(spark, tables, rows):
    out = got(spark, tables, "op4_secret_scan")
    base = [brute_base(t or "") for _, t, *_ in rows]
    digest = lambda spans: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    want = sorted((key(i), *(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")), digest(spans)) for (i, *_), spans in zip(rows, base, strict=True))
    assert sorted((key(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out.itertuples()) == want and sum(x[1] for x in want) >= 6


@pytest.mark.parametrize(("name", "folds", "rest", "columns"), [("op5_language_id", 3, 1, ["doc_id", "held_out", "lang_pred", "score"]), ("op7_quality", 4, 2, ["doc_id", "held_out", "score", "predicted"])])
def test_folds(spark, tables, rows, name, folds, rest, columns):
    out = got(spark, tables, name)
    assert list(out.columns) == columns and len(out) == len(rows) and out["score"].between(0, 1).all() and out["held_out"].notna().all()
    assert all(r.held_out == (key(r.doc_id) >= 0 and zlib.crc32(str(key(r.doc_id)).encode()) % folds == rest) for r in out.itertuples())
    if name == "op7_quality":
        assert ((out["score"] >= 0.7) == (out["predicted"] == 1)).all()
    else:
        und = sorted(key(i) for i, p in zip(out["doc_id"], out["lang_pred"], strict=True) if p == "und")
        assert und == sorted(key(i) for i, t, *_ in rows if not any(c.isalpha() for c in t or "")) and set(out["lang_pred"]) <= {"en", "de", "und"}


def test_learning_leaves_the_held_out_fold_out(spark, tables, rows):
    """Scores don't change with what the held-out rows are labelled as."""
    docs = spark.read.parquet(f"{tables}/full/documents.parquet")
    labels = spark.read.parquet(f"{tables}/full/labels.parquet")
    other = f"{tables}/other"
    fold = F.crc32(F.col("doc_id").cast("string"))
    docs.withColumn("lang", F.when(fold % 3 == 1, "zz").otherwise(F.col("lang"))).write.mode("overwrite").parquet(f"{other}/documents.parquet")
    labels.withColumn("quality", F.when(fold % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality"))).write.mode("overwrite").parquet(f"{other}/labels.parquet")
    for name, value in (("op5_language_id", "lang_pred"), ("op7_quality", "predicted")):
        a, b = (sorted((key(r["doc_id"]), r[value], round(r["score"], 9)) for r in QUERIES[name](spark, d).collect()) for d in (f"{tables}/full", other))
        assert a == b


def test_decontamination(spark, tables, rows):
    out = got(spark, tables, "op6_decontamination")
    brute = decontaminate.brute_force(pd.DataFrame([(n, t) for n, (_, t, *_) in enumerate(rows) if len(t or "") < 5000], columns=["doc_id", "text"]), pd.DataFrame({"item_id": [1], "text": [words(20, 77)]}))
    want = sorted((key(rows[n][0]), bool(x), ",".join(f"{a}:{b}" for a, b in x)) for n, x in brute.items())
    assert [x for x in sorted((key(r.doc_id), r.contaminated, r.items) for r in out.itertuples()) if x[0] != 103] == want and sum(x[1] for x in want) == 6


def test_substrings(spark, tables, rows):
    out = got(spark, tables, "op8_substring_dedup")
    brute = substring_dedup.brute_force([(i, t) for i, t, *_ in rows if i != 103])
    want = sorted((key(i), n, gone, runs, hashlib.sha256(kept).hexdigest()) for (i, *_), (n, gone, runs, kept) in zip([r for r in rows if r[0] != 103], brute, strict=True))
    assert [x for x in sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.itertuples()) if x[0] != 103] == want
    long = out[out["doc_id"] == 103].iloc[0]
    assert (long.n_bytes, long.n_removed, long.n_spans) == (60_000, 59_998, 1) or (long.n_removed, long.n_spans) == (59_998, 1)


def test_lines(spark, tables, rows):
    out = got(spark, tables, "op9_line_dedup")
    want = brute_lines([(i, t) for i, t, *_ in rows if i is not None])
    for r in out.itertuples():
        if key(r.doc_id) >= 0:
            n, gone, text = want[key(r.doc_id)]
            assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest())
    assert len(out) == len(rows) and sum(x[1] for x in want.values()) >= 10


def test_pipeline_by_brute_force(spark, tables, rows):
    """Stages of which brute force can tell the rows: near duplicates, decontamination, mixing, shards."""
    docs, kept = spark.read.parquet(f"{tables}/full/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, f"{tables}/full").write.mode("overwrite").parquet(f"{tables}/stages/{name}")
        before, docs = docs, spark.read.parquet(f"{tables}/stages/{name}")
        kept[name] = ([(r["doc_id"], r["text"], r["source"]) for r in before.collect()], [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    before, after = kept["near_dedup"]
    # rows of one id have one text here; a null id is given a number beyond all ids
    named = [(i if i is not None else 10_000 + n, t) for n, (i, t, _) in enumerate(before)]
    classes = brute_classes(list(dict(named).items()))
    worded = {i for i, t in named if (t or "").split()}
    want = sorted({classes[i] for i in worded} | {i for i in classes if i not in worded})
    assert sorted(key(i) if i is not None else 10_000 for i, *_ in after) == sorted(min(i, 10_000) for i in want)
    before, after = kept["decontamination"]
    leaks = decontaminate.brute_force(pd.DataFrame([(n, t) for n, (_, t, _) in enumerate(before) if len(t or "") < 5000], columns=["doc_id", "text"]), pd.DataFrame({"item_id": [1], "text": [words(20, 77)]}))
    assert sorted(map(str, after)) == sorted(str(r) for n, r in enumerate(before) if not leaks.get(n))
    before, after = kept["mixture"]
    size = lambda rs: sum(len((t or "").split()) for _, t, _ in rs)
    goals = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(s, size([r for r in before if r[2] == s])) for s in {r[2] for r in before}], "source string, source_size long")).collect()}
    for s, goal in goals.items():
        own = [r for r in before if r[2] == s]
        assert abs(size([r for r in after if r[2] == s]) - goal) <= sorted(len((t or "").split()) for _, t, _ in own)[-1] and max(after.count(r) for r in own) <= 2 * max(own.count(r) for r in own)
    assert sorted(map(str, kept["shards"][1])) == sorted(map(str, kept["shards"][0]))
