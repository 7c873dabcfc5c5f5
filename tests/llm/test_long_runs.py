"""Long runs of one byte: contexts are laid out a bounded number of bytes at a time, and results stay exact."""

import hashlib
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import substring_dedup as sd

RUN = """
import resource, sys
import numpy as np, pyarrow as pa
from types import SimpleNamespace
from quillmark.llm import substring_dedup as sd
full = np.full(1 << 10, 255, np.uint8).tobytes()
empty = bytes(1 << 10)
run = sd._context_rows(100, SimpleNamespace(value=((full, 1 << 13), (empty, 1 << 13))), 1, 0, 4, 2)
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["=" * 1_500_000]), pa.array([7])], ["id", "text", "k"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = sum(len(b) for b in run(iter([batch])))
print(rows, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


def test_memory_of_a_long_run():
    out = subprocess.run([sys.executable, "-c", RUN], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 1 and float(out[1]) < 600, out


@pytest.mark.parametrize("pack_bytes", [150, 5_000, 1 << 24])
def test_stretches_lose_no_context(pack_bytes):
    text = "=" * 900 + "words between " * 30 + "-" * 700
    shared = SimpleNamespace(value=((np.full(1 << 10, 255, np.uint8).tobytes(), 1 << 13), (bytes(1 << 10), 1 << 13)))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text[3:]]), pa.array([7, 8])], ["id", "text", "k"])

    def rows(limit):
        found = sd._context_rows(100, shared, 1, 0, 4, 2, pack_bytes=limit)(iter([batch]))
        return sorted((s, *map(str, r.values())) for b in found for s, body in zip(b["shard"].to_pylist(), b["body"].to_pylist(), strict=True) for r in sd._unpacked([body]).to_pylist())

    want = rows(1 << 30)
    assert rows(pack_bytes) == want and len(want) > 300


def test_runs_are_removed_exactly(spark):
    rows = [(1, "=" * 5_000), (2, "x" + "=" * 3_000 + "tail " * 40), (3, "-" * 450), (4, "=" * 99), (5, None), (6, "tail " * 40 + "=" * 150)]
    out = sd.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    want = sd.brute_force(rows)
    assert [(r["n_bytes"], r["n_removed"], len(r["spans"])) for r in out] == [w[:3] for w in want]
    assert [hashlib.sha256(bytes(r["kept"]) if not isinstance(r["kept"], str) else r["kept"].encode()).hexdigest() for r in out] == [hashlib.sha256(w[3]).hexdigest() for w in want]
