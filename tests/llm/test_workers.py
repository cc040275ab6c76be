"""What a Python worker holds: little for each byte of text while it works, nothing of it afterwards."""

import tracemalloc

import pyarrow as pa
import pytest

from quillspan.llm import op2_minhash_dedup as op2
from quillspan.llm import op6_suffix_dedup as op6
from quillspan.llm import store


class Taken:
    """Stands for a table and keeps the function that its batches would go through."""

    def select(self, *_):
        return self

    where = select

    def mapInArrow(self, fn, schema):
        self.fn = fn
        return self


TEXTS = [" ".join(f"w{(i * 7919 + j * 104729) % 99991}" for j in range(150)) for i in range(1600)]
N = len(TEXTS)


@pytest.mark.parametrize("made, columns", [
    (lambda d: op6.occurrences(d, 200), [pa.array(TEXTS), pa.array([b"h"] * N), pa.array([len(t) for t in TEXTS], pa.int32()), pa.array([1] * N, pa.int32())]),
    (op2.features, [pa.array(range(N), pa.int64()), pa.array(TEXTS)]),
])
def test_worker_memory(spark, monkeypatch, made, columns):
    given = []
    monkeypatch.setattr(store, "give_back", lambda: given.append(1))
    run = made(Taken()).fn
    batch = pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])
    list(run(iter([batch.slice(0, 10)])))  # tables that are made once
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= N and sum(map(len, TEXTS)) > 1_300_000
    assert peak < 45 << 20, peak
    assert len(given) == 2
