import re

import numpy as np
import pyarrow as pa

from lectern.llm import shingles as S


def test_slices_give_what_whole_batches_give():
    texts = [None, "", "É a B", "c d e f", "x\x0by\x0cz W é", "日本 Ü Q a\x85b c\xa0d e\x1cf"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    for start in (0, 1, 7, 123):
        part = batch.slice(start, 100).column(1)
        sets = S.shingle_sets(part, 3)
        alone = [S.shingle_sets(pa.array([t], pa.string()), 3)[0] for t in texts[start : start + 100]]
        assert all(np.array_equal(a, b) for a, b in zip(sets, alone, strict=True))
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for t in texts]
    sizes = [len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) >= 3 else bool(w) for w in (re.findall(r"[^\x20\x09-\x0D]+", t) for t in low)]
    assert [len(s) for s in S.shingle_sets(batch.column(1), 3)] == sizes


def test_batches_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(S, "SLICE", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 8, None, "b" * 30, "", "c" * 9])], ["doc_id", "text"])
    parts = list(S.sliced(batch))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4]]
    assert list(S.sliced(batch.slice(0, 0))) == []
