import ctypes
from pathlib import Path

import pyarrow as pa

from sparkloom.llm import exact_dedup, packing
from sparkloom.llm.queries import byte_level
from sparkloom.llm.shared import tidy


def resident_mb():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


def test_leaders_leave_in_batches_of_bounded_size():
    fields = (f.split() for f in exact_dedup._LEADER.split(", "))
    schema = pa.schema([*((n, pa.int64() if t == "long" else pa.string()) for n, t in fields), ("_c0", pa.string())])
    texts = [f"{i} " * 600 for i in range(8000)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(8000), pa.int64())] * 2 + [pa.array([len(t) for t in texts], pa.int64()), pa.array(texts)], ["_row", "_id", "_chars", "_c0"])
    out = [b for b in exact_dedup._combine(24 << 20, ["_c0"], "_c0", schema)(iter([rows])) if b.column(3).null_count < b.num_rows]
    assert sum(b.num_rows for b in out) == 8000
    assert sorted(x for b in out for x in b.column(8).to_pylist()) == sorted(texts)
    assert max(b.nbytes for b in out) < 9 << 20


def test_a_task_gives_back_what_it_freed():
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        return
    kept = []

    def run(batches):
        for batch in batches:
            held = [bytes(2000) for _ in range(50_000)]
            kept.append(held[-1])  # lies behind the freed ones, so the allocator keeps them
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["a"])
    before = resident_mb()
    assert list(tidy(run)(iter([batch]))) == [batch]
    assert resident_mb() - before < 50


def test_plain_texts_do_not_load_the_library():
    ids = packing.ByteIds(byte_level())
    ids("plain words only")
    assert "tokenizer" not in vars(ids)
    assert len(ids("an <|endoftext|> inside")) and "tokenizer" in vars(ids)
