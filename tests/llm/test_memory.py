"""What a Python worker holds while and after it runs the tasks of the pipeline's operators."""

import gc
import tracemalloc
import weakref

import pyarrow as pa
import pytest

from graphloom.llm import neardup, packing, secrets


class Docs:
    """Stands for a table: gives the function that a stage hands to ``mapInArrow``."""

    columns, schema = ["doc_id", "text"], None

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def batch(texts: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, kind)], names=["doc_id", "text"])


def texts(n: int) -> list[str]:
    return [" ".join(f"w{(7 * i + j) % 9973}" for j in range(1600)) for i in range(n)]


@pytest.mark.parametrize("stage", ["sketched", "sets_of"])
def test_near_dedup_holds_a_slice_of_a_batch(spark, stage):
    run = neardup.sketched(Docs(), "doc_id", "text", 5) if stage == "sketched" else neardup.sets_of(Docs(), 5)
    whole = batch([t.encode() for t in texts(2500)], pa.binary())
    run_all = lambda b: [r for part in run(iter([b])) for r in part.to_pylist()]
    small = run_all(whole.slice(0, 100))
    tracemalloc.start()
    rows = sum(part.num_rows for part in run(iter([whole])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2500 and whole.nbytes > 20e6
    assert peak < 2 * whole.nbytes, f"{peak / 1e6:.0f} MB for a batch of {whole.nbytes / 1e6:.0f} MB"
    assert run_all(whole.slice(0, 150))[:100] == small


def test_other_operators_drop_the_encoder(spark):
    held = packing.encoder(packing.default_tokenizer())
    assert packing.encoder(packing.default_tokenizer()) is held
    list(neardup.sketched(Docs(), "doc_id", "text", 5)(iter([batch([b"a b c d e f"], pa.binary())])))
    again = packing.encoder(packing.default_tokenizer())
    assert again is not held
    list(secrets.find(Docs())(iter([batch(["a b"], pa.string())])))
    assert packing.encoder(packing.default_tokenizer()) is not again


def test_a_dropped_encoder_is_freed_at_once(spark):
    gone = weakref.ref(packing.encoder(packing.default_tokenizer()))
    gc.disable()
    try:
        list(neardup.sketched(Docs(), "doc_id", "text", 5)(iter([batch([b"a b c d e f"], pa.binary())])))
        assert gone() is None
    finally:
        gc.enable()


def test_slices_have_every_row_once():
    from graphloom.llm.common import sliced

    for most in (1, 10, 1000):
        for rows in ([], [None], [None, "", "x" * 25, "", "y", None], ["ab"] * 37):
            got = list(sliced(iter([batch(rows, pa.string()), batch(rows, pa.string())]), 1, most))
            assert [x for b in got for x in b.column(1).to_pylist()] == rows * 2
            assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column(1).to_pylist()) <= most for b in got)
