"""What a worker still holds of a slice of texts when it asks for the next one."""

import gc
import random
import tracemalloc

import pyarrow as pa
import pytest

from corpusflow.llm import packing, substrings

WORDS = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


class Caught(Exception):
    pass


def held(run, n_words, n=3):
    """MB that run holds, beyond what it held before it began, as it asks for a batch after the second one."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=n_words)) for _ in range(n)]
    found = []

    def batches():
        for k, text in enumerate(texts):
            gc.collect()
            found.append(tracemalloc.get_traced_memory()[0])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([text]), pa.array([k], pa.int32())], names=["doc_id", "text", "key"])

    tracemalloc.start()
    try:
        for made in run(batches()):
            del made  # written
    finally:
        tracemalloc.stop()
    return (max(found[1:]) - found[0]) / 1e6


@pytest.fixture
def worker(spark, docs, monkeypatch):
    """The function that an operator first sends to the workers."""

    def catch(operator):
        got = []

        def take(self, run, schema, *rest, **more):
            got.append(run)
            raise Caught

        df = docs([(1, "a")])
        monkeypatch.setattr(type(df), "mapInArrow", take)
        with pytest.raises(Caught):
            operator(df)
        return got[0]

    return catch


def test_packing_lets_a_slice_go_before_the_next(worker, monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)}))}))
    run = worker(packing.packed)
    held(run, 1000)  # the tokenizer
    assert held(run, 400_000) < 0.5  # their ids alone are 1.6 MB


def test_paths_of_a_slice_go_before_the_next(worker):
    assert held(worker(substrings.removed), 400_000) < 0.5  # paths of 50 bytes for every ten words
