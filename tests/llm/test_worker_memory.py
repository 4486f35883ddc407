"""What Python workers hold during and after a task."""

import sys
import tracemalloc

import numpy as np
import pytest

from corpusgate.llm import language
from corpusgate.llm.common import map_batches


def test_new_words_are_looked_up_in_lots():
    rng = np.random.default_rng(3)
    model = language.Model([f"l{i}" for i in range(12)], rng.normal(size=(language.BUCKETS, 12)),
                           np.zeros(12), 1.0, 0.0)
    letters = np.array(list("abcdefghijklmnop"))
    words = ["".join(rng.choice(letters, 9)) for _ in range(8000)]
    worker = language.Predictor(model)
    tracemalloc.start()
    found = worker.predict([" ".join(words)])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24e6  # the n-grams of all words at once took 39 MB
    buckets, starts = language.grams_of(list(worker.known))
    own = np.add.reduceat(model.table[buckets], starts, axis=0)
    assert np.array_equal(worker.sums[:, :-1], own)
    assert worker.sums[:, -1].sum() == len(buckets) and found[0][0] in model.labels


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_worker_returns_free_memory(spark):
    def resident():
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) // 1024

    def fill():
        before = resident()

        def work(batch):
            # The last block stays, so the freed ones below it are holes in the heap.
            blocks = [bytes(3000) for _ in range(50_000)]
            sys.corpusgate_held = blocks[-1]
            return {"pid": [__import__("os").getpid()], "mb": [before]}
        return work

    def look():
        return lambda batch: {"pid": [__import__("os").getpid()], "mb": [resident()]}

    one = spark.range(0, 1, 1, 1)
    for _ in range(3):
        pid, before = map_batches(one, fill, "pid BIGINT, mb BIGINT").collect()[0]
        after = {r["pid"]: r["mb"] for r in map_batches(
            spark.range(0, 4, 1, 4), look, "pid BIGINT, mb BIGINT").collect()}
        if pid in after:
            assert after[pid] < before + 60
            return
    pytest.skip("the worker was not used again")
