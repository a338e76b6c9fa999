import tracemalloc

import numpy as np
import pyarrow as pa

from glyphmill.llm.graph import ONE_TASK, contract, lowest


def batches(n, rows=50_000, nodes=3000):
    rng = np.random.default_rng(2)
    for _ in range(n):
        yield pa.RecordBatch.from_arrays([pa.array(rng.integers(0, nodes, rows)) for _ in range(2)], names=["a", "b"])


def test_edges_are_folded_as_they_come():
    tracemalloc.start()
    out = list(contract(batches(70), ONE_TASK))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 2999 and peak < 120_000_000


def test_the_whole_graph_comes_in_one_piece():
    every = list(batches(30, 1000, 20_000))
    a, b = (np.concatenate([x.column(k).to_numpy() for x in every]) for k in (0, 1))
    want = {(n, m) for n, m in zip(*(x.tolist() for x in lowest(a, b))) if n != m}
    (out,) = contract(iter(every), 1000, whole=True)
    assert set(zip(out.column(0).to_pylist(), out.column(1).to_pylist())) == want
    assert len(list(contract(iter(every), 1000))) > 1
