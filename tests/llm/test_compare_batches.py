"""SimHash comparison streams over batches cut anywhere."""

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import simhash
from skein.llm.components import roots


@pytest.mark.parametrize("size", [1, 3, 50, 700, 5000])
def test_groups_go_on_over_batches(size):
    rng = np.random.default_rng(size)
    keys = np.sort(rng.choice(rng.integers(0, 1 << 33, 40), 2000, p=np.r_[0.4, np.full(39, 0.6 / 39)]))
    parts = rng.integers(-1, 2, 2000)
    order = np.lexsort([parts, keys])
    keys, parts = keys[order], parts[order]
    fps = rng.integers(0, 1 << 12, 2000).astype(np.uint64)
    expected = []
    for i in range(2000):
        same = np.flatnonzero((keys == keys[i]) & (parts == parts[i]) & (np.bitwise_count(fps ^ fps[i]) <= 3))
        expected += [(int(fps[i]), int(fps[j])) for j in same if fps[i] != fps[j]]
    table = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(parts), pa.array(fps.view(np.int64))], names=["key", "part", "fp"])
    batches = [table.slice(a, size) for a in range(0, 2000, size)]
    got = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in simhash.compare(iter(batches), 3)]
    lead = lambda pairs: {int(a): int(b) for a, b in roots(pairs)}
    assert lead(np.concatenate(got)) == lead(np.array(expected, np.int64))
