"""Memory of the merges of a band."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tideline.operators import density


def test_a_merge_holds_arrays_and_no_row_objects():
    n, rng = 20_000, np.random.default_rng(2)
    ra = np.arange(1, n)
    empty = {c: pa.nulls(n - 1, pa.float64() if c in ("lam_sum", "lam_max", "inner") else pa.int64())
             for c in ("root", "size", "cluster", "lam_sum", "lam_max", "inner")}
    table = pa.table({"a": ra, "b": ra // 2, "w": rng.random(n - 1) + .1, "ra": ra, "rb": ra // 2, **empty})
    tracemalloc.start()
    out = density._merge(0, 10)(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows > n and most < 800 * n
