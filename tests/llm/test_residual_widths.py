"""Sketches of sets whose widths are four times apart."""

import numpy as np
import pyarrow as pa

from palimpsest.llm import ngram_join


def test_residual_meets_sets_of_four_times_the_width():
    r = np.random.default_rng(2)
    large = np.unique(r.integers(0, 1 << 63, 150, dtype=np.uint64))
    small = large[::4]  # similarity 38 / 150, over a quarter
    rows = [(1, 0, 0, k, k, len(x), ngram_join.parity_sketch(x), 0, [1]) for k, x in enumerate((small, large))]
    assert len(rows[1][6]) == 4 * len(rows[0][6])
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=list("abcdefghi"))
    found = [x for out in ngram_join._residual(1, 4, None)(iter([batch])) for x in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert found == [(0, 1)]
