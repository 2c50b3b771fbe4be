"""What of the near dedup's buckets goes on to the exact comparison."""

import numpy as np
import pyarrow as pa

from meridian.llm import simhash


def _batch(rows):
    """(bucket, fp, rep) rows in order of their bucket."""
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([np.array([r[1]], "<u8").tobytes() for r in rows]), pa.array([r[2] for r in rows], pa.int64())], ["bucket", "fp", "rep"])


def test_what_several_buckets_hold_goes_on_once():
    near = [(0b0, 7), (0b1, -3), (0b11, 12)]  # a chain: 7 and 12 are two bits apart
    far = [((1 << 60) - 1, 5), ((1 << 60) - 2, 9)]
    rows = [(b, fp, rep) for b in range(4) for fp, rep in near] + [(b, fp, rep) for b in (10, 11) for fp, rep in [*near, *far]] + [(20, 0b0, 7), (20, 0b1, -3), (30, 0b0, 7), (30, far[0][0], 5)]
    found = [(b, r) for x in simhash._mark(1)(iter([_batch(rows)])) for b, r in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    groups = {}
    for b, r in found:
        groups.setdefault(b, set()).add(r)
    assert len(set(found)) == 3 + 2 + 2
    assert sorted(map(sorted, groups.values())) == [[-3, 7], [-3, 7, 12], [5, 9]]
