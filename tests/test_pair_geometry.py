"""Edges of features straight from Arrow arrays, and products of sparse rows as blocks."""

import numpy as np
import pyarrow as pa

from geoctx.operators import features, overlay


def test_edges_of_features_with_gaps():
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    rings = [[p((0, 0), (1, 0), (0, 1), (0, 0)), p((5, 5))], None, [], [p(), p((2, 2), (3, 3))]]
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    for array, shift in ((pa.array(rings, kind), 0), (pa.array([rings[0], *rings], kind)[1:], 0)):
        edges, owner = overlay._edges(array)
        assert owner.tolist() == [0, 0, 0, 3]
        assert edges.tolist() == [[0, 0, 1, 0], [1, 0, 0, 1], [0, 1, 0, 0], [2, 2, 3, 3]]


def test_blocks_of_sparse_rows():
    rng = np.random.default_rng(1)
    idx = [np.sort(rng.choice(40, n, replace=False)) for n in (0, 3, 40, 0, 7)]
    val = [rng.random(len(i)) for i in idx]
    dense = np.zeros((5, 40))
    for r, (i, v) in enumerate(zip(idx, val)):
        dense[r, i] = v
    m = rng.random((40, 6))
    got = np.concatenate([x @ m[used] for a, b in features._slices(idx, 5, 2) for x, used in [features._block(idx[a:b], val[a:b])]])
    assert np.allclose(got, dense @ m)
    assert all(b - a <= 2 for a, b in features._slices(idx, 10 ** 6, 2))
