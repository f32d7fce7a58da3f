"""The plane of a community against a plain power iteration on its centered vectors."""

import numpy as np
import pytest

from sixfold.operators.projection import plane


@pytest.mark.parametrize("d, wide", [(5, 256), (5, 0), (768, 256)])
def test_plane(spark, d, wide):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, d)) * np.r_[[3, 2, 1, 0.5, 0.1], np.full(d - 5, 0.02)]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)
    member = spark.createDataFrame([(i, i % 2) for i in range(60)], "node_id long, community int")
    got = {r.id: (r.x, r.y) for r in plane(nodes, member, wide).collect()}
    for c in (0, 1):
        y = x[c::2] - x[c::2].mean(axis=0)

        def power(m, v):
            v = v / np.linalg.norm(v)
            for _ in range(20):
                v = m.T @ (m @ v)
                v = v / np.linalg.norm(v)
            return v

        a = power(y, y[0])
        z = y - np.outer(y @ a, a)
        b = power(z, z[0])
        for k, i in enumerate(range(c, 60, 2)):
            assert abs(got[i][0] - y[k] @ a) < 1e-6 and abs(got[i][1] - z[k] @ b) < 1e-6
