"""All links of vectors, held against all pairs in double precision."""

import numpy as np

from palimpsest.llm import nn_descent


def pairs(r, n, dim, low, high):
    """2n random unit vectors, each with one other at a cosine from low to high."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, y = unit(r.standard_normal((n, dim))), r.standard_normal((n, dim))
    y = unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    c = r.uniform(low, high, (n, 1))
    return np.concatenate([x, c * x + np.sqrt(1 - c * c) * y])


def hold(spark, vectors):
    x = vectors.astype("f4")
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = nn_descent.near_duplicates(df).toPandas().set_index("vec_id").sort_index()
    x = x.astype("f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    assert (got["n_links"].to_numpy() == near.sum(axis=1) - 1).all()
    least = np.arange(len(x))
    while ((new := np.array([least[row].min() for row in near])) != least).any():
        least = new
    assert (got["component_id"].to_numpy() == least).all()


def test_sparse_links(spark):
    r = np.random.default_rng(1)
    hold(spark, np.concatenate([r.standard_normal((9800, 64)), pairs(r, 100, 64, 0.901, 0.95)]))


def test_sparse_links_beside_a_hot_group(spark):
    r = np.random.default_rng(1)
    hot = r.standard_normal(64) + 0.1 * r.standard_normal((3000, 64))
    hold(spark, np.concatenate([hot, r.standard_normal((6000, 64)), pairs(r, 500, 64, 0.901, 0.95)]))


def test_every_vector_has_a_link_near_the_threshold(spark):
    hold(spark, pairs(np.random.default_rng(1), 5000, 256, 0.901, 0.92))
