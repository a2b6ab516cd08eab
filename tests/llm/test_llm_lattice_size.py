"""Links of a lattice don't depend on how many vectors there are."""

import numpy as np

from tidemark.llm import lattice


def test_one_plan_for_any_number_of_vectors():
    assert len(lattice.PLANS) == 1 and lattice.PLANS[0][0] is None


def test_a_part_has_the_links_it_has_in_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24))
    x[300:] = x[:300] + rng.normal(size=(300, 24)) * rng.uniform(0.2, 0.6, size=(300, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    other = [(10_000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 24)))]

    def links(given):
        found = lattice.near_duplicates(spark.createDataFrame(given, "vec_id long, embedding array<double>"))
        return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.filter("vec_id < 10000").collect()}

    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.linalg.norm(np.array([v for _, v in other]), axis=1)[:, None]
    assert (unit @ (np.array([v for _, v in other]) / near).T).max() < 0.9  # the others link with none of these
    alone = links(rows)
    assert sum(n for n, _ in alone.values()) > 200
    monkeypatch.setattr(lattice, "BLOCK", (16, 64))
    assert links(rows + other) == alone
