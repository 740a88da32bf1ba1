"""Components against union by hand: paths, stars around the smallest and the largest node, random links."""

import random

import pytest

from tablewright.llm.components import components


def links_of(kind):
    rng = random.Random(9)
    return {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 300)],
            "high star": [(1000, i) for i in range(300)], "loops": [(5, 5), (7, 8), (8, 7), (7, 8)], "none": [],
            "random": [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(220)]}[kind]


@pytest.mark.parametrize("kind", ["path", "star", "high star", "loops", "none", "random"])
def test_components(spark, kind):
    links = links_of(kind)
    label = {n: n for link in links for n in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert all(label[n] == c for n, c in got.items())
    assert all(got.get(n, n) == c for n, c in label.items())
