"""Positive-unlabelled learning against plain loops over the published risk."""

import random
from math import exp, log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import quality


def on(edges, stats):
    """The bins that are 1 for a row, and the constant."""
    return [j * quality.BINS + sum(e <= x for e in edges[j]) for j, x in enumerate(stats)] + [quality.STATS * quality.BINS]


def descend(positive, unlabelled, prior, steps, rate=0.05, decay=1e-4):
    """Weights after so many Adam steps on the non-negative risk, row by row, and how often its second part was below zero."""
    w = [0.0] * (quality.STATS * quality.BINS) + [log(prior / (1 - prior))]
    m, v, below = [0.0] * len(w), [0.0] * len(w), 0
    for t in range(1, steps + 1):
        rest, grow, shrink = 0.0, [0.0] * len(w), [0.0] * len(w)
        for share, rows, sign in ((prior / len(positive), positive, -1), (1 / len(unlabelled), unlabelled, 1)):
            for row in rows:
                g = sum(w[i] for i in row)
                rest += sign * share * log(1 + exp(g))  # l(-g)
                for i in row:
                    shrink[i] += sign * share / (1 + exp(-g))
                    if sign < 0:
                        grow[i] -= share / (1 + exp(g))  # the slope of l(g)
        below += rest < 0
        for i in range(len(w)):
            slope = grow[i] + shrink[i] if rest >= 0 else -shrink[i]
            slope += decay * w[i] if i < len(w) - 1 else 0
            m[i], v[i] = 0.9 * m[i] + 0.1 * slope, 0.999 * v[i] + 0.001 * slope * slope
            w[i] -= rate * (m[i] / (1 - 0.9**t)) / (sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w, below


def fixture(n=24):
    rng = random.Random(5)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 30))) + "." for _ in range(n)]
    return good + [f"SPAM!! {k} " * rng.randint(3, 9) for k in range(n // 2)] + ["", "1 2 3\n1 2 3\n"]


@pytest.mark.parametrize("prior,some_below", [(0.3, False), (0.95, True)])
def test_weights_equal_plain_loops(prior, some_below):
    stats = np.array([quality.stats_of(t.encode()) for t in fixture()])
    model = quality.fit_pu(stats[:20], stats, prior, steps=40)
    want, below = descend([on(model.edges, s) for s in stats[:20]], [on(model.edges, s) for s in stats], prior, 40)
    assert np.allclose([*model.weights, model.bias], want, atol=1e-7) and (below > 0) == some_below


def test_scores_of_all_rows_equal_plain_loops(spark):
    texts = fixture()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 24)) for i in range(len(texts)) if i % 3], "doc_id long, label int")
    model = quality.fit(docs, labels, 10**6, 10**6)
    chosen = [i for i in range(24) if i % 3]
    stats = [quality.stats_of(t.encode()) for t in texts]
    prior = len(chosen) / len([i for i in range(len(texts)) if i % 3])
    want, _ = descend([on(model.edges, stats[i]) for i in chosen], [on(model.edges, s) for s in stats], prior, 400)
    got = {r["doc_id"]: r for r in quality.score(docs.withColumn("held_out", F.lit(False)), model).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, s in enumerate(stats):
        score = 1 / (1 + exp(-sum(want[k] for k in on(model.edges, s))))
        assert abs(got[i]["score"] - score) < 1e-5 and (abs(score - 0.7) < 1e-4 or got[i]["predicted"] == int(score >= 0.7))
