"""The byte network against loops over chunks, places and filters."""

import math
import random

import numpy as np
import pytest

from cindergrid.llm import quality


def plain(net, data):
    """Probability by single loops: the last place closes a text, chunks of CHUNK places follow one another by half their length."""
    width, stride, chunk = quality.WIDTH, quality.STRIDE, quality.CHUNK // quality.STRIDE
    data = list(data) + [0] * (width - len(data))
    places = list(range(0, len(data) - width + 1, stride))
    if places[-1] != len(data) - width:
        places.append(len(data) - width)
    best = []
    for lo in range(0, len(places), chunk // 2):
        maxima = [0.0] * quality.FILTERS
        for p in places[lo:lo + chunk]:
            x = [float(v) for b in data[p:p + width] for v in net["E"][b]]
            for f in range(quality.FILTERS):
                maxima[f] = max(maxima[f], sum(a * float(w) for a, w in zip(x, net["W"][:, f])) + float(net["b"][f]))
        best.append(maxima)
    feats = [max(m[f] for m in best) for f in range(quality.FILTERS)] + [sum(m[f] for m in best) / len(best) for f in range(quality.FILTERS)]
    return 1 / (1 + math.exp(-(sum(a * float(u) for a, u in zip(feats, net["u"])) + float(net["c"]))))


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 300, 1500])
def test_scores_are_those_of_loops(n):
    rng = random.Random(n)
    net = quality.train(["plain words of a text", "#### 1 2 3", "more words here", "!!"], [1, 0, 1, 0])
    data = bytes(rng.randrange(256) for _ in range(n))
    assert quality.probability(net, quality.pooled(net, np.frombuffer(data, np.uint8))) == pytest.approx(plain(net, data), abs=1e-5)
