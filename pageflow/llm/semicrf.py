"""A semi-Markov conditional random field over candidate segments.

A text is a lattice of candidate segments with a type and whole-span features;
what no segment covers is outside at score 0.  The model is the exponential of
the summed weights of the chosen segments, over all choices without overlap.
Segments are bounded in length, so a lattice falls into clusters of overlapping
candidates, each decoded exactly by dynamic programming.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    kind: str
    features: tuple[str, ...]


def clusters(segments: Iterable[Segment]) -> list[list[Segment]]:
    """The segments in groups that don't overlap each other, by start."""
    out: list[list[Segment]] = []
    reach = -1
    for s in sorted(segments, key=lambda s: (s.start, s.end)):
        if s.start >= reach:
            out.append([])
        out[-1].append(s)
        reach = max(reach, s.end)
    return out


def score(segment: Segment, weights: dict[str, float]) -> float:
    return sum(weights.get(f, 0.0) for f in segment.features)


def decode(segments: Sequence[Segment], weights: dict[str, float]) -> list[Segment]:
    """The best choice of segments without overlap, by start."""
    chosen: list[Segment] = []
    for group in clusters(segments):
        if len(group) == 1:
            if score(group[0], weights) > 0:
                chosen.append(group[0])
            continue
        group.sort(key=lambda s: s.end)
        ends = [s.end for s in group]
        best, take = [0.0], []
        for i, s in enumerate(group):
            before = bisect_right(ends, s.start, 0, i)
            with_it = best[before] + score(s, weights)
            take.append((with_it > best[i], before))
            best.append(max(best[i], with_it))
        i, own = len(group), []
        while i:
            if take[i - 1][0]:
                own.append(group[i - 1])
                i = take[i - 1][1]
            else:
                i -= 1
        chosen += reversed(own)
    return chosen


def _marginals(group: list[Segment], weights: dict[str, float]) -> list[float]:
    """The probability of each segment of a cluster, sorted by end, under the model."""
    n = len(group)
    ends = [s.end for s in group]
    before = [bisect_right(ends, s.start, 0, i) for i, s in enumerate(group)]
    psi = [math.exp(min(30.0, score(s, weights))) for s in group]
    forward = [1.0]
    for i in range(n):
        forward.append(forward[i] + psi[i] * forward[before[i]])
    # The outside weight of each prefix: what the segments after it can add.
    backward = [0.0] * (n + 1)
    backward[n] = 1.0
    inside = [0.0] * n
    for i in range(n - 1, -1, -1):
        w = backward[i + 1]
        inside[i] = w * psi[i] * forward[before[i]]
        backward[i] += w
        backward[before[i]] += w * psi[i]
    return [x / forward[n] for x in inside]


def train(examples: Sequence[tuple[Sequence[Segment], set[tuple[int, int, str]]]], epochs: int = 6, rate: float = 0.5, l2: float = 1e-4) -> dict[str, float]:
    """Weights that raise the likelihood of the gold segments, by adaptive gradient steps."""
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-6)
    for _ in range(epochs):
        for segments, gold in examples:
            gradient: dict[str, float] = defaultdict(float)
            for group in clusters(segments):
                group.sort(key=lambda s: s.end)
                for s, p in zip(group, _marginals(group, weights), strict=True):
                    d = ((s.start, s.end, s.kind) in gold) - p
                    if abs(d) > 1e-4:
                        for f in s.features:
                            gradient[f] += d
            for f, g in gradient.items():
                g -= l2 * weights[f]
                squares[f] += g * g
                weights[f] += rate * g / math.sqrt(squares[f])
    return {f: round(w, 5) for f, w in weights.items() if abs(w) > 1e-3}
