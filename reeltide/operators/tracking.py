"""Regions of pictures followed as lines: greedy matching inside a picture, a state over the pictures.

One rule, `Lines`, serves the batch (`tracked`, rows of a film read in order) and the stream (`streaming.tracking`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from reeltide.operators.folds import fold


@dataclass(frozen=True)
class Rules:
    """Least overlap of a match, how much of a new probability is taken, above which it counts as sure and below which no more, after how many sure pictures a line is lifted, by how much a picture, and for how many pictures a lost line is kept."""

    overlap: float = 0.3
    share: float = 0.3
    sure: float = 0.55
    unsure: float = 0.4
    pictures: int = 3
    step: float = 0.25
    keep: int = 2


def overlap(a: tuple, b: tuple) -> float:
    """Common area over joint area of two boxes (x0, y0, x1, y1)."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h)


class Free:
    """The lines that a picture's regions may take, by equal boxes and these by cells of a grid for each power of two in width and height, so that a region looks at the boxes near it only.

    Boxes without an area, or that are not finite, overlap none.
    """

    def __init__(self, boxes: list[tuple], least: float):
        self.least, self.cells, self.same = least, {}, {}
        for i, box in enumerate(boxes):
            held = self.same.get(box)
            if held is not None:
                held.append(i)
                continue
            self.same[box] = held = [0, i]  # how many are taken, then the lines in order
            w, h = box[2] - box[0], box[3] - box[1]
            if 0 < w < math.inf and 0 < h < math.inf:
                kx, ky = math.frexp(w)[1], math.frexp(h)[1]
                grid = self.cells.setdefault((kx, ky), {})
                grid.setdefault((math.floor(math.ldexp(box[0], -kx)), math.floor(math.ldexp(box[1], -ky))), []).append((box, held))

    def take(self, box: tuple) -> int:
        """The line of the greatest overlap, the first of several, which is taken; -1 if none has `least`, or any at all."""
        w, h = box[2] - box[0], box[3] - box[1]
        if not (0 < w < math.inf and 0 < h < math.inf):
            return -1
        best, first, chosen, apart = 0.0, -1, None, 1 - self.least + 1e-9
        for (kx, ky), grid in self.cells.items():
            wide, high = math.ldexp(1.0, kx), math.ldexp(1.0, ky)  # above the widths and heights of this grid, at most twice as much
            if min(w, wide) < self.least * max(w, wide / 2) * (1 - 1e-9) or min(h, high) < self.least * max(h, high / 2) * (1 - 1e-9):
                continue
            x0, x1 = math.floor((box[0] - apart * wide) / wide), math.floor((box[0] + apart * w) / wide)
            y0, y1 = math.floor((box[1] - apart * high) / high), math.floor((box[1] + apart * h) / high)
            if (x1 - x0 + 1) * (y1 - y0 + 1) <= len(grid):
                near = [grid[c] for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) if (c := (x, y)) in grid]
            else:
                near = [held for (x, y), held in grid.items() if x0 <= x <= x1 and y0 <= y <= y1]
            for cell in near:
                for other, held in cell:
                    at = held[0] + 1
                    if at < len(held) and (share := overlap(other, box)) >= self.least and share > 0 and (share > best or share == best and held[at] < first):
                        best, first, chosen = share, held[at], held
        if chosen is not None:
            chosen[0] += 1
        return first


@dataclass
class Lines:
    """The lines of one film: each [id, box, probability, sure pictures, lost pictures, lift]."""

    rules: Rules
    lines: list[list] = field(default_factory=list)
    count: int = 0

    def picture(self, regions: list[tuple[tuple, float]]) -> list[tuple]:
        """One picture's regions (box, probability) in order: (id, probability, lift, found) of every line that is still followed."""
        r, taken = self.rules, set()
        free = Free([line[1] for line in self.lines], r.overlap)
        for box, prob in regions:
            place = free.take(box)
            if place < 0:
                taken.add(len(self.lines))
                self.lines.append([self.count, box, prob, 0, 0, 0.0])
                self.count += 1
            else:
                line = self.lines[place]
                taken.add(place)
                line[1], line[2], line[4] = box, line[2] + r.share * (prob - line[2]), 0
        for i, line in enumerate(self.lines):
            if i not in taken:
                line[4] += 1
            raised = line[5] >= 1
            if line[2] > r.sure:
                line[3] += 1
            elif line[2] < r.unsure and not raised:
                line[3] = 0
            if raised and line[4] == 0:
                line[3] = max(line[3], r.pictures)
            up = line[4] == 0 and line[3] >= r.pictures
            line[5] = min(1.0, line[5] + r.step) if up else max(0.0, line[5] - r.step)
        self.lines = [line for line in self.lines if line[4] <= r.keep or line[5] > 0]
        return [(line[0], line[2], line[5], line[4] == 0) for line in self.lines]


def tracked(regions: DataFrame, keys: list[str], picture: str, order: list[str], box: tuple[str, str, str, str], prob: str, rules: Rules) -> DataFrame:
    """keys, picture, line, prob, lift, found: the lines followed after every picture. A row without a box (its first column null) stands for a picture without regions.

    Pictures of a film depend on one another, so a film is read in order, picture by picture; many films are many tasks. Lines are numbered from 0 in the order in which they appear.
    """
    kinds = {f.name: f.dataType.simpleString() for f in regions.schema}
    n = len(keys)

    def close(state) -> list[tuple]:
        key, at, waiting, lines = state
        return [(*key, at, *row) for row in lines.picture(waiting)]

    def step(state, row):
        at, b, p = row[n], row[n + 1 : n + 5], row[n + 5]
        out = []
        if state is None:
            state = [row[:n], at, [], Lines(rules)]
        elif at != state[1]:
            out = close(state)
            state[1], state[2] = at, []
        if b[0] is not None:
            state[2].append((b, p))
        return state, out

    form = ", ".join(f"{c} {kinds[c]}" for c in [*keys, picture]) + ", line bigint, prob double, lift double, found boolean"
    return fold(regions, keys, [picture, *order], [picture, *box, prob], step, form, close)
