"""The overlay arithmetic on hand-made and generated shapes."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from shapes import clip, ring, shoelace, square, star

from terraquilt.functions import kernel

UNIT = [square(0, 0, 1, 1)]
RING4 = [square(0, 0, 4, 4), square(1, 1, 3, 3, hole=True)]
TWO = [square(0, 0, 1, 1), square(3, 0, 4, 1, part=1)]
ELL = [ring((0, 0), (2, 0), (2, 1), (1, 1), (1, 3), (0, 3))]

CASES = {
    "identical": (UNIT, UNIT, True, 1.0),
    "half over": (UNIT, [square(0.5, 0, 1.5, 1)], True, 0.5),
    "shared edge, opposite side": (UNIT, [square(1, 0, 2, 1)], True, 0.0),
    "shared edge, same side": (UNIT, [square(0, 0, 0.5, 2)], True, 0.5),
    "partly collinear": (UNIT, [square(1, 0.25, 2, 5)], True, 0.0),
    "touch at corner": (UNIT, [square(1, 1, 2, 2)], True, 0.0),
    "apart": (UNIT, [square(2, 2, 3, 3)], False, 0.0),
    "contains": (UNIT, [square(0.25, 0.25, 0.5, 0.5)], True, 0.0625),
    "within": (UNIT, [square(-1, -1, 2, 2)], True, 1.0),
    "vertices on edges": (UNIT, [ring((0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5))], True, 0.5),
    "fills the hole": (RING4, [square(1, 1, 3, 3)], True, 0.0),
    "inside the hole": (RING4, [square(1.5, 1.5, 2, 2)], False, 0.0),
    "over the hole": (RING4, [square(0, 0, 2, 4)], True, 6.0),
    "same hole": (RING4, RING4, True, 12.0),
    "one part": (TWO, [square(3.5, 0, 9, 1)], True, 0.5),
    "both parts": (TWO, [square(0.5, 0, 3.5, 1)], True, 1.0),
    "l-shape": (ELL, [square(0.5, 0.5, 1.5, 2)], True, 1.0),
    "clockwise exterior": (UNIT, [ring((0, 0), (0, 1), (0.5, 1), (0.5, 0))], True, 0.5),
    "null": (UNIT, None, False, 0.0),
    "empty": ([], UNIT, False, 0.0),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("swap", [False, True])
def test_golden(name, swap):
    a, b, hit, area = CASES[name]
    got = clip([(b, a) if swap else (a, b)], True)[0]
    assert got["hit"] is hit
    assert got["area_deg"] == pytest.approx(area, abs=1e-12)
    assert got["residual"] == pytest.approx(0, abs=1e-12)
    rings = [(r["part"], r["hole"], np.array([(p["x"], p["y"]) for p in r["pts"]])) for r in got["rings"]]
    assert shoelace(rings) == pytest.approx(area, abs=1e-12)


@pytest.mark.parametrize("swap", [False, True])
def test_bow_tie_is_its_two_lobes(swap):
    bow = [ring((0, 0), (1, 1), (1, 0), (0, 1))]
    band = [square(-1, 0.25, 2, 0.5)]
    around = [square(-1, -1, 2, 2)]
    for other, area in ((band, 0.1875), (around, 0.5)):
        got = clip([(other, bow) if swap else (bow, other)], True)[0]
        rings = [(r["part"], r["hole"], np.array([(p["x"], p["y"]) for p in r["pts"]])) for r in got["rings"]]
        assert got["hit"] and got["residual"] == pytest.approx(0, abs=1e-12)
        assert got["area_deg"] == pytest.approx(shoelace(rings)) == pytest.approx(area)


def test_other_crossing_shapes_by_the_even_odd_rule():
    box = [square(-9, -9, 9, 9)]
    angle = np.pi / 2 + 4 * np.pi * np.arange(5) / 5
    star5 = [ring(*zip(np.cos(angle), np.sin(angle)))]
    r = np.cos(2 * np.pi / 5) / np.cos(np.pi / 5)  # inner pentagon, which the star winds round twice
    pentagon = 2.5 * r * r * np.sin(2 * np.pi / 5)
    points = 5 * r * np.sin(np.pi / 5) - pentagon
    spike = [ring((0, 0), (4, 0), (4, 1), (6, 1), (4, 1), (4, 2), (0, 2))]
    twice = [ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0), (2, 0), (2, 2), (0, 2))]
    over = [square(0, 0, 2, 2), square(1, 1, 3, 3, part=1)]
    for shape, area in ((star5, points), (spike, 8), (twice, 0), (over, 6)):
        assert clip([(shape, box)])[0]["area_deg"] == pytest.approx(area, abs=1e-9)


@pytest.mark.parametrize("noise", [1e-14, 1e-13, 1e-12, 1e-11, 1e-10, 3e-10, 7e-10, 1e-9, 1.5e-9, 2e-9, 3e-9, 1e-8, 1e-7])
def test_near_equal_boundaries(noise):
    """Copies and neighbours with noise on every vertex keep the area that they have."""
    rng = np.random.default_rng(int(noise * 1e15))
    pairs, want = [], []
    for k in range(400):
        x, y, w, h = *rng.uniform(-1, 1, 2), *rng.uniform(0.1, 1, 2)
        x, y = x + 150, y - 33
        corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        if k % 2:  # more vertices on the sides
            corners = [p for a, b in zip(corners, corners[1:] + corners[:1]) for p in (a, ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2))]
        kind = k % 3
        moved = [(px + (w if kind == 1 else w / 2 if kind == 2 else 0), py) for px, py in corners]
        jitter = rng.uniform(-noise, noise, (len(moved), 2))
        pairs.append(([ring(*corners)], [ring(*[(px + dx, py + dy) for (px, py), (dx, dy) in zip(moved, jitter)])]))
        want.append((1, 0, 0.5)[kind] * w * h)
    for got, area in zip(clip(pairs, True), want):
        assert got["area_deg"] == pytest.approx(area, abs=20 * noise + 2e-8)
        assert got["residual"] < 1e-9
        rings = [(r["part"], r["hole"], np.array([(p["x"], p["y"]) for p in r["pts"]])) for r in got["rings"]]
        assert shoelace(rings) == pytest.approx(got["area_deg"], abs=1e-9)


def test_large_pairs_are_quick():
    import time

    rng = np.random.default_rng(3)
    a, b = (star(0, 0, 1 + 0.01 * rng.random(16_000)) for _ in range(2))
    start = time.perf_counter()
    got = clip([(a, b)])[0]
    assert got["residual"] < 1e-9 and 3 < got["area_deg"] < 3.3
    assert time.perf_counter() - start < 8


def test_clipped_holes_and_parts_are_assembled():
    comb = [square(0, 0, 5, 1), square(1, 0.25, 2, 0.75, hole=True)]
    got = clip([(comb, [ring((0.5, -1), (4.5, -1), (4.5, 2), (3.5, 2), (3.5, -0.5), (2.5, -0.5), (2.5, 2), (0.5, 2))])], True)[0]
    kinds = sorted((r["part"], r["hole"]) for r in got["rings"])
    assert [h for _, h in kinds].count(True) == 1 and len({p for p, _ in kinds}) == 2
    assert got["area_deg"] == pytest.approx(2 - 0.5 + 1)


def test_touching_parts_become_separate_rings():
    diamond = [ring((0, 0), (2, 0), (2, 2), (0, 2))]
    notch = [ring((-1, -1), (3, -1), (1, 1), (3, 3), (-1, 3), (1, 1))]
    got = clip([(diamond, notch)], True)[0]
    assert got["area_deg"] == pytest.approx(2)
    assert len(got["rings"]) == 2


radii = st.lists(st.floats(0.2, 1.0), min_size=3, max_size=24)
centre = st.floats(-0.8, 0.8)


@settings(max_examples=60, deadline=None)
@given(radii, radii, centre, centre)
def test_symmetric_bounded_and_closed(ra, rb, dx, dy):
    a, b = star(150, -33, ra), star(150 + dx, -33 + dy, rb)
    ab, ba = clip([(a, b), (b, a)])
    assert ab["area_deg"] == pytest.approx(ba["area_deg"], abs=1e-7)
    assert ab["hit"] == ba["hit"]
    assert ab["residual"] < 1e-7
    assert -1e-9 <= ab["area_deg"] <= min(shoelace(a), shoelace(b)) + 1e-7


@settings(max_examples=30, deadline=None)
@given(radii, centre, centre)
def test_tiles_add_up(r, dx, dy):
    shape = star(dx, dy, r)
    tiles = [[square(x / 2, y / 2, x / 2 + 0.5, y / 2 + 0.5)] for x in range(-4, 4) for y in range(-4, 4)]
    parts = clip([(t, shape) for t in tiles], True)
    assert sum(p["area_deg"] for p in parts) == pytest.approx(shoelace(shape), abs=1e-7)
    assembled = 0.0
    for p in parts:
        assembled += shoelace([(q["part"], q["hole"], np.array([(v["x"], v["y"]) for v in q["pts"]])) for q in p["rings"]])
    assert assembled == pytest.approx(shoelace(shape), abs=1e-7)


def test_many_pairs_at_once_match_one_at_a_time():
    rng = np.random.default_rng(7)
    pairs = [
        (star(0, 0, rng.uniform(0.2, 1, rng.integers(3, 30))), star(*rng.uniform(-1, 1, 2), rng.uniform(0.2, 1, rng.integers(3, 30))))
        for _ in range(200)
    ] + [(c[0], c[1]) for c in CASES.values()]
    together = clip(pairs, True)
    for pair, row in zip(pairs, together):
        alone = clip([pair], True)[0]
        assert alone["hit"] == row["hit"]
        assert alone["area_deg"] == pytest.approx(row["area_deg"], abs=1e-12)
        assert len(alone["rings"]) == len(row["rings"])


def test_far_vertices_are_not_compared(monkeypatch):
    """A pair's cost follows the boundary near the smaller shape, not all of a district's points."""
    seen, joined = [], kernel._joined
    monkeypatch.setattr(kernel, "_joined", lambda b, a, tol: seen.append(len(a.row)) or joined(b, a, tol))
    district = star(0, 0, [10.0] * 2000)
    got = clip([(district, [square(9.9, -0.01, 11, 0.01)])])[0]
    assert 0 < max(seen) < 20
    assert got["area_deg"] == pytest.approx(0.1 * 0.02, rel=1e-3)
