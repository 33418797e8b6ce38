"""Stencils by tiles: the side of the tiles changes nothing, and plain loops give the same."""

import math

import numpy as np
import pytest

from pairbayes.operators import pixels, tiles


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(4)
    rows = []
    for image, (h, w) in {1: (9, 13), 2: (1, 6), 3: (20, 7)}.items():
        for y in range(h):
            for x in range(w - (y % 3 if image == 1 else 0)):  # ragged rows
                if rng.random() > 0.04:
                    v = None if rng.random() < 0.03 else float(np.round(rng.random(), 2) if rng.random() > 0.02 else 9.0)
                    rows.append((image, y, x, v))
    rows += [(4, 5, 5, 0.5), (5, 0, 0, None)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v double").cache(), rows


def close(a, b):
    return a == b or (a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))))


@pytest.mark.parametrize("f", [
    pixels.laplacian_stats, pixels.sobel_sharpness, pixels.cosmic_rays, lambda p, side: pixels.glcm(p, levels=8, side=side),
    lambda p, side: pixels.glcm(p, distance=2, levels=8, side=side), lambda p, side: pixels.box_mean(p, 1, side=side),
])
def test_the_side_of_the_tiles_changes_nothing(images, f):
    df = images[0].where("v < 2 OR v IS NULL")
    order = lambda rows: sorted(rows, key=lambda r: [str(x) for x in r[:3]] if "y" in r.__fields__ else [str(r[0])])
    whole = order(f(df, side=512).collect())
    assert whole
    for side in (3, 5):
        cut = order(f(df, side=side).collect())
        assert len(cut) == len(whole)
        assert all(close(u, v) for a, b in zip(cut, whole) for u, v in zip(a, b))


def test_plain_loops(images):
    df, rows = images
    value = {(i, y, x): v for i, y, x, v in rows if v is not None}
    pick = lambda i, y, x, dy, dx: value.get((i, y + dy, x + dx))

    def row(i, y, x, side):  # the pixel itself where the row has no neighbour
        return value.get((i, y, x + side), value[i, y, x])

    def at(i, y, x, dy, dx):
        return row(i, y + dy, x, dx) if (i, y + dy, x) in value else row(i, y, x, dx)

    sob, med, box = {}, {}, {}
    for i, y, x in value:
        n = {(a, b): at(i, y, x, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)}
        gx = sum(w * (n[a, 1] - n[a, -1]) for a, w in ((-1, 1), (0, 2), (1, 1)))
        gy = sum(w * (n[1, b] - n[-1, b]) for b, w in ((-1, 1), (0, 2), (1, 1)))
        sob.setdefault(i, []).append(math.hypot(gx, gy))
        med.setdefault(i, []).append((value[i, y, x], sorted(n.values())[4]))
        around = [pick(i, y, x, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        if None not in around:
            box[i, y, x] = sum(around) / 9
    got = {r.image_id: (r.sharpness, r.n_pixels) for r in pixels.sobel_sharpness(df, side=4).collect()}
    for i, g in sob.items():
        assert got[i] == (pytest.approx(np.mean(g)), sum(r[0] == i for r in rows))
    assert got[5] == (None, 1)
    assert {(r.image_id, r.y, r.x): pytest.approx(r.box_mean) for r in pixels.box_mean(df, 1, side=4).collect()} == box
    rays = {r.image_id: (r.n_replaced, r.clean_mean) for r in pixels.cosmic_rays(df, side=4).collect()}
    for i, pairs in med.items():
        v, m = np.array(pairs).T
        d = v - m
        hit = np.abs(d) > 5 * 1.4826 * np.median(np.abs(d - np.median(d)))
        assert rays[i] == (hit.sum(), pytest.approx(np.where(hit, m, v).mean()))


def test_a_tile_is_wider_than_its_halo(images):
    with pytest.raises(ValueError):
        tiles.box_means(images[0], "v", 5, side=3)


@pytest.mark.parametrize("side,block", [(5, 2), (64, 4)])
def test_a_tile_sends_a_row_for_each_angle(spark, monkeypatch, side, block):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 256, size=(23, 31))
    rows = [(1, y, x, float(v[y, x]) / 255.0) for y in range(23) for x in range(31)] + [(2, 0, x, 0.2) for x in range(4)] + [(3, 0, 0, 0.5)]
    sent, real = [], tiles.by_tile

    def seen(*args):
        sent.append(real(*args))
        return sent[-1]

    monkeypatch.setattr(tiles, "by_tile", seen)
    monkeypatch.setattr(tiles, "BLOCK", block, raising=False)
    got = {r.image_id: r for r in pixels.glcm(spark.createDataFrame(rows, "image_id long, y int, x int, v double"), side=side).collect()}
    n_tiles = math.ceil(23 / side) * math.ceil(31 / side) + 2
    assert sent[0].count() <= 4 * n_tiles
    assert set(got) == {1, 2} and (got[2].contrast, got[2].energy, got[2].correlation) == (0, 1, 1)
    level, want = np.floor(np.array([r[3] for r in rows[: 23 * 31]]) * 255.0).astype(int).reshape(23, 31), []
    for dy, dx in tiles.ANGLES.values():
        m = np.zeros((256, 256))
        for y in range(23):
            for x in range(31):
                if 0 <= y + dy < 23 and 0 <= x + dx < 31:
                    m[level[y, x], level[y + dy, x + dx]] += 1
                    m[level[y + dy, x + dx], level[y, x]] += 1
        m /= m.sum()
        i, j = np.indices(m.shape)
        ci, cj = i - (i * m).sum(), j - (j * m).sum()
        want.append([(m * (i - j) ** 2).sum(), (m * abs(i - j)).sum(), (m / (1 + (i - j) ** 2)).sum(), math.sqrt((m * m).sum()), (m * ci * cj).sum() / math.sqrt((m * ci * ci).sum() * (m * cj * cj).sum())])
    assert list(got[1])[1:] == pytest.approx(np.mean(want, axis=0).tolist(), rel=1e-9)
