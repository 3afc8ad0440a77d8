"""Links and components of vectors against every pair."""

import numpy as np
import pytest

from duewise.llm import vectordup


def plain(rows, cosine=0.98):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: [] for i in range(len(rows))}
    for i in ok:
        for j in ok:
            a, b = np.asarray(rows[i][1], float), np.asarray(rows[j][1], float)
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                near[i].append(j)
    out = []
    for i, (key, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((key, len(near[i]), least, key is not None and key == least))
    return sorted(out, key=str)


def got(spark, rows, kind="float", **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, node int, cell string")
    return sorted((tuple(r) for r in vectordup.near_vectors(df, **more).collect()), key=str)


def clouds(seed, groups, most, width=24):
    draw = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        middle = draw.standard_normal(width)
        for _ in range(int(draw.integers(1, most))):
            spread = draw.choice([0.0, 0.05, 0.12, 0.16, 0.2, 0.6])
            rows.append((len(rows) * 3, [float(np.float32(x)) for x in middle + spread * draw.standard_normal(width)], g % 2 if g % 7 else None))
    return rows


@pytest.mark.parametrize("rows_at_once", [1024, 40, 10])
def test_every_pair(spark, rows_at_once):
    rows = clouds(3, 40, 14)
    want = plain(rows)
    assert any(r[1] for r in want) and got(spark, rows, rows_at_once=rows_at_once) == want


def test_one_hot_group_over_several_tiles(spark):
    draw = np.random.default_rng(9)
    middle = draw.standard_normal(32)
    rows = [(i, [float(np.float32(x)) for x in middle + 0.13 * draw.standard_normal(32)], 1) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(200)]
    assert got(spark, rows, rows_at_once=64) == plain(rows)


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine just above 0.98, in random directions, among rows that need several projections a cell: none is lost."""
    draw = np.random.default_rng(4)
    x = draw.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = draw.standard_normal((3000, 32))
    y -= (y * x).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    both = np.concatenate([x, 0.980001 * x + np.sqrt(1 - 0.980001**2) * y])
    out = got(spark, [(i, v.tolist(), 0) for i, v in enumerate(both)], kind="double", rows_at_once=128)
    assert {(r[0], r[1]) for r in out} == {(i, 1) for i in range(6000)} and all(r[2] == r[0] % 3000 for r in out)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [inf, 1.0], 1), (4, [nan, 1.0], 1), (5, [0.0, 0.0], 1), (6, [], 1),
        (7, [2.0, 4.0], 1), (8, [1.0, 2.0], 2), (9, [1.0, 2.0], None), (None, [1.0, 2.01], 1), (None, None, None), (10, [1.0, 2.0, 0.0], 1), (11, [-1.0, -2.0], 1),
    ]
    assert got(spark, rows) == plain(rows) and got(spark, []) == []


def test_windows_count_collisions():
    draw = np.random.default_rng(2)
    a, b = draw.standard_normal((50, 16)), draw.standard_normal((70, 16))
    assert (vectordup.window_counts(a, b, 0.3) == (np.abs(a[:, None] - b[None]) <= 0.3).sum(axis=2)).all()
    assert vectordup.least_count() >= 5 and vectordup.tables(0) == 1


def test_dealing_reaches_its_recall():
    """Over 20,000 pairs at the threshold, the share that meets in one slice is the formula's."""
    draw = np.random.default_rng(6)
    x = draw.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = draw.standard_normal((20_000, 64))
    y -= (y * x).sum(axis=1)[:, None] * x
    near = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1)[:, None]
    reach = vectordup.radius(0.98)
    same = (vectordup.slices(x, 40, reach) == vectordup.slices(near, 40, reach)).mean()
    assert abs(same - vectordup.same_slice()) < 0.01
