"""Nearest entities, closest ranks and least squares against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import entities as E
from tessera.operators import least_squares, matching

FIELDS = "entity string, hec_rank double, " + ", ".join(f"{f} double" for f in E.FEATURES)
POINT = "point_id long, " + ", ".join(f"{f} double" for f in E.FEATURES)


def _entities(rng, n):
    """Clusters of unequal size, a point that many share, integer grids (ties) and missing scores."""
    rows = []
    for i in range(n):
        centre = 60 + 5 * (i % 4) ** 2
        v = [float(x) for x in (np.full(4, 55.0) if i % 5 == 0 else rng.normal(centre, 3, 4).round(0) if i % 5 < 4 else rng.uniform(40, 130, 4))]
        if i % 37 == 1:
            v[2] = None
        rows.append((f"e{i:05d}", float(i % 83), *v))
    return rows


def _nearest(entities, points, k):
    values = np.array([[np.nan if x is None else x for x in r[2:]] for r in entities], float)
    mean, std = np.nanmean(values, axis=0), np.nanstd(values, axis=0)
    std[std == 0] = 1
    z = (values - mean) / std
    out = {}
    for i, *p in points:
        if any(x is None for x in p):
            continue
        d = np.sqrt((((np.array(p) - mean) / std - z) ** 2).sum(axis=1))
        order = sorted((round(float(x), 7), entities[j][0]) for j, x in enumerate(d) if not np.isnan(x))
        out.setdefault(i, []).append([x for _, x in order[:k]])
    return out


@pytest.mark.parametrize(("n", "k"), [(2500, 5), (3, 5)])
def test_nearest_entities_equal_a_plain_loop(spark, n, k):
    rng = np.random.default_rng(3)
    entities = _entities(rng, n)
    points = [(i, *(float(x) for x in rng.uniform(40, 130, 4))) for i in range(40)]
    points += [(50, 55.0, 55.0, 55.0, 55.0), (51, 55.0, 55.0, 55.0, 55.0), (52, 1e6, 0.0, 0.0, 0.0), (53, None, 1.0, 1.0, 1.0), (54, 60.0, 61.0, 60.0, 61.0)]
    found = matching.nearest_entities(spark.createDataFrame(entities, FIELDS), spark.createDataFrame(points, POINT), k=k)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.point_id, r["rank"])):
        got.setdefault(r.point_id, []).append(r.entity)
    assert got == {i: v[0] for i, v in _nearest(entities, points, k).items()}
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()


def test_nearest_entities_of_nothing(spark):
    some = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, 1.0)], FIELDS)
    asked = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0)], POINT)
    assert matching.nearest_entities(some.where("false"), asked).count() == 0
    assert matching.nearest_entities(some, asked.where("false")).count() == 0
    assert matching.nearest_entities(some, asked).first()["distance"] == 0.0


@pytest.mark.parametrize("ranges", [256, 3])
def test_closest_ranks_equal_a_plain_loop(spark, monkeypatch, ranges):
    """Gaps, ranks that many share, values beyond both ends, and ranges with fewer than k ranks."""
    monkeypatch.setattr(matching, "RANGES", ranges)
    rng = np.random.default_rng(8)
    entities = [(f"e{i:04d}", float(r)) for i, r in enumerate([*rng.integers(0, 60, 300) / 2, *[500.0] * 40, *rng.integers(900, 2000, 200), 5000.0])]
    entities += [("none", None)]
    asked = [(i, float(v)) for i, v in enumerate([*rng.integers(-10, 2100, 80), 500, 499.75, 5000, 1e9, -1e9, 29.75, 14.5, 14.5])] + [(99, None)]
    rows = matching.closest_ranks(spark.createDataFrame(entities, "entity string, hec_rank double"),
                                  spark.createDataFrame(asked, "request_id long, predicted_rank double"), k=4).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.request_id, r.place)):
        got.setdefault(r.request_id, []).append((r.entity, r.hec_rank, r.rank_diff))
    held = [e for e in entities if e[1] is not None]
    assert got == {i: [(e, x, abs(x - v)) for _, e, x in sorted((abs(x - v), e, x) for e, x in held)[:4]] for i, v in asked if v is not None}


def test_least_squares_with_dependent_constant_and_shifted_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = 4 + x @ np.array([2.0, -1.0, 0.5]) + rng.normal(scale=0.2, size=400)
    rows = [(float(a) + 1e6, float(b), float(c), float(a + b) / 2, 7.0, float(t)) for (a, b, c), t in zip(x, y, strict=True)]
    rows += [(None, 1.0, 1.0, 1.0, 7.0, 1e9)]
    names = ["a", "b", "c", "half", "seven"]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"]))
    fitted = least_squares.coefficients(frame, names, "y").cache()
    row = fitted.first()
    assert row["weights"][3] == row["weights"][4] == 0.0
    design = np.column_stack([x, np.ones(400)])
    exact = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    found = [r[0] for r in frame.select(least_squares.predicted(frame, fitted, names)).collect()]
    assert found[-1] is None and np.allclose(found[:-1], exact, atol=1e-6)
    assert least_squares.coefficients(frame.where("false"), names, "y").first()["intercept"] is None


def test_csv_fields_with_quotes_line_ends_and_empties_come_back(spark, tmp_path):
    from tessera.sources import contracts, sinks

    rows = [(1, 'a "q" b, c'), (2, "line\nend\r\nx"), (3, ""), (4, None), (5, "  pad "), (6, 'back\\slash"'), (None, "é"), (8, '"'), (9, "NULL"), (10, "\n")]
    sinks.write_csv(spark.createDataFrame(rows, "id long, t string"), str(tmp_path / "t"))
    back = contracts.read_csv(spark, str(tmp_path / "t"), "t string, id long, extra int")
    assert sorted(((r.id, r.t) for r in back.collect()), key=str) == sorted(rows, key=str) and back.where("extra is not null").count() == 0


def test_csv_rows_that_break_the_schema_are_set_aside(spark, tmp_path):
    from tessera.sources import contracts

    (tmp_path / "r.csv").write_text('Rating ,review_text\n5,"great, ""really""\nyes"\nbad,x\n,y\n3,""\n4,  \n')
    good, bad = contracts.read_csv_rejects(spark, str(tmp_path), "review_text string, rating int", required=("review_text",))
    assert sorted(map(tuple, good.collect()), key=str) == [('great, "really"\nyes', 5), ("y", None)]
    assert sorted(r.reason for r in bad.collect()) == ["rating is no int", "review_text missing", "review_text missing"]
    assert all(r.file.endswith("r.csv") for r in bad.collect())


def test_only_whole_sentinels_mean_no_filter(spark):
    from tessera.operators import display

    df = spark.createDataFrame([("Allentown",), ("Reading",)], "store string")
    assert display.filter_equals(df, {"store": "Allentown"}).count() == 1
    assert display.filter_equals(df, {"store": "All Categories"}).count() == 2
