"""Exact neighbours by cells, symmetries from all rows, and information criteria that grow with the data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxion.functions.expressions import parse
from fluxion.operators import assess, gram, symmetry, uncertainty
from fluxion.operators.library import build_library, columns


def by_hand(x, ids, k):
    out = set()
    for i in ids:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:k]
        out |= {(i, j, p + 1, round(float(d[j]), 9)) for p, j in enumerate(order)}
    return out


@pytest.mark.parametrize(("dims", "block", "grid"), [(2, 40, False), (2, 10, True), (5, 64, False), (1, 7, True), (3, 4096, False)])
def test_neighbours_against_brute_force(spark, dims, block, grid):
    """Crowded places, ties and repeated points; cells far smaller than in production."""
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0, 0.05, (150, dims)), rng.normal(3, 1, (150, dims))])
    x = np.round(x * 4) / 4 if grid else x
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {(r["id"], r["other"], r["place"], round(r["distance"], 9)) for r in symmetry.nearest(points.where("id % 3 = 0"), points, 4, block).collect()}
    assert got == by_hand(x, range(0, 300, 3), 4)


def test_neighbours_of_few_points(spark):
    points = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "id long, x array<double>")
    got = {(r["id"], r["other"], r["place"]) for r in symmetry.nearest(points, points, 5).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 2, 1), (3, 1, 2)}
    assert symmetry.nearest(points.limit(0), points, 2).count() == 0 and symmetry.nearest(points, points.limit(0), 2).count() == 0


def fields_of(**rhs):
    return {v: parse(e, list(rhs)) for v, e in rhs.items()}


def test_brackets_of_a_table_are_those_of_its_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (5000, 2))
    f = fields_of(x="y + x*(1 - x**2 - y**2)", y="-x + y*(1 - x**2 - y**2)")
    df = spark.createDataFrame(x.tolist(), "x double, y double")
    for affine in (False, True):
        a, b = symmetry.bracket_sums(f, df, affine), symmetry.bracket_sums(f, x, affine)
        assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1]) and a[2] == b[2]


def test_generators_use_every_row(spark):
    """The first 5,000 rows see a rotation only where the field is symmetric; the rest breaks it."""
    rng = np.random.default_rng(1)
    f = fields_of(x="y + 0.5*z*x", y="-x", z="0")
    calm = spark.createDataFrame(np.column_stack([rng.normal(0, 1, (5000, 2)), np.zeros(5000)]).tolist(), "x double, y double, z double")
    wild = spark.createDataFrame(rng.normal(0, 3, (500, 3)).tolist(), "x double, y double, z double")
    rotations = lambda df: [g for g in symmetry.linear_generators(f, df) if "rotation in y-x" in g["templates"]]
    assert rotations(calm) and not rotations(calm.unionByName(wild))


def test_mixed_basis_of_a_rotation_and_a_scaling_is_named():
    rotation, scaling = symmetry.rotation_generator(0, 1, 2), np.eye(2)
    mixed = [rotation + 0.7 * scaling, rotation - 0.4 * scaling]
    assert symmetry.generators_in_span(mixed, ["x", "y"]) == ["rotation in y-x", "scaling of all"]
    assert symmetry.generators_in_span([rotation + 0.7 * scaling], ["x", "y"]) == []
    assert np.allclose(symmetry.principal_angles(mixed, [rotation, scaling]), 0, atol=1e-6)


def true_term(spark, n):
    """y' = 2 x + 0.05 x^2 + noise, rows in blocks of 9."""
    u = lambda s: (F.rand(s) + F.rand(s + 1) + F.rand(s + 2) - 1.5) * 2
    return spark.range(0, n, 1, 4).select(F.lit(0).alias("traj"), F.col("id").alias("step"), u(1).alias("y"), u(7).alias("e")).withColumn("y_t", 2 * F.col("y") + 0.05 * F.col("y") ** 2 + F.col("e") / 2)


def test_evidence_for_a_missing_term_grows_with_the_data(spark):
    library = build_library(["y"], 2)
    square = [*library][-1]
    found = {}
    for n in (900, 45_000, 450_000):
        rows = true_term(spark, n)
        blocks = gram.grams(rows, columns(library), {"y": F.col("y_t")}, gram.grouped("traj", F.floor(F.col("step") / 9)))
        _, _, missing = assess.term_statistics(blocks, ["y"], {"y": parse("2*y", ["y", "t"])}, library, assess.effective_samples(uncertainty.total(blocks).n, 9))
        found[n] = {m["term"]: m["dBIC_if_added"] for m in missing}
    assert square not in found[900] and found[45_000][square] < -20 and found[450_000][square] < 8 * found[45_000][square]


def test_models_are_told_apart_by_all_blocks(spark):
    z = {}
    for n in (9_000, 450_000):
        rows = true_term(spark, n)
        found = uncertainty.compare_models(rows, {"short": {"y": "2*y"}, "long": {"y": "2*y + 0.05*y**2"}}, F.floor(F.col("step") / 9), correlation=9)
        z[n] = found["models"]["short"]["z_vs_best"]
        bic = {m: v["bic"] for m, v in found["models"].items()}
        if n > 10_000:
            assert found["preferred"] == "long" and bic["long"] < bic["short"] - 100
    assert z[450_000] > 4 * z[9_000]
