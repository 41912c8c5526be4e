"""Closed-form planes against numpy, goals that are held, contracts on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarlake.functions.eigen import VALUES, VECTOR
from lidarlake.operators import contracts as K
from lidarlake.plans.catalog import run_steps
from lidarlake.plans.estimator import right_jacobian
from lidarlake.streaming.machines import commit_goal


def test_closed_form_eigenvalues(spark):
    r = np.random.default_rng(3)
    ms = [(lambda a: a @ a.T)(r.normal(size=(3, 5)) * s) for s in (1, 1, 10, 0.01) for _ in range(10)] + [np.diag([1.0, 2.0, 3.0]), np.eye(3), np.zeros((3, 3)), np.diag([0.0, 0.0, 5.0])]
    rows = [(k, *map(float, (m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2]))) for k, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "k long, sxx double, sxy double, sxz double, syy double, syz double, szz double")
    for x in run_steps(df, [*VALUES, *VECTOR]).collect():
        m = ms[x.k]
        assert [x.l0, x.l1, x.l2] == pytest.approx(np.linalg.eigvalsh(m), rel=1e-6, abs=1e-9 * max(1, np.trace(m)))
        n = np.array([x.nx, x.ny, x.nz])
        assert np.linalg.norm(n) == pytest.approx(1) and x.nz >= 0
        if x.l1 - x.l0 <= 1e-9 * max(1, np.trace(m)):  # no direction of its own
            continue
        assert np.abs(m @ n - x.l0 * n).max() <= 1e-5 * max(1, np.trace(m))


def test_right_jacobian_is_a_derivative(spark):
    def exp(v):
        t = np.linalg.norm(v)
        k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
        return np.eye(3) + (np.sin(t) / t * k + (1 - np.cos(t)) / t**2 * k @ k if t > 1e-12 else k)

    v = np.array([0.4, -0.7, 0.2])
    row = spark.createDataFrame([tuple(map(float, v))], "x double, y double, z double").select(*[e.alias(f"j{k}") for k, e in enumerate(right_jacobian(F.col("x"), F.col("y"), F.col("z")))]).first()
    j = np.array(row).reshape(3, 3)
    for k in range(3):
        d = np.zeros(3)
        d[k] = 1e-6
        change = exp(v).T @ exp(v + d)
        assert [change[2, 1], change[0, 2], change[1, 0]] == pytest.approx(j[:, k] * 1e-6, abs=1e-10)


def test_goals_are_held():
    state, _ = commit_goal(None, (1, 0.0, "a", 0.5, 10.0))
    assert commit_goal(state, (2, 1.0, "b", 0.9, 90.0))[0] == state  # the hold is not over
    assert commit_goal(state, (3, 3.0, "b", 0.6, 90.0))[0] == state  # not much better
    assert commit_goal(state, (4, 3.0, "b", 0.9, 20.0))[0] == state  # in the same direction
    assert commit_goal(state, (5, 3.0, "b", 0.9, 355.0))[0] == state  # 15 degrees, across north
    assert commit_goal(state, (6, 3.0, "b", 0.9, 350.0))[0] == ("b", 0.9, 350.0, 3.0)
    assert commit_goal(state, (7, 7.0, "b", 0.9, 10.0))[0][0] == "b" and commit_goal(state, (8, 7.0, "b", 0.6, 90.0))[0] == state


def test_contracts(spark):
    runs = spark.createDataFrame([("r1", "full"), ("r2", "coupled_6x6"), ("r3", "all_off")], "run string, mode string")
    actual = spark.createDataFrame([("r1", "degeneracy_aware_en", "true"), ("r1", "coupled_degeneracy_en", "1"), ("r2", "degeneracy_aware_en", "true"), ("r2", "coupled_degeneracy_en", "false"), ("r3", "degeneracy_aware_en", "false"), ("r3", "coupled_degeneracy_en", "false")], "run string, name string, value string")
    bad = K.switch_violations(runs, actual, ("degeneracy_aware_en", "coupled_degeneracy_en"))
    assert sorted(map(tuple, bad.collect())) == [("r1", "type", "coupled_degeneracy_en"), ("r2", "value", "coupled_degeneracy_en")]
    assert {r.run: r.exit_code for r in K.verdicts(runs, bad).collect()} == {"r1": 1, "r2": 1, "r3": 0}
    assert K.reference_run(runs.select("mode")).first().reference == "all_off" and K.reference_run(runs.limit(0).select("mode")).first().reference is None
    flat = spark.createDataFrame([("a", "x", "1"), ("a", "y", None), ("a", "run_id", "7"), ("b", "x", "2"), ("b", "y", None), ("b", "z", "1"), ("c", "x", "1"), ("c", "adaptive/s", "1")], "run string, path string, value string")
    got = K.tree_differences(K.stable_parameters(flat, ("s",)), "a").collect()
    assert sorted(map(tuple, got)) == [("b", "extra", "z"), ("b", "value", "x"), ("c", "missing", "y")]
    good = "0123456789abcdef" * 4
    lines = spark.createDataFrame([("a", 1, f"m  {good}"), ("a", 2, f"n {good}"), ("b", 1, "m XYZ"), ("b", 2, "one"), ("b", 3, f"m {good}"), ("b", 4, f"q\t{good} ")], "run string, line_no int, line string")
    assert sorted(map(tuple, K.manifest_violations(lines, ("m", "n")).collect())) == [("b", "digest", "m"), ("b", "duplicate", "m"), ("b", "extra", "q"), ("b", "fields", "2"), ("b", "missing", "n")]
