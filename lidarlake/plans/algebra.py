"""Queries that end in small dense linear algebra; SQL has no eigenvectors, so these are rows only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lidarlake.operators import linear as L
from lidarlake.operators.joins import with_voxel
from lidarlake.plans.mapping import _H, moments, normal_equations
from lidarlake.sources.adapters import points

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def plane_fit(spark, sf_dir):
    """Planes of voxels of 3, of at least five points."""
    return L.fit_planes(moments(with_voxel(points(spark, sf_dir), 3.0), ["vx", "vy", "vz"]).where("n >= 5"), ["vx", "vy", "vz"], 1.0)


@query
def octree_plane_fit(spark, sf_dir):
    return L.octree_planes(points(spark, sf_dir), 4.0, 2, 4, 0.3).select("vx", "vy", "vz", "path", "n", "nx", "ny", "nz", "quality")


@query
def kabsch_align(spark, sf_dir):
    """Each scan against itself turned by 0.04 and moved: the motion comes back."""
    c, s = math.cos(0.04), math.sin(0.04)
    p = points(spark, sf_dir)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    pairs = p.select("scan", x.alias("ax"), y.alias("ay"), z.alias("az"), (c * x - s * y + 0.18).alias("bx"), (s * x + c * y - 0.06).alias("by"), (z + 0.04).alias("bz"))
    return L.align(pairs, ["scan"])


@query
def degeneracy_6dof(spark, sf_dir):
    """How observable each scan's pose is: 21 sums, then one 6 x 6 eigenproblem a row."""
    p = points(spark, sf_dir)
    g = normal_equations(p, ["scan"], [F.expr(e) for e in _H], 1 / (1 + F.col("z") * F.col("z")), F.col("x") * 0.1)

    def solve(batches):
        for pdf in batches:
            m = L.symmetric(pdf[[f"a{i}{j}" for i in range(6) for j in range(i, 6)]].to_numpy(float), 6)
            rows = [(int(s), *((float(o["factors"].min()), float(o["factors"].mean()), float(o["condition"])) if (o := L.observability(x, np.eye(6) * 0.01)) else (None, None, None))) for s, x in zip(pdf["scan"], m)]
            yield pd.DataFrame(rows, columns=["scan", "factor", "mean_factor", "condition"])

    return g.mapInPandas(solve, "scan long, factor double, mean_factor double, condition double")
