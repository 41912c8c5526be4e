import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarlake.functions import scalar as S
from lidarlake.functions import text as X
from lidarlake.operators import linear as L
from lidarlake.operators.fold import ordered_fold
from lidarlake.operators.joins import asof_join
from lidarlake.sources import files, scans
from lidarlake.streaming import machines as M


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_angles_and_rotations(spark):
    for a in (0.0, math.pi, -math.pi, 4.0, -4.0, 100.0):
        (w,) = one(spark, S.wrap_angle(F.lit(a)))
        assert -math.pi <= w <= math.pi and math.isclose(math.cos(w), math.cos(a), abs_tol=1e-9) and math.isclose(math.sin(w), math.sin(a), abs_tol=1e-9)
    v = (0.3, -0.2, 0.5)
    r = one(spark, *S.so3_exp(*map(F.lit, v)))
    assert np.allclose(np.array(r).reshape(3, 3) @ np.array(r).reshape(3, 3).T, np.eye(3))
    assert np.allclose(one(spark, *S.so3_log([F.lit(x) for x in r])), v)
    tiny = one(spark, *S.so3_exp(F.lit(1e-9), F.lit(0.0), F.lit(0.0)))
    assert tiny[7] == pytest.approx(1e-9)  # never dropped
    q = one(spark, *S.quaternion_of_yaw(F.lit(1.1)))
    assert one(spark, S.yaw_of(*map(F.lit, q)))[0] == pytest.approx(1.1)
    assert one(spark, *S.euler_of(S.rotation_of(*map(F.lit, q))))[2] == pytest.approx(1.1)


def test_beam_covariance(spark):
    c = np.array(one(spark, *S.beam_covariance([F.lit(3.0), F.lit(4.0), F.lit(0.0)], 0.02, 0.05))).reshape(3, 3)
    d = np.array([0.6, 0.8, 0.0])
    assert d @ c @ d == pytest.approx(0.02**2)
    assert c[2, 2] == pytest.approx((5 * math.sin(math.radians(0.05))) ** 2)


def test_weights(spark):
    assert one(spark, S.sigmoid_health(F.lit(0.0), 12.0, 0.1), S.sigmoid_health(F.lit(1.0), 12.0, 0.1)) == (0.0, pytest.approx(1.0))
    assert one(spark, S.return_weight(F.lit(float("nan")), F.lit(float("inf")), F.lit(0.5), 40.0, 60.0, 4.0))[0] == pytest.approx(0.15)
    assert one(spark, S.robust_weight(F.lit(2.0), "huber", 1.0), S.robust_weight(F.lit(2.0), "cauchy", 1.0)) == (0.5, 0.2)


def test_key_values(spark):
    m = one(spark, X.parse_kv(F.lit("a=1; b = x=y ;junk;=3;a= 2")))[0]
    assert m == {"a": "2", "b": "x=y"}
    assert one(spark, X.to_double(F.lit("1.5x"), 0.0), X.to_double(F.lit("none"), -1.0)) == (1.5, -1.0)
    assert one(spark, X.csv_cell(F.lit('a"b,c\n')), X.status_value(F.lit("a;b\nc")), X.frame_id(F.lit("/map"))) == ('"a""b,c "', "a,b,c", "map")


def test_planes():
    """A plate is a plane; points on a line or in one place are none."""
    r = np.random.default_rng(1)
    plate = np.c_[r.uniform(-1, 1, (200, 2)), r.normal(0, 0.01, 200)]
    line = np.c_[np.linspace(0, 1, 50), np.zeros(50), np.zeros(50)]
    cov = np.stack([np.cov(p.T, bias=True) for p in (plate, line, np.ones((20, 3)))])
    p = L.plane_of(cov, 0.01)
    assert p["is_plane"].tolist() == [True, False, False] and p["quality"][0] > 0.9 and abs(p["normal"][0][2]) > 0.99


def test_registration_recovers_a_known_motion():
    u = np.arange(240)
    cloud = np.c_[0.04 * u + 0.35 * np.sin(0.31 * u), 0.7 * np.sin(0.17 * u) + 0.01 * (u % 11), 0.5 * np.cos(0.23 * u) + 0.015 * (u % 7)]
    axis = np.array([0.3, 0.7, 0.2]) / np.linalg.norm([0.3, 0.7, 0.2])
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    rot = np.eye(3) + math.sin(0.04) * k + (1 - math.cos(0.04)) * k @ k
    got = L.icp(cloud, cloud @ rot.T + [0.18, -0.06, 0.04])
    assert np.abs(got["rotation"] - rot).max() < 1e-3 and np.abs(got["translation"] - [0.18, -0.06, 0.04]).max() < 1e-3
    assert L.icp(cloud, cloud + 50.0)["coverage"] == 0.0


def test_observability_and_inverse():
    assert L.invert_symmetric(np.diag([1.0, -5.0])) is None and np.allclose(L.invert_symmetric(np.diag([2.0, 4.0]))[1], np.diag([0.5, 0.25]))
    o = L.observability(np.diag([900.0, 900, 900, 900, 900, 0]), np.eye(6) * 0.01)
    assert o["factors"].min() == pytest.approx(0.05) and o["factors"].max() > 0.89
    rates = np.random.default_rng(2).normal(size=(100, 3))
    rot = L.kabsch(np.eye(3)[:, [1, 2, 0]])
    assert np.allclose(L.fit_rotation(np.c_[rates, rates @ rot.T]), rot)


def test_supervisor():
    run = lambda s, *events: [s := s.on(e) for e in events][-1]
    s = run(M.Supervisor(), "invalid", "invalid", "invalid", "reinit")
    assert s.state == M.RECOVERING and s.attempts == 1
    s = run(s, "valid", "valid", "valid")
    assert s.state == M.HEALTHY and s.successes == 1 and s.attempts == 0
    assert run(M.Supervisor(), "invalid", "valid") == M.Supervisor()
    assert run(M.Supervisor(), "numerical").state == M.RECOVERING
    end = run(M.Supervisor(), *["invalid"] * 300)
    assert end.state == M.UNRECOVERABLE and end.failures == 1 and run(end, "valid", "reinit") == end
    tried = run(M.Supervisor(), *["reinit"] * 9)
    assert tried.attempts == 6
    assert run(M.Supervisor(), *["invalid"] * 5, "constraint").degraded == 0


def test_quarantine_promotes_within_its_budget():
    q, waiting = M.Quarantine(), {}
    for frame in range(3):
        waiting, promoted = q.frame(waiting, frame, {(0, 0, 2): ((2.5, 0.01, 1.0), 100)}, 100)
    assert promoted == [((0, 0, 2), 5)] and waiting == {}
    waiting, _ = q.frame({}, 0, {(0, 0, 0): ((0.0, 0.0, 0.0), 10)}, 100)
    waiting, _ = q.frame(waiting, 1, {(0, 0, 0): ((0.49, 0.0, 0.0), 10)}, 100)
    assert waiting[0, 0, 0][0] == 1  # the centroid jumped: support starts again
    assert q.frame(waiting, 99, {}, 100)[0] == {}


def test_admission_and_sampler():
    s, out = None, []
    for row in ((1, 0.0), (2, 0.1), (3, 0.05), (4, 0.2), (5, 2.0), (6, 1.0)):
        s, o = M.admit(s, row)
        out.append(o[2])
    assert out == ["ready", "ready", "late", "ready", "gap", "reset"]
    s = None
    for k in range(2):
        s, o = M.adapt_sampler(s, (k, 0.9, 0.9, 0.9, 0.1))
    assert o[1] == 1


def test_fold_streams_long_keys(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))

    def count(state, row):
        return (state or 0) + 1, (row[0], (state or 0) + 1)

    got = ordered_fold(df, ["k"], ["t"], ["t"], None, count, "t long, n long")
    assert got.agg(F.max("n"), F.count("*"), F.sum((F.col("n") == F.floor(F.col("t") / 2) + 1).cast("int"))).first() == (15_000, 30_000, 30_000)


def test_asof_ties(spark):
    left = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 1.0, "b"), (1, 1.5, "c")], "k int, t double, v string")
    get = lambda **o: [r.v for r in asof_join(left, right, ["k"], "t", ["v"], **o).orderBy("k", "t").collect()]
    assert get() == ["b", "c", None] and get(strict=True) == [None, "c", None] and get(forward=True) == ["b", None, None]


def test_scans(spark):
    r = random.Random(1)
    rows = [(0, i, 50, r.uniform(1, 5), 0.0, 0.0, 10, 0x10, i % 4, int(1e5 * i) if i != 20 else 10**9) for i in range(60)]
    raw = spark.createDataFrame(rows, "scan_id int, idx int, point_num int, x double, y double, z double, reflectivity int, tag int, line int, offset_time long")
    got = scans.livox(raw, stride=2).orderBy("idx").collect()
    assert len(got) == 25 and max(p.offset_ms for p in scans.livox(raw).collect()) < 5
    ring = spark.createDataFrame([(0, i, 5 * math.cos(-i * 0.1), 5 * math.sin(-i * 0.1), 0.0, float("nan"), 0.0, 0) for i in range(10)], "scan_id int, idx int, x double, y double, z double, intensity double, time double, ring int")
    got = scans.velodyne(ring).orderBy("idx").collect()
    assert [p.idx for p in got] == list(range(1, 10)) and got[0].offset_ms == pytest.approx(math.degrees(0.1) / 3.61) and got[0].intensity == 0.0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time_s,gravity_x,v\n1,2,3\n4,5\n6,7,8\n")
    assert [r[0] for r in files.ragged_csv(spark, str(tmp_path / "a.csv")).select(files.cell("gravity")).collect()] == [2.0, 7.0]
    (tmp_path / "p.txt").write_text("1 2 3 4 0 0 0 1\n1 2 3\nx 2 3 4 0 0 0 1\n")
    assert files.poses(spark, str(tmp_path / "p.txt")).count() == 1
    (tmp_path / "s.txt").write_text("# note\nmode=full\nstage=complete\nbad\n=x\nmode=other\nrate=-1\n")
    values, errors = files.key_values(spark, str(tmp_path / "s.txt"))
    assert {r.key: r.value for r in values.collect()} == {"mode": "other", "stage": "complete", "rate": "-1"}
    assert sorted((r.line_number, r.error) for r in errors.collect()) == [(4, "expected key=value"), (5, "empty key"), (6, "duplicate key mode")]
    wrong = {r.key: r.error for r in files.status_violations(values.select(F.lit("r").alias("run"), "key", "value")).collect()}
    assert "stage" not in wrong and wrong["rate"] == "not a positive finite number" and wrong["bag_sha256"] == "missing"
    assert files.non_finite({"a": {"b": float("nan"), "c": 1.0}}) == ["a/b"]


def test_stream_equals_fold(spark, tmp_path):
    df = spark.createDataFrame([(k % 3, k, "invalid" if k % 4 == 0 else "valid") for k in range(40)], "run long, row_id long, event string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    fields = ("state", "degraded", "streak", "attempts", "rollbacks", "successes", "failures")
    output = "row_id long, " + ", ".join(f"{f} long" for f in fields)
    out = M.run_stream(stream, "run", ["row_id", "event"], ["row_id"], M.supervise, output, ", ".join(f"{f} long" for f in fields))
    q = out.writeStream.format("memory").queryName("fsm").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = ordered_fold(df, ["run"], ["row_id"], ["row_id", "event"], None, M.supervise, output)
    key = lambda d: sorted(tuple(r) for r in d.select("run", "row_id", *fields).collect())
    assert key(spark.table("fsm")) == key(want)
