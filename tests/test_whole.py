"""Queries that must take every row: their SQL, without its row caps, on the same tables."""

import duckdb
import pytest

from lidarlake import registry

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier embeddings events".split()


def rows(result, columns):
    return sorted(tuple(f"{v + 0.0:.6g}" if isinstance(v, float) else str(v) for v in map(r.__getitem__, columns)) for r in result)


def whole(spark, name, *cuts):
    """The query's rows and those of its SQL without ``cuts``."""
    sql = registry.oracle_sql()[name]
    for cut in cuts:
        sql = sql.replace(cut, "")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(sql)
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    return rows(df.collect(), columns), rows([dict(zip(want.columns, r)) for r in want.fetchall()], columns)


@pytest.mark.parametrize("block", [1000, 20])
def test_all_observations_are_paired(spark, monkeypatch, block):
    from lidarlake.plans import mapping

    monkeypatch.setattr(mapping, "PATCH_BLOCK", block)
    got, want = whole(spark, "patch_ncc_pairs", " WHERE k <= 8")
    assert got == want and len(got) > 5000


def test_best_reference_among_all_observations(spark):
    got, want = whole(spark, "patch_ssd_best_ref", " WHERE k <= 8")
    assert got == want and got


def test_every_point_has_its_ray(spark):
    got, want = whole(spark, "raycast_first_hit", " WHERE idx % 5 = 0")
    assert got == want and any(int(r[0]) % 5 for r in got)


def rays(spark, folder, embeddings):
    """The query's rows on ``embeddings``, those of the SQL without its cap, and those of the SQL as it is."""
    spark.createDataFrame([(k, e, 0) for k, e in embeddings], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet/*.parquet')")
    sql = registry.oracle_sql()["raycast_first_hit"]
    take = lambda s: rows([dict(zip(("idx", "step"), r)) for r in con.sql(s).fetchall()], ["idx", "step"])
    return rows(registry.queries()["raycast_first_hit"](spark, str(folder)).collect(), ["idx", "step"]), take(sql.replace(" WHERE idx % 5 = 0", "")), take(sql)


#: A point in the middle of every other voxel around the origin, young and even: occupied.
CHEQUERS = [(1000 + 2 * k, [(2 * v + 1) / 20 for v in (k // 36 - 3, k // 6 % 6 - 3, k % 6 - 3)] + [1.0, 0.0]) for k in range(216) if (k // 36 + k // 6 + k) % 2]


def test_samples_on_the_faces_of_voxels(spark, tmp_path):
    """Rays of directions 0.6, 0.8 and the like, far outside."""
    ways = [(a * x, b * y, c * z) for x, y, z in ((3, 4, 0), (4, 0, 3), (0, 4, 3), (12, 9, 8), (8, 9, 12), (2, 1, 2)) for a in (1, -1) for b in (1, -1) for c in (1, -1)]
    got, want, capped = rays(spark, tmp_path, [(k, [float(v) for v in w] + [1.0, 0.0]) for k, w in enumerate(ways)] + CHEQUERS)
    assert got == want and [r for r in got if int(r[0]) % 5 == 0] == capped and capped


def test_rays_of_short_embeddings(spark, tmp_path):
    """A place beyond the end is null: without x, y and z there is no ray, without a time no evidence."""
    short = [[], [0.1], [0.1] * 2, [0.1] * 3, [0.1] * 4, [0.1] * 5, [None] * 5, None, [0.1, None, 0.1, 1.0, 0.0]]
    got, want, capped = rays(spark, tmp_path, list(enumerate(short)) + [(k + 50, e) for k, e in enumerate(short)] + CHEQUERS)
    assert got == want and [r for r in got if int(r[0]) % 5 == 0] == capped and {"3", "4", "5"} < {r[0] for r in got}


def test_points_that_are_nowhere(spark, tmp_path):
    """The SQL stops at places that are not a number or infinite; the query gives what the SQL gives without such points."""
    nan, inf = float("nan"), float("inf")
    odd = [(10 * k + v, e + [1.0, 0.0]) for k, e in enumerate([[nan, 0.05, 0.05], [0.05, nan, -0.05], [nan] * 3, [inf, 0.05, 0.05], [-inf, inf, nan], [0.05, -inf, 0.05]]) for v in (0, 1)]
    plain = [(101, [0.05] * 3 + [1.0, 0.0]), (105, [-0.05] * 3 + [1.0, 0.0]), (107, [0.05, None, 0.05, 1.0, 0.0])]
    far = [(200, [0.25, 0.05, 0.05, 1.0, 0.0])]  # the one occupied voxel; none around the origin
    for name, some in (("far", plain + far), ("near", plain + far + CHEQUERS)):
        _, want, _ = rays(spark, tmp_path / name, some)
        spark.createDataFrame([(k, e, 0) for k, e in some + odd], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{name}_odd/embeddings.parquet")
        assert rows(registry.queries()["raycast_first_hit"](spark, f"{tmp_path}/{name}_odd").collect(), ["idx", "step"]) == want and want


def test_key_sets_of_whole_tables(spark):
    got, want = whole(spark, "keyset_diff", " WHERE c_custkey < 30", " WHERE s_suppkey < 15")
    assert got == want and got


def test_null_keys_are_in_neither_set(spark, tmp_path):
    """NOT IN: with a null among the others nothing is left; a null key is left only where there are no others."""
    write = lambda name, schema, keys: spark.createDataFrame([(k, x) for k, x in enumerate(keys, 1)], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for k, (c, s) in enumerate([((1, 2, None, 2), (2, 3)), ((1, 2), (2, None, 3)), ((1, None), ()), ((), (4, None))]):
        write(f"{k}/customer", "c_custkey long, c_nationkey int", c)
        write(f"{k}/supplier", "s_suppkey long, s_nationkey int", s)
        got = rows(registry.queries()["keyset_diff"](spark, f"{tmp_path}/{k}").collect(), ["key", "side"])
        con = duckdb.connect()
        for t in ("customer", "supplier"):
            con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{k}/{t}.parquet/*.parquet')")
        sql = registry.oracle_sql()["keyset_diff"].replace(" WHERE c_custkey < 30", "").replace(" WHERE s_suppkey < 15", "")
        assert got == rows([dict(zip(("key", "side"), r)) for r in con.sql(sql).fetchall()], ["key", "side"])


def odd_patches(spark, tmp_path):
    """A folder with patches that are null, empty, short, long, without values or not a number, and some twice."""
    nan = float("nan")
    odd = {1: None, 2: [], 3: [0.5] * 10, 4: [None] * 64, 5: [None, 0.25] * 32, 6: [0.25, None] * 32, 7: [nan] + [0.5] * 63, 8: [0.125 * (k % 5) for k in range(70)], 9: [None] * 60 + [0.5, 1.0, 0.25, 0.0]}
    plain = [[((7 * v + 3 * k) % 17) / 16 for k in range(64)] for v in range(30)]
    patches = [(v, odd.get(v, plain[v]) if label else plain[v], label) for label in (None, 0, 1) for v in range(30)]
    patches += [(5, plain[3], 1), (6, plain[6], 1), (40, None, 2), (41, [0.5] * 64, 2), (50, [0.5] * 64, 3), (None, [0.5] * 64, 1)]
    spark.createDataFrame(patches, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return tmp_path


def odd(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet/*.parquet')")
    want = con.sql(registry.oracle_sql()[name].replace(" WHERE k <= 8", ""))
    columns = sorted(want.columns)
    return rows(registry.queries()[name](spark, str(folder)).collect(), columns), rows([dict(zip(want.columns, r)) for r in want.fetchall()], columns)


@pytest.mark.parametrize("block", [1000, 7])
def test_pairs_of_odd_patches(spark, monkeypatch, tmp_path, block):
    from lidarlake.plans import mapping

    monkeypatch.setattr(mapping, "PATCH_BLOCK", block)
    got, want = odd(spark, odd_patches(spark, tmp_path), "patch_ncc_pairs")
    assert got == want and any(r[0] == "None" for r in got)


@pytest.mark.parametrize("block", [1000, 7])
def test_best_reference_of_odd_patches(spark, monkeypatch, tmp_path, block):
    from lidarlake.plans import mapping

    monkeypatch.setattr(mapping, "PATCH_BLOCK", block)
    got, want = odd(spark, odd_patches(spark, tmp_path), "patch_ssd_best_ref")
    assert got == want and len(got) == 3
    folder = tmp_path / "finite"  # without the patch that is not a number, which decides point 0 and 1
    spark.read.parquet(f"{tmp_path}/embeddings.parquet").where("vec_id <> 7 or vec_id is null").write.parquet(f"{folder}/embeddings.parquet")
    got, want = odd(spark, folder, "patch_ssd_best_ref")
    assert got == want and len(got) == 3
