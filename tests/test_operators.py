"""Hand-made cases and invariants of the operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import geometry as g
from terravane.operators import assoc, filters, fusion, graph, images, masks, pointcloud, ranks, score, spatial, surface
from terravane.plans.all_queries import QUERIES
from terravane.plans.registry import Relations
from terravane.plans.scene import seen_in_patches
from terravane.sources import config, io

SF = "/root/testdata/sf0.001"


def cloud(spark, n, seed, scale=1.0):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.random() * scale, rng.random() * scale, rng.random() * scale) for i in range(n)], "id long, x double, y double, z double")


def test_project_undoes_backproject(spark):
    r = Relations(spark, SF)
    c = r("cameras")
    px = g.pixel_grid(spark, 32, 24).withColumn("depth", (F.col("pix") % 7 + 1).cast("double")).join(c, F.col("pix") % 7 + 1 == c["cam"])
    w = g.backproject(F.col("u"), F.col("v"), F.col("depth"))
    px = px.withColumns(dict(zip(("px", "py", "pz"), w, strict=True)))
    u, v, z = g.project(g.vector("px", "py", "pz"))
    worst = px.agg(F.max(F.abs(u - F.col("u")) + F.abs(v - F.col("v")) + F.abs(z - F.col("depth")))).first()[0]
    assert worst < 1e-9


def test_projection_at_depth_zero_is_null(spark):
    c = Relations(spark, SF)("cameras").filter("cam = 7")
    u, v, z = g.project(g.vector("tx", "ty", "tz"))
    row = c.select(u.alias("u"), v.alias("v"), z.alias("z")).first()
    assert row["u"] is None and row["v"] is None and row["z"] == 0


@pytest.mark.parametrize("k", [1, 3])
def test_knn_by_cells_equals_direct(spark, k):
    a, b = cloud(spark, 60, 1, 3.0), cloud(spark, 80, 2)
    direct = spatial.knn_join(a, b, k).orderBy("aid", "rank").collect()
    cells = spatial.knn_join(a, b, k, direct_pairs=0).orderBy("aid", "rank").collect()
    assert [(r["aid"], r["bid"]) for r in direct] == [(r["aid"], r["bid"]) for r in cells]


def test_knn_with_more_neighbours_than_points(spark):
    a, b = cloud(spark, 5, 1), cloud(spark, 3, 2)
    for direct in (0, 10**9):
        assert spatial.knn_join(a, b, 7, direct_pairs=direct).count() == 15


def test_radius_join_equals_all_pairs(spark):
    a = cloud(spark, 120, 3)
    rows = a.collect()
    want = sum((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 + (p["z"] - q["z"]) ** 2 <= 0.031 for p, q in itertools.product(rows, rows))
    assert spatial.radius_join(a, a, 0.031).count() == want


def test_weights_keep_a_constant_feature(spark):
    p = cloud(spark, 50, 4).withColumn("f", F.array(F.lit(2.5), F.lit(-1.0)))
    out = pointcloud.features_to_vertices(p, cloud(spark, 20, 5), 4, 10.0).collect()
    touched = [r["f"] for r in out if r["f"] != [0.0, 0.0]]
    assert touched and all(abs(f[0] - 2.5) < 1e-9 and abs(f[1] + 1) < 1e-9 for f in touched)


def test_features_without_close_points_are_zero(spark):
    p = cloud(spark, 5, 4).withColumn("x", F.col("x") + 100).withColumn("f", F.array(F.lit(1.0)))
    assert {tuple(r["f"]) for r in pointcloud.features_to_vertices(p, cloud(spark, 6, 5), 2, 0.1).collect()} == {(0.0,)}


def test_identical_points_give_weight_one(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    out = pointcloud.features_to_vertices(one.withColumn("f", F.array(F.lit(3.0))), one, 5, 0.1).first()
    assert out["f"] == [3.0]


def test_pairwise_is_at_most_one_over_m(spark):
    f = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(30)], "vid int, f array<double>")
    q = spark.createDataFrame([(0, "positive", [1.0, 0.0]), (1, "negative", [0.0, 1.0]), (2, "negative", [-1.0, 0.0])], "qid int, polarity string, emb array<double>")
    top = score.similarity(f, q, "pairwise").agg(F.max("similarity")).first()[0]
    assert 0.4 < top <= 0.5
    with pytest.raises(ValueError):
        score.similarity(f, q.filter("polarity = 'positive'"), "pairwise")
    with pytest.raises(ValueError):
        score.similarity(f, q, "cosine")


def test_decoder_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7, 3))
    hidden, head = (rng.normal(size=(3, 4)), rng.normal(size=4)), (rng.normal(size=(4, 2)), rng.normal(size=2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, f array<double>")
    got = np.array([r["out"] for r in score.mlp_decode(df, hidden, {"out": head}).orderBy("id").collect()])
    assert np.allclose(got, np.maximum(x @ hidden[0] + hidden[1], 0) @ head[0] + head[1])


@pytest.mark.parametrize("exact", [5_000_000, 20])
def test_pca_equals_numpy(spark, monkeypatch, exact):
    monkeypatch.setattr(pointcloud, "EXACT_ROWS", exact)
    df = Relations(spark, SF)("pts").select("id", "f")
    rows = df.orderBy("id").collect()
    x = np.array([r["f"] for r in rows])
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:3].T
    axes = axes * np.where(axes[np.abs(axes).argmax(0), range(3)] < 0, -1, 1)
    p = x @ axes
    lo, hi = np.quantile(p, 0.01, axis=0), np.quantile(p, 0.99, axis=0)
    want = np.clip((p - lo) / (hi - lo), 0, 1)
    got = {r["id"]: (r["red"], r["green"], r["blue"]) for r in score.pca_rgb(df).collect()}
    assert np.allclose([got[r["id"]] for r in rows], want, atol=1e-6)


def test_pca_is_in_range(spark):
    out = score.pca_rgb(Relations(spark, SF)("pts").select("id", "f"))
    lo, hi = out.agg(F.min(F.least("red", "green", "blue")), F.max(F.greatest("red", "green", "blue"))).first()
    assert lo == 0.0 and hi == 1.0


def test_overlay_pixels_are_unique_and_empty_is_empty(spark):
    px = Relations(spark, SF)("mask_px")
    out = masks.overlay(px)
    assert out.count() == out.select("view", "y", "x").distinct().count() > 0
    assert masks.overlay(px.limit(0)).count() == 0


def test_label_without_mask_is_an_error(spark):
    px = spark.createDataFrame([(0, 1, 0, 0)], "view int, mask_id int, y int, x int")
    with pytest.raises(Exception, match="no label"):
        masks.remap(px, spark.createDataFrame([(2, 0)], "mask_id int, label int")).collect()


def test_torus_is_closed_with_its_faces(spark):
    r = Relations(spark, SF)
    faces = r("torus_faces")
    missing = spark.createDataFrame([(k, *t) for k, t in enumerate([(0, 20, 21), (0, 21, 1), (1, 21, 22), (1, 22, 2), (2, 22, 23)])], "fid long, a long, b long, c long")
    whole = faces.unionByName(missing)
    edges = graph.mesh_edges(whole)
    assert 400 - edges.count() + whole.count() == 0 and edges.filter("n_faces <> 2").count() == 0
    assert graph.boundary_loops(whole).count() == 0


def test_filled_hole_closes_the_mesh(spark):
    r = Relations(spark, SF)
    faces, vertices = graph.fill_holes(r("torus_faces"), r("torus_vertices"), 9.0)
    assert graph.mesh_edges(faces).filter("n_faces <> 2").count() == 0 and vertices.count() == 401
    assert graph.fill_holes(r("torus_faces"), r("torus_vertices"), 1.0)[0].count() == 795


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.range(1).selectExpr("500L AS a", "500L AS b"))
    out = {r["node"]: r["root"] for r in graph.connected_components(edges).collect()}
    assert set(out) == {*range(201), 500} and out[200] == 0 and out[0] == 0 and out[500] == 500


def test_mean_of_neighbours_leaves_a_flat_grid_flat(spark):
    v = spark.createDataFrame([(i * 4 + j, float(i), float(j), 0.0) for i in range(4) for j in range(4)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(i * 4 + j, (i + 1) * 4 + j, i * 4 + j + 1) for i in range(3) for j in range(3)], "a long, b long, c long")
    assert graph.laplacian_smooth(f, v, 2).agg(F.max(F.abs("z"))).first()[0] == 0


def test_dilation_equals_a_plain_loop(spark):
    rng = random.Random(3)
    px = {(y, x): rng.choice([1.0, 5.0]) for y in range(8) for x in range(9) if rng.random() < 0.8}
    df = spark.createDataFrame([(0, y, x, d) for (y, x), d in px.items()], "view int, y int, x int, depth double")
    inv = {k: 1 / (d + 1e-6) for k, d in px.items()}
    lap = {(y, x): sum(inv.get(k, 0.0) for k in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1))) - 4 * i for (y, x), i in inv.items()}
    want = {k: any(lap.get((k[0] + i, k[1] + j), -9) > 0.3 for i in (-1, 0, 1) for j in (-1, 0, 1)) for k in px}
    got = {(r["y"], r["x"]): r["edge"] for r in images.depth_edges(df, 0.3, 1).collect()}
    assert got == want


def test_flat_depth_has_normals_along_the_axis(spark):
    c = Relations(spark, SF)("cameras").filter("cam = 1")
    px = g.pixel_grid(spark, 32, 24).select("y", "x").withColumns({"view": F.lit(1), "depth": F.lit(2.0)}).crossJoin(c)
    inner = images.depth_normals(px).filter("y BETWEEN 1 AND 22 AND x BETWEEN 1 AND 30")
    assert inner.filter("abs(nx) + abs(ny) > 1e-12 OR abs(abs(nz) - 1) > 1e-12").count() == 0
    assert images.depth_normals(px).filter("y = 0 AND nz <> 0").count() == 0


def test_resize_by_one_is_the_identity(spark):
    d = Relations(spark, SF)("depth_px").select("view", "y", "x", F.col("depth").alias("value"))
    same = images.bilinear(d, 24, 32, 24, 32).join(d.withColumnRenamed("value", "was"), ["view", "y", "x"])
    assert same.agg(F.max(F.abs(F.col("value") - F.col("was")))).first()[0] < 1e-12


def test_downsample_counts_and_outliers(spark):
    c = cloud(spark, 300, 6)
    low = c.agg(*[F.min(k).alias(k) for k in "xyz"]).first()
    want = c.select(*[F.floor((F.col(k) - low[k]) / 0.25).alias(k) for k in "xyz"]).distinct().count()
    assert pointcloud.voxel_downsample(c, 0.25).count() == want
    far = c.unionByName(spark.createDataFrame([(999, 50.0, 50.0, 50.0)], c.schema))
    assert pointcloud.statistical_outlier(far, 5).filter("id = 999").count() == 0


def test_remove_far_arguments(spark):
    c = cloud(spark, 10, 7)
    for bad in ({}, {"n_points": 11}, {"max_distance": 1.0, "reference": "moon"}):
        with pytest.raises(ValueError):
            pointcloud.remove_far(c, **bad)
    both = pointcloud.remove_far(c, max_distance=100.0, n_points=1)
    assert both.count() == 10


def test_exact_quantile_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(pointcloud, "EXACT_ROWS", 100)
    v = spark.range(20_000).select(((F.col("id") * 7919) % 20_011).cast("double").alias("v"))
    want = v.agg(F.percentile("v", F.lit(0.9))).first()[0]
    assert abs(pointcloud.quantile(v, "v", 0.9).first()["q"] - want) < 1e-9


def test_numbering_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ONE_TASK", 10)
    rows = ranks.numbered(spark.range(500).selectExpr("id * 3 AS id"), "id", "place").collect()
    assert sorted((r["id"], r["place"]) for r in rows) == [(i * 3, i) for i in range(500)]


def test_split_and_batches(spark):
    with pytest.raises(ValueError):
        ranks.split(spark.range(3), 4, "id")
    assert ranks.batches(spark.range(10), 4, "id").groupBy("batch").count().count() == 3


def test_box_contains_its_faces_and_nothing_if_far(spark):
    c = spark.createDataFrame([(1, 0.5, 0.0, 0.0), (2, 0.6, 0.0, 0.0)], "id int, x double, y double, z double")
    assert [r["id"] for r in filters.crop(c, scale=(1.0, 1.0, 1.0)).collect()] == [1]
    assert filters.crop(c, pos=(9.0, 9.0, 9.0)).count() == 0 and filters.crop(c).count() == 2


def test_association_equals_a_plain_loop(spark):
    seen = masks.front_of_patches(seen_in_patches(Relations(spark, "/root/testdata/sf0.01")), 0.5).select("view", "mask_id", "gid").filter("view < 3")
    got = {(r["view"], r["mask_id"]): r["label"] for r in assoc.associate(seen)[0].collect()}
    sets = {}
    for r in seen.distinct().collect():
        sets.setdefault(r["view"], {}).setdefault(r["mask_id"], set()).add(r["gid"])
    bank, want = [], {}
    for view in sorted(sets):
        new = len(bank)
        chosen = {}
        for m in sorted(sets[view]):
            a = sets[view][m]
            shares = [len(a & b) / (len(a) + len(a & b) + 1e-8) for b in bank]
            best = max(range(len(shares)), key=lambda k: (shares[k], -k)) if shares else None
            if best is None or shares[best] < 0.1:
                best, new = new, new + 1
            chosen[m] = best
        bank += [set() for _ in range(new - len(bank))]
        for m, label in chosen.items():
            bank[label] |= sets[view][m]
            want[view, m] = label
    assert got == want


def test_registered_associations_label_the_masks_of_all_views(spark):
    seen = masks.front_of_patches(seen_in_patches(Relations(spark, SF)), 0.5)
    want = {(r["view"], r["mask_id"]) for r in seen.select("view", "mask_id").distinct().collect()}
    assert {view for view, _ in want} == set(range(8))
    loop, stream = ({(r["view"], r["mask_id"]): r["label"] for r in QUERIES[name](spark, SF).collect()} for name in ("associate", "stateful_fold"))
    assert set(loop) == want and stream == loop


def test_floor_ends_at_zero(spark):
    rng = random.Random(9)
    rows = [(i, x := rng.random(), y := rng.random(), 0.2 * x - 0.1 * y + 1.5 + (5 * rng.random() if i % 4 == 0 else 0.0)) for i in range(200)]
    out, m = fusion.align_floor(spark.createDataFrame(rows, "id long, x double, y double, z double"), 60, 0.01)
    assert out.filter("id % 4 <> 0 AND abs(z) > 1e-6").count() == 0
    r = np.array([row[:3] for row in m])
    assert np.allclose(r @ r.T, np.eye(3))


def test_floor_of_few_points_is_found(spark):
    # a triple lies wholly on the floor with a chance of 0.003
    rng = random.Random(11)
    rows = [(i, x := rng.random(), y := rng.random(), 0.2 * x - 0.1 * y + 0.5 + (0.0 if i % 7 == 0 else 3 * rng.random() + 0.1)) for i in range(350)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    assert fusion.plane_hypotheses(points, 1000).count() == 1000
    assert fusion.align_floor(points, threshold=0.01)[0].filter("id % 7 = 0 AND abs(z) > 1e-6").count() == 0


def test_floor_query_searches_with_the_operator_default(spark, monkeypatch):
    given = []
    find = fusion.plane_hypotheses
    monkeypatch.setattr(fusion, "plane_hypotheses", lambda points, triples, **k: given.append(triples) or find(points, triples, **k))
    QUERIES["align_floor"](spark, SF)
    assert given == [1000]


def test_grid_cells_of_a_single_sample(spark):
    d = spark.createDataFrame([(5, 5, 5, 1.0)], "ix int, iy int, iz int, value double")
    assert surface.cut_cells(d, 0.5, 0.0).count() == 8 and surface.cut_cells(d, 0.5, 0.0, 6).count() == 1 and surface.cut_cells(d, 0.5).count() == 0
    with pytest.raises(ValueError):
        fusion.strategy("none")


def test_front_to_back(spark):
    s = spark.createDataFrame([(0, 0, 1, 2.0, 10.0, 0.5), (0, 0, 2, 1.0, 4.0, 0.5)], "view int, pix int, gid int, depth double, value double, alpha double")
    row = images.composite_front_to_back(s).first()
    assert abs(row["value"] - (0.5 * 4 + 0.25 * 10)) < 1e-12 and abs(row["transmittance"] - 0.25) < 1e-12


def test_ply_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(0, 0.0, 1.0, -2.5), (1, 3.0, 0.25, 0.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 0)], "fid long, a long, b long, c long")
    io.write_ply(io.ply_lines(v, f), str(tmp_path / "m"))
    got_v, got_f = io.read_ply(spark, str(tmp_path / "m"))
    assert sorted(got_v.collect()) == sorted(v.collect()) and got_f.collect() == f.collect()


def test_source_kinds(spark):
    df = spark.createDataFrame([("a.txt",)], "p string")
    with pytest.raises(Exception, match="unsupported"):
        df.select(io.source_kind(F.col("p"))).collect()


def test_configuration():
    assert config.parse_overrides(["a.b=1", "a.c=x=y", "r=1-5", "t=true", "f=2.5"]) == {"a": {"b": 1, "c": "x=y"}, "r": "1-5", "t": True, "f": 2.5}
    with pytest.raises(config.ValidationError):
        config.validate({"file_path": "x", "method": "rade-gs"}, lambda p: False)
    assert config.validate({"file_path": "a/b.mp4", "method": "rade-gs", "output_path": None})["output_path"] == "a/environment/b"
    assert config.validate({"file_path": "a/b.mp4", "method": "rade-gs"})["min_frames"] == 300
    with pytest.raises(ValueError):
        config.EXTRACTORS.get("none")
    with pytest.raises(ValueError):
        config.select_run([])


def test_fold_goes_on_after_a_restart(spark, tmp_path):
    """Each batch by a new object, one of them twice: the same labels as in one loop."""
    from terravane.streaming import fold

    seen = masks.front_of_patches(seen_in_patches(Relations(spark, SF)), 0.5).select("view", "mask_id", "gid").filter("view < 4")
    want = {(r["view"], r["mask_id"]): r["label"] for r in assoc.associate(seen)[0].collect()}
    folder = f"file://{tmp_path}/bank"
    assert fold.ViewFold(spark, folder).labels.count() == 0
    for batch in (0, 1, 1, 2, 3, 2, 3):
        fold.ViewFold(spark, folder).add(seen.filter(F.col("view") == batch), batch)
    rows = fold.ViewFold(spark, folder).labels.collect()
    assert {(r["view"], r["mask_id"]): r["label"] for r in rows} == want and len(rows) == len(want)
