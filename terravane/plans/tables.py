"""Queries of sources, sinks, configuration, functions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane import fixtures
from terravane.plans.registry import Relations, query, r9
from terravane.plans.scene import ASSOCIATED, patches_of_pixels
from terravane.plans.spatial import mask_shapes, pixels_of
from terravane.sources import config, io
from terravane.storage import fresh_path
from terravane.streaming import fold

_PATHS = "'/data/' || p_partkey || CASE p_partkey % 6 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mov' WHEN 2 THEN '.avi' WHEN 3 THEN '_360/a.JPG' WHEN 4 THEN '.jpeg' ELSE '.png' END"


@query(f"SELECT p_partkey AS id, CASE WHEN p_partkey % 6 < 3 THEN 'video' WHEN contains({_PATHS}, '360') THEN 'equirectangular' ELSE 'images' END AS kind FROM {{part}}")
def src_video_frames(r: Relations) -> DataFrame:
    endings = F.element_at(F.array(*[F.lit(e) for e in (".MP4", ".mov", ".avi", "_360/a.JPG", ".jpeg", ".png")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), F.col("p_partkey").cast("string"), endings)
    return r("part").select(F.col("p_partkey").alias("id"), path.alias("path")).select("id", io.source_kind(F.col("path")).alias("kind"))


@query("SELECT o_orderkey AS id, CASE WHEN floor((o_orderkey % 1000) * 0.25::DOUBLE) < 100 THEN o_orderkey % 1000 ELSE floor((o_orderkey % 1000) * 0.25::DOUBLE)::BIGINT END AS frames FROM {orders}")
def frame_sampling(r: Relations) -> DataFrame:
    return r("orders").select(F.col("o_orderkey").alias("id"), io.frames_to_sample(F.col("o_orderkey") % 1000, 0.25, 100).alias("frames"))


@query("SELECT 'frame_' || cam || '.png' AS file_path, r00, r01, r12, r22, tx, ty, tz FROM {cameras}")
def src_transforms_json(r: Relations) -> DataFrame:
    path = fresh_path(r.spark, "transforms")
    frames = []
    for row in fixtures.camera_rows():
        m = row[1:10]
        frames.append({"file_path": f"frame_{row[0]}.png", "transform_matrix": [[*m[3 * i : 3 * i + 3], row[10 + i]] for i in range(3)] + [[0.0, 0.0, 0.0, 1.0]]})
    io.write_json(r.spark, path, {"frames": frames})
    return io.read_transforms(r.spark, path).select("file_path", "r00", "r01", "r12", "r22", "tx", "ty", "tz")


@query("SELECT vid, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y, round(z, 6) + 0.0::DOUBLE AS z FROM {torus_vertices}")
def src_ply(r: Relations) -> DataFrame:
    path = fresh_path(r.spark, "ply")
    io.write_ply(io.ply_lines(r("torus_vertices"), r("torus_faces")), path)
    v, _ = io.read_ply(r.spark, path)
    return v.select("vid", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


@query("SELECT 2 AS part, fid AS place, printf('3 %d %d %d', a, b, c) AS value FROM {torus_faces}")
def sink_ply(r: Relations) -> DataFrame:
    return io.ply_lines(r("torus_vertices"), r("torus_faces")).filter("part = 2")


@query("SELECT id AS vid, f[1] AS f0, f[13] AS f12 FROM {pts}")
def sink_features(r: Relations) -> DataFrame:
    path = fresh_path(r.spark, "features")
    r("pts").select(F.col("id").alias("vid"), "f").write.parquet(path)
    return r.spark.read.parquet(path).select("vid", F.col("f")[0].alias("f0"), F.col("f")[12].alias("f12"))


@query("SELECT * FROM (VALUES (0, 1.0::DOUBLE, 0.5::DOUBLE), (1, -0.25, 2.0)) AS t(row, a, b)")
def sink_transforms(r: Relations) -> DataFrame:
    path = fresh_path(r.spark, "sidecar")
    io.write_json(r.spark, path, {"matrix": [[1.0, 0.5], [-0.25, 2.0]]})
    rows = [(i, *m) for i, m in enumerate(io.read_json(r.spark, path)["matrix"])]
    return r.spark.createDataFrame(rows, "row int, a double, b double")


@query("SELECT * FROM (VALUES ('sdf_trunc', '0.03'), ('voxel_size', '0.01')) AS t(name, value)")
def sink_params(r: Relations) -> DataFrame:
    path = fresh_path(r.spark, "params")
    io.write_json(r.spark, path, {"voxel_size": 0.01, "sdf_trunc": 0.03})
    return r.spark.createDataFrame([(k, str(v)) for k, v in sorted(io.read_json(r.spark, path).items())], "name string, value string")


@query("SELECT * FROM (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 3.0::DOUBLE), (1, 0.0, 1.0, 0.0, -2.0), (2, 0.0, 0.0, 1.0, 0.5)) AS t(row, m0, m1, m2, m3)")
def load_mesh_transform(r: Relations) -> DataFrame:
    path = fresh_path(r.spark, "mesh")
    io.write_json(r.spark, path, {"mesh_transform": [[1.0, 0.0, 0.0, 3.0], [0.0, 1.0, 0.0, -2.0], [0.0, 0.0, 1.0, 0.5], [0.0, 0.0, 0.0, 1.0]]})
    rows = [(i, *m) for i, m in enumerate(io.read_json(r.spark, path)["mesh_transform"][:3])]
    return r.spark.createDataFrame(rows, "row int, m0 double, m1 double, m2 double, m3 double")


@query("SELECT view, count(*) AS pixels FROM {mask_px} GROUP BY view")
def sink_mask_png(r: Relations) -> DataFrame:
    path = fresh_path(r.spark, "masks")
    io.write_masks(r("mask_px"), path)
    return r.spark.read.schema("mask_id long, predicted_iou double, y int, x int, view long").parquet(path).groupBy("view").agg(F.count(F.lit(1)).alias("pixels"))


@query("SELECT run, hit, n AS rows FROM (VALUES ('first', false), ('again', true), ('other width', false), ('other names', false)) AS t(run, hit), (SELECT count(*) AS n FROM {pts})")
def feature_cache(r: Relations) -> DataFrame:
    path, out = fresh_path(r.spark, "cache"), []
    names = ["a.png", "b.png"]
    runs = [("first", names, {"width": 13}), ("again", names, {"width": 13}), ("other width", names, {"width": 7}), ("other names", ["a.png"], {"width": 13})]
    for run, given, params in runs:
        df, hit = io.cached(r.spark, path, given, params, lambda: r("pts").select("id", "f"))
        out.append((run, hit, df.count()))
    return r.spark.createDataFrame(out, "run string, hit boolean, rows long")


@query("SELECT * FROM (VALUES (false, false, false), (false, true, false), (true, false, true), (true, true, false)) AS t(output_exists, overwrite, skipped)")
def skip_if_exists(r: Relations) -> DataFrame:
    there, missing = fresh_path(r.spark, "stage"), fresh_path(r.spark, "stage")
    io.write_json(r.spark, there, {})
    rows = [(e, o, io.skip_stage(io.exists(r.spark, there if e else missing), o)) for e in (False, True) for o in (False, True)]
    return r.spark.createDataFrame(rows, "output_exists boolean, overwrite boolean, skipped boolean")


@query("SELECT cam, row_number() OVER (ORDER BY cam) - 1 AS place FROM {cameras}")
def ordered_scan(r: Relations) -> DataFrame:
    from terravane.operators import ranks

    return ranks.numbered(r("cameras").select("cam"), "cam", "place")


@query("SELECT unnest(['ants', 'birds', 'zebra']) AS dataset")
def list_datasets(r: Relations) -> DataFrame:
    found = config.list_datasets(["d/zebra.yaml", "d/ants.yaml", "d/notes.txt", "d/birds.yaml"])
    return r.spark.createDataFrame([(d,) for d in found], "dataset string")


@query("SELECT 'runs/2024-05-01/config.yml' AS latest, 'runs/2023-01-01/config.yml' AS first")
def select_run(r: Relations) -> DataFrame:
    runs = ["runs/2024-05-01/config.yml", "runs/2023-01-01/config.yml", "runs/2023-12-31/config.yml"]
    return r.spark.createDataFrame([(config.select_run(runs), config.select_run(runs, 0))], "latest string, first string")


@query("SELECT * FROM (VALUES ('ok', true), ('no method', false), ('no source', false), ('unknown method', false)) AS t(given, valid)")
def config_validation(r: Relations) -> DataFrame:
    cases = {"ok": {"file_path": "a/b.mp4", "method": "rade-gs"}, "no method": {"file_path": "a/b.mp4"}, "no source": {"method": "rade-gs"}, "unknown method": {"file_path": "a", "method": "x"}}
    rows = []
    for name, given in cases.items():
        try:
            config.validate(given)
            rows.append((name, True))
        except config.ValidationError:
            rows.append((name, False))
    return r.spark.createDataFrame(rows, "given string, valid boolean")


@query("SELECT unnest(['feature-splatting', 'rade-features', 'rade-gs', 'splatfacto']) AS method")
def method_listing(r: Relations) -> DataFrame:
    return r.spark.createDataFrame([(m,) for m in sorted(config.METHODS)], "method string")


@query("SELECT * FROM (VALUES ('clip-vit', 512), ('dinov2', 384), ('samclip', 512)) AS t(name, width)")
def extractor_registry(r: Relations) -> DataFrame:
    return r.spark.createDataFrame([(n, config.EXTRACTORS.get(n)["width"]) for n in config.EXTRACTORS.names()], "name string, width int")


@query("SELECT * FROM (VALUES ('training.lr', '0.5'), ('training.steps', '10'), ('name', 'a=b'), ('flag', 'True')) AS t(key, value)")
def cli_overrides(r: Relations) -> DataFrame:
    got = config.parse_overrides(["training.lr=0.5", "training.steps=10", "name=a=b", "flag=true"])
    rows = [("training.lr", str(got["training"]["lr"])), ("training.steps", str(got["training"]["steps"])), ("name", got["name"]), ("flag", str(got["flag"]))]
    return r.spark.createDataFrame(rows, "key string, value string")


# --- functions

_M = {"a_exp": "exp(x)", "b_sqrt": "sqrt(abs(x))", "c_acos": "acos(greatest(-1, least(1, x)))", "d_atan": "atan(y)", "e_tan": "tan(z)", "f_floor": "floor(x * 100)::DOUBLE", "g_ceil": "ceil(x * 100)::DOUBLE", "h_half_even": "round_even(id / 2::DOUBLE, 0)", "i_norm": "sqrt(x*x + y*y + z*z)", "j_sigmoid": "1 / (1 + exp(-y))"}


@query("SELECT id, " + ", ".join(f"round({e}, 9) + 0.0::DOUBLE AS {n}" for n, e in _M.items()) + " FROM {pts}")
def math_functions(r: Relations) -> DataFrame:
    x, y, z = (F.col(c) for c in "xyz")
    e = [F.exp(x), F.sqrt(F.abs(x)), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))), F.atan(y), F.tan(z), F.floor(x * 100).cast("double"), F.ceil(x * 100).cast("double"), F.bround(F.col("id") / 2.0, 0), F.sqrt(x * x + y * y + z * z), 1.0 / (1.0 + F.exp(-y))]
    return r("pts").select("id", *[r9(v).alias(n) for v, n in zip(e, _M, strict=True)])


@query("SELECT id, len(f)::INTEGER AS n, round(list_sum(f), 9) + 0.0::DOUBLE AS total, round(list_sum(list_transform(range(1, 14), lambda i: f[i] * f[14 - i])), 9) + 0.0::DOUBLE AS mirrored, list_position(f, list_min(f))::INTEGER - 1 AS argmin, round(f[2] - f[1], 9) + 0.0::DOUBLE AS step FROM {pts}")
def array_functions(r: Relations) -> DataFrame:
    f = F.col("f")
    total = F.aggregate(f, F.lit(0.0), lambda a, b: a + b)
    mirrored = F.aggregate(F.zip_with(f, F.reverse(f), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return r("pts").select("id", F.size(f).alias("n"), r9(total).alias("total"), r9(mirrored).alias("mirrored"), (F.array_position(f, F.array_min(f)) - 1).cast("int").alias("argmin"), r9(f[1] - f[0]).alias("step"))


@query("SELECT p_partkey AS id, lower(p_brand) AS brand, split_part(p_type, ' ', 1) AS head, p_brand || '=' || p_size AS pair FROM {part}")
def string_functions(r: Relations) -> DataFrame:
    return r("part").select(F.col("p_partkey").alias("id"), F.lower("p_brand").alias("brand"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("head"), F.concat_ws("=", "p_brand", F.col("p_size").cast("string")).alias("pair"))


@query("SELECT event_id AS id, json_extract(props, '$.k')::BIGINT AS k FROM {events}")
def json_functions(r: Relations) -> DataFrame:
    return r("events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT * FROM (VALUES ('kept', '1'), ('nested.a', '2'), ('nested.b', '3'), ('new', '4')) AS t(key, value)")
def map_merge(r: Relations) -> DataFrame:
    m = config.deep_merge({"kept": 1, "nested": {"a": 0, "b": 3}}, {"nested": {"a": 2}, "new": 4})
    rows = [("kept", str(m["kept"])), ("nested.a", str(m["nested"]["a"])), ("nested.b", str(m["nested"]["b"])), ("new", str(m["new"]))]
    return r.spark.createDataFrame(rows, "key string, value string")


# --- streams


@query(ASSOCIATED)
def stateful_fold(r: Relations) -> DataFrame:
    """The association by a stream of files; equal to the loop over views."""
    path, out = fresh_path(r.spark, "views"), fold.ShapeFold(r.spark, fresh_path(r.spark, "bank"), 0.5, *patches_of_pixels(), 0.1)
    seen = fold.frames(pixels_of(r), mask_shapes(r))
    seen.write.parquet(path)
    stream = r.spark.readStream.schema(seen.schema).parquet(path)
    out.start(stream, fresh_path(r.spark, "fold")).awaitTermination()
    return out.labels


@query("""SELECT s AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM {events}) GROUP BY ALL""")
def sliding_windows(r: Relations) -> DataFrame:
    out = fold.windowed_counts(r("events"))
    return out.select("start", "event_type", "n", F.round("total", 6).alias("total"))
