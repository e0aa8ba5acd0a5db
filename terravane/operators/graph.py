"""Meshes and graphs: components, clusters, edges, holes, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from terravane.operators import pointcloud, spatial
from terravane.storage import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge (a, b).

    Rounds of large-star and small-star steps; the number of rounds grows with the
    logarithm of the graph, and each round's edges are written to shared storage.
    """
    edges = materialise(edges.select("a", "b"))
    now = materialise(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").filter("u <> v").distinct())
    mark = None
    while True:
        both = now.union(now.selectExpr("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.filter("v > u").join(low, "u").selectExpr("v AS u", "m AS v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").selectExpr("v AS u", "m AS v").union(low.selectExpr("u", "m AS v"))
        # what the round wrote is counted while it is written
        seen = Observation()
        now = materialise(small.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")))
        fresh = seen.get
        if fresh == mark:
            found = now.selectExpr("u AS node", "v AS root")
            roots = found.select(F.col("root").alias("node")).distinct()
            alone = edges.filter("a = b").select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti").join(roots, "node", "left_anti")
            return found.unionByName(roots.unionByName(alone).withColumn("root", F.col("node")))
        mark = fresh


def mesh_clusters(vertices: DataFrame, threshold: float = 0.8, radius2: float = 0.0009, min_size: int = 10, key: str = "id") -> DataFrame:
    """(component, id) of clusters of similar, close vertices with more than ``min_size`` members."""
    valid = vertices.filter(F.col("similarity") > F.lit(float(threshold)))
    pairs = spatial.radius_join(valid, valid, radius2, key, key).select(F.col("aid").alias("a"), F.col("bid").alias("b"))
    roots = connected_components(pairs).select(F.col("node").alias(key), F.col("root").alias("component"))
    sizes = roots.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_size).select("component")
    return roots.join(sizes, "component", "left_semi").select("component", key)


def component_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest(sizes: DataFrame) -> DataFrame:
    """The row of the largest component; the smallest id of equals."""
    return sizes.orderBy(F.desc("size"), "component").limit(1)


def contained(points: DataFrame) -> DataFrame:
    """Components whose box lies in that of the largest component, that one included."""
    boxes = points.groupBy("component").agg(F.count(F.lit(1)).alias("size"), *[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"])
    big = largest(boxes).select(*[F.col(f"{n}{c}").alias(f"big_{n}{c}") for n in ("lo", "hi") for c in "xyz"])
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & (F.col(f"lo{c}") >= F.col(f"big_lo{c}")) & (F.col(f"hi{c}") <= F.col(f"big_hi{c}"))
    return pointcloud.with_scalar(boxes, big).filter(inside).select("component")


def mesh_edges(faces: DataFrame) -> DataFrame:
    """(a, b, n_faces) of undirected edges, a < b."""
    each = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    return faces.select(F.explode(each).alias("e")).groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("n_faces"))


def edge_vertices(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with the places of both ends."""
    a = vertices.select(F.col("vid").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = vertices.select(F.col("vid").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    return edges.join(a, "a").join(b, "b")


def edge_lengths(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return edge_vertices(edges, vertices).select(*edges.columns, F.sqrt(spatial.squared("a", "b")).alias("length"))


def average_edge_length(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    return edge_lengths(mesh_edges(faces), vertices).agg(F.coalesce(F.avg("length"), F.lit(0.0)).alias("length"))


def face_components(faces: DataFrame) -> DataFrame:
    """Faces with the component of their vertices."""
    links = faces.selectExpr("a", "b").union(faces.selectExpr("b AS a", "c AS b"))
    roots = connected_components(links).select(F.col("node").alias("a"), F.col("root").alias("component"))
    return faces.join(roots, "a")


def filter_components(faces: DataFrame, vertices: DataFrame, use_largest: bool = False) -> DataFrame:
    """Faces of the largest component (by faces), and of those inside of its box unless ``use_largest``."""
    f = materialise(face_components(faces))
    big = largest(component_sizes(f))
    if use_largest:
        return f.join(big.select("component"), "component", "left_semi").drop("component")
    corner = f.select("component", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    boxes = corner.join(vertices, "vid").groupBy("component").agg(*[g(c).alias(f"{n}{c}") for n, g in (("lo", F.min), ("hi", F.max)) for c in "xyz"])
    outer = boxes.join(big.select("component"), "component", "left_semi").select(*[F.col(f"{n}{c}").alias(f"big_{n}{c}") for n in ("lo", "hi") for c in "xyz"])
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & (F.col(f"lo{c}") >= F.col(f"big_lo{c}")) & (F.col(f"hi{c}") <= F.col(f"big_hi{c}"))
    keep = pointcloud.with_scalar(boxes, outer).filter(inside).select("component")
    return f.join(keep, "component", "left_semi").drop("component")


def boundary_loops(faces: DataFrame) -> DataFrame:
    """(loop, a, b): edges of one face only, by the smallest vertex of their loop."""
    edges = mesh_edges(faces).filter("n_faces = 1").select("a", "b")
    edges = materialise(edges)
    roots = connected_components(edges).select(F.col("node").alias("a"), F.col("root").alias("loop"))
    return edges.join(roots, "a").select("loop", "a", "b")


def hole_perimeters(faces: DataFrame, vertices: DataFrame, max_size: float = 3.0) -> DataFrame:
    """(loop, n_edges, perimeter, fill): holes with a perimeter below ``max_size`` are filled."""
    lengths = edge_lengths(boundary_loops(faces), vertices)
    sums = lengths.groupBy("loop").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("length").alias("perimeter"))
    return sums.withColumn("fill", F.col("perimeter") < F.lit(float(max_size)))


def fill_holes(faces: DataFrame, vertices: DataFrame, max_size: float = 3.0, max_edge: float | None = None, max_splits: int = 0, smooth: int = 0) -> tuple[DataFrame, DataFrame]:
    """Faces and vertices with each small hole filled.

    The trivial fill is a fan around a new centre.  With ``max_edge`` the spokes of
    the fan are split into parts no longer than that, as long as a hole gets no more
    than ``max_splits`` new vertices on its spokes: the fill consists of rings.
    ``smooth`` times the new vertices move to the mean of their neighbours; others
    stay.  A centre is numbered after all vertices by the smallest one of its loop,
    a ring's vertex after those by its ring and the vertex on the rim.
    """
    loops = materialise(boundary_loops(faces))
    small = edge_lengths(loops, vertices).groupBy("loop").agg(F.sum("length").alias("p"), F.count(F.lit(1)).alias("n")).filter(F.col("p") < F.lit(float(max_size))).select("loop", "n")
    rim = loops.join(small, "loop")
    top = vertices.agg((F.max("vid") + 1).alias("__top"))
    corners = rim.select("loop", "n", F.explode(F.array("a", "b")).alias("vid")).distinct().join(vertices.select("vid", "x", "y", "z"), "vid")
    centres = pointcloud.with_scalar(corners.groupBy("loop", "n").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"]), top)
    spokes = corners.join(centres, ["loop", "n"])
    if max_edge is None:
        rings = F.lit(1)
    else:
        length = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("mx")) ** 2))
        longest = spokes.groupBy("loop").agg(F.max(length).alias("longest"))
        centres = centres.join(longest, "loop")
        rings = F.greatest(F.lit(1), F.least(F.ceil(F.col("longest") / F.lit(float(max_edge))), F.floor(F.lit(max_splits) / F.col("n")) + 1)).cast("int")
    centres = materialise(centres.select("loop", "n", rings.alias("rings"), "__top", "mx", "my", "mz"))
    middle = centres.select((F.col("__top") + F.col("loop")).alias("vid"), *[F.col(f"m{c}").alias(c) for c in "xyz"])
    # ring 0 is the rim, ring ``rings`` the centre
    inner = corners.join(centres, ["loop", "n"]).filter("rings > 1").select("*", F.explode(F.sequence(F.lit(1), F.col("rings") - 1)).alias("ring"))
    inner = inner.select((F.col("__top") * (F.col("ring") + 1) + F.col("vid")).alias("vid"), *[(F.col(c) + (F.col(f"m{c}") - F.col(c)) * F.col("ring") / F.col("rings")).alias(c) for c in "xyz"])
    steps = rim.join(centres.drop("n"), "loop").select("*", F.explode(F.sequence(F.lit(0), F.col("rings") - 1)).alias("ring"))

    def at(v: str, ring: Column) -> Column:
        return F.when(ring == 0, F.col(v)).otherwise(F.col("__top") * (ring + 1) + F.col(v))

    ring = F.col("ring")
    a0, b0, a1, b1, mid = at("a", ring), at("b", ring), at("a", ring + 1), at("b", ring + 1), F.col("__top") + F.col("loop")
    inmost = ring == F.col("rings") - 1
    face = F.when(inmost, F.array(F.struct(a0.alias("a"), b0.alias("b"), mid.alias("c")))).otherwise(F.array(F.struct(a0.alias("a"), b0.alias("b"), a1.alias("c")), F.struct(b0.alias("a"), b1.alias("b"), a1.alias("c"))))
    fans = steps.select(F.explode(face).alias("f")).select("f.*")
    new = middle.unionByName(inner)
    out = faces.select("a", "b", "c").unionByName(fans), vertices.select("vid", "x", "y", "z").unionByName(new)
    if not smooth:
        return out
    filled, fixed = materialise(fans), vertices.select("vid", "x", "y", "z")
    new = materialise(new)
    edges = mesh_edges(filled).select("a", "b")
    both = edges.union(edges.selectExpr("b", "a")).join(new.select(F.col("vid").alias("a")), "a", "left_semi")
    for _ in range(smooth):
        ends = both.join(fixed.unionByName(new).withColumnRenamed("vid", "b"), "b")
        new = materialise(ends.groupBy(F.col("a").alias("vid")).agg(*[F.avg(c).alias(c) for c in "xyz"]))
    return out[0], fixed.unionByName(new)


def clean_repair(faces: DataFrame, vertices: DataFrame, max_size: float = 3.0, use_largest: bool = False, max_splits: int = 0) -> tuple[DataFrame, DataFrame]:
    """Drop stray components, then fill small holes.

    With ``max_splits`` the fill has edges of the mesh's average length and is smoothed.
    """
    kept = materialise(filter_components(faces, vertices, use_largest).select("a", "b", "c"))
    if not max_splits:
        return fill_holes(kept, vertices, max_size)
    length = average_edge_length(kept, vertices).first()["length"]
    return fill_holes(kept, vertices, max_size, length or None, max_splits, 3)


def laplacian_smooth(faces: DataFrame, vertices: DataFrame, iterations: int = 1, weight: float = 0.5) -> DataFrame:
    """Each vertex moves by ``weight`` towards the mean of its neighbours."""
    edges = mesh_edges(faces).select("a", "b")
    both = edges.union(edges.selectExpr("b", "a"))
    now = vertices.select("vid", "x", "y", "z")
    for _ in range(iterations):
        ends = both.join(now.withColumnRenamed("vid", "b"), "b").groupBy(F.col("a").alias("vid")).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
        moved = now.join(ends, "vid", "left")
        now = moved.select("vid", *[F.coalesce(F.col(c) + F.lit(float(weight)) * (F.col(f"m{c}") - F.col(c)), F.col(c)).alias(c) for c in "xyz"])
    return now
