"""Queries over the file layouts: each writes its tables in a layout below the shared folder and reads them back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry, vectors
from tessera.operators import evaluation, groundtruth, incidence, lifting, openvoc, views
from tessera.plans.config import PRESETS, Params, scan_config
from tessera.plans.scratch import Scratch
from tessera.registry import query
from tessera.sources import adapters, binary, datasets, frames, images, layouts, sinks, stores
from tessera.sources.adapters import table
from tessera.streaming import points
from tessera.streaming.ingest import ingest


#: Scenes over which rows are dealt where a layout has a file for each.
SCENES = 8
#: Folders of many small files, and files that a task writes.
FOLDERS, FILES = 64, 2_000


def as_text(spark, name: str, lines: DataFrame) -> str:
    """Writes lines (seq, n, line) in the order of n as one text file for each seq; gives a glob of the files.

    Lines are dealt by a hash of seq, since Spark leaves a deal by seq itself out where both sides of a union
    are dealt so, whose tasks it then puts side by side.
    """
    root = f"{Scratch(spark, name).root}/files"
    lines.repartition(F.xxhash64("seq")).sortWithinPartitions("seq", "n").select("seq", F.col("line").alias("value")).write.partitionBy("seq").text(root)
    return f"{root}/seq=*/*"


def as_files(spark, name: str, files: DataFrame) -> str:
    """Writes files (name, content); gives the folder."""
    root = f"{Scratch(spark, name).root}/files"
    sinks.write_files(files, root)
    return root


def as_texts(spark, name: str, texts: DataFrame) -> str:
    """Writes each text (seq, value) as a small file of its own, dealt over FOLDERS so that tasks can list them; gives a glob of the folders."""
    named = texts.select(F.concat(F.pmod(F.xxhash64("seq"), F.lit(FOLDERS)), F.lit("/"), "seq", F.lit(".txt")).alias("name"), F.col("value").alias("content"))
    return f"{as_files(spark, name, named.repartition(texts.count() // FILES + 1))}/*"


def seq_of(path: str = "path") -> Column:
    """The value of a folder's seq=.. in a path."""
    return F.regexp_extract(path, "seq=([^/]+)", 1)


def stem(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([^/.]+)\.[^/]*$", 1)


def words(*columns) -> Column:
    """The columns as text with a space between."""
    return F.concat_ws(" ", *(F.col(c) if isinstance(c, str) else c for c in columns))


def rounded(df: DataFrame, *keep: str, **values: Column) -> DataFrame:
    return df.select(*keep, *(F.round(v, 6).alias(k) for k, v in values.items()))


# --- Text layouts ---------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS BIGINT) AS n, n_name AS seq FROM nation")
def split_list(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").select(F.lit("all").alias("seq"), F.col("n_nationkey").alias("n"), F.concat("n_name", F.lit(" ")).alias("line"))
    return layouts.scan_split(spark, as_text(spark, "split", lines)).select("n", "seq")


@query("""SELECT 'step' AS name, CAST(count(*) AS DOUBLE) AS value FROM region UNION ALL SELECT 'contained_threshold', round(min(s_acctbal), 2) FROM supplier
UNION ALL SELECT 'view_consensus_threshold', 1.0 UNION ALL SELECT 'few_points', 25""")
def config_values(spark, sf_dir):
    r, s = table(spark, sf_dir, "region"), table(spark, sf_dir, "supplier")
    given = r.agg(F.count("*").alias("step")).crossJoin(s.agg(F.round(F.min("s_acctbal"), 2).alias("contained_threshold"))).withColumn("dataset", F.lit("x"))
    path = as_text(spark, "config", given.select(F.lit("all").alias("seq"), F.lit(0).alias("n"), F.to_json(F.struct("*")).alias("line")))
    p = scan_config(spark, path, PRESETS["scannetpp"])
    return spark.createDataFrame([(k, float(getattr(p, k))) for k in ("step", "contained_threshold", "view_consensus_threshold", "few_points")], "name string, value double")


def matrices(spark, sf_dir):
    """The text of a 4x4 matrix for each supplier."""
    k = F.col("s_suppkey").cast("double")
    rows = [(k + 500, F.lit(0.5), k / 2, F.lit(0.0)), (F.lit(0.0), k + 510, k / 4, F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))]
    lines = F.concat(*(F.concat(words(*r), F.lit("\n")) for r in rows))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("seq"), lines.alias("value"))


@query("SELECT s_suppkey AS id, s_suppkey + 500.0::DOUBLE AS fx, s_suppkey + 510.0::DOUBLE AS fy, s_suppkey / 2 AS cx, s_suppkey / 4 AS cy, 640::BIGINT AS w, 480::BIGINT AS h FROM supplier")
def camera_intrinsics(spark, sf_dir):
    found = layouts.scan_intrinsics(spark, as_texts(spark, "intrinsics", matrices(spark, sf_dir)), 640, 480)
    return found.select(stem().cast("long").alias("id"), "intr.*")


@query("""SELECT s_suppkey AS id, i, CASE i WHEN 0 THEN s_suppkey + 500 WHEN 1 THEN 0.5 WHEN 2 THEN s_suppkey / 2 WHEN 5 THEN s_suppkey + 510 WHEN 6 THEN s_suppkey / 4
  WHEN 10 THEN 1 WHEN 15 THEN 1 ELSE 0 END::DOUBLE AS value FROM supplier CROSS JOIN range(16) t(i)""")
def pose_entries(spark, sf_dir):
    found = layouts.scan_matrix(spark, as_texts(spark, "poses", matrices(spark, sf_dir)))
    return found.select(stem().cast("long").alias("id"), F.posexplode("pose").alias("i", "value"))


CONF_SQL = """
WITH s AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS idx FROM supplier)
SELECT CAST(s_nationkey AS BIGINT) AS nation, idx, 'd' || s_suppkey || '.png' AS depth, 'c' || s_suppkey || '.jpg' AS rgb, 100.0::DOUBLE + idx // 6 AS fx, 110.0::DOUBLE + idx // 6 AS fy, 20.0::DOUBLE AS cx, 30.0::DOUBLE AS cy,
  i, (s_suppkey * 16 + i) * (CASE WHEN i < 12 AND i % 4 IN (1, 2) THEN -1 ELSE 1 END)::DOUBLE AS value FROM s CROSS JOIN range(16) t(i)"""


@query(CONF_SQL)
def camera_conf(spark, sf_dir):
    """Suppliers of a nation as scans of one configuration, with an intrinsic matrix before each six."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").withColumn("idx", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1)
    block = F.floor(F.col("idx") / 6)
    head = s.where("idx % 6 = 0").select(F.col("s_nationkey").alias("seq"), (F.col("idx") * 2).alias("n"), words(F.lit("intrinsics_matrix"), 100.0 + block, F.lit("0 20 0"), 110.0 + block, F.lit("30 0 0 1")).alias("line"))
    pose = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.col("s_suppkey") * 16 + i).cast("string")), " ")
    scans = s.select(F.col("s_nationkey").alias("seq"), (F.col("idx") * 2 + 1).alias("n"), words(F.lit("scan"), F.concat(F.lit("d"), "s_suppkey", F.lit(".png")), F.concat(F.lit("c"), "s_suppkey", F.lit(".jpg")), pose).alias("line"))
    found = layouts.scan_conf(spark, as_text(spark, "conf", head.unionByName(scans)))
    return found.select(seq_of().cast("long").alias("nation"), "idx", "depth", "rgb", "intr.*", F.posexplode("pose").alias("i", "value"))


@query("""SELECT p_partkey AS camera_id, CASE WHEN p_partkey % 2 = 0 THEN 'PINHOLE' ELSE 'SIMPLE_RADIAL' END AS model, CAST(p_size AS BIGINT) AS width, p_partkey % 99 AS height,
  p_retailprice AS fx, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_retailprice END::DOUBLE AS fy, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE p_size END::DOUBLE AS cx, CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 3 END::DOUBLE AS cy FROM part""")
def colmap_cameras(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    model = F.when(F.col("p_partkey") % 2 == 0, "PINHOLE").otherwise("SIMPLE_RADIAL")
    lines = p.select((F.col("p_partkey") % SCENES).cast("string").alias("seq"), F.col("p_partkey").alias("n"), words("p_partkey", model, "p_size", F.col("p_partkey") % 99, "p_retailprice", "p_size", F.lit("3 4")).alias("line"))
    lines = lines.unionByName(spark.createDataFrame([(str(i), -1, "# cameras, one a line") for i in range(SCENES)], "seq string, n long, line string"))
    return layouts.scan_colmap_cameras(spark, as_text(spark, "cameras", lines)).select("camera_id", "model", "width", "height", "intr.*")


@query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding[1:7]] AS v FROM embeddings),
q AS (SELECT vec_id, v, v[1] / n AS w, v[2] / n AS x, v[3] / n AS y, v[4] / n AS z FROM (SELECT *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3] + v[4] * v[4]) AS n FROM e)),
r AS (SELECT vec_id, v, [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)] AS r FROM q)
SELECT vec_id AS frame_id, i, round(CASE WHEN i = 15 THEN 1.0 WHEN i >= 12 THEN 0.0 WHEN i % 4 < 3 THEN r[i % 4 * 3 + i // 4 + 1] ELSE -(r[i // 4 + 1] * v[5] + r[i // 4 + 4] * v[6] + r[i // 4 + 7] * v[7]) END, 6) + 0.0 AS value, 400.0::DOUBLE AS fx
FROM r CROSS JOIN range(16) t(i)""")
def colmap_world_poses(spark, sf_dir):
    """Image poses, read from their two lines each, as camera-to-world matrices."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(F.slice("embedding", 1, 4)).alias("q"), F.transform(F.slice("embedding", 5, 3), lambda x: x.cast("double")).alias("t"))
    name = F.concat(F.lit("frame_"), F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit(".jpg"))
    body = F.when(F.col("vec_id") % 2 == 0, F.lit("1.0 2.0 7")).otherwise("")
    lines = F.array(F.struct((2 * F.col("vec_id")).alias("n"), words("vec_id", F.array_join(F.transform("q", lambda x: x.cast("string")), " "), F.array_join(F.transform("t", lambda x: x.cast("string")), " "), F.lit(1), name).alias("line")), F.struct((2 * F.col("vec_id") + 1).alias("n"), body.alias("line")))
    rows = e.select((F.col("vec_id") % SCENES).cast("string").alias("seq"), F.explode(lines).alias("l")).select("seq", "l.n", "l.line")
    camera = spark.createDataFrame([("all", 0, "1 PINHOLE 640 480 400 410 320 240")], "seq string, n int, line string")
    found = layouts.colmap_poses(layouts.scan_colmap_images(spark, as_text(spark, "images", rows)), layouts.scan_colmap_cameras(spark, as_text(spark, "camera", camera)))
    return found.select("frame_id", F.posexplode("pose").alias("i", "value"), "intr.fx").select("frame_id", "i", (F.round("value", 6) + 0.0).alias("value"), "fx")


@query("""SELECT o.o_orderkey AS frame_id, l.dataset, l.rgb_path, l.depth_path, l.seg_path FROM orders o, LATERAL (VALUES
  ('scannet', '/d/s/color/' || o_orderkey || '.jpg', '/d/s/depth/' || o_orderkey || '.png', '/d/s/output/mask/' || o_orderkey || '.png'),
  ('demo', '/d/s/color_640/' || o_orderkey || '.jpg', '/d/s/depth/' || o_orderkey || '.png', '/d/s/output/mask/' || o_orderkey || '.png'),
  ('scannetpp', '/d/s/iphone/rgb/frame_' || lpad(o_orderkey::VARCHAR, 6, '0') || '.jpg', '/d/s/iphone/render_depth/frame_' || lpad(o_orderkey::VARCHAR, 6, '0') || '.png', '/d/s/output/mask/frame_' || lpad(o_orderkey::VARCHAR, 6, '0') || '.png'),
  ('matterport3d', '/d/s/undistorted_color_images/' || o_orderkey || '.jpg', '/d/s/undistorted_depth_images/' || o_orderkey || '.png', '/d/s/output/mask/' || o_orderkey || '.png')) l(dataset, rgb_path, depth_path, seg_path)""")
def frame_paths(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(F.lit("s").alias("seq"), F.col("o_orderkey").alias("frame_id"))
    out = None
    for name in frames.LAYOUTS:
        each = frames.frame_paths(found, name, "/d/").select("frame_id", F.lit(name).alias("dataset"), "rgb_path", "depth_path", "seg_path")
        out = each if out is None else out.unionByName(each)
    return out


GT_POINTS = """o AS (SELECT o_orderkey, (n_regionkey + 1) * 1000 + c_nationkey + 1 AS gt_id, c_nationkey AS nation, row_number() OVER (ORDER BY o_orderkey) - 1 AS point_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def numbered_gt(spark, sf_dir):
    """Orders in the order of their keys, with their ground truth number."""
    from pyspark.sql import Window

    gt = adapters.nations_gt(spark, sf_dir).withColumn("nation", F.col("gt_id") % 1000 - 1)
    return gt.withColumn("point_id", (F.row_number().over(Window.partitionBy("nation").orderBy("point_id")) - 1).cast("long")).select(F.col("nation").cast("string").alias("seq"), "point_id", "gt_id")


@query(f"WITH {GT_POINTS} SELECT CAST(nation AS BIGINT) AS scene, row_number() OVER (PARTITION BY nation ORDER BY o_orderkey) - 1 AS point_id, CAST(gt_id AS BIGINT) AS gt_id FROM o")
def gt_files(spark, sf_dir):
    """Ground truth of each nation written as one number a line, and read again."""
    root = f"{Scratch(spark, 'gt').root}/gt"
    sinks.write_gt_text(numbered_gt(spark, sf_dir), root)
    return layouts.scan_gt(spark, f"{root}/seq=*/*").select(seq_of().cast("long").alias("scene"), "point_id", "gt_id")


@query(f"WITH {GT_POINTS} SELECT CAST(nation AS BIGINT) AS scene, count(DISTINCT gt_id // 1000) AS classes, count(DISTINCT gt_id) AS numbers FROM o GROUP BY ALL")
def gt_class_counts(spark, sf_dir):
    return groundtruth.class_counts(numbered_gt(spark, sf_dir)).select(F.col("seq").cast("long").alias("scene"), "classes", "numbers")


# --- Ground truth from annotations ------------------------------------------------------------------

#: Parts as points: a segment each, its size; groups of segments by nation in the order of their keys, some of them in several.
ANNOTATED = """
p AS (SELECT p_partkey AS id, p_partkey % 4 AS scene, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) - 1 AS point_id, CAST(p_size AS BIGINT) AS segment FROM part),
g AS (SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS label, CAST(n_regionkey AS BIGINT) AS region, unnest([2 * n_nationkey, 2 * n_nationkey + 1, n_nationkey + 5])::BIGINT AS segment FROM nation),
last AS (SELECT segment, max(pos) AS pos, arg_max(region, pos) AS region FROM g GROUP BY ALL)"""


def annotated(spark, sf_dir):
    """(segments, groups) of four scenes, written as JSON and read again."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 4).cast("string").alias("seq"), "p_partkey", "p_size")
    whole = p.groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_size"))), lambda x: x["p_size"]).alias("segIndices"))
    segs = as_text(spark, "segs", whole.select("seq", F.lit(0).alias("n"), F.to_json(F.struct("segIndices")).alias("line")))
    k = F.col("n_nationkey")
    one = F.struct(k.alias("id"), F.col("n_name").alias("label"), F.array(2 * k, 2 * k + 1, k + 5).alias("segments"))
    all_ = table(spark, sf_dir, "nation").agg(F.sort_array(F.collect_list(one)).alias("segGroups")).withColumn("seq", F.explode(F.array(*(F.lit(str(i)) for i in range(4)))))
    groups = as_text(spark, "groups", all_.select("seq", F.lit(0).alias("n"), F.to_json(F.struct("segGroups")).alias("line")))
    return layouts.scan_segments(spark, segs).withColumn("seq", seq_of()), layouts.scan_groups(spark, groups).withColumn("seq", seq_of())


@query(f"WITH {ANNOTATED} SELECT scene, point_id, segment FROM p")
def segment_files(spark, sf_dir):
    return annotated(spark, sf_dir)[0].select(F.col("seq").cast("long").alias("scene"), "point_id", "segment")


@query(f"WITH {ANNOTATED} SELECT s AS scene, pos, pos AS id, label, segment FROM g CROSS JOIN range(4) t(s)")
def group_files(spark, sf_dir):
    return annotated(spark, sf_dir)[1].select(F.col("seq").cast("long").alias("scene"), "pos", "id", "label", F.explode("segments").alias("segment"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS row, n_name AS raw_category, CAST(n_regionkey AS BIGINT) AS id FROM nation")
def label_map_file(spark, sf_dir):
    return layouts.scan_tsv(spark, tsv(spark, sf_dir), "raw_category string, id int").select("row", "raw_category", "id")


def tsv(spark, sf_dir) -> str:
    """Nations and their regions as a tab-separated table with other columns between them."""
    body = table(spark, sf_dir, "nation").select(F.lit("all").alias("seq"), F.col("n_nationkey").alias("n"), F.concat_ws("\t", F.lit("x"), "n_regionkey", F.lit(""), "n_name").alias("line"))
    head = spark.createDataFrame([("all", -1, "other\tid\tmore\traw_category")], "seq string, n int, line string")
    return as_text(spark, "tsv", head.unionByName(body))


def valid_regions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "region").where("r_name < 'E'").select(F.col("r_regionkey").alias("label_id"))


@query(f"""WITH {ANNOTATED}, ok AS (SELECT CAST(r_regionkey AS BIGINT) AS region FROM region WHERE r_name < 'E')
SELECT scene, point_id, CASE WHEN pos IS NULL THEN 1 ELSE coalesce(ok.region, 0) * 1000 + pos + 2 END AS gt_id FROM p LEFT JOIN last USING (segment) LEFT JOIN ok USING (region)""")
def gt_from_segments(spark, sf_dir):
    """Instance numbers of points from segment, group and label files."""
    segs, groups = annotated(spark, sf_dir)
    names = layouts.scan_tsv(spark, tsv(spark, sf_dir), "raw_category string, id int")
    found = groundtruth.from_segments(segs, groups, names, valid_regions(spark, sf_dir))
    return found.select(F.col("seq").cast("long").alias("scene"), "point_id", "gt_id")


#: Meshes of the scenes: parts as vertices, lines of orders as faces in the order of order and line; the supplier is a face's category, its first part its segment.
FACES = """
v AS (SELECT p_partkey % 8 AS scene, row_number() OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey) - 1 AS point_id, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y, CAST(p_partkey AS DOUBLE) AS z FROM part),
n AS (SELECT scene, count(*) AS n FROM v GROUP BY scene),
f AS (SELECT scene, l_partkey % n AS a, (l_partkey + l_suppkey) % n AS b, l_linenumber % n AS c, l_suppkey % 25 AS category, l_partkey % 50 AS segment,
  row_number() OVER (PARTITION BY scene ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem JOIN n ON l_orderkey % 8 = scene),
e AS (SELECT scene, unnest([a, b, c]) AS point_id, pos, category, segment FROM f),
w AS (SELECT scene, point_id, arg_max(category, pos) AS category, arg_max(segment, pos) AS segment FROM e GROUP BY ALL)"""


def meshes(spark, sf_dir) -> str:
    """An ASCII mesh file for each scene; gives their glob."""
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part").withColumn("seq", F.col("p_partkey") % SCENES)
    nth = lambda *order: (F.row_number().over(Window.partitionBy("seq").orderBy(*order)) - 1).cast("long")
    vertices = part.select("seq", (nth("p_partkey") + 100).alias("n"), words("p_retailprice", "p_size", "p_partkey").alias("line"))
    sizes = part.groupBy("seq").agg(F.count("*").alias("v"))
    li = table(spark, sf_dir, "lineitem").withColumn("seq", F.col("l_orderkey") % SCENES).join(sizes, "seq")
    p, s, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("v")
    faces = li.select("seq", (nth("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey") + 10**12).alias("n"), words(F.lit(3), p % k, (p + s) % k, F.col("l_linenumber") % k, s % 25, p % 50).alias("line"))
    counts = sizes.join(li.groupBy("seq").agg(F.count("*").alias("f")), "seq")
    head = ["ply", "format ascii 1.0", words(F.lit("element vertex"), "v"), *(f"property double {c}" for c in "xyz"), words(F.lit("element face"), "f"), "property list uchar int vertex_indices", "property int category_id", "property int segment_id", "end_header"]
    top = counts.select("seq", F.posexplode(F.array(*(F.lit(x) if isinstance(x, str) else x for x in head))).alias("n", "line"))
    return as_text(spark, "mesh", top.unionByName(vertices).unionByName(faces))


def faces_of(spark, sf_dir) -> DataFrame:
    """Columns seq, face_pos, verts, category_id, segment of the meshes, read again."""
    path = meshes(spark, sf_dir)
    category, segment = (binary.scan(spark, "ply_faces", path, value=v).withColumn("seq", seq_of()) for v in ("category_id", "segment_id"))
    return category.join(segment.select("seq", "face_pos", F.col("segment_id").alias("segment")), ["seq", "face_pos"])


@query(f"WITH {FACES} SELECT scene, point_id, x, y, z FROM v WHERE scene IN (SELECT scene FROM f)")
def mesh_points(spark, sf_dir):
    return binary.scan(spark, "ply", meshes(spark, sf_dir)).select(seq_of().cast("long").alias("scene"), "point_id", "x", "y", "z")


@query(f"WITH {FACES} SELECT scene, pos AS face_pos, a, b, c, category, segment FROM f")
def mesh_faces(spark, sf_dir):
    found = faces_of(spark, sf_dir)
    return found.select(F.col("seq").cast("long").alias("scene"), "face_pos", *(F.col("verts")[i].cast("long").alias(c) for i, c in enumerate("abc")), F.col("category_id").alias("category"), "segment")


@query(f"""WITH {FACES}, g AS (SELECT n_nationkey AS id, unnest([2 * n_nationkey, 2 * n_nationkey + 1, n_nationkey + 5])::BIGINT AS segment FROM nation),
i AS (SELECT segment, max(id) AS id FROM g GROUP BY ALL), ok AS (SELECT n_nationkey AS category, n_regionkey AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name < 'E')
SELECT scene, point_id, CAST(coalesce(region, 0) * 1000 + id + 1 AS BIGINT) AS gt_id FROM w JOIN i USING (segment) LEFT JOIN ok USING (category)""")
def gt_from_faces(spark, sf_dir):
    """Instance numbers of vertices from the categories and segments of their last faces."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    seqs = F.explode(F.array(*(F.lit(str(i)) for i in range(SCENES)))).alias("seq")
    groups = n.select(seqs, k.alias("pos"), k.alias("id"), F.array(2 * k, 2 * k + 1, k + 5).alias("segments"))
    category = n.select(k.alias("row"), F.col("n_regionkey").alias("nyuId"))
    found = groundtruth.from_faces(faces_of(spark, sf_dir), groups, category, valid_regions(spark, sf_dir))
    return found.select(F.col("seq").cast("long").alias("scene"), "point_id", "gt_id")


# --- Images -----------------------------------------------------------------------------------------

#: Lines of orders as pixels of a small image for each supplier modulo 10.
PIXELS = "px AS (SELECT l_suppkey % 10 AS frame_id, CAST(l_linenumber AS BIGINT) AS v, l_partkey % 64 AS u, CAST(max(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY ALL)"
HEIGHT, WIDTH = 8, 64


def pictures(spark, sf_dir, times: int = 1) -> str:
    """The images as PNG files; gives their glob."""
    li = table(spark, sf_dir, "lineitem")
    px = li.groupBy(F.lit("s").alias("seq"), (F.col("l_suppkey") % 10).alias("frame_id"), F.col("l_linenumber").alias("v"), (F.col("l_partkey") % WIDTH).cast("int").alias("u")).agg((F.max("l_quantity") * times).cast("int").alias("mask_id"))
    made = images.masks_as_png(px, HEIGHT, WIDTH).select(F.concat(F.lit("frame_"), "frame_id", F.lit(".png")).alias("name"), "content")
    return f"{as_files(spark, 'pictures', made)}/*.png"


def frame_number() -> Column:
    return F.regexp_extract("path", r"frame_(\d+)", 1).cast("long")


@query(f"WITH {PIXELS} SELECT f AS frame_id, v, u, round(coalesce(value, 0) * 20 / 1000::DOUBLE, 4) AS depth FROM range(10) a(f) CROSS JOIN range({HEIGHT}) b(v) CROSS JOIN range({WIDTH}) c(u) LEFT JOIN px ON px.frame_id = f AND px.v = b.v AND px.u = c.u WHERE f IN (SELECT frame_id FROM px)".replace("b(v)", "b(y)").replace("c(u)", "c(x)").replace("px.v = b.v", "px.v = y").replace("px.u = c.u", "px.u = x").replace("f AS frame_id, v, u,", "f AS frame_id, y AS v, x AS u,"))
def depth_pixels(spark, sf_dir):
    """Depth in metres from 16-bit images."""
    return images.scan_depth(spark, pictures(spark, sf_dir, 20)).select(frame_number().alias("frame_id"), "v", "u", F.round(F.col("depth").cast("double"), 4).alias("depth"))


@query(f"WITH {PIXELS} SELECT frame_id, v, u, value AS mask_id FROM px WHERE value <> 0")
def segmentation_pixels(spark, sf_dir):
    return images.scan_segmentation(spark, pictures(spark, sf_dir)).where("mask_id <> 0").select(frame_number().alias("frame_id"), "v", "u", "mask_id")


@query(f"WITH {PIXELS} SELECT frame_id, v // 2 AS v, u // 2 AS u, value AS mask_id FROM px WHERE v % 2 = 0 AND u % 2 = 0")
def segmentation_resized(spark, sf_dir):
    found = images.scan_segmentation(spark, pictures(spark, sf_dir), (HEIGHT // 2, WIDTH // 2))
    return found.where("mask_id <> 0").select(frame_number().alias("frame_id"), "v", "u", "mask_id")


ROWS_SQL = f"""{PIXELS}, al AS (SELECT f AS frame_id, y AS v, x AS u, coalesce(value, 0) AS value FROM range(10) a(f) CROSS JOIN range({HEIGHT}) b(y) CROSS JOIN range({WIDTH}) c(x)
  LEFT JOIN px ON px.frame_id = f AND px.v = y AND px.u = x WHERE f IN (SELECT frame_id FROM px))"""


@query(f"WITH {ROWS_SQL} SELECT frame_id, {HEIGHT}::BIGINT AS height, {WIDTH}::BIGINT AS width, string_agg(printf('%02X', value), '' ORDER BY v, u) AS bytes FROM al GROUP BY frame_id")
def colour_images(spark, sf_dir):
    """Images by Spark's reader, rows of bytes."""
    return images.scan_rgb(spark, pictures(spark, sf_dir)).select(frame_number().alias("frame_id"), "height", "width", F.hex("data").alias("bytes"))


@query(f"""WITH {ROWS_SQL}, b AS (SELECT frame_id, value AS mask_id, min(u) AS u0, min(v) AS v0, max(u) AS u1, max(v) AS v1 FROM al WHERE value > 0 GROUP BY ALL),
s AS (SELECT *, greatest(u1 - u0, v1 - v0) AS side, (greatest(u1 - u0, v1 - v0) - (u1 - u0)) // 2 AS pl, (greatest(u1 - u0, v1 - v0) - (v1 - v0)) // 2 AS pt FROM b),
g AS (SELECT s.*, y, x FROM s, range({WIDTH}) a(y), range({WIDTH}) c(x) WHERE y < side AND x < side),
h AS (SELECT g.frame_id, g.mask_id, side, y, x, CASE WHEN x >= pl AND x < pl + u1 - u0 AND y >= pt AND y < pt + v1 - v0 THEN al.value ELSE 255 END AS value
  FROM g LEFT JOIN al ON al.frame_id = g.frame_id AND al.v = v0 + y - pt AND al.u = u0 + x - pl)
SELECT frame_id, mask_id, side, md5(string_agg(printf('%02X', value), '' ORDER BY y, x)) AS crop FROM h GROUP BY ALL""")
def crop_pixels(spark, sf_dir):
    """The pixels of each mask's box on a white square."""
    glob = pictures(spark, sf_dir)
    seg = images.scan_segmentation(spark, glob).select(F.lit("s").alias("seq"), frame_number().alias("frame_id"), "v", "u", "mask_id")
    boxes = views.mask_boxes(seg, F.lit(WIDTH), F.lit(HEIGHT), 1).where("side > 0")
    whole = images.scan_rgb(spark, glob).select(F.lit("s").alias("seq"), frame_number().alias("frame_id"), "height", "width", "channels", "data")
    return images.crops(whole, boxes).select("frame_id", "mask_id", "side", F.md5(F.hex("crop").cast("binary")).alias("crop"))


# --- Predictions and objects ------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, c_nationkey AS nation, CAST(o_orderpriority[1] AS INT) AS priority FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT nation AS inst, o_orderkey AS point_id FROM o WHERE priority > nation % 5)
SELECT CAST(n_nationkey AS BIGINT) AS inst, CAST(n_regionkey + 1 AS BIGINT) AS class_id, round(1.0 / (1 + n_nationkey % 3), 6)::DOUBLE AS score, point_id FROM nation LEFT JOIN p ON inst = n_nationkey""")
def prediction_archives(spark, sf_dir):
    """Predictions written as an archive of masks, scores and classes, and read again."""
    pred, meta = adapters.nations_pred(spark, sf_dir)
    scene = adapters.nations_gt(spark, sf_dir).select("seq", "point_id")
    made = binary.prediction_archive(pred, meta, scene).select("name", "content")
    points, found = binary.scan_predictions(spark, f"{as_files(spark, 'archive', made)}/*")
    return found.join(points, ["seq", "inst"], "left").select("inst", "class_id", F.round("score", 6).alias("score"), "point_id")


@query("""WITH o AS (SELECT c_nationkey AS nation, CAST(o_orderpriority[1] AS INT) AS priority FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CAST(nation AS BIGINT) AS scene, count(*) AS points FROM o WHERE nation IN (SELECT nation FROM o WHERE priority > nation % 5) GROUP BY ALL""")
def prediction_pairs(spark, sf_dir):
    """Nations as scenes: those with predictions, each with the size of its ground truth; one without would be an error."""
    of = adapters.orders_of_nations(spark, sf_dir).withColumn("seq", F.col("nation").cast("string"))
    gt = of.groupBy("seq").agg(F.count("*").alias("points"))
    return evaluation.require_pairs(of.where(F.col("priority") > F.col("nation") % 5), gt).join(gt, "seq").select(F.col("seq").cast("long").alias("scene"), "points")


def objects_of_parts(spark, sf_dir) -> DataFrame:
    """Parts of a type as an object, its brands as masks."""
    p = table(spark, sf_dir, "part").withColumn("object_id", F.crc32(F.col("p_type").cast("binary")))
    one = p.groupBy(F.lit("s").alias("seq"), "object_id").agg(F.sort_array(F.collect_set("p_partkey")).alias("point_ids"), F.sort_array(F.collect_set(F.struct(F.length("p_brand").alias("frame_id"), F.col("p_size").alias("mask_id")))).alias("mask_list"))
    return one.withColumn("repre_mask_list", F.slice("mask_list", 1, 5))


@query("""WITH t AS (SELECT p_type, list_sort(list(DISTINCT p_partkey)) AS points, list_sort(list(DISTINCT {'a': length(p_brand), 'b': p_size})) AS masks FROM part GROUP BY p_type)
SELECT points[1] AS first_point, len(points) AS points, len(masks) AS masks, least(len(masks), 5)::BIGINT AS representatives FROM t""")
def object_tables(spark, sf_dir):
    """Objects, a part type each, written by scene and read again."""
    root = f"{Scratch(spark, 'objects').root}/objects"
    sinks.write_scenes(objects_of_parts(spark, sf_dir), root)
    size = lambda c: F.size(c).cast("long")
    return spark.read.parquet(root).select(F.col("point_ids")[0].alias("first_point"), size("point_ids").alias("points"), size("mask_list").alias("masks"), size("repre_mask_list").alias("representatives"))


@query("SELECT label AS scene, vec_id, i - 1 AS i, CAST(x AS DOUBLE) AS x FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def feature_tables(spark, sf_dir):
    """Features of masks, a label a scene, written by scene and read again."""
    root = f"{Scratch(spark, 'features').root}/features"
    sinks.write_scenes(table(spark, sf_dir, "embeddings").select(F.col("label").alias("seq"), "vec_id", "embedding"), root)
    found = spark.read.parquet(root).select(F.col("seq").cast("long").alias("scene"), "vec_id", F.posexplode("embedding").alias("i", "x"))
    return found.select("scene", "vec_id", "i", F.col("x").cast("double").alias("x"))


@query("SELECT vec_id, label AS scene FROM embeddings WHERE label % 2 = 0 UNION ALL SELECT -vec_id - 1, label FROM embeddings WHERE label % 2 = 1")
def replaced_scenes(spark, sf_dir):
    """Scenes written once more replace what was there of them; the others stay."""
    root = f"{Scratch(spark, 'replaced').root}/features"
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("seq"), "vec_id")
    sinks.write_scenes(e, root)
    sinks.write_scenes(e.where("seq % 2 = 1").withColumn("vec_id", -F.col("vec_id") - 1), root)
    return spark.read.parquet(root).select("vec_id", F.col("seq").cast("long").alias("scene"))


@query("SELECT vec_id, label AS scene FROM embeddings WHERE label % 3 <> 0")
def removed_scenes(spark, sf_dir):
    """Scenes whose outputs are removed are gone; the others stay."""
    root = f"{Scratch(spark, 'removed').root}/features"
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("seq"), "vec_id")
    sinks.write_scenes(e, root)
    sinks.remove_scenes(spark, root, [str(r.seq) for r in e.where("seq % 3 = 0").select("seq").distinct().collect()])
    return spark.read.parquet(root).select("vec_id", F.col("seq").cast("long").alias("scene"))


#: Images of a row for each line number and a column for each part modulo 64, side by side with the colours of their values, at half size.
@query(f"""WITH {ROWS_SQL}, c AS (SELECT frame_id, v // 2 AS y, u // 2 AS x, value, CAST(value AS INT) AS i FROM al WHERE v % 2 = 0 AND u % 2 = 0)
SELECT frame_id, y, x, value AS r, value AS g, value AS b FROM c UNION ALL
SELECT frame_id, y, x + {WIDTH // 2}, (i & 1) * 128 + ((i >> 3) & 1) * 64 + ((i >> 6) & 1) * 32, ((i >> 1) & 1) * 128 + ((i >> 4) & 1) * 64 + ((i >> 7) & 1) * 32, ((i >> 2) & 1) * 128 + ((i >> 5) & 1) * 64 FROM c""")
def mask_pictures(spark, sf_dir):
    glob = pictures(spark, sf_dir)
    whole = images.scan_rgb(spark, glob).select(F.lit("s").alias("seq"), frame_number().alias("frame_id"), "height", "width", "channels", "data")
    labels = images.scan_segmentation(spark, glob).where("mask_id <> 0").select(F.lit("s").alias("seq"), frame_number().alias("frame_id"), "v", "u", *(c.alias(n) for c, n in zip(geometry.palette(F.col("mask_id")), "rgb")))

    def pixels(batches):
        for batch in batches:
            for frame, content in zip(batch["frame_id"], batch["content"]):
                image = images.decode_png(content)
                y, x = (k.ravel() for k in np.indices(image.shape[:2]))
                yield pd.DataFrame({"frame_id": frame, "y": y, "x": x, **{c: image[:, :, k].ravel() for k, c in enumerate("rgb")}})

    return images.mask_pictures(whole, labels).mapInPandas(pixels, "frame_id long, y long, x long, r long, g long, b long")


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS content FROM supplier WHERE s_suppkey % 2 = 0")
def copied_files(spark, sf_dir):
    """Half of the files of a folder, a supplier each, copied to another one and read there."""
    s = table(spark, sf_dir, "supplier")
    root = as_files(spark, "clouds", s.select(F.concat(F.lit("even/"), "s_suppkey", F.lit(".txt")).alias("name"), F.col("s_name").cast("binary").alias("content")).where("s_suppkey % 2 = 0")
                    .unionByName(s.where("s_suppkey % 2 = 1").select(F.concat(F.lit("odd/"), "s_suppkey", F.lit(".txt")).alias("name"), F.col("s_name").cast("binary").alias("content"))))
    to = f"{Scratch(spark, 'copies').root}/copies"
    sinks.copy_files(spark, f"{root}/even/*.txt", to)
    found = spark.read.format("binaryFile").load(f"{to}/*.txt")
    return found.select(stem().cast("long").alias("id"), F.col("content").cast("string").alias("content"))


@query("SELECT p_partkey AS point_id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 7 END AS class_id, 1.0::DOUBLE AS score FROM part")
def predictions_of_objects(spark, sf_dir):
    """Each part an object; classes are known of two thirds of them."""
    p = table(spark, sf_dir, "part").select(F.lit("s").alias("seq"), F.col("p_partkey").alias("object_id"), F.array("p_partkey").alias("point_ids"))
    known = p.where("object_id % 3 <> 0").select("seq", "object_id", (F.col("object_id") % 7).alias("class_id"))
    points, meta = sinks.predictions(p, known)
    return points.join(meta, ["seq", "inst"]).select("point_id", "class_id", "score")


@query("""WITH o AS (SELECT vec_id // 5 AS object_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
f AS (SELECT object_id, i, avg(CAST(x AS DOUBLE)) AS x FROM o GROUP BY ALL),
t AS (SELECT CAST(label AS BIGINT) AS idx, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY ALL)),
s AS (SELECT object_id, idx, sum(f.x * CAST(t.x AS DOUBLE)) AS similarity FROM f JOIN t USING (i) GROUP BY ALL)
SELECT object_id, CASE WHEN object_id % 7 = 0 THEN 0 ELSE idx + 10 END AS class_id FROM s QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY similarity DESC, idx) = 1""")
def open_vocabulary_classes(spark, sf_dir):
    """Classes of objects by the features of their representative masks; an object without any has class 0."""
    e = table(spark, sf_dir, "embeddings").select(F.lit("s").alias("seq"), F.floor(F.col("vec_id") / 5).alias("object_id"), F.col("vec_id").alias("frame_id"), F.lit(1).alias("mask_id"), F.col("embedding").alias("v"))
    own = F.collect_list(F.struct("frame_id", "mask_id"))
    objects = e.groupBy("seq", "object_id").agg(own.alias("m")).select("seq", "object_id", F.when(F.col("object_id") % 7 == 0, F.slice("m", 1, 0)).otherwise(F.col("m")).alias("repre_mask_list"))
    labels = adapters.label_features(spark, sf_dir)
    return openvoc.classify(objects, e, labels, labels.select("label", (F.col("idx") + 10).alias("label_id"))).select("object_id", "class_id")


@query("SELECT vec_id, i - 1 AS i, round(CAST(x AS DOUBLE) / sqrt(n), 6) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i, list_sum([CAST(y AS DOUBLE) * y FOR y IN embedding]) AS n FROM embeddings)")
def unit_vectors(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("v"))
    return found.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


@query(f"WITH {PIXELS} SELECT frame_id, v, u, coalesce(value, 0) AS value FROM (SELECT DISTINCT frame_id FROM px) CROSS JOIN range({HEIGHT}) a(v) CROSS JOIN range({WIDTH}) b(u) LEFT JOIN px USING (frame_id, v, u) WHERE frame_id BETWEEN 2 AND 6")
def dataset_frames(spark, sf_dir):
    """Depth images of one scene of a dataset, read by the dataset's name; other scenes and frames stay unread."""
    glob = pictures(spark, sf_dir)
    root = f"{Scratch(spark, 'dataset').root}/scenes"
    made = spark.read.format("binaryFile").load(glob).select(frame_number().alias("id"), "content")
    broken = made.select(F.concat(F.lit("s2/depth/"), "id", F.lit(".png")).alias("name"), F.lit(b"not an image").alias("content"))
    sinks.write_files(made.select(F.concat(F.lit("s1/depth/"), "id", F.lit(".png")).alias("name"), "content").unionByName(broken), root)
    datasets.register(spark)
    found = spark.read.format("tessera_frames").option("dataset", "scannet").option("root", stores.reachable(spark, root)).option("bytes", 1).load()
    return found.where("seq = 's1' AND frame_id >= 2 AND frame_id <= 6").select("frame_id", "v", "u", "value")


# --- Sensor streams ---------------------------------------------------------------------------------


def streams(spark, sf_dir) -> str:
    """A stream for each region, its nations as frames: depth the nation's number and its region's."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import struct
        import zlib

        region, unit = int(pdf["n_regionkey"].iloc[0]), [float(i % 5 == 0) for i in range(16)]
        header = {"sensor": f"region {region}", "intrinsic_color": [float(i + region) for i in range(16)], "extrinsic_color": unit, "intrinsic_depth": [float(2 * i) for i in range(16)], "extrinsic_depth": unit}
        header |= {"color_codec": "jpeg", "depth_codec": "zlib_ushort", "color_width": 1, "color_height": 1, "depth_width": 2, "depth_height": 1, "depth_shift": 1000.0}
        frames_ = [
            {"pose": [float(k)] * 16, "ts_color": 10 * k, "ts_depth": 10 * k + 1, "color": name.encode(), "depth": zlib.compress(struct.pack("<2H", k, region))}
            for k, name in sorted(zip(pdf["n_nationkey"].tolist(), pdf["n_name"]))
        ]
        return pd.DataFrame({"name": [f"region{region}.sens"], "content": [binary.encode_sens(header, frames_)]})

    made = n.groupBy("n_regionkey").applyInPandas(run, "name string, content binary")
    return f"{as_files(spark, 'streams', made)}/*.sens"


SENS_SQL = "SELECT CAST(n_regionkey AS BIGINT) AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS idx, n_nationkey, n_name, n_regionkey FROM nation"


def region() -> Column:
    return F.regexp_extract("path", r"region(\d+)", 1).cast("long").alias("region")


@query(f"SELECT region, idx, n_nationkey::DOUBLE AS pose0, 10 * n_nationkey::BIGINT AS ts_color, 10 * n_nationkey::BIGINT + 1 AS ts_depth, n_name AS color FROM ({SENS_SQL})")
def stream_frames(spark, sf_dir):
    found = binary.scan(spark, "sens", streams(spark, sf_dir))
    return found.select(region(), "idx", F.col("pose")[0].cast("double").alias("pose0"), "ts_color", "ts_depth", F.col("color").cast("string").alias("color"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS region, 'region ' || r_regionkey AS sensor, 'jpeg' AS color_codec, 'zlib_ushort' AS depth_codec, 2::BIGINT AS depth_width, 1000.0::DOUBLE AS depth_shift, (4 + r_regionkey)::DOUBLE AS k4 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def stream_headers(spark, sf_dir):
    found = binary.scan(spark, "sens_header", streams(spark, sf_dir))
    return found.select(region(), "sensor", "color_codec", "depth_codec", "depth_width", "depth_shift", F.col("intrinsic_color")[4].cast("double").alias("k4"))


@query(f"SELECT region, idx, u, CASE u WHEN 0 THEN n_nationkey ELSE n_regionkey END / 1000::DOUBLE AS depth, n_nationkey::DOUBLE AS pose0 FROM ({SENS_SQL}) CROSS JOIN range(2) t(u) WHERE idx % 2 = 0")
def exported_streams(spark, sf_dir):
    """Every second frame of the streams exported as files: depth images and pose files, read again."""
    root = f"{Scratch(spark, 'export').root}/export"
    binary.export_sens(spark, streams(spark, sf_dir), root, 2)
    number = stem().cast("long").alias("idx")
    depth = images.scan_depth(spark, f"{root}/*/depth/*.png").select(region(), number, "u", "depth")
    poses = layouts.scan_matrix(spark, f"{root}/*/pose/*.txt").select(region(), number, F.col("pose")[0].alias("pose0"))
    return depth.join(poses, ["region", "idx"]).select("region", "idx", "u", F.round(F.col("depth").cast("double"), 6).alias("depth"), "pose0")


# --- Lifting and geometry ---------------------------------------------------------------------------

FEW = Params(few_points=2)
LIFT_SQL = """WITH p AS (SELECT l_orderkey AS frame_id, CAST(l_linenumber AS BIGINT) AS v, l_partkey % 640 AS u, l_quantity / 2 - 2 AS d, l_suppkey % 3 AS mask_id FROM lineitem),
c AS (SELECT *, (u - 320.0::DOUBLE) * d / 500 AS cx, (v - 240.0::DOUBLE) * d / 510 AS cy FROM p WHERE mask_id <> 0 AND d > 0 AND d < 20 AND frame_id % 5 <> 0),
k AS (SELECT frame_id, mask_id FROM c GROUP BY ALL HAVING count(*) >= 2)"""


@query(LIFT_SQL + " SELECT frame_id, mask_id, round(cx + 1, 5) AS x, round(cy + 2, 5) AS y, round(d + 3, 5) AS z, count(*) AS n FROM c JOIN k USING (frame_id, mask_id) GROUP BY ALL")
def labelled_world_points(spark, sf_dir):
    """World points of labelled pixels: background, odd depths, frames without a finite pose and masks of one point are left out."""
    li = table(spark, sf_dir, "lineitem")
    pixels = li.select(F.lit("s").alias("seq"), F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("v"), (F.col("l_partkey") % 640).alias("u"), (F.col("l_quantity") / 2 - 2).alias("depth"), (F.col("l_suppkey") % 3).alias("mask_id"))
    d = lambda x: F.lit(float(x))
    odd = F.when(F.col("frame_id") % 5 == 0, d("inf")).otherwise(d(1))
    pose = F.array(d(1), d(0), d(0), odd, d(0), d(1), d(0), d(2), d(0), d(0), d(1), d(3), d(0), d(0), d(0), d(1))
    intr = F.struct(d(500).alias("fx"), d(510).alias("fy"), d(320).alias("cx"), d(240).alias("cy"))
    cameras = pixels.select("seq", "frame_id").distinct().select("seq", "frame_id", intr.alias("intr"), pose.alias("pose"))
    found = lifting.mask_points(pixels, cameras, FEW)
    return found.groupBy("frame_id", "mask_id", *(F.round(c, 5).alias(c) for c in "xyz")).agg(F.count("*").alias("n"))


@query("""WITH pts AS (SELECT vec_id AS id, label, vec_id % 2 AS frame_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
near AS (SELECT a.id, a.frame_id, a.label, b.id AS r_id FROM pts a JOIN pts b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.01 AND b.id % 3 = 0
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.id) <= 4),
cov AS (SELECT frame_id, label, count(DISTINCT near.id) AS hit FROM near GROUP BY ALL), tot AS (SELECT frame_id, label, count(*) AS n FROM pts GROUP BY ALL)
SELECT DISTINCT frame_id, CAST(label AS BIGINT) AS mask_id, r_id AS point_id FROM near JOIN cov USING (frame_id, label) JOIN tot USING (frame_id, label) WHERE hit / n >= 0.3""")
def covered_masks(spark, sf_dir):
    """Incidences of masks with scene points near enough of their points; the scene is every third vector."""
    e = adapters.vectors_as_points(spark, sf_dir)
    points = e.select("seq", (F.col("point_id") % 2).alias("frame_id"), F.col("label").alias("mask_id"), "point_id", "x", "y", "z")
    scene = e.where("point_id % 3 = 0").select("seq", "point_id", "x", "y", "z")
    return lifting.near_points(points, scene, Params(distance=0.1, neighbours=4, coverage=0.3)).select("frame_id", "mask_id", "point_id")


@query("""WITH b AS (SELECT s_suppkey AS i, s_acctbal AS lo, s_acctbal + 100 + s_nationkey AS hi, s_nationkey::DOUBLE AS la, s_nationkey + 1.0 AS ha FROM supplier)
SELECT a.i, b.i AS j FROM b a JOIN b ON a.i < b.i WHERE a.lo <= b.hi AND b.lo <= a.hi AND a.la <= b.ha AND b.la <= a.ha""")
def touching_boxes(spark, sf_dir):
    """Pairs of suppliers whose boxes of balance and nation touch: joined on the nation's number, as no box is wider than one."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 100 + F.col("s_nationkey")).alias("hi"), F.col("s_nationkey").alias("k"))
    other = s.select(*(F.col(c).alias(f"_{c}") for c in s.columns))
    box = lambda p: {"b": (F.col(f"{p}lo"), F.col(f"{p}hi")), "n": (F.col(f"{p}k").cast("double"), F.col(f"{p}k") + 1.0)}
    near = s.withColumn("at", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)))
    met = near.join(other, F.col("at") == F.col("_k")).where(F.col("i") < F.col("_i"))
    return met.where(geometry.boxes_touch(box(""), box("_"))).select("i", F.col("_i").alias("j"))


@query("SELECT p_partkey, CAST(greatest(p_size, p_partkey % 50) AS BIGINT) AS side, CAST((greatest(p_size, p_partkey % 50) - p_size) // 2 AS BIGINT) AS pad_left, CAST((greatest(p_size, p_partkey % 50) - p_partkey % 50) // 2 AS BIGINT) AS pad_top FROM part")
def square_padding(spark, sf_dir):
    side, left, top = geometry.square_padding(F.col("p_size"), F.col("p_partkey") % 50)
    return table(spark, sf_dir, "part").select("p_partkey", side.cast("long").alias("side"), left.alias("pad_left"), top.alias("pad_top"))


@query("SELECT p_partkey, round(pow(p_size / 50, 1 / 2.2), 6) AS shade FROM part")
def gamma_curve(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part"), "p_partkey", shade=geometry.gamma(F.col("p_size") / 50))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CAST(CAST(l_quantity * 10 AS FLOAT) / CAST(4000 AS FLOAT) AS DOUBLE) > 0.05 AS near, l_quantity / 2 - 2 > 0 AND l_quantity / 2 - 2 < 20 AS valid FROM lineitem")
def depth_values(spark, sf_dir):
    """Stored depths in metres and the valid ones among depths."""
    metres = geometry.depth_metres(F.col("l_quantity") * 10, 4000.0).cast("double")
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", (metres > 0.05).alias("near"), geometry.valid_depth(F.col("l_quantity") / 2 - 2).alias("valid"))


@query("SELECT vec_id, vec_id % 11 <> 0 AS usable FROM embeddings")
def usable_poses(spark, sf_dir):
    odd = F.when(F.col("vec_id") % 22 == 0, float("inf")).when(F.col("vec_id") % 11 == 0, float("-inf"))
    pose = F.transform(F.slice("embedding", 1, 16), lambda x, i: F.when(i == F.col("vec_id") % 16, F.coalesce(odd, x.cast("double"))).otherwise(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", geometry.valid_pose(pose).alias("usable"))


# --- Streams of incidences, whole runs ----------------------------------------------------------------


@query("SELECT DISTINCT l_suppkey AS frame_id, CAST(l_linenumber AS BIGINT) AS mask_id, l_partkey AS point_id FROM lineitem")
def streamed_incidence(spark, sf_dir):
    """Incidences that arrive as files, some of them twice, gathered by a stream."""
    scratch = Scratch(spark, "stream")
    inc = adapters.lineitem(spark, sf_dir).select(incidence.KEYS)
    inc.write.parquet(f"{scratch.root}/in/a")
    inc.where("point_id % 3 = 0").write.parquet(f"{scratch.root}/in/b")
    stream = spark.readStream.schema(inc.schema).parquet(f"{scratch.root}/in/*")
    ingest(stream, f"{scratch.root}/table", f"{scratch.root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{scratch.root}/table").select("frame_id", "mask_id", "point_id")


def streamed_changes(spark, sf_dir) -> DataFrame:
    """What a stream of the documents' lines, some of which come again, changes."""
    scratch = Scratch(spark, "points")
    inc = adapters.docs_lines(spark, sf_dir).select(incidence.KEYS)
    for n, part in enumerate(("pmod(mask_id, 3) <> 1", "pmod(mask_id, 3) <> 2")):
        inc.where(part).write.parquet(f"{scratch.root}/in/{n}")
    stream = spark.readStream.schema(inc.schema).option("maxFilesPerTrigger", 8).parquet(f"{scratch.root}/in/*")
    points.follow(stream, f"{scratch.root}/changes", f"{scratch.root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{scratch.root}/changes")


LINES_SQL = r"inc AS (SELECT DISTINCT CAST(regexp_extract(source, '\d+') AS BIGINT) AS frame_id, doc_id AS mask_id, unnest(string_split(text, chr(10))) AS point_id FROM documents), bnd AS (SELECT DISTINCT point_id FROM (SELECT point_id FROM inc GROUP BY point_id, frame_id HAVING count(*) > 1))"


@query(f"WITH {LINES_SQL} SELECT point_id FROM bnd")
def streamed_boundary(spark, sf_dir):
    """Boundary points of a stream, from the state of each point."""
    return points.boundary(streamed_changes(spark, sf_dir)).select("point_id")


@query(f"""WITH {LINES_SQL}, i AS (SELECT * FROM inc WHERE point_id NOT IN (SELECT point_id FROM bnd))
SELECT a.frame_id AS frame_a, a.mask_id AS mask_a, b.frame_id AS frame_b, b.mask_id AS mask_b, count(*) AS k FROM i a JOIN i b USING (point_id) GROUP BY ALL""")
def streamed_overlaps(spark, sf_dir):
    """Points that each two masks share, as the sum of a stream's changes."""
    return points.overlaps(streamed_changes(spark, sf_dir)).drop("seq")
