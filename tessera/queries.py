"""Registered queries of the library and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry, vectors
from tessera.operators import clustering, components, consensus, containment, evaluation, groundtruth, incidence, lifting, openvoc, postprocess, runs, spatial
from tessera.plans.config import PRESETS, Params
from tessera.plans.scratch import Scratch
from tessera.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from tessera.sources import adapters
from tessera.sources.adapters import table

DOCS = PRESETS["scannet"]
#: Settings under which the lineitem table keeps masks and runs many rounds.
PARTS = Params(mask_visible_threshold=0.3, undersegment_filter_threshold=0.9, view_consensus_threshold=0.5, contained_threshold=0.3)

# --- SQL of the oracles --------------------------------------------------------------------------

INC = {
    "docs": "SELECT DISTINCT CAST(regexp_extract(source, '\\d+') AS BIGINT) AS frame_id, doc_id AS mask_id, unnest(string_split(text, chr(10))) AS point_id FROM documents",
    "parts": "SELECT DISTINCT l_suppkey AS frame_id, CAST(l_linenumber AS BIGINT) AS mask_id, l_partkey AS point_id FROM lineitem",
    "events": "SELECT DISTINCT CAST(ts AS DATE) AS frame_id, event_type AS mask_id, user_id AS point_id FROM events",
}
PERCENTS = ", ".join(str(p / 100) for p in consensus.PERCENTILES)


def base_sql(name: str, p: Params) -> str:
    """Common table expressions from incidences to contained masks, observers and thresholds."""
    return f"""
WITH RECURSIVE inc AS ({INC[name]}),
bnd AS (SELECT DISTINCT point_id FROM (SELECT point_id, frame_id FROM inc GROUP BY ALL HAVING count(*) > 1)),
pf AS (SELECT DISTINCT point_id, frame_id FROM inc),
msk AS (SELECT row_number() OVER (ORDER BY frame_id, mask_id) - 1 AS gid, frame_id, mask_id FROM (SELECT DISTINCT frame_id, mask_id FROM inc)),
ins AS (SELECT m.gid, m.frame_id, i.point_id FROM inc i JOIN msk m USING (frame_id, mask_id) WHERE i.point_id NOT IN (SELECT point_id FROM bnd)),
ov AS (SELECT a.gid, b.frame_id, b.gid AS by_gid, count(*) AS k FROM ins a JOIN ins b ON a.point_id = b.point_id GROUP BY ALL),
sz AS (SELECT msk.gid, count(ins.point_id) AS n FROM msk LEFT JOIN ins USING (gid) GROUP BY msk.gid),
fr AS (SELECT gid, frame_id, by_gid AS best, k, CAST(sum(k) OVER (PARTITION BY gid, frame_id) AS BIGINT) AS seen FROM ov
  QUALIFY row_number() OVER (PARTITION BY gid, frame_id ORDER BY k DESC, by_gid) = 1),
vis AS (SELECT fr.*, n FROM fr JOIN sz USING (gid) WHERE NOT (1 - (n - seen) / n < {p.mask_visible_threshold}::DOUBLE AND seen < {p.visible_points})),
con0 AS (SELECT gid, best AS by_gid FROM vis WHERE k / seen > {p.contained_threshold}::DOUBLE),
val AS (SELECT gid, visible_num, split_num, visible_num > 0 AND coalesce(split_num / nullif(visible_num, 0), 0) <= {p.undersegment_filter_threshold}::DOUBLE AS valid FROM
  (SELECT msk.gid, count(vis.gid) AS visible_num, count(*) FILTER (WHERE NOT (vis.k / vis.seen > {p.contained_threshold}::DOUBLE)) AS split_num FROM msk LEFT JOIN vis USING (gid) GROUP BY msk.gid)),
con AS (SELECT * FROM con0 WHERE by_gid NOT IN (SELECT gid FROM val WHERE NOT valid)),
vf AS (SELECT DISTINCT con.gid, msk.frame_id FROM con JOIN msk ON con.by_gid = msk.gid),
ob AS (SELECT a.gid AS i, b.gid AS j, count(*) AS observers FROM vf a JOIN vf b USING (frame_id) GROUP BY ALL),
th AS (SELECT pos - 1 AS round, greatest(v, 1.0::DOUBLE) AS threshold FROM
  (SELECT unnest(q) AS v, generate_subscripts(q, 1) AS pos FROM (SELECT quantile_cont(observers, [{PERCENTS}]) AS q FROM ob)) WHERE pos <= 10 OR v > 1),
nd0 AS (SELECT gid AS node, gid FROM val WHERE valid)"""


def rounds_sql(k: int, p: Params) -> str:
    """The nodes of k rounds, as nd1 .. ndk, with their links e1 .. ek."""
    out = ""
    for r in range(1, k + 1):
        out += f""",
nv{r} AS (SELECT DISTINCT node, frame_id FROM nd{r - 1} JOIN vf USING (gid)),
nc{r} AS (SELECT DISTINCT node, by_gid FROM nd{r - 1} JOIN con USING (gid)),
o{r} AS (SELECT a.node AS i, b.node AS j, count(*) AS o FROM nv{r} a JOIN nv{r} b ON a.frame_id = b.frame_id AND a.node < b.node GROUP BY ALL),
s{r} AS (SELECT a.node AS i, b.node AS j, count(*) AS s FROM nc{r} a JOIN nc{r} b ON a.by_gid = b.by_gid AND a.node < b.node GROUP BY ALL),
e{r} AS (SELECT i, j FROM o{r} JOIN s{r} USING (i, j) WHERE o >= (SELECT threshold FROM th WHERE round = {r - 1})
  AND CAST(s AS FLOAT) / (CAST(o AS FLOAT) + CAST(1e-7 AS FLOAT)) >= CAST({p.view_consensus_threshold} AS FLOAT)),
y{r} AS (SELECT i, j FROM e{r} UNION SELECT j, i FROM e{r}),
c{r}(i, j) AS (SELECT DISTINCT node, node FROM nd{r - 1} UNION SELECT c{r}.i, y{r}.j FROM c{r} JOIN y{r} ON c{r}.j = y{r}.i),
m{r} AS (SELECT i, min(j) AS head FROM c{r} GROUP BY i),
nd{r} AS (SELECT head AS node, gid FROM nd{r - 1} JOIN m{r} ON i = node)"""
    return out


DOCS_SQL, PARTS_SQL = base_sql("docs", DOCS), base_sql("parts", PARTS)


# --- Incidences and containment ------------------------------------------------------------------


def docs_state(spark: SparkSession, sf_dir: str):
    """(incidences, masks, contained, validity, visible frames) of the documents."""
    scratch = Scratch(spark, "docs")
    inc = scratch.save(adapters.docs_points(spark, sf_dir), "incidence")
    masks = scratch.save(incidence.masks(inc), "masks")
    contained, valid = containment.containment(inc, masks, DOCS, scratch)
    contained, valid = scratch.save(contained, "contained"), scratch.save(valid, "valid")
    return inc, masks, contained, valid, containment.visible_frames(contained, masks)


@query(DOCS_SQL + " SELECT point_id FROM bnd")
def boundary_points(spark, sf_dir):
    return incidence.boundary(adapters.docs_lines(spark, sf_dir)).select("point_id")


@query(DOCS_SQL + " SELECT point_id, frame_id FROM pf")
def point_frame(spark, sf_dir):
    return incidence.point_frame(adapters.docs_lines(spark, sf_dir)).select("point_id", "frame_id")


@query(DOCS_SQL + " SELECT gid, frame_id, mask_id FROM msk")
def mask_index(spark, sf_dir):
    return incidence.masks(adapters.docs_lines(spark, sf_dir)).select("gid", "frame_id", "mask_id")


@query(DOCS_SQL + " SELECT gid, frame_id, by_gid, k FROM ov")
def mask_overlap_hist(spark, sf_dir):
    inc = adapters.docs_lines(spark, sf_dir)
    return containment.overlaps(inc, incidence.masks(inc)).select("gid", "frame_id", "by_gid", "k")


@query(PARTS_SQL + " SELECT gid, frame_id, best, k, seen, n FROM vis")
def visible_ratio(spark, sf_dir):
    inc = adapters.lineitem(spark, sf_dir)
    masks = incidence.masks(inc)
    return containment.visible_masks(inc, masks, PARTS).select("gid", "frame_id", "best", "k", "seen", "n")


@query(DOCS_SQL + " SELECT gid, by_gid FROM con0")
def contained_masks(spark, sf_dir):
    inc = adapters.docs_lines(spark, sf_dir)
    masks = incidence.masks(inc)
    seen = containment.visible_masks(inc, masks, DOCS)
    return containment.contained_once(seen, DOCS).select("gid", "by_gid")


@query(PARTS_SQL + " SELECT gid, visible_num, split_num, valid FROM val")
def undersegmented(spark, sf_dir):
    inc = adapters.lineitem(spark, sf_dir)
    masks = incidence.masks(inc)
    seen = containment.visible_masks(inc, masks, PARTS)
    return containment.validity(seen, masks, PARTS).select("gid", "visible_num", "split_num", "valid")


@query(DOCS_SQL + " SELECT gid, by_gid FROM con")
def contained_after_undo(spark, sf_dir):
    return docs_state(spark, sf_dir)[2].select("gid", "by_gid")


@query(base_sql("events", DOCS) + " SELECT gid, valid FROM val")
def degenerate_scene(spark, sf_dir):
    """All users are boundary points: every mask is invalid."""
    inc = adapters.events(spark, sf_dir)
    return containment.containment(inc, incidence.masks(inc), DOCS)[1].select("gid", "valid")


# --- Consensus and clustering --------------------------------------------------------------------


@query(DOCS_SQL + " SELECT i, j, observers FROM ob")
def observer_counts(spark, sf_dir):
    return consensus.observers(docs_state(spark, sf_dir)[4], ordered=True).select("i", "j", "observers")


@query(PARTS_SQL + " SELECT round, round(threshold, 6) AS threshold FROM th")
def observer_thresholds(spark, sf_dir):
    inc = adapters.lineitem(spark, sf_dir)
    masks = incidence.masks(inc)
    found = consensus.thresholds(containment.visible_frames(containment.containment(inc, masks, PARTS)[0], masks))
    return found.select("round", F.round("threshold", 6).alias("threshold"))


@query(DOCS_SQL + " SELECT a.gid AS i, b.gid AS j, count(*) AS supporters FROM con a JOIN con b USING (by_gid) GROUP BY ALL")
def supporter_counts(spark, sf_dir):
    return consensus.supporters(docs_state(spark, sf_dir)[2], ordered=True).select("i", "j", "supporters")


@query(DOCS_SQL + rounds_sql(1, DOCS) + " SELECT i, j FROM e1")
def consensus_edges(spark, sf_dir):
    _, _, contained, valid, visible = docs_state(spark, sf_dir)
    nodes = clustering.start(valid)
    least = consensus.thresholds(visible).where("round = 0")
    rows = lambda r, c: clustering.node_rows(nodes, r, c)
    found = consensus.links_at(consensus.agreeing(rows(contained, "by_gid"), rows(visible, "frame_id"), DOCS.view_consensus_threshold), least)
    return found.select("i", "j")


@query(DOCS_SQL + rounds_sql(1, DOCS) + " SELECT i AS node, head AS component FROM m1")
def components_round1(spark, sf_dir):
    _, _, contained, valid, visible = docs_state(spark, sf_dir)
    scratch = Scratch(spark, "round1")
    nodes = clustering.start(valid)
    after = clustering.one_round(nodes, contained, visible, consensus.thresholds(visible).where("round = 0"), DOCS.view_consensus_threshold, scratch)
    return after.select(F.col("gid").alias("node"), F.col("node").alias("component"))


@query(DOCS_SQL + rounds_sql(1, DOCS) + " SELECT DISTINCT node, by_gid FROM nd1 JOIN con USING (gid)")
def merge_round1(spark, sf_dir):
    _, _, contained, valid, visible = docs_state(spark, sf_dir)
    after = clustering.one_round(clustering.start(valid), contained, visible, consensus.thresholds(visible).where("round = 0"), DOCS.view_consensus_threshold, Scratch(spark, "round1"))
    return clustering.node_rows(after, contained, "by_gid").select("node", "by_gid")


@query(DOCS_SQL + rounds_sql(3, DOCS) + " SELECT node, gid FROM nd3")
def clusters_k3(spark, sf_dir):
    """Flagship: near-duplicate documents of several sources as one object."""
    return clustering.cluster(adapters.docs_points(spark, sf_dir), DOCS, rounds=3)[0].select("node", "gid")


FLAGSHIP = clusters_k3


@query(PARTS_SQL + rounds_sql(2, PARTS) + " SELECT node, gid FROM nd2")
def clusters_joined_k2(spark, sf_dir):
    """The engine of joins, on a scene with many links."""
    return clustering.cluster(adapters.lineitem(spark, sf_dir), PARTS, rounds=2, engine="joined")[0].select("node", "gid")


@query(PARTS_SQL + rounds_sql(20, PARTS) + " SELECT node, gid FROM nd20")
def clusters_all_rounds(spark, sf_dir):
    return clustering.cluster(adapters.lineitem(spark, sf_dir), PARTS)[0].select("node", "gid")


# --- Objects -------------------------------------------------------------------------------------

OBJECTS_SQL = rounds_sql(1, DOCS) + """,
big AS (SELECT node, gid FROM nd1 WHERE node IN (SELECT node FROM nd1 GROUP BY node HAVING count(*) >= 2)),
np AS (SELECT DISTINCT node, point_id, length(point_id) % 2 AS component FROM big JOIN msk USING (gid) JOIN inc USING (frame_id, mask_id)),
nf AS (SELECT DISTINCT node, frame_id FROM big JOIN vf USING (gid)),
vid AS (SELECT np.node, np.component, np.point_id, count(pf.frame_id) AS in_video FROM np JOIN nf USING (node) LEFT JOIN pf ON pf.point_id = np.point_id AND pf.frame_id = nf.frame_id GROUP BY ALL),
own AS (SELECT np.node, np.point_id, count(DISTINCT msk.frame_id) AS in_node FROM np JOIN big USING (node) JOIN msk USING (gid) JOIN nf ON nf.node = np.node AND nf.frame_id = msk.frame_id
  JOIN inc ON inc.frame_id = msk.frame_id AND inc.mask_id = msk.mask_id AND inc.point_id = np.point_id GROUP BY ALL),
det AS (SELECT node, component, point_id, in_video, coalesce(in_node, 0) AS in_node, coalesce(in_node, 0) / (in_video + 1e-6) > 0.5 AS kept FROM vid LEFT JOIN own USING (node, point_id)),
sh AS (SELECT big.node, big.gid, np.component, count(*) AS k FROM big JOIN msk USING (gid) JOIN inc USING (frame_id, mask_id) JOIN np ON np.node = big.node AND np.point_id = inc.point_id GROUP BY ALL),
ass AS (SELECT sh.node, sh.component, sh.gid, k / n AS coverage FROM sh JOIN (SELECT node, component, count(*) AS n FROM np GROUP BY ALL) USING (node, component)
  QUALIFY row_number() OVER (PARTITION BY sh.node, sh.gid ORDER BY k DESC, sh.component) = 1)"""


def docs_objects(spark, sf_dir):
    """(objects, nodes, incidences, masks, visible) after a round; lines of even and odd length stand for two density clusters."""
    inc, masks, contained, valid, visible = docs_state(spark, sf_dir)
    nodes = clustering.one_round(clustering.start(valid), contained, visible, consensus.thresholds(visible).where("round = 0"), DOCS.view_consensus_threshold, Scratch(spark, "round1"))
    scratch = Scratch(spark, "objects")
    nodes = scratch.save(postprocess.merged_nodes(nodes), "nodes")
    points = scratch.save(postprocess.node_points(nodes, inc, masks).withColumn("component", F.col("point_id.n") % 2), "points")
    return points, nodes, inc, masks, visible


@query(DOCS_SQL + OBJECTS_SQL + " SELECT node, component, point_id, in_node, in_video, kept FROM det")
def detection_ratio(spark, sf_dir):
    points, nodes, inc, masks, visible = docs_objects(spark, sf_dir)
    found = postprocess.detection(points, nodes, inc, masks, visible).withColumnRenamed("point_id", "point")
    lines = adapters.lines_of(spark, sf_dir, masks.join(nodes, ["seq", "gid"], "left_semi"))
    found = found.join(lines, "point")
    return found.select("node", "component", F.col("line").alias("point_id"), "in_node", "in_video", postprocess.passes_ratio(F.col("in_node"), F.col("in_video"), DOCS.point_filter_threshold).alias("kept"))


@query(DOCS_SQL + OBJECTS_SQL + " SELECT node, component, gid, round(coverage, 6) AS coverage FROM ass")
def mask_object_assign(spark, sf_dir):
    points, nodes, inc, masks, _ = docs_objects(spark, sf_dir)
    return postprocess.assign_masks(points, nodes, inc, masks).select("node", "component", "gid", F.round("coverage", 6).alias("coverage"))


@query(DOCS_SQL + OBJECTS_SQL + " SELECT node, component, gid, row_number() OVER (PARTITION BY node, component ORDER BY coverage DESC, gid) AS rank FROM ass QUALIFY rank <= 5")
def representative_masks(spark, sf_dir):
    points, nodes, inc, masks, _ = docs_objects(spark, sf_dir)
    return postprocess.representatives(postprocess.assign_masks(points, nodes, inc, masks)).select("node", "component", "gid", "rank")


#: Parts of suppliers as objects that overlap: those of equal number modulo 40 and their subsets by year.
SETS_SQL = """
WITH pts AS (SELECT DISTINCT l_suppkey % 40 AS object_id, l_partkey AS point_id FROM lineitem
  UNION SELECT DISTINCT 100 + l_suppkey % 40, l_partkey FROM lineitem WHERE year(l_shipdate) < 1993 + l_suppkey % 7),
n AS (SELECT object_id, count(*) AS n FROM pts GROUP BY ALL),
ov AS (SELECT a.object_id AS i, b.object_id AS j, count(*) AS k FROM pts a JOIN pts b ON a.point_id = b.point_id AND a.object_id < b.object_id GROUP BY ALL)"""


def part_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("s"), F.col("l_partkey").alias("point_id"), "l_suppkey", F.year("l_shipdate").alias("y"))
    early = rows.where(F.col("y") < 1993 + F.col("l_suppkey") % 7).select((F.col("s") + 100).alias("object_id"), "point_id")
    return rows.select(F.col("s").alias("object_id"), "point_id").unionByName(early).distinct().select(F.lit("parts").alias("seq"), "object_id", "point_id")


@query(SETS_SQL + " SELECT i, j, k, a.n AS n_i, b.n AS n_j FROM ov JOIN n a ON a.object_id = i JOIN n b ON b.object_id = j")
def object_overlaps(spark, sf_dir):
    return postprocess.object_overlaps(part_sets(spark, sf_dir)).select("i", "j", "k", "n_i", "n_j")


#: Objects one after another, each with the objects that are gone before its turn.
MERGE_SQL = SETS_SQL.replace("WITH", "WITH RECURSIVE") + """,
pr AS (SELECT i, j, k / a.n > 0.8::DOUBLE AS inner_i FROM ov JOIN n a ON a.object_id = i JOIN n b ON b.object_id = j WHERE k / a.n > 0.8::DOUBLE OR k / b.n > 0.8::DOUBLE),
o AS (SELECT object_id, row_number() OVER (ORDER BY object_id) AS r FROM n),
w(r, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT w.r + 1, CASE WHEN list_contains(w.gone, o.object_id) THEN w.gone ELSE list_concat(w.gone,
  coalesce((SELECT list(CASE WHEN inner_i THEN i ELSE j END) FROM pr WHERE pr.i = o.object_id AND NOT list_contains(w.gone, pr.j)), [])) END FROM w JOIN o ON o.r = w.r + 1)
SELECT DISTINCT unnest(gone) AS object_id FROM w WHERE r = (SELECT max(r) FROM w)"""


@query(MERGE_SQL)
def overlap_merge(spark, sf_dir):
    return postprocess.overlapped(postprocess.object_overlaps(part_sets(spark, sf_dir)), 0.8).select("object_id")


@query(MERGE_SQL)
def overlap_merge_joined(spark, sf_dir):
    """The same by rounds, as for scenes with too many pairs for a task."""
    return postprocess.overlapped(postprocess.object_overlaps(part_sets(spark, sf_dir)), 0.8, most=0).select("object_id")


WHOLE_SQL = PARTS_SQL + rounds_sql(20, PARTS) + """,
big AS (SELECT node, gid FROM nd20 WHERE node IN (SELECT node FROM nd20 GROUP BY node HAVING count(*) >= 2)),
sc AS (SELECT p_partkey AS point_id, p_size / 50::DOUBLE AS x, p_retailprice / 2000::DOUBLE AS y, (p_partkey % 7) / 7::DOUBLE AS z FROM part),
pp AS (SELECT DISTINCT node, point_id, x, y, z FROM big JOIN msk USING (gid) JOIN inc USING (frame_id, mask_id) JOIN sc USING (point_id)),
near AS (SELECT a.node, a.point_id AS i, b.point_id AS j FROM pp a JOIN pp b ON a.node = b.node AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.1::DOUBLE * 0.1::DOUBLE),
cor AS (SELECT node, i FROM near GROUP BY ALL HAVING count(*) >= 4),
ce AS (SELECT node, i, j FROM near SEMI JOIN cor USING (node, i) WHERE (node, j) IN (SELECT node, i FROM cor)),
lab(node, i, m) USING KEY (node, i) AS (SELECT node, i, i FROM cor UNION
  SELECT ce.node, ce.j, min(w.m) FROM lab w JOIN ce ON ce.node = w.node AND ce.i = w.i JOIN recurring.lab r ON r.node = ce.node AND r.i = ce.j WHERE w.m < r.m GROUP BY ALL),
hd AS (SELECT node, i, dense_rank() OVER (PARTITION BY node ORDER BY m) AS component FROM lab),
bd AS (SELECT near.node, near.j AS i, min(component) AS component FROM near JOIN hd ON hd.node = near.node AND hd.i = near.i GROUP BY ALL),
np AS (SELECT pp.node, pp.point_id, coalesce(hd.component, bd.component, 0) AS component FROM pp LEFT JOIN hd ON hd.node = pp.node AND hd.i = pp.point_id LEFT JOIN bd ON bd.node = pp.node AND bd.i = pp.point_id),
nf AS (SELECT DISTINCT node, frame_id FROM big JOIN vf USING (gid)),
vid AS (SELECT np.node, np.component, np.point_id, count(pf.frame_id) AS in_video FROM np JOIN nf USING (node) LEFT JOIN pf ON pf.point_id = np.point_id AND pf.frame_id = nf.frame_id GROUP BY ALL),
own AS (SELECT big.node, inc.point_id, count(DISTINCT msk.frame_id) AS in_node FROM big JOIN msk USING (gid) JOIN nf ON nf.node = big.node AND nf.frame_id = msk.frame_id
  JOIN inc ON inc.frame_id = msk.frame_id AND inc.mask_id = msk.mask_id GROUP BY ALL),
ass AS (SELECT big.node, big.gid, np.component, count(*) AS k FROM big JOIN msk USING (gid) JOIN inc USING (frame_id, mask_id) JOIN np ON np.node = big.node AND np.point_id = inc.point_id GROUP BY big.node, big.gid, np.component
  QUALIFY row_number() OVER (PARTITION BY big.node, big.gid ORDER BY k DESC, np.component) = 1),
enough AS (SELECT node, component, count(*) AS masks FROM ass GROUP BY ALL HAVING count(*) >= 2),
kept AS (SELECT node, component, point_id FROM vid LEFT JOIN own USING (node, point_id) SEMI JOIN enough USING (node, component) WHERE coalesce(in_node, 0) / (in_video + 1e-6::DOUBLE) > 0.5::DOUBLE),
ids AS (SELECT node, component, row_number() OVER (ORDER BY node, component) - 1 AS object_id FROM (SELECT DISTINCT node, component FROM kept)),
pts AS (SELECT object_id, point_id FROM kept JOIN ids USING (node, component)), n AS (SELECT object_id, count(*) AS n FROM pts GROUP BY ALL),
ovl AS (SELECT a.object_id AS i, b.object_id AS j, count(*) AS k FROM pts a JOIN pts b ON a.point_id = b.point_id AND a.object_id < b.object_id GROUP BY ALL),
pr AS (SELECT i, j, k / a.n > 0.8::DOUBLE AS inner_i FROM ovl JOIN n a ON a.object_id = i JOIN n b ON b.object_id = j WHERE k / a.n > 0.8::DOUBLE OR k / b.n > 0.8::DOUBLE),
o AS (SELECT object_id, row_number() OVER (ORDER BY object_id) AS r FROM n),
w(r, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT w.r + 1, CASE WHEN list_contains(w.gone, o.object_id) THEN w.gone ELSE list_concat(w.gone,
  coalesce((SELECT list(CASE WHEN inner_i THEN i ELSE j END) FROM pr WHERE pr.i = o.object_id AND NOT list_contains(w.gone, pr.j)), [])) END FROM w JOIN o ON o.r = w.r + 1),
lost AS (SELECT DISTINCT unnest(gone) AS object_id FROM w WHERE r = (SELECT max(r) FROM w))
SELECT row_number() OVER (ORDER BY object_id) - 1 AS object_id, n AS points, masks, least(masks, 5)::BIGINT AS representatives
FROM n ANTI JOIN lost USING (object_id) JOIN ids USING (object_id) JOIN enough USING (node, component)"""


@query(WHOLE_SQL)
def whole_pipeline_objects(spark, sf_dir):
    """Clustering, splitting, filtering and merging of parts as points in the space of size, price and number."""
    p = table(spark, sf_dir, "part")
    scene = p.select(F.lit("lineitem").alias("seq"), F.col("p_partkey").alias("point_id"), (F.col("p_size") / 50).alias("x"), (F.col("p_retailprice") / 2000).alias("y"), (F.col("p_partkey") % 7 / 7).alias("z"))
    inc = adapters.lineitem(spark, sf_dir)
    nodes, masks, _, _, visible = clustering.cluster(inc, PARTS)
    found = postprocess.objects(nodes, inc, masks, visible, scene, PARTS)
    return found.select("object_id", F.size("point_ids").alias("points"), F.size("mask_list").alias("masks"), F.size("repre_mask_list").alias("representatives"))


# --- Space ---------------------------------------------------------------------------------------

PTS_SQL = "WITH pts AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
EPS_SQL = PTS_SQL + ", near AS (SELECT a.id AS l_id, b.id AS r_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM pts a, pts b), "


def space(spark, sf_dir):
    return adapters.vectors_as_points(spark, sf_dir)


@query(PTS_SQL + """, lo AS (SELECT label, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts GROUP BY label)
SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM pts JOIN lo USING (label)
GROUP BY label, floor((x - (lx - 0.05)) / 0.1), floor((y - (ly - 0.05)) / 0.1), floor((z - (lz - 0.05)) / 0.1)""")
def voxel_downsample(spark, sf_dir):
    found = spatial.voxel_downsample(space(spark, sf_dir), 0.1, ["label"])
    return found.select("label", *(F.round(c, 6).alias(c) for c in "xyz"), "n")


@query(EPS_SQL + "w AS (SELECT 1) SELECT l_id, r_id FROM near WHERE d2 < 0.0225")
def epsilon_join(spark, sf_dir):
    p = space(spark, sf_dir).withColumnRenamed("point_id", "id")
    return spatial.epsilon_join(p, p, 0.15, columns=["l_id", "r_id"])


@query(EPS_SQL + "w AS (SELECT 1) SELECT l_id, r_id FROM near WHERE d2 < 0.0225 QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY r_id) <= 20")
def knn_cap(spark, sf_dir):
    p = space(spark, sf_dir).withColumnRenamed("point_id", "id")
    return spatial.first_within(p, p, 0.15, 20).select("l_id", "r_id")


DBSCAN_SQL = PTS_SQL.replace("WITH", "WITH RECURSIVE") + EPS_SQL[len(PTS_SQL) :] + """
e AS (SELECT l_id, r_id FROM near WHERE d2 <= 0.01::DOUBLE),
core AS (SELECT l_id AS id FROM e GROUP BY l_id HAVING count(*) >= 4),
ce AS (SELECT l_id AS i, r_id AS j FROM e WHERE l_id IN (SELECT id FROM core) AND r_id IN (SELECT id FROM core)),
r(i, j) AS (SELECT id, id FROM core UNION SELECT r.i, ce.j FROM r JOIN ce ON r.j = ce.i),
hd AS (SELECT i AS id, min(j) AS component FROM r GROUP BY i),
bd AS (SELECT e.r_id AS id, min(hd.component) AS component FROM e JOIN hd ON hd.id = e.l_id GROUP BY e.r_id)"""


@query(DBSCAN_SQL + " SELECT pts.id AS point_id, coalesce(hd.component, bd.component) AS component FROM pts LEFT JOIN hd USING (id) LEFT JOIN bd USING (id)")
def dbscan_core(spark, sf_dir):
    return spatial.dbscan_joined(space(spark, sf_dir), 0.1, 4, ["seq"]).select("point_id", "component")


@query(DBSCAN_SQL + """, c AS (SELECT pts.id, coalesce(hd.component, bd.component) AS component FROM pts LEFT JOIN hd USING (id) LEFT JOIN bd USING (id))
SELECT id AS point_id, CASE WHEN component IS NULL THEN 0 ELSE (SELECT count(DISTINCT d.component) FROM hd d WHERE d.component <= c.component) END AS component FROM c""")
def dbscan_split(spark, sf_dir):
    return spatial.dbscan(space(spark, sf_dir), 0.1, 4, ["seq"]).select("point_id", "component")


DENOISE_SQL = PTS_SQL.replace("WITH", "WITH RECURSIVE") + """,
near AS (SELECT a.id AS l_id, b.id AS r_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM pts a JOIN pts b USING (label)),
e AS (SELECT l_id, r_id FROM near WHERE d2 <= 0.09::DOUBLE),
core AS (SELECT l_id AS id FROM e GROUP BY l_id HAVING count(*) >= 4),
ce AS (SELECT l_id AS i, r_id AS j FROM e WHERE l_id IN (SELECT id FROM core) AND r_id IN (SELECT id FROM core)),
r(i, j) AS (SELECT id, id FROM core UNION SELECT r.i, ce.j FROM r JOIN ce ON r.j = ce.i),
hd AS (SELECT i AS id, min(j) AS component FROM r GROUP BY i),
bd AS (SELECT e.r_id AS id, min(hd.component) AS component FROM e JOIN hd ON hd.id = e.l_id GROUP BY e.r_id),
c AS (SELECT pts.id, label, coalesce(hd.component, bd.component, -1) AS component FROM pts LEFT JOIN hd USING (id) LEFT JOIN bd USING (id)),
big AS (SELECT label, component FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM c) GROUP BY label, component, n HAVING count(*) >= 0.2::DOUBLE * n),
k AS (SELECT id, label FROM c JOIN big USING (label, component)),
d AS (SELECT l_id AS id, sqrt(d2) AS d, row_number() OVER (PARTITION BY l_id ORDER BY d2) AS nth FROM near WHERE l_id IN (SELECT id FROM k) AND r_id IN (SELECT id FROM k)),
m AS (SELECT label, id, avg(d) AS m FROM d JOIN k USING (id) WHERE nth <= 20 GROUP BY ALL),
w AS (SELECT label, avg(m) + 2 * coalesce(stddev_samp(m), 0) AS most FROM m GROUP BY label)
SELECT label, id AS point_id FROM m JOIN w USING (label) WHERE m <= most"""


@query(DENOISE_SQL)
def denoise(spark, sf_dir):
    return spatial.denoise(space(spark, sf_dir), ["seq", "label"], eps=0.3).select("label", "point_id")


@query(DENOISE_SQL)
def denoise_joined(spark, sf_dir):
    """The same by joins, as for groups that are too large for a task."""
    return spatial.denoise(space(spark, sf_dir), ["seq", "label"], eps=0.3, most=0).select("label", "point_id")


@query(PTS_SQL + """, d AS (SELECT a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM pts a, pts b),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS nth FROM d) SELECT id AS point_id, round(avg(d), 6) AS mean FROM o WHERE nth <= 20 GROUP BY ALL""")
def nearest_means(spark, sf_dir):
    return spatial.nearest_means(space(spark, sf_dir), 20, ["seq"]).select("point_id", F.round("mean", 6).alias("mean"))


@query(PTS_SQL + """, b AS (SELECT label, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM pts GROUP BY label)
SELECT b.label, pts.id AS point_id FROM pts, b WHERE x > lx AND x < hx AND y > ly AND y < hy AND z > lz AND z < hz""")
def aabb_crop(spark, sf_dir):
    p = space(spark, sf_dir)
    return spatial.crop(p.drop("label"), p.select("seq", "label", *"xyz"), ["seq", "label"]).select("label", "point_id")


def pixels(spark, sf_dir):
    """Lines of orders as pixels: v the line, u the part modulo 640, depth the quantity in tenths; one camera a supplier modulo 10."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", F.col("l_linenumber").alias("v"), (F.col("l_partkey") % 640).alias("u"), (F.col("l_quantity") / 2 - 2).alias("depth"), (F.col("l_suppkey") % 10).cast("double").alias("k")
    )


@query("""WITH p AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS v, l_partkey % 640 AS u, l_quantity / 2 - 2 AS d, CAST(l_suppkey % 10 AS DOUBLE) AS k FROM lineitem),
c AS (SELECT *, (u - 320.0::DOUBLE) * d / (500 + k) AS cx, (v - 240.0::DOUBLE) * d / (510 + k) AS cy FROM p WHERE d > 0 AND d < 20)
SELECT l_orderkey, v, u, round(cy + k, 6) AS x, round(-cx + 2 * k, 6) AS y, round(d - 1, 6) AS z FROM c""")
def backproject(spark, sf_dir):
    p = pixels(spark, sf_dir).where(geometry.valid_depth(F.col("depth")))
    k, d = F.col("k"), lambda x: F.lit(float(x))
    intr = F.struct((d(500) + k).alias("fx"), (d(510) + k).alias("fy"), d(320).alias("cx"), d(240).alias("cy"))
    pose = F.array(d(0), d(1), d(0), k, d(-1), d(0), d(0), 2 * k, d(0), d(0), d(1), d(-1), d(0), d(0), d(0), d(1))
    xyz = geometry.backproject(F.col("u"), F.col("v"), F.col("depth"), intr, pose)
    return p.where(geometry.valid_pose(pose)).select("l_orderkey", "v", "u", *(F.round(c, 6).alias(n) for c, n in zip(xyz, "xyz")))


@query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding[1:4]] AS v FROM embeddings),
q AS (SELECT vec_id, v[1] / n AS w, v[2] / n AS x, v[3] / n AS y, v[4] / n AS z FROM (SELECT *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3] + v[4] * v[4]) AS n FROM e))
SELECT vec_id, round(1 - 2 * (y * y + z * z), 6) AS r00, round(2 * (x * y - w * z), 6) AS r01, round(2 * (y * z + w * x), 6) AS r21, round(1 - 2 * (x * x + y * y), 6) AS r22 FROM q""")
def quat_rotation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(F.slice("embedding", 1, 4)).alias("q"))
    r = geometry.quaternion_rotation(*(F.col("q")[i] for i in range(4)))
    return e.select("vec_id", r.alias("r")).select("vec_id", *(F.round(F.col("r")[3 * i + j], 6).alias(f"r{i}{j}") for i, j in ((0, 0), (0, 1), (2, 1), (2, 2))))


# --- Images and masks ----------------------------------------------------------------------------

#: Events as candidate masks: hour and minute as a pixel, day as frame, type as candidate.
PAINT_SQL = """
WITH c AS (SELECT CAST(ts AS DATE) AS frame_id, event_type AS cand, minute(ts) AS v, second(ts) AS u, user_id % 10 / 10 AS s FROM events),
one AS (SELECT frame_id, cand, max(s) AS score, count(*) AS n FROM c WHERE s >= 0.5 GROUP BY ALL HAVING count(*) >= 2),
num AS (SELECT frame_id, cand, row_number() OVER (PARTITION BY frame_id ORDER BY score, cand) AS mask_id FROM one),
img AS (SELECT frame_id, v, u, max(mask_id) AS mask_id FROM c JOIN num USING (frame_id, cand) WHERE s >= 0.5 GROUP BY ALL)"""


def painted(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.lit("e").alias("seq"), F.to_date("ts").alias("frame_id"), F.col("event_type").alias("cand"), (F.col("user_id") % 10 / 10).alias("score"), F.minute("ts").alias("v"), F.second("ts").alias("u"))
    return lifting.paint(rows, Params(min_pixels=2))


@query(PAINT_SQL + " SELECT frame_id, v, u, mask_id FROM img")
def paint_masks(spark, sf_dir):
    return painted(spark, sf_dir).select("frame_id", "v", "u", "mask_id")


#: The label image as runs along its rows of 60 pixels.
RUNS_SQL = PAINT_SQL.replace("count(*) AS n", "count(DISTINCT v * 60 + u) AS n") + """,
g AS (SELECT frame_id, mask_id, v * 60 + u AS place, v * 60 + u - row_number() OVER (PARTITION BY frame_id, mask_id ORDER BY v, u) AS island FROM img)"""


def painted_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.lit("e").alias("seq"), F.to_date("ts").alias("frame_id"), F.col("event_type").alias("cand"), (F.col("user_id") % 10 / 10).alias("score"), (F.minute("ts") * 60 + F.second("ts")).alias("place"))
    return runs.paint(runs.encode(rows, ["seq", "frame_id", "cand", "score"], F.col("place")), 0.5, 2, span=256)


@query(RUNS_SQL + " SELECT frame_id, mask_id, CAST(min(place) AS BIGINT) AS start, count(*) AS length FROM g GROUP BY frame_id, mask_id, island")
def paint_runs(spark, sf_dir):
    """Painter's order over runs, without a row for a pixel."""
    return painted_runs(spark, sf_dir).select("frame_id", "mask_id", "start", "length")


@query("""WITH o AS (SELECT o_orderkey AS point_id, c_nationkey AS nation, n_regionkey AS region, CAST(o_orderpriority[1] AS INT) AS priority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT nation AS inst, point_id FROM o WHERE priority > nation % 5), g AS (SELECT region, point_id FROM o WHERE priority < 4),
k AS (SELECT inst, region, count(*) AS k FROM p JOIN g USING (point_id) GROUP BY ALL), n AS (SELECT inst, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT region, count(*) AS m FROM g GROUP BY ALL)
SELECT CAST(inst AS BIGINT) AS inst, CAST(region AS BIGINT) AS region, k, round(k / (n + m - k), 6) AS iou FROM k JOIN n USING (inst) JOIN m USING (region)""")
def overlap_runs(spark, sf_dir):
    """Shared points and IoU of nations' predictions and regions, both as runs of points."""
    o = adapters.orders_of_nations(spark, sf_dir).withColumn("seq", F.lit("orders"))
    pred = runs.encode(o.where(F.col("priority") > F.col("nation") % 5).withColumnRenamed("nation", "inst"), ["seq", "inst"], F.col("o_orderkey"))
    gt = runs.encode(o.where("priority < 4"), ["seq", "region"], F.col("o_orderkey"))
    return runs.overlaps(pred, ["inst"], gt, ["region"], ["seq"]).select("inst", "region", "k", F.round("iou", 6).alias("iou"))


@query(PAINT_SQL + """, b AS (SELECT frame_id, mask_id, min(u) AS u0, min(v) AS v0, max(u) AS u1, max(v) AS v1 FROM img GROUP BY ALL)
SELECT frame_id, mask_id, level, greatest(0, u0 - CAST(floor((u1 - u0) * 0.1::DOUBLE) AS BIGINT) * level) AS left_, greatest(0, v0 - CAST(floor((v1 - v0) * 0.1::DOUBLE) AS BIGINT) * level) AS top_,
  least(60, u1 + CAST(floor((u1 - u0) * 0.1::DOUBLE) AS BIGINT) * level) AS right_, least(60, v1 + CAST(floor((v1 - v0) * 0.1::DOUBLE) AS BIGINT) * level) AS bottom_ FROM b, range(3) r(level)""")
def mask_bbox_levels(spark, sf_dir):
    from tessera.operators.views import mask_boxes

    found = mask_boxes(painted(spark, sf_dir), F.lit(60), F.lit(60))
    return found.select("frame_id", "mask_id", "level", F.col("u0").alias("left_"), F.col("v0").alias("top_"), F.col("u1").alias("right_"), F.col("v1").alias("bottom_"))


@query(PAINT_SQL + " SELECT frame_id, mask_id, CAST(trunc(avg(u)) AS BIGINT) AS u, CAST(trunc(avg(v)) AS BIGINT) AS v FROM img GROUP BY ALL")
def mask_centroid(spark, sf_dir):
    from tessera.operators.views import mask_centroids

    return mask_centroids(painted(spark, sf_dir)).select("frame_id", "mask_id", "u", "v")


@query("""SELECT DISTINCT i, (i & 1) * 128 + ((i >> 3) & 1) * 64 + ((i >> 6) & 1) * 32 AS r, ((i >> 1) & 1) * 128 + ((i >> 4) & 1) * 64 + ((i >> 7) & 1) * 32 AS g,
  ((i >> 2) & 1) * 128 + ((i >> 5) & 1) * 64 AS b FROM (SELECT l_suppkey % 256 AS i FROM lineitem)""")
def label_palette(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 256).cast("int").alias("i")).distinct()
    return i.select("i", *(c.alias(n) for c, n in zip(geometry.palette(F.col("i")), "rgb")))


@query("SELECT o_orderkey AS frame_id FROM orders WHERE o_orderkey % 10 = 0 UNION SELECT x FROM range(0, (SELECT max(o_orderkey) + 1 FROM orders), 10) t(x)")
def frame_stride(spark, sf_dir):
    from tessera.sources.frames import strided

    return strided(table(spark, sf_dir, "orders").select(F.lit("o").alias("seq"), F.col("o_orderkey").alias("frame_id")), 10).select("frame_id")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)
SELECT a.doc_id, a.n // 2 AS pos, a.line AS head, b.line AS body FROM l a LEFT JOIN l b ON a.doc_id = b.doc_id AND b.n = a.n + 1 WHERE a.n % 2 = 0""")
def colmap_pairs(spark, sf_dir):
    from tessera.sources.layouts import paired_lines

    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return paired_lines(d, ["doc_id"]).select("doc_id", "pos", "head", "body")


@query("""WITH p AS (SELECT l_orderkey AS frame_id, CAST(l_linenumber AS BIGINT) AS v, CAST(0 AS BIGINT) AS u, max(l_quantity) AS depth FROM lineitem GROUP BY ALL)
SELECT a.frame_id, a.v, a.u, CASE WHEN EXISTS (SELECT 1 FROM p b WHERE b.frame_id = a.frame_id AND abs(b.v - a.v) + abs(b.u - a.u) = 1 AND abs(a.depth - b.depth) > 10) THEN 0.0::DOUBLE ELSE depth END AS depth FROM p a""")
def depth_edge_filter(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.lit("l").alias("seq"), F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("v"), F.lit(0).alias("u"), F.col("l_quantity").alias("depth"))
    p = p.groupBy("seq", "frame_id", "v", "u").agg(F.max("depth").alias("depth"))
    return lifting.without_depth_edges(p, 10.0).select("frame_id", "v", "u", "depth")


@query("""WITH o AS (SELECT DISTINCT CAST(regexp_extract(source, '\\d+') AS BIGINT) AS frame_id, doc_id, string_split(text, ' ') AS w FROM documents),
s AS (SELECT DISTINCT frame_id, doc_id AS mask_id, array_to_string(w[i:i + 4], ' ') AS point_id FROM (SELECT frame_id, doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM o WHERE len(w) >= 5)),
b AS (SELECT DISTINCT point_id FROM (SELECT point_id, frame_id FROM s GROUP BY ALL HAVING count(*) > 1)),
t AS (SELECT * FROM s WHERE point_id NOT IN (SELECT point_id FROM b))
SELECT a.frame_id, a.mask_id, c.frame_id AS by_frame, c.mask_id AS by_mask, count(*) AS k FROM t a JOIN t c USING (point_id) GROUP BY ALL""")
def shingle_overlap_hist(spark, sf_dir):
    """Overlaps of documents by runs of five words."""
    docs = adapters.docs_words(spark, sf_dir)
    masks = Scratch(spark, "shingles").save(incidence.masks(docs), "masks")
    words = incidence.with_gid(docs, containment.numbered(masks)).select("seq", "at", "w")
    found = containment.overlaps_of_sets(containment.hashed_sets(adapters.shingle_hashes(words)), masks)
    a, b = masks.select("gid", "frame_id", "mask_id"), masks.select(F.col("gid").alias("by_gid"), F.col("frame_id").alias("by_frame"), F.col("mask_id").alias("by_mask"))
    return found.select("gid", "by_gid", "k").join(a, "gid").join(b, "by_gid").select("frame_id", "mask_id", "by_frame", "by_mask", "k")


@query(PTS_SQL + """, m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pts)
SELECT id AS point_id, round(x - mx, 6) AS x, round(y - my, 6) AS y, round(z - mz, 6) AS z, round(pow(0.5, 1 / 2.2), 6) AS r, round(pow(0.5, 1 / 2.2), 6) AS g, round(pow(0.5, 1 / 2.2), 6) AS b,
  round((label + 1) * 97 % 256 / 255, 6) AS ir, round((label + 1) * 57 % 256 / 255, 6) AS ig, round((label + 1) * 151 % 256 / 255, 6) AS ib FROM pts, m""")
def scene_colours(spark, sf_dir):
    """Points of the embedding space with a colour for each label."""
    from tessera.operators.views import scene_colours as colours

    p = space(spark, sf_dir)
    grey = p.select("seq", "point_id", *"xyz", *(F.lit(0.5).alias(c) for c in "rgb"))
    found = colours(grey, p.select("seq", "point_id", F.col("label").alias("inst")))
    return found.select("point_id", *(F.round(c, 6).alias(c) for c in ("x", "y", "z", "r", "g", "b", "ir", "ig", "ib")))


@query("SELECT CAST(r_regionkey AS BIGINT) AS idx, r_name AS label, CAST(r_regionkey + 1 AS BIGINT) AS label_id FROM region")
def label_vocab(spark, sf_dir):
    return adapters.nation_classes(spark, sf_dir)


@query("SELECT l_partkey AS point_id, min(l_suppkey) AS x, count(DISTINCT l_suppkey) AS frames FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1")
def points_in_many_frames(spark, sf_dir):
    found = incidence.point_frame(adapters.lineitem(spark, sf_dir)).groupBy("point_id").agg(F.min("frame_id").alias("x"), F.count("*").alias("frames"))
    return found.where("frames > 1")


# --- Ground truth and scores ---------------------------------------------------------------------

GT_SQL = """
WITH o AS (SELECT o_orderkey AS point_id, CAST(c_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region, CAST(o_orderpriority[1] AS INT) AS priority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
gt AS (SELECT point_id, nation, (region + 1) * 1000 + nation + 1 AS gt_id FROM o),
pred AS (SELECT nation AS inst, point_id FROM o WHERE priority > nation % 5),
gi AS (SELECT gt_id AS instance_id, gt_id // 1000 AS label_id, count(*) AS vert_count FROM gt GROUP BY ALL),
pi AS (SELECT inst, CAST(n_regionkey AS BIGINT) + 1 AS label_id, count(*) AS np, 1.0::DOUBLE / (1 + inst % 3) AS score FROM pred JOIN nation ON inst = n_nationkey GROUP BY ALL HAVING count(*) >= 100),
x AS (SELECT pi.label_id, inst, gt_id AS instance_id, count(*) AS k FROM pred JOIN pi USING (inst) JOIN gt USING (point_id) WHERE gt_id // 1000 = pi.label_id GROUP BY ALL),
u AS (SELECT x.*, k / (vert_count + np - k) AS iou FROM x JOIN pi USING (inst, label_id) JOIN gi USING (instance_id)),
ovs AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.25]::DOUBLE[]) AS overlap),
hits AS (SELECT pi.label_id, overlap, score, CAST(coalesce(iou > overlap, false) AS BIGINT) AS hit FROM pi CROSS JOIN ovs LEFT JOIN (SELECT inst, iou FROM u) v USING (inst)),
tot AS (SELECT label_id, count(*) AS total FROM gi WHERE vert_count >= 100 GROUP BY ALL),
grp AS (SELECT label_id, overlap, score, count(*) AS n, CAST(sum(hit) AS BIGINT) AS tp FROM hits GROUP BY ALL),
cur AS (SELECT label_id, overlap, score, sum(n) OVER w AS n, sum(tp) OVER w AS tp, row_number() OVER (PARTITION BY label_id, overlap ORDER BY score) - 1 AS nth FROM grp WINDOW w AS (PARTITION BY label_id, overlap ORDER BY score DESC)),
pr AS (SELECT label_id, overlap, nth, tp / n AS precision, tp / total AS recall FROM cur JOIN tot USING (label_id)
  UNION ALL SELECT label_id, overlap, max(nth) + 1, 1.0, 0.0 FROM cur GROUP BY label_id, overlap),
st AS (SELECT *, (coalesce(lag(recall) OVER w, recall) - coalesce(lead(recall) OVER w, 0)) / 2 AS step FROM pr WINDOW w AS (PARTITION BY label_id, overlap ORDER BY nth)),
ap AS (SELECT label_id, overlap, sum(step * precision) AS ap FROM st GROUP BY ALL)"""


def scored(spark, sf_dir):
    """(predictions, instances, shared points, classes)."""
    gt, (pred, meta), classes = adapters.nations_gt(spark, sf_dir), adapters.nations_pred(spark, sf_dir), adapters.nation_classes(spark, sf_dir)
    preds, gts = evaluation.predictions(pred, meta, gt, classes), groundtruth.instances(gt, classes)
    return preds, gts, evaluation.intersections(pred, preds, gt, gts), classes


@query(GT_SQL + " SELECT point_id, gt_id FROM gt")
def gt_encode(spark, sf_dir):
    o = adapters.orders_of_nations(spark, sf_dir)
    return o.select(F.col("o_orderkey").alias("point_id"), groundtruth.encode(F.col("region") + 1, F.col("nation")).alias("gt_id"))


@query(GT_SQL + " SELECT point_id, gt_id % 1000 + 3000 AS gt_id, gt_id // 1000 AS label_id FROM gt")
def gt_agnostic(spark, sf_dir):
    gt = adapters.nations_gt(spark, sf_dir)
    return gt.select("point_id", groundtruth.agnostic(F.col("gt_id"), 3).alias("gt_id"), groundtruth.decode(F.col("gt_id")).alias("label_id"))


@query(GT_SQL + " SELECT instance_id, label_id, vert_count FROM gi")
def gt_instances(spark, sf_dir):
    return groundtruth.instances(adapters.nations_gt(spark, sf_dir), adapters.nation_classes(spark, sf_dir)).select("instance_id", "label_id", "vert_count")


@query("SELECT l_partkey AS point_id, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS segment FROM lineitem GROUP BY ALL")
def last_wins_scatter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    faces = li.select(F.lit("l").alias("seq"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("face_pos"), F.array("l_partkey").alias("verts"), F.col("l_suppkey").alias("segment"))
    return groundtruth.face_values(faces, "segment").select("point_id", "segment")


@query("SELECT p_type AS raw_category, CAST(arg_min(p_size, p_partkey) AS BIGINT) AS id FROM part GROUP BY ALL")
def label_map_first(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.col("p_type").alias("raw_category"), F.col("p_size").alias("id"))
    return groundtruth.first_label(rows)


@query(GT_SQL + " SELECT label_id, inst, instance_id, k, round(iou, 6) AS iou FROM u")
def gt_pred_iou(spark, sf_dir):
    preds, gts, shared, _ = scored(spark, sf_dir)
    met = shared.join(preds.select("inst", F.col("vert_count").alias("np")), "inst").join(gts.select("instance_id", F.col("vert_count").alias("ng")), "instance_id")
    return met.select("label_id", "inst", "instance_id", "k", F.round(evaluation.iou(F.col("k"), F.col("ng"), F.col("np")), 6).alias("iou"))


@query(GT_SQL + """, c AS (SELECT label_id, CAST(sum(hit) AS BIGINT) AS tp, count(*) - CAST(sum(hit) AS BIGINT) AS fp FROM hits WHERE overlap = 0.5 GROUP BY ALL)
SELECT tot.label_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, total - coalesce(tp, 0) AS fn FROM tot LEFT JOIN c USING (label_id)""")
def ap_counts(spark, sf_dir):
    preds, gts, shared, _ = scored(spark, sf_dir)
    return evaluation.counts_unambiguous(preds, gts, shared, 0.5)


@query(GT_SQL + " SELECT label_id, overlap, nth, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr")
def pr_curve(spark, sf_dir):
    preds, gts, shared, _ = scored(spark, sf_dir)
    found = evaluation.pr_curve(evaluation.matches(preds, gts, shared))
    return found.select("label_id", "overlap", "nth", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(GT_SQL + " SELECT label_id, overlap, round(ap, 6) AS ap FROM ap")
def ap_step_width(spark, sf_dir):
    preds, gts, shared, _ = scored(spark, sf_dir)
    found = evaluation.average_precision(evaluation.pr_curve(evaluation.matches(preds, gts, shared)))
    return found.select("label_id", "overlap", F.round("ap", 6).alias("ap"))


@query(GT_SQL + """, v AS (SELECT r_name AS class, r_regionkey + 1 AS class_id, ovs.overlap, CASE WHEN tot.total IS NULL THEN 'nan'::DOUBLE ELSE coalesce(ap, 0) END AS ap
  FROM region CROSS JOIN ovs LEFT JOIN ap ON ap.label_id = r_regionkey + 1 AND ap.overlap = ovs.overlap LEFT JOIN tot ON tot.label_id = r_regionkey + 1),
per AS (SELECT class, CAST(class_id AS BIGINT) AS class_id, avg(ap) FILTER (WHERE overlap <> 0.25) AS ap, max(ap) FILTER (WHERE overlap = 0.5) AS ap50, max(ap) FILTER (WHERE overlap = 0.25) AS ap25 FROM v GROUP BY ALL)
SELECT class, class_id, round(ap, 6) AS ap, round(ap50, 6) AS ap50, round(ap25, 6) AS ap25 FROM per
UNION ALL SELECT '', NULL, round(avg(ap) FILTER (WHERE NOT isnan(ap)), 6), round(avg(ap50) FILTER (WHERE NOT isnan(ap50)), 6), round(avg(ap25) FILTER (WHERE NOT isnan(ap25)), 6) FROM per""")
def ap_summary(spark, sf_dir):
    pred, meta = adapters.nations_pred(spark, sf_dir)
    found = evaluation.evaluate(pred, meta, adapters.nations_gt(spark, sf_dir), adapters.nation_classes(spark, sf_dir))
    return found.select("class", "class_id", *(F.round(c, 6).alias(c) for c in ("ap", "ap50", "ap25")))


#: The same with everything in the first class.
AGNOSTIC_SQL = GT_SQL.replace("(region + 1) * 1000 + nation + 1", "1000 + nation + 1").replace("CAST(n_regionkey AS BIGINT) + 1 AS label_id", "1::BIGINT AS label_id")


@query(AGNOSTIC_SQL + """, v AS (SELECT r_name AS class, ovs.overlap, CASE WHEN tot.total IS NULL THEN 'nan'::DOUBLE ELSE coalesce(ap, 0) END AS ap
  FROM region CROSS JOIN ovs LEFT JOIN ap ON ap.label_id = 1 AND ap.overlap = ovs.overlap LEFT JOIN tot ON tot.label_id = 1 WHERE r_regionkey = 0),
per AS (SELECT class, 1::BIGINT AS class_id, avg(ap) FILTER (WHERE overlap <> 0.25) AS ap, max(ap) FILTER (WHERE overlap = 0.5) AS ap50, max(ap) FILTER (WHERE overlap = 0.25) AS ap25 FROM v GROUP BY ALL)
SELECT class, class_id, round(ap, 6) AS ap, round(ap50, 6) AS ap50, round(ap25, 6) AS ap25 FROM per
UNION ALL SELECT '', NULL, round(avg(ap) FILTER (WHERE NOT isnan(ap)), 6), round(avg(ap50) FILTER (WHERE NOT isnan(ap50)), 6), round(avg(ap25) FILTER (WHERE NOT isnan(ap25)), 6) FROM per""")
def ap_class_agnostic(spark, sf_dir):
    pred, meta = adapters.nations_pred(spark, sf_dir)
    found = evaluation.evaluate(pred, meta, adapters.nations_gt(spark, sf_dir), adapters.nation_classes(spark, sf_dir), class_agnostic=True)
    return found.select("class", "class_id", *(F.round(c, 6).alias(c) for c in ("ap", "ap50", "ap25")))


# --- Labels --------------------------------------------------------------------------------------

FEATURES_SQL = """
WITH o AS (SELECT vec_id // 5 AS object_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
f AS (SELECT object_id, i, avg(CAST(x AS DOUBLE)) AS x FROM o GROUP BY ALL),
t AS (SELECT CAST(label AS BIGINT) AS idx, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY ALL)),
s AS (SELECT object_id, idx, sum(f.x * CAST(t.x AS DOUBLE)) AS similarity FROM f JOIN t USING (i) GROUP BY ALL),
e AS (SELECT *, exp(100 * (similarity - max(similarity) OVER (PARTITION BY object_id))) AS e FROM s)"""


def similar(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("object_id"), "embedding")
    return openvoc.similarity(vectors.mean_vector(e, ["object_id"], "embedding"), adapters.label_features(spark, sf_dir), ["object_id"])


@query(FEATURES_SQL + " SELECT object_id, i - 1 AS i, round(x, 6) AS x FROM f")
def feature_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("object_id"), "embedding")
    return vectors.mean_vector(e, ["object_id"], "embedding").select("object_id", F.posexplode("v").alias("i", "x")).select("object_id", "i", F.round("x", 6).alias("x"))


@query(FEATURES_SQL + " SELECT object_id, idx, round(similarity, 6) AS similarity FROM s")
def label_similarity(spark, sf_dir):
    return similar(spark, sf_dir).select("object_id", "idx", F.round("similarity", 6).alias("similarity"))


@query(FEATURES_SQL + " SELECT object_id, idx, round(e / sum(e) OVER (PARTITION BY object_id), 6) AS probability FROM e")
def label_softmax(spark, sf_dir):
    return openvoc.probabilities(similar(spark, sf_dir), ["object_id"]).select("object_id", "idx", F.round("probability", 6).alias("probability"))


@query(FEATURES_SQL + " SELECT object_id, idx, 'label ' || idx AS label FROM s QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY similarity DESC, idx) = 1")
def best_label(spark, sf_dir):
    return openvoc.best_label(similar(spark, sf_dir), ["object_id"]).select("object_id", "idx", "label")


def least_neighbours_sql(rounds: int) -> str:
    """Components by so many rounds in which each node takes the least of its own and its neighbours' numbers."""
    out = "WITH e AS (SELECT DISTINCT o_custkey AS a, 1000000 + l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey),\ny AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),\nc0 AS (SELECT DISTINCT a AS i, a AS c FROM y)"
    for r in range(1, rounds + 1):
        out += f",\nc{r} AS MATERIALIZED (SELECT y.a AS i, least(min(p.c), min(q.c)) AS c FROM y JOIN c{r - 1} p ON p.i = y.a JOIN c{r - 1} q ON q.i = y.b GROUP BY y.a)"
    return out + f"\nSELECT i AS node, c AS component FROM c{rounds}"


#: Every path of the table's bipartite graph is found within so many rounds at the scales of the tests.
@query(least_neighbours_sql(8))
def connected_components(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    e = table(spark, sf_dir, "orders").join(li, "o_orderkey").select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"))
    return components.connected_components(e, "a", "b")

import tessera.file_queries  # noqa: E402,F401  (registers the queries over files)
