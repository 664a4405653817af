"""Queries of co-visibility, the pose graph and place retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from stereolith.operators import covis as C
from stereolith.operators import geometry as G
from stereolith.operators import quality as Q
from stereolith.operators import retrieval as B
from stereolith.plans.map_queries import CEN, RAY, rounded
from stereolith.plans.registry import register
from stereolith.sources.fixtures import table as t
from stereolith.sources.fixtures import twin

COV = ("cov", "select a.frame_idx as frame_a, b.frame_idx as frame_b, count(*) as n from fx_obs a join fx_obs b on a.point_id = b.point_id and a.frame_idx < b.frame_idx group by 1, 2")
BOTH = ("bothw", "select frame_a, frame_b, n from cov union all select frame_b, frame_a, n from cov")
SCALE = ("scl", "select greatest(sqrt(power(max(cx)-min(cx),2)+power(max(cy)-min(cy),2)+power(max(cz)-min(cz),2)), 1e-6) as scale from cen")
WAY = "sqrt(power(ca.cx-cb.cx,2)+power(ca.cy-cb.cy,2)+power(ca.cz-cb.cz,2))"


def covis(spark, d):
    return C.covisibility(t(spark, d, "fx_obs"))


@register(twin("select * from cov", COV))
def cv1_covisibility(spark, d):
    return covis(spark, d)


@register(twin("select * from (select *, cast(row_number() over (partition by frame_a order by n desc, frame_b) as int) as rank from bothw) where rank <= 5", COV, BOTH))
def cv2_top_neighbours(spark, d):
    return C.top_neighbours(covis(spark, d), 5)


@register(twin("select frame_idx, count(distinct point_id) as points from fx_obs where frame_idx <> 3 group by 1 order by 2 desc, 1 limit 10"))
def cv2_rank_by_points(spark, d):
    return C.rank_by_points(t(spark, d, "fx_obs"), 10, 3)


@register(
    twin(
        """select b.frame_a, b.frame_b, count(*) as bound, round(case when count(*) >= 5 then cast(count(s.point_id) as double) / count(*) else 0e0 end, 6) as ratio
from (select distinct m.frame_a, m.frame_b, o.point_id, m.kp_b from fx_matches m join fx_obs o on o.frame_idx = m.frame_b and o.kp_idx = m.kp_b where m.frame_b = m.frame_a + 1) b
left join (select distinct frame_idx, point_id from fx_obs where point_id % 3 > 0) s on s.frame_idx = b.frame_a and s.point_id = b.point_id group by 1, 2"""
    )
)
def cv3_covis_ratio(spark, d):
    obs = t(spark, d, "fx_obs")
    m = t(spark, d, "fx_matches")
    last = m.where("frame_b = frame_a + 1").select("frame_a", "frame_b").distinct()
    bound = m.select("frame_a", "frame_b", "kp_b")
    # the keyframe sees a part of the points only
    seen = obs.where("point_id % 3 > 0")
    return rounded(C.covis_ratio(bound, obs, last, 5, seen), "ratio")


_KD = "select s_suppkey as frame_a, s_suppkey + 1 + s_suppkey % 4 as frame_b, cast(s_suppkey % 10 as double) / 10 as ratio from supplier"


@register(
    twin(
        f"""select p.frame_a, p.frame_b, (degrees(acos(greatest(-1e0, least(1e0, ({' + '.join(f'b.r{i}{j}*a.r{i}{j}' for i in range(3) for j in range(3))} - 1) / 2)))) > 5 or {WAY} / scale > 0.15e0 or ratio < 0.6e0) and p.frame_b - p.frame_a >= 2 as keyframe
from ({_KD}) p join fx_poses a on a.frame_idx = p.frame_a join fx_poses b on b.frame_idx = p.frame_b join cen ca on ca.frame_idx = p.frame_a join cen cb on cb.frame_idx = p.frame_b, scl""",
        CEN, SCALE,
    )
)
def cv4_keyframe_decision(spark, d):
    poses = t(spark, d, "fx_poses")
    k = F.col("s_suppkey")
    pairs = t(spark, d, "supplier").select(k.alias("frame_a"), (k + 1 + k % 4).alias("frame_b"), ((k % 10).cast("double") / 10).alias("ratio"))
    return C.keyframe_decision(pairs, poses, G.scene_scale(poses))


# every frame stands for three keyframes that see the same points
_THREE = "select distinct point_id, f as frame_idx from (select point_id, unnest([frame_idx * 3, frame_idx * 3 + 1, case when point_id % 5 = 0 then frame_idx * 3 + 2 else frame_idx * 3 + 1 end]) as f from fx_obs)"


@register(
    twin(
        """select distinct frame_b as frame_idx from (select a.frame_idx as frame_a, b.frame_idx as frame_b, count(*) as n from m a join m b on a.point_id = b.point_id and a.frame_idx < b.frame_idx where a.frame_idx in (select * from recent) and b.frame_idx in (select * from recent) group by 1, 2)
join (select frame_idx as frame_a, count(*) as sa from m group by 1) using (frame_a) join (select frame_idx as frame_b, count(*) as sb from m group by 1) using (frame_b) where n::double / least(sa, sb) > 0.8e0""",
        ("m", _THREE), ("recent", "select frame_idx from (select frame_idx, row_number() over (order by frame_idx desc) as r from (select distinct frame_idx from m)) where r between 2 and 10"),
    )
)
def cv5_cull_keyframes(spark, d):
    f = F.col("frame_idx") * 3
    many = t(spark, d, "fx_obs").select("point_id", F.explode(F.array(f, f + 1, F.when(F.col("point_id") % 5 == 0, f + 2).otherwise(f + 1))).alias("frame_idx")).distinct()
    return C.cull_keyframes(many, many.select("frame_idx").distinct())


@register(twin(f"select frame_a, frame_b, round(score, 6) as score, rank from (select frame_a, frame_b, score, cast(row_number() over (partition by frame_a order by score desc, frame_b) as int) as rank from (select frame_a, frame_b, n + 0.1e0*ln(1+{WAY}) as score from bothw join cen ca on ca.frame_idx = frame_a join cen cb on cb.frame_idx = frame_b where {WAY} >= 1e-6)) where rank <= 8", CEN, COV, BOTH))
def cv6_rank_view_partners(spark, d):
    return rounded(C.rank_view_partners(covis(spark, d), t(spark, d, "fx_poses")), "score")


@register(
    twin(
        """select frame_idx from w, (select count(*) as k from kept), (select count(*) as p from ray where frame_idx = 10) where frame_idx in (select * from kept) or k < 3 or p < 10""",
        CEN, RAY, ("w", "select frame_idx from fx_poses where frame_idx between 1 and 60"),
        ("kept", """select frame_idx from (select b.frame_idx, count(*) as shared, count(*) filter (where degrees(acos(greatest(-1e0, least(1e0, a.dx*b.dx+a.dy*b.dy+a.dz*b.dz)))) >= 12) as wide
  from ray a join ray b on a.point_id = b.point_id and a.frame_idx = 10 and b.frame_idx <> 10 and b.frame_idx in (select * from w) group by 1) where shared >= 8 and wide >= greatest(8, cast(trunc(0.2e0*shared) as int)) union all select 10"""),
    )
)
def cv7_filter_window_by_angle(spark, d):
    poses = t(spark, d, "fx_poses")
    rays = Q.rays(t(spark, d, "fx_obs"), t(spark, d, "fx_points"), poses)
    return C.filter_window_by_angle(rays, poses.where("frame_idx between 1 and 60"), 10, wide=12.0)


def _components(edges: str) -> list[tuple[str, str]]:
    """SQL of connected components of ``edges`` (a, b) by their transitive closure."""
    return [("both0", f"select a, b from {edges} union select b, a from {edges}"), ("closure(a, b)", "select a, b from both0 union select c.a, e.b from closure c join both0 e on e.a = c.b"), ("comp", "select a as node, min(least(a, b)) as component from closure group by 1")]


def recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@register(
    recursive(
        twin(
            """select cast(node as int) as frame_idx, component, size, coalesce(component <> main and size >= 2 and size <= greatest(2, cast(trunc(0.1e0*most) as int)) and size < mid, false) as odd
from comp join (select component, count(*) as size from comp group by 1) using (component), (select component as main, count(*) as most from comp group by 1 order by 2 desc, 1 limit 1), (select median(size) as mid from (select count(*) as size from comp group by component) where size >= 2)""",
            COV, ("edge", "select frame_a::bigint as a, frame_b::bigint as b from cov where n >= 8"), *_components("edge"),
        )
    )
)
def cv8_anomaly_blocks(spark, d):
    return C.anomaly_blocks(covis(spark, d), 8).withColumn("odd", F.coalesce("odd", F.lit(False)))


EA = ("ea", "select e.frame_a, e.frame_b, degrees(acos(greatest(-1e0, least(1e0, (" + " + ".join(f"e.r{i}{j}*({' + '.join(f'b.r{i}{k}*a.r{j}{k}' for k in range(3))})" for i in range(3) for j in range(3)) + " - 1) / 2)))) as angle from fx_rot_edges e join fx_poses a on a.frame_idx = e.frame_a join fx_poses b on b.frame_idx = e.frame_b")


# every frame stands for two, of which one has the edge before it and the other the edge behind it
@register(twin("select frame_idx, count(*) as edges, round(min(angle), 4) as least from (select frame_a * 2 as frame_idx, angle from ea union all select frame_b * 2 + 1, angle from ea) group by 1 having count(*) >= 1 and min(angle) > 5", EA))
def cv9_pose_outliers(spark, d):
    f, poses = F.col("frame_idx") * 2, t(spark, d, "fx_poses")
    edges = t(spark, d, "fx_rot_edges").withColumns({"frame_a": F.col("frame_a") * 2, "frame_b": F.col("frame_b") * 2 + 1})
    both = poses.withColumn("frame_idx", F.explode(F.array(f, f + 1)))
    return rounded(C.pose_outliers(edges, both, 5.0, least_edges=1), "least", digits=4)


# nine frames in a row, then a gap of eight
_GAPS = "select frame_idx + cast(floor(frame_idx / 9) as int) * 7 as frame_idx from fx_poses"


@register(twin("select frame_idx as frame_a, nxt as frame_b from (select frame_idx, lead(frame_idx) over (order by frame_idx) as nxt from g) where nxt - frame_idx <= 6", ("g", _GAPS)))
def cv10_rotation_edges(spark, d):
    f = F.col("frame_idx")
    return C.rotation_edges(t(spark, d, "fx_poses").withColumn("frame_idx", f + F.floor(f / 9).cast("int") * 7))


@register(recursive(twin("select frame_a, frame_b, round(angle, 3) + 0e0 as angle from ea where angle <= 5 and frame_a in (select node from comp where component = (select component from comp group by 1 order by count(*) desc, 1 limit 1))", EA, ("edge", "select frame_a::bigint as a, frame_b::bigint as b from ea where angle <= 5"), *_components("edge"))))
def cv10_filter_rotation_edges(spark, d):
    return rounded(C.filter_rotation_edges(t(spark, d, "fx_rot_edges"), t(spark, d, "fx_poses"), 5.0), "angle", digits=3)


_LOOPS = """select s.s_suppkey as frame_a, s.s_suppkey + 7 + s.s_suppkey % 20 as frame_b, case when s.s_suppkey % 4 > 0 then s.s_suppkey % 30 end as shared, {m} from {supplier} s join {fx_poses} a on a.frame_idx = s.s_suppkey join {fx_poses} b on b.frame_idx = s.s_suppkey + 7 + s.s_suppkey % 20"""
_M = ", ".join(f"b.r{i}0*a.r{j}0+b.r{i}1*a.r{j}1+b.r{i}2*a.r{j}2 as r{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"b.t{i} - ({' + '.join(f'(b.r{i}0*a.r{j}0+b.r{i}1*a.r{j}1+b.r{i}2*a.r{j}2)*a.t{j}' for j in range(3))}) + cast(s.s_suppkey % 5 as double) * {0.3 if i == 0 else 0.1}e0 as t{i}" for i in range(3))


def loops(spark, d):
    return spark.sql(_LOOPS.replace("{m}", _M), supplier=t(spark, d, "supplier"), fx_poses=t(spark, d, "fx_poses"))


LOOPS = ("loops", _LOOPS.replace("{m}", _M).replace("{supplier}", "supplier").replace("{fx_poses}", "fx_poses"))
# a loop's measured rotation is that of the poses, and its translation is off by a known way
LERR = ("lerr", "select frame_a, frame_b, shared, sqrt(power((frame_a % 5) * 0.3e0, 2) + 2 * power((frame_a % 5) * 0.1e0, 2)) as way from loops")


@register(twin("select frame_idx as frame_a, nxt as frame_b, 'seq' as kind, 1e0 as weight from (select frame_idx, lead(frame_idx) over (order by frame_idx) as nxt from fx_poses where frame_idx % 3 = 0) where nxt is not null union all select frame_a, frame_b, 'loop', round(greatest(1.5e0, ln(1 + greatest(1, coalesce(shared, 10)))), 6) from lerr, (select scale * 0.1e0 as scale from scl) where way <= 0.5e0 * scale", CEN, SCALE, LOOPS, LERR))
def cv11_pose_graph_edges(spark, d):
    poses = t(spark, d, "fx_poses")
    small = G.scene_scale(poses).select((F.col("scale") * 0.1).alias("scale"))
    return rounded(C.pose_graph_edges(poses.where("frame_idx % 3 = 0"), loops(spark, d), poses, small), "weight")


@register(twin("select frame_a, frame_b, round(way, 5) + 0e0 as way from lerr", LOOPS, LERR))
def cv12_edge_errors(spark, d):
    return rounded(C.edge_errors(loops(spark, d), t(spark, d, "fx_poses")).select("frame_a", "frame_b", "way"), "way", digits=5)


@register(twin("select frame_a, frame_b, case when frame_a % 7 = 0 then 'seq' else 'loop' end as kind from lerr, scl where frame_a % 7 = 0 or way <= 0.05e0 * scale", CEN, SCALE, LOOPS, LERR))
def cv12_prune_loop_edges(spark, d):
    poses = t(spark, d, "fx_poses")
    kind = F.when(F.col("frame_a") % 7 == 0, "seq").otherwise("loop")
    return C.prune_loop_edges(loops(spark, d).withColumn("kind", kind), poses, G.scene_scale(poses))


def _vis(source: str) -> tuple[str, str]:
    cell = lambda c, s: f"greatest(0, least(dim - 1, cast(floor({c} / {s} * dim) as int)))"
    return ("vis", f"select frame_idx, cast(sum(n * dim * dim) as bigint) as score from (select frame_idx, dim, count(*) as n from (select distinct frame_idx, dim, {cell('u', '1280')} as cu, {cell('v', '720')} as cv from {source}, (select unnest([2, 4, 8, 16, 32, 64]) as dim)) group by 1, 2) group by 1")


@register(twin("select * from vis", _vis("fx_obs")))
def cv13_visibility_score(spark, d):
    return C.visibility_score(t(spark, d, "fx_obs"), 1280, 720)


@register(twin("select f.frame_idx, coalesce(score, 0) as score, cast(row_number() over (order by coalesce(score, 0) desc, f.frame_idx) as int) as rank from (select frame_idx from fx_poses where frame_idx % 10 <> 0 and exists (select 1 from fx_poses r where r.frame_idx % 10 = 0 and abs(r.frame_idx - fx_poses.frame_idx) <= 3)) f left join vis using (frame_idx)", ("seen", "select * from fx_obs where point_id in (select point_id from fx_obs where frame_idx % 10 = 0)"), _vis("seen")))
def cv14_next_frames(spark, d):
    obs, poses = t(spark, d, "fx_obs"), t(spark, d, "fx_poses")
    visible = obs.join(obs.where("frame_idx % 10 = 0").select("point_id").distinct(), "point_id", "left_semi")
    return C.next_frames(poses.where("frame_idx % 10 <> 0"), poses.where("frame_idx % 10 = 0"), visible, 1280, 720)


@register(twin("select f.frame_idx, arg_min(g.frame_idx, abs(g.frame_idx - f.frame_idx) * 1000 + g.frame_idx) as nearest from fx_poses f, (select frame_idx from fx_poses where frame_idx * frame_idx % 7 = 2) g group by 1"))
def cv15_nearest_registered(spark, d):
    f = t(spark, d, "fx_poses").select("frame_idx", (F.col("frame_idx").cast("long") * F.col("frame_idx") % 7 == 2).alias("registered"))
    return C.nearest_registered(f)


def bw1_train_vocabulary(spark, d):
    v = B.train_vocabulary(t(spark, d, "fx_kps"), 16)
    return v.select("word", F.size("centroid").alias("dims"))


register()(bw1_train_vocabulary)


@register(twin("select frame_idx, kp_idx, arg_min(word, dd * 1e6 + word * 1e-6) as word from (select frame_idx, kp_idx, word, list_sum(list_transform(range(1, len(descr) + 1), lambda i: power(descr[i]::double - centroid[i]::double, 2))) as dd from fx_kps, fx_vocab) group by 1, 2"))
def bw2_assign_words(spark, d):
    return B.assign_words(t(spark, d, "fx_kps"), t(spark, d, "fx_vocab"))


IDF = ("idf", "select word, ln(cast((select count(distinct frame_idx) from fx_words) + 1 as double) / (count(distinct frame_idx) + 1)) + 1 as idf from fx_words group by 1")
HIST = ("hist", "select frame_idx, word, w / sum(w) over (partition by frame_idx) as w from (select frame_idx, word, count(*) * idf as w from fx_words join idf using (word) group by 1, 2, idf)")
SIM = ("sim", """select a.frame_idx as frame_a, b.frame_idx as frame_b, sum(a.w*b.w) / (x.n * y.n) as score from hist a join hist b on a.word = b.word and abs(a.frame_idx - b.frame_idx) >= 5
  join (select frame_idx, sqrt(sum(w*w)) as n from hist group by 1) x on x.frame_idx = a.frame_idx join (select frame_idx, sqrt(sum(w*w)) as n from hist group by 1) y on y.frame_idx = b.frame_idx group by 1, 2, x.n, y.n""")


def histograms(spark, d):
    w = t(spark, d, "fx_words")
    return B.tfidf_histograms(w, B.idf(w))


@register(twin("select word, round(idf, 6) as idf from idf", IDF))
def bw3_idf(spark, d):
    return rounded(B.idf(t(spark, d, "fx_words")), "idf")


@register(twin("select frame_idx, word, round(w, 7) as w from hist", IDF, HIST))
def bw4_tfidf_histograms(spark, d):
    return rounded(histograms(spark, d), "w", digits=7)


@register(twin("select frame_a, frame_b, round(score, 6) as score from sim where score >= 0.7e0", IDF, HIST, SIM))
def bw5_similarity(spark, d):
    h = histograms(spark, d)
    return rounded(B.similarity(h, h, 5, 0.7), "score")


def bw6_suppress_near(spark, d):
    h = histograms(spark, d)
    # scores to six digits, so that both engines see the same ties; three of which no two are within 5 of each other lie among the best 3 * 11
    return B.suppress_near(rounded(B.similarity(h, h, 5, 0.0, top=3 * 11, digits=6), "score"), 5, 3)


register(
    recursive(
        twin(
            """select frame_a, frame_b, score from (select frame_a, kept, unnest(kept) as frame_b from (select frame_a, max_by(kept, r) as kept from walk group by 1)) join rk using (frame_a, frame_b)""",
            IDF, HIST, SIM, ("rk", "select frame_a, frame_b, round(score, 6) + 0e0 as score, row_number() over (partition by frame_a order by round(score, 6) desc, frame_b) as r from sim"),
            ("walk(frame_a, r, kept)", """select frame_a, 0::bigint, []::int[] from (select distinct frame_a from rk)
  union all select w.frame_a, rk.r, case when len(w.kept) < 3 and len(list_filter(w.kept, lambda y: abs(y - rk.frame_b) <= 5)) = 0 then list_append(w.kept, rk.frame_b) else w.kept end from walk w join rk on rk.frame_a = w.frame_a and rk.r = w.r + 1"""),
        )
    )
)(bw6_suppress_near)


@register(
    twin(
        """select frame_a, frame_b, count(hit) as votes from (select p.frame_a, p.frame_b, x.frame_idx as x, y.frame_idx as y from (select distinct frame_a, frame_b from sim where score >= 0.75e0) p
  join pl a on a.frame_idx = p.frame_a join pl b on b.frame_idx = p.frame_b join pl x on abs(x.p - a.p) <= 2 join pl y on abs(y.p - b.p) <= 2 where x.frame_idx <> y.frame_idx)
left join (select frame_a as x, frame_b as y, 1 as hit from sim where score > 0.72e0) using (x, y) group by 1, 2""",
        IDF, HIST, SIM, ("pl", "select frame_idx, row_number() over (order by frame_idx) as p from fx_poses"),
    )
)
def bw7_sequence_consistency(spark, d):
    h = histograms(spark, d)
    return B.consistent_pairs(h, t(spark, d, "fx_poses"), 5, 0.75, 0.72)
