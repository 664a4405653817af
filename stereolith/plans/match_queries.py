"""Queries of descriptors, matches, tracks and registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from stereolith.operators import geometry as G
from stereolith.operators import loops as L
from stereolith.operators import matching as M
from stereolith.operators import quality as Q
from stereolith.operators import refine as RF
from stereolith.operators import register as X
from stereolith.operators import retrieval as B
from stereolith.operators import tracks as K
from stereolith.plans.graph_queries import BOTH, COV, _components, covis, recursive
from stereolith.plans.map_queries import RES, rounded
from stereolith.plans.registry import register
from stereolith.sources.fixtures import table as t
from stereolith.sources.fixtures import twin

RATIO, MOST = 0.97, 1.3


def frame_pairs(spark, d):
    return M.neighbour_pairs(t(spark, d, "fx_kps").select("frame_idx").distinct(), 2)


_PAIRS = ("prs", "select a.frame_idx as frame_a, b.frame_idx as frame_b from (select distinct frame_idx from fx_kps) a join (select distinct frame_idx from fx_kps) b on b.frame_idx > a.frame_idx and b.frame_idx <= a.frame_idx + 2")
_DIST = ("dst", "select p.frame_a, a.kp_idx as kp_a, p.frame_b, b.kp_idx as kp_b, sqrt(list_sum(list_transform(range(1, len(a.descr) + 1), lambda i: power(a.descr[i]::double - b.descr[i]::double, 2)))) as distance from prs p join fx_kps a on a.frame_idx = p.frame_a join fx_kps b on b.frame_idx = p.frame_b")
_ONE = ("one", f"select frame_a, kp_a, frame_b, kp_b, distance from (select *, row_number() over w as r, lead(distance) over w as d2 from dst window w as (partition by frame_a, frame_b, kp_a order by distance, kp_b)) where r = 1 and distance < {RATIO}e0 * d2 and distance < {MOST}e0")
_TWO = ("two", f"select frame_a, kp_a, frame_b, kp_b from (select *, row_number() over w as r, lead(distance) over w as d2 from dst window w as (partition by frame_a, frame_b, kp_b order by distance, kp_a)) where r = 1 and distance < {RATIO}e0 * d2 and distance < {MOST}e0")


@register(twin("select frame_idx, kp_idx, round(list_sum(list_transform(n, lambda x: x * x)), 6) as norm2, round(n[1], 6) + 0e0 as first from (select frame_idx, kp_idx, list_transform(descr, lambda x: sign(x::double) * sqrt(abs(x::double) / (list_sum(list_transform(descr, lambda y: abs(y::double))) + 1e-8))) as n from fx_kps)"))
def ma1_root_normalize(spark, d):
    n = t(spark, d, "fx_kps").select("frame_idx", "kp_idx", M.root_normalize(F.col("descr").cast("array<double>")).alias("n"))
    return rounded(n.select("frame_idx", "kp_idx", F.aggregate("n", F.lit(0.0), lambda a, x: a + x * x).alias("norm2"), F.col("n")[0].alias("first")), "norm2", "first")


@register(twin("select frame_idx, case when frame_idx % 2 = 0 then 'rootsift' else 'sift' end as kind, case when frame_idx % 2 = 0 then 1.5e0 else 350e0 end as match_limit, case when frame_idx % 2 = 0 then 0.92e0 else 0.75e0 end as ratio from (select distinct frame_idx from fx_kps)"))
def ma2_descriptor_metric(spark, d):
    k = t(spark, d, "fx_kps").withColumn("descr", F.when(F.col("frame_idx") % 2 == 0, F.col("descr")).otherwise(F.transform("descr", lambda x: x * 100)))
    return M.descriptor_metric(k, "frame_idx").select("frame_idx", "kind", "match_limit", "ratio")


@register(twin("select frame_a, kp_a, frame_b, kp_b, round(distance, 6) as distance from dst where kp_a = kp_b", _PAIRS, _DIST))
def ma3_l2_distance(spark, d):
    k = t(spark, d, "fx_kps")
    a, b = k.select(F.col("frame_idx").alias("frame_a"), "kp_idx", F.col("descr").alias("da")), k.select(F.col("frame_idx").alias("frame_b"), "kp_idx", F.col("descr").alias("db"))
    met = frame_pairs(spark, d).join(a, "frame_a").join(b, ["frame_b", "kp_idx"])
    return rounded(met.select("frame_a", F.col("kp_idx").alias("kp_a"), "frame_b", F.col("kp_idx").alias("kp_b"), M.l2_distance(F.col("da"), F.col("db")).alias("distance")), "distance")


@register("select p_partkey as id, cast(bit_count(xor(cast('0x' || substr(a, 1, 15) as bigint), cast('0x' || substr(b, 1, 15) as bigint))) + bit_count(xor(cast('0x' || substr(a, 17, 15) as bigint), cast('0x' || substr(b, 17, 15) as bigint))) as bigint) as distance from (select p_partkey, md5(p_name) as a, md5(p_brand) as b from part)")
def ma3_hamming_distance(spark, d):
    # 32 bytes of which 60 of every 128 bits carry a digest: what a signed literal of the twin can hold
    half = lambda c: F.concat(F.lit("0"), F.substring(F.md5(c), 1, 15), F.lit("0"), F.substring(F.md5(c), 17, 15))
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), *[F.unhex(F.concat(half(c), F.repeat(F.lit("0"), 32))).alias(n) for c, n in (("p_name", "a"), ("p_brand", "b"))])
    return p.select("id", M.hamming_distance(F.col("a"), F.col("b")).cast("long").alias("distance"))


@register(twin("select frame_a, kp_a, frame_b, kp_b, round(distance, 5) as distance from one", _PAIRS, _DIST, _ONE))
def ma4_match_ratio(spark, d):
    return rounded(M.match(t(spark, d, "fx_kps"), frame_pairs(spark, d), RATIO, MOST), "distance", digits=5)


@register(twin("select frame_a, kp_a, frame_b, kp_b, round(distance, 5) as distance from one", _PAIRS, _DIST, _ONE))
def ma4_match_ratio_small(spark, d):
    return rounded(M.match_ratio_small(t(spark, d, "fx_kps"), frame_pairs(spark, d), RATIO, MOST), "distance", digits=5)


# 32 bytes a part, of which 60 of every 128 bits carry a digest: what a signed literal of the twin can hold
_BITS = ("bts", "select cast(p_partkey % 50 as int) as frame_idx, cast(p_partkey as int) as kp_idx, cast('0x' || substr(md5(p_name), 1, 15) as bigint) as lo, cast('0x' || substr(md5(p_name), 17, 15) as bigint) as hi from part")
_BIT_DIST = ("bdst", "select a.frame_idx as frame_a, a.kp_idx as kp_a, b.frame_idx as frame_b, b.kp_idx as kp_b, bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) + 0e0 as distance from bts a join bts b on b.frame_idx = a.frame_idx + 1")


def binary_kps(spark, d):
    half = lambda at: F.concat(F.lit("0"), F.substring(F.md5("p_name"), at, 15))
    return t(spark, d, "part").select((F.col("p_partkey") % 50).cast("int").alias("frame_idx"), F.col("p_partkey").cast("int").alias("kp_idx"), F.unhex(F.concat(half(1), half(17), F.repeat(F.lit("0"), 32))).alias("descr"))


@register(twin(f"select frame_a, kp_a, frame_b, kp_b, distance from (select *, row_number() over w as r, lead(distance) over w as d2 from bdst window w as (partition by frame_a, frame_b, kp_a order by distance, kp_b)) where r = 1 and distance < {RATIO}e0 * d2 and distance < 60e0", _BITS, _BIT_DIST))
def ma4_match_hamming(spark, d):
    return M.match(binary_kps(spark, d), M.neighbour_pairs(binary_kps(spark, d).select("frame_idx").distinct(), 1), RATIO, 60.0)


@register(twin("select frame_a, kp_a, frame_b, kp_b, round(distance, 5) as distance from one join two using (frame_a, kp_a, frame_b, kp_b)", _PAIRS, _DIST, _ONE, _TWO))
def ma5_match_mutual(spark, d):
    return rounded(M.match(t(spark, d, "fx_kps"), frame_pairs(spark, d), RATIO, MOST, mutual=True), "distance", digits=5)


@register("""select distinct cast(a as int) as a, cast(b as int) as b from (
  select x.i as a, y.i as b from anchor x join anchor y on x.i < y.i
  union all select i, i + o from n, (select unnest(range(0, k)) as i from n), (select unnest([1, 2, 3, 5, 8, 13, 21, 34, 55]) as o) where i + o < k)""".replace("select distinct cast(a", "with n as (select count(*) as k from pages), anchor as (select distinct unnest(list_append(range(0, k, greatest(1, k // 100)), k - 1)) as i from n) select distinct cast(a", 1))
def ma6_candidate_pairs(spark, d):
    return M.candidate_pairs(t(spark, d, "pages"))


@register(twin("select a.frame_idx as frame_a, b.frame_idx as frame_b from fx_poses a join fx_poses b on b.frame_idx > a.frame_idx and b.frame_idx - a.frame_idx <= 3"))
def ma7_neighbour_pairs(spark, d):
    return M.neighbour_pairs(t(spark, d, "fx_poses"), 3)


_SC = ("scr", "select p.frame_a, p.frame_b, count(o.kp_a) as score from prs p left join (select * from one join two using (frame_a, kp_a, frame_b, kp_b)) o using (frame_a, frame_b) group by 1, 2")


@register(twin("select * from scr", _PAIRS, _DIST, _ONE, _TWO, _SC))
def ma8_pair_scores(spark, d):
    return M.pair_scores(t(spark, d, "fx_kps"), frame_pairs(spark, d), RATIO, MOST, least=10)


_SHORT = "select frame_a, frame_b, n as score from {cov} where (frame_a * 7 + frame_b) % 5 = 0"


@register(
    twin(
        """select frame_a, frame_b, score from (select *, row_number() over (partition by score >= cut order by score desc, frame_a, frame_b) as r, max((score >= cut)::int) over () as anyp, row_number() over (order by score desc, frame_a, frame_b) as alln, row_number() over (partition by band order by score desc, frame_a, frame_b) as b
  from (select *, greatest(20, cast(trunc(0.15e0 * max(score) over ()) as int)) as cut, least(7, cast(floor((frame_a - min(frame_a) over ()) * 8 / (max(frame_a) over () - min(frame_a) over () + 1)::double) as int)) as band from sl))
where (score >= cut and r <= 30) or (anyp = 0 and alln <= 40) or b = 1""",
        ("cov", "select a.frame_idx as frame_a, b.frame_idx as frame_b, count(*) as n from fx_obs a join fx_obs b on a.point_id = b.point_id and a.frame_idx < b.frame_idx group by 1, 2"),
        ("sl", _SHORT.format(cov="cov")),
    )
)
def ma8_shortlist_pairs(spark, d):
    from stereolith.operators.covis import covisibility

    return M.shortlist_pairs(spark.sql(_SHORT, cov=covisibility(t(spark, d, "fx_obs"))), top=30)


@register()
def ma9_verify_pairs(spark, d):
    return M.verify_pairs(t(spark, d, "fx_matches"), min_inliers=8, tries=300).groupBy("frame_a", "frame_b", "model").agg(F.count("*").alias("matches"), F.sum(F.col("inlier").cast("long")).alias("inliers"))


@register()
def ma10_relative_rotation(spark, d):
    return M.relative_rotation(t(spark, d, "fx_matches"), tries=300).select("frame_a", "frame_b", "n")


_TRI = """select m.frame_a, m.frame_b, a.depth as depth_a, b.depth as depth_b, cast((m.kp_a * 7 + m.kp_b) % 50 as double) / 10 as angle from {m} m
join {r} a on a.frame_idx = m.frame_a and a.kp_idx = m.kp_a join {r} b on b.frame_idx = m.frame_b and b.kp_idx = m.kp_b"""


@register(twin("select frame_a, frame_b, coalesce(count(*) >= 8 and avg((depth_a > 0 and depth_b > 0)::int) >= 0.5e0 and median(angle) filter (where depth_a > 0 and depth_b > 0) >= 2.4e0, false) as ok from tri group by 1, 2", RES, ("tri", _TRI.format(m="fx_matches", r="res"))))
def ma11_baseline_ok(spark, d):
    r = Q.residuals(t(spark, d, "fx_obs"), t(spark, d, "fx_points"), t(spark, d, "fx_poses"))
    return M.baseline_ok(spark.sql(_TRI, m=t(spark, d, "fx_matches"), r=r), min_angle=2.4)


@register("select frame_a, frame_b, score, \"round\" from (select s_suppkey as frame_a, s_suppkey + 1 as frame_b, s_suppkey % 17 as score, case when s_suppkey % 90 >= 60 and s_suppkey % 20 >= 16 then 0 when s_suppkey % 90 >= 40 and s_suppkey % 20 >= 12 then 1 when s_suppkey % 90 >= 30 and s_suppkey % 20 >= 8 then 2 end as \"round\" from supplier) where \"round\" is not null order by \"round\", score desc, frame_a limit 1")
def ma12_select_seed_pair(spark, d):
    k = F.col("s_suppkey")
    m = t(spark, d, "supplier").select(k.alias("frame_a"), (k + 1).alias("frame_b"), (k % 17).alias("score"), F.lit(100).alias("matches"), (k % 90).alias("inliers"), (k % 20).cast("double").alias("angle"), F.lit(30).alias("points"))
    return M.select_seed_pair(m).select("frame_a", "frame_b", "score", "round")


_NODES = ("edge", "select frame_a::bigint * 4294967296 + kp_a as a, frame_b::bigint * 4294967296 + kp_b as b from fx_matches")


@register(recursive(twin("select component as point_id, cast(node // 4294967296 as int) as frame_idx, cast(node % 4294967296 as bigint) as kp_idx from comp where component not in (select component from comp group by component, node // 4294967296 having count(*) > 1)", _NODES, *_components("edge"))))
def tr1_build_tracks(spark, d):
    return K.build_tracks(t(spark, d, "fx_matches"))


@register()
def tr2_triangulate(spark, d):
    return K.triangulate(t(spark, d, "fx_obs"), t(spark, d, "fx_poses"))


_NEAR = ("near", "select a.point_id as p, b.point_id as q, sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)+power(a.z-b.z,2)) as distance from fx_points a join fx_points b on a.point_id < b.point_id and abs(a.x-b.x) <= 0.1 and abs(a.y-b.y) <= 0.1 and abs(a.z-b.z) <= 0.1 where sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)+power(a.z-b.z,2)) <= 0.0995e0")


@register(twin("select p, q, round(distance, 6) as distance from near", _NEAR))
def tr9_merge_candidates(spark, d):
    return rounded(K.merge_candidates(t(spark, d, "fx_points"), 0.0995), "distance")


@register()
def tr9_merge_points(spark, d):
    return K.merge_points(t(spark, d, "fx_points"), t(spark, d, "fx_obs"), t(spark, d, "fx_poses"), 0.06)


def _free_everywhere(spark, d):
    """Candidates over all frames, every second keypoint of each being free."""
    obs = t(spark, d, "fx_obs")
    return K.project_candidates(t(spark, d, "fx_points"), obs.where("kp_idx % 2 = 1"), obs.select("frame_idx", "kp_idx", "u", "v"), t(spark, d, "fx_poses"), 2.5)


@register(
    twin(
        """select frame_idx, point_id, kp_idx, round(distance, 5) as distance from (
  select p.frame_idx, p.point_id, k.kp_idx, sqrt(power(pu-k.u,2)+power(pv-k.v,2)) as distance
  from (select f.frame_idx, q.point_id, 1000*(f.r00*x+f.r01*y+f.r02*z+f.t0)/(f.r20*x+f.r21*y+f.r22*z+f.t2)+640 as pu, 1000*(f.r10*x+f.r11*y+f.r12*z+f.t1)/(f.r20*x+f.r21*y+f.r22*z+f.t2)+360 as pv
    from (select * from fx_points where point_id not in (select point_id from bound group by 1 having count(*) >= 10)) q, fx_poses f where f.r20*x+f.r21*y+f.r22*z+f.t2 > 1e-6) p
  join free k on k.frame_idx = p.frame_idx and abs(k.u - pu) <= 3 and abs(k.v - pv) <= 3
  where pu >= 0 and pu < 1280 and pv >= 0 and pv < 720 and not exists (select 1 from bound b where b.frame_idx = p.frame_idx and b.point_id = p.point_id))
where distance <= 2.5e0""",
        ("bound", "select * from fx_obs where kp_idx % 2 = 1"), ("free", "select * from fx_obs where kp_idx % 2 = 0"),
    )
)
def tr10_project_candidates(spark, d):
    return rounded(_free_everywhere(spark, d), "distance", digits=5)


@register()
def tr10_assign_candidates(spark, d):
    return K.assign_candidates(_free_everywhere(spark, d))


@register(
    twin(
        """select frame_idx, kp_idx, point_id, into_id as "into" from (select a.frame_idx, a.kp_idx, a.point_id, b.point_id as into_id, power(b.pu-a.u,2)+power(b.pv-a.v,2) as n2, power(a.pu-a.u,2)+power(a.pv-a.v,2) as o2,
    row_number() over (partition by a.frame_idx, a.kp_idx order by power(b.pu-a.u,2)+power(b.pv-a.v,2), b.point_id) as r
  from s a join rad using (frame_idx) join s b on a.frame_idx = b.frame_idx and abs(b.pu-a.u) <= rr and abs(b.pv-a.v) <= rr where power(b.pu-a.u,2)+power(b.pv-a.v,2) <= rr*rr)
join (select point_id as into_id, count(*) as have from fx_obs group by 1) using (into_id) where r = 1 and into_id <> point_id and have < 10 and n2 < 0.5e0*o2""",
        ("s", """select o.frame_idx, o.kp_idx, o.point_id, o.u, o.v, 1000*(f.r00*x+f.r01*y+f.r02*z+f.t0)/(f.r20*x+f.r21*y+f.r22*z+f.t2)+640 as pu, 1000*(f.r10*x+f.r11*y+f.r12*z+f.t1)/(f.r20*x+f.r21*y+f.r22*z+f.t2)+360 as pv
from fx_obs o join fx_points using (point_id) join fx_poses f using (frame_idx) where f.r20*x+f.r21*y+f.r22*z+f.t2 > 1e-6"""),
        ("rad", "select frame_idx, greatest(6e0, least(24e0, 2*sqrt((max(pu)-min(pu))*(max(pv)-min(pv))/count(*)))) as rr from s group by 1"),
    )
)
def tr13_reassign_observations(spark, d):
    return K.reassign_observations(t(spark, d, "fx_obs"), t(spark, d, "fx_points"), t(spark, d, "fx_poses"), 12.0)


@register(
    recursive(
        twin(
            "select point_id, arg_max(who, r) as kp_idx from walk group by 1",
            ("rk", "select point_id, kp_idx, embedding as descr, row_number() over (partition by point_id order by frame_idx, kp_idx) as r from fx_obs, (select count(*) as n from embeddings) join embeddings on vec_id = kp_idx % n"),
            ("walk(point_id, r, who, now, age)", """select point_id, r, kp_idx, descr, 0 from rk where r = 1
  union all select point_id, r, case when fresh then kp_idx else who end, case when fresh then descr else now end, case when fresh then 0 else age + 1 end from (
    select k.*, w.who, w.now, w.age, k.r <= 3 or w.age > 5 or sqrt(list_sum(list_transform(range(1, len(k.descr) + 1), lambda i: power(k.descr[i]::double - w.now[i]::double, 2)))) >= 1.08e0 as fresh
    from walk w join rk k on k.point_id = w.point_id and k.r = w.r + 1)"""),
        )
    )
)
def tr17_representative_descriptor(spark, d):
    e = t(spark, d, "embeddings")
    o = t(spark, d, "fx_obs").crossJoin(F.broadcast(e.agg(F.count("*").alias("n")))).withColumn("vec_id", F.col("kp_idx") % F.col("n"))
    return K.representative_descriptor(o.join(e.select("vec_id", F.col("embedding").alias("descr")), "vec_id"), 0.9)


@register()
def ge8_estimate_similarity(spark, d):
    p = t(spark, d, "fx_points").select((F.col("point_id") % 50).alias("g"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"))
    p = p.withColumns({"dx": 2 * (0.6 * F.col("sx") - 0.8 * F.col("sy")) + F.col("g"), "dy": 2 * (0.8 * F.col("sx") + 0.6 * F.col("sy")) - 1, "dz": 2 * F.col("sz") + 3})
    return rounded(K.estimate_similarity(p, "g"), "s", *G.POSE)


@register()
def ge9_undistort_points(spark, d):
    out = K.undistort_points(t(spark, d, "fx_obs").select("point_id", "frame_idx", "u", "v"), G.Camera(), [1000.0, 1000.0, 640.0, 360.0, 0.02, -0.003, 0.001, -0.0005, 0.0004, -0.0001, 0.0003, 0.0002])
    return rounded(out.select("point_id", "frame_idx", "uu", "uv"), "uu", "uv", digits=4)


@register(
    """select dataset_id, side as image_size, f as feature_count, greatest(80, cast(trunc(f*0.01e0) as int)) as min_features, rt as reproj_thresh, rt*0.8e0 as ransac_thresh,
  greatest(5e0, least(20e0, side*0.008e0)) as guided_radius_px, cast(case when n <= 20 then greatest(1, n-1) when n <= 50 then n else 15 end as int) as init_candidate_window,
  cast(case when n <= 50 then n*(n-1)//2 else greatest(100, least(500, n*3)) end as int) as init_max_pairs, cast(trunc(greatest(60e0, least(120e0, side*0.022e0))) as int) as init_min_inliers,
  cast(trunc(greatest(6e0, least(12e0, 12 - log10(greatest(n, 10))*2))) as int) as ba_local_covis_neighbors, cast(trunc(greatest(40e0, least(80e0, 40 + log2(greatest(n, 2))*3))) as int) as ba_global_iters,
  cast(trunc(greatest(400e0, least(1500e0, sqrt(n)*40))) as int) as loop_vocab_size, cast(greatest(15, n//8) as int) as loop_min_gap
from (select dataset_id, n, side, case when orb then cast(trunc(base*1.5e0) as int) else base end as f, case when orb then greatest(1e0, least(4e0, side*0.002e0)) else greatest(0.5e0, least(2e0, side*0.001e0)) end as rt
  from (select p_partkey as dataset_id, p_size*11 as n, greatest(480 + p_size*20, 640 + p_size*40)::double as side, cast(trunc(greatest(2000e0, least(12000e0, sqrt((480 + p_size*20)*(640 + p_size*40)::double)*1.5e0))) as int) as base, p_size % 2 = 0 as orb from part))"""
)
def ge11_auto_config(spark, d):
    s = F.col("p_size")
    p = t(spark, d, "part").select(F.col("p_partkey").alias("dataset_id"), (s * 11).alias("n_frames"), (480 + s * 20).alias("h"), (640 + s * 40).alias("w"), F.when(s % 2 == 0, "orb").otherwise("sift").alias("feature"))
    return G.auto_config(p).select("dataset_id", "image_size", "feature_count", "min_features", "reproj_thresh", "ransac_thresh", "guided_radius_px", "init_candidate_window", "init_max_pairs", "init_min_inliers", "ba_local_covis_neighbors", "ba_global_iters", "loop_vocab_size", "loop_min_gap")


def _lost(spark, d):
    obs, points, poses = t(spark, d, "fx_obs"), t(spark, d, "fx_points"), t(spark, d, "fx_poses")
    return obs, points, poses, poses.where("frame_idx % 5 = 0")


_RG2 = (
    "corr",
    """select frame_idx, kp_idx, point_id from (select m.frame_idx, m.kp_idx, o.point_id, row_number() over (partition by m.frame_idx, m.kp_idx order by count(*) desc, o.point_id) as r
from (select frame_b as frame_idx, kp_b as kp_idx, frame_a as f, kp_a as k from fx_matches union all select frame_a, kp_a, frame_b, kp_b from fx_matches) m join fx_obs o on o.frame_idx = m.f and o.kp_idx = m.k
where m.frame_idx % 5 = 0 and m.f % 5 <> 0 group by m.frame_idx, m.kp_idx, o.point_id) where r = 1""",
)


def correspondences(spark, d):
    obs, points, _, lost = _lost(spark, d)
    return X.correspondences_3d2d(t(spark, d, "fx_matches"), obs, points, lost, obs)


@register(twin("select c.frame_idx, c.point_id, c.kp_idx, round(o.u, 5) + 0e0 as u, round(p.x, 6) as x from (select frame_idx, kp_idx, point_id from corr) c join fx_obs o on o.frame_idx = c.frame_idx and o.kp_idx = c.kp_idx join fx_points p on p.point_id = c.point_id", _RG2))
def rg2_correspondences(spark, d):
    out = correspondences(spark, d).select("frame_idx", "point_id", "kp_idx", "u", "x")
    return rounded(rounded(out, "u", digits=5), "x")


@register(
    twin(
        """select frame_a as frame_idx, frame_b as f from (select *, row_number() over (partition by frame_a order by n desc, frame_b) as r from bothw where frame_a % 5 = 0 and frame_b % 5 <> 0) where r <= 20
union all select frame_idx, f from fx_poses, (select frame_idx as f from fx_poses where frame_idx % 5 <> 0 order by 1 desc limit 20) where frame_idx % 5 = 0 and frame_idx not in (select frame_a from bothw where frame_b % 5 <> 0)""",
        COV, BOTH,
    )
)
def rg2_choose_neighbours(spark, d):
    _, _, poses, lost = _lost(spark, d)
    return X.choose_neighbours(lost, covis(spark, d), poses.where("frame_idx % 5 <> 0"))


@register()
def rg1_resect(spark, d):
    return X.resect(correspondences(spark, d))


@register()
def rg3_register_rounds(spark, d):
    obs, points, poses, lost = _lost(spark, d)
    matches = t(spark, d, "fx_matches")
    known = poses.where("frame_idx % 5 <> 0")
    bound = obs.where("frame_idx % 5 <> 0").join(points.select("point_id"), "point_id", "left_semi")
    # frames are alike by the matches they share, of the most that any two do
    met = matches.groupBy("frame_a", "frame_b").agg(F.count("*").alias("n"))
    alike = met.join(F.broadcast(met.agg(F.max("n").alias("top")))).select("frame_a", "frame_b", (F.col("n") / F.col("top")).alias("score"))  # one row
    alike = alike.unionByName(alike.select(F.col("frame_b").alias("frame_a"), F.col("frame_a").alias("frame_b"), "score"))
    done, _, _ = X.register_rounds(matches, obs, bound, points, known, poses.select("frame_idx"), similar=alike)
    return done.select("frame_idx", "is_keyframe", *G.POSE)


@register(twin("select frame_idx // 10 as seq_id, frame_idx, round(t0, 5) + 0e0 as t0, round(t1, 5) + 0e0 as t1, round(t2, 5) + 0e0 as t2 from fx_poses"))
def rg4_chain_two_view_pose(spark, d):
    poses = t(spark, d, "fx_poses")
    pairs = poses.select(F.col("frame_idx").alias("frame_a"), (F.col("frame_idx") + 1).alias("frame_b")).where("floor(frame_a / 10) = floor(frame_b / 10)")
    edges = G.relative_pose(pairs, poses).withColumn("seq_id", F.floor(F.col("frame_a") / 10).cast("int"))
    start = poses.withColumn("seq_id", F.floor(F.col("frame_idx") / 10).cast("int")).where("frame_idx % 10 = 0 or frame_idx = 1")
    return rounded(X.chain_two_view_pose(edges, start).select("seq_id", "frame_idx", *G.T), *G.T, digits=5)


def _noisy(spark, d):
    obs = t(spark, d, "fx_obs")
    points = t(spark, d, "fx_points").select("point_id", (F.col("x") + (F.col("point_id") % 7 - 3) * 0.004).alias("x"), "y", "z")
    poses = t(spark, d, "fx_poses").withColumn("t0", F.col("t0") + F.when(F.col("frame_idx") > 2, 0.01).otherwise(0.0))
    return obs, points, poses


@register()
def rg5_refine_step(spark, d):
    s = RF.refine_step(*_noisy(spark, d), fixed=[1, 2], cam=G.Camera(fx=1030.0, fy=1030.0), intrinsics=("f",))
    return s.poses.select("frame_idx", *G.POSE, F.lit(float(s.cam.fx)).alias("f"), F.lit(s.cost).alias("cost"), F.lit(s.after).alias("after"))


@register()
def rg6_refine_loop(spark, d):
    _, _, poses, cam, history = RF.refine_loop(*_noisy(spark, d), fixed=[1, 2], weightings=2, steps=3, cam=G.Camera(fx=1030.0, fy=1030.0), intrinsics=("f",))
    return poses.select("frame_idx", *G.POSE, F.lit(float(cam.fx)).alias("f"), F.lit(history[0]["cost"]).alias("cost"), F.lit(history[-1]["after"]).alias("after"))


def _revisited(spark, d):
    """Frames seen again: every fifth frame, moved by 0.4 to the side and with new keypoints, as frame 100000 + its index."""
    obs, points, poses = t(spark, d, "fx_obs"), t(spark, d, "fx_points"), t(spark, d, "fx_poses")
    again = poses.where("frame_idx % 5 = 0").withColumns({"frame_idx": F.col("frame_idx") + 100_000, "t0": F.col("t0") + 0.4})
    near = obs.where("frame_idx % 5 = 0").select((F.col("frame_idx") + 100_000).alias("frame_idx"), "point_id").distinct()
    seen = G.project(near.join(again, "frame_idx").join(points, "point_id")).select("point_id", "frame_idx", (-F.col("point_id")).alias("kp_idx"), F.col("pu").alias("u"), F.col("pv").alias("v"))
    every = obs.select("point_id", "frame_idx", "kp_idx", "u", "v").unionByName(seen)
    # a point looks the same in all frames: two embeddings beside one another tell it from others
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    n = F.broadcast(e.agg(F.count("*").alias("n")))  # one row
    keyed = every.join(n).withColumns({"i": F.col("point_id") % F.col("n"), "j": F.floor(F.col("point_id") / F.col("n")) % F.col("n")})
    descr = keyed.join(e.toDF("i", "di"), "i").join(e.toDF("j", "dj"), "j").select("frame_idx", "kp_idx", F.concat("di", "dj").alias("descr"))
    return every, descr, obs, points, poses, again


@register()
def bw8_close_loops(spark, d):
    every, descr, obs, points, poses, again = _revisited(spark, d)
    # every frame seen again with the frames around the one it was: one true loop each, and others
    near = again.select("frame_idx").withColumn("frame_a", F.explode(F.sequence(F.col("frame_idx") - 100_003, F.col("frame_idx") - 99_997)))
    pairs = near.join(poses.select(F.col("frame_idx").alias("frame_a")), "frame_a", "left_semi").select("frame_a", F.col("frame_idx").alias("frame_b"))
    words = every.select("frame_idx", (F.col("point_id") % 200).cast("int").alias("word"))
    h = B.tfidf_histograms(words, B.idf(words))
    frames = every.select("frame_idx").distinct()
    similar = B.similarity(h, h, 5, 0.3, asked=B.neighbourhood(pairs, frames))
    loops, _ = L.close_loops(pairs, descr, every, obs, points, poses, similar, frames, matches=100)
    return loops


@register()
def ma12_choose_seed(spark, d):
    every, descr, _, _, _, _ = _revisited(spark, d)
    met = t(spark, d, "fx_matches").groupBy("frame_a", "frame_b").agg(F.count("*").cast("int").alias("score"))
    return L.choose_seed(met, descr, every, rounds=((60, 6.0, 0.30), (40, 3.0, 0.20), (15, 0.5, 0.15)), points=10)


_CAND = "select l_orderkey as frame_a, l_suppkey as frame_b, l_quantity as matches, l_quantity * 0.7e0 as inliers, l_linenumber * 4 as links, l_linenumber as votes, l_quantity / 3 as resected, l_quantity as rows, l_extendedprice / 30000 as scale from {lineitem}"


@register("select count(*) as candidates, count(*) filter (where g) as gap, count(*) filter (where g and m >= 15) as matched, count(*) filter (where g and m >= 15 and m * 0.7e0 >= 10) as verified, count(*) filter (where g and m >= 15 and m * 0.7e0 >= 10 and n * 4 >= 8) as linked, count(*) filter (where g and m >= 15 and m * 0.7e0 >= 10 and n * 4 >= 8 and n >= 2) as consistent, count(*) filter (where g and m >= 15 and m * 0.7e0 >= 10 and n * 4 >= 8 and n >= 2 and m / 3 >= 8) as resected from (select abs(l_orderkey - l_suppkey) >= 40 as g, l_quantity as m, l_linenumber as n from lineitem)")
def bw8_verify_loops(spark, d):
    return X.verify_loops(spark.sql(_CAND, lineitem=t(spark, d, "lineitem")), 40)[1]
