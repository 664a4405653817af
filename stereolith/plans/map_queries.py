"""Queries of the geometry, point and observation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereolith.operators import geometry as G
from stereolith.operators import quality as Q
from stereolith.plans.registry import register
from stereolith.sources.fixtures import table as t
from stereolith.sources.fixtures import twin


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles as both engines show them: rounded, no negative zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


#: Residuals of all observations, at f 1000 and centre (640, 360).
RES = (
    "res",
    """select o.point_id, o.frame_idx, o.kp_idx, o.u, o.v, p.x, p.y, p.z, w.zc as depth,
  sqrt(power(1000*w.xc/w.zs + 640 - o.u, 2) + power(1000*w.yc/w.zs + 360 - o.v, 2)) as err
from fx_obs o join fx_points p using (point_id) join fx_poses f using (frame_idx),
lateral (select f.r00*p.x+f.r01*p.y+f.r02*p.z+f.t0 as xc, f.r10*p.x+f.r11*p.y+f.r12*p.z+f.t1 as yc, f.r20*p.x+f.r21*p.y+f.r22*p.z+f.t2 as zc,
  case when abs(f.r20*p.x+f.r21*p.y+f.r22*p.z+f.t2) < 1e-9 then 1e-9 else f.r20*p.x+f.r21*p.y+f.r22*p.z+f.t2 end as zs) w""",
)
PE = ("pe", "select point_id, coalesce(avg(err) filter (where depth > 0), 'infinity'::double) as err, count(*) filter (where depth > 0) as valid_count, avg(case when depth > 0 then 0e0 else 1e0 end) as neg_ratio from res group by 1")
CEN = ("cen", "select frame_idx, -(r00*t0+r10*t1+r20*t2) as cx, -(r01*t0+r11*t1+r21*t2) as cy, -(r02*t0+r12*t1+r22*t2) as cz from fx_poses")
RAY = ("ray", "select point_id, frame_idx, (x-cx)/n as dx, (y-cy)/n as dy, (z-cz)/n as dz from (select *, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) as n from fx_obs join cen using (frame_idx) join fx_points using (point_id)) where n > 1e-12")
ANG = (
    "ang",
    """select point_id, coalesce(angle, 0e0) as angle from (select distinct point_id from ray) left join (
  select a.point_id, max(degrees(acos(greatest(-1e0, least(1e0, a.dx*b.dx+a.dy*b.dy+a.dz*b.dz))))) as angle
  from ray a join ray b on a.point_id = b.point_id and a.frame_idx < b.frame_idx group by 1) using (point_id)""",
)


@register(twin("select frame_idx, round(-(r00*t0+r10*t1+r20*t2), 6) + 0e0 as cx, round(-(r01*t0+r11*t1+r21*t2), 6) + 0e0 as cy, round(-(r02*t0+r12*t1+r22*t2), 6) + 0e0 as cz from fx_poses"))
def ge1_camera_center(spark, d):
    return rounded(G.camera_center(t(spark, d, "fx_poses")), "cx", "cy", "cz")


def next_pairs(poses: DataFrame) -> DataFrame:
    return poses.select(F.col("frame_idx").alias("frame_a"), (F.col("frame_idx") + 1).alias("frame_b"))


_REL = ("rel", "select a.frame_idx as frame_a, b.frame_idx as frame_b, " + ", ".join(f"b.r{i}0*a.r{j}0+b.r{i}1*a.r{j}1+b.r{i}2*a.r{j}2 as m{i}{j}" for i in range(3) for j in range(3)) + ", a.t0 as at0, a.t1 as at1, a.t2 as at2, b.t0 as bt0, b.t1 as bt1, b.t2 as bt2 from fx_poses a join fx_poses b on b.frame_idx = a.frame_idx + 1")


@register(twin("select frame_a, frame_b, " + ", ".join(f"round(m{i}{j}, 6) + 0e0 as r{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"round(bt{i} - (m{i}0*at0+m{i}1*at1+m{i}2*at2), 6) + 0e0 as t{i}" for i in range(3)) + " from rel", _REL))
def ge2_relative_pose(spark, d):
    poses = t(spark, d, "fx_poses")
    return rounded(G.relative_pose(next_pairs(poses), poses), *G.POSE)


@register(twin("select a.frame_idx, " + ", ".join(f"round(a.r{i}0*b.r0{j}+a.r{i}1*b.r1{j}+a.r{i}2*b.r2{j}, 6) + 0e0 as r{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"round(a.r{i}0*b.t0+a.r{i}1*b.t1+a.r{i}2*b.t2+a.t{i}, 6) + 0e0 as t{i}" for i in range(3)) + " from fx_poses a join fx_poses b on b.frame_idx = a.frame_idx + 1"))
def ge2_compose_pose(spark, d):
    poses = t(spark, d, "fx_poses")
    met = G.prefixed(poses, "a_").join(G.prefixed(poses, "b_").withColumn("frame_idx", F.col("frame_idx") - 1), "frame_idx")
    return rounded(met.select("frame_idx", *[v.alias(k) for k, v in G.composed("a_", "b_").items()]), *G.POSE)


@register(twin("select frame_idx, round(degrees(acos(greatest(-1e0, least(1e0, (r00+r11+r22-1)/2)))), 4) as angle from fx_poses"))
def ge3_rotation_angle(spark, d):
    return rounded(G.rotation_angles(t(spark, d, "fx_poses")), "angle", digits=4)


_QUAT = (
    "quat",
    """select frame_idx, x/n as qx, y/n as qy, z/n as qz, w/n as qw from (select *, sqrt(x*x+y*y+z*z+w*w)+1e-12 as n from (
  select frame_idx, (r21-r12)/s as x, (r02-r20)/s as y, (r10-r01)/s as z, s/4 as w from (select *, sqrt(r00+r11+r22+1)*2 as s from fx_poses where r00+r11+r22 > 0)))""",
)


@register(twin("select frame_idx, round(qx, 6) + 0e0 as qx, round(qy, 6) + 0e0 as qy, round(qz, 6) + 0e0 as qz, round(qw, 6) + 0e0 as qw from quat", _QUAT))
def ge4_quaternions(spark, d):
    return rounded(G.quaternions(t(spark, d, "fx_poses")), "qx", "qy", "qz", "qw")


@register(twin("select frame_idx, " + ", ".join(f"round({c}, 6) + 0e0 as {c}" for c in G.R) + " from fx_poses"))
def ge4_quaternion_round_trip(spark, d):
    return rounded(G.rotations(G.quaternions(t(spark, d, "fx_poses"))), *G.R)


@register(
    twin(
        """select point_id, frame_idx, round(1000*x*(1+0.05e0*(x*x+y*y))+640, 4) + 0e0 as pu, round(1000*y*(1+0.05e0*(x*x+y*y))+360, 4) + 0e0 as pv, round(zc, 6) as depth from (
  select o.point_id, o.frame_idx, (f.r00*p.x+f.r01*p.y+f.r02*p.z+f.t0)/(f.r20*p.x+f.r21*p.y+f.r22*p.z+f.t2) as x, (f.r10*p.x+f.r11*p.y+f.r12*p.z+f.t1)/(f.r20*p.x+f.r21*p.y+f.r22*p.z+f.t2) as y, f.r20*p.x+f.r21*p.y+f.r22*p.z+f.t2 as zc
  from fx_obs o join fx_points p using (point_id) join fx_poses f using (frame_idx))"""
    )
)
def ge5_project(spark, d):
    rows = t(spark, d, "fx_obs").join(t(spark, d, "fx_poses"), "frame_idx").join(t(spark, d, "fx_points"), "point_id")
    out = G.project(rows, G.Camera(k1=0.05)).select("point_id", "frame_idx", "pu", "pv", "depth")
    return rounded(rounded(out, "pu", "pv", digits=4), "depth")


@register(twin("select round(greatest(sqrt(power(max(cx)-min(cx),2)+power(max(cy)-min(cy),2)+power(max(cz)-min(cz),2)), 1e-6), 6) as scale from cen", CEN))
def ge6_scene_scale(spark, d):
    return rounded(G.scene_scale(t(spark, d, "fx_poses")), "scale")


@register(twin("select round(median(sqrt(power(x-mx,2)+power(y-my,2)+power(z-mz,2)))+1e-6, 6) as radius from fx_points, (select avg(x) as mx, avg(y) as my, avg(z) as mz from fx_points)"))
def ge7_scene_median_radius(spark, d):
    return rounded(G.scene_median_radius(t(spark, d, "fx_points")), "radius")


_K = (0.01, -0.002, 0.0003, -0.00004)
_S = (0.001, -0.0005, 0.0002, 0.00003, -0.0001, 0.00002)


@register(
    twin(
        """select point_id, frame_idx, round(1000*(x*rad+2*0.001e0*x*y-0.0005e0*(q+2*x*x)+0.0002e0*q+0.00003e0*q*q)+640, 4) as du, round(1000*(y*rad-2*0.0005e0*x*y+0.001e0*(q+2*y*y)-0.0001e0*q+0.00002e0*q*q)+360, 4) as dv
from (select *, x*x+y*y as q, 1+(x*x+y*y)*(0.01e0+(x*x+y*y)*(-0.002e0+(x*x+y*y)*(0.0003e0+(x*x+y*y)*-0.00004e0))) as rad from (
  select point_id, frame_idx, a*s as x, b*s as y from (select *, case when sqrt(a*a+b*b) < 1e-9 then 1e0 else atan(sqrt(a*a+b*b))/sqrt(a*a+b*b) end as s from (
    select point_id, frame_idx, (u-640)/1000 as a, (v-360)/1000 as b from fx_obs))))"""
    )
)
def ge10_distort_points(spark, d):
    out = G.distort_points(t(spark, d, "fx_obs"), k=_K, s=_S).select("point_id", "frame_idx", "du", "dv")
    return rounded(out, "du", "dv", digits=4)


@register(
    """select pair, cast(greatest(0, cast(floor(fb/far) as int) - 2) as int) as min_disparity,
  cast(least(256, greatest(16, 16*cast(ceil(greatest(ceil(fb/near) - greatest(0, cast(floor(fb/far) as int) - 2) + 2, 16)/16) as int))) as int) as num_disparities
from (select p_partkey as pair, 800e0*(0.05e0 + p_size/100e0) as fb, 0.5e0 + p_size/25e0 as near, 10e0 + p_retailprice/100 as far from part)"""
)
def ge12_disparity_range(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("pair"), F.lit(800.0).alias("focal"), (0.05 + F.col("p_size") / 100.0).alias("baseline"), (0.5 + F.col("p_size") / 25.0).alias("near"), (10.0 + F.col("p_retailprice") / 100).alias("far"))
    return G.disparity_range(p).select("pair", "min_disparity", "num_disparities")


_DISP = "select src as pair_id, cast(floor(x*60) as int) as px, cast(floor(y*70) as int) as py, 2 + z*4 as disp from {fx_dense}"


@register(
    twin(
        """select pair_id, px, py, round(c0*r00+c1*r10+c2*r20, 4) + 0e0 as x, round(c0*r01+c1*r11+c2*r21, 4) + 0e0 as y, round(c0*r02+c1*r12+c2*r22, 4) + 0e0 as z from (
  select pair_id, px, py, p0*m.r00+p1*m.r10+p2*m.r20-f.t0 as c0, p0*m.r01+p1*m.r11+p2*m.r21-f.t1 as c1, p0*m.r02+p1*m.r12+p2*m.r22-f.t2 as c2, f.r00, f.r01, f.r02, f.r10, f.r11, f.r12, f.r20, f.r21, f.r22
  from (select pair_id, px, py, disp, (px-640e0)/(4*disp) as p0, (py-360e0)/(4*disp) as p1, 1000/(4*disp) as p2 from (select src as pair_id, cast(floor(x*60) as int) as px, cast(floor(y*70) as int) as py, 2 + z*4 as disp from fx_dense))
  join fx_poses f on f.frame_idx = pair_id join fx_poses m on m.frame_idx = pair_id % 7 + 1 where disp >= 4 and p2 > 8 and p2 < 60)"""
    )
)
def ge13_disparity_to_points(spark, d):
    poses = t(spark, d, "fx_poses")
    disp = spark.sql(_DISP, fx_dense=t(spark, d, "fx_dense"))
    q = [1.0, 0.0, 0.0, -640.0, 0.0, 1.0, 0.0, -360.0, 0.0, 0.0, 0.0, 1000.0, 0.0, 0.0, 4.0, 0.0]
    turn = poses.select(F.col("frame_idx").alias("k"), *[F.col(c).alias("m" + c[1:]) for c in G.R])
    calib = poses.withColumn("k", F.col("frame_idx") % 7 + 1).join(turn, "k").select(F.col("frame_idx").cast("long").alias("pair_id"), F.lit(3).alias("min_disparity"), *[F.lit(v).alias(f"q{i}") for i, v in enumerate(q)], *G.POSE, *["m" + c[1:] for c in G.R])
    return rounded(G.disparity_to_points(disp, calib, min_disp=4.0, min_depth=8.0, max_depth=60.0), "x", "y", "z", digits=4)


def _opt(spark, d):
    return t(spark, d, "fx_obs"), t(spark, d, "fx_points"), t(spark, d, "fx_poses")


@register(twin("select point_id, case when isinf(err) then null else round(err, 6) end as err, cast(valid_count as bigint) as valid_count, round(neg_ratio, 6) as neg_ratio from pe", RES, PE))
def tr4_point_errors(spark, d):
    e = Q.point_errors(*_opt(spark, d)).withColumn("err", F.when(F.col("err") < float("inf"), F.col("err")))
    return rounded(e, "err", "neg_ratio")


@register(twin("select point_id, round(angle, 4) as angle from ang", CEN, RAY, ANG))
def tr5_tri_angles(spark, d):
    return rounded(Q.tri_angles(*_opt(spark, d)), "angle", digits=4)


@register(twin("select point_id, frame_idx, kp_idx, n_obs, round(err, 6) as err from (select *, count(*) over (partition by point_id) as n_obs from res where depth > 1e-9 and err <= 16) where n_obs >= 2", RES))
def tr6_filter_observations(spark, d):
    return rounded(Q.filter_observations(*_opt(spark, d), 16.0).select("point_id", "frame_idx", "kp_idx", "n_obs", "err"), "err")


@register(
    twin(
        """select point_id, n_obs, case when n_obs < 2 then 'few' when coalesce(neg_ratio, 1) >= 0.5e0 then 'behind' when valid_count > 0 and err > lim then 'error' when coalesce(angle, 0) < 1.5e0 then 'angle' end as reason
from (select point_id, count(*) as n_obs from fx_obs group by 1) left join pe using (point_id) left join ang using (point_id),
(select case when count(*) > 10 then greatest(16e0, 3*median(abs(err - mid))) else 16e0 end as lim from pe, (select median(err) as mid from pe where valid_count >= 2 and not isinf(err)) where valid_count >= 2 and not isinf(err))""",
        RES, PE, CEN, RAY, ANG,
    )
)
def tr7_prune_points(spark, d):
    return Q.prune_points(*_opt(spark, d))


@register(twin("select point_id, round(err, 6) as err from pe where valid_count >= 2 and neg_ratio < 0.5e0 and err < (select greatest(3*median(err), 1e0) from pe where valid_count >= 2 and neg_ratio < 0.5e0)", RES, PE))
def tr8_final_cloud_mask(spark, d):
    return rounded(Q.final_cloud_mask(Q.point_errors(*_opt(spark, d)), 0.5), "err")


_FRESH = "select point_id, case when point_id % 3 = 0 then x + 0.5e0 else x end as x, y, case when point_id % 5 = 0 then z + 1 else z end as z from {fx_points}"
_BASE = "select point_id, case when point_id % 2 = 0 then x + 0.2e0 else x end as x, y, z from {fx_points}"


def _sq(points: str, name: str) -> tuple[str, str]:
    return name, RES[1].replace("fx_points", points)


@register(
    twin(
        """select p.point_id, round(case when taken then f.x else p.x end, 6) + 0e0 as x, round(case when taken then f.y else p.y end, 6) + 0e0 as y, round(case when taken then f.z else p.z end, 6) + 0e0 as z, coalesce(taken, false) as taken
from p0 p join f0 f using (point_id) left join (
  select o.point_id, coalesce(n.e < 0.9e0*o.e and n.depth > 1e-9, false) as taken
  from (select point_id, avg(err*err) as e, count(*) as n from ro group by 1 having count(*) >= 3 order by n desc, point_id limit 8000) o join (select point_id, avg(err*err) as e, min(depth) as depth from rf group by 1) n using (point_id)) using (point_id)""",
        ("p0", _BASE.format(fx_points="fx_points")), ("f0", _FRESH.format(fx_points="fx_points")), _sq("p0", "ro"), _sq("f0", "rf"),
    )
)
def tr3_accept_retriangulation(spark, d):
    obs, points, poses = _opt(spark, d)
    out = Q.accept_retriangulation(obs, spark.sql(_BASE, fx_points=points), spark.sql(_FRESH, fx_points=points), poses)
    return rounded(out, "x", "y", "z")


@register(twin("select point_id, frame_idx from (select * from fx_obs where kp_idx % 8 = 1) join (select point_id from (select point_id, count(*) as n from fx_obs group by 1) left join ang using (point_id) where n < 2 or coalesce(angle, 0) >= 20) using (point_id)", CEN, RAY, ANG))
def tr11_angle_gate(spark, d):
    obs, points, poses = _opt(spark, d)
    new, old = obs.where("kp_idx % 8 = 1"), obs.where("kp_idx % 8 <> 1")
    return Q.angle_gate(new, old, points, poses, 20.0).select("point_id", "frame_idx")


@register(
    twin(
        """select point_id, frame_idx, kp_idx from (
  select n.*, coalesce(have, 0) as have, row_number() over (partition by n.point_id order by n.frame_idx, n.kp_idx) as turn
  from (select * from fx_obs where kp_idx % 8 >= 4) n left join (select point_id, count(*) as have from fx_obs where kp_idx % 8 < 4 group by 1) h on h.point_id = n.point_id
  where not exists (select 1 from fx_obs o where o.kp_idx % 8 < 4 and o.frame_idx = n.frame_idx and o.kp_idx = n.kp_idx)) where have + turn <= 4"""
    )
)
def tr12_cap_observations(spark, d):
    obs = t(spark, d, "fx_obs")
    return Q.cap_observations(obs.where("kp_idx % 8 >= 4"), obs.where("kp_idx % 8 < 4"), 4).select("point_id", "frame_idx", "kp_idx")


def _em() -> list[tuple[str, str]]:
    out = [("w0", "select frame_idx, kp_idx, err*err as r2, greatest(median(err*err) over (partition by frame_idx)/2, 1e-6) as s, 0.7e0 as p, 1/greatest(max(err*err) over (partition by frame_idx), 1e0) as q from res")]
    for k in range(3):
        out.append((f"e{k}", f"select *, p*exp(-r2/(2*s)) as g from w{k}"))
        out.append((f"g{k}", f"select frame_idx, kp_idx, r2, q, g/(g+(1-p)*q+1e-30) as w from e{k}"))
        out.append((f"w{k + 1}", f"select frame_idx, kp_idx, r2, q, w, greatest(sum(w*r2) over (partition by frame_idx)/greatest(sum(w) over (partition by frame_idx), 1e-6), 1e-6) as s, greatest(1e-3, avg(w) over (partition by frame_idx)) as p from g{k}"))
    return out


@register(twin("select frame_idx, kp_idx, round(greatest(0.01e0, least(1e0, w)), 4) as w from w3", RES, *_em()))
def tr14_inlier_weights(spark, d):
    r = Q.residuals(*_opt(spark, d)).select("frame_idx", "kp_idx", (F.col("err") * F.col("err")).alias("r2"))
    return rounded(Q.inlier_weights(r, "frame_idx").select("frame_idx", "kp_idx", "w"), "w", digits=4)


@register(twin("select point_id, coalesce(cast(floor(median(r)) as int), 128) as r, coalesce(cast(floor(median(g)) as int), 128) as g, coalesce(cast(floor(median(b)) as int), 128) as b from fx_points left join (select pt_id // 8 as point_id, r, g, b from fx_dense where r % 3 > 0) using (point_id) group by 1"))
def tr15_median_colors(spark, d):
    colored = t(spark, d, "fx_dense").where("r % 3 > 0").select(F.floor(F.col("pt_id") / 8).alias("point_id"), "r", "g", "b")
    return Q.median_colors(colored, t(spark, d, "fx_points"))


@register(twin("select point_id, row_number() over (partition by point_id order by frame_idx, kp_idx) as place, frame_idx, kp_idx from fx_obs"))
def tr16_observations_per_point(spark, d):
    out = Q.observations_per_point(t(spark, d, "fx_obs")).select("point_id", F.posexplode("obs"))
    return out.select("point_id", (F.col("pos") + 1).cast("long").alias("place"), "col.frame_idx", "col.kp_idx")


_BROKEN = "select case when kp_idx % 97 = 0 then -point_id else point_id end as point_id, case when kp_idx % 89 = 0 then frame_idx + 1000000 else frame_idx end as frame_idx, case when kp_idx % 83 = 0 then 1 else kp_idx end as kp_idx, u, v from {fx_obs} union all select * from {fx_obs} where kp_idx % 79 = 0"


@register(
    twin(
        """select 'frame missing' as rule, count(*) as n from o where not exists (select 1 from fx_poses f where f.frame_idx = o.frame_idx)
union all select 'point missing', count(*) from o where not exists (select 1 from fx_points p where p.point_id = o.point_id)
union all select 'observation repeated', count(*) from (select 1 from o group by point_id, frame_idx, kp_idx having count(*) > 1)
union all select 'keypoint of two points', count(*) from (select 1 from o group by frame_idx, kp_idx having count(distinct point_id) > 1)""",
        ("o", _BROKEN.format(fx_obs="fx_obs")),
    )
)
def tr18_check_integrity(spark, d):
    obs, points, poses = _opt(spark, d)
    return Q.check_integrity(spark.sql(_BROKEN, fx_obs=obs), points, poses)


@register(twin("select 'obs' as kind, count(*) as n from fx_obs where frame_idx % 4 <> 0 union all select 'poses', count(*) from fx_poses where frame_idx % 4 <> 0"))
def tr19_drop_frames(spark, d):
    obs, _, poses = _opt(spark, d)
    o, p = Q.drop_frames(obs, poses, poses.where("frame_idx % 4 = 0"))
    return o.agg(F.count("*").alias("n")).select(F.lit("obs").alias("kind"), "n").unionByName(p.agg(F.count("*").alias("n")).select(F.lit("poses").alias("kind"), "n"))


_SOLVE = [
    ("chosen", "select point_id, frame_idx, kp_idx from fx_obs where frame_idx % 2 = 0 order by md5(concat('42', ':', point_id, ':', frame_idx, ':', kp_idx)), point_id, frame_idx limit 20000"),
    ("best", "select point_id from (select point_id, count(*) as n from chosen group by 1 having count(distinct frame_idx) >= 2 order by n desc, point_id limit 2000)"),
]


@register(twin("select point_id, frame_idx, kp_idx from chosen join best using (point_id)", *_SOLVE))
def tr20_select_solve_set(spark, d):
    obs, _, poses = _opt(spark, d)
    return Q.select_solve_set(obs, poses.where("frame_idx % 2 = 0"), max_points=2000).select("point_id", "frame_idx", "kp_idx")


@register(twin("select frame_idx from (select frame_idx, count(*) as n from fx_obs group by 1 order by n desc, frame_idx limit 2)"))
def tr20_reference_frames(spark, d):
    return Q.reference_frames(t(spark, d, "fx_obs"), "local")


@register(twin("select frame_idx from fx_poses where frame_idx in (select frame_idx from fx_obs where kp_idx % 50 = 1)"))
def tr21_registered_frames(spark, d):
    obs, _, poses = _opt(spark, d)
    return Q.registered_frames(poses, obs.where("kp_idx % 50 = 1"))


@register(twin("select point_id, frame_idx, kp_idx from fx_obs where frame_idx >= 11 and point_id in (select point_id from fx_obs where frame_idx < 11) order by 1, 2, 3 limit 8000"))
def tr22_window_observations(spark, d):
    obs, _, poses = _opt(spark, d)
    return Q.window_observations(obs, poses.where("frame_idx < 11")).select("point_id", "frame_idx", "kp_idx")
