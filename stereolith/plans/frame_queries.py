"""Queries of frame sampling, listings, dense clouds and reports."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import functions as F

from stereolith.operators import dense as D
from stereolith.operators import geometry as G
from stereolith.operators import matching as M
from stereolith.operators import reports as P
from stereolith.operators import sampling as S
from stereolith.plans.map_queries import CEN, rounded
from stereolith.plans.registry import register
from stereolith.plans.scratch import Scratch
from stereolith.sources import listing as L
from stereolith.sources.fixtures import table as t
from stereolith.sources.fixtures import twin

_TOTALS = ("totals", "select video_id, count(*) as total from fx_frames group by 1")


def totals(spark, d):
    return t(spark, d, "fx_frames").groupBy("video_id").agg(F.count("*").alias("total"))


@register(twin("select video_id, cast(greatest(1, least(greatest(5, least(40, cast(trunc(total * (1 + video_id % 3) / 3e0) as int))), total)) as int) as target from totals", _TOTALS))
def fs1_target_frame_count(spark, d):
    v = totals(spark, d).select("video_id", "total", (1 + F.col("video_id") % 3).alias("fps"), F.lit(3.0).alias("fps_orig"))
    return S.target_frame_count(v, 5, 40).select("video_id", "target")


@register(twin("select distinct video_id, cast(f as int) as frame_no from (select video_id, unnest(list_append(range(0, total * 25, greatest(1, total * 25 // 100)), total * 25 - 1)) as f from totals)", _TOTALS))
def fs2_sample_points(spark, d):
    return S.sample_points(totals(spark, d).withColumn("total", F.col("total") * 25))


def _lin(i: str, n: str, k: str, how: str = "trunc") -> str:
    f = f"trunc({i} * (({n} - 1) / greatest({k} - 1, 1)::double))" if how == "trunc" else f"round_even({i} * (({n} - 1) / greatest({k} - 1, 1)::double), 0)"
    return f"case when {k} = 1 then 0 when {i} = {k} - 1 then cast({n} - 1 as int) else cast({f} as int) end"


@register(twin(f"select distinct video_id, {_lin('i', 'total', '7')} as frame_no from (select video_id, total, unnest(range(0, 7)) as i from totals)", _TOTALS))
def fs3_uniform_sample(spark, d):
    return S.uniform_sample(totals(spark, d).withColumn("n", F.lit(7)))


_SAMPLES = "select video_id, frame_no, flow as magnitude, frame_no % 11 <> 3 as readable from {fx_frames} where frame_no % 3 = 0"


@register(
    twin(
        """select video_id, frame_no, round(case when n = 1 then coalesce(lead(f) over (partition by video_id order by frame_no), f) else f end, 6) as flow from (
  select video_id, frame_no, row_number() over (partition by video_id order by frame_no) as n,
    case when readable and coalesce(lag(readable) over (partition by video_id order by frame_no), false) then magnitude / (frame_no - lag(frame_no) over (partition by video_id order by frame_no)) else 0e0 end as f from s)""",
        ("s", _SAMPLES.format(fx_frames="fx_frames")),
    )
)
def fs5_flow_rate(spark, d):
    return rounded(S.flow_rate(spark.sql(_SAMPLES, fx_frames=t(spark, d, "fx_frames"))).select("video_id", "frame_no", "flow"), "flow")


def interpolated(samples: str, column: str) -> str:
    """SQL of interpolate_to_full for one column, over ``totals``."""
    w = "(partition by video_id order by frame_no rows between unbounded preceding and current row)"
    v = "(partition by video_id order by frame_no rows between current row and unbounded following)"
    return f"""select video_id, frame_no, coalesce(case when p is null then qv when q is null or p = q then pv else pv + (qv - pv) * ((frame_no - p) / greatest(q - p, 1)::double) end, 0e0) as {column} from (
  select g.video_id, g.frame_no, last_value(s.frame_no ignore nulls) over (partition by g.video_id order by g.frame_no rows between unbounded preceding and current row) as p, last_value(s.{column} ignore nulls) over (partition by g.video_id order by g.frame_no rows between unbounded preceding and current row) as pv,
    first_value(s.frame_no ignore nulls) over (partition by g.video_id order by g.frame_no rows between current row and unbounded following) as q, first_value(s.{column} ignore nulls) over (partition by g.video_id order by g.frame_no rows between current row and unbounded following) as qv
  from (select video_id, cast(unnest(range(0, total)) as int) as frame_no from totals) g left join {samples} s on s.video_id = g.video_id and s.frame_no = g.frame_no)"""


@register(twin("select video_id, frame_no, round(sharpness, 6) as sharpness from inter", _TOTALS, ("s", "select video_id, frame_no, sharpness from fx_frames where frame_no % 4 = 1"), ("inter", interpolated("s", "sharpness"))))
def fs6_interpolate_to_full(spark, d):
    f = t(spark, d, "fx_frames")
    return rounded(S.interpolate_to_full(f.where("frame_no % 4 = 1"), totals(spark, d), ["sharpness"]), "sharpness")


_GATE = ("gated", """select video_id, frame_no, sharpness, flow, sharpness >= greatest(quantile_cont(sharpness, 0.05) over w, 0.08e0 * quantile_cont(sharpness, 0.5) over w) and flow >= greatest(quantile_cont(flow, 0.05) over w, 0.08e0 * quantile_cont(flow, 0.5) over w) as valid
from fx_frames window w as (partition by video_id)""")


@register(twin("select video_id, frame_no, valid from gated", _GATE))
def fs7_gate_frames(spark, d):
    return S.gate_frames(t(spark, d, "fx_frames")).select("video_id", "frame_no", "valid")


def _bin(total: str, bins: str) -> str:
    return f"len(list_filter(range(1, {bins}), lambda i: cast(trunc(i * ({total} / {bins}::double)) as int) <= frame_no))"


_COVER = [
    ("cov0", f"select *, {_bin('total', '20')} as b from (select *, count(*) over (partition by video_id) as total from gated)"),
    ("cov", "select video_id, frame_no, sharpness, flow, total, valid or (n < 2 and turn <= 2) as valid from (select *, sum(valid::int) over (partition by video_id, b) as n, row_number() over (partition by video_id, b order by sharpness * flow desc, frame_no desc) as turn from cov0)"),
]


@register(twin("select video_id, frame_no, valid from cov", _GATE, *_COVER))
def fs8_enforce_coverage(spark, d):
    return S.enforce_coverage(S.gate_frames(t(spark, d, "fx_frames")), 2).select("video_id", "frame_no", "valid")


def _stratified(source: str) -> list[tuple[str, str]]:
    """SQL of stratified_select over ``source`` (video_id, frame_no, valid, weight, target)."""
    return [
        ("st0", f"select *, cast(least(target, sum(valid::int) over (partition by video_id)) as bigint) as n, count(*) over (partition by video_id) as all_n from {source}"),
        ("st1", "select *, cast(least(20, n) as bigint) as bins from st0 where n > 0"),
        ("st2", f"select *, {_bin('all_n', 'bins')} as b, case when valid then weight else 0e0 end as w from st1"),
        ("st3", """select *, n // bins + (b < n % bins)::int as k, count(*) over (partition by video_id, b) as size, cast(sum(valid::int) over (partition by video_id, b) as bigint) as ok, sum(w) over (partition by video_id, b) as s,
  sum(w) over (partition by video_id, b order by frame_no rows unbounded preceding) as cum, sum(valid::int) over (partition by video_id, b order by frame_no rows unbounded preceding) - 1 as rnk from st2"""),
        ("st4", f"""select video_id, frame_no from st3 where ok > 0 and k > 0 and case when k >= size then true
  when s <= 0 then valid and len(list_filter(range(0, k), lambda i: ({_lin('i', 'ok', 'k', 'round')}) = rnk)) > 0
  else w > 0 and floor(cum / s * k + 0.5e0) > floor((cum - w) / s * k + 0.5e0) end"""),
    ]


@register(twin("select * from st4", ("src", "select video_id, frame_no, frame_no % 3 <> 0 as valid, case when video_id % 4 = 0 then 0e0 else sharpness * flow end as weight, 8 as target from fx_frames"), *_stratified("src")))
def fs9_stratified_select(spark, d):
    f = t(spark, d, "fx_frames").select("video_id", "frame_no", (F.col("frame_no") % 3 != 0).alias("valid"), F.when(F.col("video_id") % 4 == 0, 0.0).otherwise(F.col("sharpness") * F.col("flow")).alias("weight"), F.lit(8).alias("target"))
    return S.stratified_select(f)


def _smart(extra: str) -> list[tuple[str, str]]:
    return [
        ("covn", "select video_id, frame_no, sharpness, flow, total, valid or (n < 12 and turn <= 12) as valid from (select *, sum(valid::int) over (partition by video_id, b) as n, row_number() over (partition by video_id, b order by sharpness * flow desc, frame_no desc) as turn from cov0)"),
        ("sm0", f"select covn.*, sharpness * flow * valid::int{extra} as weight0, sum(valid::int) over (partition by video_id) as ok_n from covn left join par using (video_id, frame_no)" if extra else "select *, sharpness * flow * valid::int as weight0, sum(valid::int) over (partition by video_id) as ok_n from covn"),
        ("sm1", "select *, case when sum(weight0) over (partition by video_id) > 0 then weight0 else valid::int::double end as weight, 8 as target from sm0"),
        ("smsrc", "select video_id, frame_no, valid, weight, target from sm1 where ok_n >= 10"),
        *_stratified("smsrc"),
        ("few", "select distinct video_id, total, least(target, total) as n from sm1 where ok_n < 10"),
        ("even", f"select distinct video_id, {_lin('i', 'total', 'n')} as frame_no from (select video_id, total, n, unnest(range(0, n)) as i from few)"),
    ]


@register(twin("select * from st4 union all select * from even", _GATE, _COVER[0], *_smart("")))
def fs10_smart_sample(spark, d):
    f = t(spark, d, "fx_frames")
    return S.smart_sample(f, f.select("video_id").distinct().withColumn("target", F.lit(8)))


_COARSE = "select q.video_id, q.frame_no, c.cx, c.cy, c.cz, cast(q.frame_no as double) / 50 as angle from (select video_id, frame_no from {fx_frames} where frame_no % 4 = 0) q left join {cen} c on c.frame_idx = q.frame_no % 90 + 1 and q.frame_no % 12 <> 8"


def _parallax() -> list[tuple[str, str]]:
    k = S.gaussian()
    taps = " + ".join(f"{w!r}::double * coalesce({'lead' if i > 0 else 'lag'}(score, {abs(i)}) over (partition by video_id order by j), 0)" for i, w in zip(range(-4, 5), k, strict=True))
    return [
        CEN,
        _TOTALS,
        ("coarse", _COARSE.format(fx_frames="fx_frames", cen="cen")),
        ("sc", """select video_id, frame_no, coalesce(sqrt(power(cx - lag(cx) over w, 2) + power(cy - lag(cy) over w, 2) + power(cz - lag(cz) over w, 2)) + 0.1e0 * radians(angle), 0e0) as score from coarse where cx is not null window w as (partition by video_id order by frame_no)
union all select video_id, frame_no, 0e0 from coarse where cx is null"""),
        ("inter", interpolated("sc", "score")),
        ("pad0", "select video_id, total, cast(unnest(range(-4, total + 4)) as int) as j from totals"),
        ("pad1", "select video_id, total, j, case when r > total - 1 then 2 * (total - 1) - r else r end as src from (select *, ((j % m) + m) % m as r from (select *, greatest(2 * (total - 1), 1) as m from pad0))"),
        ("sm", f"select video_id, total, j, case when total < 3 then score else {taps} end as s from pad1 join inter using (video_id) where inter.frame_no = src"),
        ("par", "select video_id, j as frame_no, case when max(s) over (partition by video_id) > 1e-9 then s / max(s) over (partition by video_id) else s end as parallax from sm where j >= 0 and j < total"),
    ]


def coarse(spark, d):
    return spark.sql(_COARSE, fx_frames=t(spark, d, "fx_frames"), cen=G.camera_center(t(spark, d, "fx_poses")))


@register(twin("select video_id, frame_no, round(parallax, 5) + 0e0 as parallax from par", *_parallax()))
def fs11_parallax_scores(spark, d):
    return rounded(S.parallax_scores(coarse(spark, d), totals(spark, d)), "parallax", digits=5)


@register(twin("select * from st4 union all select * from even", *_parallax(), _GATE, _COVER[0], *_smart(" * (0.3e0 + 0.7e0 * coalesce(parallax, 0))")))
def fs12_two_stage_sample(spark, d):
    f = t(spark, d, "fx_frames")
    return S.two_stage_sample(f, f.select("video_id").distinct().withColumn("target", F.lit(8)), S.parallax_scores(coarse(spark, d), totals(spark, d)))


@register("""select page_id, cast(row_number() over (order by list_transform(range(0, len(tx)), lambda i: {'t': tx[i + 1], 'n': nums[i + 1]}), url) - 1 as int) as frame_idx from (
  select page_id, url, string_split_regex(url, '[0-9]+') as tx, list_transform(regexp_extract_all(url, '([0-9]+)', 1), lambda x: cast(x as decimal(38,0))) as nums from pages)""")
def io1_natural_order(spark, d):
    return L.natural_order(t(spark, d, "pages").select("page_id", F.col("url").alias("path"))).select("page_id", "frame_idx")


@register(f"select page_id from (select page_id, row_number() over (order by page_id) - 1 as i, count(*) over () as n from pages) where n <= 37 or len(list_filter(range(0, 37), lambda k: ({_lin('k', 'n', '37')}) = i)) > 0")
def io2_even_subset(spark, d):
    return L.even_subset(t(spark, d, "pages").select("page_id"), "page_id", 37)


@register("""select id, round(e, 4) as exif_focal, round(coalesce(kf, case when calibrated then greatest(w, h)::double end, e, 1.2e0 * greatest(w, h)), 4) as start_focal from (
  select *, case when f35 > 0 and w > 0 and h > 0 then f35 / 43.26661530556787e0 * sqrt(1 + power(h / w, 2)) * w end as e from (
    select p_partkey as id, case when p_size % 4 = 0 then null else p_size::double end as f35, (p_size % 7) * 640e0 as w, 480e0 + p_size as h, p_size % 9 = 0 as calibrated, case when p_size % 10 = 0 then 1234.5e0 end as kf from part))""")
def io3_exif_focal(spark, d):
    s = F.col("p_size")
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(s % 4 != 0, s.cast("double")).alias("f35"), ((s % 7) * 640.0).alias("w"), (480.0 + s).alias("h"), (s % 9 == 0).alias("calibrated"), F.when(s % 10 == 0, 1234.5).alias("k_focal"))
    return rounded(L.exif_focal(p).select("id", "exif_focal", "start_focal"), "exif_focal", "start_focal", digits=4)


@register(twin("select g.frame_idx, " + ", ".join(f"round(case when g.frame_idx % 6 <> 0 then p.{c} end, 6) + 0e0 as {c}" for c in G.POSE) + " from (select distinct unnest([frame_idx, frame_idx + 50]) as frame_idx from fx_poses) g left join fx_poses p on p.frame_idx = g.frame_idx"))
def io4_pose_rows(spark, d):
    p = t(spark, d, "fx_poses").withColumn("t1", F.when(F.col("frame_idx") % 6 == 0, float("nan")).otherwise(F.col("t1")))
    return rounded(L.pose_rows(p, p.select(F.explode(F.array(F.col("frame_idx"), F.col("frame_idx") + 50)).alias("frame_idx")).distinct()), *G.POSE)


_Q = ("quat", """select frame_idx, t0, t1, t2, (r21-r12)/s/n as qx, (r02-r20)/s/n as qy, (r10-r01)/s/n as qz, s/4/n as qw from (select *, sqrt(power((r21-r12)/s,2)+power((r02-r20)/s,2)+power((r10-r01)/s,2)+s*s/16)+1e-12 as n from (select *, sqrt(r00+r11+r22+1)*2 as s from fx_poses))""")


@register(twin("select frame_idx, printf('%d %.9f %.9f %.9f %.9f %.9f %.9f %.9f', frame_idx, round(t0, 7) + 0e0, round(t1, 7) + 0e0, round(t2, 7) + 0e0, round(qx, 7) + 0e0, round(qy, 7) + 0e0, round(qz, 7) + 0e0, round(qw, 7) + 0e0) as line from quat", _Q))
def io6_camera_lines(spark, d):
    poses = t(spark, d, "fx_poses")
    q = poses.select("frame_idx", *G.T).join(G.quaternions(poses), "frame_idx")
    return L.camera_lines(rounded(q, *G.T, "qx", "qy", "qz", "qw", digits=7))


@register(twin("select (select count(*) from fx_poses) as frames, (select count(*) from fx_points) as points, (select count(*) from fx_obs) as observations, round((select count(*) from fx_obs) / (select count(*) from fx_points), 6) as track_length"))
def io7_report(spark, d):
    return rounded(P.run_report(t(spark, d, "fx_poses"), t(spark, d, "fx_points"), t(spark, d, "fx_obs")), "track_length")


@register("select s_suppkey as frame_a, s_suppkey + 1 as frame_b from supplier where not (s_suppkey % 3 = 0 and s_suppkey % 2 = 0)")
def io8_pending_pairs(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("frame_a"), (F.col("s_suppkey") + 1).alias("frame_b"))
    done = s.where("frame_a % 3 = 0").withColumn("fingerprint", F.when(F.col("frame_a") % 2 == 0, "now").otherwise("before"))
    return L.pending_pairs(s, done, "now")


@register(twin("""select md5(concat_ws('|', 'K', '64', '5', string_agg(told, ';' order by i), max(n)::varchar)) as fingerprint from (
  select row_number() over (order by frame_idx) - 1 as i, count(*) over () as n, concat_ws(',', """ + ", ".join(f"cast(round_even({c} * 1e6, 0) as bigint)" for c in G.POSE) + ") as told from fx_poses) where i % greatest(1, n // 30) = 0"))
def io9_fingerprint(spark, d):
    return L.fingerprint(t(spark, d, "fx_poses"), "K", 70, 4)


@register("""select p_partkey as run_id, concat_ws(',', case when p_size % 5 = 0 and p_size % 7 <> 0 then 'fps' end, case when p_size % 3 = 0 then 'min_frames' end, case when p_brand <> 'Brand#11' then 'sampling_mode' end) as changed from part""")
def io10_config_drift(spark, d):
    p = t(spark, d, "part")
    old = p.select(F.col("p_partkey").alias("run_id"), F.col("p_retailprice").alias("fps"), F.col("p_size").alias("min_frames"), F.col("p_brand").alias("sampling_mode"))
    new = old.select("run_id", F.when(F.col("min_frames") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("fps") + F.when(F.col("min_frames") % 5 == 0, 0.01).otherwise(1e-9)).alias("fps"), F.when(F.col("min_frames") % 3 == 0, F.col("min_frames") + 1).otherwise(F.col("min_frames")).alias("min_frames"), F.lit("Brand#11").alias("sampling_mode"))
    return L.config_drift(old, new, ["fps"], ["min_frames", "sampling_mode"])


_KF = "select frame_idx, frame_idx % 2 = 0 as is_keyframe from {fx_poses}"


@register(twin(f"select frame_a, frame_b from (select *, row_number() over (order by frame_a) - 1 as i, count(*) over () as n from (select frame_idx as frame_a, lead(frame_idx) over (order by frame_idx) as frame_b from fx_poses where frame_idx % 2 = 0) where frame_b is not null) where n <= 20 or len(list_filter(range(0, 20), lambda k: ({_lin('k', 'n', '20', 'round')}) = i)) > 0"))
def dn1_adjacent_pairs(spark, d):
    return D.adjacent_pairs(spark.sql(_KF, fx_poses=t(spark, d, "fx_poses")), 20)


_SCALE = ("sc", "select greatest(sqrt(power(max(cx)-min(cx),2)+power(max(cy)-min(cy),2)+power(max(cz)-min(cz),2)), 1e-6) as scale from cen")
_GP = ("gp", """select p.a as frame_a, p.b as frame_b, baseline, case when baseline is null then 'no pose' when baseline < 0.005e0*scale or baseline > 0.5e0*scale then 'baseline' else 'ok' end as status, scale
from (select *, sqrt(power(x.cx-y.cx,2)+power(x.cy-y.cy,2)+power(x.cz-y.cz,2)) as baseline from (select s_suppkey as a, s_suppkey * 3 as b from supplier) p left join cen x on x.frame_idx = a left join cen y on y.frame_idx = b) p, sc""")


def _gated(spark, d):
    pairs = t(spark, d, "supplier").select(F.col("s_suppkey").alias("frame_a"), (F.col("s_suppkey") * 3).alias("frame_b"))
    return D.gate_pairs(pairs, t(spark, d, "fx_poses"))


@register(twin("select frame_a, frame_b, round(baseline, 6) as baseline, status, round(greatest(0.005e0*scale, 1e-4), 6) as voxel, round(greatest(0.02e0*scale, 1e-3), 6) as min_depth, round(5*scale, 6) as max_depth from gp", CEN, _SCALE, _GP))
def dn2_gate_pairs(spark, d):
    return rounded(_gated(spark, d), "baseline", "voxel", "min_depth", "max_depth")


@register(twin("select src, count(*) as n from fx_dense group by 1"))
def dn3_merge_clouds(spark, d):
    c = t(spark, d, "fx_dense")
    return D.merge_clouds([c.where("src % 2 = 0"), c.where("src % 2 = 1")]).groupBy("src").agg(F.count("*").alias("n"))


_VOX = ("vox", "select cast(floor(x/0.5e0) as bigint) as kx, cast(floor(y/0.5e0) as bigint) as ky, cast(floor(z/0.5e0) as bigint) as kz, count(*) as n, count(distinct src) as views, avg(x) as x, avg(y) as y, avg(z) as z, cast(floor(avg(r)) as int) as r, cast(floor(avg(g)) as int) as g, cast(floor(avg(b)) as int) as b from fx_dense group by 1, 2, 3")


@register(twin("select kx, ky, kz, cast(n as bigint) as n, views, round(x + 1e-7, 4) as x, round(y + 1e-7, 4) as y, round(z + 1e-7, 4) as z, r, g, b from vox where views >= 4 or (select max(views) from vox) < 4", _VOX))
def dn4_voxel_downsample(spark, d):
    cells = D.voxel_downsample(t(spark, d, "fx_dense"), 0.5, 4)
    # means of a few hundredths lie on rounding ties; both sides step off them
    return rounded(cells.withColumns({c: F.col(c) + 1e-7 for c in "xyz"}), "x", "y", "z", digits=4)


def dn5_statistical_outliers(spark, d):
    vox = D.voxel_downsample(t(spark, d, "fx_dense"), 0.5)
    points = vox.select(F.xxhash64("kx", "ky", "kz").alias("uid"), "kx", "ky", "kz", "x", "y", "z")
    return D.statistical_outliers(points, 8, 2.0).select("kx", "ky", "kz", F.round("d", 6).alias("d"))


register(
    twin(
        """select kx, ky, kz, round(d, 6) as d from dist where d < (select avg(d) + 2 * stddev_pop(d) from dist)""",
        _VOX,
        ("pd", "select p.kx, p.ky, p.kz, sqrt(power(p.x-q.x,2)+power(p.y-q.y,2)+power(p.z-q.z,2)) as e, row_number() over (partition by p.kx, p.ky, p.kz order by sqrt(power(p.x-q.x,2)+power(p.y-q.y,2)+power(p.z-q.z,2))) as i from vox p join vox q on abs(p.kx-q.kx) <= 12 and abs(p.ky-q.ky) <= 12 and abs(p.kz-q.kz) <= 12 and (p.kx <> q.kx or p.ky <> q.ky or p.kz <> q.kz)"),
        ("dist", "select kx, ky, kz, avg(e) as d from pd where i <= 8 group by 1, 2, 3"),
    )
)(dn5_statistical_outliers)


# every point of the cloud rather than voxels whose number does not grow; tests/test_whole.py holds it against all pairs
@register()
def dn5_statistical_outliers_whole(spark, d):
    points = t(spark, d, "fx_dense").groupBy("pt_id", "src", "x", "y", "z").agg(F.count("*").alias("rows")).withColumn("uid", F.xxhash64("pt_id", "src", "x", "y", "z"))
    return D.statistical_outliers(points, 8, 2.0).select("pt_id", "src", "rows", F.round("d", 6).alias("d"))


@register(twin("select pt_id, src, round(x, 6) as x from fx_dense order by md5(concat_ws(':', '0', pt_id, src, r, g, b)), pt_id, src, r, g, b limit 500"))
def dn6_cap_points(spark, d):
    return rounded(D.cap_points(t(spark, d, "fx_dense"), 500, ["pt_id", "src", "r", "g", "b"]).select("pt_id", "src", "x"), "x")


@register(twin("select count(*) as pairs, count(*) filter (where status = 'ok') as used, count(*) filter (where status <> 'ok') as failed, (select count(*) from fx_dense) as points, round(max(scale), 6) as scale, round(greatest(0.005e0*max(scale), 1e-4), 6) as voxel from gp", CEN, _SCALE, _GP))
def dn7_dense_summary(spark, d):
    return rounded(D.dense_summary(_gated(spark, d), t(spark, d, "fx_dense"), t(spark, d, "fx_poses")), "scale", "voxel")


_STATUS = "case o_orderstatus when 'F' then 'tracked' when 'O' then 'lost' else 'keyframe' end"


@register(f"select status, n, lost > 0.4e0 as warn from (select {_STATUS} as status, count(*) as n from orders group by 1), (select avg(case when {_STATUS} in ('lost', 'invalid') then 1e0 else 0e0 end) as lost from orders)")
def rp1_status_counts(spark, d):
    return P.status_counts(t(spark, d, "orders").select(F.expr(_STATUS).alias("status")))


@register("select count(*) filter (where o_orderstatus = 'F' and path = 'relative') as ok_relative, count(*) filter (where o_orderstatus = 'F' and path = 'resect') as ok_resect, count(*) filter (where o_orderstatus = 'F' and path = 'relocate') as ok_relocate, count(*) filter (where o_orderstatus <> 'F') as failed from (select *, case o_orderkey % 3 when 0 then 'relative' when 1 then 'resect' else 'relocate' end as path from orders)")
def rp2_registration_funnel(spark, d):
    o = t(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("ok"), F.expr("case o_orderkey % 3 when 0 then 'relative' when 1 then 'resect' else 'relocate' end").alias("path"))
    return P.registration_funnel(o)


@register(twin("""select frame_idx, coalesce(frames >= 1.1e0 * pf or points >= 1.1e0 * pp or kf - pk >= 20, false) as refine from (
  select *, lag(frames) over (order by frame_idx) as pf, lag(points) over (order by frame_idx) as pp, lag(kf) over (order by frame_idx) as pk from (
    select frame_idx, row_number() over (order by frame_idx) as frames, sum(n) over (order by frame_idx) as points, frame_idx * 7 % 60 as kf from (select frame_idx, count(*) as n from fx_obs group by 1)))"""))
def rp3_refine_triggers(spark, d):
    from pyspark.sql import Window

    w = Window.orderBy("frame_idx")
    n = t(spark, d, "fx_obs").groupBy("frame_idx").agg(F.count("*").alias("n"))
    log = n.select("frame_idx", F.row_number().over(w).alias("frames"), F.sum("n").over(w).alias("points"), (F.col("frame_idx") * 7 % 60).alias("keyframes"))
    return P.refine_triggers(log).select("frame_idx", "refine")


# images of 8 x 8 pixels, made of the 64 numbers of an embedding
_PIXELS = ("px", "select cast(vec_id as int) as frame_idx, list_transform(embedding, lambda x: cast(floor(abs(x::double) * 1000) as int) % 256) as p from embeddings")


def images(spark, d, channels):
    value = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("int") % 256)
    data = F.unhex(F.array_join(F.transform(value, lambda v: F.concat(*[F.lpad(F.hex((v + 85 * c) % 256), 2, "0") for c in range(channels)])), ""))
    return t(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("frame_idx"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(channels).alias("nChannels"), data.alias("data"))


@register(
    twin(
        """select frame_idx, round(var_pop(z) + 1e-5, 4) as sharpness from (select frame_idx, unnest(list_transform(range(0, 64), lambda i:
  p[case when i // 8 = 0 then i + 9 else i - 7 end] + p[case when i // 8 = 7 then i - 7 else i + 9 end]
  + p[case when i % 8 = 0 then i + 2 else i end] + p[case when i % 8 = 7 then i else i + 2 end] - 4 * p[i + 1])) as z from px) group by 1""",
        _PIXELS,
    )
)
def fs4_sharpness(spark, d):
    # variances of whole numbers over 64 pixels often end in a 5, where engines round apart
    return rounded(M.sharpness(images(spark, d, 1)).withColumn("sharpness", F.col("sharpness") + 1e-5), "sharpness", digits=4)


@register(
    twin(
        """select frame_idx, k as kp_idx, (v + 170) % 256 as r, (v + 85) % 256 as g, v as b from (
  select frame_idx, k, p[8 * least(greatest(cast(round((frame_idx * 3 + k * 29) % 90 / 10e0 - 0.37e0) as int), 0), 7) + least(greatest(cast(round((frame_idx * 7 + k * 13) % 90 / 10e0 - 0.42e0) as int), 0), 7) + 1] as v
  from px, (select unnest(range(0, 3))::int as k))""",
        _PIXELS,
    )
)
def ma13_sample_colors(spark, d):
    at = lambda a, b, less: (F.col("frame_idx") * a + F.col("kp_idx") * b) % 90 / F.lit(10.0) - less
    frames = images(spark, d, 3)
    points = frames.select("frame_idx", F.explode(F.array(*map(F.lit, range(3)))).alias("kp_idx"))
    return M.sample_colors(points.withColumns({"u": at(7, 13, 0.42), "v": at(3, 29, 0.37)}), frames)


@register(twin("select count(*) as points, sum(r)::bigint as r, sum(g)::bigint as g, sum(b)::bigint as b, round(sum(x::float::double), 2) as x, round(sum(y::float::double), 2) as y, round(sum(z::float::double), 2) as z from fx_dense"))
def io5_write_ply(spark, d):
    at = Scratch(spark, "ply").path("cloud.ply")
    fs.FileSystem.from_uri(at)[0].create_dir(fs.FileSystem.from_uri(at.rsplit("/", 1)[0])[1], recursive=True)
    L.write_ply(t(spark, d, "fx_dense"), at)
    v = L.read_ply(spark, at)
    return rounded(v.agg(F.count("*").alias("points"), *[F.sum(c).cast("long").alias(c) for c in "rgb"], *[F.sum(F.col(c).cast("double")).alias(c) for c in "xyz"]), "x", "y", "z", digits=2)
