"""Input views over the driver's tables, as one SQL text for Spark and for the SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_poses": """select frame_idx,
  c as r00, 0e0 as r01, -s as r02, 0e0 as r10, 1e0 as r11, 0e0 as r12, s as r20, 0e0 as r21, c as r22,
  -(c*cx - s*cz) as t0, -cy as t1, -(s*cx + c*cz) as t2
from (select frame_idx, (1-h*h)/(1+h*h) as c, 2*h/(1+h*h) as s, cx, cy, cz
      from (select cast(s_suppkey as int) as frame_idx, cast(s_suppkey % 100 - 50 as double)/400 as h,
              cast(s_suppkey % 100 - 50 as double)/10 + cast(s_suppkey as double)/10000 as cx,
              cast(s_suppkey % 3 as double)/10 as cy, cast(s_suppkey % 5 as double)/10 as cz
            from {supplier}) q1) q2""",
    "fx_points": """select o_orderkey as point_id, cast(o_custkey % 200 - 100 as double)/20 as x,
  cast(o_orderkey % 97 - 48 as double)/24 as y, 12 + cast(o_orderkey % 31 as double)/10 as z from {orders}""",
    "fx_obs": """select point_id, frame_idx, kp_idx, 1000*xc/zc + 640 + du as u, 1000*yc/zc + 360 + dv as v
from (select l.l_orderkey as point_id, f.frame_idx, l.l_orderkey*8 + l.l_linenumber as kp_idx,
        f.r00*q.x+f.r01*q.y+f.r02*q.z+f.t0 as xc, f.r10*q.x+f.r11*q.y+f.r12*q.z+f.t1 as yc,
        f.r20*q.x+f.r21*q.y+f.r22*q.z+f.t2 as zc,
        (l.l_discount-0.05e0)*20 + case when l.l_returnflag='R' and l.l_linenumber=1 then 40 else 0 end as du,
        (l.l_tax-0.04e0)*20 as dv
      from (select *, row_number() over (partition by l_orderkey, l_suppkey
               order by l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_returnflag) as rn from {lineitem}) l
      join {fx_points} q on q.point_id = l.l_orderkey join {fx_poses} f on f.frame_idx = l.l_suppkey where l.rn = 1) w""",
    "fx_frames": """select user_id as video_id,
  cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame_no,
  value as sharpness, cast(regexp_extract(props, '([0-9]+)', 1) as double)/10 as flow from {events}""",
    "fx_kps": "select cast(vec_id % 10 as int) as frame_idx, cast(floor(vec_id/10) as int) as kp_idx, embedding as descr from {embeddings}",
    "fx_dense": """select l_orderkey*8 + l_linenumber as pt_id, l_suppkey as src,
  cast(l_orderkey % 400 as double)/40 + l_discount as x, l_quantity/10 as y, cast(l_partkey % 50 as double)/10 + l_tax as z,
  cast(l_partkey % 256 as int) as r, cast(l_suppkey % 256 as int) as g, cast(l_orderkey % 256 as int) as b from {lineitem}""",
    "fx_matches": """select a.frame_idx as frame_a, a.kp_idx as kp_a, b.frame_idx as frame_b, b.kp_idx as kp_b, a.u as u_a, a.v as v_a, b.u as u_b, b.v as v_b
from {fx_obs} a join {fx_obs} b on a.point_id = b.point_id where b.frame_idx > a.frame_idx and b.frame_idx - a.frame_idx <= 2""",
    "fx_words": "select cast(l_suppkey as int) as frame_idx, cast(l_partkey % 200 as int) as word from {lineitem}",
    "fx_vocab": "select cast(vec_id as int) as word, embedding as centroid from {embeddings} where vec_id < 16",
    "fx_rot_edges": """select a.frame_idx as frame_a, b.frame_idx as frame_b,
  m.r00*a.r00+m.r01*a.r01+m.r02*a.r02 as r00, m.r00*a.r10+m.r01*a.r11+m.r02*a.r12 as r01, m.r00*a.r20+m.r01*a.r21+m.r02*a.r22 as r02,
  m.r10*a.r00+m.r11*a.r01+m.r12*a.r02 as r10, m.r10*a.r10+m.r11*a.r11+m.r12*a.r12 as r11, m.r10*a.r20+m.r11*a.r21+m.r12*a.r22 as r12,
  m.r20*a.r00+m.r21*a.r01+m.r22*a.r02 as r20, m.r20*a.r10+m.r21*a.r11+m.r22*a.r12 as r21, m.r20*a.r20+m.r21*a.r21+m.r22*a.r22 as r22
from {fx_poses} a join {fx_poses} b on b.frame_idx = a.frame_idx + 1
join {fx_poses} m on m.frame_idx = case when b.frame_idx % 13 = 0 and b.frame_idx > 30 then b.frame_idx - 30 else b.frame_idx end""",
}
_NAME = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table, or one of the views over them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needed = {n: table(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(VIEWS[name]))}
    return spark.sql(VIEWS[name], **needed)


def _needed(name: str, into: dict[str, str]) -> None:
    for n in _NAME.findall(VIEWS[name]):
        if n in VIEWS and n not in into:
            _needed(n, into)
    into[name] = _NAME.sub(r"\1", VIEWS[name])


def twin(body: str, *more: tuple[str, str]) -> str:
    """``body`` behind a WITH clause of the views that it and ``more`` (name, text) name."""
    found: dict[str, str] = {}
    for n in dict.fromkeys(re.findall(r"\bfx_\w+", " ".join([*(t for _, t in more), body]))):
        if n not in found:
            _needed(n, found)
    found |= dict(more)
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in found.items()) + "\n" + body if found else body
