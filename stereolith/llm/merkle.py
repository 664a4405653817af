"""Merkle manifest of a table: leaves, a tree of each group, a tree over the groups' roots, proofs and their check.

Every level is a table of nodes ``(tree, idx, h)``. Its slot-zero rows (``idx`` divisible by the arity) compute the indices of
their siblings by slot offsets, an equijoin of the level with itself fetches these, and the slot-zero rows emit the parents,
each with its children's digests. Proofs go down again: a parent hands each child what stands left and right of it, and the
parent's own steps, so a level is joined once more and long proofs are never shuffled, only made at the leaves.

Leaves are ranked without one task for a group: they are range-partitioned by (group, order), counted by partition, and
numbered within it from the sum of what stands before. Everything is in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from stereolith.operators.ranking import ranked
from stereolith.plans.scratch import Scratch

ARITY = 8
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = Ty.ArrayType(Ty.StructType([Ty.StructField("left", Ty.StringType()), Ty.StructField("right", Ty.StringType())]))


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lowered(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parents(nodes: DataFrame, arity: int = ARITY, carry: list[str] | None = None) -> DataFrame:
    """(tree, idx, n, h, kids) of the level above nodes (tree, idx, n, h) of trees that have more than one; ``kids`` have h and ``carry``."""
    zero = nodes.where(F.col("idx") % arity == 0)
    offsets = F.sequence(F.lit(0), F.least(F.lit(arity), F.col("n") - F.col("idx")).cast("int") - 1)
    wanted = zero.select("tree", F.col("idx").alias("zero"), "n", F.explode(offsets).alias("slot")).withColumn("idx", F.col("zero") + F.col("slot"))
    met = wanted.join(nodes.select("tree", "idx", "h", *(carry or [])), ["tree", "idx"])
    up = met.groupBy("tree", "zero", "n").agg(F.sort_array(F.collect_list(F.struct("slot", "h", *(carry or [])))).alias("kids"))
    return up.select("tree", (F.col("zero") / arity).cast("long").alias("idx"), F.ceil(F.col("n") / arity).cast("long").alias("n"), F.sha2(F.array_join("kids.h", ""), 256).alias("h"), "kids")


def grow(nodes: DataFrame, scratch: Scratch, name: str, arity: int = ARITY, carry: list[str] | None = None) -> tuple[list[DataFrame], DataFrame]:
    """The levels above ``nodes`` (tree, idx, n, h and what their parents ``carry``), lowest first, and (tree, root)."""
    level, levels = nodes, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    tops = [level.where("n = 1").select("tree", "h")]
    while most > 1:
        level = scratch.table(parents(level.where("n > 1"), arity, None if levels else carry), f"{name}-{len(levels)}")
        levels.append(level)
        tops.append(level.where("n = 1").select("tree", "h"))
        most = -(-most // arity)
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return levels, scratch.table(top.select("tree", F.col("h").alias("root")), f"{name}-roots")


def _down(level: DataFrame, steps: DataFrame | None, above: DataFrame, arity: int, carry: list[str]) -> DataFrame:
    """(tree, idx, steps) of the children of ``level``, their own step, then their parent's steps; with h, ``carry`` and what else ``above`` has.

    ``steps`` has (tree, idx, steps) of this level's nodes that have parents; a root takes its steps from ``above`` (tree, steps).
    """
    more = [c for c in above.columns if c not in ("tree", "steps")]
    own = level.join(steps.select("tree", "idx", F.col("steps").alias("more")), ["tree", "idx"], "left") if steps is not None else level.withColumn("more", F.lit(None).cast(_STEPS))
    own = own.join(above.withColumnRenamed("steps", "top"), "tree", "left")
    rest = F.when(F.col("n") == 1, F.col("top")).otherwise(F.col("more"))
    kid = own.select("tree", "idx", *more, F.col("kids.h").alias("hs"), rest.alias("rest"), F.explode("kids").alias("kid"))
    slot = F.col("kid.slot")
    left, right = F.array_join(F.slice("hs", F.lit(1), slot), ""), F.array_join(F.slice("hs", slot + 2, F.lit(arity)), "")
    return kid.select("tree", (F.col("idx") * arity + slot).cast("long").alias("idx"), F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "rest").alias("steps"), "kid.h", *[f"kid.{c}" for c in carry], *more)


def proofs(nodes: DataFrame, levels: list[DataFrame], above: DataFrame, scratch: Scratch, name: str, arity: int = ARITY, carry: list[str] | None = None) -> DataFrame:
    """(tree, idx, steps, h) and ``carry`` for every row of ``nodes``: what stands left and right of it and its ancestors, lowest first.

    ``above`` (tree, steps, and columns that are handed down) are the steps of each tree's root. All but the leaves' steps are written; those
    are made where their parents' rows are opened, and go nowhere from there.
    """
    steps, carry = None, carry or []
    for k in range(len(levels) - 1, 0, -1):
        steps = scratch.table(_down(levels[k], steps, above.select("tree", "steps"), arity, []), f"{name}-steps-{k}")
    lone = nodes.where("n = 1").select("tree", "idx", "h", *carry).join(above, "tree")
    return lone if not levels else _down(levels[0], steps, above, arity, carry).unionByName(lone)


def fold(h: Column, steps: Column) -> Column:
    """The root that a digest and its steps give."""
    return F.aggregate(steps, h, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_hash(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, group_col: str, order_col: str, leaf_col: str, carry: list[str], arity: int = ARITY) -> DataFrame:
    """``order_col``, ``carry``, ``leaf``, ``subroot``, ``root`` and ``steps`` of every row.

    Rows are leaves of their group's tree, ascending by ``order_col`` (nulls first; rows that repeat it by their leaf); groups are ordered by name
    as bytes, null first. A tree of one leaf is that leaf. Rows that repeat others are leaves of their own; no rows, no result.
    """
    spark: SparkSession = rows.sparkSession
    scratch = Scratch(spark, "merkle")
    rows = rows.select(F.col(group_col).alias("tree"), F.col(order_col).alias("_o"), F.col(leaf_col).alias("h"), *carry)
    # a group's name is carried as text, null apart, so that joins on it are plain; a text of "" sorts after null
    rows = rows.withColumn("tree", F.when(F.col("tree").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("tree").cast("string"))))
    leaves = scratch.table(ranked(rows, [F.col("_o").asc_nulls_first(), F.col("h")], scratch, by="tree", count="n"), "leaves")
    levels, roots = grow(leaves, scratch, "group", arity, ["_o", *carry])
    tops = ranked(roots.select(F.col("tree").alias("name"), F.col("root").alias("h"), F.lit(0).alias("tree")), [F.col("name")], scratch, by="tree", count="n", name="parted-roots")
    tops = scratch.table(tops, "tops")
    upper, root = grow(tops, scratch, "top", arity, ["name"])
    none = root.select("tree", F.array().cast(_STEPS).alias("steps"))
    above = proofs(tops, upper, none, scratch, "top", arity, ["name"])
    above = scratch.table(above.select(F.col("name").alias("tree"), F.col("h").alias("subroot"), "steps"), "above")
    found = proofs(leaves, levels, above, scratch, "group", arity, ["_o", *carry]).crossJoin(F.broadcast(root.select("root")))  # one row
    return found.select(F.col("_o").alias(order_col), F.col("h").alias("leaf"), "subroot", "root", *carry, "steps")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per input row.

    Tampering lower-cases A-Z of the texts of rows whose id has a crc32 divisible by 3 (never a null id's); those rows' leaves are hashed
    anew and folded with the original siblings. Other columns are ignored.
    """
    columns = [F.col(c) for c in FIELDS]
    changed = leaf_hash(*columns[:-1], lowered(columns[-1]))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select("doc_id", "lang", leaf_hash(*columns).alias("_leaf"), F.when(hit, changed).alias("_changed"))
    found = manifest(rows, "lang", "doc_id", "_leaf", ["_changed"])
    folded = found.withColumn("folded_root", fold(F.coalesce("_changed", "leaf"), F.col("steps")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(levels: int = 9) -> str:
    """SQL of ``digest`` for trees of up to 8^levels leaves: each level is a table of its own."""
    f = lambda c: f"case when {c} is null then '-' else octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar) end"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join([*[f(c) for c in FIELDS[:-1]], f(text)]) + ")"
    step = "case when c & 1 = 1 then 3988292384 else 0 end"
    codes = "list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))"
    crc = f"xor(list_reduce(list_concat([cast(4294967295 as bigint)], {codes}), lambda crc, b: xor(crc >> 8, tab[1 + (xor(crc, b) & 255)])), 4294967295)"
    parts = [
        "with recursive bits as (select cast(range as bigint) as b, cast(range as bigint) as c, 0 as k from range(256) union all select b, " + f"xor(c >> 1, {step}), k + 1 from bits where k < 8)",
        "tab as (select list(c order by b) as tab from bits where k = 8)",
        f"d as (select row_number() over () as r, doc_id, lang, {leaf('text')} as leaf, case when doc_id is not null and ({crc}) % 3 = 0 then {leaf(low)} end as changed from documents cross join tab)",
    ]

    def tree(p: str, source: str) -> str:
        """Levels p0.. of nodes (t, idx, n, h, r) and the walk up: p_up (r, level, l, q), p_root (t, h)."""
        out = [f"{p}0 as ({source})"]
        for k in range(levels):
            out.append(f"{p}{k + 1} as (select t, idx // 8 as idx, (any_value(n) + 7) // 8 as n, sha256(string_agg(h, '' order by idx)) as h from {p}{k} where n > 1 group by t, idx // 8)")
        out.append(f"{p}_root as (" + " union all ".join(f"select t, h from {p}{k} where n = 1" for k in range(levels + 1)) + ")")
        for k in range(levels):
            w = "over (partition by t, idx // 8 order by idx rows between"
            out.append(f"{p}_s{k} as (select t, idx, coalesce(string_agg(h, '') {w} unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') {w} 1 following and unbounded following), '') as q from {p}{k} where n > 1)")
        return ", ".join(out)

    parts.append(tree("g", "select lang as t, row_number() over (partition by lang order by doc_id nulls first, leaf, r) - 1 as idx, count(*) over (partition by lang) as n, leaf as h, r from d"))
    parts.append(tree("u", "select 0 as t, row_number() over (order by encode(t) nulls first) - 1 as idx, count(*) over () as n, h, t as name from g_root"))

    def join(p: str) -> str:
        return " ".join(f"left join {p}_s{k} {p}s{k} on {p}s{k}.t is not distinct from {p}.t and {p}s{k}.idx = {p}.idx // {8**k}" for k in range(levels))

    def steps(p: str) -> str:
        return "[" + ", ".join(f"{{'l': {p}s{k}.l, 'q': {p}s{k}.q}}" for k in range(levels)) + "]"

    parts.append(f"au as (select u.name, u.h as subroot, {steps('u')} as s from u0 u {join('u')})")
    parts.append(f"ag as (select g.r, g.t, {steps('g')} as s from g0 g {join('g')})")
    parts.append("a as (select d.doc_id, d.leaf, au.subroot, u_root.h as root, list_filter(list_concat(ag.s, au.s), lambda x: x.l is not null) as s, coalesce(changed, leaf) as now from d join ag using (r) join au on au.name is not distinct from ag.t cross join u_root)")
    parts.append("z as (select *, list_reduce(list_concat([{'l': now, 'q': ''}], s), lambda acc, x: {'l': sha256(x.l || acc.l || x.q), 'q': ''}).l as folded_root from a)")
    return ", ".join(parts) + " select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(s, lambda x: x.l || x.q), '')) as proof_sha256, folded_root, folded_root = root as verified from z"
