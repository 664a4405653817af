"""N-gram Jaccard self-join by a token-group matrix, and the classes that its links make.

A document's tokens are the distinct hashes (64 bits) of its 5-word shingles. The job:

1. **Groups.** Within each Arrow batch, documents of one MinHash value are compared with the first of them; those
   that reach the threshold form a group around it. A group is a set of documents already linked, so copies and
   near copies are folded where they are read, before anything is shuffled, however many there are.
2. **Matrix.** For each group the union of its members' prefix tokens is stored, one (token, group) row each. The
   prefix of n tokens is the floor(0.2 n) + 1 first in one global order (by hash, but tokens that a first pass found in
   several groups' prefixes last); documents that reach the threshold share a prefix token, whatever that order is.
3. **Bound.** Tokens that two groups share are counted. The count, with the tokens in long lists and what lies behind the
   longest prefixes, bounds the overlap of any two of their documents; pairs that can't reach the threshold, or whose
   documents differ too much in size, are never opened.
4. **Open.** A qualifying pair is compared on whole token sets: first the groups' leaders, then, if those are
   not linked, the groups' different members.

Tokens of over ``LONG`` groups are not paired off: their groups gather in the cell of the token's pivot, and a cell is compared
by products of its documents-by-tokens matrix, in blocks of bounded size. It returns trees of what is linked, not all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereolith.llm import text as T
from stereolith.operators.graph import connected_components
from stereolith.plans.scratch import RUN_BYTES, Scratch

PERCENT = 80
SHINGLE = 5
#: Tokens, of those in most groups, that come last in the order. A bound on what is broadcast (8 bytes each); any value
#: gives the same result.
FREQUENT = 1_000_000
#: Groups of a token from which it may be one of them.
COMMON = 4
#: Groups of a token up to which its pairs are all made.
LONG = 8
#: Documents and tokens of a block of a cell, and columns of a matrix at a time.
CELL_ROWS, CELL_TOKENS, COLUMNS, STRIP = 1024, 400_000, 1024, 256
#: Bytes of text that are grouped at a time (a whole batch, mostly), and that are cut into shingles at a time.
RUN, STEP = 3_000_000, 300_000
#: Rows of a long list that meet its pivot in one place.
SPLIT = 1_000

_ROWS = "doc_id long, n_shingles long, leader long, variant long, token long"


def linked(inter: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * inter >= percent * (n + m - inter)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Tokens of which a linked set shares one at least: n - ceil(percent n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, firsts) for runs of rows."""
    for a, b in T.runs(column, STEP):
        w = T.words(column.slice(a, b - a), T.WS)
        yield a, *T.sets(*T.grams(w.h, w.first, n, short=True))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _fold(ids: np.ndarray, token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each row's leader (a row number): the first row of its MinHash value if they are linked, else the row itself."""
    n = np.diff(first)
    leader = np.arange(len(n))
    for salt in (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F):
        alone = np.flatnonzero((leader == np.arange(len(n))) & (n > 0))
        heads = np.zeros(len(n), bool)
        heads[leader[leader != np.arange(len(n))]] = True
        if not len(alone):
            break
        h = T.mix(token ^ np.uint64(salt))
        bounds = np.stack([first[:-1][alone], first[1:][alone]], 1).ravel()
        low = np.minimum.reduceat(np.append(h, np.uint64(2**64 - 1)), bounds)[::2]
        order = np.lexsort((alone, ~heads[alone], low))
        value, at = low[order], alone[order]
        cut = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a < 2:
                continue
            p = at[a]
            mine = token[first[p] : first[p + 1]]
            for q in at[a + 1 : b]:
                if heads[q]:
                    continue
                other = token[first[q] : first[q + 1]]
                if 100 * min(len(mine), len(other)) < PERCENT * max(len(mine), len(other)):
                    continue
                if linked(_overlap(mine, other), len(mine), len(other)):
                    leader[q] = p
    return leader


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def _groups(frequent=None):
    """Rows of two kinds: a document's (token null) and a group's prefix tokens; without ``frequent`` the tokens of the latter alone, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = frequent.value if frequent else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        for batch in (b.slice(at, end - at) for b in batches for at, end in T.runs(b.column(1), RUN)):
            parts = list(shingle_sets(batch.column(1)))
            token = np.concatenate([t for _, t, _ in parts])
            size = np.concatenate([np.diff(f) for _, _, f in parts])
            first = np.concatenate([[0], np.cumsum(size)])
            ids = batch.column(0).fill_null(0).to_numpy().astype(np.int64)
            known = ~np.asarray(batch.column(0).is_null())
            use = np.flatnonzero(known & (size > 0))
            leader = np.arange(len(size))
            if len(use):
                row = np.repeat(np.arange(len(size)), size)
                on = np.isin(row, use) if len(use) < len(size) else np.ones(len(row), bool)
                leader[use] = use[_fold(ids[use], token[on], np.concatenate([[0], np.cumsum(size[use])]))]
            digest = np.zeros(len(size), np.uint64)
            if len(token):
                bounds = np.stack([first[:-1], np.maximum(first[1:], first[:-1])], 1).ravel()
                digest = np.where(size > 0, np.bitwise_xor.reduceat(np.append(T.mix(token + np.uint64(1)), np.uint64(0)), bounds)[::2], np.uint64(0))
            real = ids
            if frequent:
                yield pa.record_batch(
                    {"doc_id": batch.column(0).cast(pa.int64()), "n_shingles": size.astype(np.int64), "leader": pa.array(real[leader], mask=~known), "variant": pa.array(_signed(digest), mask=digest == digest[leader]), "token": pa.nulls(len(size), pa.int64())}
                )
            if not len(use):
                continue
            # prefixes: within each row the tokens that aren't common, ascending, and then those that are, rarest first
            row = np.repeat(np.arange(len(size)), size)
            last = T.among(token, late)
            before = np.concatenate([[0], np.cumsum(~last)])
            place = before[:-1] - before[first[row]]
            tail = np.flatnonzero(last)
            tail = tail[np.lexsort((rank[np.searchsorted(late, token[tail])], row[tail]))]
            nth = np.arange(len(tail)) - np.searchsorted(row[tail], row[tail])
            place[tail] = (before[first[1:]] - before[first[:-1]])[row[tail]] + nth
            most = size - (PERCENT * size + 99) // 100 + 1
            keep = (place < most[row]) & known[row]
            group, t = leader[row[keep]], token[keep]
            both = np.lexsort((t, group))
            group, t = group[both], t[both]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (group[1:] != group[:-1])
            if not frequent:
                yield pa.record_batch({"token": _signed(t[new])})
                continue
            none = pa.nulls(int(new.sum()), pa.int64())
            yield pa.record_batch({"doc_id": none, "n_shingles": none, "leader": real[group[new]], "variant": none, "token": _signed(t[new])})

    return T.tidy(run)


@T.tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, token, first in shingle_sets(batch.column(1)):
            off = pa.array((first * 8).astype(np.int64))
            yield pa.record_batch({"doc_id": batch.column(0).slice(a, len(first) - 1), "tokens": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, off.buffers()[1], pa.py_buffer(token)]).cast(pa.binary())})


@T.tidy
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        ok = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            ok.append(bool(linked(_overlap(p, q), len(p), len(q))))
        yield pa.record_batch({"a": batch.column(0), "b": batch.column(1), "ok": pa.array(ok, pa.bool_())})


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ok) of document pairs (a, b), by whole token sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    near = (100 * F.least(F.length("x"), F.length("y")) >= PERCENT * F.greatest(F.length("x"), F.length("y")))
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long, ok boolean")


def _cells(long_lists: DataFrame, docs: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) among the groups of long lists, by documents.

    A token's groups gather at the list's pivot; most tokens of a family of documents have the same one, so a group is in
    few cells, and two groups that share a long list are in one together. A cell of many documents is cut into blocks,
    and each two blocks meet in a task of their own.
    """
    parts = F.ceil(F.col("groups") / SPLIT)
    pivot = long_lists.groupBy("token", "groups").agg(F.min_by("leader", F.xxhash64("leader")).alias("pivot"))
    pivot = pivot.select("token", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    star = long_lists.withColumn("part", F.pmod(F.xxhash64("leader"), parts)).join(pivot, ["token", "part"])
    star = scratch.table(star.select("pivot", "leader").distinct(), "stars")
    several = own.where("leader <> doc_id and variant is not null").groupBy("leader", "variant").agg(F.min("doc_id").alias("doc_id"))
    several = scratch.table(several.join(star.select("leader").distinct(), "leader", "left_semi").select("leader", "doc_id"), "members")
    inside = star.select("pivot", F.col("leader").alias("doc_id")).unionByName(star.join(several, "leader").select("pivot", "doc_id"))
    size = own.where("doc_id is not null").groupBy("doc_id").agg(F.sum("n_shingles").alias("n"))
    inside = scratch.table(inside.join(size, "doc_id"), "cells")
    blocks = inside.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum("n") / CELL_TOKENS)).cast("int").alias("k")).where("k > 0")
    block = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("k")).cast("int")
    parted = inside.join(blocks, "pivot").withColumn("i", block).select("pivot", "doc_id", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    parted = parted.select("doc_id", "pivot", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    sets = scratch.table(docs.where("doc_id is not null").join(inside.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, tokens binary"), "sets")
    found = parted.join(sets, "doc_id").groupBy("pivot", "i", "j").applyInArrow(_cell, "a long, b long").distinct()
    tied = several.select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
    return scratch.table(found.unionByName(tied), "cell-links")


def _open(pairs: DataFrame, docs: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """Linked group pairs (a, b): leaders are compared first, then the groups' different members.

    Token sets are made for the documents in question only.
    """
    both = pairs
    several = own.where("leader <> doc_id and variant is not null")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("leader")).distinct()
    members = scratch.table(several.join(ends, "leader", "left_semi").groupBy("leader", "variant").agg(F.min("doc_id").alias("doc_id")).select("leader", "doc_id"), "members")
    need = scratch.table(both.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(members.select("doc_id")).distinct(), "need")
    sets = scratch.table(docs.where("doc_id is not null").join(need, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, tokens binary"), "sets")
    done = scratch.table(compare(both, sets).where("ok").select("a", "b").distinct(), "linked")
    if not members.limit(1).count():
        return done
    left = pairs.distinct().join(done, ["a", "b"], "left_anti")
    other = members.select(F.col("leader").alias("a"), F.col("doc_id").alias("p"))
    mate = members.select(F.col("leader").alias("b"), F.col("doc_id").alias("q"))
    many = left.join(other, "a", "left").join(mate, "b", "left").where("p is not null or q is not null").select("a", "b", F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q"))
    # a member or leader of a with one of b, but for the two leaders themselves
    spread = many.select("a", "b", F.explode(F.array(F.struct("p", "q"), F.struct(F.col("a").alias("p"), "q"), F.struct("p", F.col("b").alias("q")))).alias("s")).select("a", "b", "s.p", "s.q").where("p <> a or q <> b").distinct()
    spread = scratch.table(spread, "spread")
    met = compare(spread.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), sets).where("ok").select(F.col("a").alias("p"), F.col("b").alias("q")).distinct()
    return done.unionByName(scratch.table(spread.join(met, ["p", "q"]).select("a", "b").distinct(), "opened"))


def _cell(key: tuple, rows: pa.Table) -> pa.Table:
    """Links within one cell (or between two of its blocks) by a matrix product over the tokens that several documents have.

    Of each set of linked documents a tree is returned, not every link. The matrices are made and read in strips.
    """
    ids = rows.column("doc_id").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in rows.column("tokens").chunks for x in chunk]
    n, size = len(sets), np.array([len(x) for x in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token = token[order]
    new = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    several = ~new
    several[:-1] |= ~new[1:]
    row = np.repeat(np.arange(n, dtype=np.int32), size)[order][several]
    name = np.cumsum(new[several], dtype=np.int32) - 1
    del token, order, new, several
    inter, x = np.zeros((n, n), np.float32), None
    for low in range(0, int(name[-1]) + 1 if len(name) else 0, COLUMNS):
        a, b = np.searchsorted(name, [low, low + COLUMNS])
        x = np.zeros((n, COLUMNS), np.float32)
        x[row[a:b], name[a:b] - low] = 1
        for k in range(0, n, STRIP):
            inter[k : k + STRIP] += x[k : k + STRIP] @ x.T
    strips = [(k, linked(inter[k : k + STRIP].astype(np.int64), size[k : k + STRIP, None], size[None, :])) for k in range(0, n, STRIP)]
    label = np.arange(n)
    while True:
        low = np.concatenate([np.where(ok, label[None, :], n).min(1) for _, ok in strips])
        low = np.minimum(low, label)[np.minimum(low, label)]
        if (low == label).all():
            break
        label = low
    on = np.flatnonzero(label != np.arange(n))
    if n > STRIP:
        del inter, strips, x
        T.give_back()
    return pa.table({"a": ids[on], "b": ids[label[on]]})


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest id reachable by links (Jaccard of 5-word shingle sets of 0.8 or more). Empty
    or null texts have 0 shingles and are linked with nothing. Rows that repeat an id are one node and all returned;
    rows with a null id take part in no link and get a null component. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "jaccard", RUN_BYTES)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = scratch.table(docs.mapInArrow(_groups(), "token long").groupBy("token").agg(F.count("*").alias("groups")).where(F.col("groups") >= COMMON), "common")
    most = first.orderBy(F.desc("groups"), "token").limit(FREQUENT).select("token").toArrow()["token"].to_numpy()[::-1].view(np.uint64)
    by_value = np.argsort(most)
    late = spark.sparkContext.broadcast((most[by_value], by_value.astype(np.int32)))
    rows = scratch.table(docs.mapInArrow(_groups(late), _ROWS), "groups")
    late.unpersist()
    own = rows.where("token is null").select("doc_id", "n_shingles", "leader", "variant")
    matrix = rows.where("token is not null").select("token", "leader")

    shared = scratch.table(matrix.groupBy("token").agg(F.count("*").alias("groups"), F.min("leader").alias("a"), F.max("leader").alias("b")).where("a < b"), "shared")
    lists = scratch.table(matrix.join(shared.where("groups > 2").select("token", "groups"), "token"), "lists")
    long_lists = lists.where(F.col("groups") > LONG).select("token", "leader", "groups")

    # the least and most tokens of a group's documents and the number of its tokens in long lists
    info = own.where("leader is not null and n_shingles > 0").groupBy("leader").agg(F.min("n_shingles").alias("n"), F.max("n_shingles").alias("most"))
    info = info.join(long_lists.groupBy("leader").agg(F.count("*").alias("long")), "leader", "left").select("leader", "n", "most", F.coalesce("long", F.lit(0)).alias("long"))
    info = scratch.table(info, "info")

    # pairs of short lists, counted; one is opened if the count, the long lists and what lies behind the prefixes can reach
    short = lists.where(F.col("groups") <= LONG).select("token", "leader")
    met = shared.where("groups = 2").select("a", "b").unionByName(short.alias("l").join(short.alias("r"), "token").where("l.leader < r.leader").select(F.col("l.leader").alias("a"), F.col("r.leader").alias("b")))
    counts = scratch.table(met.groupBy("a", "b").agg(F.count("*").alias("c")), "counts")
    side = lambda end, n, most, long: info.select(F.col("leader").alias(end), F.col("n").alias(n), F.col("most").alias(most), F.col("long").alias(long))
    sized = counts.join(side("a", "n", "n1", "k"), "a").join(side("b", "m", "m1", "l"), "b")
    behind = lambda c: F.floor((F.col(c) * PERCENT + 99) / 100) - 1
    reach = (100 + PERCENT) * (F.col("c") + F.least("k", "l") + F.greatest(behind("n1"), behind("m1"))) >= PERCENT * (F.col("n") + F.col("m"))
    alike = (100 * F.col("m1") >= PERCENT * F.col("n")) & (100 * F.col("n1") >= PERCENT * F.col("m"))
    pairs = scratch.table(sized.where(reach & alike).select("a", "b"), "pairs")
    links = _open(pairs, docs, own, scratch)
    if long_lists.limit(1).count():
        links = links.unionByName(_cells(long_lists, docs, own, scratch))
    # a repeated id is one node: it ties the groups that its rows are in
    several = own.groupBy("doc_id").agg(F.min("leader").alias("a"), F.max("leader").alias("z")).where("a < z").select("doc_id", "a")
    if (several := scratch.table(several, "several")).limit(1).count():
        links = links.unionByName(own.join(several, "doc_id").select("a", F.col("leader").alias("b")).where("a <> b"))
    # and a group's smallest id, so that a class is named by its smallest
    low = own.groupBy("leader").agg(F.min("doc_id").alias("b")).where("b < leader")
    links = links.unionByName(low.select(F.col("leader").alias("a"), "b"))
    comp = scratch.table(connected_components(links), "classes")
    scratch.drop(keep=("groups", "classes"))
    return own.join(comp.withColumnRenamed("node", "leader"), "leader", "left").select("doc_id", "n_shingles", F.coalesce("component", "leader").alias("component_id"))
