"""Frame lists, run records and written results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stereolith.operators.geometry import POSE
from stereolith.operators.ranking import ranked
from stereolith.operators.sampling import linspace_index
from stereolith.plans.scratch import Scratch

# fixed values: image suffixes
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp", "ppm", "pgm")
#: Diagonal of the 36 x 24 mm frame that the 35 mm equivalent refers to.
DIAGONAL = 43.26661530556787


def natural_key(path: Column) -> Column:
    """Text and number by turns, beginning with a (maybe empty) text: texts compare with texts, numbers as numbers."""
    return F.arrays_zip(F.split(path, r"\d+").alias("t"), F.transform(F.regexp_extract_all(path, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("decimal(38,0)")).alias("n"))


def natural_order(df: DataFrame, path: str = "path") -> DataFrame:
    """``df`` with ``frame_idx`` from 0 by the natural key (ties: the path, then the other columns that have an order), ranked over range partitions of it."""
    keyed = df.withColumn("_key", natural_key(F.col(path)))
    more = [F.col(c) for c, kind in df.dtypes if c != path and not kind.startswith(("map", "variant")) and "map<" not in kind]
    found = ranked(keyed, [F.col("_key"), F.col(path), *more], Scratch(df.sparkSession, "order"), rank="frame_idx").drop("_key")
    return found.withColumn("frame_idx", F.col("frame_idx").cast("int"))


def list_images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(frame_idx, path) of the images under ``root``; deeper folders only if the top one has none."""
    kind = rf"(?i)\.({'|'.join(SUFFIXES)})$"

    def found(deep: bool) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", "*").load(root).select("path")
        return files.where(F.col("path").rlike(kind))

    top = found(False)
    files = found(True) if recursive and not top.limit(1).count() else top
    return natural_order(files)


def even_subset(df: DataFrame, order: str, k: int, how: str = "trunc", by: str | None = None) -> DataFrame:
    """At most ``k`` rows evenly over the order (per group ``by``), first and last among them."""
    f = ranked(df, [F.col(order)], Scratch(df.sparkSession, "even"), by=by, rank="_i", count="_m").withColumnRenamed("_m", "_n")
    picked = F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: linspace_index(i, F.col("_n"), F.lit(k), how) == F.col("_i"))
    return f.where((F.col("_n") <= k) | picked).drop("_i", "_n")


def exif_focal(df: DataFrame) -> DataFrame:
    """``exif_focal`` in pixels of (f35, w, h), null if any is missing or not positive; ``start_focal`` by priority."""
    long_side = F.greatest("w", "h")
    ok = (F.col("f35") > 0) & (F.col("w") > 0) & (F.col("h") > 0)
    exif = F.when(ok, F.col("f35") / DIAGONAL * F.sqrt(1 + (F.col("h") / F.col("w")) ** 2))
    return df.withColumn("exif_focal", exif * F.col("w")).withColumn("start_focal", F.coalesce("k_focal", F.when(F.col("calibrated"), long_side.cast("double")), "exif_focal", 1.2 * long_side))


def pose_rows(df: DataFrame, frames: DataFrame) -> DataFrame:
    """A row for each of ``frames``; poses with a NaN are null, poses of other frames are dropped."""
    bad = F.lit(False)
    for c in POSE:
        bad = bad | F.isnan(c) | F.col(c).isNull()
    clean = df.select("frame_idx", *[F.when(~bad, F.col(c)).alias(c) for c in POSE])
    return frames.select("frame_idx").join(clean, "frame_idx", "left")


def camera_lines(quats: DataFrame) -> DataFrame:
    """(frame_idx, line): ``idx tx ty tz qx qy qz qw`` with nine decimals; rows with a null are left out."""
    return quats.dropna().select("frame_idx", F.format_string("%d %.9f %.9f %.9f %.9f %.9f %.9f %.9f", "frame_idx", "t0", "t1", "t2", "qx", "qy", "qz", "qw").alias("line"))


def write_cameras(quats: DataFrame, path: str) -> None:
    """Text files of camera lines behind three comment lines, in frame order over the files."""
    spark = quats.sparkSession
    head = spark.createDataFrame([(-3, "# Camera poses"), (-2, "# frame tx ty tz qx qy qz qw"), (-1, "# world to camera")], "frame_idx int, line string")
    head.unionByName(camera_lines(quats)).orderBy("frame_idx").select("line").write.text(path)


def write_report(row: DataFrame, path: str) -> None:
    row.write.json(path)


def _vertices(colored: bool):
    fields = [(c, "<f4") for c in "xyz"] + [(c, "u1") for c in ("red", "green", "blue")] * colored

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, fields)
            for (name, kind), column in zip(fields, batch.columns, strict=True):
                out[name] = column.to_numpy(zero_copy_only=False).astype(kind)
            yield pa.record_batch({"rows": pa.array([batch.num_rows], pa.int64()), "body": pa.array([out.tobytes()], pa.binary())})

    return run


def ply_parts(cloud: DataFrame) -> tuple[bytes, DataFrame]:
    """The header of a binary little-endian PLY file, and its body in parts (rows, body)."""
    colored = {"r", "g", "b"} <= set(cloud.columns)
    names = ["x", "y", "z"] + ["r", "g", "b"] * colored
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {cloud.count()}", *(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue") if colored), "end_header", ""]
    return "\n".join(lines).encode(), cloud.select(*names).mapInArrow(_vertices(colored), "rows long, body binary")


def write_ply(cloud: DataFrame, path: str) -> None:
    """The cloud as one binary PLY file at ``path`` (a URI or a local path), its parts streamed one after another in any order.

    A file is for a viewer: give it a cloud that ``dense.cap_points`` has bounded.
    """
    head, body = ply_parts(cloud)
    store, at = _store(path)
    with store.open_output_stream(at) as out:
        out.write(head)
        for row in body.select("body").toLocalIterator():
            out.write(bytes(row["body"]))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


#: Vertices of a range of a file that one task reads, and of a batch.
RANGE, VERTICES = 2_000_000, 100_000


def read_ply(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """The vertices of files that ``write_ply`` made, of any length: tasks read ranges of ``rows`` vertices each."""
    rows = rows or RANGE
    parts = []
    for found in spark.read.format("binaryFile").load(path).select("path").collect():  # names alone, no content
        store, at = _store(found["path"])
        with store.open_input_stream(at) as f:
            head = b""
            while b"end_header\n" not in head and (more := f.read(4096)):
                head += more
        head = head.partition(b"end_header\n")[0]
        lines = head.decode().splitlines()
        names = ",".join(x.split()[2] for x in lines if x.startswith("property"))
        n = next(int(x.split()[2]) for x in lines if x.startswith("element vertex"))
        parts += [(found["path"], names, len(head) + len(b"end_header\n"), k, min(rows, n - k)) for k in range(0, n, rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, names, start, first, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = names.split(",")
                kind = np.dtype([(n, "<f4" if n in "xyz" else "u1") for n in names])
                store, where = _store(at)
                with store.open_input_file(where) as f:
                    f.seek(start + first * kind.itemsize)
                    for k in range(0, count, VERTICES):
                        size = min(VERTICES, count - k) * kind.itemsize
                        body = f.read(size)
                        if len(body) != size:
                            raise ValueError(f"{at} ends before its last vertex")
                        v = np.frombuffer(body, kind)
                        none = np.zeros(len(v), np.int32)
                        yield pa.record_batch({**{c: v[c].astype(np.float32) for c in "xyz"}, **{c: v[n].astype(np.int32) if n in names else pa.array(none, mask=none == 0) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))}})

    ranges = spark.createDataFrame(parts, "path string, names string, start long, first long, count long")
    return ranges.repartition(max(1, len(parts))).mapInArrow(run, "x float, y float, z float, r int, g int, b int")


def pending_pairs(pairs: DataFrame, done: DataFrame, fingerprint: str) -> DataFrame:
    """Pairs that are neither hit nor known empty under ``fingerprint``."""
    return pairs.join(done.where(F.col("fingerprint") == fingerprint).select("frame_a", "frame_b"), ["frame_a", "frame_b"], "left_anti")


def fingerprint(poses: DataFrame, camera: str, num_disparities: int, block_size: int) -> DataFrame:
    """One row: md5 over the camera, the normalised parameters, and every max(1, n // 30)-th pose (in millionths)."""
    nd = max(16, num_disparities // 16 * 16)
    bs = max(3, min(block_size + (block_size % 2 == 0), 21))
    told = F.coalesce(F.concat_ws(",", *[F.bround(F.col(c) * 1e6, 0).cast("long").cast("string") for c in POSE]), F.lit("none"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 30))
    some = ranked(poses, [F.col("frame_idx")], Scratch(poses.sparkSession, "fingerprint"), rank="_i", count="n").where(F.col("_i") % step == 0).select("_i", told.alias("p"), "n")
    told_all = some.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "p"))), lambda x: x["p"]), ";").alias("p"), F.max("n").alias("n"))
    return told_all.select(F.md5(F.concat_ws("|", F.lit(camera), F.lit(str(nd)), F.lit(str(bs)), "p", F.col("n").cast("string"))).alias("fingerprint"))


def config_drift(old: DataFrame, new: DataFrame, floats: list[str], others: list[str]) -> DataFrame:
    """(run_id, changed): names of fields that differ, sorted; a null on either side is no change, floats differ from 1e-6 on."""
    a, b = old.alias("a"), new.alias("b")
    differs = {c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) >= 1e-6 for c in floats} | {c: F.col(f"a.{c}") != F.col(f"b.{c}") for c in others}
    changed = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(c)) for c, v in differs.items()])))
    return a.join(b, "run_id").select("run_id", F.array_join(changed, ",").alias("changed"))
