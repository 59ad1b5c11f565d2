"""Vector sources and sinks: sparse text, raw float32 files, generated blobs, dumps, dimensions of files."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vecloom.functions.numerics import let

#: Dense values, 4 bytes each, beyond which sparse text is refused: 60 GB.
DENSE_VALUES = 15_000_000_000
#: Rows of a raw file that one task reads, and of one batch.
TASK_ROWS, BATCH_ROWS = 1 << 18, 8_192


def parse_libsvm(lines: DataFrame, dimension: int | None = None, most: int = DENSE_VALUES) -> DataFrame:
    """id, label, x (dense array<double>) from rows (id, value) of sparse text.

    What follows # is dropped, blank lines are passed over; the label is the number the line begins
    with; tokens that aren't integer:number are passed over, as are indices below 1; of an index
    that is repeated the last counts. Without a dimension it is the largest index, found in a pass of its own, and more dense
    values than most are an error. A line's pairs become one map, so a row costs its pairs and its dimension, not their product."""
    clean = lines.select("id", F.trim(F.regexp_replace("value", r"#.*$", "")).alias("t")).filter("t <> ''")
    label = F.regexp_extract("t", r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", 0)
    tokens = F.filter(F.split("t", r"\s+"), lambda s: s.rlike(r"^[0-9]+:[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"))
    pairs = F.transform(tokens, lambda s: F.struct(F.substring_index(s, ":", 1).cast("int").alias("k"), F.substring_index(s, ":", -1).cast("double").alias("v")))
    rows = clean.select("id", label.try_cast("double").alias("label"), F.filter(pairs, lambda p: p["k"] > 0).alias("pairs"))
    if dimension is None:
        found = rows.agg(F.max(F.array_max(F.transform("pairs", lambda p: p["k"]))).alias("d"), F.count("*").alias("n")).first()
        dimension = found.d or 0
        if dimension * found.n > most:
            raise ValueError(f"{found.n} rows of dimension {dimension} are more than {most} dense values")
    if not dimension:
        return rows.select("id", "label", F.array().cast("array<double>").alias("x"))
    ordered = F.array_sort(F.transform("pairs", lambda p, i: F.struct(p["k"].alias("k"), (-i).alias("at"), p["v"].alias("v"))))  # of equal indices the last comes first

    def lasts(sorted_):
        marked = F.transform(sorted_, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), F.when(i > 0, F.try_element_at(sorted_, i)["k"]).alias("before")))
        return F.filter(marked, lambda p: p["before"].isNull() | (p["before"] != p["k"]))

    kept = let(ordered, lasts)

    def add(acc, p):
        gap = F.array_repeat(F.lit(0.0), p["k"] - 1 - F.size(acc))
        return F.concat(acc, gap, F.array(p["v"]))

    inside = F.filter("kept", lambda p: p["k"] <= dimension)
    dense = F.aggregate(inside, F.array().cast("array<double>"), add)
    return rows.withColumn("kept", kept).select("id", "label", dense.alias("x")).withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), dimension - F.size("x"))))


def parse_libsvm_points(lines: DataFrame, dimension: int | None = None) -> DataFrame:
    """id, x: the same without labels."""
    return parse_libsvm(lines, dimension).drop("label")


def read_libsvm(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """id (a line's place in its file, among the files in order of name), label, x and class (labels numbered by first appearance) of sparse text files."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), "value")
    return first_seen(parse_libsvm(lines, dimension), "label", "id")


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, rows: int, number: int):
        self.path, self.first, self.rows, self.number = path, first, rows, number


class _Float32Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width = options["path"], int(options["dimension"])
        self.most = int(options.get("rows", "-1"))

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.is_file else sorted((f for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name.endswith(".bin")), key=lambda f: f.base_name)
        if not files:
            raise FileNotFoundError(self.path)
        out, number = [], 0
        for file in files:
            rows, torn = divmod(file.size, 4 * self.width)
            if torn:
                raise ValueError(f"{file.path} doesn't hold whole rows of {self.width} values")
            if self.most >= 0:
                rows = min(rows, self.most - number)
            out += [_Rows(file.path, first, min(TASK_ROWS, rows - first), number + first) for first in range(0, rows, TASK_ROWS)]
            number += rows
        return out or [_Rows(files[0].path, 0, 0, 0)]

    def read(self, partition):
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as file:
            file.seek(4 * self.width * partition.first)
            for at in range(0, partition.rows, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.rows - at)
                values = np.frombuffer(file.read(4 * self.width * n), "<f4").astype(np.float64)
                x = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.width), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64) + partition.number + at), x], names=["id", "x"])


class Float32Source(DataSource):
    """Headerless row-major little-endian float32 rows of a file, or of a folder's .bin files in order of name.

    Options: path (a URI), dimension, rows (a prefix; by default all). Tasks read ranges of rows as whole batches; a torn last row is an error."""

    @classmethod
    def name(cls):
        return "vecloom_float32"

    def schema(self):
        return "id long, x array<double>"

    def reader(self, schema):
        return _Float32Reader(self.options)


def uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def read_float32(spark: SparkSession, path: str, dimension: int, rows: int | None = None) -> DataFrame:
    """id, x of a headerless row-major little-endian float32 file, in file order, or of its first rows. A torn last row is an error."""
    if dimension < 1 or (rows is not None and rows < 0):
        raise ValueError("dimension must be positive, rows not negative")
    spark.dataSource.register(Float32Source)
    reader = spark.read.format("vecloom_float32").option("path", uri(path)).option("dimension", dimension)
    return (reader if rows is None else reader.option("rows", rows)).load()


def _text(path: str) -> str | None:
    fs, at = pafs.FileSystem.from_uri(uri(path))
    if not fs.get_file_info(at).is_file:
        return None
    with fs.open_input_stream(at) as file:
        return file.read().decode()


def resolve_dimension(path: str, explicit: int | None = None) -> int:
    """The dimension of a raw file: by its sidecar path.meta (rows and dimension), else by its id, of data_<id>.bin,
    in ../manifest.tsv, else the explicit one. One that disagrees with the file's own is an error, as is none at all."""
    found = source = None
    sidecar = _text(path + ".meta")
    if sidecar is not None:
        found, source = int(sidecar.split()[1]), path + ".meta"
    else:
        name = posixpath.basename(path)
        if name.startswith("data_") and name.endswith(".bin") and not name.endswith("_test.bin"):
            place = posixpath.join(posixpath.dirname(posixpath.dirname(path)), "manifest.tsv")
            manifest = _text(place)
            head, *lines = [line.split("\t") for line in (manifest or "").splitlines()] or [[]]
            row = next((dict(zip(head, line)) for line in lines if dict(zip(head, line)).get("id") == name[len("data_") : -len(".bin")]), None)
            if row:
                found, source = int(row["d"]), place
    if found is not None and explicit is not None and explicit != found:
        raise ValueError(f"{path}: dimension {explicit} is asked for, but {source} says {found}")
    if found is None and explicit is None:
        raise ValueError(f"{path}: no sidecar, no line in a manifest and no dimension given")
    return found if found is not None else explicit


def lookup(manifest: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """wanted with its manifest rows; the manifest is a small table."""
    return wanted.join(F.broadcast(manifest), key, "left")


def dump_float32(points: DataFrame, folder: str, dimension: int) -> int:
    """Writes points (id, x) in order of id as raw float32 parts, which read_float32 reads back, and the sidecar folder.meta.

    Tasks write under names of their own and rename when whole. Gives the number of rows. A vector of another length is an error."""
    place = uri(folder)
    ordered = points.select("id", F.when(F.size("x") == dimension, F.col("x")).otherwise(F.raise_error(F.lit("a vector of another dimension"))).alias("x")).repartitionByRange("id").sortWithinPartitions("id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(place)
        fs.create_dir(root, recursive=True)
        number, n = TaskContext.get().partitionId(), 0
        own = f"{root}/.{number:06d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            for batch in batches:
                out.write(batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                n += batch.num_rows
        fs.move(own, f"{root}/part-{number:06d}.bin")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    n = ordered.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    fs, root = pafs.FileSystem.from_uri(place)
    with fs.open_output_stream(root + ".meta") as out:
        out.write(f"{n} {dimension}\n".encode())
    return n


def normalised_where(rows: DataFrame, listed: list[str], key: str = "dataset") -> DataFrame:
    """rows (key, x): x over its length where the key is listed, as it is elsewhere."""
    from vecloom.functions import vectors as V

    return rows.withColumn("x", F.when(F.col(key).isin(listed), V.normalise(F.col("x"))).otherwise(F.col("x")))


def blobs(spark: SparkSession, n: int, dimension: int, k: int, std: float = 1.0, box: float = 10.0, seed: int = 1) -> DataFrame:
    """id, label, x: point id of blob floor(id * k / n); centres uniform in a box, points normal about them. Same values however it is partitioned."""
    if min(n, dimension, k) < 1 or k > n:
        raise ValueError("n, dimension and k must be positive, k at most n")

    def uniform(*parts):
        return (F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    rows = spark.range(n).select("id", F.floor(F.col("id") * k / n).cast("int").alias("label"))

    def value(l):
        centre = (2 * uniform(F.lit("c"), F.col("label"), l) - 1) * box
        normal = F.sqrt(-2 * F.ln(uniform(F.lit("u"), F.col("id"), l))) * F.cos(6.283185307179586 * uniform(F.lit("w"), F.col("id"), l))
        return centre + std * normal

    return rows.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), value))


def first_seen(rows: DataFrame, label: str, order: str) -> DataFrame:
    """rows with class: labels numbered by first appearance."""
    from pyspark.sql import Window

    seen = rows.groupBy(label).agg(F.min(order).alias("at"))
    numbered = seen.select(label, (F.row_number().over(Window.orderBy("at", label)) - 1).cast("int").alias("class"))  # a row for each label
    return rows.join(F.broadcast(numbered), label)
