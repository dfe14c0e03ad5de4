"""Record tables: scans, sorted and sharded writes, lookups, merges, metadata, paths and file systems."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODECS = ("none", "snappy", "zstd", "gzip", "lz4")
#: Metadata keys that a table reserves for itself.
VALUE_FORMAT, SORT_ORDER = "value.format", "sort.order"


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table as a DataFrame; filters and columns are pushed to the files."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def scan_shards(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Some shards of a table (S2); byte ranges within a shard are Spark's input splits (S3)."""
    return spark.read.parquet(*paths)


def entry_count(df: DataFrame) -> int:
    """Records of a table (S5); Parquet answers it from its footers."""
    return df.count()


def shard_paths(df: DataFrame) -> list[str]:
    """The files of a table; their number is its shard count."""
    return sorted(df.inputFiles())


def find(df: DataFrame, key: object, key_col: str = "key") -> tuple[bool, T.Row | None]:
    """Point lookup: (found, record) (S7). The filter reaches the files' statistics and bloom filters."""
    row = df.filter(F.col(key_col) == F.lit(key)).limit(1).first()
    return row is not None, row


def lookup_batch(df: DataFrame, ids: DataFrame, key_col: str = "key") -> DataFrame:
    """The records whose key is among ids."""
    return df.join(ids.select(key_col).distinct(), key_col, "left_semi")


def write_table(df: DataFrame, path: str, shards: int | None = None, key: list[str] | None = None, sort: bool = True, codec: str = "snappy", bloom: str | None = None, mode: str = "errorifexists") -> None:
    """Write a table in shards by key, each sorted by it (S9, S10, S17); bloom names a column for Parquet bloom filters."""
    out = codec_checked(codec)
    if key:
        df = df.repartition(shards, *key) if shards else df.repartition(*key)
        df = df.sortWithinPartitions(*key) if sort else df
    elif shards:
        df = df.repartition(shards)
    writer = df.write.mode(mode).option("compression", out)
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
    writer.parquet(path)


def write_typed(df: DataFrame, path: str, schema: T.StructType, **options) -> None:
    """Write with a declared schema: columns are cast to it and unknown ones refused."""
    missing = {f.name for f in schema} ^ set(df.columns)
    if missing:
        raise ValueError(f"columns differ from the schema: {sorted(missing)}")
    write_table(df.select(*[F.col(f.name).cast(f.dataType) for f in schema]), path, **options)


def codec_checked(name: str) -> str:
    """A known compression codec's name; ValueError otherwise."""
    if name not in CODECS:
        raise ValueError(f"unknown compression codec: {name}")
    return name


def with_metadata(df: DataFrame, column: str, **values: object) -> DataFrame:
    """Attach named metadata to a column; Parquet keeps it."""
    found = {**df.schema[column].metadata, **values}
    return df.withColumn(column, F.col(column).alias(column, metadata=found))


def metadata(df: DataFrame, column: str) -> dict:
    return dict(df.schema[column].metadata)


def merge_tables(tables: list[DataFrame], key: list[str], shards: int | None = None) -> DataFrame:
    """All records of all tables in key order (U1, W3). One range-partitioned sort serves any number of tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.repartitionByRange(shards, *key).sortWithinPartitions(*key) if shards else out.orderBy(*key)


class FileSystem:
    """Files of any URI that Spark reads: exists, list, size, times, folders, removal, copies."""

    def __init__(self, spark: SparkSession, uri: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(uri).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def is_dir(self, path: str) -> bool:
        return self.exists(path) and self._fs.getFileStatus(self._path(path)).isDirectory()

    def is_file(self, path: str) -> bool:
        return self.exists(path) and self._fs.getFileStatus(self._path(path)).isFile()

    def make_dir(self, path: str) -> bool:
        return self._fs.mkdirs(self._path(path))

    def list_dir(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def modified(self, path: str) -> int:
        return self._fs.getFileStatus(self._path(path)).getModificationTime()

    def set_modified(self, path: str, millis: int) -> None:
        self._fs.setTimes(self._path(path), millis, -1)

    def block_size(self, path: str) -> int:
        return self._fs.getFileStatus(self._path(path)).getBlockSize()

    def remove(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    def write(self, path: str, data: bytes) -> None:
        """A file of these bytes; folders are made, a file in the way is replaced."""
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read(self, path: str, start: int = 0, length: int | None = None) -> bytes:
        """A file's bytes, or a range of them."""
        end = self.size(path) if length is None else min(self.size(path), start + length)
        source = self._fs.open(self._path(path))
        try:
            source.seek(start)
            return bytes(source.readNBytes(max(0, end - start)))
        finally:
            source.close()

    def upload(self, local: str, path: str) -> None:
        self._fs.copyFromLocalFile(self._path(local), self._path(path))

    def download(self, path: str, local: str) -> None:
        self._fs.copyToLocalFile(self._path(path), self._path(local))


def shard_number(path: Column) -> Column:
    """The number in a shard's name, as in part-00012; null if there is none."""
    return F.regexp_extract(path, r"part-(?:r-)?(\d+)", 1).try_cast("long")


def clean_path(path: Column) -> Column:
    """A path without scheme, host and port."""
    return F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")


def split_file_list(paths: Column) -> Column:
    """A comma-separated list as an array, without empty names."""
    return F.filter(F.transform(F.split(paths, ","), lambda x: F.trim(x)), lambda x: x != "")


def import_images(spark: SparkSession, path: str) -> DataFrame:
    """JPEG files under path: (image_id, name, data); other files are left out by their first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    jpeg = files.filter(F.substring("content", 1, 3) == F.to_binary(F.lit("FFD8FF"), F.lit("hex")))
    return jpeg.select(F.xxhash64("path").alias("image_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data"))


def export_images(images: DataFrame, path: str, class_col: str | None = None) -> None:
    """Images as a table partitioned by class, one row per file name."""
    out = images.withColumn("file_name", F.concat(F.col("image_id").cast("string"), F.lit(".jpg")))
    writer = out.write.mode("errorifexists")
    (writer.partitionBy(class_col) if class_col else writer).parquet(path)


def missing_results(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Configurations without a result yet."""
    return wanted.join(done.select(*key), key, "left_anti")


class ResultStore:
    """Results by their configuration, a struct's fields: contains, put, items, and download as one sorted table."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path, key

    def items(self) -> DataFrame | None:
        """All results, the latest of each configuration; None before the first."""
        if not FileSystem(self.spark, self.path).exists(self.path):
            return None
        rows = self.spark.read.parquet(self.path)
        rest = [c for c in rows.columns if c not in (*self.key, "written")]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "written").alias("r")).select(*self.key, "r.*")

    def put(self, results: DataFrame) -> None:
        """Add results; those of a known configuration take its place."""
        results.withColumn("written", F.current_timestamp()).write.mode("append").parquet(self.path)

    def contains(self, **key: object) -> bool:
        rows = self.items()
        if rows is None:
            return False
        for k, v in key.items():
            rows = rows.filter(F.col(k) == F.lit(v))
        return not rows.isEmpty()

    def missing(self, wanted: DataFrame) -> DataFrame:
        rows = self.items()
        return wanted if rows is None else missing_results(wanted, rows, self.key)

    def download(self, path: str) -> None:
        """One file with all results, numbered `ordinal` in key order; for as many as a benchmark has."""
        from pyspark.sql import Window

        rows = self.items().withColumn("ordinal", F.row_number().over(Window.orderBy(*self.key)))
        rows.coalesce(1).write.mode("errorifexists").parquet(path)


def export_files(images: DataFrame, path: str, data_col: str = "data", class_col: str | None = None) -> int:
    """Write each image's bytes to <id>.jpg under path, by class if asked, through Hadoop's file system (S20); returns how many.

    Files are made on the driver, an image at a time: this is for the classes someone wants to look at."""
    fs = FileSystem(images.sparkSession, path)
    n = 0
    for r in images.toLocalIterator():
        folder = f"{path}/{r[class_col]}" if class_col else path
        fs.write(f"{folder}/{r['image_id']}.jpg", bytes(r[data_col]))
        n += 1
    return n


def save_result(df: DataFrame, path: str) -> None:
    """A result of exactly one row (S25); ValueError otherwise."""
    if len(df.take(2)) != 1:
        raise ValueError("a result holds exactly one row")
    df.coalesce(1).write.mode("errorifexists").parquet(path)


def load_result(spark: SparkSession, path: str) -> T.Row:
    rows = spark.read.parquet(path).take(2)
    if len(rows) != 1:
        raise ValueError(f"{path} holds no single result")
    return rows[0]


def save_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables."""
    vertices.write.parquet(f"{path}/vertices")
    edges.write.parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def read_ascii_features(spark: SparkSession, path: str) -> DataFrame:
    """Features from text files, one per line: x y radius and the descriptor's numbers, by white space.

    Lines of under four numbers (headers) are left out."""
    fields = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.transform(fields, lambda x: x.try_cast("double")).alias("v"))
    rows = rows.filter((F.size("v") > 3) & ~F.exists("v", lambda x: x.isNull()))
    return rows.select("file", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.col("v")[2].alias("radius"), F.slice("v", 4, 1 << 20).alias("descriptor"))


def svg_matches(matches: list[tuple[float, float, float, float]], width: int, height: int) -> str:
    """Correspondences between two images side by side, as SVG."""
    lines = "".join(f'<line x1="{a}" y1="{b}" x2="{c + width}" y2="{d}" stroke="red"/>' for a, b, c, d in matches)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{2 * width}" height="{height}">{lines}</svg>'


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines for a viewer."""
    df.write.json(path)


def latex_table(rows: list[T.Row], columns: list[str]) -> str:
    """A report table's LaTeX (S31); the caller bounds the rows."""
    head = " & ".join(columns) + r" \\ \hline"
    body = "\n".join(" & ".join(str(r[c]) for c in columns) + r" \\" for r in rows)
    return "\\begin{tabular}{" + "l" * len(columns) + "}\n" + head + "\n" + body + "\n\\end{tabular}"


def table_summary(df: DataFrame) -> str:
    """Schema and metadata as JSON, for provenance."""
    return json.dumps([{"name": f.name, "type": f.dataType.simpleString(), "metadata": f.metadata} for f in df.schema])
