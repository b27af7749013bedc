"""Readers and writers: text tables, truth files, points, state tables, result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

POINTS = "unit long, cycle long, repeat int, fold int, seed int, rul_true double, pred double, subpop int"


def write_text(df: DataFrame, folder: str, split: str) -> None:
    """Rows as lines of numbers with a trailing blank, in files below <split>_<dataset>.txt."""
    values = [c for c in df.columns if c != "dataset"]
    for (dataset,) in df.select("dataset").distinct().collect():  # a handful of fleets
        df.where(F.col("dataset") == dataset).select(F.concat(F.concat_ws(" ", *[F.col(c).cast("string") for c in values]), F.lit(" "))).write.text(f"{folder}/{split}_{dataset}.txt")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_datasets(spark: SparkSession, folder: str, names: list[str], columns: list[str], known: list[str], splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """The files of the named datasets alone. A name that isn't known, or a file that isn't there, is an error before anything is read."""
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise ValueError(f"unknown datasets {unknown}; known are {sorted(known)}")
    paths = [f"{folder}/{split}_{name}.txt" for name in dict.fromkeys(names) for split in splits]
    for path in paths:
        if not exists(spark, path):
            raise FileNotFoundError(f"no file {path}")
    return read_text(spark, paths, columns)


def read_text(spark: SparkSession, where: str | list[str], columns: list[str]) -> DataFrame:
    """All files of a folder, or those listed; split and dataset from the path; a line with another number of values becomes nulls."""
    lines = spark.read.text(f"{where}/*_*.txt" if isinstance(where, str) else where).select("value", F.col("_metadata.file_path").alias("p"))
    parts = F.split(F.trim("value"), r"\s+")
    names, kinds = ["unit", "cycle", *columns], ["long", "long", *["double"] * len(columns)]
    ok = F.size("parts") == len(names)
    rows = lines.select(F.regexp_extract("p", r"(train|test)_\w+\.txt", 1).alias("split"), F.regexp_extract("p", r"(?:train|test)_(\w+)\.txt", 1).alias("dataset"), parts.alias("parts"))
    return rows.select("dataset", "split", *[F.when(ok, F.get("parts", i)).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])


def read_truth(spark: SparkSession, folder: str) -> DataFrame:
    """(unit, rul): the value in line i of all files, in the order of their names, is unit i's.

    Rows of a text scan stand in the order of their file's blocks: each scan task numbers its own lines, and the lines of
    the blocks before it are added.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = written(spark.read.text(folder).select("value", place.alias("p"), F.monotonically_increasing_id().alias("i")).where("length(trim(value)) > 0"), "lines")
    counts = lines.groupBy("p").agg(F.count("*").alias("n")).collect()  # a row for each block of a file
    at, before = 0, []
    for r in sorted(counts, key=lambda r: (r.p.file, r.p.block)):
        before.append(((r.p.file, r.p.block), at))
        at += r.n
    known = F.broadcast(spark.createDataFrame(before, "p struct<file string, block long>, before long"))
    line = F.row_number().over(Window.partitionBy("p").orderBy("i"))  # one block's lines
    return lines.join(known, "p").select((F.col("before") + line).cast("long").alias("unit"), F.col("value").cast("long").alias("rul"))


def raw_names(columns: list[str]) -> dict[str, str]:
    """Short names to the names of raw tables."""
    return {"unit": "unit_id"} | {c: f"op_setting_{c[2:]}" if c.startswith("op") else f"sensor_{c[1:]}" for c in columns}


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("dataset", "unit", "cycle", "rul", "rul_true")]


def write_points(points: DataFrame, folder: str, candidate: str) -> None:
    points.withColumn("candidate", F.lit(candidate)).write.partitionBy("dataset", "candidate").mode("append").parquet(folder)


def read_points(spark: SparkSession, folder: str, candidate: str) -> DataFrame:
    return spark.read.parquet(folder).where(F.col("candidate") == candidate)


def read_points_csv(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(POINTS).csv(folder, header=True)


def wide(df: DataFrame, key: str, name: str, values: list[str], value: str = "estimate") -> DataFrame:
    """One column for each of the values of name."""
    return df.groupBy(key).pivot(name, values).agg(F.first(value))


def flatten_results(spark: SparkSession, folder: str) -> DataFrame:
    """(stage, metric, estimate, lo, hi, verdict) from documents with nested comparisons."""
    kind = "stage int, comparisons array<struct<metric:string,estimate:double,ci:struct<lo:double,hi:double>>>"
    rows = spark.read.schema(kind).json(folder).select("stage", F.explode("comparisons").alias("c")).select("stage", "c.metric", "c.estimate", "c.ci.lo", "c.ci.hi")
    return rows.withColumn("verdict", F.when(F.col("hi") < 0, "better").when(F.col("lo") > 0, "worse").otherwise("not different"))


def save_state(state: DataFrame, folder: str, version: int) -> None:
    state.withColumn("schema_version", F.lit(version)).write.parquet(folder)


def load_state(spark: SparkSession, folder: str, least: int) -> DataFrame:
    """The state; an older version is refused when rows are read."""
    state = spark.read.parquet(folder)
    seen = F.col("schema_version")
    return state.withColumn("schema_version", F.when(seen >= least, seen).otherwise(F.raise_error(F.lit("the state's schema version is too old")).cast("int")))


def latest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The lexically greatest version of each key."""
    return versions.groupBy(*keys).agg(F.max("version").alias("version"))
