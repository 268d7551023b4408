"""Session helpers: building a session, reading tables, and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "quillstone", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine is written for (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):  # one JVM holds all
            builder = builder.config("spark.driver.memory", os.environ.get("QUILLSTONE_LOCAL_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless their Python path or working folder has it already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    reached = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if root in reached or context.applicationId in _shipped:
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='quillstone-')}/quillstone", "zip", root, "quillstone")
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


_shipped: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, in local mode only: a cluster
    without a shared folder is an error, since a lost machine would take its files along.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(configured)
        whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
        # one slash after a local scheme is Hadoop's way, three are everyone's
        return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = os.environ.get("QUILLSTONE_LOCAL_DIR") or tempfile.mkdtemp(prefix="quillstone-")
    os.environ["QUILLSTONE_LOCAL_DIR"] = made
    return f"file://{made}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder: cuts lineage, survives lost executors."""
    ship(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a table that a later step reads."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    ship(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most ``most`` bytes to Python workers in what runs within the block."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(most, int(before)) if before.isdigit() else most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: bytes of text that a Python worker takes from an Arrow batch at a time
SLICE = 1 << 20


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of a column of texts, ``most`` bytes at a time; a longer row comes alone."""
    ends = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64))
    first = 0
    while first < len(column):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield first, column.slice(first, last - first)
        first = last


#: logical nodes that neither add rows to a scan nor merge them
_ROWWISE = {"Project", "Filter", "LogicalRelation", "SubqueryAlias", "View"}
#: files up to this number are told apart within a row's expression; more by a broadcast join, up to the second number
_FEW_FILES, _BROADCAST_FILES = 64, 200_000


def _nodes(plan) -> list[str]:
    names, children = [plan.nodeName().split(" ")[0]], plan.children()
    for i in range(children.size()):
        names += _nodes(children.apply(i))
    return names


def _plain_path(path: Column) -> Column:
    """A file's address with one slash after the scheme: Spark writes both one and three."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def numbered(df: DataFrame) -> DataFrame:
    """``doc`` (the row as it came, a struct) and ``row``, a number that stays with a row.

    The number is made of the file's place among the sorted files and the row's place in the file. Both are facts about the data, so they
    do not change with the splits of a scan, the columns read, or the executors alive, as ``monotonically_increasing_id`` does. What is not
    a plain scan of Parquet files is written to the shared folder first.
    """
    ship(df.sparkSession)
    plan = df._jdf.queryExecution().optimizedPlan()
    names = _nodes(plan)
    if not set(names) <= _ROWWISE or names.count("LogicalRelation") != 1 or not plan.deterministic():
        df = written(df, "numbered")
    try:
        return _by_file(df)
    except AnalysisException:  # another format, or a projection that hides the files
        return _by_file(written(df, "numbered"))


def _by_file(df: DataFrame) -> DataFrame:
    where = df.metadataColumn("_metadata")
    place = where["row_index"].cast("long")
    at = lambda file: F.shiftleft(file.cast("long"), 40) + place
    files = sorted({re.sub("^([A-Za-z0-9+.-]+):/+", r"\1:/", f) for f in df.inputFiles()})
    doc = F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("doc")
    if len(files) <= 1:
        return df.select(doc, place.alias("row"))
    if len(files) <= _FEW_FILES:
        return df.select(doc, at(F.array_position(F.array(*map(F.lit, files)), _plain_path(where["file_path"]))).alias("row"))
    known = df.sparkSession.createDataFrame(list(enumerate(files)), "_n long, _file string")
    rows = df.select(doc, place.alias("_place"), _plain_path(where["file_path"]).alias("_path"))
    joined = rows.join(F.broadcast(known) if len(files) <= _BROADCAST_FILES else known, F.col("_path") == F.col("_file"), "left")
    number = F.coalesce("_n", F.raise_error(F.concat(F.lit("not among the files of the scan: "), "_path")).cast("long"))
    return joined.select("doc", (F.shiftleft(number, 40) + F.col("_place")).alias("row"))
