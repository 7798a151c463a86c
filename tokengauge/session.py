"""Session helpers: shared storage for intermediates, and small tables of known size."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Setting: tasks over which texts are spread; unset, the scan splits stay.
TEXT_PARTITIONS = "spark.tokengauge.text.partitions"

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(app: str = "tokengauge", cpus: str | int = "*") -> SparkSession:
    """A single-machine session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config(TEXT_PARTITIONS, str(os.cpu_count() if cpus == "*" else cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only a plain local master, one process, may fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tokengauge-")
    return _local_roots[app]


def shared_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{checkpoint_root(spark)}/tokengauge/{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    Unlike a local checkpoint this survives the loss of any executor, and the
    Parquet copy keeps column pruning for the passes that follow.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A table of driver rows as a local relation, whose exact size the optimizer knows.

    (From a list of rows Spark would make an RDD of unknown size, which is never broadcast.)
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def inline(df: DataFrame) -> DataFrame:
    """Compute a table whose size is bounded by the model grid, as a local relation."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a text table over ``spark.tokengauge.text.partitions`` tasks before per-row text work.

    A Parquet file with one row group is one task however many cores there are; a
    session that reads such files sets the number (``local_session`` does). Where it
    is unset, as on a cluster that reads many files, the scan splits stay and no text is
    shuffled. Results do not depend on it.
    """
    parts = df.sparkSession.conf.get(TEXT_PARTITIONS, None)
    return df if parts is None or df.isStreaming else df.repartition(int(parts), *keys)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application).

    Needed where the session was started without ``--py-files``.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tokengauge-py-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
