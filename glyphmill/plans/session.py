"""Gets this package to the workers of a session, and tables to the folder that its machines share."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package's sources to the workers, once an application, as --py-files would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    archive.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a
    folder of its own; a cluster has none that every machine sees, so it must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder. It goes when the application ends, or with ``release``."""
    spark = df.sparkSession
    ship_package(spark)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    store, place = _folder(spark, path)
    store.deleteOnExit(place)
    # a file's fields may all be null, whatever the plan knew of them
    kind = re.sub(r'("(?:nullable|containsNull|valueContainsNull)":)false', r"\1true", df.schema.json())
    out = spark.read.schema(StructType.fromJson(json.loads(kind))).parquet(path)
    out._written_to = path
    return out


#: Rows of a table that is broadcast, at most.
FEW_ROWS = 20_000


def sized(table: DataFrame) -> DataFrame:
    """A table as one side of a join: broadcast if it has ``FEW_ROWS`` rows at most, else merged. They are counted, as Spark goes by the size
    of files, which are much smaller than their rows, and takes a row that gives many for one."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table.hint("merge")


def streamed(rows: DataFrame, write, what: str) -> DataFrame:
    """What is there now of a stream, by ``write(rows, path, checkpoint)``, as a table in the shared folder like those of ``written``."""
    spark = rows.sparkSession
    top = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    store, place = _folder(spark, top)
    store.deleteOnExit(place)
    write(rows, f"{top}/rows", f"{top}/marks").awaitTermination()
    out = spark.read.schema(rows.schema).parquet(f"{top}/rows")
    out._written_to = top
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no plan reads any more."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            store, place = _folder(df.sparkSession, path)
            store.delete(place, True)
