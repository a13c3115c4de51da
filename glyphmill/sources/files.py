"""A sink for rows that are files each: ``df.write.format("files")``, with attempts staged by task and committed by the job."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from glyphmill.plans.session import ship_package
from glyphmill.sources.sinks import folder, png_pixels, tiff_bytes

c = F.col
#: Files that the driver moves at once.
MOVES = 16
#: Seconds without a trace of a failed job's tasks after which they count as ended (Spark lets a killed task's Python run on for two), and seconds to wait at most.
QUIET, PATIENCE = 3.0, 60.0


@dataclass
class Attempt(WriterCommitMessage):
    """The folder of a task's attempt. Files aren't listed here, so what the driver gets doesn't grow with them."""

    name: str
    files: int


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class FileWriter(DataSourceArrowWriter):
    """Each attempt writes to a folder of its own under the job's. The job's commit moves what the successful attempts wrote to its
    place and drops the rest; its abort drops all. So a task that fails or runs twice leaves neither halves nor doubles."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        store, top = _store(self.path)
        name, n, made = uuid.uuid4().hex, 0, set()
        for batch in iterator:
            for file, data in zip(batch.column("file"), batch.column("data"), strict=True):
                parts = (file.as_py() or "").split("/")
                if not all(parts) or any(p in (".", "..") for p in parts) or parts[0].startswith("_staged-"):
                    raise ValueError(f"no name for a file under {self.path}: {file.as_py()!r}")
                place = "/".join([top, self.job, name, *parts])
                under = place.rsplit("/", 1)[0]
                if under not in made:
                    store.create_dir(under, recursive=True)
                    made.add(under)
                with store.open_output_stream(place) as out:
                    out.write(data.as_py() or b"")
                n += 1
        return Attempt(name, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        store, top = _store(self.path)
        store.create_dir(top, recursive=True)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(top)):
                if info.base_name != self.job:
                    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
        with ThreadPoolExecutor(MOVES) as pool:
            for message in messages:
                if message is None or not message.files:
                    continue
                base = f"{top}/{self.job}/{message.name}"
                infos = store.get_file_info(fs.FileSelector(base, recursive=True))
                for info in infos:
                    if info.type == fs.FileType.Directory:
                        store.create_dir(top + info.path[len(base) :], recursive=True)
                files = [i.path for i in infos if i.type == fs.FileType.File]
                list(pool.map(lambda f: self._move(store, f, top + f[len(base) :]), files))
        self._drop(store, top)

    @staticmethod
    def _move(store, source: str, place: str) -> None:
        try:
            store.move(source, place)
        except OSError:  # stores that don't replace a file by a move
            store.delete_file(place)
            store.move(source, place)

    def _drop(self, store, top: str) -> bool:
        """Whether there was anything to drop."""
        from pyarrow import fs

        there = store.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory
        if there:
            store.delete_dir(f"{top}/{self.job}")
        return there

    def abort(self, messages: list[Attempt | None]) -> None:
        """Tasks that run as the job fails are killed, but may write on for a while: what they put back goes, too."""
        store, top = _store(self.path)
        began = last = time.monotonic()
        while (now := time.monotonic()) < min(last + QUIET, began + PATIENCE):
            try:
                if self._drop(store, top):
                    last = now
            except OSError:  # written to while it was deleted
                last = now
            time.sleep(0.1)


class Files(DataSource):
    """Rows of ``file`` (a path below the sink's) and ``data``; further columns aren't written. Of rows with one file name, one is kept.
    The mode ``append`` leaves files of other names alone, ``overwrite`` leaves no others."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        missing = {"file", "data"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"the files sink needs the columns {sorted(missing)}")
        return FileWriter(self.options["path"], overwrite)


def save(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Writes file, data. ``path`` is any file system that pyarrow knows and all executors see."""
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(Files)
    rows.select("file", c("data").cast("binary").alias("data")).write.format("files").mode(mode).save(path)


def picture_files(icons: DataFrame, kinds: list[str]) -> DataFrame:
    """file, data of each icon's bitmap in each kind (png, tiff), under <sheet>/<kind>/<stem>.<kind>; an icon without a bitmap has none."""
    ship_package(icons.sparkSession)
    kind = F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind")
    rows = icons.where("png is not null").select(folder(c("sheet_id")).alias("folder"), "stem", "png", kind)

    def run(stream):
        for batch in stream:
            data = [tiff_bytes(png_pixels(p)) if k == "tiff" else p for p, k in zip(batch["png"], batch["kind"], strict=True)]
            yield pd.DataFrame({"file": batch["folder"] + "/" + batch["kind"] + "/" + batch["stem"] + "." + batch["kind"], "data": data})

    return rows.mapInPandas(run, "file string, data binary")


def text_files(icons: DataFrame, text: Column, kind: str) -> DataFrame:
    """file, data of a text of each icon, its drawing (svg) or its metadata (json), named as bitmaps are; a null text has no file."""
    name = F.concat(folder(c("sheet_id")), F.lit(f"/{kind}/"), c("stem"), F.lit(f".{kind}"))
    return icons.select(name.alias("file"), F.encode(text, "UTF-8").alias("data")).where("data is not null")
