"""What is written: metadata rows, SVG text, image files."""

from __future__ import annotations

import struct
import uuid
import zlib
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glyphmill.operators import naming
from glyphmill.plans.session import ship_package

c = F.col
VERSION = "1.0.0"


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return c(name) if name in df.columns else F.lit(None).cast(kind)


def metadata(icons: DataFrame, *, provider: str, naming: bool, model: str | None = None, source: Column | None = None) -> DataFrame:
    """Adds meta, one struct an icon with the fields of a metadata file. One export time a query."""
    from glyphmill.operators.naming import label_or_stem

    outputs = F.map_from_entries(F.array_sort(F.map_entries("outputs")))
    fields = {
        "stem": c("stem"),
        "label": label_or_stem(_or_null(icons, "label", "string"), c("stem")),
        "tags": F.coalesce(_or_null(icons, "tags", "array<string>"), F.array().cast("array<string>")),
        "semantic_confidence": _or_null(icons, "confidence", "double"),
        "group_id": F.format_string("group-%03d", c("icon_index")),
        "sheet_index": c("icon_index"),
        "source_file": source if source is not None else _or_null(icons, "source_file", "string"),
        "source_bounds": c("source_bounds"),
        "source_size": c("source_size"),
        "canvas_size": c("canvas_size"),
        "pipeline": F.lit("classical_cv" + (f" + {provider}_labeling" if naming else "")),
        "provider": F.lit(provider),
        "model_used": F.lit(model if naming else None).cast("string"),
        "formats": outputs,
        "canvas_mode": _or_null(icons, "canvas_mode", "string"),
        "dominant_color": _or_null(icons, "dominant_color", "string"),
        "palette": F.coalesce(_or_null(icons, "palette", "array<string>"), F.array().cast("array<string>")),
        "vector_mode": _or_null(icons, "vector_mode", "string"),
        "exported_at": F.current_timestamp(),
        "app_version": F.lit(VERSION),
    }
    return icons.withColumn("meta", F.struct(*[v.alias(k) for k, v in fields.items()]))


def write_metadata(rows: DataFrame, path: str, sheet: str = "sheet") -> None:
    """JSON lines, a folder for each sheet."""
    rows.select(sheet, "meta.*").write.partitionBy(sheet).mode("overwrite").json(path)


def svg_of_png(png: Column, width: int, height: int) -> Column:
    """A drawing that shows a PNG over the whole canvas."""
    uri = naming.data_uri(png, F.lit("x.png"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" version="1.1" width="{width}" height="{height}" viewBox="0 0 {width} {height}"><image width="{width}" height="{height}" href="'
    return F.concat(F.lit(head), uri, F.lit('"/></svg>'))


def svg_fragment(children: Column, width: Column, height: Column, style: Column) -> Column:
    """A drawing of its own from children that already carry their shift."""
    size = lambda v: v.cast("string")
    attr = F.when(style.isNotNull(), F.concat(F.lit(' style="'), style, F.lit('"'))).otherwise("")
    return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), size(width), F.lit(" "), size(height), F.lit('"'), attr, F.lit(">"), F.array_join(children, ""), F.lit("</svg>"))


def shifted(xml: Column, dx: Column, dy: Column) -> Column:
    """An element with translate(dx dy) put before its transform."""
    move = F.concat(F.lit("translate("), dx.cast("string"), F.lit(" "), dy.cast("string"), F.lit(")"))
    had = F.regexp_like(xml, F.lit(r'^<[^>]*\stransform="'))
    return F.when(had, F.regexp_replace(xml, F.lit(r'^(<[^>]*\stransform=")'), F.concat(F.lit("$1"), move, F.lit(" ")))).otherwise(F.regexp_replace(xml, F.lit(r"^(<[A-Za-z:]+)"), F.concat(F.lit('$1 transform="'), move, F.lit('"'))))


def with_metadata(svg: Column, payload: Column) -> Column:
    """The drawing with one metadata element, the first child of its root, in place of metadata that the root had; metadata
    deeper in the drawing stays, and text that is no drawing stays as it is."""
    if session := SparkSession.getActiveSession():
        ship_package(session)
    return _with_metadata(svg, payload)


@F.pandas_udf(StringType())
def _with_metadata(svg: pd.Series, payload: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else put_metadata(x, y or "") for x, y in zip(svg, payload, strict=True)], dtype=object)


def put_metadata(svg: str, payload: str) -> str:
    try:
        root = ElementTree.fromstring(svg)
    except ElementTree.ParseError:
        return svg
    for child in [x for x in root if isinstance(x.tag, str) and x.tag.endswith("metadata")]:
        root.remove(child)
    space = root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""
    new = ElementTree.Element(f"{space}metadata")
    new.text = payload
    root.insert(0, new)
    ElementTree.register_namespace("", space[1:-1] or "http://www.w3.org/2000/svg")
    return ElementTree.tostring(root, encoding="unicode")


def svg_canvas(children: Column, defs: Column, transform: Column, width: int, height: int) -> Column:
    """A drawing of the canvas's size: the definitions, then the icon's elements in one group with its transform."""
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">'
    hoisted = F.when(F.size(defs) > 0, F.concat(F.lit("<defs>"), F.array_join(defs, ""), F.lit("</defs>"))).otherwise("")
    return F.concat(F.lit(head), hoisted, F.lit('<g transform="'), transform, F.lit('">'), F.array_join(children, ""), F.lit("</g></svg>"))


def folder(sheet: Column) -> Column:
    """A sheet's folder: its file name, with a digest of its whole path, as sheets of one name may lie in different folders."""
    return F.concat(F.regexp_extract(sheet, r"([^/]*?)(?:\.[^./]*)?/?$", 1), F.lit("-"), F.substring(F.md5(sheet), 1, 8))


def write_pictures(icons: DataFrame, path: str, kinds: list[str]) -> DataFrame:
    """Writes each icon's picture as path/<sheet>/<kind>/<stem>.<kind> (png, tiff) and gives a row for each file; the files are written
    when the rows are asked for. ``path`` is any file system that pyarrow knows and all executors see. A file
    appears whole under its name, and a task that runs again writes the same file again."""
    ship_package(icons.sparkSession)
    rows = icons.select(folder(c("sheet_id")).alias("folder"), "stem", "png")

    def run(stream):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for batch in stream:
            files = []
            for under, stem, png in zip(batch["folder"], batch["stem"], batch["png"], strict=True):
                for kind in kinds:
                    place = f"{top}/{under}/{kind}"
                    store.create_dir(place, recursive=True)
                    data = png if kind == "png" else tiff_bytes(png_pixels(png))
                    draft = f"{place}/.{stem}.{uuid.uuid4().hex}"
                    with store.open_output_stream(draft) as out:
                        out.write(data)
                    store.move(draft, f"{place}/{stem}.{kind}")
                    files.append((f"{place}/{stem}.{kind}", len(data)))
            yield pd.DataFrame(files, columns=["file", "n_bytes"])

    return rows.mapInPandas(run, "file string, n_bytes long")


def png_pixels(data: bytes) -> np.ndarray:
    """Pixels of a file of ``png_bytes``: eight bits, no filters, not interlaced."""
    width, height, _, kind = struct.unpack(">IIBB", data[16:26])
    at, packed = 8, b""
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += size + 12
    depth = {0: 1, 2: 3, 6: 4}[kind]
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width * depth + 1)[:, 1:].reshape(height, width, depth)


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG file of uint8 pixels, gray, RGB or RGBA by the last dimension."""
    height, width = pixels.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if pixels.ndim == 2 else pixels.shape[2]]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def tiff_bytes(pixels: np.ndarray) -> bytes:
    """An uncompressed TIFF file of uint8 RGB or RGBA pixels."""
    height, width, depth = pixels.shape
    data = pixels.tobytes()
    extra = 8 + 2 * depth
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, depth, 8), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, extra), (277, 3, 1, depth), (278, 4, 1, height), (279, 4, 1, len(data))]
    if depth == 4:
        entries.append((338, 3, 1, 2))
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", v, 0) if k == 3 and n == 1 else struct.pack("<I", v)) for t, k, n, v in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", extra + len(data) + len(data) % 2) + struct.pack(f"<{depth}H", *[8] * depth) + data + b"\0" * (len(data) % 2) + directory
