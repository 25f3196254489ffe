"""Charts, page archives, thread lists and XML tags as data sources: ``spark.read.format("chart_oxs")`` and its like.

After ``register(spark)`` the formats are ``chart_oxs``, ``chart_json``, ``chart_png``, ``chart_pages``, ``thread_list`` and
``xml_tags`` (the last is read only).  A path is a folder; each file in it is one chart, list or archive, named by the column
``file`` without its ending.

Reading: the files of a folder are dealt into partitions of ``partitionBytes`` (32 MB) of files.  The option ``files`` chooses files
by patterns of their names (``12*|77``) before any is opened, ``part`` what is read of them (``PARTS``), and a schema given by the
reader chooses columns; pixels of others are not unpacked.  A file is never split, a row of XML is parsed as it streams by, and what a
broken file holds is told by ``part=problem`` or ``part=report`` instead of an error.

``pushFilters`` is left out on purpose: Spark 4.1.2 keeps a reader that took filters for later queries of the same DataFrame, which
then miss rows wherever they have no filter to push themselves (measured: ``read.count()`` gave a third after ``read.where(...)``).

Writing: rows come sorted by file and line (``lines``, ``page_lines`` and ``saved`` see to it), so a task holds one line at a time.
Tasks write into a folder of the job's own; the commit moves the files of the attempts that succeeded to their names, the abort
removes the folder.  A file whose lines are missing, doubled or out of order fails the job.

Paths are opened by pyarrow's file systems: local or mounted folders, object stores, and HDFS where its client library is there.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any
from xml.parsers import expat
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomgrid.functions import scalars
from loomgrid.operators import grid
from loomgrid.sources import charts, images

CHUNK = 1 << 16
PARTITION_BYTES = 32 << 20
PARTITION_FILES = 1024
MAX_JSON = 256 << 20
BLOCK = 1 << 16
Block = dict[str, Any]


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if ":/" in path:
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


# ---------------------------------------------------------------- XML, tag by tag


class BadXml(ValueError):
    """The text is no well-formed XML, or declares a document type."""


def tags(source, names: frozenset[str]) -> Iterator[list[tuple[str, dict[str, str]]]]:
    """The elements of these names with their attributes, in blocks as the text streams by; it is never held whole."""
    found: list[tuple[str, dict[str, str]]] = []

    def begin(name: str, attributes: dict[str, str]) -> None:
        if name in names:
            found.append((name, attributes))

    def refuse(*_: object) -> None:
        raise BadXml("a document type is declared")

    parser = expat.ParserCreate()
    parser.StartElementHandler = begin
    parser.StartDoctypeDeclHandler = refuse
    try:
        while chunk := source.read(CHUNK):
            parser.Parse(chunk, False)
            if found:
                yield found[:]
                found.clear()
        parser.Parse(b"", True)
    except expat.ExpatError as problem:
        raise BadXml(str(problem)) from problem


def _whole(text: str) -> int | None:
    return int(text) if re.fullmatch(r"\s*[0-9]{1,6}\s*", text) else None


@dataclass
class _OxsHead:
    """What the first pass over a file tells: sizes, palette and counts; or what is wrong with it."""

    w: int | None = None
    h: int | None = None
    items: list[tuple[int | None, str, str, str, bool | None]] = field(default_factory=list)
    parts: int = 0
    marks: int = 0
    problem: str | None = None

    @property
    def cloth(self) -> set[int | None]:
        return {idx for idx, *_, cloth in self.items if cloth}


def _oxs_head(source) -> _OxsHead:
    head, sized = _OxsHead(), False
    try:
        for block in tags(source, frozenset(("properties", "palette_item", "stitch", "partstitch"))):
            for name, a in block:
                if name == "stitch":
                    head.marks += a.get("marked", "").startswith("true")
                elif name == "partstitch":
                    head.parts += 1
                elif name == "palette_item":
                    idx, number = _whole(a.get("index", "")), a.get("number", "").strip(" ")
                    cloth = True if idx == 0 or number.lower() == "cloth" else None if idx is None else False
                    head.items.append((idx, number, a.get("name", "").strip(" "), a.get("color", "").upper(), cloth))
                elif not sized:
                    head.w, head.h, sized = _whole(a.get("chartwidth", "")), _whole(a.get("chartheight", "")), True
    except BadXml:
        head.problem = "not-well-formed"
    return head


def _oxs_cells(source, head: _OxsHead, left: dict[str, int]) -> Iterator[Block]:
    """Blocks of cells, the first stitch of a place ruling; ``left`` counts by kind what is not taken."""
    taken: dict[int, int] = {}  # by line, a bit for each place that is filled
    cloth = head.cloth
    for block in tags(source, frozenset(("stitch",))):
        ys, xs, labels = [], [], []
        for _, a in block:
            x, y, label = (_whole(a.get(n, "")) for n in ("x", "y", "palindex"))
            if x is None or y is None or label is None:
                kind = "unreadable"
            elif (head.w is not None and x >= head.w) or (head.h is not None and y >= head.h):
                kind = "out-of-grid"
            elif label in cloth:
                kind = "cloth"
            elif taken.get(y, 0) >> x & 1:
                kind = "duplicate"
            else:
                taken[y] = taken.get(y, 0) | 1 << x
                ys.append(y), xs.append(x), labels.append(label)
                continue
            left[kind] = left.get(kind, 0) + 1
        if ys:
            yield {"y": ys, "x": xs, "label": labels}


def read_oxs(opened: Callable, part: str, wanted: set[str]) -> Iterator[Block]:
    """Two passes: the first finds whether the text is whole, and its palette; the second streams the stitches, where they are asked for."""
    with opened() as source:
        head = _oxs_head(source)
    if part == "palette" and not head.problem:
        yield dict(zip(("idx", "number", "name", "hex", "cloth"), zip(*head.items, strict=True), strict=True)) if head.items else {}
    if part == "cells" and not head.problem:
        with opened() as source:
            yield from _oxs_cells(source, head, {})
    if part == "report":
        left = {"not-well-formed": 1} if head.problem else {"part-stitches": head.parts, "completion-marks": head.marks}
        if not head.problem:
            with opened() as source:
                for _ in _oxs_cells(source, head, left):
                    pass
        left = {k: n for k, n in left.items() if n}
        yield {"kind": list(left), "n": list(left.values())} if left else {}


def read_tags(opened: Callable, row_tag: str, wanted: set[str]) -> Iterator[Block]:
    """(nth, attributes) of each element of the row tag, up to where the text breaks, if it does; then a row with ``problem`` alone."""
    nth = 0
    with opened() as source:
        try:
            for block in tags(source, frozenset((row_tag,))):
                yield {"nth": list(range(nth, nth + len(block))), "attributes": [list(a.items()) for _, a in block], "problem": [None] * len(block)}
                nth += len(block)
        except BadXml as problem:
            yield {"nth": [None], "attributes": [None], "problem": [str(problem)]}


# ---------------------------------------------------------------- charts as JSON


def _int(value: object) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def json_problem(chart: object) -> str | None:
    """The first rule that a chart breaks, by the names that ``charts.read_json`` gives."""
    c = chart if isinstance(chart, dict) else {}
    cells, palette = c.get("cellPalette"), c.get("palette")
    cells = cells if isinstance(cells, list) else None
    palette = palette if isinstance(palette, list) else []
    w, h, version = _int(c.get("width")), _int(c.get("height")), _int(c.get("formatVersion"))
    if not c or (cells is None and w is None):
        return "not-a-chart"
    if (1 if version is None else version) > charts.VERSION:
        return "newer-version"
    if any(side is None or not 1 <= side <= charts.LONGEST_SIDE for side in (w, h)):
        return "size"
    if cells is None or len(cells) != w * h:
        return "cell-count"
    if len(palette) > 100:
        return "too-many-colours"
    if any(_int(v) is None or v < 0 or (v != charts.EMPTY and v >= len(palette)) for v in cells):
        return "label-out-of-palette"
    colours = [p.get("rgb") if isinstance(p, dict) else None for p in palette]
    if any(not isinstance(rgb, list) or len(rgb) != 3 or any(_int(v) is None or not 0 <= v <= 255 for v in rgb) for rgb in colours):
        return "colour"
    return None


def read_json(opened: Callable, part: str, wanted: set[str]) -> Iterator[Block]:
    """A chart's cells, palette or problem; a chart that breaks a rule has no cells and no palette.  Files over 256 MB are a problem of size."""
    with opened() as source:
        text = source.read(MAX_JSON + 1)
    try:
        chart = json.loads(text) if len(text) <= MAX_JSON else None
    except ValueError:
        chart = None
    problem = "size" if len(text) > MAX_JSON else json_problem(chart)
    if part == "problem":
        yield {"problem": [problem]}
    elif not problem and part == "palette":
        p = chart.get("palette") or []
        yield {"idx": list(range(len(p))), **{c: [e["rgb"][i] for e in p] for i, c in enumerate("rgb")}, **{k: [e.get(k) for e in p] for k in ("symbol", "name")}} if p else {}
    elif not problem:
        label, w = np.array(chart["cellPalette"], np.int32), chart["width"]
        for at in range(0, len(label), BLOCK):
            here = np.arange(at, min(at + BLOCK, len(label)), dtype=np.int32)
            yield {"y": here // w, "x": here % w, "label": pa.array(label[here], mask=label[here] == charts.EMPTY)}


# ---------------------------------------------------------------- pictures and archives of them


def _pixels(rgba: np.ndarray, wanted: set[str]) -> Iterator[Block]:
    """Blocks of whole rows with the wanted columns, and with the line, whose length is theirs."""
    h, w = rgba.shape[:2]
    step = max(1, BLOCK // w)
    for top in range(0, h, step):
        rows = rgba[top : top + step]
        n = len(rows) * w
        block = {"y": np.repeat(np.arange(top, top + len(rows), dtype=np.int32), w)}
        block |= {name: np.full(n, v, np.int32) for name, v in (("width", w), ("height", h)) if name in wanted}
        block |= {"x": np.tile(np.arange(w, dtype=np.int32), len(rows))} if "x" in wanted else {}
        yield block | {c: rows[..., i].ravel().astype(np.int32) for i, c in enumerate("rgba") if c in wanted}


def read_png(opened: Callable, part: str, wanted: set[str]) -> Iterator[Block]:
    """Pixels, or ``part=size``, which reads the header's bytes alone.  A file that is no picture has no pixels and null sizes."""
    with opened() as source:
        head = source.read(24)
        known = len(head) == 24 and head[:8] == images.PNG_MAGIC and head[12:16] == b"IHDR"
        if part == "size":
            w, h = struct.unpack(">II", head[16:]) if known else (None, None)
            yield {"width": [w], "height": [h]}
        elif known:
            yield from _pixels(images.decode_png(head + source.read()), wanted)


def read_pages(opened: Callable, part: str, wanted: set[str]) -> Iterator[Block]:
    """Of each archive the names and sizes of its files, its page map, its table of threads, or the pixels of its pages, a page at a time."""
    with opened() as source, zipfile.ZipFile(source) as archive:
        entries = archive.infolist()
        if part == "entries":
            yield {"name": [e.filename for e in entries], "bytes": [e.file_size for e in entries]}
        elif part == "pixels":
            for e in entries:
                if e.filename.endswith(".png"):
                    for block in _pixels(images.decode_png(archive.read(e)), wanted):
                        yield {"name": [e.filename] * len(block["y"]), **block}
        else:
            rows = [line.split("\t") for line in archive.read(f"{part}.tsv").decode().split("\n")[1:] if line]
            names = list(PARTS["chart_pages"][part])
            columns = zip(*rows, strict=True) if rows else ([] for _ in names)
            yield {n: [int(v) for v in c] if PARTS["chart_pages"][part][n] != "string" else list(c) for n, c in zip(names, columns, strict=True)}


def read_threads(opened: Callable, part: str, wanted: set[str]) -> Iterator[Block]:
    """The threads of a list in CSV or JSON, or one row with what is wrong with it."""
    with opened() as source:
        rows, error = charts.read_thread_list(source.read().decode("utf-8", "replace"))
    if error:
        yield {"ord": [None], "code": [None], "name": [None], "hex": [None], "error": [error]}
    elif rows:
        code, name, colour = zip(*rows, strict=True)
        yield {"ord": list(range(len(rows))), "code": code, "name": name, "hex": colour, "error": [None] * len(rows)}


_CELLS = {"y": "int", "x": "int", "label": "int"}
_RGBA = {"width": "int", "height": "int", "y": "int", "x": "int", "r": "int", "g": "int", "b": "int", "a": "int"}
#: By format its parts and their columns; the first part is the one read where none is named.
PARTS: dict[str, dict[str, dict[str, str]]] = {
    "chart_oxs": {"cells": _CELLS, "palette": {"idx": "int", "number": "string", "name": "string", "hex": "string", "cloth": "boolean"}, "report": {"kind": "string", "n": "long"}},
    "chart_json": {"cells": _CELLS, "palette": {"idx": "int", "r": "int", "g": "int", "b": "int", "symbol": "string", "name": "string"}, "problem": {"problem": "string"}},
    "chart_png": {"pixels": _RGBA, "size": {"width": "long", "height": "long"}},
    "chart_pages": {
        "entries": {"name": "string", "bytes": "long"}, "pixels": {"name": "string", **_RGBA}, "pages": {"name": "string", "left": "int", "top": "int", "width": "int", "height": "int"},
        "threads": {"idx": "int", "hex": "string", "stitches": "long"},
    },
    "thread_list": {"threads": {"ord": "int", "code": "string", "name": "string", "hex": "string", "error": "string"}},
    "xml_tags": {"tags": {"nth": "long", "attributes": "map<string,string>", "problem": "string"}},
}
ENDINGS = {"chart_oxs": ".oxs", "chart_json": ".json", "chart_png": ".png", "chart_pages": ".zip", "thread_list": ".csv", "xml_tags": ""}
READERS = {"chart_oxs": read_oxs, "chart_json": read_json, "chart_png": read_png, "chart_pages": read_pages, "thread_list": read_threads, "xml_tags": read_tags}


# ---------------------------------------------------------------- reading


@dataclass
class Files(InputPartition):
    paths: list[str]


class FileReader(DataSourceReader):
    """Reads one part of a format; see the module for what it prunes."""

    def __init__(self, kind: str, options: dict[str, str], schema: StructType):
        self.kind, self.schema = kind, schema
        self.path = options["path"]
        self.part = options.get("part", next(iter(PARTS[kind])))
        self.row_tag = options.get("rowTag", "row")
        self.limit = int(options.get("partitionBytes", PARTITION_BYTES))
        self.ending = options.get("ending", ENDINGS[kind])
        known = {"file": "string", **PARTS[kind][self.part]}
        strange = [n for n in schema.names if n not in known]
        if strange:
            raise ValueError(f"{kind} has no column {', '.join(strange)} in its part {self.part}")
        self.files = options.get("files", "*").split("|")

    def _name(self, path: str) -> str:
        name = path.rsplit("/", 1)[-1]
        return name[: len(name) - len(self.ending)]

    def partitions(self) -> list[Files]:
        system, path = place(self.path)
        found = [i for i in system.get_file_info(fs.FileSelector(path)) if i.is_file and i.base_name.endswith(self.ending) and not i.base_name.startswith(("_", "."))]
        found.sort(key=lambda i: i.path)
        found = [i for i in found if any(fnmatch.fnmatchcase(self._name(i.path), g) for g in self.files)]
        out, size = [Files([])], 0
        for i in found:
            if out[-1].paths and (size + i.size > self.limit or len(out[-1].paths) == PARTITION_FILES):
                out.append(Files([]))
                size = 0
            out[-1].paths.append(i.path)
            size += i.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system = place(self.path)[0]
        wanted, parse = set(self.schema.names), READERS[self.kind]
        types = to_arrow_schema(self.schema)
        for path in partition.paths:
            # random access only where an archive's directory needs it
            opened = (lambda p=path: system.open_input_file(p)) if self.kind == "chart_pages" else (lambda p=path: system.open_input_stream(p, compression=None))
            for block in parse(opened, self.row_tag if self.kind == "xml_tags" else self.part, wanted):
                if not block:
                    continue
                n = len(next(iter(block.values())))
                columns = [pa.array([self._name(path)] * n, f.type) if f.name == "file" else _array(block[f.name], f.type) for f in types]
                yield pa.RecordBatch.from_arrays(columns, schema=types)


def _array(values: Any, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


# ---------------------------------------------------------------- writing


class Picture:
    """A PNG written line by line into ``out``."""

    def __init__(self, out, w: int, h: int):
        self.out, self.deflate = out, zlib.compressobj()
        out.write(images.PNG_MAGIC + images._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)))

    def line(self, rgba: np.ndarray) -> None:
        if data := self.deflate.compress(b"\0" + rgba.tobytes()):
            self.out.write(images._chunk(b"IDAT", data))

    def end(self) -> None:
        self.out.write(images._chunk(b"IDAT", self.deflate.flush()) + images._chunk(b"IEND", b""))


def _table(palette: list[dict]) -> np.ndarray:
    """RGBA by label; what has no entry is clear."""
    table = np.zeros((charts.EMPTY + 1, 4), np.uint8)
    for p in palette:
        table[p["idx"]] = (p["r"], p["g"], p["b"], 255)
    return table


def _hex(p: dict) -> str:
    return f"{p['r']:02X}{p['g']:02X}{p['b']:02X}"


class Sink:
    """A file being written: its first row opens it, each row is a line of it, ``end`` closes it."""

    def __init__(self, out, row: dict):
        self.out, self.next, self.lines = out, 0, row.get("height")

    def put(self, text: str) -> None:
        self.out.write(text.encode())

    def check(self, row: dict) -> None:
        if row["y"] != self.next or len(row["labels"]) != row["width"]:
            raise ValueError(f"file {row['file']}: line {self.next} is missing, doubled or broken")
        self.next += 1

    def line(self, row: dict) -> None:
        raise NotImplementedError

    def end(self) -> None:
        if self.next != self.lines:
            raise ValueError(f"a file has {self.next} of its {self.lines} lines")


class JsonSink(Sink):
    def __init__(self, out, row: dict):
        super().__init__(out, row)
        entries = [{"rgb": [p["r"], p["g"], p["b"]], "symbol": p["symbol"], "name": p["name"]} for p in row["palette"] or []]
        head = {"formatVersion": charts.VERSION, "width": row["width"], "height": row["height"], "isLandscape": row["width"] >= row["height"], "palette": entries}
        self.put(json.dumps(head, ensure_ascii=False)[:-1] + ', "cellPalette": [')

    def line(self, row: dict) -> None:
        self.check(row)
        self.put((", " if row["y"] else "") + ", ".join(map(str, row["labels"])))

    def end(self) -> None:
        super().end()
        self.put("]}")


class OxsSink(Sink):
    def __init__(self, out, row: dict):
        super().__init__(out, row)
        quoted = {'"': "&quot;", "\t": "&#9;", "\n": "&#10;", "\r": "&#13;"}
        palette = row["palette"] or []
        self.put(f'<?xml version="1.0" encoding="UTF-8"?>\n<chart>\n<properties oxs="1.0" oxsversion="1.0" software="loomgrid" chartwidth="{row["width"]}" chartheight="{row["height"]}" palettecount="{len(palette)}"/>\n<palette>\n')
        self.put('<palette_item index="0" number="cloth" name="cloth" color="FFFFFF"/>\n')
        for p in palette:
            self.put(f'<palette_item index="{p["idx"] + 1}" number="" name="{escape(p["name"] or "", quoted)}" color="{_hex(p)}" symbol="{escape(p["symbol"] or "", quoted)}"/>\n')
        self.put("</palette>\n<fullstitches>\n")

    def line(self, row: dict) -> None:
        self.check(row)
        self.put("".join(f'<stitch x="{x}" y="{row["y"]}" palindex="{label + 1}"/>\n' for x, label in enumerate(row["labels"]) if label != charts.EMPTY))

    def end(self) -> None:
        super().end()
        self.put("</fullstitches>\n<partstitches/>\n<backstitches/>\n</chart>\n")


class PngSink(Sink):
    def __init__(self, out, row: dict):
        super().__init__(out, row)
        self.picture, self.table = Picture(out, row["width"], row["height"]), _table(row["palette"] or [])

    def line(self, row: dict) -> None:
        self.check(row)
        self.picture.line(self.table[row["labels"]])

    def end(self) -> None:
        super().end()
        self.picture.end()


class PagesSink(Sink):
    """A zip with a picture a page, then ``pages.tsv`` (where each page lies) and ``threads.tsv`` (stitches by label, overlaps counted once)."""

    def __init__(self, out, row: dict):
        super().__init__(out, row)
        self.archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self.palette = row["palette"] or []
        self.table, self.name, self.entry, self.picture = _table(self.palette), None, None, None
        self.map, self.counts = [], np.zeros(charts.EMPTY + 1, np.int64)

    def _close(self) -> None:
        if self.entry:
            super().end()
            self.picture.end()
            self.entry.close()

    def line(self, row: dict) -> None:
        if row["name"] != self.name:
            self._close()
            if any(row["name"] == name for name, *_ in self.map):
                raise ValueError(f"file {row['file']}: page {row['name']} comes twice")
            self.name, self.next, self.lines = row["name"], 0, row["height"]
            self.map.append((row["name"], row["left"], row["top"], row["width"], row["height"]))
            self.entry = self.archive.open(zipfile.ZipInfo(row["name"]), "w", force_zip64=False)  # a fixed time: equal charts, equal bytes
            self.picture = Picture(self.entry, row["width"], row["height"])
        self.check(row)
        labels = np.asarray(row["labels"])
        self.picture.line(self.table[labels])
        if row["y"] >= row["again_y"]:
            self.counts += np.bincount(labels[row["again_x"] :], minlength=charts.EMPTY + 1)

    def _text(self, name: str, header: str, rows: list[tuple]) -> None:
        self.archive.writestr(zipfile.ZipInfo(name), "\n".join([header, *("\t".join(map(str, r)) for r in rows)]) + "\n", zipfile.ZIP_DEFLATED)

    def end(self) -> None:
        self._close()
        self._text("pages.tsv", "name\tleft\ttop\twidth\theight", self.map)
        self._text("threads.tsv", "idx\thex\tstitches", [(p["idx"], _hex(p), self.counts[p["idx"]]) for p in self.palette])
        self.archive.close()


class ThreadSink(Sink):
    def __init__(self, out, row: dict):
        super().__init__(out, row)
        self.put("number,name,hex\n")

    def line(self, row: dict) -> None:
        if row["ord"] != self.next:
            raise ValueError(f"file {row['file']}: thread {self.next} is missing or doubled")
        self.next += 1
        cells = (f'"{v.replace(chr(34), chr(34) * 2)}"' if re.search(r'[",\n\r]', v) else v for v in (row["code"], row["name"] or ""))
        self.put(",".join((*cells, f"#{row['hex']}")) + "\n")

    def end(self) -> None:
        """A list has as many threads as it has."""


SINKS = {"chart_json": JsonSink, "chart_oxs": OxsSink, "chart_png": PngSink, "chart_pages": PagesSink, "thread_list": ThreadSink}


def _rows(batch: pa.RecordBatch, kind: str) -> Iterator[dict]:
    """The rows of a batch; the labels of pictures stay arrays, as numbers by themselves would take most of the time."""
    if kind not in ("chart_png", "chart_pages"):
        yield from batch.to_pylist()
        return
    labels = batch.column("labels")
    ends, flat = labels.offsets.to_numpy(), labels.values.to_numpy(zero_copy_only=False)
    names = [n for n in batch.schema.names if n != "labels"]
    for i, values in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
        yield {**dict(zip(names, values, strict=True)), "labels": flat[ends[i] : ends[i + 1]]}


@dataclass
class Written(WriterCommitMessage):
    """The files of one task that succeeded: where they are and their names."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    """Whole files or none: see the module."""

    def __init__(self, kind: str, options: dict[str, str], overwrite: bool):
        self.kind, self.path, self.overwrite = kind, options["path"], overwrite
        self.work = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = place(self.path)
        folder = f"{path}/{self.work}/{uuid.uuid4().hex}"  # an attempt's own
        done: list[tuple[str, str]] = []
        names: set[str] = set()
        name = out = sink = None

        def close() -> None:
            if sink is not None:
                sink.end()
                out.close()

        for batch in iterator:
            for row in _rows(batch, self.kind):
                if sink is None or row["file"] != name:
                    close()
                    name = row["file"]
                    if not name or "/" in name or name.startswith((".", "_")) or name in names:
                        raise ValueError(f"{name!r} is no name of a file, or its rows do not follow each other")
                    names.add(name)
                    if not done:  # a task without rows leaves nothing, also after an abort
                        system.create_dir(folder, recursive=True)
                    done.append((f"{folder}/{len(done)}", name + ENDINGS[self.kind]))
                    out = system.open_output_stream(done[-1][0], compression=None)
                    sink = SINKS[self.kind](out, row)
                sink.line(row)
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = place(self.path)
        files = [f for m in messages if m for f in m.files]
        names = {n for _, n in files}
        if len(names) < len(files):
            raise ValueError("a file's rows are in more than one task")
        before = {i.base_name for i in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.is_file and i.base_name.endswith(ENDINGS[self.kind])}
        if not self.overwrite and before & names:
            raise FileExistsError(f"{sorted(before & names)[0]} is there already")
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: system.move(f[0], f"{path}/{f[1]}"), files))
            if self.overwrite:
                list(pool.map(lambda n: system.delete_file(f"{path}/{n}"), before - names))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        for _ in range(5):  # tasks that are being stopped may still write
            self._clear()
            time.sleep(0.2)

    def _clear(self) -> None:
        system, path = place(self.path)
        if system.get_file_info(f"{path}/{self.work}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{self.work}")


class _Source(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        parts = PARTS[self.kind]
        part = self.options.get("part", next(iter(parts)))
        if part not in parts:
            raise ValueError(f"{self.kind} has no part {part}; it has {', '.join(parts)}")
        return ", ".join(f"{n} {t}" for n, t in {"file": "string", **parts[part]}.items())

    def reader(self, schema: StructType) -> FileReader:
        return FileReader(self.kind, self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if self.kind not in SINKS:
            raise ValueError(f"{self.kind} is read only")
        return FileWriter(self.kind, self.options, overwrite)


class OxsSource(_Source):
    kind = "chart_oxs"


class JsonSource(_Source):
    kind = "chart_json"


class PngSource(_Source):
    kind = "chart_png"


class PagesSource(_Source):
    kind = "chart_pages"


class ThreadSource(_Source):
    kind = "thread_list"


class TagSource(_Source):
    kind = "xml_tags"


def register(spark: SparkSession) -> SparkSession:
    """Make the formats known to a session."""
    for source in (OxsSource, JsonSource, PngSource, PagesSource, ThreadSource, TagSource):
        spark.dataSource.register(source)
    return spark


# ---------------------------------------------------------------- rows for the writers


def _with_palette(rows: DataFrame, palette_rows: DataFrame, key: str, first: Column) -> DataFrame:
    """A chart's palette on its first row; one entry a label, at most 100 a chart.  The key becomes the file's name.

    Up to here all is by the key, so that charts that lie together by it stay where they are; palettes are as many as charts, and are
    never broadcast.
    """
    entry = F.struct("idx", *(F.col(c).cast("int").alias(c) for c in "rgb"), "symbol", "name")
    colours = palette_rows.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(entry)).alias("palette")).hint("merge")
    return rows.join(colours, "_key", "left").withColumns({"file": F.col("_key").cast("string"), "palette": F.when(first, F.col("palette"))}).drop("_key")


def lines(cell_rows: DataFrame, palette_rows: DataFrame, key: str = "chart_id") -> DataFrame:
    """A row for each line of each chart, for the formats of one chart a file; every place of the grid needs a row, null labels are empty."""
    label = F.coalesce(F.col("label"), F.lit(charts.EMPTY)).cast("int").alias("l")
    rows = cell_rows.select(F.col(key).alias("_key"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), label)
    row = rows.groupBy("_key", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "l"))), lambda v: v["l"]).alias("labels"))
    whole = row.withColumns({"width": F.size("labels"), "height": F.max("y").over(Window.partitionBy("_key")) + 1})
    return _with_palette(whole, palette_rows, key, F.col("y") == 0)


def page_lines(cell_rows: DataFrame, palette_rows: DataFrame, size: tuple[int, int], per_page: tuple[int, int], overlap: int = 0, key: str = "chart_id") -> DataFrame:
    """A row for each line of each page, pages in the order of their names; what an earlier page shows already is not counted again."""
    shown = grid.onto_pages(cell_rows, cell_rows.sparkSession, size, per_page, overlap)
    label = F.coalesce(F.col("label"), F.lit(charts.EMPTY)).cast("int").alias("l")
    named = F.concat(scalars.page_letter(F.col("page_y")), F.col("page_x") + 1, F.lit(".png"))
    rows = shown.select(F.col(key).alias("_key"), "page_y", "page_x", F.col("y").cast("int").alias("at"), F.col("x").cast("int").alias("x"), label)
    line = rows.groupBy("_key", "page_y", "page_x", "at").agg(F.min("x").alias("left"), F.transform(F.sort_array(F.collect_list(F.struct("x", "l"))), lambda v: v["l"]).alias("labels"))
    page = Window.partitionBy("_key", "page_y", "page_x")
    top = F.min("at").over(page)
    whole = line.withColumns({"name": named, "width": F.size("labels"), "top": top, "height": F.max("at").over(page) - top + 1, "y": F.col("at") - top}).drop("at")
    again = {f"again_{a}": F.when(F.col(f"page_{a}") > 0, F.lit(overlap)).otherwise(F.lit(0)) for a in "xy"}
    return _with_palette(whole.withColumns(again), palette_rows, key, (F.col("page_y") == 0) & (F.col("page_x") == 0) & (F.col("y") == 0))


ORDER = {"chart_pages": ("file", "page_y", "page_x", "y"), "thread_list": ("file", "ord")}


def saved(rows: DataFrame, path: str, kind: str, overwrite: bool = False) -> str:
    """``rows`` of ``lines``, of ``page_lines`` or of threads (file, ord, code, name, hex) written as files; the path."""
    register(rows.sparkSession)
    order = ORDER.get(kind, ("file", "y"))
    # a number of parts of its own: rows are short for the files that they make, and parts of a usual size would be few
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(tasks, "file").sortWithinPartitions(*order).write.format(kind).mode("overwrite" if overwrite else "append").save(path)
    return path


def loaded(spark: SparkSession, path: str, kind: str, part: str | None = None, **options: str) -> DataFrame:
    """One part of the files of a folder."""
    reader = register(spark).read.format(kind)
    for name, value in (options | ({"part": part} if part else {})).items():
        reader = reader.option(name, value)
    return reader.load(path)
