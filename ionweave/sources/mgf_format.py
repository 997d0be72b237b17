"""MGF as a data source of Spark's own: ``spark.read.format("mgf")`` and ``.write.format("mgf")``.

Reading plans a partition for each ``split`` bytes of each file (an option, 32 MiB by default); a task takes the blocks that begin in its
bytes and reads past their end for the last one. Writing gives each task a hidden file of its own, which counts only once all tasks are done: the
commit moves the files of the tasks that Spark names to their places, so tasks that fail, or run twice, leave nothing behind.

Paths are those that all machines see: a plain path or a URI that Arrow's file systems know (``file:``, ``hdfs:``, ``s3:``). ``read_mgf`` reads by
Spark's own file sources instead, from any store that these reach.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ionweave.schema import RAW
from ionweave.session import ship
from ionweave.sources.mgf import START, block_text

SPLIT = 32 << 20
#: Bytes read at a time, and spectra in a batch.
CHUNK, BATCH = 1 << 20, 2000
_MARK = START.encode()
_NUMBER = rb"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_END = re.compile(rb"(?m)^END")
_PEAK = re.compile(rb"\s*" + _NUMBER + rb"\s+" + _NUMBER)
_FIELD = {name: re.compile(rb"(?m)^" + name.encode() + rb"=\s*(" + kind + rb")") for name, kind in (("CHARGE", rb"[0-9]+"), ("PEPMASS", _NUMBER), ("SCANS", rb"-?[0-9]+"), ("RTINSECONDS", _NUMBER))}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace(":", "://", 1))
    return pafs.LocalFileSystem(), path


def _float(text: bytes) -> float | None:
    try:
        return float(np.float32(float(text)))
    except ValueError:
        return None


def spectrum_of(block: bytes) -> tuple | None:
    """(charge, precursor m/z, scan, time, peaks) of what follows a ``BEGIN IONS``; None without an END line or a charge."""
    end = _END.search(block)
    if not end:
        return None
    body = block[: end.start()].replace(b"\r", b"")
    got = {name: x.group(1) for name, pattern in _FIELD.items() if (x := pattern.search(body))}
    if "CHARGE" not in got or int(got["CHARGE"]) > 127:
        return None
    peaks = []
    for line in body.split(b"\n"):
        if _PEAK.match(line):
            mz, intensity = (_float(w) for w in re.split(rb"\s+", line.strip(b" "))[:2])
            if mz is not None and intensity is not None:
                peaks.append((mz, intensity))
    scan = int(got.get("SCANS", b"-1"))
    known = lambda name: x if (x := _float(got.get(name, b"-1"))) is not None else -1.0
    return int(got["CHARGE"]), known("PEPMASS"), scan if -(2**31) <= scan < 2**31 else -1, known("RTINSECONDS"), sorted(peaks)


def blocks_of(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the blocks whose ``BEGIN IONS`` stands at an offset in [start, end); a part of the file is held at a time."""
    file.seek(start)
    held, at, more = b"", start, True
    begun: int | None = None
    look = 0
    while True:
        found = held.find(_MARK, look)
        if found < 0:
            if not more:
                break
            if begun is None:
                # no block is open: only what may be the beginning of a mark is kept
                keep = min(len(held), len(_MARK) - 1)
                at, held, look = at + len(held) - keep, held[len(held) - keep :], 0
                if at >= end:
                    return
            else:
                look = max(begun, len(held) - len(_MARK) + 1)
            chunk = file.read(CHUNK)
            more = bool(chunk)
            held += chunk
            continue
        if begun is not None:
            yield at + begun - len(_MARK), held[begun:found]
        if at + found >= end:
            return
        at, held = at + found, held[found:]
        begun = look = len(_MARK)
    if begun is not None:
        yield at + begun - len(_MARK), held[begun:]


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class MgfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern, self.size = options["path"], options.get("pathglobfilter", "*.mgf"), int(options.get("split", SPLIT))

    def partitions(self) -> list[Split]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [x for x in system.get_file_info(pafs.FileSelector(path)) if x.is_file and fnmatch.fnmatch(x.base_name, self.pattern)]
        files = [x for x in files if not x.base_name.startswith((".", "_"))]
        return [Split(x.path, at, min(at + self.size, x.size)) for x in sorted(files, key=lambda x: x.path) for at in range(0, x.size, self.size)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split is None:
            return
        system, _ = opened(self.path)
        name = split.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        rows: list[tuple] = []
        with system.open_input_file(split.path) as file:
            for offset, block in blocks_of(file, split.start, split.end):
                found = spectrum_of(block)
                if found:
                    rows.append((name, offset, *found))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


_TYPES = [pa.string(), pa.int64(), pa.int8(), pa.float32(), pa.int32(), pa.float32(), pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64())]))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES[:-1])]
    peaks = pa.array([[{"mz": m, "intensity": y} for m, y in r[-1]] for r in rows], _TYPES[-1])
    return pa.RecordBatch.from_arrays([*columns, peaks], names=RAW.names)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int
    task: int


class MgfWriter(DataSourceArrowWriter):
    """Spectra with the columns that ``write_mgf`` takes: title and cluster where they are there."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex
        self.hidden = f"_mgf-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, path = opened(self.path)
        task = TaskContext.get().partitionId()
        file, rows, out = f"{path}/{self.hidden}/{uuid.uuid4().hex}", 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(f"{path}/{self.hidden}", recursive=True)
                    out = system.open_output_stream(file)
                for text in texts_of(batch):
                    out.write(text.encode() + b"\n")
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(file if out is not None else None, rows, task)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        old = []
        if self.overwrite and system.get_file_info(path).type == pafs.FileType.Directory:
            old = [x.path for x in system.get_file_info(pafs.FileSelector(path)) if x.is_file and not x.base_name.startswith((".", "_"))]
        system.create_dir(path, recursive=True)
        for x in old:
            system.delete_file(x)
        for m in sorted((m for m in messages if m and m.file), key=lambda m: m.task):
            system.move(m.file, f"{path}/part-{m.task:05d}-{self.run}.mgf")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, path = opened(self.path)
        if system.get_file_info(f"{path}/{self.hidden}").type == pafs.FileType.Directory:
            system.delete_dir(f"{path}/{self.hidden}")


def texts_of(batch: pa.RecordBatch) -> Iterator[str]:
    """The blocks of a batch, as ``mgf_blocks`` has them."""
    names = batch.schema.names
    get = lambda c: batch.column(names.index(c)).to_pylist()
    titles = get("title") if "title" in names else [":".join(str(x) for x in t if x is not None) for t in zip(get("identifier"), get("spec_index"), get("scan"), strict=True)]
    clusters = get("cluster") if "cluster" in names else [None] * batch.num_rows
    for t, m, r, z, c, peaks in zip(titles, get("precursor_mz"), get("retention_time"), get("precursor_charge"), clusters, get("peaks"), strict=True):
        yield block_text(t, m, r, z, c, [p["mz"] for p in peaks or ()], [p["intensity"] for p in peaks or ()])


class MgfSource(DataSource):
    """Options: ``path`` (a folder, or a file to read), ``pathGlobFilter``, ``split``."""

    @classmethod
    def name(cls) -> str:
        return "mgf"

    def schema(self):
        return RAW

    def reader(self, schema) -> MgfReader:
        return MgfReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> MgfWriter:
        return MgfWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register_mgf(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, and the package to its executors."""
    ship(spark).dataSource.register(MgfSource)
    return spark
