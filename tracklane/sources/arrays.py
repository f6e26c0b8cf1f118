"""Containers of arrays as a data source: spark.read.format("arrays") and df.write.format("arrays").

A dataset is a folder of .npz files, an append log: each write adds a batch of files named by dataset and time, each
column is an array, and the array `_metadata` holds JSON with columns, types and shape. A batch is seen once the last step of its
commit has put its list into the folder `_batches`; files from elsewhere, without a list, are seen as they are. A
reading takes all batches in order or only the latest.

Files are opened by pyarrow's file systems (file:, hdfs:, s3: and the like), as a data source in Python has no Hadoop
client. Register it with register(spark).
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Spark types of stored dtypes, for files that don't name Spark's own.
KINDS = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "float16": "float", "float32": "float", "float64": "double", "bool": "boolean"}
#: Rows of a container, and of an Arrow batch read from one.
ROWS, BATCH = 1_000_000, 65_536
OWN = re.compile(r"_(\d{8}_\d{6}_\d{6})_\d{5}_[0-9a-f]{8}\.npz$")


def opened(path: str) -> tuple[files.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return files.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return files.LocalFileSystem(), path


def stored(path: str, mode: str = "all") -> list[str]:
    """Paths of the dataset's files in order of their names: all, or those of the latest batch."""
    f, root = opened(path)
    lists = [x.path for x in f.get_file_info(files.FileSelector(f"{root}/_batches", allow_not_found=True)) if x.path.endswith(".json")]
    listed = {n for p in lists for n in json.loads(f.open_input_stream(p).read())}
    names = sorted(x.base_name for x in f.get_file_info(files.FileSelector(root, allow_not_found=True)) if x.base_name.endswith(".npz"))
    names = [n for n in names if n in listed or not OWN.search(n)]
    if mode == "latest" and names:
        stamp = lambda n: (m[1] if (m := OWN.search(n)) else n)
        names = [n for n in names if stamp(n) == stamp(names[-1])]
    return [f"{root}/{n}" for n in names]


def metadata(f: files.FileSystem, path: str) -> dict:
    """What a container says of itself, without its columns; columns and dtypes come from array headers if it says nothing."""
    with f.open_input_file(path) as data, zipfile.ZipFile(data) as z:
        names = [n.removesuffix(".npy") for n in z.namelist()]
        told = {}
        if "_metadata" in names:
            told = json.loads(str(np.load(io.BytesIO(z.read("_metadata.npy")), allow_pickle=False)[0]))
        columns = told.get("columns") or [n for n in names if not n.startswith("_")]
        dtypes = dict(told.get("dtypes") or {})
        for c in columns:
            if c not in dtypes or dtypes[c] == "object":
                with z.open(f"{c}.npy") as a:
                    version = np.lib.format.read_magic(a)
                    head = np.lib.format.read_array_header_1_0(a) if version == (1, 0) else np.lib.format.read_array_header_2_0(a)
                dtypes[c] = str(head[2])
        return told | {"columns": columns, "dtypes": dtypes}


def kind_of(dtype: str) -> str:
    if dtype.startswith("datetime64"):
        return "date" if dtype.endswith("[D]") else "timestamp_ntz"
    return KINDS.get(dtype, "string")


def _array(a: np.ndarray, missing: np.ndarray | None, kind: pa.DataType) -> pa.Array:
    if a.dtype.kind in "OSU":
        x = pa.array([None if m else v for v, m in zip(a.astype(str).tolist(), missing.tolist() if missing is not None else [False] * len(a), strict=True)], pa.string())
    elif a.dtype.kind == "M":
        day = pa.types.is_date(kind)
        x = pa.array(a.astype("datetime64[D]" if day else "datetime64[us]"), pa.date32() if day else pa.timestamp("us"), mask=missing)
    else:
        x = pa.array(a.astype(np.float32) if a.dtype == np.float16 else a, mask=missing)
    return x.cast(kind)


def _cells(x: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """A column as an array, and where it is null."""
    missing = np.asarray(x.is_null()) if x.null_count else None
    t = x.type
    if pa.types.is_boolean(t) or pa.types.is_integer(t) or pa.types.is_floating(t):
        return np.asarray((x.fill_null(False if pa.types.is_boolean(t) else 0) if missing is not None else x).to_numpy(zero_copy_only=False)), missing
    if pa.types.is_timestamp(t) or pa.types.is_date(t):
        unit = "D" if pa.types.is_date(t) else "us"
        whole = x.cast(pa.int32()).cast(pa.int64()) if pa.types.is_date(t) else x.cast(pa.timestamp("us", t.tz)).cast(pa.int64())
        return whole.fill_null(0).to_numpy(zero_copy_only=False).astype(f"datetime64[{unit}]"), missing
    if pa.types.is_string(t) or pa.types.is_large_string(t) or pa.types.is_decimal(t):
        return np.array(x.cast(pa.string()).fill_null("").to_pylist(), str), missing
    raise ValueError(f"a container has no cells for {t}")


class Piece(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ContainerReader(DataSourceReader):
    def __init__(self, path: str, mode: str, schema: StructType):
        self.path, self.mode, self.schema = path, mode, schema

    def partitions(self) -> list[InputPartition]:
        return [Piece(p) for p in stored(self.path, self.mode)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        """The rows of one file; columns that it lacks are null."""
        from pyspark.sql.pandas.types import to_arrow_type

        if partition is None:  # a dataset without files
            return
        f, _ = opened(self.path)
        kinds = [to_arrow_type(x.dataType) for x in self.schema]
        with f.open_input_file(partition.path) as data, np.load(data, allow_pickle=False) as z:
            held = {n: z[n] for x in self.schema for n in (x.name, f"_null_{x.name}") if n in z.files}
            rows = max((len(a) for n, a in held.items()), default=metadata(f, partition.path).get("shape", [0])[0])
            for i in range(0, rows, BATCH):
                n = min(BATCH, rows - i)
                cut = lambda name: held[name][i : i + n] if name in held else None  # noqa: B023, E731
                cols = [_array(a, cut(f"_null_{x.name}"), k) if (a := cut(x.name)) is not None else pa.nulls(n, k) for x, k in zip(self.schema, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.name for x in self.schema])


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class ContainerWriter(DataSourceArrowWriter):
    """Tasks put files into `_staged`; the commit moves them into the dataset and then lists them, so a reader sees a
    whole batch or none, and nothing of tasks that were tried twice or failed."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, rows: int, compress: bool):
        self.path, self.schema, self.overwrite, self.rows, self.compress = path, schema, overwrite, rows, compress
        self.job = uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        f, root = opened(self.path)
        f.create_dir(f"{root}/_staged/{self.job}", recursive=True)
        names, held, size = [], [], 0
        for b in iterator:
            while b.num_rows:
                part = b.slice(0, self.rows - size)
                held.append(part)
                size += part.num_rows
                b = b.slice(part.num_rows)
                if size >= self.rows:
                    names.append(self._put(f, root, held))
                    held, size = [], 0
        if size:
            names.append(self._put(f, root, held))
        return Written(names)

    def _put(self, f: files.FileSystem, root: str, batches: list[pa.RecordBatch]) -> str:
        t = pa.Table.from_batches(batches).combine_chunks()
        arrays, dtypes = {}, {}
        for x in self.schema:
            c = t.column(x.name)
            a, missing = _cells(c.chunk(0) if c.num_chunks else pa.array([], c.type))
            arrays[x.name], dtypes[x.name] = a, "object" if a.dtype.kind == "U" else str(a.dtype)
            if missing is not None:
                arrays[f"_null_{x.name}"] = missing
        told = {"columns": t.column_names, "dtypes": dtypes, "shape": [t.num_rows, t.num_columns], "has_index": False, "spark": {x.name: x.dataType.simpleString() for x in self.schema}}
        out = io.BytesIO()
        (np.savez_compressed if self.compress else np.savez)(out, **arrays, _metadata=np.array([json.dumps(told)]))
        name = uuid.uuid4().hex
        with f.open_output_stream(f"{root}/_staged/{self.job}/{name}") as s:
            s.write(out.getvalue())
        return name

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        f, root = opened(self.path)
        dataset = root.rstrip("/").rsplit("/", 1)[-1]
        old = stored(self.path) if self.overwrite else []
        lists = [x.path for x in f.get_file_info(files.FileSelector(f"{root}/_batches", allow_not_found=True))] if self.overwrite else []
        stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
        names = []
        for k, n in enumerate(n for m in messages if m for n in m.names):
            names.append(f"{dataset}_{stamp}_{k:05d}_{self.job}.npz")
            f.move(f"{root}/_staged/{self.job}/{n}", f"{root}/{names[-1]}")
        f.create_dir(f"{root}/_batches", recursive=True)
        with f.open_output_stream(f"{root}/_batches/.{stamp}") as s:
            s.write(json.dumps(names).encode())
        f.move(f"{root}/_batches/.{stamp}", f"{root}/_batches/{stamp}.json")
        for p in lists + old:
            f.delete_file(p)
        self._cleared(f, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._cleared(*opened(self.path))

    def _cleared(self, f: files.FileSystem, root: str) -> None:
        staged = f"{root}/_staged/{self.job}"
        if f.get_file_info(staged).type == files.FileType.Directory:
            f.delete_dir(staged)


class ArrayContainers(DataSource):
    """Options: mode "all" or "latest" for reading; rows of a file and compress for writing. The schema is that of the
    latest file, unless it is given; a given one reads its columns alone."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def _mode(self) -> str:
        mode = self.options.get("mode", "all").lower()
        if mode not in ("all", "latest"):
            raise ValueError(f"mode is all or latest, not {mode}")
        return mode

    def schema(self) -> str:
        found = stored(self.options["path"], self._mode())
        if not found:
            raise ValueError(f"no containers at {self.options['path']}")
        told = metadata(opened(self.options["path"])[0], found[-1])
        own = told.get("spark", {})
        return ", ".join(f"`{c}` {own.get(c) or kind_of(told['dtypes'][c])}" for c in told["columns"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ContainerReader(self.options["path"], self._mode(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ContainerWriter(self.options["path"], schema, overwrite, int(self.options.get("rows", ROWS)), self.options.get("compress", "true").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayContainers)
