"""One file for each row: names and bytes, on any store that Arrow's file systems reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(df: DataFrame, folder: str, name: str = "file_id", content: str = "content", suffix: str = ".pdf") -> DataFrame:
    """Writes each row's bytes to ``folder``/name+suffix and returns a row for each: file, length, error.

    Lazy, as the rows come from the writing: the caller's action writes. A file appears whole or not at
    all (it is moved into place), and a task that runs again writes the same bytes, so lost executors
    leave no halves behind but parts whose names end in ``.part``. ``folder``: a path or URI that all
    executors share. Names must differ; of equal ones any may stay. A null name or null bytes, a name
    with a path in it and a refused write are rows with an error; empty bytes make an empty file.
    """

    def put(store: fs.FileSystem, root: str, file: str, data: bytes) -> None:
        part = f"{root}/{file}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as out:
            out.write(data)
        store.move(part, f"{root}/{file}")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for part in parts:
            for k in range(part.num_rows):
                stem, data = part.column(0)[k].as_py(), part.column(1)[k].as_py()
                row = {"file": None if stem is None else stem + suffix, "length": None if data is None else len(data), "error": None}
                try:
                    if stem is None or data is None or "/" in stem or not stem:
                        raise ValueError("no name, a name with a path, or no bytes")
                    put(store, root, stem + suffix, data)
                except (OSError, ValueError) as error:
                    row["error"] = f"{type(error).__name__}: {error}"
                yield pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), ("length", pa.int64()), ("error", pa.string())]))

    return df.select(F.col(name).cast("string"), F.col(content)).mapInArrow(batches, "file string, length long, error string")
