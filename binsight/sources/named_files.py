"""Files opened by the tasks that need them, from a table of paths.

The paths stay in Spark: no list of files goes through the driver. A file is
opened through the file system of its URI (``pyarrow.fs``: local and shared
folders, object stores, HDFS), which the executors must be able to reach.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from binsight.functions.columns import basename
from binsight.session import ship_package

BATCH_BYTES = 16 << 20  # contents that leave a task at once, about


def open_system(uri: str):
    """(file system, path in it) of a URI as Spark writes it."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_named(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(filename, content) of the files that ``paths`` names; a missing file fails the job."""
    ship_package(paths.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        names, contents, size = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())],
                                              names=["filename", "content"])

        for batch in batches:
            for name, path in zip(batch.column("filename").to_pylist(), batch.column("path").to_pylist()):
                system, at = open_system(path)
                with system.open_input_stream(at) as f:
                    contents.append(f.read())
                names.append(name)
                size += len(contents[-1])
                if size >= BATCH_BYTES:
                    yield out()
                    names, contents, size = [], [], 0
        if names:
            yield out()

    return paths.select(basename(path_col).alias("filename"), paths[path_col].alias("path")).mapInArrow(
        run, "filename string, content binary")
