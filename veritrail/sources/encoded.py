"""Text files in any of the known encodings, read by tasks that have about as many bytes each.

    spark.dataSource.register(EncodedTexts)
    spark.read.format("encoded_texts").load(uri)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from veritrail.functions.text import normalize_invisibles
from veritrail.sources.remote import full_uri, opened
from veritrail.sources.tables import ENCODINGS

COLUMNS = "path string, bytes long, text string, encoding string, error string"
#: Bytes of a task, unless one file has more; each file counts as so many more, for the time that opening takes.
TASK_BYTES, OPEN_BYTES = 128 << 20, 1 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]
    sizes: list[int]


def decoded(raw: bytes) -> tuple[str, str, str | None]:
    """Text, encoding and what was wrong: the first encoding that fits, else UTF-8 with marks for what it can't read."""
    for name in ENCODINGS:
        try:
            return raw.decode(name), name, None
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), "utf-8", "no known encoding fits; unreadable characters are replaced"


def planned(sizes: list[tuple[str, int]], most: int) -> list[Files]:
    """Files in order of their paths, dealt out in runs of about most bytes."""
    out, held, total = [], Files([], []), 0
    for path, size in sorted(sizes):
        if held.paths and total + size + OPEN_BYTES > most:
            out.append(held)
            held, total = Files([], []), 0
        held.paths.append(path)
        held.sizes.append(size)
        total += size + OPEN_BYTES
    return [*out, held] if held.paths else out


class EncodedTexts(DataSource):
    """All files of a folder and those below it, but for hidden ones: path, bytes, text, encoding, error. A file that can't be read has no text, and an error."""

    @classmethod
    def name(cls) -> str:
        return "encoded_texts"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        return TextReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))


class TextReader(DataSourceReader):
    def __init__(self, path: str, most: int) -> None:
        self.path, self.most = path, most

    def partitions(self) -> list[Files]:
        from pyarrow.fs import FileSelector

        system, root = opened(self.path)
        found = [system.get_file_info(root)] if system.get_file_info(root).is_file else system.get_file_info(FileSelector(root, recursive=True))
        own = [(x.path, x.size) for x in found if x.is_file and not any(part[:1] in ("_", ".") for part in x.path[len(root) :].split("/"))]
        return planned(own, self.most) or [Files([], [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("text", pa.string()), ("encoding", pa.string()), ("error", pa.string())])
        for path, size in zip(partition.paths, partition.sizes, strict=True):
            try:
                with system.open_input_file(path) as source:
                    text, name, wrong = decoded(source.read())
            except OSError as e:
                text, name, wrong = None, None, f"{type(e).__name__}: {e}"[:500]
            if text is not None:
                text = text.encode("utf-8", "replace").decode()  # lone surrogates have no place in a table
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((path, size, text, name, wrong), schema, strict=True)], schema=schema)


def read_encoded(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """path, bytes, text (with its invisible characters normalized), encoding, error of every file below the path."""
    spark.dataSource.register(EncodedTexts)
    rows = spark.read.format("encoded_texts").option("path", full_uri(spark, path)).option("task_bytes", str(task_bytes)).load()
    return rows.withColumn("text", normalize_invisibles("text"))


def unreadable(files: DataFrame) -> DataFrame:
    """path, bytes, error of the files that could not be read as they are."""
    return files.where("error is not null").select("path", "bytes", "error")
