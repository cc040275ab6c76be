"""A sink of JSON lines by unit that a stopped run leaves usable: finished units stay, and the next run writes the rest."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .spool import filesystem

UNITS = "unit string, part int, bytes long"


@dataclass
class Written(WriterCommitMessage):
    """The units that a task finished: (unit, part, rows, bytes, sha256) each."""

    units: list


class UnitFile:
    """One gzip file; its bytes depend on the lines alone, and its name appears once it is whole."""

    def __init__(self, store, folder: str, unit: str | None, part: int):
        self.store, self.key = store, (unit, part)
        self.final = f"{folder}/{file_name(unit, part)}"
        self.temporary = f"{folder}/.tmp-{uuid.uuid4().hex}"
        self.out, self.rows, self.size, self.sha = store.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        self.zip = zlib.compressobj(6, zlib.DEFLATED, -15)
        self.crc = self.plain = 0
        self._put(b"\x1f\x8b\x08\0\0\0\0\0\0\xff")

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def add(self, line: str) -> None:
        data = line.encode() + b"\n"
        self.crc, self.plain, self.rows = zlib.crc32(data, self.crc), self.plain + len(data), self.rows + 1
        self._put(self.zip.compress(data))

    def close(self) -> tuple:
        self._put(self.zip.flush() + self.crc.to_bytes(4, "little") + (self.plain & 0xFFFFFFFF).to_bytes(4, "little"))
        self.out.close()
        self.store.move(self.temporary, self.final)  # a second attempt puts the same bytes there
        return (*self.key, self.rows, self.size, self.sha.hexdigest())

    def drop(self) -> None:
        self.out.close()
        self.store.delete_file(self.temporary)


def file_name(unit: str | None, part: int) -> str:
    return f"unit-{'n' if unit is None else 'v' + quote(unit, safe='')}-{part:05d}.jsonl.gz"


class UnitWriter(DataSourceArrowWriter):
    """Writes each unit of a task's sorted rows (unit, part, line) as a file of its own; the job's commit adds a manifest of what it wrote."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = filesystem(self.path)
        store.create_dir(folder)
        now, done = None, []
        try:
            for b in iterator:
                for unit, part, line in zip(*(b.column(k).to_pylist() for k in ("unit", "part", "line"))):
                    if now is None or now.key != (unit, part):
                        if now is not None:
                            done.append(now.close())
                            now = None
                        now = UnitFile(store, folder, unit, part)
                    now.add(line)
            if now is not None:
                done.append(now.close())
                now = None
        finally:
            if now is not None:
                now.drop()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        units = sorted((u for m in messages if m for u in m.units), key=str)
        store, folder = filesystem(self.path)
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([dict(zip(("unit", "part", "rows", "bytes", "sha256"), u)) for u in units]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Finished units stay: each is whole, and the next run leaves it out."""


class UnitSink(DataSource):
    """Format ``unit_lines``: option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "unit_lines"

    def writer(self, schema, overwrite: bool) -> UnitWriter:
        return UnitWriter(self.options["path"])


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(unit, part, bytes) of the units under ``path`` that are whole, by the files' names alone."""
    store, folder = filesystem(path)
    from pyarrow import fs

    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return spark.createDataFrame([], UNITS)
    m = F.regexp_extract("path", r"unit-([nv][^/]*)-(\d+)\.jsonl\.gz$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "unit-*.jsonl.gz").load(path).select("path", "length")
    name = F.when(m != "n", F.url_decode(F.substring(m, 2, 1 << 30)))
    return files.select(name.alias("unit"), F.regexp_extract("path", r"-(\d+)\.jsonl\.gz$", 1).cast("int").alias("part"), F.col("length").alias("bytes"))


def write_units(df: DataFrame, unit: str, order: list[str], path: str, parts: int = 1) -> DataFrame:
    """Write the rows as JSON lines, a gzip file for each ``unit`` (and hash of ``order``, in ``parts``, so that no task holds a large unit); units that an earlier run finished are left out.

    Within a file rows are in the order of ``order``, which is unique, so a file's bytes are the same
    however often the work was interrupted. A null unit is a unit. Returns the finished units.
    """
    spark = df.sparkSession
    spark.dataSource.register(UnitSink)
    done = finished(spark, path).select(F.col("unit").alias("_unit"), F.col("part").alias("_part"))
    lines = df.select(F.col(unit).cast("string").alias("unit"), F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int").alias("part"), F.to_json(F.struct(*df.columns)).alias("line"), F.struct(*order).alias("o"))
    lines = lines.join(F.broadcast(done) if parts == 1 else done, F.col("unit").eqNullSafe(F.col("_unit")) & (F.col("part") == F.col("_part")), "left_anti")
    lines = lines.repartition("unit", "part").sortWithinPartitions("unit", "part", "o").select("unit", "part", "line")
    lines.write.format("unit_lines").option("path", path).mode("append").save()
    return finished(spark, path)


def read_units(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("pathGlobFilter", "unit-*.jsonl.gz").json(path)
