"""Snapshots as generations with a manifest, read only after a check, with the last good one to fall back on.

A publisher writes the rows, then the generation's manifest (schema, rows,
files with their bytes, a digest), and the pointer last.  A reader that finds
the pointer or its generation torn, of another schema or too large takes the
newest generation that is good, and says why.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.recheck import fingerprint

SCHEMA_VERSION = 1
POINTER, MANIFEST = "_CURRENT", "_MANIFEST.json"
MOST_BYTES = 1 << 30
#: Manifests and pointers are small; larger ones are refused unread.
MOST_NOTE_BYTES = 1 << 20


class SnapshotError(RuntimeError):
    """No generation can be read; the text says why for each."""


@dataclass
class Snapshot:
    rows: DataFrame
    generation: str
    #: Why newer generations were passed over; empty if the pointer's own was read.
    passed_over: list[str] = field(default_factory=list)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small file, seen whole or not at all where the store renames in one step."""
    fs, part = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    _, at = _fs(spark, path)
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, at, options)


def _read_note(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    if not fs.getFileStatus(at).isFile() or fs.getFileStatus(at).getLen() > MOST_NOTE_BYTES:
        raise ValueError("it is no small file")
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    fs, at = _fs(spark, path)
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(("_", "."))}


def publish(rows: DataFrame, path: str, deep: bool = True) -> str:
    """Write a new generation and point to it last; its name.  ``deep``: with a digest of the rows, one more pass over them."""
    spark = rows.sparkSession
    known = _generations(spark, path)
    name = f"g{(int(known[0][1:9]) if known else 0) + 1:08d}-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(f"{path}/{name}")
    files = _files(spark, f"{path}/{name}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/{name}")
    manifest = {"schema_version": SCHEMA_VERSION, "schema": json.loads(rows.schema.json()), "files": files, "bytes": sum(files.values()), "digest": fingerprint(written) if deep else None}
    _write_note(spark, f"{path}/{name}/{MANIFEST}", json.dumps(manifest))
    _write_note(spark, f"{path}/{POINTER}", name)
    return name


def _generations(spark: SparkSession, path: str) -> list[str]:
    """Names of the generations there, the newest first; whether they are good is another question."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted((n for n in names if n[:1] == "g" and n[1:9].isdigit()), reverse=True)


def _plain(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def _checked(spark: SparkSession, path: str, name: str, schema: StructType | None, most_bytes: int, deep: bool) -> DataFrame:
    """The rows of a generation; ValueError with what is wrong with it."""
    note = _read_note(spark, f"{path}/{name}/{MANIFEST}")
    if note is None:
        raise ValueError("it has no manifest, so its writer didn't finish")
    manifest = json.loads(note)
    if not isinstance(manifest, dict) or manifest.get("schema_version") != SCHEMA_VERSION:
        raise ValueError("its manifest is of another version")
    own = StructType.fromJson(manifest["schema"])
    if schema is not None and _plain(own) != _plain(schema):
        raise ValueError(f"its schema is {own.simpleString()}")
    if manifest["bytes"] > most_bytes:
        raise ValueError(f"it has {manifest['bytes']} bytes, more than {most_bytes}")
    if _files(spark, f"{path}/{name}") != manifest["files"]:
        raise ValueError("its files aren't those that were published")
    rows = spark.read.schema(own).parquet(f"{path}/{name}")
    if deep and manifest["digest"] is not None and fingerprint(rows) != manifest["digest"]:
        raise ValueError("its rows aren't those that were published")
    return rows


def read(spark: SparkSession, path: str, schema: StructType | None = None, most_bytes: int = MOST_BYTES, deep: bool = False) -> Snapshot:
    """The generation that the pointer names, else the newest good one, with the reasons; SnapshotError if there is none.

    Files and sizes are always held against the manifest, the rows' digest only with ``deep``.
    """
    passed, names = [], _generations(spark, path)
    try:
        pointed = _read_note(spark, f"{path}/{POINTER}")
    except Exception as x:  # an unreadable pointer is a reason like any other
        pointed, passed = None, [f"pointer: {x}"]
    if pointed in names:
        # what is newer than the pointer was never published
        names = [pointed, *(n for n in names if n < pointed)]
    else:
        passed = passed or [f"pointer: {'there is none' if pointed is None else 'it names no generation'}"]
    for name in names:
        try:
            return Snapshot(_checked(spark, path, name, schema, most_bytes, deep), name, passed)
        except Exception as x:  # whatever is wrong with one generation, an older one may be good
            passed.append(f"{name}: {x}")
    raise SnapshotError("; ".join(passed))
