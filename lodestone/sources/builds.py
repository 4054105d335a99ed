"""Builds written with a commit: a table counts when its writer has committed, a build when all its tables have.

Tasks write files of names of their own and tell the driver which. Only the commit makes them a table: it writes the plan's
hash, the hash of all rows and the list of files as one mark. So an attempt that was killed leaves files that nobody reads
(the commit removes them), and an aborted write leaves nothing. A replay with the same rows changes nothing; other rows raise.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.validate import ValidationError

MARK, DIGEST = "_complete.json", "_digest"


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    sums: tuple  # of four parts of the rows' hashes, which no order changes


def _open(path: str):
    return fs.FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", path))


def _read(store, path: str) -> dict | None:
    if not store.get_file_info(path).is_file:
        return None
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def _put(store, path: str, content: dict) -> None:
    """The file appears whole."""
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(json.dumps(content, sort_keys=True).encode())
    store.move(part, path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, schema: T.StructType):
        self.path, self.plan = options["path"], options["plan"]
        own = T.StructType([f for f in schema.fields if f.name != DIGEST])
        self.schema, self.ddl = to_arrow_schema(own), own.json()

    def write(self, iterator) -> Written:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        file, rows, sums, out = f"part-{uuid.uuid4().hex}.parquet", 0, [0] * 4, None
        try:
            for batch in iterator:
                if out is None:
                    out = pq.ParquetWriter(f"{root}/{file}", self.schema, filesystem=store)
                for digest in batch.column(DIGEST).to_pylist():
                    for i in range(4):
                        sums[i] += int(digest[15 * i : 15 * i + 15], 16)
                rows += batch.num_rows
                kept = [batch.column(f.name).cast(f.type) for f in self.schema]
                out.write_batch(pa.RecordBatch.from_arrays(kept, schema=self.schema))
        finally:
            if out is not None:
                out.close()
        return Written(file if out is not None else "", rows, tuple(sums))

    def commit(self, messages) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        told = [m for m in messages if m is not None]
        sums = [sum(m.sums[i] for m in told) for i in range(4)]
        rows = sum(m.rows for m in told)
        mark = {"plan_hash": self.plan, "payload_hash": _hash(rows, sums), "rows": rows, "schema": self.ddl}
        there = _read(store, f"{root}/{MARK}")
        if there:
            self.abort(messages)
            if {k: there[k] for k in mark} != mark:
                raise ValidationError("the table is there with other rows or of another plan")
            return
        _put(store, f"{root}/{MARK}", mark | {"files": sorted(m.file for m in told if m.file)})
        self._remove(store, root, set(m.file for m in told))

    def abort(self, messages) -> None:
        store, root = _open(self.path)
        for m in messages:
            if m is not None and m.file and store.get_file_info(f"{root}/{m.file}").is_file:
                store.delete_file(f"{root}/{m.file}")
        if not _read(store, f"{root}/{MARK}"):
            self._remove(store, root, set())

    def _remove(self, store, root: str, kept: set) -> None:
        """Files of attempts that were killed."""
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.is_file and f.base_name.startswith("part-") and f.base_name not in kept:
                store.delete_file(f.path)


def _hash(rows: int, sums) -> str:
    return hashlib.sha256(":".join(map(str, [rows, *sums])).encode()).hexdigest()


class Builds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "build_table"

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema)


def write_table(df: DataFrame, root: str, table: str, plan_hash: str) -> None:
    """``df`` as ``table`` of the build at ``root``."""
    df.sparkSession.dataSource.register(Builds)
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    df.withColumn(DIGEST, digest).write.format("build_table").mode("append").option("plan", plan_hash).save(f"{root}/{table}")


def complete(spark: SparkSession, root: str, plan_hash: str, tables: list[str]) -> dict:
    """Marks a build as whole once all its tables are committed under one plan; again the same mark, another raises."""
    store, at = _open(root)
    marks = {t: _read(store, f"{at}/{t}/{MARK}") for t in sorted(tables)}
    if missing := [t for t, m in marks.items() if not m or m["plan_hash"] != plan_hash]:
        raise ValidationError(f"not committed under this plan: {', '.join(missing)}")
    mark = {"plan_hash": plan_hash, "tables": {t: {"payload_hash": m["payload_hash"], "rows": m["rows"]} for t, m in marks.items()}}
    there = _read(store, f"{at}/{MARK}")
    if there and there != mark:
        raise ValidationError("the build is complete with other tables")
    if not there:
        _put(store, f"{at}/{MARK}", mark)
    return mark


def read_table(spark: SparkSession, root: str, table: str, plan_hash: str) -> DataFrame:
    """A table of a complete build: the files of its mark, and no others."""
    store, at = _open(root)
    build, mark = _read(store, f"{at}/{MARK}"), _read(store, f"{at}/{table}/{MARK}")
    if not build or build["plan_hash"] != plan_hash or table not in build["tables"] or build["tables"][table]["payload_hash"] != mark["payload_hash"]:
        raise ValidationError("the build isn't complete under this plan")
    schema = T.StructType.fromJson(json.loads(mark["schema"]))
    return spark.read.schema(schema).parquet(*[f"{root}/{table}/{f}" for f in mark["files"]]) if mark["files"] else spark.createDataFrame([], schema)
