"""Snapshots: immutable Parquet folders and a pointer that is replaced last.

A write prepares all tables of a version and then renames the pointer over the old
one, so readers see the old state or the new one, and a failed write leaves no trace in results.
Paths go through Hadoop's file systems, so a store can be anywhere Spark reads and writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DimensionMismatch, StoreError

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<float>": T.ArrayType(T.FloatType()), "array<double>": T.ArrayType(T.DoubleType()), "array<int>": T.ArrayType(T.IntegerType())}


def _schema(fields: str) -> T.StructType:
    """Names and types without a session, which Spark's own reader of such text needs."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, fields.split(", "))])


FILES = _schema("file_id long, file_uri string, mime_type string, content_hash string, size_bytes long, indexed_at double, modified_at double")
CHUNKS = _schema(
    "chunk_id long, file_id long, file_uri string, tier int, chunk_index long, content string, token_count long, meta string, lance_id long, structural_score double, coherence_score double, is_flagged boolean, chunker_method string"
)
EDGES = _schema("src_chunk long, dst_uri string, dst_uri_norm string, edge_type string, meta string")
VECTORS = _schema("id long, chunk_id long, tier int, vector array<float>")
POSTINGS = _schema("term string, chunk_id long, tf long, positions array<int>")
LENGTHS = _schema("chunk_id long, dl long")
DOCUMENTS = _schema("file_uri string, name string, mime_type string, size_bytes long, modified_at double, content binary, record_meta string")
CELLS = _schema("id long, cell int")
CENTRES = _schema("cell int, centre array<double>, probes int")
SCHEMAS = {"cells": CELLS, "centres": CENTRES, "files": FILES, "chunks": CHUNKS, "edges": EDGES, "vectors": VECTORS, "postings": POSTINGS, "lengths": LENGTHS, "documents": DOCUMENTS}
POINTER = "CURRENT"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- pointer

    def _state(self) -> dict:
        at = self._path(f"{self.path}/{POINTER}")
        if not self._fs.exists(at):
            return {"version": None, "tables": {}, "meta": {}}
        return json.loads(self.spark.read.text(f"{self.path}/{POINTER}", wholetext=True).first()[0])

    def _point(self, state: dict) -> None:
        fresh = self._path(f"{self.path}/{POINTER}.{uuid.uuid4().hex}")
        out = self._fs.create(fresh)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fresh, self._path(f"{self.path}/{POINTER}"), options)

    @property
    def version(self) -> str | None:
        return self._state()["version"]

    @property
    def meta(self) -> dict:
        return self._state()["meta"]

    # --- tables

    def table(self, name: str) -> DataFrame:
        """The current snapshot of a table, empty if it was never written; columns added since are null."""
        if name not in SCHEMAS:
            raise StoreError(f"no table {name}")
        folder = self._state()["tables"].get(name)
        if folder is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{folder}")

    def commit(self, tables: dict[str, DataFrame], **meta: object) -> str:
        """Write new snapshots of ``tables`` and then make them current, all at once."""
        version = uuid.uuid4().hex[:12]
        state = self._state()
        folders = {}
        for name, df in tables.items():
            schema = SCHEMAS[name]
            have = set(df.columns)
            shaped = df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
            folders[name] = f"{name}/v={version}"
            shaped.write.parquet(f"{self.path}/{folders[name]}")
        self._point({"version": version, "tables": state["tables"] | folders, "meta": state["meta"] | meta})
        return version

    @property
    def vectors_snapshot(self) -> str | None:
        return self._state()["tables"].get("vectors")

    def check_dimension(self, dim: int) -> None:
        known = self.meta.get("dim")
        if known is not None and known != dim:
            raise DimensionMismatch(f"the store has {known}, not {dim}")

    def vacuum(self) -> int:
        """Delete the folders that no table points to; how many."""
        current, gone = set(self._state()["tables"].values()), 0
        for name in SCHEMAS:
            at = self._path(f"{self.path}/{name}")
            if self._fs.exists(at):
                for status in self._fs.listStatus(at):
                    folder = f"{name}/{status.getPath().getName()}"
                    if folder not in current:
                        self._fs.delete(status.getPath(), True)
                        gone += 1
        return gone
