"""Versioned tables: parquet data, one manifest file for each version.

A version is committed by creating the next manifest, which only one writer can
do; readers pin the version that they began with. Data files are never changed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .files import Files
from .partition import Partitioning

# Type names of the dialect and what they are here.
TYPES = {
    "INT": "int", "INT32": "int", "INTEGER": "int", "BIGINT": "bigint", "INT64": "bigint", "FLOAT": "double", "DOUBLE": "double", "REAL": "double",
    "DECIMAL": "double", "NUMERIC": "double", "TEXT": "string", "STRING": "string", "VARCHAR": "string", "CHAR": "string", "BOOL": "boolean",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATETIME": "timestamp_ntz", "DATE": "date", "JSON": "string", "JSONB": "string",
}


class ConflictError(RuntimeError):
    """Another writer committed a version in between."""


@dataclass
class ColumnDef:
    name: str
    type: str
    not_null: bool = False
    default: str | None = None
    auto: bool = False
    declared: str = ""


@dataclass
class TableDef:
    name: str
    columns: list[ColumnDef]
    key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    foreign: list[dict] = field(default_factory=list)
    storage: str = "row"
    partition: dict | None = None
    indexes: dict[str, dict] = field(default_factory=dict)
    paths: list[str] = field(default_factory=list)

    def schema(self) -> StructType:
        return StructType.fromDDL(", ".join(f"`{c.name}` {c.type}" for c in self.columns))

    def column(self, name: str) -> ColumnDef:
        return next(c for c in self.columns if c.name.lower() == name.lower())

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def parse(cls, text: str) -> TableDef:
        d = json.loads(text)
        return cls(**d | {"columns": [ColumnDef(**c) for c in d["columns"]]})


#: Column of the folders of a partitioned table.
PART = "_part"


def partitioning(d: TableDef) -> Partitioning:
    p = d.partition
    return Partitioning(p["kind"], p["column"], [tuple(b) for b in p["bounds"]], [tuple(b) for b in p["lists"]], p["buckets"])


class Store:
    """Tables of one warehouse; a database is a folder of tables."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.root, self.files = spark, warehouse.rstrip("/"), Files(spark)

    def folder(self, db: str, table: str) -> str:
        return f"{self.root}/{db}/{table.lower()}"

    def databases(self) -> list[str]:
        return [n for n in self.files.names(self.root) if not n.startswith(".")]

    def tables(self, db: str) -> list[str]:
        return [t for t in self.files.names(f"{self.root}/{db}") if self.version(db, t)]

    def version(self, db: str, table: str) -> int:
        """The newest version; 0 where there is none or the newest drops the table."""
        names = [n for n in self.files.names(self.folder(db, table)) if n.startswith("manifest-") and n.endswith(".json")]
        if not names:
            return 0
        last = max(names)
        return 0 if self.files.read(f"{self.folder(db, table)}/{last}") == "dropped" else int(last[9:-5])

    def last(self, db: str, table: str) -> int:
        names = [n for n in self.files.names(self.folder(db, table)) if n.startswith("manifest-") and n.endswith(".json")]
        return int(max(names)[9:-5]) if names else 0

    def load(self, db: str, table: str, version: int) -> TableDef:
        return TableDef.parse(self.files.read(f"{self.folder(db, table)}/manifest-{version:012d}.json"))

    def read(self, d: TableDef, parts: list[str] | None = None) -> DataFrame:
        """The table; of a partitioned one only ``parts`` if they are named."""
        schema = d.schema()
        if not d.paths:
            return self.spark.createDataFrame([], schema)
        # Files written before a column was added or renamed are brought to the schema as they were staged.
        stored = StructType([*schema.fields, StructField(PART, StringType())]) if d.partition else schema
        out = reduce(lambda a, b: a.unionByName(b), [self.spark.read.schema(stored).parquet(p) for p in d.paths])
        if d.partition and parts is not None:
            out = out.where(F.col(PART).isin(parts))
        return out.drop(PART) if d.partition else out

    def stage(self, db: str, table: str, rows: DataFrame, d: TableDef) -> str:
        """Write data that no manifest names yet, a partitioned table's by partition."""
        path = f"{self.folder(db, table)}/data-{uuid.uuid4().hex}"
        if d.partition:
            route = partitioning(d).route()
            rows.withColumn(PART, F.coalesce(route, F.raise_error(F.lit(f"no partition of {table} takes a row")).cast("string"))).write.partitionBy(PART).parquet(path)
        else:
            rows.write.parquet(path)
        return path

    def commit(self, db: str, table: str, base: int, new: TableDef | None) -> int:
        """Make ``new`` (None: dropped) the version after ``base``; ConflictError if there is one already."""
        if not self.files.create(f"{self.folder(db, table)}/manifest-{base + 1:012d}.json", new.dump() if new else "dropped"):
            raise ConflictError(f"{table} has changed since version {base}")
        return base + 1
