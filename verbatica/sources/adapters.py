"""Pluggable sources: what a reader of another system has to say and to give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Declared kinds of metadata fields, and the type each is read as.
KINDS = {"string": "string", "int": "long", "float": "double", "bool": "boolean", "delimiter_joined_string": "array<string>", "json_string": "map<string,string>"}


@dataclass(frozen=True)
class FieldSpec:
    name: str
    kind: str = "string"
    required: bool = False
    delimiter: str = ";"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: unknown kind {self.kind}")

    def column(self) -> Column:
        """The raw text of the field as its declared type."""
        raw = F.col(self.name).cast("string")
        if self.kind == "delimiter_joined_string":
            value = F.filter(F.split(raw, f"\\Q{self.delimiter}\\E"), lambda s: s != "")
        elif self.kind == "json_string":
            value = F.from_json(raw, KINDS[self.kind])
        else:
            value = raw.try_cast(KINDS[self.kind])
        return value.alias(self.name)


@dataclass
class SourceAdapter:
    """A named reader: ingest gives rows with id, text, source_file and the declared fields."""

    name: str
    version: str
    ingest: Callable[[SparkSession, str], DataFrame]
    fields: list[FieldSpec] = field(default_factory=list)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """Typed rows; those without a required field are left out; each says which adapter read it, and has a stable id."""
        raw = self.ingest(spark, path)
        plain = [c for c in raw.columns if c not in {f.name for f in self.fields}]
        typed = raw.select(*plain, *[f.column() for f in self.fields])
        for f in self.fields:
            if f.required:
                typed = typed.where(F.col(f.name).isNotNull())
        ident = F.concat(F.substring(F.sha2("source_file", 256), 1, 24), F.lit("_"), F.coalesce(F.col("chunk_index"), F.lit(0)).cast("string")) if "chunk_index" in plain else F.substring(F.sha2("source_file", 256), 1, 24)
        return typed.withColumn("drawer_id", ident).withColumn("adapter_name", F.lit(self.name)).withColumn("adapter_version", F.lit(self.version))

    def summary(self, spark: SparkSession, path: str) -> DataFrame:
        return self.read(spark, path).agg(F.count("*").alias("n"), F.countDistinct("source_file").alias("n_sources"))


class Adapters:
    """Adapters by name; the explicit choice goes before the configured one, and that before the default."""

    def __init__(self, default: str | None = None):
        self.known: dict[str, SourceAdapter] = {}
        self.default = default

    def register(self, adapter: SourceAdapter) -> None:
        self.known[adapter.name] = adapter

    def resolve(self, explicit: str | None = None, configured: str | None = None) -> SourceAdapter:
        name = explicit or configured or self.default
        if name not in self.known:
            raise KeyError(f"no adapter {name}; there are {', '.join(sorted(self.known)) or 'none'}")
        return self.known[name]
