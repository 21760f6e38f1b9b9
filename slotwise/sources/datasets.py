"""Datasets and views: partitioned Parquet tables in the catalog (``hive`` store) or in folders (any other store)."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from urllib.parse import urlencode

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions.timeparts import HOLES, as_nominal, fill_template
from slotwise.functions.uris import Uri, split_uri
from slotwise.schemas import BATCH_PARTS
from slotwise.session import path_exists
from slotwise.sources.evolution import check_update, reader_schema, with_nested_defaults


# Partition values that stand in a folder's name as they are.
SAFE_VALUE = r"[\w.-]+"


@dataclass(frozen=True)
class View:
    """A dataset, or the part of it that meets the constraints of its URI.

    ``schema`` is the record schema; the catalog knows it for ``hive`` views. ``parts`` names the partition
    columns, outermost first. A constraint value may be a time hole, filled by :meth:`at`.
    """

    uri: str
    schema: T.StructType | None = None
    parts: tuple[str, ...] = ()
    options: Mapping[str, str] | None = None

    @property
    def parsed(self) -> Uri:
        return split_uri(self.uri)

    @property
    def constraints(self) -> dict[str, str]:
        return self.parsed.constraints

    @property
    def name(self) -> str:
        """Dataset name without kind and constraints."""
        return self.uri.partition("?")[0].partition(":")[2]

    @property
    def marks(self) -> str:
        """The name that marks of this view are filed under: the dataset, and the constraints that no time fills.

        It is the same however the URI is written: constraints are sorted, escapes resolved, numbers unpadded.
        """
        fixed = {column: plain_value(value, self.type_of(column))
                 for column, value in sorted(self.constraints.items()) if value not in HOLES}
        return self.parsed.dataset + ("?" + urlencode(fixed) if fixed else "")

    @property
    def slot_parts(self) -> dict[str, str]:
        """Constraint column to time part, for constraints that are holes."""
        return {column: HOLES[value] for column, value in self.constraints.items() if value in HOLES}

    @property
    def full_schema(self) -> T.StructType | None:
        """Record fields, then the partition columns (provided ones are INT)."""
        if self.schema is None:
            return None
        known = set(self.schema.fieldNames())
        added = [T.StructField(part, T.IntegerType()) for part in self.parts if part not in known]
        return T.StructType([*self.schema.fields, *added])

    def type_of(self, column: str) -> T.DataType | None:
        """The type of a column, None where no schema says."""
        schema = self.full_schema
        return schema[column].dataType if schema is not None and column in schema.fieldNames() else None

    def known(self, spark: SparkSession) -> View:
        """The view with the schema and parts of its catalog table; a path view as it is."""
        if self.parsed.table is None or not spark.catalog.tableExists(self.parsed.table):
            return self
        columns = spark.catalog.listColumns(self.parsed.table)
        parts = tuple(c.name for c in columns if c.isPartition)
        return replace(self, schema=spark.table(self.parsed.table).schema, parts=parts or self.parts)

    def slot_value(self, column: str) -> Column:
        """The value a constraint gives a partition column, as its type; a number is an INT where no schema says."""
        value = self.constraints[column]
        kind = self.type_of(column)
        if kind is not None:
            return F.lit(value).cast(kind)
        return F.lit(int(value)) if value.isdigit() else F.lit(value)

    def at(self, nominal_time: str | dt.datetime) -> View:
        return replace(self, uri=fill_template(self.uri, as_nominal(nominal_time)))

    def dataset(self) -> View:
        """The whole dataset behind the view."""
        return replace(self, uri=self.uri.partition("?")[0])


def as_view(view: View | str) -> View:
    return view if isinstance(view, View) else View(view)


def is_number(value: str, kind: T.DataType | None) -> bool:
    """Whether a partition value is a whole number: its column's type decides, the digits only where none is known."""
    return value.isdigit() and (kind is None or isinstance(kind, T.IntegralType))


def plain_value(value: str, kind: T.DataType | None) -> str:
    """A partition value as it names a folder: numbers unpadded, text as it is."""
    return str(int(value)) if is_number(value, kind) else value


def read_dataset(spark: SparkSession, view: View | str) -> DataFrame:
    """Every record of the dataset a URI names, constraints left aside."""
    return load(spark, as_view(view).dataset())


def read_view(spark: SparkSession, view: View | str) -> DataFrame:
    """The records that meet all constraints of the URI; empty when no folder matches.

    Constraints on leading partition columns pick the folders to list, so one slot of a large table costs one
    listing; the rest are filters.
    """
    view = as_view(view)
    if any("${" in value for value in view.constraints.values()):
        raise ValueError(f"{view.uri} still has holes: give a nominal time")
    folders = []
    for part in view.parts:
        value = view.constraints.get(part, "")
        if not re.fullmatch(SAFE_VALUE, value):
            break
        kind = view.type_of(part)
        folders.append((part, int(value) if is_number(value, kind) else value))
    return refine(load(spark, view, folders), **view.constraints)


def read_at(spark: SparkSession, template: View | str, nominal_time: str | dt.datetime) -> DataFrame:
    """The view a template names at a nominal time."""
    return read_view(spark, as_view(template).at(nominal_time))


def refine(df: DataFrame, **equal) -> DataFrame:
    """Narrow to rows whose fields have the given values; partition and data fields alike."""
    condition: Column | None = None
    for field, value in equal.items():
        test = F.col(field) == F.lit(value).cast(df.schema[field].dataType)
        condition = test if condition is None else condition & test
    return df if condition is None else df.where(condition)


def covering_partitions(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The partitions that the rows of ``df`` lie in. It goes over every row; :func:`list_partitions` does not."""
    return df.select(*parts).distinct()


def list_partitions(spark: SparkSession, view: View | str) -> DataFrame:
    """The partitions of a dataset by name: from the catalog, or from the names of its files. No file is opened.

    Writers of this package leave no file in a slot without rows. Another writer's empty file counts as a partition
    that is there, as it does in a catalog.
    """
    view = as_view(view).dataset()
    if view.parsed.table is None:
        return list_files(spark, view).select(*view.parts).distinct()
    view = view.known(spark)
    names = spark.sql(f"SHOW PARTITIONS {view.parsed.table}").select(F.concat("partition", F.lit("/")).alias("path"))
    return names.select(*(_part_of_path(F.concat(F.lit("/"), "path"), p, view.type_of(p)).alias(p) for p in view.parts))


def list_files(spark: SparkSession, view: View, folders: Sequence[tuple[str, int | str]] = ()) -> DataFrame:
    """``path`` and partition values of the files of a path dataset, or below one of its folders; none is opened."""
    path = "/".join([view.parsed.location, *(_folder(*f) for f in folders)])
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    files = reader.load(path).select("path")
    return files.select("path", *(_part_of_path(F.col("path"), p, view.type_of(p)).alias(p) for p in view.parts))


def _part_of_path(path: Column, part: str, kind: T.DataType | None) -> Column:
    text = F.regexp_extract(path, f"/{re.escape(part)}=([^/]*)/", 1)
    value = F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.nullif(value, F.lit("__HIVE_DEFAULT_PARTITION__")).cast(kind or T.StringType())


def load(spark: SparkSession, view: View, folders: Sequence[tuple[str, int | str]] = ()) -> DataFrame:
    """A dataset, or what lies below one of its folders; a catalog table knows its folders itself.

    A dataset that streams write has further folders, one per batch, below its own partitions; these are read
    through and not shown. Files of older schemas are read under the view's: see :mod:`slotwise.sources.evolution`.
    """
    rows = _load(spark, view, folders)
    schema = view.full_schema if view.parsed.table is None else spark.table(view.parsed.table).schema
    if schema is not None:
        rows = with_nested_defaults(rows, schema)
    if view.schema is not None and view.parts and set(BATCH_PARTS) <= set(rows.columns):
        return rows.drop(*(set(BATCH_PARTS) - set(view.full_schema.fieldNames())))
    return rows


def _load(spark: SparkSession, view: View, folders: Sequence[tuple[str, int | str]]) -> DataFrame:
    if view.parsed.table is not None:
        return spark.table(view.parsed.table)
    reader = spark.read.options(**(view.options or {}))
    if view.full_schema is not None:
        reader = reader.schema(reader_schema(view.full_schema))
    root = view.parsed.location
    if not folders:
        return reader.parquet(root)
    try:
        return reader.option("basePath", root).parquet("/".join([root, *(_folder(*f) for f in folders)]))
    except AnalysisException as error:
        # Without a folder the slot is empty; without the dataset's own folder it is an error.
        if error.getCondition() != "PATH_NOT_FOUND" or not path_exists(spark, root):
            raise
    if view.full_schema is not None:
        return spark.createDataFrame([], view.full_schema)
    return reader.parquet(root).where(F.lit(False))


def _folder(part: str, value: int | str) -> str:
    """``month=5`` as written here, or ``month=05`` as other writers pad it; text is what it is."""
    return f"{part}={{{value},0{value}}}" if isinstance(value, int) and value < 10 else f"{part}={value}"


def ensure_dataset(spark: SparkSession, view: View, location: str | None = None) -> View:
    """Create the dataset if it is missing, else give it the view's schema, if files of its present one can be read so.

    Types may become wider, fields may be added and may go, at any depth; :func:`check_update` refuses the rest. Rows
    written before a field was added have its default there, or NULL. The location stays as it is unless one is given.
    Partition columns stay. A folder needs nothing but the new schema on the reader.
    """
    table = view.parsed.table
    if table is None:
        return view
    if view.schema is None:
        raise ValueError(f"{view.uri}: a dataset needs a schema")
    if not spark.catalog.tableExists(table):
        if "`.`" in table:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.rpartition('.')[0]}")
        columns = ", ".join(_ddl(field) for field in view.full_schema)
        partitioned = f" PARTITIONED BY ({', '.join(map(quoted_column, view.parts))})" if view.parts else ""
        at = f" LOCATION {text_literal(location)}" if location else ""
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet{partitioned}{at}")
        return view
    known = view.known(spark)
    present, parts = known.schema, [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    wanted = T.StructType([f for f in view.full_schema if f.name not in parts])
    try:
        check_update(T.StructType([f for f in present if f.name not in parts]), wanted)
        for part in set(parts) & set(view.full_schema.fieldNames()):
            if present[part].dataType != view.full_schema[part].dataType:
                raise ValueError(f"{part} is a partition column, cannot become {view.full_schema[part].dataType.simpleString()}")
        if view.parts and list(view.parts) != parts:
            raise ValueError(f"the partition columns are {', '.join(parts) or 'none'}")
    except ValueError as error:
        raise ValueError(f"{table}: {error}") from None
    _set_record_schema(spark, table, wanted)
    if location:
        spark.sql(f"ALTER TABLE {table} SET LOCATION {text_literal(location)}")
    return view


def _set_record_schema(spark: SparkSession, table: str, schema: T.StructType) -> None:
    """One update of the catalog's entry; SQL can only add columns. Columns may all be null in a table of files."""
    columns = reader_schema(T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema]))
    database, _, name = table.replace("`", "").rpartition(".")
    jvm_schema = spark._jvm.org.apache.spark.sql.types.DataType.fromJson(columns.json())
    spark._jsparkSession.sharedState().externalCatalog().alterTableDataSchema(
        database or spark.catalog.currentDatabase(), name, jvm_schema)
    spark.catalog.refreshTable(table)


def _ddl(field: T.StructField) -> str:
    return f"{quoted_column(field.name)} {field.dataType.simpleString()}"


def quoted_column(name: str) -> str:
    """A column's name, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
