"""Records of older files under a newer schema: wider types, added fields with defaults, fields that went.

The Parquet reader widens numbers, leaves out what is not asked for, and gives NULL for what a file lacks, file by file
and at any depth. What is added here are the rules of what may become what, and the defaults: one scan and one
projection, however many generations of files there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT = "default"
# Fixed value: the metadata that Spark takes for the value of a top-level column in files without it.
_IN_OLD_FILES = "EXISTS_DEFAULT"

# What the Parquet reader reads as a wider type without loss.
WIDER = {
    "tinyint": ("smallint", "int", "bigint", "double"), "smallint": ("int", "bigint", "double"),
    "int": ("bigint", "double"), "float": ("double",), "date": ("timestamp_ntz",),
}


def field(name: str, kind: T.DataType | str, default: str | None = None, nullable: bool = True) -> T.StructField:
    """A field whose value in files without it is ``default``, the text of a SQL literal."""
    kind = T.StructType().add(name, kind)[name].dataType
    return T.StructField(name, kind, nullable, {} if default is None else {DEFAULT: default})


def check_update(old: T.DataType, new: T.DataType, where: str = "") -> None:
    """Refuse a schema that files of the old one cannot be read under; the message names the field.

    Numbers may become wider, fields may go, be added if they have a default or may be null, and change their order. A
    nullable field inside a record takes no default but null: a file's null and a field it lacks read alike there. So a
    field inside a record that was nullable and becomes required with a default reads its old nulls as the default.
    """
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        for one in new:
            path = f"{where}.{one.name}" if where else one.name
            if one.name in old.fieldNames():
                check_update(old[one.name].dataType, one.dataType, path)
            elif not one.nullable and DEFAULT not in one.metadata:
                raise ValueError(f"{path} is new and required, and has no default")
            if where and one.nullable and DEFAULT in one.metadata:
                raise ValueError(f"{path} is inside a record: only a required field has a default there")
    elif isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        check_update(old.elementType, new.elementType, f"{where}[]")
    elif isinstance(old, T.MapType) and isinstance(new, T.MapType):
        check_update(old.keyType, new.keyType, f"{where} keys")
        check_update(old.valueType, new.valueType, f"{where} values")
    elif old != new and new.simpleString() not in WIDER.get(old.simpleString(), ()):
        raise ValueError(f"{where} is {old.simpleString()}, cannot become {new.simpleString()}")


def reader_schema(schema: T.StructType) -> T.StructType:
    """The schema to read with; the reader itself fills in top-level fields that a file lacks."""
    return T.StructType([
        T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, _IN_OLD_FILES: f.metadata[DEFAULT]})
        if DEFAULT in f.metadata else f for f in schema])


def with_nested_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Defaults of required fields inside records, arrays and maps, where the reader found NULL for what a file lacks.

    A record that is null itself stays so. Columns without such fields are not touched, so they are pruned as ever.
    """
    filled = {f.name: _filled(F.col(_quoted(f.name)), f.dataType) for f in schema if _has_default(f.dataType)}
    return df.withColumns(filled) if filled else df


def _has_default(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(DEFAULT in f.metadata or _has_default(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _has_default(kind.elementType)
    return isinstance(kind, T.MapType) and _has_default(kind.valueType)


def _filled(value: Column, kind: T.DataType) -> Column:
    if not _has_default(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _filled(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _filled(x, kind.valueType))
    parts = []
    for f in kind:
        part = _filled(value.getField(f.name), f.dataType)
        if DEFAULT in f.metadata:
            part = F.coalesce(part, F.expr(f.metadata[DEFAULT]).cast(f.dataType))
        parts.append(part.alias(f.name))
    return F.when(value.isNotNull(), F.struct(*parts))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
