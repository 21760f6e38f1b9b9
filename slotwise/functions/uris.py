"""Dataset and view URIs: ``view:hive:example/events?year=2015&month=5``."""

from __future__ import annotations

from typing import NamedTuple
from urllib.parse import parse_qsl

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_view_uri(uri: Column, decode: bool = False) -> Column:
    """Struct of kind, store, authority, path and a map of the constraints (empty without a query).

    Any text gives a struct: of a repeated key the last value counts, a constraint without ``=`` is NULL, and what
    a text lacks is NULL. Constraint values are as written; ``decode=True`` resolves their percent escapes.
    """
    pieces = F.split(uri, ":", 3)
    rest = F.get(pieces, 2)
    target = F.substring_index(rest, "?", 1)
    query = F.substr(rest, F.length(target) + 2)
    pairs = _last_values(F.transform(F.filter(F.split(query, "&"), lambda pair: pair != ""), _pair))
    if decode:
        pairs = F.transform_values(pairs, lambda _, value: F.try_url_decode(value))
    return F.struct(
        F.get(pieces, 0).alias("kind"),
        F.get(pieces, 1).alias("store"),
        F.nullif(F.regexp_extract(target, "^//([^/]*)", 1), F.lit("")).alias("authority"),
        F.regexp_replace(target, F.when(F.get(pieces, 1) == "hive", "^//[^/]*/?|^/").otherwise("^//[^/]*"), F.lit(""))
        .alias("path"),
        F.when(F.length(query) > 0, pairs)
        .otherwise(F.create_map().cast("map<string,string>")).alias("constraints"),
    )


def _pair(text: Column) -> Column:
    key = F.substring_index(text, "=", 1)
    value = F.when(F.contains(text, F.lit("=")), F.substr(text, F.length(key) + 2))
    return F.struct(key.alias("key"), value.alias("value"))


def _last_values(pairs: Column) -> Column:
    """A map of pairs; a key that comes again replaces its earlier value, whatever the session says of such keys.

    The pairs are bound to a name, so they are worked out once; only among repeated keys is the last one looked for.
    """
    def as_map(bound: Column) -> Column:
        keys = F.transform(bound, lambda pair: pair.key)
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), bound).otherwise(
            F.get(F.transform(F.array(F.reverse(keys)), lambda back: F.filter(
                bound, lambda pair, i: F.array_position(back, pair.key) == F.size(back) - i)), F.lit(0))))

    return F.get(F.transform(F.array(pairs), as_map), F.lit(0))


def quoted(name: str) -> str:
    """A dotted catalog name with each part quoted."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


class Uri(NamedTuple):
    """One parsed URI."""

    kind: str
    store: str
    authority: str
    path: str
    constraints: dict[str, str]

    @property
    def table(self) -> str | None:
        """Catalog name for the ``hive`` store, quoted for SQL; None for a path."""
        return quoted(self.path.strip("/").replace("/", ".")) if self.store == "hive" else None

    @property
    def dataset(self) -> str:
        """One name for the dataset, however its URI is written: ``file:/x`` for ``file:///x`` as well."""
        return f"{self.store}:" + (f"//{self.authority}/" if self.authority else "") + (
            self.path.lstrip("/") if self.store == "hive" or self.authority else self.path)

    @property
    def location(self) -> str:
        """Folder of a path store."""
        if self.store == "file" and not self.authority:
            return "file://" + self.path
        return f"{self.store}://{self.authority}{self.path}"


def split_uri(uri: str) -> Uri:
    """:func:`parse_view_uri` for one URI; holes (``${YEAR}``) are kept as they are."""
    base, _, query = uri.partition("?")
    kind, _, rest = base.partition(":")
    store, _, rest = rest.partition(":")
    if kind not in ("dataset", "view") or not store or not rest:
        raise ValueError(f"not a dataset or view URI: {uri!r}")
    authority = ""
    if rest.startswith("//"):
        authority, slash, path = rest[2:].partition("/")
        rest = slash + path
    if store == "hive":
        rest = rest.removeprefix("/")
    return Uri(kind, store, authority, rest, dict(parse_qsl(query, keep_blank_values=True, strict_parsing=bool(query))))
