"""Paths of data files and of metadata."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.model import TableError

#: Directories that hold a format's metadata though their names don't start with _ or a dot.
METADATA_NAMES = frozenset({"metadata", "schema", "snapshot", "manifest"})
#: Schemes that name the same store.
SAME = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfs", "abfss": "abfs"}
_scheme = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(?=/)")


def is_metadata_name(name: str) -> bool:
    return name.startswith(("_", ".")) or name in METADATA_NAMES


def is_metadata_path(relative: str) -> bool:
    return any(is_metadata_name(part) for part in relative.split("/") if part)


def join(base: str, *parts: str) -> str:
    return "/".join([base.rstrip("/"), *(p.strip("/") for p in parts if p.strip("/"))])


def comparable(path: str) -> str:
    """Scheme and host in one spelling, single slashes; local paths without scheme."""
    m = _scheme.match(path)
    scheme, rest = (m[1].lower(), path[m.end() :]) if m else ("file", path)
    scheme = SAME.get(scheme, scheme)
    if scheme == "file":
        return "/" + rest.lstrip("/")
    host, _, tail = rest.lstrip("/").partition("/")
    host = host.lower().replace(".blob.", ".dfs.")
    return f"{scheme}://{host}/{tail.lstrip('/')}"


def relative(path: str, base: str) -> str:
    """The path below the base, which must end at a separator in it."""
    a, b = comparable(path), comparable(base).rstrip("/") + "/"
    if not a.startswith(b) or len(a) == len(b):
        raise TableError(f"{path} isn't below {base}")
    return a[len(b) :]


def resolve(path: str, base: str) -> str:
    """A path of a log entry: escapes undone, and below the base unless it is absolute."""
    path = unquote(path)
    return path if path.startswith("/") or _scheme.match(path) else join(base, path)


def decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def resolved(path: Column, base: str) -> Column:
    """`resolve` as an expression."""
    plain = decoded(path)
    return F.when(plain.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:/)"), plain).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), plain))


def local_form(path: Column) -> Column:
    """Paths of local files in one spelling, with or without scheme; others as they are."""
    return F.regexp_replace(path, r"^file:/+", "/")


def hive_values(relative_path: Column) -> Column:
    """`k=v` directories as a map, outermost first; other directories are skipped. The null marker is null."""
    parts = F.filter(F.split(relative_path, "/"), lambda p: p.contains("="))
    key = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: decoded(F.substring(p, F.locate("=", p) + 1, F.length(p)))
    pairs = F.transform(parts, lambda p: F.struct(key(p).alias("key"), F.when(value(p) != "__HIVE_DEFAULT_PARTITION__", value(p)).alias("value")))
    return F.map_from_entries(pairs)
