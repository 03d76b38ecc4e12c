"""Project id and project-relative path out of a scanned file's full path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"


def below(root: str, full_path: Column) -> Column:
    """The decoded path of a scanned file below ``root``."""
    bare = F.lit(root.rstrip("/"))
    plain_root = F.regexp_replace(bare, SCHEME, "/")
    decoded = F.url_decode(F.replace(full_path, F.lit("+"), F.lit("%2B")))
    return F.substring(F.regexp_replace(decoded, SCHEME, "/"), F.length(plain_root) + F.lit(2),
                       F.length(decoded))


def project_of(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def rel_path_of(path: Column) -> Column:
    return F.regexp_replace(path, "^[^/]*/", "")
