"""Expressions over file paths, names and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """Last part of a path with either separator; '' when the path ends in one."""
    return F.regexp_extract(path, r"[^/\\]+\z", 0)


def base_name(path: Column) -> Column:
    """Last part of a POSIX path."""
    return F.regexp_extract(path, r"[^/]*\z", 0)


def suffix(path: Column) -> Column:
    """``.ext`` of a POSIX path; '' for dot files and for a trailing dot."""
    return F.regexp_extract(base_name(path), r"(?s)\A.+(\.[^.]+)\z", 1)


def stem(path: Column) -> Column:
    """POSIX file name without its suffix."""
    name = base_name(path)
    return F.left(name, F.length(name) - F.length(suffix(path)))


def extension_class(name: Column) -> Column:
    """Upper-case extension, '' for a trailing dot, NO_EXTENSION without any dot."""
    return F.when(
        name.contains("."), F.upper(F.regexp_extract(name, r"\.([^.]+)\z", 1))
    ).otherwise(F.lit("NO_EXTENSION"))


def extension_label(ext: Column) -> Column:
    """Extension as shown in reports: a blank one gets a name."""
    return F.when(ext == "", F.lit("NO_EXT")).otherwise(ext)


def short_hash(value: Column, keep: int = 16) -> Column:
    """First characters of a hash followed by an ellipsis; NULL stays NULL."""
    return F.concat(F.substring(value, 1, keep), F.lit("..."))


def short_path(path: Column, width: int = 50) -> Column:
    """Paths longer than ``width`` keep their end behind an ellipsis."""
    tail = F.right(path, F.lit(width - 3))
    return F.when(F.length(path) > width, F.concat(F.lit("..."), tail)).otherwise(path)


def manifest_name(uuid: Column, device: Column) -> Column:
    """Default manifest file name of a device: its UUID, else its own name."""
    own = F.concat(base_name(device), F.lit("_manifest.csv"))
    return F.when(uuid != "", F.concat(uuid, F.lit(".csv"))).otherwise(own)


def scan_root(mountpoint: Column, device: Column) -> Column:
    """Where a device is scanned: its mount point, else its device file."""
    return F.when(mountpoint != "", mountpoint).otherwise(
        F.concat(F.lit("/dev/"), base_name(device))
    )


def row_key(*cols: Column) -> Column:
    """Repeatable row id: the same source row gets the same id on every load."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.sha2(F.concat_ws("\0", *parts), 256)
