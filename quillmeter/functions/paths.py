"""Paths of workspaces and files.  Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_workspace(raw: Column) -> Column:
    """Trimmed, with single forward slashes and none at the end; lower case only
    for drive-letter and UNC paths; a bare drive keeps its slash; blank is null."""
    text = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    slashed = F.replace(text, F.lit("\\"), F.lit("/"))
    unc, drive = slashed.startswith("//"), slashed.rlike(r"^[A-Za-z]:(/|$)")
    single = F.concat(F.when(unc, F.lit("/")).otherwise(F.lit("")), F.regexp_replace(slashed, "/+", "/"))
    cut = F.regexp_replace(single, "/+$", "")
    kept = F.when(cut == "", F.lit("/")).when(cut.rlike("^[A-Za-z]:$"), F.concat(cut, F.lit("/"))).otherwise(cut)
    return F.when(text != "", F.when(unc | drive, F.lower(kept)).otherwise(kept))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]+[^/\\]*$", "")


def stem(path: Column) -> Column:
    """The file name without its extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
