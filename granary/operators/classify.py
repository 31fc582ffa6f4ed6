"""Archive formats by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def archive_format(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.endswith(".zip"), "zip")
        .when(low.endswith(".tar.gz") | low.endswith(".tgz"), "tar.gz")
        .when(low.endswith(".tar.bz2") | low.endswith(".tbz2"), "tar.bz2")
        .when(low.endswith(".tar"), "tar")
        .when(low.endswith(".gz"), "gzip")
        .when(low.endswith(".bz2"), "bzip2")
    )
