"""Getting a session ready for the library."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: send its source once per application."""
    context = spark.sparkContext
    if getattr(context, "_tickerloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # imported from an archive: already shipped
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tickerloom-src-"), "tickerloom_src.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("tickerloom", os.path.relpath(path, root)))
    context.addPyFile(target)
    context._tickerloom_shipped = True
