"""Uploaded documents: a landing folder that the file stream reads, and reading a stored file back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Content types that are taken.
CONTENT_TYPES = ("application/pdf", "application/octet-stream")


class UnsupportedMediaType(ValueError):
    """For HTTP servers: status 415."""

    status = 415


def land(spark: SparkSession, folder: str, data: bytes, content_type: str) -> str:
    """Stores a document under a name of its own in the folder and gives its path; other content types are refused.

    The file appears under its final name when it is complete, so a stream never reads half of it.
    """
    if content_type not in CONTENT_TYPES:
        raise UnsupportedMediaType(content_type)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    name = f"ingest_{uuid.uuid4().hex[:8]}.pdf"
    part, whole = path_of(f"{folder}/_{name}.part"), path_of(f"{folder}/{name}")
    fs = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part)
    out.write(bytearray(data))
    out.close()
    fs.rename(part, whole)
    return whole.toString()


def stored(spark: SparkSession, path: str) -> bytes:
    """The content of a stored file."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row.content)
