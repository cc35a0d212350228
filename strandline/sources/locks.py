"""A lock for builds of one key: a file that only one of several drivers can create, on the shared file system."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

LIFETIME = 900  # seconds, after which a lock that its owner has not given back counts for nothing


def _create(fs, path, token: str) -> bool:
    """Whether the file was made here; it holds the owner's token."""
    try:
        out = fs.create(path, False)
    except Py4JJavaError:
        if fs.exists(path):
            return False
        raise
    out.write(bytearray(token.encode()))
    out.close()
    return True


def _token(spark: SparkSession, fs, path) -> str | None:
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


@contextmanager
def build_lock(spark: SparkSession, folder: str, key: str, lifetime: float = LIFETIME) -> Iterator[bool]:
    """REV-12: yields whether this caller holds the lock of `key`. An expired lock is moved aside, which only one caller
    can do, and taken anew; on leaving, a lock is deleted only if it still holds our token. A folder that cannot be
    reached leaves the build open."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path, token, held, fs = hadoop.Path(f"{folder}/{key}.lock"), uuid.uuid4().hex, True, None
    try:
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path.getParent())
        held = _create(fs, path, token)
        if not held and fs.getFileStatus(path).getModificationTime() < (time.time() - lifetime) * 1000:
            aside = hadoop.Path(f"{folder}/{key}.{token}.expired")
            if fs.rename(path, aside):
                fs.delete(aside, False)
                held = _create(fs, path, token)
    except Py4JJavaError:
        fs = None
    try:
        yield held
    finally:
        if held and fs is not None and _token(spark, fs, path) == token:
            fs.delete(path, False)
