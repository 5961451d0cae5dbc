"""Small files of metadata, on any file system that Spark can reach."""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's files; none if there is no folder."""
    where, fs = _at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def read(spark: SparkSession, path: str) -> str:
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole if there is none of its name; whether it was written.

    The text goes to a file beside it, which then gets the name in one step: by a
    link on a local file system, elsewhere by a rename that does not overwrite.
    """
    where, fs = _at(spark, path)
    beside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    at, _ = _at(spark, beside)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if fs.getScheme() == "file":
            local = lambda p: fs.makeQualified(p).toUri().getPath()
            try:
                os.link(local(at), local(where))
            except FileExistsError:
                return False
            return True
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        kinds = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(at, where, kinds)
        except Exception as e:  # py4j wraps the cause
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
    finally:
        with contextlib.suppress(Exception):
            fs.delete(at, False)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder, if it is there."""
    where, fs = _at(spark, path)
    fs.delete(where, True)
