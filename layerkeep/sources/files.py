"""Small files by Hadoop's file systems, so that any path Spark reads works; and the policy of artifact paths."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from ..errors import InvalidArgument, NotFound


def check_uri(uri: str, schemes: tuple[str, ...] = ("file",)) -> str:
    """The path, if it is bare or of an allowed scheme."""
    if not uri:
        raise InvalidArgument("the artifact path is empty")
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", uri)
    if m and m[1] not in schemes:
        raise InvalidArgument(f"scheme {m[1]} is not allowed")
    if m and uri == m[0]:
        raise InvalidArgument("the artifact path is empty")
    return uri


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_dir(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise NotFound(f"{path} is missing")
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Written beside and renamed, so readers see the old file or the new one."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        _, beside = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if not fs.rename(beside, p):  # some file systems do not replace
            fs.delete(p, False)
            fs.rename(beside, p)

    def children(self, path: str) -> list[tuple[str, bool]]:
        """(path, whether a folder), sorted by name."""
        fs, p = self._at(path)
        return sorted((s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(p))

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
