"""Small files in the shared store: listing, reading, and putting one that must not be there yet."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if it is not there. Those that begin with a dot or an underscore are files on their way, and left out."""
        fs, p = self._at(path)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in found if n[0] not in "._")

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_if_absent(self, path: str, text: str) -> bool:
        """Whether ``path`` is now this text; false if another writer was first. Readers see the whole file or none.

        The text is written beside it and then given its name: on a local or mounted disk by a hard link, elsewhere by a rename, either of which fails if
        the name is taken. The store must do that in one step, as HDFS does; an object store needs a file system with atomic renames on top.
        """
        fs, p = self._at(path)
        beside = self._at(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")[1]
        fs.mkdirs(p.getParent())
        if fs.getUri().getScheme() == "file":
            mine, name = beside.toUri().getPath(), p.toUri().getPath()
            with open(mine, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(mine, name)
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(mine)
        if fs.exists(p):
            return False
        out = fs.create(beside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            return fs.rename(beside, p)
        finally:
            fs.delete(beside, False)
