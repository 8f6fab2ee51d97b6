"""Numbered commits in a folder: small JSON files, each of which only one writer can create, and which appear whole."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """Another writer has made this commit."""


def give_name(beside: str, name: str) -> None:
    """Gives a whole file a second name; FileExistsError when there is such a file."""
    try:
        os.link(beside, name)
    except FileExistsError:
        raise
    except OSError:  # no second names in this folder
        with open(beside, "rb") as whole, open(name, "xb") as out:
            shutil.copyfileobj(whole, out)
            out.flush()
            os.fsync(out.fileno())


class Commits:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._jvm, self._gateway = path, spark._jvm, spark.sparkContext._gateway
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(path))

    def last(self) -> int:
        """The greatest number committed; 0 without any."""
        names = (x.getPath().getName() for x in self._fs.listStatus(self._path(self.path)))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _file(self, number: int) -> str:
        return f"{self.path}/{number:012d}"

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(self._file(number)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, number: int, content: dict) -> None:
        """Fails when the commit is there, so of two writers that read the same last commit one is refused.

        The content is written beside and then takes its name in one step that never overwrites, so a writer that dies leaves
        either the whole commit or none.
        """
        beside = f"{self.path}/.{uuid.uuid4().hex}"
        if self._fs.getUri().getScheme() == "file":
            made = self._link(beside, self._file(number), json.dumps(content))
        else:
            made = self._rename(beside, self._file(number), json.dumps(content))
        if not made:
            raise Taken(f"commit {number}")

    @staticmethod
    def _link(beside: str, name: str, text: str) -> bool:
        """In a folder of the operating system a second name is given, which fails when it is in use.

        Where a mounted folder has no second names, the file is created under its name, which only one writer can do.
        """
        beside, name = (unquote(urlparse(x).path) if x.startswith("file:") else x for x in (beside, name))
        with open(beside, "w") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            give_name(beside, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(beside)

    def _rename(self, beside: str, name: str, text: str) -> bool:
        """Elsewhere the file is renamed without overwriting, which the file system does as one step."""
        out = self._fs.create(self._path(beside), False)
        out.write(bytearray(text.encode()))
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = getattr(fs, "Options$Rename")
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(self._path(beside), self._path(name), options)
            return True
        except Exception as e:
            self._fs.delete(self._path(beside), False)
            if self._fs.exists(self._path(name)):
                return False
            raise OSError(f"{name} can't be written") from e
