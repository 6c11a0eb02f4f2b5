"""Folders on whatever file system a path names: listing, moving, removing, and writing a marker once."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder below which datasets are published: a child is there whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _system(self):
        return self._at().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def child(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._system().exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """Names of the entries of a folder; none if it isn't there."""
        system, at = self._system(), self._at(name)
        return sorted(entry.getPath().getName() for entry in system.listStatus(at)) if system.exists(at) else []

    def remove(self, name: str = "") -> None:
        self._system().delete(self._at(name), True)

    def move(self, source: str, target: str) -> None:
        """Rename a child; its new parent is made, and the target must not be there."""
        system, to = self._system(), self._at(target)
        system.mkdirs(to.getParent())
        if system.exists(to) or not system.rename(self._at(source), to):
            raise OSError(f"could not move {self.child(source)} to {self.child(target)}")

    def write_once(self, name: str, text: str) -> bool:
        """Put a small file where there is none yet; False if there is one.

        The text is written beside it first and moved there whole, so a reader never sees a part of it.
        """
        system, target = self._system(), self._at(name)
        if system.exists(target):
            return False
        draft = self._at(f"{name}.{self._jvm.java.util.UUID.randomUUID()}.draft")
        stream = system.create(draft, False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        moved = not system.exists(target) and system.rename(draft, target)
        if not moved:
            system.delete(draft, False)
        return moved

    def read(self, name: str) -> str:
        stream = self._system().open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
