"""Files on any file system that Spark reaches, through Hadoop's interface: small notes, existence, renames, listings."""

from __future__ import annotations


class Files:
    """The file system of a path, as seen by the driver of a session."""

    def __init__(self, spark):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def on(self, path: str):
        at = self.path(path)
        return at.getFileSystem(self.conf), at

    def exists(self, path: str) -> bool:
        fs, at = self.on(path)
        return fs.exists(at)

    def read(self, path: str) -> str | None:
        """A small file's text; None without it."""
        fs, at = self.on(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return self.jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str, replace: bool = True) -> bool:
        """Write a small file; without `replace`, False where it is there already (the file system decides who was first)."""
        fs, at = self.on(path)
        try:
            stream = fs.create(at, replace)
        except Exception as error:  # noqa: BLE001  a Java error, told apart by its class
            if not replace and "FileAlreadyExists" in str(error):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def rename(self, old: str, new: str) -> bool:
        """Whether the rename was made; where `new` exists already it isn't."""
        fs, at = self.on(old)
        to = self.path(new)
        fs.mkdirs(to.getParent())
        return not fs.exists(to) and bool(fs.rename(at, to))

    def delete(self, path: str) -> bool:
        fs, at = self.on(path)
        return bool(fs.delete(at, True))

    def children(self, path: str) -> list[str]:
        fs, at = self.on(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def state(self, path: str) -> list[tuple[str, int, int]]:
        """(path, bytes, time of change) of every file at or under a path, or that it matches as a pattern; hidden ones are left out."""
        fs, at = self.on(path)
        out = []
        for top in fs.globStatus(at) or []:
            files = fs.listFiles(top.getPath(), True) if top.isDirectory() else None
            if files is None:
                out.append((top.getPath().toString(), top.getLen(), top.getModificationTime()))
            while files is not None and files.hasNext():
                s = files.next()
                if not s.getPath().getName().startswith((".", "_")):
                    out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(out)
