"""Files that Spark's scans leave out: hidden names and empty files.

Only the session's Hadoop file system sees them, so they are listed through it, on the driver as
Spark's own listing is. One call per level of folders finds hidden names; other names are not looked at.
What is done to single files is done to several at once, as each waits for the file system.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.session import shared_folder

# Files that are handled at the same time.
_AT_ONCE = 32


def is_hidden(name: str) -> bool:
    """Whether a scan passes over a file or folder of this name."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


class Folder:
    """A folder as the session's Hadoop file system shows it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = root.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(root).toString().rstrip("/")

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def glob(self, pattern: str) -> list:
        """Statuses of what matches below the folder; a missing folder matches nothing."""
        plain = "".join("\\" + c if c in "{}[]*?\\" else c for c in self.root)
        found = self.fs.globStatus(self.path(plain + pattern))
        return [] if found is None else found

    def paths(self, pattern: str) -> list[str]:
        """Paths of what matches below the folder."""
        return self.each(lambda status: status.getPath().toString(), self.glob(pattern))

    def each(self, act: Callable, *items: Iterable) -> list:
        """``act`` on all items, some at a time; the first error is raised."""
        with ThreadPoolExecutor(_AT_ONCE) as pool:
            return list(pool.map(act, *items))

    def hidden_files(self) -> list[str]:
        """Paths of all files with a hidden name, or below a folder with one."""
        found, level = set(), ""

        def files(path: str) -> list[str]:
            if self.fs.getFileStatus(self.path(path)).isFile():
                return [path]
            below, inside = self.fs.listFiles(self.path(path), True), []
            while below.hasNext():
                inside.append(below.next().getPath().toString())
            return inside

        while True:
            hits = self.paths(level + "/{[._]*,*._COPYING_}")
            hidden = [path for path in hits if is_hidden(posixpath.basename(path))]
            found.update(*self.each(files, hidden))
            level += "/*"
            if not len(self.glob(level + "/*")):
                return sorted(found)

    def copy(self, source: str, target: str) -> None:
        """A copy of one file, streamed."""
        src, dst = self.path(source), self.path(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(
            self.fs, src, dst.getFileSystem(self.conf), dst, False, self.conf
        )

    def rename(self, source: str, target: str) -> None:
        if not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"{source} could not be renamed to {target}")

    def touch(self, path: str) -> None:
        """A new empty file."""
        self.fs.create(self.path(path)).close()


def staged(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> tuple[str, DataFrame] | None:
    """Copies of the hidden files with these extensions, under names that scans see.

    The folder of copies and a table ``(file_no, path)`` of where they come from; ``None`` where no
    file is hidden. Bytes pass through the driver, a buffer of each of up to ``_AT_ONCE`` files at a time.
    """
    folder = Folder(spark, path)
    files = [
        f for f in folder.hidden_files()
        if posixpath.splitext(f)[1].lower().lstrip(".") in extensions
    ]
    if not files:
        return None
    copies = shared_folder(spark, f"hidden-{uuid.uuid4().hex}")
    names = [f"{copies}/{no}/copy{posixpath.splitext(file)[1]}" for no, file in enumerate(files)]
    folder.each(folder.copy, files, names)
    return copies, spark.createDataFrame(list(enumerate(files)), "file_no long, path string")


def listed(files: DataFrame) -> DataFrame:
    """Paths of the files a scan has listed, also of empty ones, as one column ``path``."""
    spark = files.sparkSession
    # encoded paths hold no line end, so they come over in one piece
    paths = spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", files._jdf.inputFiles())
    rows = spark.createDataFrame([(p,) for p in paths.split("\n") if p], "value string")
    plus = F.replace(F.col("value"), F.lit("+"), F.lit("%2B"))  # a plus is no blank in a path
    # a path without a host has one slash after its scheme where rows name it
    return rows.select(F.regexp_replace(F.url_decode(plus), r"\A([\w+.-]+):///", "$1:/").alias("path"))
