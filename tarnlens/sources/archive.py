"""Source archives and uploads: guarded members as rows, and where the sources begin."""

from __future__ import annotations

import io
import posixpath
import re
import stat
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Limits of an archive and of a file in it.
MAX_MEMBERS = 5000
MAX_BYTES = 100 * 1024 * 1024
MAX_JAVA_BYTES = 1024 * 1024


class ArchiveError(ValueError):
    pass


def members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of an archive's files; raises before anything is unpacked if a guard is broken."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ArchiveError("not a zip archive") from e
    files = [m for m in archive.infolist() if not m.is_dir()]
    if not files:
        raise ArchiveError("the archive is empty")
    if len(files) > MAX_MEMBERS:
        raise ArchiveError(f"the archive has more than {MAX_MEMBERS} files")
    if sum(m.file_size for m in files) > MAX_BYTES:
        raise ArchiveError(f"the archive unpacks to more than {MAX_BYTES} bytes")
    for m in files:
        name = m.filename.replace("\\", "/")
        if name.startswith("/") or re.match(r"[A-Za-z]:", name) or ".." in name.split("/"):
            raise ArchiveError(f"{m.filename} leaves the archive")
        if stat.S_ISLNK(m.external_attr >> 16):
            raise ArchiveError(f"{m.filename} is a link")
        if m.flag_bits & 1:
            raise ArchiveError(f"{m.filename} is encrypted")
    for m in files:
        yield m.filename.replace("\\", "/"), archive.read(m)


def source_root(names: list[str]) -> str:
    """The one top folder that holds everything, if there are Java files in it; else the archive itself."""
    own = [n for n in names if not n.startswith("__MACOSX/")]
    tops = {n.split("/")[0] for n in own}
    if len(tops) == 1 and all("/" in n for n in own) and any(n.lower().endswith(".java") for n in own):
        return tops.pop() + "/"
    return ""


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(repo, file, content) of the Java and mapper files in zip archives; an archive is one task's work, bounded by MAX_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for repo, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                found = checked(data)
                root = source_root([n for n, _ in found])
                rows = [(repo, n.removeprefix(root), c.decode("utf-8")) for n, c in found if n.lower().endswith(".java")]
                for n, c in found:
                    if n.lower().endswith(".xml"):
                        try:
                            rows.append((repo, n.removeprefix(root), c.decode("utf-8")))
                        except UnicodeDecodeError:
                            continue
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.string()) for x in zip(*rows, strict=True)], names=["repo", "file", "content"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    found = raw.select("path", "content").mapInArrow(run, "repo string, file string, content string")
    return found.filter(F.lower("file").endswith(".java") | F.col("content").rlike(r"(?i)<\s*(?:mapper|sqlMap)\b"))


def inspected(archives: DataFrame) -> DataFrame:
    """(path, n_files, root, error) of archives (path, content): which guard an archive breaks, or where its sources begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    found = checked(data)
                    rows.append((path, len(found), source_root([n for n, _ in found]), None))
                except ArchiveError as e:
                    rows.append((path, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "n_files", "root", "error"])

    return archives.select("path", "content").mapInArrow(run, "path string, n_files int, root string, error string")


def checked(data: bytes) -> list[tuple[str, bytes]]:
    """An archive's files, once all guards of archive and Java files hold."""
    found = list(members(data))
    java = [c for n, c in found if n.lower().endswith(".java")]
    if not java:
        raise ArchiveError("the archive has no Java files")
    if len(java) > MAX_MEMBERS:
        raise ArchiveError(f"the archive has more than {MAX_MEMBERS} Java files")
    if any(len(c) > MAX_JAVA_BYTES for c in java):
        raise ArchiveError(f"a Java file has more than {MAX_JAVA_BYTES} bytes")
    return found


def rejected(name: Column, size: Column) -> Column:
    """Why a single file that is handed in is turned down, or null."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.when(base == "", "no name").when(~F.lower(base).endswith(".java"), "not a Java file").when(size > MAX_JAVA_BYTES, f"more than {MAX_JAVA_BYTES} bytes")


def guarded(files: DataFrame) -> DataFrame:
    """Source files (path, length, ...) of a folder whose Java files hold the guards; a broken one is raised when rows are read.

    The number of files is counted before; a folder without Java files is an error too.
    """
    java = F.lower("path").endswith(".java")
    n = files.filter(java).count()
    if not n or n > MAX_MEMBERS:
        raise ArchiveError("no Java files" if not n else f"more than {MAX_MEMBERS} Java files")
    large = F.raise_error(F.concat(F.col("path"), F.lit(f" has more than {MAX_JAVA_BYTES} bytes"))).cast("bigint")
    return files.withColumn("length", F.when(java & (F.col("length") > MAX_JAVA_BYTES), large).otherwise(F.col("length")))


def contained(target: str, workspace: str) -> str | None:
    """A target's absolute path if it lies in the workspace; relative ones begin there."""
    root = posixpath.normpath(workspace)
    path = posixpath.normpath(posixpath.join(root, target))
    return path if path == root or path.startswith(root.rstrip("/") + "/") else None


def repository(url: str) -> tuple[str, str] | None:
    """(owner, name) of a repository's address."""
    m = re.fullmatch(r"https://github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?", url.strip().rstrip("/"))
    return (m[1], m[2]) if m else None


def branch_candidates(default: str | None) -> list[str]:
    return list(dict.fromkeys(b for b in (default, "main", "master") if b))


def displayed(df: DataFrame, root: str, file: str = "file") -> DataFrame:
    """Paths relative to a root."""
    return df.withColumn(file, F.regexp_replace(file, "^(?:file:)?/*" + re.escape(root.strip("/")) + "/", ""))


def numbered_members(df: DataFrame) -> DataFrame:
    """Files of each archive in order of their names."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("file")))
