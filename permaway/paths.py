"""Addresses of files, the same for Spark and for pyarrow, and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import getpass
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []


def _plain(uri: str) -> str:
    return re.sub("^file:/+", "file:///", uri)


def located(spark: SparkSession, path: str) -> str:
    """The full address of a path, by Spark's own file systems: what has no scheme lies on the default one, for pyarrow as for Spark."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return _plain(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString())


def opened(path: str):
    """The pyarrow file system of a located path, and the path in it; without a scheme the local one."""
    from pyarrow import fs

    m = re.match(r"([A-Za-z][\w+.-]*://[^/]*)(/.*)", path)
    if m is None or m[1] == "file://":
        return fs.LocalFileSystem(), m[2] if m else path
    store, base = fs.FileSystem.from_uri(m[1] + "/")  # the path itself is no part of an address: its characters stand for themselves
    return store, base.rstrip("/") + m[2]


def name_of(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


#: From so many paths of one folder on, the folder is listed once instead of asking for each.
LISTED = 32
#: Bytes that the opening of one of so many files counts as when they are dealt to tasks.
OPENING = 64 << 10


def _inner(spark: SparkSession, folder: str) -> list[str]:
    """The located files of a folder by name: a few calls to the driver's JVM in all, not some for each file."""
    jvm, invoke = spark.sparkContext._jvm, spark.sparkContext._jvm.java.lang.invoke
    status, file_path = (jvm.java.lang.Class.forName(f"org.apache.hadoop.fs.{n}") for n in ("FileStatus", "Path"))

    def function(kind: str, method: str, gives):
        handle = invoke.MethodHandles.publicLookup().findVirtual(status, method, invoke.MethodType.methodType(gives))
        return invoke.MethodHandleProxies.asInterfaceInstance(jvm.java.lang.Class.forName(f"java.util.function.{kind}"), handle)

    at = jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    every = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, len(found))
    jvm.java.lang.System.arraycopy(found, 0, every, 0, len(found))
    inner = jvm.java.util.ArrayList(jvm.java.util.Arrays.asList(every))
    inner.removeIf(function("Predicate", "isDirectory", jvm.java.lang.Boolean.TYPE))
    inner.replaceAll(function("UnaryOperator", "getPath", file_path))
    names = jvm.org.apache.hadoop.util.StringUtils.join("\0", inner)
    return sorted(_plain(n) for n in names.split("\0")) if names else []


def _folders(paths: list[str]) -> dict[str, set[str]]:
    """The folders that many of the paths lie in, and those paths' names there; paths that may not stand as they are written are left out."""
    found: dict[str, set[str]] = {}
    for path in paths:
        folder, _, name = path.rpartition("/")
        if folder and name not in ("", ".", ".."):
            found.setdefault(folder, set()).add(name)
    return {f: names for f, names in found.items() if len(names) >= LISTED}


def files_of(spark: SparkSession, paths: list[str]) -> list[str]:
    """The located files of paths in their order; a folder stands for its files by name, a path that comes again counts once."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    known: dict[str, str] = {}
    for folder in _folders(paths):
        at = jvm.org.apache.hadoop.fs.Path(located(spark, folder))
        if at.getFileSystem(conf).exists(at):
            known.update((f"{folder}/{name_of(p)}", p) for p in _inner(spark, at.toString()))
    found: dict[str, None] = {}
    for path in paths:
        if path in known:
            found[known[path]] = None
            continue
        at = jvm.org.apache.hadoop.fs.Path(located(spark, path))
        store = at.getFileSystem(conf)
        if store.getFileStatus(at).isDirectory():
            found.update(dict.fromkeys(p for p in _inner(spark, at.toString()) if name_of(p)[0] not in "._"))
        else:
            found[_plain(at.toString())] = None
    return list(found)


def decoded(path: Column) -> Column:
    """A path as it stands in _metadata.file_path with its own characters."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _texts(spark: SparkSession, paths: list[str], cost: int | None = None) -> DataFrame:
    """(_path, value) of whole files; ``cost``: the bytes that the opening of a file counts as when files are dealt to tasks."""
    at = spark.newSession() if cost else spark  # the bound is no option of a reader: a session of its own has it
    if cost:
        at.conf.set("spark.sql.files.openCostInBytes", cost)
    texts = at.read.text([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths], wholetext=True, recursiveFileLookup=bool(cost) or None)
    if cost:
        texts = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, texts._jdf.queryExecution().analyzed()), spark)
    return texts.select(F.regexp_replace(decoded(F.col("_metadata.file_path")), "^file:/+", "file:///").alias("_path"), "value")


def whole_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, file_ord, value): each file's name, its place among ``paths``, and its text."""
    files = files_of(spark, paths)
    if not files:
        return spark.createDataFrame([], "file string, file_ord int, value string")
    order = spark.createDataFrame([(p, name_of(p), k) for k, p in enumerate(files)], "_path string, file string, file_ord int")
    # files of one folder are read by its name: named one by one they would be listed in as many tasks, and read in as many as a file counts megabytes
    folders = {f: names for f, names in _folders(files).items() if all(n[0] not in "._" for n in names) and len(names) * 2 > len(_inner(spark, f))}
    rest = [p for p in files if p.rpartition("/")[0] not in folders]
    parts = [_texts(spark, [f], OPENING) for f in folders] + ([_texts(spark, rest)] if rest else [])
    read = functools.reduce(DataFrame.unionByName, parts)
    return read.join(F.broadcast(order), "_path").select("file", "file_ord", "value")  # as many rows as the driver has paths


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where that is unset and all tasks run in this process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return located(spark, named.rstrip("/"))
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return located(spark, f"{tempfile.gettempdir()}/permaway-{getpass.getuser()}")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/permaway/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def drop_dirs() -> None:
    """Deletes what this driver wrote, through Spark's own file systems."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended: the folder then stays for the cluster's own cleaning
            return


atexit.register(drop_dirs)
