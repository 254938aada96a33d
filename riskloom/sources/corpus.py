"""Writing and reading a folder of text files."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.plans.lineage import file_system, materialise

# Python tasks carry this module's helpers with them, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Sub-folders that files are dealt to by their name, so that no folder gets too long to list.
FOLDERS = 256
#: Stands for a name that is missing or empty.
UNNAMED = "__HIVE_DEFAULT_PARTITION__"
#: Most files and bytes that a task reads on average, and that it hands on at a time.
TASK_FILES, TASK_BYTES, BATCH_FILES, BATCH_BYTES = 4096, 64 << 20, 1024, 4 << 20
#: Folders of a level that a task lists where there are many, and tasks where there are few.
LIST_FOLDERS, LIST_TASKS = 64, 24
#: What stands in a URI's path as it is, besides letters and digits.
KEPT = "/;:@&=+$,-_.!~*'()"


def write_text_corpus(texts: DataFrame, folder: str, folders: int = FOLDERS) -> int:
    """Stores ``texts(name, content)`` as files ``doc=<name>.<task>.txt`` below ``folder`` and returns their number.

    Tasks write the files in place, so nothing is moved or listed by the driver, and a task that is run again
    writes the same ones. Rows of one name in a task are lines of one file; every text ends with a line feed.
    """
    named = texts.select(F.coalesce(F.nullif("name", F.lit("")), F.lit(UNNAMED)).alias("name"), F.coalesce("content", F.lit("")).alias("content"))
    place = F.pmod(F.xxhash64("name"), F.lit(folders)).cast("int").alias("place")

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, (fs, root), made = TaskContext.get().partitionId(), file_system(folder), set()
        last, out = None, None
        for frame in frames:
            files = 0
            for where, name, content in zip(frame["place"], frame["name"], frame["content"]):
                if name != last:
                    if out is not None:
                        out.close()
                    if where not in made:
                        fs.create_dir(f"{root}/{where}", recursive=True)
                        made.add(where)
                    out = fs.open_output_stream(f"{root}/{where}/doc={quote(name, safe='')}.{task}.txt")
                    last, files = name, files + 1
                out.write(f"{content}\n".encode())
            yield pd.DataFrame({"files": [files]})
        if out is not None:
            out.close()

    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    stored = named.select(place, "name", "content").sortWithinPartitions("name").mapInPandas(store, "files bigint")
    return stored.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def read_text_corpus(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """Whole files below ``folder`` as ``path, filename, content``.

    ``path`` stays unique where two sub-folders hold the same file name. Tasks list the folders, one level at a time,
    and read the files, so the driver holds no list of them. What only Spark can open, such as a path with
    wildcards, Spark lists.
    """
    where = _opened(folder)
    if where is None or any(c in folder + suffix for c in "*?[]{}\\"):
        files = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{suffix}", recursiveFileLookup=True)
        return files.select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("filename"),
            F.col("value").alias("content"),
        )
    files = _listed(spark, folder, where, suffix)
    count, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, -(-count // TASK_FILES), -(-size // TASK_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, kept, held = file_system(folder)[0], [], 0
        for batch in batches:
            for place, path, name in zip(*(batch.column(c).to_pylist() for c in ("place", "path", "filename"))):
                with fs.open_input_stream(place) as source:
                    kept.append((path, name, source.read()))
                held += len(kept[-1][2])
                if held >= BATCH_BYTES or len(kept) >= BATCH_FILES:
                    yield _batch(kept)
                    kept, held = [], 0
        if kept:
            yield _batch(kept)

    texts = files.select("place", "path", "filename").repartition(tasks, "path").mapInArrow(
        read, "path string, filename string, content binary")
    return texts.withColumn("content", F.col("content").cast("string"))


def _batch(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))],
                                      ["path", "filename", "content"])


def _opened(folder: str) -> str | None:
    """The folder's place in its file system, if tasks can list it themselves."""
    try:
        fs, place = file_system(folder)
        return place.rstrip("/") if fs.get_file_info(place).type == FileType.Directory else None
    except (pa.ArrowException, OSError):
        return None


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _encoded(path: str) -> str:
    """A path as in ``_metadata``: ASCII signs that no URI has, and other blanks and control signs, are escaped."""
    return "".join(c if ord(c) > 127 and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc") else quote(c, safe=KEPT) for c in path)


def _listed(spark: SparkSession, folder: str, root: str, suffix: str) -> DataFrame:
    """``place, path, filename, size`` of the files below ``folder``, stored; empty files are left out, as Spark does."""
    above = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = above.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(above).toUri()
    start = "".join((uri.getScheme(), ":", f"//{uri.getAuthority()}" if uri.getAuthority() else "", _encoded(uri.getPath().rstrip("/"))))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs = file_system(folder)[0]
        for frame in frames:
            for place in frame["place"]:
                rows = []
                for found in fs.get_file_info(FileSelector(place)):
                    is_folder, name = found.type == FileType.Directory, found.base_name
                    if not _hidden(name) and (is_folder or (found.size and name.endswith(suffix))):
                        rows.append((found.path, start + _encoded(found.path[len(root):]), _encoded(name), found.size or 0, is_folder))
                yield pd.DataFrame(rows, columns=["place", "path", "filename", "size", "is_folder"])

    def level(folders: DataFrame) -> DataFrame:
        return materialise(folders.mapInPandas(
            look, "place string, path string, filename string, size bigint, is_folder boolean"), "listed")

    found = level(spark.createDataFrame([(root,)], "place string"))
    levels = [found]
    while folders := found.where("is_folder").count():
        found = level(found.where("is_folder").select("place").repartition(
            min(folders, max(LIST_TASKS, folders // LIST_FOLDERS)), "place"))
        levels.append(found)
    return functools.reduce(DataFrame.unionByName, levels).where("NOT is_folder")
