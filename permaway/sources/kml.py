"""Drawn paths: a Python data source of Placemarks, and their coordinates as Columns.

``spark.read.format("placemarks").load(paths)`` gives one row per Placemark in
document order, a partition for each file or a few files.  Coordinates stay text there; ``points``
splits and parses them in the engine.

Element names are matched without a prefix in the default namespace.  The
section is the text of the first name below the Placemark, or ``Section_<i>``
where there is none (an empty name stays empty).  All coordinates elements of a
Placemark count, in order.  A malformed file has no Placemarks; DTDs are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from permaway.functions import jsnum
from permaway.paths import files_of, name_of, opened
from permaway.shipping import ship

SCHEMA = "file string, file_ord int, placemark_idx int, section string, description string, coordinates array<string>"


def placemarks(content: bytes | str) -> list[tuple[int, str, str, list[str]]]:
    """(index, section, description, coordinate texts) of every Placemark; none for a malformed document."""
    found: list[dict] = []
    open_: list[dict] = []
    text: list[list[str]] = []  # buffers of the wanted elements that stand open

    def start(tag: str, _: dict) -> None:
        if tag == "Placemark":
            mark = {"coordinates": []}
            found.append(mark)
            open_.append(mark)
        elif open_ and tag in ("name", "description", "coordinates"):
            text.append([])

    def end(tag: str) -> None:
        if tag == "Placemark" and open_:
            open_.pop()
        elif open_ and tag in ("name", "description", "coordinates") and text:
            value = "".join(text.pop())
            for mark in open_:
                if tag == "coordinates":
                    mark["coordinates"].append(value)
                else:
                    mark.setdefault(tag, value)

    def data(s: str) -> None:
        for buffer in text:
            buffer.append(s)

    def refuse(*_) -> None:
        raise ValueError("document type declarations are refused")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, data, refuse
    try:
        parser.Parse(content, True)
    except (expat.ExpatError, ValueError):
        return []
    return [(k, m.get("name", f"Section_{k}"), m.get("description", ""), m["coordinates"]) for k, m in enumerate(found)]


#: Files of one partition at most, and partitions that many files are dealt to before one takes a second.
FILES, PARTITIONS = 100, 200


class _Files(InputPartition):
    def __init__(self, numbers: range, paths: list[str]):
        self.numbers, self.paths = numbers, paths


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def __getstate__(self) -> dict:
        return {}  # a task knows its files from its partition: the reader goes to every task

    def partitions(self) -> list[_Files]:
        n = len(self.paths)
        size = max(1, min(FILES, -(-n // PARTITIONS)))
        return [_Files(range(a, min(a + size, n)), self.paths[a : a + size]) for a in range(0, n, size)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for number, path in zip(partition.numbers, partition.paths, strict=True):
            store, inner = opened(path)
            with store.open_input_stream(inner) as stream:
                content = stream.read()
            for k, section, description, coordinates in placemarks(content):
                yield name_of(path), number, k, section, description, coordinates


class PlacemarkSource(DataSource):
    """Option ``path``: one file, or several separated by line feeds; without a scheme a local one."""

    @classmethod
    def name(cls) -> str:
        return "placemarks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options["path"].split("\n") if p])


def read_placemarks(spark: SparkSession, paths: list[str]) -> DataFrame:
    ship(spark)
    spark.dataSource.register(PlacemarkSource)
    return spark.read.format("placemarks").option("path", "\n".join(files_of(spark, paths))).load()


def parse_documents(documents: DataFrame) -> DataFrame:
    """The same rows from documents that are already a table (file, file_ord, content)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [(f, o, *m) for f, o, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for m in placemarks(c or "")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "file_ord", "placemark_idx", "section", "description", "coordinates"])

    ship(documents.sparkSession)
    return documents.select("file", F.col("file_ord").cast("int"), "content").mapInArrow(run, SCHEMA)


def points(marks: DataFrame) -> DataFrame:
    """One row per coordinate tuple with a numeric longitude and latitude, in document order.

    ``altitude`` is 0 without a third component and NaN where that is no number.
    """
    tuples = F.flatten(F.transform("coordinates", lambda c: F.split(jsnum.trim(c), r"\s+")))
    rows = marks.select("file", "file_ord", "section", "description", "placemark_idx", F.posexplode(tuples).alias("tuple_idx", "_t")).where(F.col("_t") != "")
    parts = F.split("_t", ",")
    rows = rows.withColumn("_p", parts).where(F.size("_p") >= 2)
    number = lambda k: jsnum.parse_float(F.get("_p", F.lit(k)))
    alt = F.when(F.size("_p") > 2, F.coalesce(number(2), F.lit(float("nan")))).otherwise(F.lit(0.0))
    out = rows.select("file", "file_ord", "section", "description", "placemark_idx", "tuple_idx", number(1).alias("latitude"), number(0).alias("longitude"), alt.alias("altitude"))
    return out.where("latitude is not null and longitude is not null")
