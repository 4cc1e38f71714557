"""Tolerant JSON reading.

Raw text is a DataFrame with a ``value`` column (one line, or one whole file)
plus any carried columns. Each text is parsed once, inside an envelope
``{"doc": [<text>], "end": []}`` read as a map of lists. The text was exactly
one object if the map has two entries and the first one element: text that
goes on after its object, or closes the list or the envelope itself, adds an
element or an entry, or breaks the whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.settings import local_path

# Strict JSON apart from NaN / Infinity literals.
JSON_OPTIONS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}

OK, BLANK, MALFORMED, NOT_OBJECT = "ok", "blank", "malformed", "not_object"


def decoded(path: Column) -> Column:
    """A path as written: %XX escapes resolved (a plus sign is a plus sign)."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_texts(spark: SparkSession, paths: list[str], whole_files: bool = False) -> DataFrame:
    """Lines (or whole files) with their path: columns ``value``, ``path``, ``modified_at``."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(paths, wholetext=whole_files)
        .select(
            "value",
            decoded(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_modification_time").alias("modified_at"),
        )
    )


# --- many small files, listed and read by tasks ------------------------------------------

LISTING_TASKS = 64
DOCUMENT_TASKS = 64  # tasks that write files of one document each


def visible_names() -> Callable[[str], bool]:
    """Whether a file scan takes an entry of a name, by the rule of Spark's own: no hidden ones."""
    def visible(name: str) -> bool:
        hidden = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
        return not hidden or name.startswith(("_metadata", "_common_metadata"))

    return visible


def listed(spark: SparkSession, root: str, enter: Callable[[list[str]], bool]) -> DataFrame | None:
    """Files under a folder (``path``, ``modified_at``, ``bytes``), found by tasks whenever the rows are read.

    A file scan keeps every file's status on the driver, a listing by tasks none.
    ``enter`` gets the names from the folder down to an entry and says whether
    it is taken; it goes to the tasks, so it is no function of a module. None where tasks cannot list: no such folder, or one on another
    file system than that of the machines.
    """
    top = local_path(spark, root)
    if top is None:
        return None
    enough = 1000  # folders of one level that the first task still opens itself

    def opened(folder: str) -> Iterator[tuple[str, bool, int, int]]:
        import os

        try:
            entries = os.scandir(folder)
        except FileNotFoundError:  # gone since it was listed
            return
        below = [p for p in folder[len(top):].split("/") if p]
        with entries:
            for entry in entries:
                if enter([*below, entry.name]):
                    try:
                        inner = entry.is_dir()
                        status = None if inner else entry.stat()
                    except FileNotFoundError:
                        continue
                    if status and not status.st_size:
                        continue  # a scan leaves out empty files
                    yield entry.path, inner, status and status.st_mtime_ns // 1_000_000 * 1000, status and status.st_size

    def rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        from itertools import batched

        for some in batched(found, 10_000):
            path, inner, modified, size = zip(*some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(path, pa.string()), pa.array(inner, pa.bool_()), pa.array(modified, pa.int64()), pa.array(size, pa.int64())],
                ["path", "inner", "modified", "bytes"])

    def first() -> Iterator[tuple]:
        """Level by level, until one has many folders: these are left to the other tasks."""
        level = [top]
        while level:
            below: list[str] = []
            for folder in level:
                for entry in opened(folder):
                    if entry[1] and len(below) < enough:
                        below.append(entry[0])
                    else:
                        yield entry
            if len(below) >= enough:
                yield from ((folder, True, None, None) for folder in below)
                return
            level = below

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns)):
                if not entry[1]:
                    yield entry
                    continue
                todo = [entry[0]]
                while todo:
                    for found in opened(todo.pop()):
                        if found[1]:
                            todo.append(found[0])
                        else:
                            yield found

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from rows(first())

    schema = "path STRING, inner BOOLEAN, modified BIGINT, bytes BIGINT"
    begun = spark.range(0, 1, 1, 1).mapInArrow(start, schema).repartition(LISTING_TASKS)
    found = begun.mapInArrow(lambda batches: rows(rest(batches)), schema)
    return found.select(F.concat(F.lit("file:"), F.col("path")).alias("path"), F.timestamp_micros("modified").alias("modified_at"), "bytes")


def document_texts(files: DataFrame) -> DataFrame:
    """The files of a listing (:func:`listed`) with their whole text as ``value``, opened by the tasks that hold the rows.

    Compressed files are opened by their ending, as a text scan does.
    """
    schema = f"value STRING, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema)}"
    place = files.columns.index("path")
    read = reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin, size = [], 0, 0
            for at, path in enumerate(batch.column(place).to_pylist()):
                texts.append(read(path.removeprefix("file:")))
                size += len(texts[-1])
                if size > 1 << 24 or at + 1 == batch.num_rows:
                    carried = batch.slice(begin, len(texts))
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *carried.columns], ["value", *batch.schema.names])
                    texts, begin, size = [], at + 1, 0

    return files.mapInArrow(run, schema)


def write_documents(texts: DataFrame, folder: str, keys: list[str]) -> None:
    """Every ``value`` as a file of its own in the folders of its keys, in place of what these folders held.

    A Spark writer opens, closes and moves a folder and a file for each of them
    through several calls, which take a hundred times as long. Rows of one
    folder lie in one task, which writes the same again if it is run again.
    """
    spark = texts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    top = local_path(spark, folder)
    rows = texts.select(*[F.col(k).cast("string") for k in keys], "value")
    if top is None:
        (rows.repartition(DOCUMENT_TASKS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*keys).text(folder))
        return

    def escaped(value: str | None) -> str:
        odd = "\"#%'*/:=?\\{[]^\x7f"  # as Spark names folders
        return "".join(f"%{ord(c):02X}" if c < " " or c in odd else c for c in value) if value else "__HIVE_DEFAULT_PARTITION__"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import shutil

        now, names, count = None, [], 0

        def close() -> None:
            """Remove what lay in the folder before and was not written over."""
            if now is not None:
                for name in set(os.listdir(now)) - set(names):
                    gone = f"{now}/{name}"
                    shutil.rmtree(gone) if os.path.isdir(gone) and not os.path.islink(gone) else os.remove(gone)

        for batch in batches:
            *parts, values = (c.to_pylist() for c in batch.columns)
            for value, *part in zip(values, *parts):
                place = "/".join([top, *(f"{k}={escaped(p)}" for k, p in zip(keys, part))])
                if place != now:
                    close()
                    os.makedirs(place, exist_ok=True)
                    now, names = place, []
                names.append(f"part-{len(names):05d}.txt")
                with open(f"{place}/.{names[-1]}.new", "w", encoding="utf-8", newline="") as file:
                    file.write(f"{value or ''}\n")
                os.replace(f"{place}/.{names[-1]}.new", f"{place}/{names[-1]}")
                count += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["files"])

    placed = rows.repartition(DOCUMENT_TASKS, *keys).sortWithinPartitions(*keys, "value")
    placed.mapInArrow(run, "files BIGINT").agg(F.sum("files")).collect()  # one row


def reader() -> Callable[[str], str]:
    """A function from a path to the text of its file. It holds all it needs, so workers take it without the package."""
    def length(data: bytes, at: int, start: int) -> tuple[int, int]:
        """A length of LZ4 that goes on in further bytes, and where it ends."""
        while data[at] == 255:
            start, at = start + 255, at + 1
        return start + data[at], at + 1

    def lz4(data: bytes) -> bytes:
        out, at = bytearray(), 0
        while True:
            plain, same = data[at] >> 4, data[at] & 15
            at += 1
            if plain == 15:
                plain, at = length(data, at, plain)
            out += data[at:at + plain]
            at += plain
            if at >= len(data):
                return bytes(out)
            back, at = int.from_bytes(data[at:at + 2], "little"), at + 2
            if same == 15:
                same, at = length(data, at, same)
            same += 4
            repeated = bytes(out[-back:][:same])
            out += (repeated * (same // len(repeated) + 1))[:same]

    def snappy(data: bytes) -> bytes:
        size = sum((byte & 127) << 7 * k for k, byte in enumerate(data[:1 + next(k for k, b in enumerate(data) if b < 128)]))
        return pa.Codec("snappy").decompress(data, size, asbytes=True)

    def blocks(data: bytes, opened: Callable[[bytes], bytes]) -> bytes:
        """Hadoop's block format: the length of some bytes, then compressed pieces of these with a length each."""
        out, at = [], 0
        while at < len(data):
            left, at = int.from_bytes(data[at:at + 4], "big"), at + 4
            while left > 0:
                size, at = int.from_bytes(data[at:at + 4], "big"), at + 4
                out.append(opened(data[at:at + size]))
                at, left = at + size, left - len(out[-1])
        return b"".join(out)

    def read(path: str) -> str:
        import bz2
        import gzip
        import zlib

        with open(path, "rb") as file:
            data = file.read()
        match path.rpartition("/")[2].rpartition(".")[2]:
            case "gz":
                data = gzip.decompress(data)
            case "bz2":
                data = bz2.decompress(data)
            case "deflate":
                data = zlib.decompress(data)
            case "zst":
                data = pa.input_stream(pa.BufferReader(data), compression="zstd").read()
            case "snappy":
                data = blocks(data, snappy)
            case "lz4":
                data = blocks(data, lz4)
        return data.decode("utf-8", "replace")

    return read


#: Fixed value: a private-use character, put before the first one of every string in a marked text.
MARK = "\ue000"


def marked(text: Column) -> Column:
    """The JSON text with :data:`MARK` at the start of all its strings, keys too.

    Read as STRING, a marked string then differs from a number, a flag, or a list
    kept as text. Escaped quotes and backslashes become \\u escapes first, so that
    every quote left is one end of a string.
    """
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    return F.regexp_replace(plain, '"([^"]*)"', f'"{MARK}$1"')


def unmarked(kept: Column) -> Column:
    """JSON kept as text, without the marks."""
    return F.regexp_replace(kept, f'(?<!\\\\)"{MARK}', '"')


def _enveloped(text: Column, doc_type: str) -> Column:
    envelope = F.concat(F.lit('{"doc":['), text, F.lit('],"end":[]}'))
    return F.from_json(envelope, f"MAP<STRING, ARRAY<{doc_type}>>", JSON_OPTIONS)


def _is_one(parsed: Column) -> Column:
    """Whether the text was exactly one JSON value."""
    return F.coalesce((F.size(parsed) == 2) & (F.size(F.try_element_at(parsed, F.lit("doc"))) == 1), F.lit(False))


def _with_object(texts: DataFrame, doc_type: str) -> DataFrame:
    """Add ``doc``: the object, null for any other text. ``inline`` keeps the optimizer from parsing once per use."""
    parsed = texts.select("*", F.inline(F.array(F.struct(_enveloped(F.col("value"), doc_type).alias("_parsed")))))
    found = F.when(_is_one(F.col("_parsed")), F.get(F.try_element_at("_parsed", F.lit("doc")), 0))
    return parsed.withColumn("doc", found).drop("_parsed")


def with_doc(texts: DataFrame, doc_type: str) -> DataFrame:
    """Replace ``value`` by ``doc`` (typed) and ``status`` (ok / blank / malformed / not_object)."""
    status = (
        F.when(F.col("doc").isNotNull(), OK)
        .when(~F.col("value").rlike(r"\S"), BLANK)
        .when(_is_one(_enveloped(F.col("value"), "STRING")), NOT_OBJECT)  # only such texts are parsed again
        .otherwise(MALFORMED)
    )
    return _with_object(texts, doc_type).withColumn("status", status).drop("value")


def valid_docs(texts: DataFrame, doc_type: str, keep_text: bool = False) -> DataFrame:
    """Only the texts that hold a JSON object (as ``doc``); others are skipped, never fatal."""
    found = _with_object(texts, doc_type).where(F.col("doc").isNotNull())
    return found if keep_text else found.drop("value")
