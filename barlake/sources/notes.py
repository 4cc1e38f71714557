"""Research notes, a JSON file each."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.sources.lines import document_texts, listed, read_texts, valid_docs, visible_names

NOTE_DOC = """STRUCT<
  saved_at: STRING, created_at: STRING, symbol: STRING, title: STRING, body: STRING, timeframe: STRING,
  snapshot: STRUCT<timeframe: STRING, captured_at: STRING, marker_lines: ARRAY<STRING>,
                   view_state: STRUCT<x_range: ARRAY<STRING>>>,
  ai_summary: STRUCT<status: STRING, model: STRING, source: STRING, summary_file: STRING>
>"""


def parse_notes(texts: DataFrame) -> DataFrame:
    """Note documents as rows; unreadable, non-object and empty ones are skipped.

    Needs ``value``, ``folder_symbol`` and ``id``; other columns are carried.
    """
    carried = [c for c in texts.columns if c not in ("value", "folder_symbol", "id")]
    not_empty = ~F.col("value").rlike(r"^\s*\{\s*\}\s*$")
    return valid_docs(texts.where(not_empty), NOTE_DOC).select("folder_symbol", "id", *carried, "doc.*")


def read_notes(spark: SparkSession, root: str, since: datetime | None = None) -> DataFrame:
    """Notes under ``root`` with ``modified_at``; folder symbol and id come from the path.

    A note is ``<root>/<SYMBOL>/<id>/note.json``, or a file in
    ``<root>/note.json/symbol=<SYMBOL>/id=<id>``. ``since`` takes only files
    changed after that time; the others are listed, not opened.
    """
    files = listed(spark, root, _places())
    texts = _scanned(spark, root) if files is None else files
    if since is not None:
        texts = texts.where(F.col("modified_at") > F.lit(since))

    def part(plain: str, keyed: str) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract("path", p, 1), F.lit("")) for p in (keyed, plain)])

    found = texts.select(
        *(["value"] if files is None else ["path"]), "modified_at",
        part(r"([^/]+)/[^/]+/note\.json$", r"/note\.json/symbol=([^/]+)/").alias("folder_symbol"),
        part(r"([^/]+)/note\.json$", r"/note\.json/symbol=[^/]+/id=([^/]+)/").alias("id"),
    )
    found = found.where("id is not null")
    return parse_notes(found if files is None else document_texts(found).drop("path"))


def _places() -> Callable[[list[str]], bool]:
    """Which entries below a root are, or may lead to, notes."""
    visible = visible_names()

    def enter(parts: list[str]) -> bool:
        if len(parts) <= 2:
            return True
        if parts[0] == "note.json":
            return len(parts) == 3 or visible(parts[-1])
        return len(parts) == 3 and parts[2] == "note.json"

    return enter


def _scanned(spark: SparkSession, root: str) -> DataFrame:
    """Texts of a root that tasks cannot list."""
    plain, keyed = f"{root}/*/*/note.json", f"{root}/note.json/*/*"
    places = [p for p in (plain, keyed) if _any(spark, p)]
    return read_texts(spark, places or [plain], whole_files=True)


def _any(spark: SparkSession, place: str) -> bool:
    try:
        spark.read.format("binaryFile").load(place)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True
