"""Symbols, path labels, slugs and note labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# What counts as white space at the ends of a text, and the patterns of paths and of safe folder names.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SYMBOL_FOLDER = "symbol=([^/]+)"
UNSAFE, OUTER = "[^A-Za-z0-9._-]+", "^[._-]+|[._-]+$"
SLUG_LENGTH = 120


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def clean_key(symbol: Column) -> Column:
    return F.upper(stripped(symbol))


def symbol_or(payload_symbol: Column, fallback: Column) -> Column:
    """The record's own symbol, or the fallback when it has none."""
    return F.coalesce(F.nullif(payload_symbol, F.lit("")), fallback)


def symbol_in_path(path: Column) -> Column:
    """Ticker of a ``symbol=<TICKER>`` folder; '' when the path has none."""
    return F.regexp_extract(path, SYMBOL_FOLDER, 1)


def interval_of(path: Column, stem: str) -> Column:
    """Label after ``<stem>_`` in the file name; '' when the name does not match."""
    return F.regexp_extract(path, rf"(?:^|/){stem}_([^/]+)\.(?:parquet|jsonl)$", 1)


def slug(text: Column, fallback: str = "note") -> Column:
    """Text as a safe folder name of at most 120 characters."""
    safe = F.regexp_replace(stripped(text), UNSAFE, "_")
    bare = F.regexp_replace(safe, OUTER, "")
    return F.substring(F.coalesce(F.nullif(bare, F.lit("")), F.lit(fallback)), 1, SLUG_LENGTH)


def note_label(created_at: Column, saved_at: Column, title: Column, note_id: Column) -> Column:
    """``time | title`` from what is filled in, else the id."""
    def filled(c: Column) -> Column:
        return F.nullif(stripped(c), F.lit(""))

    label = F.concat_ws(" | ", F.coalesce(filled(created_at), filled(saved_at)), filled(title))
    return F.coalesce(F.nullif(label, F.lit("")), note_id)
