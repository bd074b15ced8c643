"""Column functions: whitespace, paths, commands and resource strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends of a line or between words.
WHITESPACE = r"[\s\x1c-\x1f]"

# Redirect tokens and the stream each selects (0 stdout, 1 stderr, 2 both).
REDIRECT_STREAMS = {">": 0, "1>": 0, "2>": 1, "&>": 2}

# The token each stream is written with.
STREAM_TOKENS = {0: "1>", 1: "2>", 2: "&>"}

# Memory units.
MEMORY_UNITS = {"M": 1 << 20, "G": 1 << 30, "T": 1 << 40}

# Date formats of log lines, log file names and registry stamps.
LOG_STAMP = "ddMMMyyyy HH:mm:ss"
FILE_STAMP = "ddMMMyyyy_HHmmss"
REGISTRY_STAMP = "yyyyMMMdd HH:mm:ss"


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` removes only blanks)."""
    return F.regexp_replace(text, f"(?U)^{WHITESPACE}+|{WHITESPACE}+$", "")


def words(text: Column) -> Column:
    """Split at runs of white space; an empty text has no words."""
    bare = strip(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, f"(?U){WHITESPACE}+")
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Base name without its last extension; leading dots belong to the name."""
    return F.regexp_replace(basename(path), r"^(\.*[^.].*)\.[^.]*$", "$1")


def memory_bytes(amount: Column) -> Column:
    """``512M``, ``4G``, ``1T`` as bytes; null for anything else."""
    number = F.regexp_extract(amount, r"^\s*(\d+)\s*[MGT]\s*$", 1)
    unit = F.regexp_extract(amount, r"([MGT])\s*$", 1)
    scale = F.lit(None).cast("long")
    for name, size in MEMORY_UNITS.items():
        scale = F.when(unit == name, F.lit(size).cast("long")).otherwise(scale)
    return F.when(number != "", number.cast("long") * scale)


def redirect_stream(token: Column) -> Column:
    """Stream number of a redirect token; an unknown token is null."""
    stream = F.lit(None).cast("int")
    for name, number in REDIRECT_STREAMS.items():
        stream = F.when(F.trim(token) == name, F.lit(number)).otherwise(stream)
    return stream


def redirect_token(stream: Column) -> Column:
    token = F.lit(None).cast("string")
    for number, name in STREAM_TOKENS.items():
        token = F.when(stream == number, F.lit(name)).otherwise(token)
    return token


def accepted_exit(success_on: Column, code: Column) -> Column:
    """Exit codes are compared as strings; no list means only ``0`` is a success."""
    codes = F.when(
        success_on.isNull() | (F.size(success_on) == 0), F.array(F.lit("0"))
    ).otherwise(success_on)
    return F.array_contains(codes, code.cast("string"))
