"""Read-only checks of query text before it is run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_COMMENT = re.compile(r"--[^\n]*|//[^\n]*|/\*.*?\*/", re.S)
_STRING = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"")
_WRITES = re.compile(r"(?i)\b(create|merge|delete|detach|set|remove|drop|insert|update|alter|truncate|load|grant|revoke|foreach|call\s+dbms|call\s+apoc)\b")
_READS = re.compile(r"(?i)^\s*(match|return|with|optional|call|unwind|select|values|from|explain|describe|show)\b")
MOST_ROWS = 1000


def bare(text: str) -> str:
    """The text without comments and string contents."""
    return _STRING.sub("''", _COMMENT.sub(" ", text))


def is_read_only(text: str) -> bool:
    """No writing clause anywhere outside of strings and comments, and a reading start of
    every statement."""
    parts = [p for p in bare(text).split(";") if p.strip()]
    return bool(parts) and not _WRITES.search(bare(text)) and all(_READS.match(p) for p in parts)


def with_limit(text: str, most: int = MOST_ROWS) -> str:
    """The query with a LIMIT if it has none."""
    return text if re.search(r"(?i)\blimit\s+\d+\s*;?\s*$", text) else f"{text.rstrip().rstrip(';')} LIMIT {most}"


def run(spark: SparkSession, text: str, safe: bool = True, **args: object) -> DataFrame:
    """Spark SQL over the registered views."""
    if safe and not is_read_only(text):
        raise ValueError("only reading queries are allowed")
    return spark.sql(text, args=args or None)


def rows(spark: SparkSession, text: str, most: int = MOST_ROWS) -> tuple[list, bool]:
    """At most ``most`` rows of a reading query, and whether there are more."""
    got = run(spark, text).limit(most + 1).collect()
    return got[:most], len(got) > most
