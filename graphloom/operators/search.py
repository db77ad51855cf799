"""Name and path search: phrase tokens with AND over terms, and a linear fallback."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = {"functions": ("Function",), "symbols": ("Symbol", "Module")}


def token_text(column: Column) -> Column:
    """Lower-case tokens between blanks; '_' splits, non-ASCII characters belong to tokens."""
    t = F.regexp_replace(F.lower(column), "[^a-z0-9\\u0080-\\uffff]+", " ")
    return F.concat(F.lit(" "), F.trim(t), F.lit(" "))


def indexed(nodes: DataFrame) -> DataFrame:
    """Search index rows: (uid, label, project, name, path) with token texts."""
    return nodes.select("uid", "label", "project", "name", "path", token_text(F.col("name")).alias("name_tokens"), token_text(F.col("path")).alias("path_tokens"))


def search(index: DataFrame, query: str, scope: str = "all", project: str = "", limit: int = 20) -> DataFrame:
    """Rows whose name or path holds every term of the query as a phrase."""
    hit = F.lit(True)
    terms = re.findall("[A-Za-z0-9_]+", query)
    for t in terms:
        phrase = " " + re.sub("_+", " ", t.lower()).strip() + " "
        hit = hit & (F.contains("name_tokens", F.lit(phrase)) | F.contains("path_tokens", F.lit(phrase)))
    d = index.where(hit & F.lit(bool(terms)))
    if scope in GROUPS:
        d = d.where(F.col("label").isin(*GROUPS[scope]))
    d = d.where(F.col("project") == project) if project else d
    return d.select("uid", "label", "project", "name", "path").orderBy("uid").limit(limit)


def scan(nodes: DataFrame, query: str, project: str = "", limit: int = 20) -> DataFrame:
    """Fallback: the query as a substring of name and path."""
    own = F.coalesce(F.nullif("project", F.lit("")), F.when(F.col("label") == "Project", F.col("name")), F.when(F.col("label").isin("File", "Function"), F.substring_index("uid", ":", 1)), F.lit(""))
    d = nodes.select("uid", "label", own.alias("project"), "name", "path").where(F.contains(F.lower(F.concat_ws(" ", "name", "path")), F.lit(query.lower())))
    return (d.where(F.col("project") == project) if project else d).orderBy("uid").limit(limit)


def find(nodes: DataFrame, index: DataFrame | None, query: str, scope: str = "all", project: str = "", limit: int = 20) -> DataFrame:
    """The index if there is one and it finds something, else the scan."""
    if index is not None:
        got = search(index, query, scope, project, limit)
        if not got.isEmpty():
            return got
    return scan(nodes, query, project, limit)
