"""Columns over source text and paths: parsing rules that need no Python worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Call keywords of the two rule sets, and the rules' patterns.
CALL_KEYWORDS = ("if", "for", "while", "switch", "return")
SIGNAL_CALL_KEYWORDS = ("if", "for", "while", "switch", "return", "catch", "function", "typeof", "console")
JS_IMPORT = r"^\s*import\s+.*?from\s+['\"]([^'\"]+)['\"]"
JS_REQUIRE = r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"
JS_FUNCTION = r"^\s*(?:export\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
CALL = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("
CALL_LIMIT = 200


def lines(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, line number from 1, line)."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("_p", "line")).select(*keys, (F.col("_p") + 1).alias("line_no"), "line")


def all_matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def js_definitions(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, name) of function declarations, a line each."""
    d = lines(df, key, text=text).select(key, "line_no", F.regexp_extract("line", JS_FUNCTION, 1).alias("name"))
    return d.where("name <> ''")


def js_imports(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, module): distinct modules of import and require lines."""
    d = lines(df, key, text=text)
    a = d.select(key, F.regexp_extract("line", "(?d)" + JS_IMPORT, 1).alias("module")).where("module <> ''")
    return a.union(d.select(key, F.explode(all_matches(F.col("line"), JS_REQUIRE, 1)).alias("module"))).distinct()


def calls(text: Column, keywords: tuple[str, ...] = CALL_KEYWORDS, limit: int | None = None) -> Column:
    """Called names in order, repeats kept, without keywords."""
    found = F.filter(all_matches(text, CALL, 1), lambda x: ~x.isin(*keywords))
    return F.slice(found, 1, limit) if limit else found


def js_cyclomatic(text: Column) -> Column:
    """1 + branch keywords + && + || + conditional question marks."""
    n = F.regexp_count(text, F.lit(r"\b(?:if|for|while|case|catch)\b")) + F.regexp_count(text, F.lit("&&")) + F.regexp_count(text, F.lit(r"\|\|"))
    return 1 + n + F.regexp_count(text, F.lit(r"(?<!\?)\?(?!\.)"))


def normal_python(text: Column) -> Column:
    t = F.regexp_replace(text, "(?d)#.*", "")
    t = F.regexp_replace(t, r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'", "STR")
    return F.regexp_replace(F.regexp_replace(t, r"\b\d+(?:\.\d+)?\b", "NUM"), r"\s+", "")


def normal_js(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?md)//.*?$|/\*[\s\S]*?\*/", "")
    t = F.regexp_replace(t, r"`[\s\S]*?`|\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'", "STR")
    return F.regexp_replace(F.regexp_replace(t, r"\b\d+(?:\.\d+)?\b", "NUM"), r"\s+", "")


def module_name(path: Column) -> Column:
    """Dotted module of a Python path; a package's __init__ is the package."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "/__init__$", ""), "/", ".")


def language(path: Column) -> Column:
    s = F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))
    return F.when(s == ".py", "python").when(s.isin(".js", ".jsx"), "javascript").when(s.isin(".ts", ".tsx"), "typescript").otherwise("unknown")


def import_modules(text: Column) -> Column:
    """Module names of an import statement's text."""
    from_ = F.regexp_extract(text, r"^\s*from\s+([\w.]+)\s+import", 1)
    js = F.regexp_extract(text, r"(?:from\s+|require\()\s*['\"]([^'\"]+)['\"]", 1)
    plain = F.regexp_extract(text, r"^\s*import\s+(.+)$", 1)
    names = F.transform(F.split(plain, ","), lambda x: F.trim(F.regexp_replace(x, r"\s+as\s+.*$", "")))
    return F.when(js != "", F.array(js)).when(from_ != "", F.array(from_)).when(plain != "", names).otherwise(F.array().cast("array<string>"))


def callee_name(text: Column) -> Column:
    """Last dotted part before the bracket of a call's text."""
    return F.element_at(F.split(F.regexp_extract(text, r"^([\w.]+)\s*\(", 1), "[.]"), -1)


def is_internal(module: Column, top_modules: Column) -> Column:
    """Relative, or its first part is a module of the project."""
    return module.startswith(".") | F.array_contains(top_modules, F.element_at(F.split(module, "[./]"), 1))


#: Lint rules (needle, needle in lower case, severity, message).
LINT = (
    ("eval(", "user", "HIGH", "Potential user input in eval()"),
    ("exec(", "user", "HIGH", "Potential user input in exec()"),
    ("SELECT", "{", "MEDIUM", "Possible SQL injection risk"),
    ("=", "password", "LOW", "Possible hardcoded password"),
)


def lint(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, severity, message, code) of lines that break a rule."""
    d = lines(df, key, text=text)
    hit = [F.when(F.contains("line", F.lit(a)) & F.contains(F.lower("line"), F.lit(b)), F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for a, b, s, m in LINT]
    d = d.select(key, "line_no", "line", F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("r"))
    return d.select(key, "line_no", "r.severity", "r.message", F.substring(F.trim("line"), 1, 50).alias("code"))


def severity_gate(issues: DataFrame) -> DataFrame:
    """One row: issues of each severity, and whether the gate blocks."""
    n = {s: F.count_if(F.col("severity") == s.upper()) for s in ("high", "medium", "low")}
    return issues.agg(*(v.alias(k) for k, v in n.items())).withColumn("blocked", (F.col("high") > 0).cast("int"))


def docstring(text: Column) -> Column:
    """First triple-quoted block, stripped; null if there is none."""
    a = F.regexp_extract(text, r'(?s)"""(.*?)"""', 1)
    b = F.regexp_extract(text, r"(?s)'''(.*?)'''", 1)
    strip = lambda x: F.nullif(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))
    return F.coalesce(strip(a), strip(b))


def comments(text: Column) -> Column:
    """Comment lines joined by blanks."""
    ls = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(ls, lambda x: x.startswith("#") | x.startswith("//")), " ")


def summary(name: Column, doc: Column, text: Column, n: int = 20) -> Column:
    return F.concat_ws("\n", name, doc, F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n"))


def numstat(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, rel_path, commits, added, removed) of version-control text: lines
    added\\tremoved\\tpath under COMMIT sentinels; '-' is 0, shorter lines are skipped."""
    # a text is cut at its sentinels, so a part's position is the number of those before it
    parts = df.select(key, F.posexplode(F.split(text, r"(?:\A|\n) *COMMIT *(?=\n|\z)")).alias("commit", "_t"))
    d = parts.select(key, "commit", F.explode(F.split("_t", "\n")).alias("line"))
    p = F.split("line", "\t")
    d = d.where(F.size(p) >= 3).select(key, "commit", F.replace(p[2], F.lit("\\"), F.lit("/")).alias("rel_path"), *(F.coalesce(F.try_to_number(F.nullif(p[i], F.lit("-")), F.lit("999999999999")), F.lit(0)).cast("long").alias(n) for i, n in ((0, "added"), (1, "removed"))))
    return d.groupBy(key, "rel_path").agg(F.count_distinct("commit").alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def report_blocks(df: DataFrame, key: str, mark: str = "EVALUATING: ", text: str = "text") -> DataFrame:
    """(key, pos, subject, location, home) of blocks that begin with ``mark``; blocks without
    a location are left out."""
    b = df.select(key, F.posexplode(F.slice(F.split(text, mark), 2, 1 << 20)).alias("pos", "b"))
    get = lambda n: F.trim(F.regexp_extract("b", rf"(?m)^\s*{n}:\s*(.*)$", 1))
    out = b.select(key, "pos", F.trim(F.regexp_extract("b", r"^([^\n]*)", 1)).alias("subject"), get("Current Location").alias("location"), get("RECOMMENDED HOME").alias("home"))
    return out.where("location <> ''")


def safe_label(value: Column) -> Column:
    """Letters, digits and '_' of a label; Entity if none is left."""
    return F.coalesce(F.nullif(F.regexp_replace(value, r"[^\p{L}\p{N}_]", ""), F.lit("")), F.lit("Entity"))


def slug(value: Column) -> Column:
    """Other characters than letters, digits, '-' and '_' become '-'; none stands at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"[^\p{L}\p{N}_-]", "-"), "^[-_]+|[-_]+$", "")


def duration(seconds: Column) -> Column:
    """Milliseconds below a second, seconds below a minute, else minutes and seconds; ties
    are rounded to the even digit."""
    minutes = F.floor(seconds / 60)
    rest = F.format_string("%dm %.1fs", minutes, F.bround(seconds - minutes * 60, 1))
    return F.when(seconds < 1, F.format_string("%.1fms", F.bround(seconds * 1000, 1))).when(seconds < 60, F.format_string("%.2fs", F.bround(seconds, 2))).otherwise(rest)


def tail(text: Column, n: int = 20) -> Column:
    """The last n lines that aren't blank."""
    kept = F.filter(split_lines(text), lambda x: F.trim(x) != "")
    return F.array_join(F.when(F.size(kept) > n, F.slice(kept, -n, n)).otherwise(kept), "\n")


def split_lines(text: Column) -> Column:
    """Lines at every line end that text knows, a final one not starting a line."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "(\r\n|[\n\u000b\u000c\r\u001c-\u001e\u0085\u2028\u2029])\\z", ""), "\r\n|[\n\u000b\u000c\r\u001c-\u001e\u0085\u2028\u2029]"))


def like_prefix(value: Column, prefix: str) -> Column:
    """SQL LIKE with a prefix, as ASCII case goes: '_' and '%' in it are wildcards."""
    import re as _re

    body = "".join("." if c == "_" else ".*" if c == "%" else _re.escape(c) for c in prefix)
    return value.rlike("(?s)(?i)^" + body)
