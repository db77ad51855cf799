"""Secret scanning with a random forest that removes false positives.

Everything on the main path is SQL functions: candidates and the texts between them come
from one pattern, features from string functions, and the forest is compiled to nested
CASE expressions. The forest is trained on the driver from a fixed set of labelled
findings, made by rule below, whose features the same SQL computes.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import prepare

#: Words that assign or name a secret, and words that name harmless identifiers.
_CUES = r"(?:passw(?:or)?d|passwd|pwd|secret|token|api.?key|access.?key|credential|private.?key|auth|bearer)"
CUES = r"(?i)" + _CUES
HARMLESS = r"(?i)(commit|checksum|sha1|sha256|md5|digest|uuid|guid|build|version|isbn|order|invoice|image|path|file|url|href|src|release)"
#: Behind a cue word and an assignment; the shorter looks behind come first, as they cost less.
_ASSIGNED = r"(?<=[\s=:{q}])(?<=[=:]\s{{0,8}}{q})(?<=(?i:" + _CUES + r")[A-Za-z0-9_-]{{0,32}}[\"']?\s{{0,8}}[=:]{{1,2}}\s{{0,8}}{q})"
#: A header of a private key; a quoted value after a cue word, of any printable characters; a cue word
#: and its value in one run; a value without quotes; a run of 12 or more token characters with a digit in it.
CANDIDATE = "|".join((
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----",
    _ASSIGNED.format(q='"') + r'(?:\\.|[^"\\\n])++(?=")',
    _ASSIGNED.format(q="'") + r"(?:\\.|[^'\\\n])++(?=')",
    r"(?<![A-Za-z0-9_+/=.-])(?i:[A-Za-z0-9_.-]*" + _CUES + r")[A-Za-z0-9_-]*=[^\s\"'=](?:\S*[^\s\"',;)\]}>])?",
    _ASSIGNED.format(q="") + r"(?!(?i:bearer|basic|token)\s)[^\s\"'=:](?:\S*[^\s\"',;)\]}>])?",
    r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/=.-]*[0-9])[A-Za-z0-9_+/=.-]{12,}+",
))
#: Words whose characters count as dictionary coverage.
DICTIONARY = (
    "the and for with from this that into over under user users admin test data file files image images page pages index item items list table report "
    "static assets public local server client config default update create delete config build release version module package function value number "
    "street north south east west spring summer autumn winter january february march april june july august september october november december "
    "example sample demo mail http https html json main home about contact product service system network"
).split()
#: Words of harmless findings that the forest learns from: other words than the dictionary's, so
#: that coverage is no sign of the class by construction.
OTHER_WORDS = (
    "bridge garden copper marble velvet lantern harbor meadow pepper saddle ribbon timber walnut pocket mirror candle basket hammer needle blanket "
    "engine market signal planet window kitchen library station theatre museum factory orchestra painter teacher doctor lawyer farmer sailor pilot "
    "parse render fetch merge branch commit layout widget cursor buffer socket thread kernel packet column filter schema cluster journal archive"
).split()
CONTEXT = 60


def features() -> dict[str, Column]:
    """Feature columns over (c: candidate, before, after: neighbouring text)."""
    c, low = F.col("c"), F.lower("c")
    n = F.length("c").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / n

    value = F.regexp_replace(c, "^[A-Za-z_-]{2,}[=:]+", "")
    last = F.regexp_extract("before", r"([^\s=:\"']*)[\s=:\"']*$", 1)
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    return {
        "length": n,
        "value_length": F.length(value).cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "vowels": share("(?i)[aeiou]"),
        "punctuation": share("[_+/=.-]"),
        "kind_changes": F.regexp_count(c, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / n,
        "consonant_runs": F.regexp_count(low, F.lit("[bcdfghjklmnpqrstvwxz]{4,}")).cast("double"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.length(value), F.lit(1)),
        "repeats": F.regexp_count(c, F.lit(r"(.)\1")) / n,
        "hex": value.rlike("^[0-9a-f]{12,}$").cast("double"),
        "all_digits": value.rlike("^[0-9.+/=-]+$").cast("double"),
        "key_prefix": value.rlike("^(AKIA|ASIA|ghp_|gho_|xox[bp]-|sk_live_|AIza|glpat-)").cast("double"),
        "coverage": 1 - F.length(F.regexp_replace(low, words, "")) / n,
        "path": (c.rlike("[A-Za-z0-9]/[A-Za-z0-9]") | F.col("before").rlike("[/\\\\]$|://\\S*$")).cast("double"),
        "dotted": F.regexp_count(c, F.lit("[.]")).cast("double"),
        "uuid": c.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$").cast("double"),
        "cue_inside": c.rlike(CUES).cast("double"),
        "cue_before": last.rlike(CUES).cast("double"),
        "cue_near": F.col("before").rlike(CUES + r"[^\n]{0,24}$").cast("double"),
        "harmless_before": (last.rlike(HARMLESS) | F.col("before").rlike(HARMLESS + r"\W{1,4}$")).cast("double"),
        "assigned": (F.col("before").rlike("[=:]\\s*[\"']?$") | c.rlike("^[A-Za-z_]+=")).cast("double"),
        "quoted": F.col("before").rlike("[\"']$").cast("double"),
        "private_key": c.startswith("-----BEGIN").cast("double"),
        "symbols": share("[^A-Za-z0-9_+/=.\\s-]"),
        "spaces": share("\\s"),
        "strong_cue": F.concat(last, F.regexp_extract("c", "^([A-Za-z_-]{2,})=", 1)).rlike("(?i)(passw(or)?d|passwd|pwd|secret|token|key|credential)$").cast("double"),
        "placeholder": value.rlike("(?i)^([<$%{*]|your|change|example|none$|null$|true$|false$|required|optional|string|x+$|self[.]|os[.]|get|input|env)|[(]").cast("double"),
        "at_after": F.col("after").rlike("^@").cast("double"),
        "sentence_after": F.col("after").rlike("^\\s+[a-z]").cast("double"),
    }


def word_of(r: random.Random) -> str:
    """A word of a harmless finding: mostly one that the dictionary lacks."""
    return r.choice(OTHER_WORDS if r.random() < 0.6 else DICTIONARY)


def labelled_findings(n: int = 1500, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, is_secret), by rule from a fixed seed."""
    r = random.Random(seed)
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    wide = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "in", "ed", "nd", "ha", "ou", "le", "de", "st", "ch"]) for _ in range(r.randint(1, 5)))
    plain = lambda: " ".join(word() for _ in range(r.randint(1, 4))) + " "
    out = []
    for k in range(n):
        before, after = plain() if r.random() < 0.9 else "", r.choice([" ", ". ", "\n", '"', ", "]) + plain()
        if k % 2:
            kind = r.randrange(7)
            name = r.choice(["password", "passwd", "secret", "token", "api_key", "access_key", "DB_PASSWORD", "auth_token"])
            if kind == 0:
                c = r.choice(["AKIA", "ASIA"]) + pick(upper, 16)
            elif kind == 1:
                c = f"{name}={pick(hexa, r.choice([16, 18, 20, 24, 32]))}"
            elif kind == 2:
                before, c, after = before + name + r.choice([' = "', ': "', "='", ' : "']), pick(hexa, r.choice([32, 40, 64])), '"' + after
            elif kind == 3:
                before, c = before + name + r.choice([": ", " = ", " is "]), pick(wide, r.randint(16, 40))
            elif kind == 4:
                c = r.choice(["ghp_", "gho_", "glpat-", "sk_live_", "AIza", "xoxb-"]) + pick(wide, r.randint(20, 36))
            elif kind == 5:
                before, c = before + r.choice(["Authorization: Bearer ", "bearer "]), pick(wide, 20) + "." + pick(wide, 30)
            else:
                c = f"{name}={pick(wide, r.randint(14, 32))}"
            if not any(x.isdigit() for x in c):
                c += str(r.randint(10, 99))
            out.append((before[-CONTEXT:], c, after[:CONTEXT], 1))
        else:
            kind = r.randrange(10)
            if kind == 0:
                before, c = before + r.choice(["commit ", "sha1: ", "checksum ", "sha256:", "md5 ", "digest="]), pick(hexa, r.choice([32, 40, 64]))
            elif kind == 1:
                c = "-".join([pick(hexa, 8), pick(hexa, 4), pick(hexa, 4), pick(hexa, 4), pick(hexa, 12)])
            elif kind == 2:
                c = "/".join([word_of(r) for _ in range(3)] + [f"{word_of(r)}{r.randint(1, 99)}." + r.choice(["html", "png", "js"])])
            elif kind == 3:
                c = pick("0123456789", r.randint(12, 19))
            elif kind == 4:
                before, c, after = before, f"{pick('abcdefghijkl', r.randint(3, 8))}.{r.randint(10, 99)}{pick('abcdefghijkl', r.randint(3, 8))}", f"@mail{r.randint(1, 9)}.example.com " + after
            elif kind == 5:
                c = f"mail{r.randint(1, 9)}.example.com"
                before += pick("abcdefgh", 5) + "@"
            elif kind == 6:
                c = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}"
            elif kind == 7:
                c = word_of(r) + "_" + word_of(r) + "_" + word_of(r) + str(r.randint(1, 99))
            elif kind == 8:
                c = word() + word() + word() + word() + str(r.randint(1, 9))
                c += "x" * max(0, 12 - len(c))
            else:
                c = ".".join(str(r.randint(100, 255)) for _ in range(4))
            out.append((before[-CONTEXT:], c, after[:CONTEXT], 0))
    return out + labelled_values(n // 2, seed + 1)


def labelled_values(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """Findings of the kinds that need a cue: passwords as people write them, private keys,
    and the harmless words and placeholders that stand in the same places."""
    r = random.Random(seed)
    lower = "abcdefghijklmnopqrstuvwxyz"
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    syllables = lambda a, b: "".join(r.choice(["cor", "rec", "hor", "se", "bat", "ter", "sta", "ple", "hun", "mon", "key", "dra", "gon", "sun", "blue", "tro", "ub", "let", "me", "in"]) for _ in range(r.randint(a, b)))
    out = []
    for k in range(n):
        before, after = r.choice(["", "the ", "set ", "# ", "login root ", "\n"]), r.choice(["\n", " ", ", ", "}"]) + r.choice(["", "user = admin", "next line", "and then"])
        name = r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "DB_PASSWORD", "client_secret", "Password", "credential"])
        quote = r.choice(['"', '"', "'", ""])
        if k % 2:
            kind = r.randrange(6)
            if kind == 0:
                c = syllables(2, 3) + pick("0123456789", r.randint(1, 4)) + r.choice(["", "pass", "!", syllables(1, 1)])
            elif kind == 1:
                c = syllables(4, 9)
                quote = quote or '"'
            elif kind == 2:
                c = syllables(1, 2).capitalize() + pick("0123456789", 2) + pick("&!@#$%^*?~", r.randint(1, 2)) + pick(lower + "0123456789", r.randint(2, 5)) + pick("&!@#$%?", r.randint(0, 2))
            elif kind == 3:
                c = pick(lower + lower.upper() + "!@#$%&*", r.randint(6, 24))
            elif kind == 4:
                c = r.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED ", "DSA "]) + "PRIVATE KEY"
                out.append((before, f"-----BEGIN {c}-----", "\n" + pick(lower.upper() + "0123456789+/", 50), 1))
                continue
            else:
                c = " ".join(syllables(1, 3) for _ in range(r.randint(3, 5)))
                quote = quote or '"'
            if not quote and r.random() < 0.5:
                out.append((before, f"{name}={c}", after, 1))
                continue
            out.append((before + name + r.choice(['": ', ": ", " = ", "="] if quote else [": ", " = "]) + quote, c, quote + after, 1))
        else:
            kind = r.randrange(6)
            if kind == 0:
                name, c = r.choice(["author", "Author", "authors", "authority", "authentication", "tokens", "authorised by"]), r.choice(["John Smith", "Mary", "Anna", "Peter_Jones", "city council", "enabled", "42", "basic", "MIT", syllables(2, 3).capitalize()])
                c = c if quote else c.split(" ")[0]
            elif kind == 1:
                c = r.choice(["required", "optional", "string", "null", "None", "true", "false", "example", "changeme", "xxxx", "xxxxxxxx"])
            elif kind == 2:
                c = r.choice(["<your-password>", "${SECRET}", "$PASSWORD", "%s", "{token}", "********", "your_password_here", "<token>", "YOUR-API-KEY"])
            elif kind == 3:
                c, quote = r.choice(["os.environ[key]", "input()", "getpass()", "get_secret(name)", "self.password", "env.TOKEN", "request.form"]), ""
            elif kind == 4:
                c, quote = r.choice(["the", "a", "see", "it", "must", "at", "not", "use", "never", "eight", "forgotten", "minimum", "list", word_of(r)]), ""
                out.append((before + name + r.choice([": ", ": ", " = "]), c, " " + " ".join(word_of(r) for _ in range(4)), 0))
                continue
            else:
                c = r.choice(["Password", "Enter your password", "Token", "must not be empty", "Forgot your password?", "Please sign in"])
                quote = quote or '"'
            out.append((before + name + r.choice(['": ', ": ", " = "] if quote else [": ", " = "]) + quote, c, quote + after, 0))
    return out


Tree = float | tuple  # a leaf's share of secrets, or (feature, threshold, left, right)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int = 5) -> Tree:
    """A Gini tree that looks at a random third of the features at each split."""
    p = float(y.mean())
    if depth == 0 or len(y) < 2 * least or p in (0.0, 1.0):
        return round(p, 6)
    best: tuple = (p * (1 - p) * len(y) - 1e-9,)
    for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(y))
        ok = (v[1:] != v[:-1]) & (k >= least) & (len(y) - k >= least)
        if ok.any():
            a, b = s[:-1] / k, (s[-1] - s[:-1]) / (len(y) - k)
            cost = np.where(ok, a * (1 - a) * k + b * (1 - b) * (len(y) - k), np.inf)
            i = int(cost.argmin())
            if cost[i] < best[0]:
                best = (float(cost[i]), int(f), float((v[i] + v[i + 1]) / 2))
    if len(best) == 1:
        return round(p, 6)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[left], y[left], rng, depth - 1, least), grow(x[~left], y[~left], rng, depth - 1, least))


def train(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, seed: int = 5) -> list[Tree]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        k = rng.integers(0, len(y), len(y))
        out.append(grow(x[k], y[k].astype(float), rng, depth))
    return out


def vote(tree: Tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def to_column(tree: Tree, names: list[str]) -> Column:
    """A tree as a CASE expression."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(F.col(names[tree[0]]) <= F.lit(tree[1]), to_column(tree[2], names)).otherwise(to_column(tree[3], names))


def labelled_features(spark: SparkSession, rows: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The labelled findings' features, by the SQL that scores the corpus."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    values = ", ".join(f"({quote(b)}, {quote(c)}, {quote(a)}, {y})" for b, c, a, y in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t(before, c, after, y)")
    got = df.select(*(f.alias(k) for k, f in features().items()), "y").collect()
    m = np.array([[float(v) for v in r] for r in got])
    return m[:, :-1], m[:, -1]


_forest: list[Tree] = []


def forest(spark: SparkSession) -> list[Tree]:
    """The trained forest, once for each driver."""
    if not _forest:
        _forest.extend(train(*labelled_features(spark, labelled_findings())))
    return _forest


def find_secrets(docs: DataFrame, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(key, start, end, secret, score): every candidate that the forest calls a secret.

    Offsets are code points of the whole text. Null and empty texts have none; repeated
    rows report their findings as often as they stand there.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = list(features())
    rows = docs.select(F.col(key), F.col("text")).where(F.col("text").rlike(CANDIDATE)).withColumn("_row", F.monotonically_increasing_id())
    cut = rows.select(key, "_row", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("cs"), F.split("text", CANDIDATE, -1).alias("parts"))
    part = F.transform("cs", lambda c, i: F.struct(c.alias("c"), F.get("parts", i).alias("gap"), F.get("parts", i + 1).alias("then")))
    one = cut.select(key, "_row", F.posexplode(part).alias("i", "x"))
    w = Window.partitionBy("_row").orderBy("i")
    end = F.sum(F.length("x.gap") + F.length("x.c")).over(w)
    one = one.select(key, end.cast("long").alias("end"), F.col("x.c").alias("c"), F.substring("x.gap", -CONTEXT, CONTEXT).alias("before"), F.substring("x.then", 1, CONTEXT).alias("after"))
    seen = one.select(key, "end", "c", *(f.alias(k) for k, f in features().items()))
    trees = forest(spark)
    score = sum((to_column(t, names) for t in trees[1:]), to_column(trees[0], names)) / len(trees)
    found = seen.select(key, (F.col("end") - F.length("c")).alias("start"), "end", F.col("c").alias("secret"), F.round(score, 6).alias("score"))
    return found.where(F.col("score") >= threshold)
