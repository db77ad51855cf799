"""The registered queries opN_<name>, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.jaccard import jaccard_links

    got = jaccard_links(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.pivots import near_vectors

    got = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return got.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.pii import KINDS, find_pii

    got = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return got.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.chat import format_conversations, read_back

    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import score

    got = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return got.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontaminate import decontaminate

    got = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", (F.col("_n_items") > 0).alias("contaminated"), F.col("_item").alias("item_id"), F.col("_coverage").alias("coverage"), F.col("_n_items").alias("n_items"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.linededup import dedup_lines

    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.substrings import remove_repeats

    got = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return got.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op1_jaccard_join": op1_jaccard_join, "op2_near_vectors": op2_near_vectors, "op3_pii": op3_pii, "op4_secrets": op4_secrets, "op5_chat_format": op5_chat_format, "op6_quality": op6_quality, "op8_decontamination": op8_decontamination, "op7_line_dedup": op7_line_dedup, "op9_substrings": op9_substrings, "op10_packing": op10_packing}

LINE_SQL = """
WITH l AS (
  SELECT doc_id, u.line, u.pos, translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       unnest(d.ls) WITH ORDINALITY AS u(line, pos)),
r AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.line, l.pos, r.k IS NOT NULL AND l.doc_id < r.keeper AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {esc_role} AS erole, {esc_text} AS etext FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(erole) + length(etext) + 33)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
_CONTROL = r"<(\\*\|im_(?:start|sep|end)\|>|\\*s>|\\*/s>|\\*<SYS>>|\\*</SYS>>)"
_SQUARE = r"\[(\\*/?INST\])"


def _escaped(c: str) -> str:
    inner = f"regexp_replace({c}, '{_CONTROL}', '<' || chr(92) || chr(92) || chr(92) || '1', 'g')"
    return f"regexp_replace({inner}, '{_SQUARE}', '[' || chr(92) || chr(92) || chr(92) || '1', 'g')"


CHAT_SQL = CHAT_SQL.replace("{esc_role}", _escaped("role")).replace("{esc_text}", _escaped("text"))

_COMPONENTS = """,
r(x, y) AS (SELECT a, b FROM links UNION SELECT r.x, l.b FROM r JOIN links l ON l.a = r.y),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
"""

JACCARD_SQL = (
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS h FROM w WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS z FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN z u ON u.doc_id = a JOIN z v ON v.doc_id = b WHERE k >= 0.8 * (u.z + v.z - k) - 1e-9)"""
    + _COMPONENTS
    + """SELECT doc_id, least(doc_id, coalesce(c.y, doc_id)) AS class_id, coalesce(n.n, 0) AS n_links, doc_id <= coalesce(c.y, doc_id) AS kept
FROM documents LEFT JOIN c ON c.x = doc_id LEFT JOIN n ON n.a = doc_id"""
)

VECTOR_SQL = (
    """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_dot_product(x.e, y.e) / (x.l * y.l) >= 0.95)"""
    + _COMPONENTS
    + """SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.y, vec_id)) AS component_id, vec_id <= coalesce(c.y, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.a = vec_id"""
)

#: Texts as hexadecimal digits, two for a byte, as functions of strings don't take blobs.
SUBSTRING_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 400)) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d WHERE length(h) >= 400)),
r AS (SELECT doc_id, p FROM w WHERE x IN (SELECT x FROM w GROUP BY x HAVING count(*) > 1)),
g AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200, true)::INT AS new FROM r),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
s AS (SELECT doc_id, k, min(p) AS s, max(p) + 200 AS e FROM i GROUP BY 1, 2),
n AS (SELECT doc_id, list(struct_pack(s := s, e := e) ORDER BY s) AS l FROM s GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(list_sum(list_transform(l, lambda x: x.e - x.s)), 0)::BIGINT AS n_removed, coalesce(len(l), 0) AS n_spans,
  sha256(unhex(CASE WHEN l IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(l) + 1), lambda j:
    substr(h, CASE WHEN j = 0 THEN 1 ELSE 2 * l[j].e + 1 END, CASE WHEN j = len(l) THEN length(h) ELSE 2 * l[j + 1].s - CASE WHEN j = 0 THEN 0 ELSE 2 * l[j].e END END)), '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)"""

ORACLE_SQL = {"op9_substrings": SUBSTRING_SQL, "op1_jaccard_join": JACCARD_SQL, "op2_near_vectors": VECTOR_SQL, "op5_chat_format": CHAT_SQL, "op7_line_dedup": LINE_SQL}
