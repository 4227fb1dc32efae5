"""The queries that apply the operators of this subpackage to whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chat import BREAK, CONTROL, END, ESCAPE, START, format_chat, read_back
from tessera.llm.common import read_table
from tessera.llm.funnels import Funnel, count_funnels
from tessera.llm.gridjoin import near_duplicates as vector_duplicates
from tessera.llm.knn import integer_vectors, top_k
from tessera.llm.negatives import hard_negatives, labelled_vectors
from tessera.llm.packing import pack
from tessera.llm.pieces import digests
from tessera.llm.pii import replace_entities
from tessera.llm.separators import flatten, scan
from tessera.llm.simhash import near_duplicates
from tessera.llm.suffixes import remove_repeats
from tessera.llm.toxicity import toxicity
from tessera.llm.wrappers import main_text


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(flatten(read_table(spark, sf_dir, "documents"))).select("doc_id", "file", "ordinal", "start", "n_tokens")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chat(turns.unionByName(extra)))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
)


def op11_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_funnels(read_table(spark, sf_dir, "clicks"), FUNNELS)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # only a smaller doc_id comes earlier: texts that share one take nothing from each other
    kept = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ordered=False)
    n_bytes, left = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), F.octet_length("kept").cast("long")
    return kept.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - left).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(labelled_vectors(read_table(spark, sf_dir, "embeddings"), 256, label), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_topk, op2_toxicity, op3_simhash, op4_token_counts, op5_packing, op6_pii, op7_embedding_dedup, op8_chat_formatting, op9_html_extraction,
    op10_sentencepiece, op11_funnels, op12_suffix_dedup, op13_hard_negatives,
)}

# ---- the same in SQL, where SQL can express it -----------------------------------------------------

_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOPK_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE {_SOUND}),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(coalesce(list_sum(list_transform(q.e, lambda x, i: x * d.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""

LINKS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND {_SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(a.e, lambda x, i: x * b.e[i])) / (a.size * b.size) >= 0.93
),
reached AS (SELECT vec_id, vec_id AS component FROM embeddings UNION SELECT l.b, r.component FROM reached r JOIN links l ON l.a = r.vec_id),
least AS (SELECT vec_id, min(component) AS component_id FROM reached GROUP BY vec_id)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) c USING (vec_id)
"""


def _escaped_sql(text: str) -> str:
    """The text with its control strings broken up, as the formatter writes it."""
    out = f"replace({text}, '{ESCAPE}', '{ESCAPE * 2}')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0] + ESCAPE + c[1:]}')"
    return out


_ROLE_SQL = f"replace({_escaped_sql('role')}, chr(10), '{ESCAPE}n')"
CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum({len(START) + len(BREAK) + len(END)} + length({_ROLE_SQL}) + length({_escaped_sql('text')})) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id
"""

NEGATIVES_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {_SOUND}
),
s AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, CAST(coalesce(list_sum(list_transform(a.e, lambda x, i: x * d.e[i])), 0) AS BIGINT) AS score
  FROM v a JOIN v d ON a.vec_id % 100 = 0 AND a.vec_id <> d.vec_id AND len(a.e) = len(d.e)
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5
),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

_STEP_SQL = """
r{now} AS (
  SELECT a.funnel, a.client_id, a.started, n.us, n.us - a.us AS gap FROM r{last} a JOIN f USING (funnel)
  ASOF JOIN e n ON a.client_id = n.client_id AND f.s{now} = n.kind AND a.us < n.us
  ASOF LEFT JOIN e x ON a.client_id = x.client_id AND f.excluded = x.kind AND a.us < x.us
  WHERE n.us <= a.started + 1800000000 AND (x.us IS NULL OR x.us > n.us)
),
q{now} AS (
  SELECT funnel, client_id, max(n) AS n, max(gap) FILTER (nth = (90 * n + 99) // 100) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY funnel, client_id ORDER BY gap) AS nth, count(*) OVER (PARTITION BY funnel, client_id) AS n FROM r{now}) GROUP BY funnel, client_id
),"""
_FUNNEL_ROWS = ", ".join(str((f.name, *f.steps, *f.excluded)) for f in FUNNELS)
FUNNELS_SQL = f"""
WITH e AS (SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS us FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL),
f(funnel, s1, s2, s3, s4, excluded) AS (VALUES {_FUNNEL_ROWS}),
r1 AS (SELECT funnel, client_id, us AS started, us FROM f JOIN e ON s1 = kind),
{"".join(_STEP_SQL.format(now=k, last=k - 1) for k in (2, 3, 4))}
n AS (
  SELECT c.funnel, c.client_id, c.n AS n1, coalesce(q2.n, 0) AS n2, coalesce(q3.n, 0) AS n3, coalesce(q4.n, 0) AS n4, q2.t AS t2, q3.t AS t3, q4.t AS t4,
    CAST(1 + (q2.n IS NOT NULL)::INTEGER + (q3.n IS NOT NULL)::INTEGER + (q4.n IS NOT NULL)::INTEGER AS INTEGER) AS deepest
  FROM (SELECT funnel, client_id, count(*) AS n FROM r1 GROUP BY ALL) c
  LEFT JOIN q2 USING (funnel, client_id) LEFT JOIN q3 USING (funnel, client_id) LEFT JOIN q4 USING (funnel, client_id)
)
SELECT funnel, client_id, n1, n2, n3, n4, deepest, t2, t3, t4, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM n
"""

ORACLE_SQL: dict[str, str] = {"op1_topk": TOPK_SQL, "op7_embedding_dedup": LINKS_SQL, "op8_chat_formatting": CHAT_SQL, "op11_funnels": FUNNELS_SQL, "op13_hard_negatives": NEGATIVES_SQL}
