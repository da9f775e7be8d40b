"""Queries over conversations (11), vectors (12) and rearranged documents (13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, middle
from .common import table

#: The conversation that the query adds: both turns say what a template's marks look like.
MARKS_AS_TEXT = "</s>[INST] ok [/INST]"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    added = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(MARKS_AS_TEXT).alias("text"),
    )
    found = chat.format_conversations(rows.unionByName(added))
    read = found.select("conv_id", "state", "refused_turn", "complete", chat.formatted(F.col("segments")).alias("formatted"), chat.learned(F.col("segments")).alias("learned"))
    turns = read.withColumn("turns", chat.turns_of(F.col("formatted")))
    newline = F.lit("\n")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "refused_turn",
        "complete",
    )


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes.compressed(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {"op11_chat": op11_chat, "op12_codes": op12_codes, "op13_middle": op13_middle}


def _escaped(text: str) -> str:
    found = f"replace({text}, '\\', '\\\\')"
    for c in chat.INSTRUCTIONS.controls:
        found = f"replace({found}, '{c}', '{c[0]}\\{c[1:]}')"
    return found


_LETTERS = "CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END"
# lengths of what stands around each role's text
_AROUND = "CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE length(" + _escaped("role") + ") + 25 END"

OP11_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '{MARKS_AS_TEXT}'),
t AS (SELECT *, {_LETTERS} AS letter, {_AROUND} + length({_escaped("text")}) AS chars FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (letter = 'a'), '') AS learned, sum(chars)::BIGINT AS formatted_chars,
         string_agg(letter, '' ORDER BY turn NULLS FIRST, role, text) AS letters
  FROM t GROUP BY conv_id),
m AS (SELECT *, length(regexp_extract(letters, '^s?(ua)*u?')) AS good FROM g)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars,
       CASE WHEN good < n_turns THEN 'refused' ELSE CASE right(letters, 1) WHEN 's' THEN 'system' WHEN 'u' THEN 'user' ELSE 'assistant' END END AS state,
       CASE WHEN good < n_turns THEN good END AS refused_turn, good = n_turns AND right(letters, 1) = 'a' AS complete
FROM m
"""


def _rounds(rounds: int) -> str:
    """Common tables a<k> (assignments to the entries of c<k>) and c<k+1> (their means), floors going down."""
    found = []
    for k in range(rounds + 1):
        found.append(
            f"a{k} AS MATERIALIZED (SELECT rn, x.p, min((((x.v1-c.v1)*(x.v1-c.v1)+(x.v2-c.v2)*(x.v2-c.v2)+(x.v3-c.v3)*(x.v3-c.v3)+(x.v4-c.v4)*(x.v4-c.v4)) * 64 + c.e)) AS best FROM x JOIN c{k} c ON x.p = c.p GROUP BY rn, x.p)"
        )
        if k < rounds:
            mean = lambda i: f"coalesce((m.s{i} - ((m.s{i} % m.n) + m.n) % m.n) // m.n, c.v{i}) AS v{i}"  # noqa: B023, E731
            sums = ", ".join(f"sum(v{i})::BIGINT AS s{i}" for i in range(1, 5))
            found.append(f"m{k} AS (SELECT x.p, best % 64 AS e, count(*) AS n, {sums} FROM x JOIN a{k} USING (rn, p) GROUP BY ALL)")
            found.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, {', '.join(mean(i) for i in range(1, 5))} FROM c{k} c LEFT JOIN m{k} m ON c.p = m.p AND c.e = m.e)")
    return ",\n".join(found)


# for vectors of 64 components, as the given tables have them
OP12_SQL = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS q, row_number() OVER (ORDER BY vec_id NULLS LAST) AS rn
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT rn, p, q[4*p+1] AS v1, q[4*p+2] AS v2, q[4*p+3] AS v3, q[4*p+4] AS v4 FROM k, unnest(range(16)) AS r(p)),
c0 AS MATERIALIZED (SELECT p, rn - 1 AS e, v1, v2, v3, v4 FROM x WHERE rn <= 64),
{_rounds(2)},
coded AS (SELECT rn, string_agg(format('{{:02x}}', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY rn),
books AS (SELECT sha256(string_agg(concat_ws(',', v1, v2, v3, v4), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN coded USING (rn), books
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units FROM d),
r AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM u),
p AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS pre, array_to_string(units[least(a, b)+1:greatest(a, b)], '') AS mid, array_to_string(units[greatest(a, b)+1:], '') AS suf,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

ORACLE_SQL = {"op11_chat": OP11_SQL, "op12_codes": OP12_SQL, "op13_middle": OP13_SQL}
