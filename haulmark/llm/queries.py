"""The operators bound to the test tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm.common import ship, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return add


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


@query(
    "op7_warc",
    """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
      FROM pages
    ), q AS (
      SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
    FROM q
    """,
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


@query(
    "op5_decontaminate",
    r"""
    WITH letters AS (
      SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS low
    ), d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), upper, low),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents, letters
    ), b AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), upper, low),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark, letters
    ), iw AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
    ), ks AS (SELECT DISTINCT k FROM iw), dw AS (
      SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
    ), m AS (
      SELECT doc_id, i, dw.k, item_id FROM dw JOIN iw USING (k, g)
    ), h AS (
      SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1
    ), t AS (
      SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
      FROM m GROUP BY 1
    )
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"))


@query(
    "op4_near_dedup",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), pairs AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
    ), links AS (
      SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)
    ), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links), reach AS (
      SELECT doc_id, doc_id AS r FROM d UNION SELECT y, r FROM reach JOIN edges ON x = doc_id
    ), c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
)
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op8_substring_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), win AS (
      SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
    ), f AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g), gone AS (
      SELECT DISTINCT doc_id, p
      FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (g) WHERE first < doc_id)
    ), words AS (
      SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
    ), kept AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
      FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op10_language_model")
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.llm.language_model import score

    return score(table(spark, sf_dir, "documents"))


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.llm.token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


@query("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


@query(
    "op12_conversation_repair",
    r"""
    WITH RECURSIVE base AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
    ), keyed AS (
      SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind FROM base
    ), rows AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
      FROM keyed WHERE kind <> 0
    ), placed AS (
      SELECT *, row_number() OVER c AS i, left(role, 1) AS r, rtrim(text, E' \t\n\x0b\f\r') AS seen,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
             lag(left(role, 1)) OVER c || left(role, 1) AS pair
      FROM rows WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
    ), coded AS (
      SELECT *, seen = '' OR again AS gone, seen <> '' AND NOT again AND right(seen, 1) NOT IN ('.', '!', '?') AS cut FROM placed
    ), inserts(s, t, c, x, roles) AS (
      VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', 'u'), (1, 2, 5, 'I', 'u'),
             (2, 3, 5, 'I', 'a'), (3, 2, 5, 'I', 'u'), (0, 3, 10, 'II', 'ua'), (1, 3, 10, 'II', 'ua')
    ), reads(s, r, t) AS (
      VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
    ), lines(roles, text) AS (
      VALUES ('', []), ('u', ['user:']), ('a', ['assistant:']), ('ua', ['user:', 'assistant:'])
    ), edits AS (
      SELECT conv_id, i, n.s, n.t, n.c + 2 AS c, n.x || 'D' AS x, l.text AS made FROM coded, inserts n JOIN lines l USING (roles)
      UNION ALL
      SELECT conv_id, i, n.s, e.t, n.c + 5 * cut::INTEGER, n.x || 'K', list_append(l.text, role || ':' || coded.text)
      FROM coded JOIN reads e USING (r) JOIN inserts n ON n.t = e.s JOIN lines l USING (roles) WHERE NOT gone
      UNION ALL
      SELECT conv_id, i, n.s, e.t, n.c + 1 + 5 * cut::INTEGER, n.x || 'R',
             list_append(l.text, CASE e.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || coded.text)
      FROM coded, reads e JOIN inserts n ON n.t = e.s JOIN lines l USING (roles) WHERE NOT gone AND e.r <> 's'
    ), walk AS (
      SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {'c': 0, 'x': ''} AS best, []::VARCHAR[] AS made FROM conversations
      UNION ALL
      SELECT w.conv_id, e.i, e.t, min({'c': w.best.c + e.c, 'x': w.best.x || e.x}),
             arg_min(list_concat(w.made, e.made), {'c': w.best.c + e.c, 'x': w.best.x || e.x})
      FROM walk w JOIN edits e ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = w.i + 1 AND e.s = w.state
      GROUP BY w.conv_id, e.i, e.t
    ), stats AS (
      SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count_if(seen = '')::BIGINT AS blank, count_if(again AND seen <> '')::BIGINT AS duplicate, count_if(cut)::BIGINT AS truncated,
             count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
      FROM coded GROUP BY conv_id
    ), ended AS (
      SELECT w.conv_id, w.i, min({'c': w.best.c + n.c, 'x': w.best.x || n.x}) AS best,
             arg_min(list_concat(w.made, l.text), {'c': w.best.c + n.c, 'x': w.best.x || n.x}) AS made
      FROM walk w JOIN inserts n ON n.s = w.state JOIN lines l USING (roles) WHERE n.t IN (0, 3) GROUP BY w.conv_id, w.i
    )
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.best.c::BIGINT AS cost, e.best.x AS audit,
           sha256(array_to_string(e.made, chr(10))) AS repaired_sha256
    FROM ended e LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.i = coalesce(s.n, 0)
    """,
)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.llm.common import keep
    from haulmark.llm.conversations import damaged, digest, repair

    rows = table(spark, sf_dir, "conversations")
    return digest(keep(repair(rows, **damaged(rows)), "conversation-pieces"))


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT a.vec_id AS anchor, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ), p AS (
      SELECT anchor, vec_id AS positive, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor AS anchor_id, positive AS positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
           s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor = s.anchor AND NOT same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
    QUALIFY row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, s.vec_id) <= 5
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.llm.hard_negatives import mine, rows_of

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows_of(table(spark, sf_dir, "embeddings"), "vec_id", moved, F.col("embedding"))
    return mine(rows, F.col("vec_id") % 100 == 0)
