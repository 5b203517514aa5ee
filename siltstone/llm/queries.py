"""The thirteen operators bound to the synthetic tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, decontaminate, dialogue, html, jpeg, lexical, licences, pii, quality, secrets, sharding, simhash, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("secrets")


def op2_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_columns(table(spark, sf_dir, "documents")).drop("media")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read_documents(spark, path)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), byte_vocabulary()).drop("ids", "decoded")


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op7_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    scored = quality.score_quality(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op8_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("values")


def op11_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents")).drop("spans")


def op12_dijkstra_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogue.damaged(table(spark, sf_dir, "conversations"))
    return dialogue.repair_conversations(rows, copies=F.col("copies"), messages=False)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_page_differencing, op3_jpeg_media, op4_wavelet_shards, op5_byte_bpe, op6_rendezvous_shards, op7_nbsvm_quality,
        op8_wu_manber_decontamination, op9_simhash_near_dedup, op10_weak_pii, op11_licence_automaton, op12_dijkstra_repair, op13_lexical_search,
    )
}

_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_SPACE = "\\x20\\x09-\\x0D"


def _edit(key: str, cost: str, letter: str) -> str:
    """SQL of a key (nine digits of cost, then the audit) after one more edit."""
    return f"lpad((left({key}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({key}, 10) || '{letter}'"


def _to(key: str, role: str) -> str:
    """SQL of a key after the row was kept or reroled to ``role``; null where only deleting it helps."""
    return f"CASE WHEN o.fault IN (1, 2) THEN NULL WHEN left(o.role, 1) = '{role}' THEN {_edit(key, 'late', 'K')} ELSE {_edit(key, '2 + late', 'R')} END"


#: A dynamic programme over the rows of a conversation, state by state, beside the operator's search by cost.
_REPAIR = f"""
    WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
            lambda a, b: list_reduce(generate_series(0::BIGINT, 7::BIGINT), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295::BIGINT)) % 20 AS kind FROM conversations),
    d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(generate_series(1, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM d),
    o AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_SPACE}]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2
        WHEN NOT regexp_matches(text, '[.!?][{_SPACE}]*\\z') THEN 3 ELSE 0 END AS fault,
        left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) || left(role, 1) AS pair FROM k),
    r AS (SELECT conv_id, 0::BIGINT AS k, '000000000' AS p0, NULL::VARCHAR AS ps, '000000002I' AS pu, '000000004II' AS pa FROM (SELECT DISTINCT conv_id FROM k)
      UNION ALL SELECT conv_id, k, n0, ns, u, least(na, {_edit("u", "2", "I")}) FROM
        (SELECT *, least(nu, {_edit("n0", "2", "I")}, {_edit("ns", "2", "I")}, {_edit("na", "2", "I")}) AS u FROM
          (SELECT conv_id, k, {_edit("p0", "3", "D")} AS n0,
            least({_edit("ps", "3", "D")}, CASE WHEN fault NOT IN (1, 2) AND left(role, 1) = 's' THEN {_edit("p0", "late", "K")} END) AS ns,
            least({_edit("pu", "3", "D")}, {_to("p0", "u")}, {_to("ps", "u")}, {_to("pa", "u")}) AS nu,
            least({_edit("pa", "3", "D")}, {_to("pu", "a")}) AS na FROM
            (SELECT o.conv_id, o.k, o.role, o.fault, (o.fault = 3)::INT AS late, p0, ps, pu, pa FROM r JOIN o ON o.conv_id IS NOT DISTINCT FROM r.conv_id AND o.k = r.k + 1) o))),
    f AS (SELECT conv_id, left(key, 9)::BIGINT AS cost, substr(key, 10) AS audit FROM (SELECT conv_id, arg_max(least(p0, pa), k) AS key FROM r GROUP BY conv_id)),
    e AS (SELECT conv_id, audit, unnest(generate_series(1, length(audit))) AS j FROM f),
    x AS (SELECT conv_id, j, audit[j] AS edit, length(replace(left(audit, j), 'I', '')) AS k, length(replace(left(audit, j), 'D', '')) AS place FROM e),
    y AS (SELECT x.*, o.role, o.text, bool_or(edit = 'K' AND place = 1 AND left(o.role, 1) = 's') OVER (PARTITION BY x.conv_id)::INT AS has_s
        FROM x LEFT JOIN o ON edit <> 'I' AND x.conv_id IS NOT DISTINCT FROM o.conv_id AND x.k = o.k),
    z AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - coalesce(has_s, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
        CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS digest FROM y WHERE edit <> 'D' GROUP BY conv_id),
    g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate,
        count_if(fault = 3) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv_id)
    SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
        coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id
        LEFT JOIN f ON a.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id"""

#: DuckDB SQL where SQL can express an operator; the others are tested by brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op8_wu_manber_decontamination": f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents),
    b AS (SELECT item_id::VARCHAR AS item_id, {_FOLDED} AS w FROM benchmark WHERE item_id IS NOT NULL),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s FROM
        (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)),
    dw AS (SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s FROM
        (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
    hit AS (SELECT DISTINCT r, k, n, item_id FROM dw JOIN bw USING (n, s)),
    words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS p FROM hit) GROUP BY r),
    items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op13_lexical_search": f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w)::BIGINT AS n FROM (SELECT doc_id, {_FOLDED} AS w FROM documents) WHERE len(w) > 0),
    s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d),
    q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_FOLDED}) AS t FROM benchmark)),
    tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
    w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY t),
    p AS (SELECT tf.r, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS part FROM tf JOIN w USING (t) JOIN d USING (r), s),
    k AS (SELECT item_id, doc_id, r, sum(part)::BIGINT AS score FROM p JOIN q USING (t) GROUP BY item_id, doc_id, r HAVING sum(part) > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM
        (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM k) WHERE rank <= 50""",
    "op12_dijkstra_repair": _REPAIR,
}
