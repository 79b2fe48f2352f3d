"""The queries of the corpus operators, one opN_<name> each, with the parameters they run with in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwatch.llm import bpe, decontaminate, hamming, idfile, merkle, mixing, neardup, rules, secrets, sharding, token_counts, warc, whitening
from shelfwatch.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), split_pattern())


def op2_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op6_nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest_codes(table(spark, sf_dir, "embeddings"), every=20, k=10)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op11_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_benchmark_passages": op2_benchmark_passages,
    "op3_warc_round_trip": op3_warc_round_trip,
    "op4_minimax_shards": op4_minimax_shards,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_nearest_codes": op6_nearest_codes,
    "op7_token_counts": op7_token_counts,
    "op8_id_files": op8_id_files,
    "op9_rule_quality": op9_rule_quality,
    "op10_secret_spans": op10_secret_spans,
    "op11_merkle_proofs": op11_merkle_proofs,
    "op12_source_mix": op12_source_mix,
    "op13_whitened_embeddings": op13_whitened_embeddings,
}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Base 32 of a SHA-1: each five hex digits are four of its digits.
BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('" + ALPHABET + "', (('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4)))::BIGINT % 32 + 1, 1)), '')"



def merkle_sql(levels: int = 8) -> str:
    """Each level of the trees by name, those of the languages first and then that above them; a tree of one node stays as it is."""
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"
    fields = " || ".join(map(part, ("doc_id", "source", "lang", "n_chars")))
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 by its bits: after each byte eight shifts.
    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"
    out = [
        f"l AS (SELECT doc_id, lang, sha256({fields} || {part('text')}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({fields} || {part(small)}) END AS tampered FROM documents)",
        "r0 AS (SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, coalesce(tampered, leaf) AS cur, '' AS proof FROM l)",
        "a0 AS (SELECT tree, i, n, leaf AS h FROM r0)",
    ]
    left, right = "array_to_string(m[1 : r.i % 8], '')", "array_to_string(m[r.i % 8 + 2 :], '')"
    for k in range(2 * levels):
        if k == levels:
            out.append(f"top AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM a{k})")
            out.append(f"b{k} AS (SELECT '/' AS tree, i, n, h FROM top)")
            out.append(f"s{k} AS (SELECT doc_id, leaf, '/' AS tree, top.i, top.n, cur, proof, top.h AS subroot FROM r{k} r JOIN top ON top.tree = r.tree)")
        nodes, rows = (f"b{k}", f"s{k}") if k == levels else (f"a{k}", f"r{k}")
        out.append(f"m{k} AS (SELECT tree, i // 8 AS i, n, list(h ORDER BY i) AS m FROM {nodes} GROUP BY ALL)")
        out.append(f"a{k + 1} AS (SELECT tree, i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN m[1] ELSE sha256(array_to_string(m, '')) END AS h FROM m{k})")
        kept = "doc_id, leaf, r.tree, r.i // 8 AS i, (r.n + 7) // 8 AS n" + (", subroot" if k >= levels else "")
        out.append(f"r{k + 1} AS (SELECT {kept}, CASE WHEN r.n = 1 THEN cur ELSE sha256({left} || cur || {right}) END AS cur, CASE WHEN r.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof FROM {rows} r JOIN m{k} m ON m.tree = r.tree AND m.i = r.i // 8)")
    last = 2 * levels
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM r{last} JOIN a{last} USING (tree)"


#: Where SQL can say it. The others are held against a library, a brute-force version or held-out rows in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op11_merkle_proofs": merkle_sql(),
    "op3_warc_round_trip": f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS t, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top, sha1(coalesce(html, '')) AS h FROM pages)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, url AS uri FROM p""",
    "op5_near_duplicates": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
each_one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each_one a JOIN each_one b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM s JOIN least USING (doc_id)""",
    "op6_nearest_codes": """WITH c AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INT AS distance FROM c q JOIN c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank, vec_id, distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10""",
}
