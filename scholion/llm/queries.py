"""The queries of this subpackage: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

#: The rules of the URL query, and the hosts its digest array blocks besides.
URL_RULES = [("com/", False), ("example.com/en/", True), ("www.example.com/en/", False), ("net/es/", True), ("net/fr/", True)]
BLOCKED_HOSTS = [f"{name}.example.{tld}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org")]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import round_trips
    from .tokens import vocabulary

    return round_trips(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), 40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_HOSTS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), digest=True)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_texts
    from .tokens import vocabulary

    return pack_texts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048, end=0)


def op9_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .orc_tokens import summaries, write_tokens
    from .tokens import vocabulary

    folder = scratch(spark, "orc-tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), end=1)
    return summaries(spark, folder)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf import score, train

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_jaccard_join, op3_sentencepiece, op4_sharding, op5_url_filter, op6_quality_rules, op7_exact_dedup, op8_best_fit_packing, op9_orc_tokens, op10_quality_classifier)}

_BLOCKED = ", ".join(f"'{h}'" for h in BLOCKED_HOSTS)
ORACLE_SQL = {
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
        hit AS (SELECT doc_id, i FROM g QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
        gone AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM hit, range(0, 13) AS r(k) GROUP BY doc_id),
        kept AS (SELECT doc_id, len(w) AS n_words, len(w) - coalesce(len(gone), 0) AS n_kept, list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept FROM w LEFT JOIN gone USING (doc_id))
        SELECT doc_id, n_words, n_words - n_kept AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM kept""",
    "op2_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
        r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON r.a = n.doc_id JOIN documents d ON d.doc_id = r.a GROUP BY d.doc_id""",
    "op5_url_filter": rf"""
        WITH split AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM split),
        rules(rule, h, p, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
        fits AS (SELECT page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict FROM parts JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN len(list_filter([{_BLOCKED}], lambda b: host = b OR ends_with(host, '.' || b))) > 0 THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts LEFT JOIN fits USING (page_id)""",
    "op6_quality_rules": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
        dup AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(0, 5) AS r(k) GROUP BY doc_id),
        base AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
        l AS (SELECT doc_id, source, trim(regexp_replace(lower(unnest(string_split(t, chr(10)))), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM d),
        lw AS (SELECT doc_id, source, line, len(string_split(line, ' ')) AS words FROM l WHERE line <> ''),
        hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM lw GROUP BY source),
        freq AS (SELECT lw.source, line FROM lw JOIN hosts ON lw.source IS NOT DISTINCT FROM hosts.source GROUP BY ALL HAVING count(DISTINCT doc_id) > 2 AND count(DISTINCT doc_id) > 0.05 * any_value(docs)),
        rest AS (SELECT doc_id, count(freq.line) AS n_frequent, sum(words) AS all_words, sum(CASE WHEN freq.line IS NULL THEN words ELSE 0 END) AS left_words FROM lw LEFT JOIN freq ON lw.source IS NOT DISTINCT FROM freq.source AND lw.line = freq.line GROUP BY doc_id),
        gone AS (SELECT doc_id FROM rest WHERE n_frequent > 0 AND (left_words < 0.5 * all_words OR left_words < 10)),
        v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
        SELECT *, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM gone) AS kept FROM v""",
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256)""",
}
