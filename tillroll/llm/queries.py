"""The registered queries of the training-data operators, each over the whole of its table, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm import (
    centroid_clustering,
    decontamination,
    html_extraction,
    language_id,
    mixing,
    nearest_neighbours,
    prefix_trie,
    quality_rules,
    sharding,
    simhash,
    site_quality,
    substring_dedup,
    url_filters,
)

from tillroll.llm.common import saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.per_row(mixing.plan(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_spans(docs, _table(spark, sf_dir, "benchmark"), keep_text=False, unnamed=True)
    hit = decontamination.n_hit(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark WHERE text IS NOT NULL
), sized AS (
    SELECT *, least(len(words), 10) AS n FROM b WHERE len(words) > 0
), wins AS (
    SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM sized)
), here AS (
    SELECT r, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(words) >= n)
), hits AS (
    SELECT DISTINCT r, i, n, item_id FROM here JOIN wins USING (n, win)
), hit_words AS (
    SELECT r, count(DISTINCT p) AS n_hit
    FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), hit_items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language_id.learn(docs.filter(~held_out).select("text", "lang"))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.predict(spark, model, rows)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = saved(simhash.with_fingerprint(docs, "fp").select("doc_id", "fp"), "fingerprints")
    rows = simhash.near_duplicates(prints)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def sharded(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Equal texts follow each other in the order that is cut into shards."""
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8
    crc = F.crc32(F.encode(text, "UTF-8"))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text).alias("_text"))
    out = sharding.assign_shards(rows, [F.col("_text"), F.col("doc_id")], F.col("size"), n_shards)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", F.col("slot").cast("bigint"), grown)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(_table(spark, sf_dir, "documents"))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source stands for its host, its language section for the path."""
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low"), "toxic")
    return site_quality.judged(docs, labels)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")), "v1")
    base = F.lit(quality_rules.mask(quality_rules.BASE)).cast("bigint")
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failed").bitwiseAND(base) != 0).alias("base_failed"),
        "kept",
        "failed",
        "n_lines",
        "n_letters",
        "n_stutter",
    )


OP7_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), w AS (
    SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d
), five AS (
    SELECT r, i, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o) AS four,
        lead(word, 4) OVER o AS fifth
    FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), g AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, four, fifth) AS n FROM five WHERE fifth IS NOT NULL
), covered AS (
    SELECT r, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY r
), m AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters,
        len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutter,
        coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM d LEFT JOIN covered USING (r)
), f AS (
    SELECT *, (n_words < 10)::INT AS b0, (100 * n_repeat_words > 20 * n_words)::INT AS b1,
        (10 * n_symbols > 3 * n_words)::INT AS b2, (2 * n_dup_lines > n_lines)::INT AS b3,
        (word_chars < 2 * n_words)::INT AS b4, (word_chars > 20 * n_words)::INT AS b5,
        (5 * n_letters < 2 * word_chars)::INT AS b6, (10 * n_stutter > 3 * n_words)::INT AS b7
    FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, (b0 + b1 > 0) AS base_failed,
    (b0 + b1 + b2 + b3 + b4 + b5 + b6 + b7 = 0) AS kept,
    (b0 + 2 * b1 + 4 * b2 + 8 * b3 + 16 * b4 + 32 * b5 + 64 * b6 + 128 * b7)::BIGINT AS failed,
    n_lines::BIGINT AS n_lines, n_letters::BIGINT AS n_letters, n_stutter::BIGINT AS n_stutter
FROM f
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_table(spark, sf_dir, "documents"), with_text=False)


OP8_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), w AS (
    SELECT r, i, array_to_string(words[i:i + 34], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS n FROM w) WHERE n > 1
), hit AS (
    SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM twice)
), words AS (
    SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d
), kept AS (
    SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN hit USING (r, p) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extraction.with_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.col("main_text")
    return pages.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))


# (verdict, host, path prefix)
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's last path segment is the document that it shows, and so has that document's labels."""
    number = F.regexp_extract(url_filters.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    key = F.when(number != "", number).cast("bigint")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", key.alias("_label_key"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), bad.alias("bad"))
    rows = url_filters.judged(pages, labels, URL_RULES)
    return rows.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = centroid_clustering.clustered(_table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    digest = F.array(*[F.lit(d) for d in digests]) if digests else F.lit(None).cast("array<string>")
    rows = centroid_clustering.with_inertia(rows).withColumnRenamed("id", "vec_id")
    return rows.withColumn("centroid_sha256", F.get(digest, F.col("cluster")))


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round measures all distances: a step for the assignment and one for the means, the same each time."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""apart{i} AS (
    SELECT r, number, list_sum(list_transform(range(1, 65), lambda j: (v[j] - c[j]) * (v[j] - c[j])))::BIGINT AS d
    FROM x, c{i}
)""")
        steps.append(f"""near{i} AS MATERIALIZED (
    SELECT r, number, d FROM apart{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, number) = 1
)""")
        if i < rounds:
            steps.append(f"""means{i} AS (
    SELECT number, j, sum(v[j])::BIGINT AS total, count(*) AS n
    FROM near{i} JOIN x USING (r), range(1, 65) AS t(j) GROUP BY number, j
), c{i + 1} AS MATERIALIZED (
    SELECT number, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
        SELECT number, list((total - ((total % n) + n) % n) // n ORDER BY j) AS c FROM means{i} GROUP BY number
    ) m USING (number)
)""")
    return f"""
WITH x AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1 AS number, v AS c
    FROM x WHERE vec_id IS NOT NULL QUALIFY number < {k}
), {", ".join(steps)}
SELECT vec_id, number::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY number))::BIGINT AS cluster_inertia,
    (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{rounds} JOIN x USING (r) JOIN c{rounds} USING (number)
"""


OP11_SQL = _op11_sql()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their hundred.

    The turns are dealt by that conversation, so its start meets the others without a further shuffle of theirs.
    """
    first = F.col("conv_id") - F.col("conv_id") % 100
    own = prefix_trie.sequences(conversations.withColumn("first", first), "first")
    heads = prefix_trie.sequences(conversations.filter(F.col("conv_id") % 100 == 0))
    heads = heads.select(F.col("conv_id").alias("first"), F.slice("turns", 1, 5).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    head = F.coalesce(F.slice("head", 1, n), F.expr("slice(turns, 1, 0)"))
    rest = F.slice("turns", n + 1, F.size("turns"))
    return own.join(heads, "first", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(rebuilt(_table(spark, sf_dir, "conversations")))


OP12_SQL = r"""
WITH ids AS (
    SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
    -- CRC-32 of the decimal digits: eight shifts a byte, from all ones to its complement
    SELECT c, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda state, byte: list_reduce(
            list_prepend(xor(state, byte), range(8)),
            lambda s, i: xor(s >> 1, (s & 1) * 3988292384)
        ))) % 6 AS h
    FROM ids
), turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
    ) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), again AS (
    SELECT crc.c, i, role, text FROM crc JOIN turns t ON t.c = crc.c - crc.c % 100 AND i <= h
    UNION ALL
    SELECT crc.c, i + 1000000000, role, text FROM crc JOIN turns t ON t.c = crc.c AND i > h
), whole AS (
    SELECT c, coalesce(list({'role': role, 'text': text} ORDER BY i) FILTER (i IS NOT NULL), []) AS s
    FROM ids LEFT JOIN again USING (c) GROUP BY c
), firsts AS (
    SELECT c, len(s) AS n, d, s[1:d] AS p FROM whole, LATERAL (SELECT unnest(range(0, len(s) + 1)) AS d)
), nodes AS MATERIALIZED (
    SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends,
        CASE WHEN d > 0 THEN (count(*) - 1) * length(p[d].text) ELSE 0 END AS own_saved
    FROM firsts GROUP BY p, d
), children AS (
    SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), marked AS (
    SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (p, d)
), below AS (
    SELECT p[1:k] AS p, k AS d, sum(own_saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM marked) GROUP BY ALL
)
SELECT m.conv_id, m.d::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs,
    m.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
    sha256(coalesce(m.ends, '')) AS ends_sha256
FROM marked m JOIN below USING (p, d) LEFT JOIN nodes u ON u.d = m.d - 1 AND u.p = m.p[1:m.d - 1]
"""


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest_neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select(*[F.col(c).cast("bigint") for c in ("query_id",)], "rank", F.col("vec_id").cast("bigint"), "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_decontamination": op2_decontamination,
        "op3_language_id": op3_language_id,
        "op4_simhash": op4_simhash,
        "op5_sharding": op5_sharding,
        "op6_site_quality": op6_site_quality,
        "op7_quality_rules": op7_quality_rules,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_html_extraction": op9_html_extraction,
        "op10_url_filters": op10_url_filters,
        "op11_clustering": op11_clustering,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_neighbours": op13_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": OP2_SQL,
        "op7_quality_rules": OP7_SQL,
        "op8_substring_dedup": OP8_SQL,
        "op11_clustering": OP11_SQL,
        "op12_prefix_trie": OP12_SQL,
    }
