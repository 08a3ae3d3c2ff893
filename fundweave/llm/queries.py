"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bottomk, decontam, linededup, mixing, secrets, simhash, spelling, tokenattr, tokenfile, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, plan = mixing.mixture(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3, seed=42)
    return mixing.taken(sizes, plan).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), query_every=50, k=5, codes=32, recall=0.98, sample_rows=20_000)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), words=3, max_bits=2)
    return found.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.write_archives(_table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    found = warc.read_archives(index, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))

    def joined(spans):
        parts = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
        return F.array_join(parts, ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select(
        F.col("id").alias("doc_id"), number("assign"), number("access"), number("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.kept_texts(_table(spark, sf_dir, "documents"), min_chars=10)
    return found.select(F.col("doc").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), sample_rows=20_000, levels=2)
    found = toxicity.with_severity(docs, model)
    severity = F.col("__severity")
    return found.select("doc_id", severity.alias("expected_severity"), (severity >= model.reject_at).alias("toxic"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenattr.attribute(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), rule="most")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    files, folder = tokenfile.token_output(_table(spark, sf_dir, "documents"), tokenizer_path=path, end_id=2)
    return tokenfile.document_digests(files, folder)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, _table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("__items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.aligned_sums(_table(spark, sf_dir, "documents"), path_a=a, path_b=b)
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(_table(spark, sf_dir, "documents"), least_length=5, least_count=3, ratio=2)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bottomk.near_sets(_table(spark, sf_dir, "documents"), words=2, similarity=0.8)
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_neighbours": op2_neighbours,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_secret_scan": op5_secret_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_token_ids": op9_token_ids,
    "op10_decontamination": op10_decontamination,
    "op11_alignment": op11_alignment,
    "op12_spelling": op12_spelling,
    "op13_minhash": op13_minhash,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3] AS weight FROM s),
        o AS (
            SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(weight) OVER () AS total_w,
                   coalesce(sum(3 * source_size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS w_before
            FROM w WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, cap::HUGEINT * (total_w - w_before) <= (total - cap_before) * weight AS is_full FROM o),
        g AS (SELECT *, coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS full_size,
                     coalesce(sum(weight) FILTER (is_full) OVER (), 0) AS full_w FROM f),
        t AS (SELECT source, source_size,
                     CASE WHEN is_full THEN cap::DOUBLE
                          ELSE (weight::DOUBLE * (total - full_size)::DOUBLE) / (total_w - full_w)::DOUBLE END AS target
              FROM g),
        u AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size)::BIGINT, 3) ELSE 0 END AS whole
              FROM t),
        k AS (SELECT d.*, md5('42:' || coalesce(doc_id::VARCHAR, '')) || lpad(size::VARCHAR, 15, '0') AS key FROM d),
        c AS (SELECT source, key, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) AS upto, sum(size) AS size
              FROM k GROUP BY source, key)
        SELECT k.doc_id, k.size, u.source_size, u.target,
               (k.size * (u.whole + CASE WHEN u.target - (u.whole * u.source_size)::DOUBLE > 0
                    AND (2 * c.upto - c.size)::DOUBLE <= 2 * (u.target - (u.whole * u.source_size)::DOUBLE)
                    THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM k JOIN u ON k.source IS NOT DISTINCT FROM u.source
        JOIN c ON c.source IS NOT DISTINCT FROM k.source AND c.key = k.key""",
    "op4_warc": r"""
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                   sha1(coalesce(html, '')) AS sha FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first_id FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          1 + ((('0x' || substr(sha, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER,
                          1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op6_line_dedup": rf"""
        WITH l AS (
            SELECT doc_id, i, ls[i] AS line,
                   translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             '{_UPPER}', '{_LOWER}') AS key
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
                 unnest(range(1, len(ls) + 1)) AS t(i)),
        k AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10
              GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        m AS (SELECT l.*, k.key IS NULL OR l.doc_id = k.first_doc AS keep FROM l LEFT JOIN k USING (key))
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (NOT keep))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op10_decontamination": rf"""
        WITH b AS (
            SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM benchmark),
        bl AS (SELECT item_id, ws, least(10, len(ws)) AS size FROM b WHERE len(ws) > 0),
        bw AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS w
               FROM bl, unnest(range(1, len(ws) - size + 2)) AS t(i)),
        d AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
            FROM documents),
        dw AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS w
               FROM d, (SELECT DISTINCT size FROM bl) AS z, unnest(range(1, len(ws) - size + 2)) AS t(i)),
        h AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, w)),
        n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + size)) AS t(j) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
               FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit,
               coalesce(it.n_items, 0)::BIGINT AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256,
               coalesce(n.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op12_spelling": rf"""
        WITH RECURSIVE bits AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
        r AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run
            FROM documents),
        g AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY doc_id, run),
        x AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS raw FROM g),
        h AS (
            SELECT run, n, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(range(length(raw) // 2), lambda k: ('0x' || substr(raw, 2 * k + 1, 2))::BIGINT)),
                lambda c, b: xor(crc[1 + (xor(c, b) & 255)], c >> 8))) AS h
            FROM x, bits),
        d AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
            FROM h),
        w AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        l AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM w, unnest(range(length(word))) AS t(i)),
        e AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM l a JOIN l b USING (rest, i) WHERE a.word <> b.word
            UNION SELECT l.word, w.word, w.n FROM l JOIN w ON l.rest = w.word
            UNION SELECT w.word, l.word, l.n FROM l JOIN w ON l.rest = w.word),
        b AS (
            SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM e GROUP BY word),
        f AS (
            SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
                   CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
            FROM w LEFT JOIN b USING (word)),
        c AS (
            SELECT word, word AS last, 0 AS steps FROM f
            UNION ALL SELECT c.word, f.form, steps + 1 FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL),
        z AS (SELECT word, arg_max(last, steps) AS root FROM c GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)""",
    "op13_minhash": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws
                   ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingle
            FROM d),
        n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y USING (shingle)
            WHERE x.doc_id < y.doc_id GROUP BY ALL),
        l AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
        r AS (
            SELECT doc_id AS a, doc_id AS b FROM d
            UNION SELECT r.a, e.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) e ON e.a = r.b),
        m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)""",
}
