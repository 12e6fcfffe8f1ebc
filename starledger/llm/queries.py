"""Driver queries of this folder, with SQL where it can say the same over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from starledger.llm import (ball_tree, bpe, chat_format, exact_dedup, manifest, near_dedup, packing, quality_qda,
                            quality_rules, runs, toxicity, url_filter, warc)
from starledger.llm.common import pick, table
from starledger.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

ASCII_LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
               "'abcdefghijklmnopqrstuvwxyz')")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_exact_dedup", f"""
    WITH d AS (SELECT doc_id, {ASCII_LOWER} AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
    FROM d""")
def op1(spark, sf_dir):
    return exact_dedup.groups(table(spark, sf_dir, "documents"), keep="largest")


@query("op2_quality_rules")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


@query("op3_chat_perspectives", """
    WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text
               FROM conversations),
    p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
    h AS (SELECT t.*, perspective,
                 '<|' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker
                              ELSE 'user name=' || speaker END || '|>' || chr(10) AS head
          FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
    s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM h),
    r AS (SELECT *, row_number() OVER w - 1 AS position,
                 coalesce(CAST(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                               AS BIGINT), 0) AS segment_start
          FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
    SELECT conv_id, perspective, position, speaker, segment, segment_start,
           CASE WHEN speaker = perspective THEN segment_start + length(head) END AS mask_start,
           CASE WHEN speaker = perspective THEN segment_start + length(segment) END AS mask_end
    FROM r""")
def op3(spark, sf_dir):
    return chat_format.perspectives(table(spark, sf_dir, "conversations"))


@query("op4_warc_archives", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(encode(body)) AS h,
                 min(page_id) OVER (PARTITION BY body) AS first_id FROM p),
    b AS (SELECT *, array_to_string(list_transform(range(1, 41),
              lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011',
                    '1100','1101','1110','1111'][strpos('0123456789abcdef', substr(h, i, 1))]), '') AS bits FROM d)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + 16 * CAST(substr(bits, 5*i+1, 1) AS INT) + 8 * CAST(substr(bits, 5*i+2, 1) AS INT)
                 + 4 * CAST(substr(bits, 5*i+3, 1) AS INT) + 2 * CAST(substr(bits, 5*i+4, 1) AS INT)
                 + CAST(substr(bits, 5*i+5, 1) AS INT), 1)), '') AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM b""")
def op4(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"), scratch_path(spark, "warc")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_byte_bpe")
def op5(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A host is put on the list if one of its labels has one of these words.
LISTED_WORDS = "(^|[^a-z0-9])(casino|spam|adult|ads|track|malware|phishing)([^a-z0-9]|$)"


@query("op6_url_filter", f"""
    WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    f AS (SELECT *, CASE
            WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/')
              THEN 'www.example.com/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/')
              THEN 'example.com/en/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                WHEN regexp_matches(host, '{LISTED_WORDS}') THEN 'block' ELSE 'allow' END AS verdict
    FROM f""")
def op6(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host, _ = url_filter.host_and_path(F.col("url"))
    listed = pages.select(host.alias("key")).distinct().filter(F.col("key").rlike(LISTED_WORDS))
    return url_filter.judge(pages, listed, URL_RULES)


@query("op7_quality_classifier")
def op7(spark, sf_dir):
    return quality_qda.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_best_fit_packing")
def op8(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=2048, end_id=0)


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op10_minhash_near_dedup")
def op10(spark, sf_dir):
    return near_dedup.classes(table(spark, sf_dir, "documents"), n_words=4, percent=80)


@query("op11_exact_top_k", """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding,
                   lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
               WHERE embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id,
                 CAST(list_sum(list_transform(range(1, 1 + least(len(a.q), len(b.q))),
                                              lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
          FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS place FROM s)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM o WHERE place <= 5""")
def op11(spark, sf_dir):
    rows = ball_tree.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256.0)
    return ball_tree.top_k(rows, rows.filter("id % 50 = 0"), 5)


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", "[ \\t-\\r]+"), "")
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
    repeated = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(block), F.lit(1), n - a))
    planted = docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), F.array_join(repeated, " "))
                          .otherwise(F.col("text")).alias("text"))
    best = runs.strongest(F.col("runs"))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return runs.collapse(planted, least=24, exponent=3).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(listed, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def merkle_sql(levels: int = 7) -> str:
    """Every level of the trees as two steps; enough for 8 ** levels documents of a language."""
    def leaf(text):
        fields = [f"CAST({f} AS VARCHAR)" for f in LEAF_FIELDS[:-1]] + [text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"

    crc = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(s) + 1),
                 lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)],
                 [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384)
                 ELSE x >> 1 END)), 4294967295)"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""d AS (SELECT *, {leaf('text')} AS leaf, {leaf(lower)} AS other, CAST(doc_id AS VARCHAR) AS s
                       FROM documents)""",
             f"""t AS (SELECT doc_id, lang, leaf, CASE WHEN {crc} % 3 = 0 THEN other ELSE leaf END AS fold,
                              dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
                              row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                              count(*) OVER (PARTITION BY lang) AS n FROM d)""",
             "a0 AS (SELECT tree, pos, n, leaf AS digest FROM t)",
             "sa0 AS (SELECT *, '' AS proof, pos AS doc_pos FROM t)"]

    def climb(name):
        for k in range(levels):
            left, right = "array_to_string(ds[1:pos % 8], '')", "array_to_string(ds[pos % 8 + 2:], '')"
            yield f"""g{name}{k} AS (SELECT tree, pos // 8 AS up, n, list(digest ORDER BY pos) AS ds FROM {name}{k}
                                     GROUP BY tree, pos // 8, n)"""
            yield f"""{name}{k + 1} AS (SELECT tree, up AS pos, (n + 7) // 8 AS n,
                          CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS digest
                          FROM g{name}{k})"""
            yield f"""s{name}{k + 1} AS (SELECT s.* REPLACE (pos // 8 AS pos,
                          CASE WHEN g.n = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold,
                          CASE WHEN g.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof)
                          FROM s{name}{k} s JOIN g{name}{k} g ON s.tree = g.tree AND s.pos // 8 = g.up)"""

    steps += climb("a")
    steps.append(f"b0 AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, digest FROM a{levels})")
    steps.append(f"""sb0 AS (SELECT s.* REPLACE (0 AS tree, s.tree AS pos), digest AS subroot
                             FROM sa{levels} s JOIN a{levels} a ON s.tree = a.tree)""")
    steps += climb("b")
    return f"""WITH {", ".join(steps)}
               SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
                      fold = r.digest AS verified FROM sb{levels}, b{levels} r"""


@query("op13_merkle_manifest", merkle_sql())
def op13(spark, sf_dir):
    docs = pick(table(spark, sf_dir, "documents"), **{f: f for f in LEAF_FIELDS})
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", capitals, capitals.lower())
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = docs.withColumn("tampered", F.when(chosen, manifest.digest(*LEAF_FIELDS[:-1], lowered)))
    rows = manifest.build(tampered, list(LEAF_FIELDS), carry=["tampered"])
    folded = rows.withColumn("folded_root", manifest.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root",
                         F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
