"""Registered queries of the corpus operators, one per operator, with the SQL that checks them where SQL can."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelake.llm import alignment, bpe, exact_dedup, language, mixing, ngram_join, quality, secrets, spelling, suffix_dedup, toxicity, voronoi, warc
from strikelake.llm.common import LOWER, UPPER, configure, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = functools.wraps(fn)(lambda spark, sf_dir: fn(configure(spark), sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path() -> str:
    """The byte-level BPE file: from CORPUS_TOKENIZER, else the one of the installed public tokenizers."""
    if path := os.environ.get("CORPUS_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_register("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["ord"] < 3)
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secret_spans")).alias("spans"))


@_register("op2_bpe_round_trip")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


QUALITY_THRESHOLD = 0.7


@_register("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(4))
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), learn_from=fold("id") != 2, out="score").drop("text")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


@_register("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(5))
    scored = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), learn_from=fold("id") != 0, out="score").drop("text")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_register(
    "op5_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
    d AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS h FROM p),
    g AS (SELECT h, n, max(page_id) AS m FROM d WHERE n >= 1000 GROUP BY h, n)
    SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.h AS payload_digest,
           CASE WHEN g.m <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN g.m <> d.page_id THEN g.m END AS refers_to
    FROM d LEFT JOIN g ON d.h = g.h AND d.n = g.n""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_register(
    "op6_exact_dedup",
    f"""WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


@_register("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.mix(docs.select("doc_id", "text"), mixing.labelled_domains(docs, labels), mixing.even_targets, carry=["doc_id"])


@_register(
    "op8_top_k",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return voronoi.top_k(vectors.filter("vec_id % 100 = 0"), vectors)


@_register("op9_ngram_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@_register("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans, size = F.size("removed_spans").cast("long"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return cut.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept_bytes")).alias("n_removed"), spans.alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def piece_model_path() -> str:
    """The sentencepiece model: from CORPUS_PIECE_MODEL, else the one of the installed public tokenizers."""
    if path := os.environ.get("CORPUS_PIECE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_register("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), piece_model_path(), carry=["doc_id"], digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


@_register("op12_language")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda c: F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, learn_from=~fold("id"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", fold("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


#: A word of at least this many code points with at least this many occurrences is looked at; one occurrence in EDITED loses a letter.
SPELLING_LENGTH, SPELLING_COUNT, SPELLING_RATIO, EDITED = 6, 5, 5, 199


def _edited(doc_id: Column, word: Column) -> Column:
    """The contract's rule: an occurrence whose crc32 is divisible by EDITED loses the code point that the crc32 points to."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.char_length(word).cast("long")).cast("int")
    return F.when(F.pmod(h, F.lit(EDITED)) == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


#: Accented letters stand for one byte each, as DuckDB's levenshtein counts bytes.
_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x100))
_STAND_INS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).islower())[: len(_ACCENTED)]


@_register(
    "op13_spelling",
    f"""WITH RECURSIVE t AS (
        SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents),
    c AS (SELECT d, w, count(*) AS k FROM runs WHERE length(w) >= {SPELLING_LENGTH} GROUP BY d, w),
    b AS (SELECT w, k, hex(encode(d || ':' || w)) AS x FROM c),
    h AS (SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x)::BIGINT, 2), lambda i: ('0x' || x[i:i+1])::BIGINT)),
        lambda a, y: xor(t.crc[(xor(a, y) & 255) + 1], a >> 8))) AS h FROM b, t),
    e AS (SELECT CASE WHEN h % {EDITED} = 0 THEN substr(w, 1, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS w, k FROM h),
    v AS (SELECT w, sum(k)::BIGINT AS n, length(w) AS l, translate(w, '{_ACCENTED}', '{_STAND_INS.replace("'", "''")}') AS z FROM e GROUP BY w HAVING length(w) >= {SPELLING_LENGTH} AND sum(k) >= {SPELLING_COUNT}),
    p AS (SELECT a.w, a.n, b.w AS near, b.n AS m FROM v a JOIN v b ON b.l BETWEEN a.l - 1 AND a.l + 1 AND a.w <> b.w WHERE levenshtein(a.z, b.z) = 1),
    f AS (SELECT w, count(*) AS n_near, min((-m, near)) AS best FROM p GROUP BY w),
    g AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= {SPELLING_RATIO} * v.n THEN best[2] END AS form, CASE WHEN -best[1] >= {SPELLING_RATIO} * v.n THEN -best[1] END AS form_n FROM v LEFT JOIN f ON v.w = f.w),
    s AS (SELECT w, w AS root, form AS next FROM g UNION ALL SELECT s.w, g.w, g.form FROM s JOIN g ON s.next = g.w)
    SELECT g.w AS word, g.form, s.root, g.n::BIGINT AS n, g.n_near::BIGINT AS n_near, g.form_n::BIGINT AS form_n FROM g JOIN s ON g.w = s.w AND s.next IS NULL""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), SPELLING_LENGTH, SPELLING_COUNT, _edited)
    return spelling.group_variants(counts, SPELLING_RATIO)
