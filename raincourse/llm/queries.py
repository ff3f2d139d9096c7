"""One registered query per operator, with SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raincourse.llm import align, exact_dedup, infill, language, lm, minhash, mix, pack, pii, quality, token_counts, vectors, warc
from raincourse.llm.learn import remainder
from raincourse.session import sized

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def register(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return put


@register()
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text of documents."""
    return pii.digest(pii.find_pii(table(spark, folder, "documents")))


@register()
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of documents."""
    import public_tokenizers

    return token_counts.count_tokens(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register()
def op3_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of equal label with cosine of 0.98 or more."""
    return vectors.link_vectors(table(spark, folder, "embeddings"))


OP4_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mix.WORD}')) AS size,
    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS tie,
    CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key
  FROM documents),
per AS (SELECT key, source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY key, source),
weighted AS (SELECT *, 2.0 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM per),
levels AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighted WINDOW o AS (ORDER BY cap / w, source IS NULL, encode(source))),
targets AS (SELECT key, source_size, least(cap, w * coalesce((SELECT min_by(b.level, b.cap / b.w) FROM levels b WHERE b.level * b.w <= b.cap AND b.cap / b.w <= a.cap / a.w), 1e300)) AS target FROM levels a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size, tie) - 1 AS r,
    CAST('0x' || substr(md5('mix' || key), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM docs),
rates AS (SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate FROM ranked r JOIN targets t USING (key))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST((floor((r + 1) * rate + u) - floor(r * rate + u)) * size AS BIGINT) AS taken FROM rates"""


@register(OP4_SQL)
def op4_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of documents: 150 % of all words, weights 5, 2, 1, at most twice a source."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    mixed = mix.mixed(docs)
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@register()
def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near copies of documents on five-word shingles at 0.85."""
    return minhash.near_duplicates(table(spark, folder, "documents"), percent=85).drop("cls")


@register("""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Equal texts of documents against a fresh index, newest ids first."""
    digests = exact_dedup.digests_of(table(spark, folder, "documents"))
    index = f"digest_index_{spark.range(1).select(F.uuid()).first()[0].replace('-', '')}"
    found = exact_dedup.dedup(digests, index).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    spark.sql(f"DROP TABLE IF EXISTS {index}")  # this index serves one answer, which is written elsewhere
    return found


@register()
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every text of documents."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    return quality.classify(docs, labels).select("row.doc_id", "held_out", "score", "predicted")


@register()
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text of documents."""
    docs = table(spark, folder, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@register()
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in as few sequences of 4096 tokens as best fit needs."""
    return pack.pack(pack.cut(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json")))


OP10_SQL = f"""
WITH n AS (SELECT greatest(1, (count(*) + {warc.RECORDS - 1}) // {warc.RECORDS}) AS files FROM pages),
bodies AS (SELECT page_id, url, md5(coalesce(CAST(page_id AS VARCHAR), 'null')) AS mark, encode(coalesce(html, '')) AS body FROM pages),
blocks AS (SELECT page_id, url, mark, body, encode('HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(body) || chr(13) || chr(10) || chr(13) || chr(10)) || body AS block FROM bodies),
records AS (SELECT page_id, mark, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
    || substr(mark, 1, 8) || '-' || substr(mark, 9, 4) || '-' || substr(mark, 13, 4) || '-' || substr(mark, 17, 4) || '-' || substr(mark, 21, 12) || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Date: {warc.DATE}' || chr(13) || chr(10)
    || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(block) || chr(13) || chr(10) || chr(13) || chr(10)) || block || encode(chr(13) || chr(10) || chr(13) || chr(10)) AS record FROM blocks),
placed AS (SELECT CAST('0x' || substr(mark, 1, 8) AS BIGINT) % files AS file, page_id, mark, octet_length(record) AS length, record FROM records, n),
ordered AS (SELECT file, row_number() OVER o - 1 AS "at", page_id, mark, sum(length) OVER o - length AS start, length, record FROM placed WINDOW o AS (PARTITION BY file ORDER BY page_id))
SELECT file, "at", page_id, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
  sha256(start || ':' || length || ':' || sha256(record)) AS expected,
  sha256(start || ':' || length || ':' || sha256(record[1:length - 5] || encode('~') || record[length - 3:length])) AS found
FROM ordered WHERE substr(mark, 1, 1) = '0'"""


@register(OP10_SQL)
def op10_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged records of a second replica of all pages, found by comparing Merkle trees.

    The replica is made from the pages: in one of 16 records, by a hash of the id, the last octet
    of the block is overwritten.
    """
    good = warc.response_records(table(spark, folder, "pages"))
    hit = F.md5(F.col("page_id").cast("string").cast("binary")).startswith("0")
    n = F.octet_length("record")
    broken = F.concat(F.expr("substring(record, 1, octet_length(record) - 5)"), F.lit("~").cast("binary"), F.expr("substring(record, octet_length(record) - 3, 4)"))
    return warc.audit_replicas(good, good.withColumn("record", F.when(hit & (n > 5), broken).otherwise(F.col("record")))).drop("kind")


OP11_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
drawn AS (SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM docs),
cut AS (SELECT doc_id, text, n, form, array_to_string(units[1:least(one, two)], '') AS prefix,
    array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle, array_to_string(units[greatest(one, two) + 1:], '') AS suffix FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM cut"""


@register(OP11_SQL)
def op11_infill(spark: SparkSession, folder: str) -> DataFrame:
    """Documents rearranged for filling in the middle, and their texts rebuilt."""
    cut = infill.fill_in_middle(table(spark, folder, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored()).alias("restored_sha256"))


@register()
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of tokens of two tokenizers over every text, and how common their links are."""
    import public_tokenizers

    rows = align.aligned(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN, tokenizer("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return align.count_links(sized(rows.withColumn("groups_sha256", digest).drop("groups"), "aligned"))


@register()
def op13_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of every text under a recurrent language model and under word counts."""
    docs = table(spark, folder, "documents")
    model = lm.train(docs.where(~lm.held_out()))
    return lm.score(docs, model).select("doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
