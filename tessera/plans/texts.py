"""Queries of cleaning, segmentation, chunking, hashing and formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import chunking, cleaning, embedding, html, text
from tessera.plans.views import MESSAGES, Catalog, messages, table

CATALOG = Catalog()
query = CATALOG.add

_HAN = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}"


@query(f"SELECT doc_id, CASE WHEN text = '' THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(text, '([{_HAN}])', ' \\1 ', 'g'), '([{_HAN}])  ([{_HAN}])', '\\1 \\2', 'g'), '', '') END AS segmented FROM documents")
def segment_cjk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.segment_cjk("text").alias("segmented"))


@query(f"""WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[{_HAN}]')) AS cjk, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS words,
  length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS latin FROM documents)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE CAST(floor(cjk + words * CAST(1.3 AS DOUBLE) + greatest(0, length(text) - cjk - latin) * CAST(0.25 AS DOUBLE)) AS INTEGER) + 1 END AS tokens FROM c""")
def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens("text").alias("tokens"))


@query("SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS tokens FROM documents")
def index_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.tokens("text").alias("tokens"))


@query(f"WITH {MESSAGES} SELECT message_pk, sha256(coalesce(subject, '') || chr(0) || coalesce(body_text, '')) AS fingerprint FROM messages")
def content_fingerprint(spark, sf_dir):
    return messages(spark, sf_dir).select("message_pk", text.fingerprint("subject", "body_text").alias("fingerprint"))


@query(f"WITH {MESSAGES} SELECT message_pk, sha256(message_id || '|0|' || body_text) AS chunk_hash FROM messages")
def chunk_hash(spark, sf_dir):
    return messages(spark, sf_dir).select("message_pk", text.chunk_hash("message_id", F.lit(0), "body_text").alias("chunk_hash"))


_TOKEN = r"\b[A-Za-z0-9]{24,}\b"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b(bearer\\s+)([A-Za-z0-9._\\-+/=]{{8,}})', '\\1{text.HIDDEN}', 'g'), '(?i)\\b({text.SECRET_KEYS})\\b\\s*[:=]\\s*(?:\"([^\\s''\",;)}}\\]]+)\"|''([^\\s''\",;)}}\\]]+)''|([^\\s''\",;)}}\\]]+))', '\\1={text.HIDDEN}', 'g'), '{_TOKEN}', '{text.HIDDEN}', 'g') AS redacted FROM documents")
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redact("text").alias("redacted"))


@query("SELECT c_custkey, CASE WHEN length(n) > 2 THEN substr(n, 1, 2) ELSE substr(n, 1, 1) END || '***@example.com' AS masked FROM (SELECT c_custkey, c_name AS n FROM customer)")
def mask_address(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.mask_address(F.concat("c_name", F.lit("@example.com"))).alias("masked"))


@query("""SELECT doc_id, CASE WHEN s >= 1073741824 THEN printf('%.1fGB', s / 1073741824.0) WHEN s >= 1048576 THEN printf('%.1fMB', s / 1048576.0)
  WHEN s >= 1024 THEN printf('%.1fKB', s / 1024.0) ELSE s || 'B' END AS size FROM (SELECT doc_id, n_chars * 512 AS s FROM documents)""")
def human_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.human_size(F.col("n_chars") * 512).alias("size"))


_NAME = """regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '\\s+', ' ', 'g'), '^[.\\s]+|[.\\s]+$', '', 'g')"""


@query(f"SELECT page_id, CASE WHEN {_NAME} = '' THEN 'untitled' ELSE regexp_replace({_NAME}, '[. ]+$', '') END AS name FROM pages")
def sanitize_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_filename("url").alias("name"))


@query(f"WITH {MESSAGES} SELECT message_pk, strftime(date_utc, '%Y%m%d_%H%M%S') AS stamp, 'blobs/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h AS blob FROM (SELECT *, sha256(body_text) AS h FROM messages)")
def archive_paths(spark, sf_dir):
    return messages(spark, sf_dir).select("message_pk", text.file_stamp("date_utc").alias("stamp"), text.blob_path(F.sha2("body_text", 256)).alias("blob"))


@query("""SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE substr(t, 1, 119) || '…' END AS clipped FROM (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS t FROM documents)""")
def clip_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clip("text").alias("clipped"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, list_transform(list_filter(lines, lambda x: NOT regexp_matches(x, '^\\s*[-=_*]{{3,}}\\s*$')), lambda x: regexp_replace(x, '\\s+$', '')) AS lines,
  list_min(list_filter(list_transform(range(len(lines)), lambda i: CASE WHEN i >= greatest(0, least(CAST(floor(len(lines) * CAST(0.7 AS DOUBLE)) AS BIGINT), len(lines) - 8)) AND regexp_matches(lines[CAST(i + 1 AS BIGINT)], '^\\s*--\\s*$|(?i)^\\s*Sent from my\\s+\\w+\\s*$') THEN i END), lambda i: i IS NOT NULL)) AS cut FROM l)
SELECT doc_id, {_STRIP.format("regexp_replace(array_to_string(CASE WHEN cut > 0 THEN lines[1:cut] ELSE lines END, chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS clean FROM k""")
def strip_noise_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.strip_noise("text").alias("clean"))


@query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, coalesce(array_to_string(list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: regexp_replace(y, '\\s+', '', 'g')), regexp_replace(x, '\\s+', '', 'g')) = i), chr(10) || chr(10)), '') AS text FROM p""")
def dedupe_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.dedupe_paragraphs("text").alias("text"))


@query()
def normalize_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.normalize_markdown("text").alias("markdown"))


_TEXT = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query(f"""SELECT page_id, {_STRIP.format(f"regexp_replace(regexp_replace(replace(replace({_TEXT}, chr(160), ' '), chr(8203), ''), '[ \\t]+', ' ', 'g'), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM pages""")
def html_to_text_regex(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cleaning.html_to_text_regex("html").alias("text"))


_BLOCKS = "|".join(f"<{t}\\b.*?</{t}>" for t in cleaning.DROPPED.split("|"))


@query(f"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is){_BLOCKS}', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<img\\b[^>]*?(?:width\\s*=\\s*["'']?[01]["'']?)[^>]*?>', ' ', 'g'), '(?i)\\son\\w+\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s>]+)', '', 'g') AS html FROM pages""")
def html_regex_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cleaning.clean_html_regex("html").alias("html"))


@query()
def html_dom_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.clean_html("html").alias("html"))


@query()
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.html_to_markdown("html").alias("markdown"))


@query()
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.html_to_text("html").alias("text"))


@query()
def compose_body(spark, sf_dir):
    """Markdown and plain bodies of pages, as of HTML mail."""
    own = table(spark, sf_dir, "pages").withColumn("markdown", html.html_to_markdown("html"))
    return own.select("page_id", cleaning.compose_body(cleaning.html_to_text_regex("html"), "markdown", "url").alias("b")).select("page_id", "b.markdown", "b.plain")


@query()
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.sentences("text").alias("sentences"))


@query("""SELECT doc_id, list_filter(list_transform(range(0, greatest(CAST(1 AS BIGINT), CAST(ceil(length(text) / 200.0) AS BIGINT))), lambda i: regexp_replace(substr(text, CAST(i * 200 + 1 AS BIGINT), 200), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS windows FROM documents""")
def chunk_windows_hard(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.hard_windows("text").alias("windows"))


@query()
def chunk_pack(spark, sf_dir):
    return chunking.chunks(messages(spark, sf_dir).select("message_pk", "message_id", "subject", "body_text")).select("message_pk", "chunk_index", "text", "token_count", "content_hash")


@query()
def hash_embed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", embedding.embed("text", embedding.hashing(128)).alias("embedding"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS length FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", embedding.rounded(embedding.norm("embedding"), 6).alias("length"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text)) AS chars FROM conversations GROUP BY conv_id")
def thread_rollup(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"), F.sum(F.length("text")).alias("chars"))
    return own.select("conv_id", "turns", F.array_join(F.transform("r", lambda x: x["role"]), ">").alias("roles"), "chars")
