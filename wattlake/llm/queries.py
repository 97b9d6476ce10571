"""The operators' registered queries: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.llm.shared import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, last_word of every test item found in ``documents``."""
    from wattlake.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    from wattlake.llm.language_id import fold_of, identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = fold_of(F.col("doc_id"), 3)
    model = train(docs.where(fold != 1))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated passages, words_removed, spans_removed of every document."""
    from wattlake.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page's record, read back from archives."""
    from wattlake.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    from wattlake.llm.language_id import fold_of
    from wattlake.llm.quality import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = fold_of(F.col("doc_id"), 3)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold != 1)
    scored = score(docs, train(docs.where(fold != 1), labels))
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    from wattlake.llm.language_id import fold_of
    from wattlake.llm.lm_score import score_documents

    return score_documents(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 5) == 1)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five nearest vectors of each query."""
    from wattlake.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    from wattlake.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, copy_id, class_id, n_links of every document."""
    from wattlake.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    from wattlake.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    from wattlake.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op12_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and return rates of each sale's items, vendors and client, of what was sold earlier in other folds."""
    from wattlake.llm.target_encoding import encode_sales

    return encode_sales(*[table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired rows of every damaged conversation."""
    from wattlake.llm.conversations import audit_damaged

    return audit_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_language_id, op3_warc, op4_substring_dedup, op5_quality, op6_lm_score, op7_nearest, op8_packing, op9_jaccard_join, op10_html_text, op11_token_counts, op12_target_encoding, op13_conversation_repair)
}

def _encoding_sql() -> str:
    """Sums over all earlier lines less those over earlier lines of the fold, level by level."""
    keys = ("item_id", "kind", "vendor_id", "nation_id", "client_id", "segment", "everything")
    window = lambda x, by: f"coalesce(sum({x}) OVER (PARTITION BY {by} ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0)::BIGINT"
    sums = ", ".join(f"{window(x, k)} - {window(x, f'{k}, fold')} AS {k}_{x}" for k in keys for x in "ns")
    rate = lambda k, p: f"(CASE WHEN {k}_n < 1 THEN {p} ELSE (1000000 * {k}_s + 50 * {p}) // ({k}_n + 50) END)"
    group = lambda k: rate(k, rate("everything", "500000"))
    least = lambda t, k, v: f"(SELECT {k} AS id, min({v}) AS v FROM {t} GROUP BY 1)"
    return f"""
        WITH own AS (SELECT sale_id, coalesce(item_id, -1) AS item_id, vendor_id, count(*) AS n, count(*) FILTER (flag = 'returned') AS s FROM sale_lines GROUP BY ALL),
        r AS (SELECT own.*, coalesce(sales.client_id, -1) AS client_id, sold_at, crc32_of AS fold, i.v AS kind, v.v AS nation_id, c.v AS segment, 0 AS everything
              FROM own JOIN sales USING (sale_id) JOIN (SELECT sale_id, {{crc}} % 5 AS crc32_of FROM (SELECT DISTINCT sale_id FROM sales)) USING (sale_id)
              LEFT JOIN {least("items", "item_id", "kind")} i ON i.id = own.item_id LEFT JOIN {least("vendors", "vendor_id", "nation_id")} v ON v.id = own.vendor_id
              LEFT JOIN {least("clients", "client_id", "segment")} c ON c.id = coalesce(sales.client_id, -1) WHERE sold_at IS NOT NULL),
        h AS (SELECT *, {sums} FROM r)
        SELECT sale_id, item_id, vendor_id, n::BIGINT AS n_lines, s::BIGINT AS n_returned, item_id_n AS item_n, {rate("item_id", group("kind"))} AS item_rate,
               vendor_id_n AS vendor_n, {rate("vendor_id", group("nation_id"))} AS vendor_rate, client_id_n AS client_n, {rate("client_id", group("segment"))} AS client_rate
        FROM h""".replace("{crc}", _crc32_sql("sale_id::VARCHAR"))  # fmt: skip


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit; DuckDB has no function for it."""
    step = "lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = "xor(c, b)"
    for _ in range(8):
        byte = f"list_transform([{byte}], {step})[1]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {byte}), 4294967295)"


#: The archives' records, the nearest vectors and the encodings, from the tables alone.
ORACLES: dict[str, str] = {
    "op7_nearest": """
        WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        g AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda s, x: s + x)) AS n FROM e
              WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]), lambda s, x: s + x) / (q.n * c.n) AS score
              FROM g q JOIN g c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        k AS (SELECT page_id, html, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND keep > page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND keep > page_id THEN keep END AS refers_to
        FROM k""",
    "op12_target_encoding": _encoding_sql(),
}
