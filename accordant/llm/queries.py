"""The operators' queries over whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat_format, decontam, exact_dedup, line_dedup, ngram_join, pii, quality, search, sharding, toxicity, url_filter
from .common import table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def _said(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", _said(spans))


def _number(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    by_kind = F.array_sort(F.transform("terms", lambda t: F.struct(t["kind"], t["start"], t["end"])))
    return found.select(
        "doc_id",
        *[_number(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(_said(F.col("base")), _said(by_kind))).alias("spans"),
        _joined(F.col("terms")).alias("term_spans"),
    )


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    items = F.transform(F.coalesce("_items", F.array().cast("array<bigint>")), lambda i: i.cast("string"))
    hit = decontam.hit_words(F.col("_hits"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(items)), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def grade() -> Column:
    """Grades of the labels: 0 low quality, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(*quality.rated_sample(documents, table(spark, sf_dir, "labels"), grade()))
    return quality.grade(documents.select("doc_id", "text"), model).select(
        "doc_id", F.round("_expected_grade", 6).alias("expected_grade"), F.round("_tail", 6).alias("tail_probability"), (F.col("_tail") >= 0.5).alias("kept")
    )


def learnt() -> Column:
    """Whether labels of the id may be learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    read = chat_format.read_formatted(chat_format.format_chats(given.union(more)))
    return read.select(
        "conv_id",
        F.col("turns_read").alias("n_turns"),
        F.sha2("transcript", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("output").cast("long").alias("formatted_chars"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(*toxicity.labelled_sample(documents, table(spark, sf_dir, "labels"), learnt()))
    return toxicity.score(documents, model).select("doc_id", (~learnt()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "most_saved")


def op9_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_file())
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align(table(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n = search.build(table(spark, sf_dir, "documents"))
    found = search.search(index, n, table(spark, sf_dir, "benchmark"), k=50)
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op13_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "_metadata.file_name", "_metadata.row_index")
    placed = sharding.shuffled(documents, 40, row_id=["file_name", "row_index"])
    return placed.select(
        "doc_id",
        sharding.weight().alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_STRIP = r"regexp_replace(regexp_replace({0}, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', '')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op2_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, rowid_ AS r, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (
                SELECT doc_id, row_number() OVER () AS rowid_, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
        keyed AS (SELECT *, {_LOWER.format(_STRIP.format('line'))} AS key FROM lines),
        common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN common c ON keyed.key = c.key GROUP BY r""",
    "op5_benchmark_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
        lengths AS (SELECT DISTINCT n FROM sized),
        spots AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
        found AS (SELECT r, i, spots.n, item_id FROM spots JOIN windows USING (n, s)),
        hits AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS k FROM found) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')) AS text_sha256 FROM documents),
        best AS (SELECT text_sha256, count(*) AS group_size, arg_min(r, (-n, doc_id IS NULL, doc_id, r)) AS keep FROM d GROUP BY 1)
        SELECT d.doc_id, k.doc_id AS keep_id, group_size, d.r = keep AS kept, text_sha256
        FROM d JOIN best USING (text_sha256) JOIN d k ON k.r = keep""".replace("JOIN d k ON k.r = keep", "JOIN (SELECT r, doc_id FROM d) k ON k.r = keep"),
    "op12_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS w FROM documents),
        c AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
        tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), c),
        m AS (SELECT r, doc_id, 100 - 50 + (50 * len(w) * n) // l AS m FROM d, c WHERE len(w) > 0),
        b AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}')) AS w FROM benchmark),
        asked AS (SELECT i, item_id, unnest(w) AS term FROM b),
        scores AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r)::INT AS rank FROM scores WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
}


def queries() -> dict:
    found = [
        op1_url_filter,
        op2_line_dedup,
        op3_pii,
        op4_ngram_jaccard_join,
        op5_benchmark_decontamination,
        op6_quality_classifier,
        op7_chat_formatting,
        op8_toxicity,
        op9_bpe_coding,
        op10_exact_dedup,
        op11_token_alignment,
        op12_lexical_search,
        op13_external_shuffle,
    ]
    return {f.__name__: f for f in found}
