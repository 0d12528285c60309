"""The registered queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontaminate, exact_dedup, fill_in_middle, language, line_dedup, main_text, mixing, near_dedup, quality, repair, substring_dedup, token_files, toxicity
from parlance.llm.registry import query


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_token_files")
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files and their index: per document, what is read back."""
    import public_tokenizers

    out = token_files.stored_tokens(spark, table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


@query(
    "op8_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


MIX_SEED, MIX_EXPONENT, MIX_EPOCHS = 17, 0.5, 1.0


@query(
    "op9_source_mix",
    f"""
    WITH sizes AS (
      SELECT source, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source
    ), rates AS (
      SELECT source, pow(size, {MIX_EXPONENT}) / sum(pow(size, {MIX_EXPONENT})) OVER () * {MIX_EPOCHS} * sum(size) OVER () / size AS rate
      FROM sizes
    ), parts AS (
      SELECT source, rate, greatest(1, ceil(rate / {mixing.PART_MEAN}))::INT AS parts FROM rates
    ), terms AS (
      SELECT source, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1.0)) AS term
      FROM parts, generate_series(0, {mixing.TERMS}) AS g(k)
    ), below AS (
      SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS upto FROM terms
    ), points AS (
      SELECT doc_id, d.source, part, ('0x' || substr(md5('{MIX_SEED}:' || part || ':' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT / {float(1 << 52)} AS u
      FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, generate_series(1, p.parts) AS g(part)
    ), drawn AS (
      SELECT doc_id, source, sum((SELECT count(*) FROM below b WHERE b.source IS NOT DISTINCT FROM points.source AND b.upto <= u))::BIGINT AS n
      FROM points GROUP BY doc_id, source
    )
    SELECT doc_id, source, copy::INT AS copy, n_chars, sha256(coalesce(text, '')) AS text_sha256
    FROM drawn JOIN documents USING (doc_id, source), generate_series(1, n) AS g(copy)
    """,
)
def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix, a row per copy in its shuffled order; the text as its digest."""
    from pyspark.sql import functions as F

    mix = mixing.mixed(table(spark, folder, "documents"), None, MIX_EXPONENT, MIX_EPOCHS, MIX_SEED)
    return mix.select("doc_id", "source", F.col("mix_copy").alias("copy"), "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query(
    "op10_line_dedup",
    """
    WITH lines AS (
      SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
    ), windows AS (
      SELECT doc_id, i AS pos, lines[i + 1] AS a, lines[i + 2] AS b, lines[i + 3] AS c
      FROM lines, generate_series(0, len(lines) - 3) AS g(i)
    ), later AS (
      SELECT doc_id, pos FROM windows
      QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) > 1
    ), covered AS (
      SELECT DISTINCT doc_id, pos + j AS pos FROM later, generate_series(0, 2) AS g(j)
    ), kept AS (
      SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n_kept
      FROM (SELECT doc_id, i AS pos, lines[i + 1] AS line FROM lines, generate_series(0, len(lines) - 1) AS g(i)) l
      ANTI JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos
      GROUP BY l.doc_id
    )
    SELECT d.doc_id, len(d.lines)::BIGINT AS n_lines, (len(d.lines) - coalesce(k.n_kept, 0))::BIGINT AS n_removed, coalesce(k.text, '') AS text
    FROM lines d LEFT JOIN kept k USING (doc_id)
    """,
)
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.without_repeats(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), width=4, percent=80).drop("text_hash")


@query("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """One row per contaminated document and benchmark item."""
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_hash")


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.without_shared_windows(table(spark, folder, "documents"), width=13, with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_main_text")
def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.main_text(table(spark, folder, "pages"))


@query("op2_page_language")
def op2_page_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.page_languages(table(spark, folder, "pages"), table(spark, folder, "documents"))


@query(
    "op11_fill_in_middle",
    """
    WITH cut AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
             sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
    ), drawn AS (
      SELECT *, len(tokens)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM cut
    ), placed AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM drawn
    ), parts AS (
      SELECT doc_id, text, n,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:n], '') AS s
      FROM placed
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts
    """,
)
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in fill-in-middle form and what is rebuilt from it, both as digests."""
    from pyspark.sql import functions as F

    found = fill_in_middle.transformed(table(spark, folder, "documents").select("doc_id", "text"))
    back = fill_in_middle.rebuilt(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


@query("op13_repair")
def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged conversations and their cheapest repair; the repaired lines as a digest."""
    return repair.repair_reports(table(spark, folder, "conversations"))


@query("op12_quality")
def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = quality.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
