"""The ten queries over `documents`, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm import _docs, language, licenses, media, near_duplicates, packing, quality_model, quality_rules, sentencepieces, substrings, token_counts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_docs.read(spark, sf_dir), WORD_BPE)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_docs.read(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(_docs.read(spark, sf_dir), WORD_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs.read(spark, sf_dir)
    profiles = language.fit(docs.where(~language.held_out()))
    found = language.predict(docs, profiles)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_docs.read(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.evaluate(_docs.read(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs.read(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode(_docs.read(spark, sf_dir), PIECE_BPE)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.crc32("span_ends").alias("spans_crc32"),
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates.classify(_docs.read(spark, sf_dir))
    return classes.select("doc_id", "class_id", "n_class", "kept")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.media_columns(_docs.read(spark, sf_dir))
    payload, stored_form = F.col("payload"), F.col("media")
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.length(stored_form).cast("long").alias("media_bytes"),
        F.sha2(stored_form, 256).alias("media_sha256"),
        "feature",
    )


QUERIES = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_counts": op6_token_counts,
    "op7_license_scan": op7_license_scan,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_media_columns": op10_media_columns,
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": r"""
        with docs as (
            select row_number() over () as nr, doc_id, coalesce(text, '') as text,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
            from documents
        ), lines as (
            select nr, unnest(string_split(text, chr(10))) as line from docs
        ), same as (
            select nr, line, count(*) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by all
        ), dup as (
            select nr, sum(n - 1) as n_dup, sum(n) as n_lines from same group by nr
        ), starts as (
            select nr, words, unnest(range(1, len(words) - 6)) as i from docs
        ), windows as (
            select nr, i, count(*) over (partition by nr, array_to_string(words[i : i + 7], ' ')) as n from starts
        ), covered as (
            select nr, unnest(range(i, i + 8)) as place from windows where n > 1
        ), repeats as (
            select nr, count(distinct place) as n from covered group by nr
        ), measured as (
            select doc_id, cast(len(words) as bigint) as n_words,
                   cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
                   cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
                   cast(coalesce(n_dup, 0) as bigint) as n_dup_lines, coalesce(n_lines, 0) as n_lines,
                   cast(coalesce(repeats.n, 0) as bigint) as n_repeat_words,
                   len(list_filter(words, lambda x: ends_with(x, '!'))) as shouts,
                   len(list_filter(range(1, len(words)), lambda k: words[k] = words[k + 1])) as stutters
            from docs left join dup using (nr) left join repeats using (nr)
        ), judged as (
            select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from measured
        )
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               not (base_failed or 5 * n_symbols > n_words or not (2 * n_words <= word_chars and word_chars <= 20 * n_words)
                    or (n_dup_lines > 0 and 2 * n_dup_lines > n_lines) or 4 * shouts > n_words or 4 * stutters > n_words) as kept
        from judged
    """,
    "op3_substring_dedup": r"""
        with docs as (
            select row_number() over () as nr, doc_id,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
            from documents
        ), starts as (
            select nr, doc_id, words, unnest(range(1, len(words) - 18)) as i from docs
        ), windows as (
            select nr, i, row_number() over (
                partition by array_to_string(words[i : i + 19], ' ') order by doc_id, nr, i) as nth
            from starts
        ), gone as (
            select distinct nr, unnest(range(i, i + 20)) as at from windows where nth > 1
        ), each as (
            select nr, unnest(words) as word, unnest(range(1, len(words) + 1)) as at from docs
        ), kept as (
            select each.nr, string_agg(word, ' ' order by each.at) as text, count(*) as n
            from each left join gone on each.nr = gone.nr and each.at = gone.at
            where gone.at is null group by each.nr
        )
        select doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed,
               sha256(coalesce(text, '')) as kept_sha256
        from docs left join kept using (nr)
    """,
}
