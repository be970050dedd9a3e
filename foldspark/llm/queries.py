"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspark.llm import (
    bagminhash,
    bytebpe,
    langid,
    lexical,
    lines,
    mixing,
    multiindex,
    pieces,
    pii,
    quality,
    shards,
    spelling,
    sql,
    suffixes,
)
from foldspark.plans.registry import query


@query("op1_sharding")
def op1(t):
    return shards.shard_records(t.documents, n_shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op2_quality_rules", sql.QUALITY)
def op2(t):
    out, names = quality.judged(t.documents.select("doc_id", "text"))
    return out.select("doc_id", *(F.col(v).alias(k) for k, v in names.items()))


@query("op3_source_mixing")
def op3(t):
    return mixing.draws(mixing.token_rows(t.documents)).drop("row")


@query("op4_inverted_multi_index", sql.VECTORS)
def op4(t):
    return multiindex.vector_classes(t.embeddings)


@query("op5_line_dedup", sql.LINES)
def op5(t):
    return lines.line_digests(t.documents)


@query("op6_sentencepiece")
def op6(t):
    out, names = pieces.encoded(t.documents.select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", *(F.col(v).alias(k) for k, v in names.items()))


@query("op7_language_id")
def op7(t):
    learn = t.documents.where(langid.fold(F.col("doc_id")) != 1).select("doc_id", "text", "lang")
    out = langid.predicted(t.documents, langid.fit(learn))
    return out.withColumn("held_out", F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(True)))


@query("op8_pii")
def op8(t):
    return pii.personal_data(t.documents, pii.fit(t.documents))


@query("op9_suffix_dedup")
def op9(t):
    return suffixes.without_repeats(t.documents).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_bagminhash")
def op10(t):
    return bagminhash.duplicate_classes(t.documents)


@query("op11_permuterm_spelling", sql.SPELLING)
def op11(t):
    return spelling.spelling_variants(t.documents)


@query("op12_lexical_search", sql.SEARCH)
def op12(t):
    return lexical.ranked(t.documents, t.benchmark)


@query("op13_byte_bpe")
def op13(t):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out, names = bytebpe.encoded(t.documents.select("doc_id", "text"), path, public_tokenizers.PATTERN, keep_text=False)
    back, name = bytebpe.decoded(out, names["ids"], path)
    return back.select("doc_id", F.col(names["n_tokens"]).alias("n_tokens"), F.sha2(names["ids"], 256).alias("ids_sha256"),
                       F.sha2(name, 256).alias("decoded_sha256"))
