"""The queries of the operators, one per operator, and the SQL of those that SQL can express."""

from pyspark.sql import functions as F

from armlight.llm import (
    conversations, exact_dedup, fingerprints, id_files, jaccard, line_dedup, packing, quality, repeats, secret_scan, spelling, tokens, toxicity,
)
from armlight.llm.plain_sql import CONVERSATIONS, SPELLING
from armlight.llm.training_rows import fold
from armlight.session import fresh_path

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_bpe(spark, sf):
    ids = tokens.encode(documents(spark, sf), vocabulary_path())
    return tokens.decode(ids, vocabulary_path()).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_secret_scan(spark, sf):
    found = secret_scan.scan(documents(spark, sf).select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secret_scan.span_text(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
    )


def op3_exact_dedup(spark, sf):
    return exact_dedup.exact_groups(documents(spark, sf)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op4_packing(spark, sf):
    return packing.pack(documents(spark, sf), vocabulary_path()).drop("ids")


def op5_suffix_dedup(spark, sf):
    return repeats.remove_repeats(documents(spark, sf)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def _scored(classifier, spark, sf):
    docs = documents(spark, sf)
    model = classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    return classifier.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", classifier.FOLDS) == classifier.HELD_OUT).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_quality(spark, sf):
    return _scored(quality, spark, sf)


def op10_toxicity(spark, sf):
    return _scored(toxicity, spark, sf)


def op7_jaccard_join(spark, sf):
    docs = documents(spark, sf)
    found = jaccard.grouped(docs).select(F.col("id").alias("doc_id"), "n_shingles", F.col("label").alias("component_id"))
    unnamed = jaccard.shingle_counts(docs.where("doc_id is null"))
    return found.union(unnamed.withColumn("component_id", F.lit(None).cast("bigint")))


def op8_line_dedup(spark, sf):
    return line_dedup.drop_repeated_lines(documents(spark, sf)).select(
        "doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256")
    )


def op9_order_minhash(spark, sf):
    f = fingerprints
    pairs = f.edited_pairs(documents(spark, sf))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        f.as_text(F.col("own")).alias("fingerprint"), f.as_text(F.col("edited_own")).alias("edited_fingerprint"),
        f.likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        f.likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op11_spelling(spark, sf):
    return spelling.variants(documents(spark, sf))


def op12_id_files(spark, sf):
    path = fresh_path(spark, "id-files")
    id_files.write_ids(documents(spark, sf), vocabulary_path("byte_bpe_50k.json"), path)
    read = id_files.read_documents(spark, path).select("doc_id", "shard", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    found = read.join(id_files.shard_starts(spark, path), "shard")
    return found.select("doc_id", (F.col("shard_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op13_conversation_repair(spark, sf):
    return conversations.with_hashes(*conversations.repair(spark.read.parquet(f"{sf}/conversations.parquet")))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_secret_scan, op3_exact_dedup, op4_packing, op5_suffix_dedup, op6_quality, op7_jaccard_join, op8_line_dedup, op9_order_minhash, op10_toxicity, op11_spelling, op12_id_files, op13_conversation_repair)}

SQL = {
    "op11_spelling": SPELLING,
    "op13_conversation_repair": CONVERSATIONS,
    "op3_exact_dedup": """
with d as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[ \\t-\\r]', '', 'g') as plain
  from documents)
select doc_id, first_value(doc_id) over g as keep_id, count(*) over (partition by plain) as group_size,
       doc_id = first_value(doc_id) over g as kept, sha256(plain) as text_sha256
from d window g as (partition by plain order by n desc, doc_id)
""",
    "op8_line_dedup": """
with l as (
  select doc_id, text, string_split(text, chr(10)) as lines from documents),
w as (
  select doc_id, unnest(range(0, greatest(len(lines) - 2, 0))) as pos, lines from l),
k as (
  select doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] as body from w),
r as (
  select doc_id, pos, row_number() over (partition by body order by doc_id, pos) as nth from k
  where trim(translate(body, chr(10) || chr(9) || chr(13), '   ')) <> ''),
c as (
  select distinct doc_id, pos + t as line from r, (values (0), (1), (2)) as v(t) where nth > 1),
e as (
  select doc_id, unnest(range(0, len(lines))) as line, unnest(lines) as body from l),
m as (
  select e.doc_id, e.line, e.body, c.line is not null as gone,
         lag(c.line is not null, 1, false) over (partition by e.doc_id order by e.line) as gone_before
  from e left join c on e.doc_id = c.doc_id and e.line = c.line)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_removed,
       cast(sum((gone and not gone_before)::int) as bigint) as n_spans,
       sha256(coalesce(string_agg(body, chr(10) order by line) filter (not gone), '')) as kept_sha256
from m group by doc_id
union all
select doc_id, 0, 0, 0, null from documents where text is null
""",
}
