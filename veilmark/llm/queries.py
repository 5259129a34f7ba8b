"""Queries opN_<name> of this subpackage, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, clusters, decontaminate, language, minhash, neighbours, phrases, pieces, private, quality, sharding, training_order
from .common import crc_mod, documents, session_defaults
from .secrets import digest as secret_digest
from .secrets import find_secrets


def op3_secret_scan(spark, sf_dir):
    session_defaults(spark)
    return secret_digest(find_secrets(documents(spark, sf_dir), ["doc_id"]))


def op8_quality(spark, sf_dir):
    session_defaults(spark)
    docs = documents(spark, sf_dir)
    scored = quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_language(spark, sf_dir):
    session_defaults(spark)
    docs = documents(spark, sf_dir)
    found = language.identify(docs, language.train(docs), ["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


def tokenizer_source() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op2_bpe(spark, sf_dir):
    session_defaults(spark)
    source = tokenizer_source()
    return bpe.digest(bpe.decode(bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), source, drop_text=True), source))


def op7_near_duplicates(spark, sf_dir):
    session_defaults(spark)
    return minhash.near_duplicates(documents(spark, sf_dir), k=3, percent=85)


def op4_decontaminate(spark, sf_dir):
    session_defaults(spark)
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])


def op6_hilbert_shards(spark, sf_dir):
    return sharding.assign(documents(spark, sf_dir))


def op10_neighbours(spark, sf_dir):
    session_defaults(spark)
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op1_training_order(spark, sf_dir):
    session_defaults(spark)
    return training_order.written(documents(spark, sf_dir))


def op5_private(spark, sf_dir):
    session_defaults(spark)
    return private.digest(private.find_private(documents(spark, sf_dir), ["doc_id"]))


def op11_centroids(spark, sf_dir):
    session_defaults(spark)
    return clusters.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_sentencepiece(spark, sf_dir):
    import public_tokenizers

    session_defaults(spark)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        source = f.read()
    return pieces.digest(pieces.decode(pieces.encode(documents(spark, sf_dir).select("doc_id", "text"), source, drop_text=True), source))


def op13_phrases(spark, sf_dir):
    session_defaults(spark)
    return phrases.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_training_order, op2_bpe, op3_secret_scan, op4_decontaminate, op5_private, op6_hilbert_shards, op7_near_duplicates, op8_quality, op9_language, op10_neighbours, op11_centroids, op12_sentencepiece, op13_phrases)}
#: Shingle sets joined with themselves, and links followed to their ends.
ORACLE_SQL: dict[str, str] = {
    "op11_centroids": clusters.lloyd_sql(),
    "op13_phrases": phrases.collocations_sql(),
    "op7_near_duplicates": """
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[i:i + 2], ' ') end as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y using (s) where x.doc_id <> y.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept from (select a as doc_id, min(b) as component_id from r group by 1) left join n using (doc_id)
"""
}
