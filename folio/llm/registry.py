"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.llm import pieces, pii, pivots, sharding, simhash, substrings, templates, tiered, toxicity, urls, variants, warc, wrappers


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op10_pii(spark, sf_dir):
    return pii.digest(pii.detect(_table(spark, sf_dir, "documents")))


def op2_pivots(spark, sf_dir):
    return pivots.cluster(_table(spark, sf_dir, "embeddings"))


def op3_templates(spark, sf_dir):
    return templates.report(templates.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_sentencepiece(spark, sf_dir):
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    return warc.derive(warc.responses(_table(spark, sf_dir, "pages")))


def op6_substrings(spark, sf_dir):
    out = substrings.dedupe(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.cluster(_table(spark, sf_dir, "documents"))


def op9_url_filters(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages"))


def op11_tiered(spark, sf_dir):
    return tiered.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("tier")


def op12_variants(spark, sf_dir):
    return variants.group(_table(spark, sf_dir, "documents"), variants.EVERY)


def op13_wrappers(spark, sf_dir):
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def queries():
    return {
        "op1_toxicity": op1_toxicity,
        "op2_pivots": op2_pivots,
        "op3_templates": op3_templates,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_warc": op5_warc,
        "op6_substrings": op6_substrings,
        "op7_sharding": op7_sharding,
        "op8_simhash": op8_simhash,
        "op9_url_filters": op9_url_filters,
        "op10_pii": op10_pii,
        "op11_tiered": op11_tiered,
        "op12_variants": op12_variants,
        "op13_wrappers": op13_wrappers,
    }


def oracle_sql():
    return {"op3_templates": templates.SQL, "op11_tiered": tiered.SQL, "op12_variants": variants.SQL, "op13_wrappers": wrappers.SQL}
