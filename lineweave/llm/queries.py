"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import covertree, htmltext, imatch, langid, mixing, orderminhash, pii, ppm, secrets, sentencepieces


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_minhash": orderminhash.query,
        "op2_html": htmltext.query,
        "op3_ppm": ppm.query,
        "op4_sentencepiece": sentencepieces.query,
        "op5_pii": pii.query,
        "op6_langid": langid.query,
        "op7_mixing": mixing.query,
        "op8_secrets": secrets.query,
        "op9_imatch": imatch.query,
        "op10_embeddings": covertree.query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.oracle()}
