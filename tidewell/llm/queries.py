"""The corpus queries and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from tidewell.llm import chat_format, decontaminate, exact_dedup, html_extract, license_scan, minhash_dedup, mixing, pii, quality, secret_scan



def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_html_extraction": html_extract.op5_html_extraction,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_pii": pii.op7_pii,
    "op8_chat_formatting": chat_format.op8_chat_formatting,
    "op9_minhash_near_dedup": minhash_dedup.op9_minhash_near_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "pipeline": pipeline,
}
ORACLES = {
    "op4_benchmark_decontamination": decontaminate.ORACLE,
    "op5_html_extraction": html_extract.ORACLE,
    "op8_chat_formatting": chat_format.ORACLE,
    "op9_minhash_near_dedup": minhash_dedup.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
