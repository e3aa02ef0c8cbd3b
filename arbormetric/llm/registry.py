"""The queries of this folder and the SQL that checks them."""

import corpus_pipeline
from arbormetric.llm import bytepairs, centroids, fingerprints, language, lines, manifest, near, packing, pieces, pii, topk, urls, warc

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_url_filters": urls.op2_url_filters,
    "op3_pii": pii.op3_pii,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_exact_topk": topk.op6_exact_topk,
    "op7_warc": warc.op7_warc,
    "op8_bag_minhash": near.op8_bag_minhash,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_language_id": language.op10_language_id,
    "op11_centroids": centroids.op11_centroids,
    "op12_byte_bpe": bytepairs.op12_byte_bpe,
    "op13_manifest": manifest.op13_manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op6_exact_topk": topk.OP6_SQL, "op7_warc": warc.OP7_SQL, "op11_centroids": centroids.OP11_SQL, "op13_manifest": manifest.OP13_SQL}
