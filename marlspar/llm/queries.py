"""The queries of this package and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from functools import wraps

from . import html, jaccard, language, mixing, packing, quality, substring, vectors, warc
from .scratch import bound_batches


def _bounded(query):
    @wraps(query)
    def run(spark, sf_dir):
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_html_extraction": html.op1_html_extraction,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_embedding_near_dedup": vectors.op5_embedding_near_dedup,
    "op6_warc": warc.op6_warc,
    "op7_language_id": language.op7_language_id,
    "op8_ann_search": vectors.op8_ann_search,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_packing": packing.op10_packing,
}
QUERIES = {name: _bounded(query) for name, query in QUERIES.items()}
SQL = {
    "op2_substring_dedup": substring.SQL,
    "op4_source_mixing": mixing.SQL,
    "op5_embedding_near_dedup": vectors.SQL5,
    "op9_ngram_jaccard": jaccard.SQL,
}
