"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, fingerprints, html_text, langid, licenses, ngram_join, oracles, pieces, quality, secrets, urls
from .common import spread, table


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"))


def op1_secret_scans(spark, sf_dir):
    return secrets.digest(documents(spark, sf_dir))


def op2_html_extraction(spark, sf_dir):
    return html_text.extract(pages(spark, sf_dir))


def op3_decontamination(spark, sf_dir):
    return decontaminate.digest(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_license_scans(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op5_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_fingerprints(spark, sf_dir):
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark, sf_dir):
    return ngram_join.classes(documents(spark, sf_dir))


def op8_url_filters(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_language_id(spark, sf_dir):
    return langid.predict(documents(spark, sf_dir))


def op10_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_html_extraction,
        op3_decontamination,
        op4_license_scans,
        op5_quality,
        op6_fingerprints,
        op7_ngram_join,
        op8_url_filters,
        op9_language_id,
        op10_sentencepiece,
    )
}

#: The others learn from the corpus or make sketches; their tests hold them against brute force, definitions or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": oracles.DECONTAMINATION,
    "op7_ngram_join": oracles.NGRAM_JOIN,
    "op8_url_filters": oracles.URL_FILTERS,
}
