"""Every operator and pipeline stage on odd rows, on an empty table, and on columns with clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from wayfold.llm import best_fit_packing, chat_format, edit_fingerprint, language_id, quality_rules, secret_scan
from wayfold.llm import simhash_dedup, source_mix, substring_dedup, url_filter

ROW_OPERATORS = {
    "edit": edit_fingerprint.fingerprints,
    "substring": substring_dedup.dedup,
    "mixed": source_mix.mixed,
    "language": language_id.identify,
    "simhash": simhash_dedup.classes,
    "quality": quality_rules.judge,
}


@pytest.mark.parametrize("name", ROW_OPERATORS)
def test_one_row_for_each_odd_row(odd_docs, no_docs, name):
    out = ROW_OPERATORS[name](odd_docs)
    assert out.count() == odd_docs.count()
    assert sorted(r[0] for r in out.select("doc_id").collect() if r[0] is not None) == [1, 1, 1, 2, 3, 4, 5, 6, 7]
    assert ROW_OPERATORS[name](no_docs).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_return_the_columns_of_documents(spark, odd_docs, no_docs, name, stage):
    out = stage(spark, odd_docs, None)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    out.collect()
    assert stage(spark, no_docs, None).count() == 0


def test_secret_scan_and_packing_on_odd_rows(odd_docs, no_docs):
    assert secret_scan.scan(odd_docs).count() == 0
    assert secret_scan.scan(no_docs).count() == 0
    packed = best_fit_packing.pack(odd_docs)
    assert packed.agg(F.sum("size")).first()[0] == 7 + 7 + 6 + 3 + 30_000 + 3 + 7
    assert best_fit_packing.pack(no_docs).count() == 0


def test_redact_keeps_other_rows_as_they_are(odd_docs):
    out = secret_scan.redact(odd_docs)
    assert out.exceptAll(odd_docs).count() == 0 and out.count() == odd_docs.count()


def test_near_dedup_keeps_one_of_each_class(odd_docs):
    kept = simhash_dedup.keep_one(odd_docs)
    # the repeated row goes; the texts without words are one class with fingerprint 0, kept by its least id
    texts = sorted(str(r.text) for r in kept.select("text").collect())
    assert len(texts) == odd_docs.count() - 1 - 3


def test_urls_and_chats_on_odd_rows(spark):
    pages = spark.createDataFrame(
        [(None, None, None), (1, "", ""), (1, "no scheme", None), (2, "http://", "x"), (2, "http://", "x"), (3, "HTTP://A.NET", "<link rel=canonical>")],
        "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "node", "component")})
    out = url_filter.judge(pages)
    assert out.count() == 6 and {r.verdict for r in out.collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0)).count() == 0
    chats = spark.createDataFrame(
        [(None, None, None, None), (1, None, "user", "> a"), (1, 0, "user", ""), (1, 0, "user", ""), (1, 1, None, ">"), (None, 1, "user", "> a")],
        "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "lines", "thread", "depth", "reply_to")})
    out = chat_format.linked(chats)
    assert out.count() == 6 and all(r.reply_to is None for r in out.collect())
    assert chat_format.linked(chats.limit(0)).count() == 0


@pytest.mark.parametrize("names", ["_text _words words grams _row _m body h h2 _h _copies _copy place _row_key row n", "N_Words KEPT H2 PLACE"])
def test_clashing_names_stay_as_they_are(spark, names):
    """A measure replaces a column of its own name; every other column comes through as it was."""
    names = names.split()
    docs = spark.createDataFrame([(1, "a b c " * 30, "s"), (2, "x", None)], "doc_id long, text string, source string").withColumns({c: F.lit(41) for c in names})
    out = quality_rules.judge(docs)
    assert out.count() == 2 and len({c.lower() for c in out.columns}) == len(out.columns)
    assert {r[c] for r in out.collect() for c in names if c.lower() not in ("n_words", "kept")} == {41}
    for stage in (quality_rules.keep_good, source_mix.mix, secret_scan.redact):
        got = stage(docs)
        assert got.columns == docs.columns and {r[c] for r in got.collect() for c in names} <= {41}


def test_quality_rules_on_very_long_words_lines_and_runs(spark):
    texts = ["w" * 2_000_000, "#" * 2_000_000, "# " * 300_000, "\n" * 500_000, "word and the " * 200_000, "a b\n" * 100_000]
    out = quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out}
    assert got == {0: (1, 2_000_000, 0, 0, 0), 1: (1, 2_000_000, 2_000_000, 0, 0), 2: (300_000, 300_000, 300_000, 0, 300_000), 3: (0, 0, 0, 0, 0),
                   4: (600_000, 2_000_000, 0, 0, 600_000), 5: (200_000, 200_000, 0, 99_999, 200_000)}
