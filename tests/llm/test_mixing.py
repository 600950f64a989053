import os

import pytest
from pyspark.sql import functions as F

from foliant.llm import mixing
from foliant.llm.tokens import TOKENIZER_DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZER_DIR), reason="no public tokenizers here")


def test_capped_poisson():
    for rate, cap in ((0.3, 1), (0.9, 2), (1.7, 4), (2.9, 3)):
        steps = mixing.capped_poisson_cumulative(rate, cap)
        assert len(steps) == cap and steps == sorted(steps)
        assert abs(sum(1 - c for c in steps) - rate) < 1e-6
    assert mixing.capped_poisson_cumulative(3.0, 3) == [0.0, 0.0, 0.0]
    assert mixing.capped_poisson_cumulative(0.0, 3) is None


def table(spark):
    rows = [(i, ["big", " BIG", "small", "other", None, "unused"][i % 6], "the sample follows " * (i % 7 + 1), "x") for i in range(3000)]
    rows += [(9000, "small", None, "x"), (9001, "small", "", "x"), (9001, "small", "the sample", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target_share string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 3), ("other", 0.1, 1), ("absent", 0.1, 5), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_shares_and_caps(spark):
    docs, targets = table(spark)
    report, repeats = mixing.mix(docs, targets)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big", "small", "other", "absent"}
    assert got["absent"].tokens_out == 0 and got["absent"].n_docs == 0
    for name, share in (("big", 0.5), ("small", 0.3), ("other", 0.1)):
        assert abs(got[name].reached_share - share / 0.9) < 0.02
        assert got[name].most_repeats <= got[name].max_repeats
    assert repeats.where("source IN ('unused')").count() == 0
    copies = mixing.shuffled_copies(repeats)
    assert copies.count() == repeats.agg(F.sum("copies")).first()[0]
    assert [r.doc_id for r in copies.limit(50).collect()] != sorted(r.doc_id for r in copies.limit(50).collect())


def test_same_seed_same_mix_at_any_partitioning(spark):
    docs, targets = table(spark)
    a = {(r.doc_id, r.copies) for r in mixing.mix(docs, targets)[1].collect()}
    b = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(7), targets)[1].collect()}
    assert a == b
    assert a != {(r.doc_id, r.copies) for r in mixing.mix(docs, targets, seed=9)[1].collect()}


def test_a_larger_total_leaves_capped_sources_below(spark):
    docs, targets = table(spark)
    got = {r.source: r for r in mixing.mix(docs, targets, total_tokens=1e9)[0].collect()}
    assert got["big"].most_repeats == 2 and got["small"].most_repeats == 3
    assert got["big"].tokens_out == 2 * got["big"].n_tokens


def test_empty_tables(spark):
    docs, targets = table(spark)
    report, repeats = mixing.mix(docs.where(F.lit(False)), targets)
    assert repeats.count() == 0 and report.count() == 4
    report, repeats = mixing.mix(docs, targets.where(F.lit(False)))
    assert repeats.count() == 0 and report.count() == 0


def test_draws_do_not_depend_on_other_documents(spark):
    docs, targets = table(spark)
    only = targets.where("source IN ('big', 'other')")
    both = docs.where("lower(trim(source)) IN ('big', 'other') AND text IS NOT NULL")
    few, all_ = both.where("doc_id % 5 = 0"), both
    # the same rate by a total in proportion to the documents
    sizes = lambda df: {r.source: r.n_tokens for r in mixing.mix(df, only)[0].collect()}
    assert set(sizes(few)) == {"big", "other"}
    a = {r.doc_id: r.copies for r in mixing.mix(few, only, total_tokens=1e9)[1].collect()}
    b = {r.doc_id: r.copies for r in mixing.mix(all_, only, total_tokens=1e9)[1].collect()}
    assert all(b[k] == n for k, n in a.items())
    u = lambda df: {r[0]: r[1] for r in df.select("doc_id", mixing._draw(F.col("doc_id"), F.col("text"), 0)).collect()}
    assert all(u(all_)[k] == v for k, v in u(few).items()) and all(0 <= v < 1 for v in u(all_).values())


def test_draws_are_even(spark):
    draws = spark.range(20000).select(mixing._draw(F.col("id"), F.lit("same"), 3).alias("u"))
    counts = draws.groupBy(F.floor(F.col("u") * 10)).count().collect()
    assert len(counts) == 10 and all(abs(r["count"] - 2000) < 250 for r in counts)


def test_large_caps_reach_their_rate():
    steps = mixing.capped_poisson_cumulative(900.0, 1000)
    assert abs(sum(1 - c for c in steps) - 900.0) < 1e-3
