"""Quantiles against exact ones, within the accuracy of one rank in 10,000."""

from compare import DATA, connect

from tidemark.plans import measures


def test_percentiles_of_a_whole_table(spark):
    got = measures.QUERIES["profile_percentiles"](spark, f"{DATA}/sf0.01").first()
    want = connect("sf0.01").execute("select " + ", ".join(f"quantile_disc(text_word_count, {q - 0.0005}), quantile_disc(text_word_count, {q + 0.0005})" for q in (0.5, 0.9, 0.99)) + " from silver_reviews").fetchone()
    for i, p in enumerate(("p50", "p90", "p99")):
        assert want[2 * i] <= got[p] <= want[2 * i + 1]
