"""Corpus statistics of the classifier come from all rows, not from the regression's sample."""

from tidemark.operators import classifier


def test_vocabulary_is_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(classifier, "FIT_ROWS", 2)
    rows = spark.createDataFrame([(str(i), f"common {'left' if i % 2 else 'right'}word", ["t"] if i % 2 else []) for i in range(12)], "id string, text string, themes array<string>")
    encoder, _ = classifier.train(rows, ["t"])
    assert set(encoder.stages[2].vocabulary) == {"common", "leftword", "rightword"}
