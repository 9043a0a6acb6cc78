"""Reading levels: held-out accuracy, splitting, features, and odd tables."""

import random

import numpy as np
import pytest
from compare import DATA, connect

from tidemark.llm import reading as R

EASY = ["we like it", "it is red", "the cap fell", "my dad has one", "you can use it"]
HARD = ["the residual variance conceals systematic misapprehensions", "longitudinal observations corroborate heterogeneous degradation", "such viscosity undermines replicability across populations"]
FOREIGN = ["la tapa es muy frágil", "me gusta el tamaño", "el precio parece bonito", "no lo recomiendo para viajes"]


def made(n, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        kind = i % 3
        bank = (EASY, HARD, FOREIGN)[kind]
        docs.append((i, ". ".join(rng.choice(bank).capitalize() for _ in range(6)) + ".", "es" if kind == 2 and i % 11 else "en"))
        if kind < 2:
            labels.append((i, (1, 4)[kind] if i % 13 else (2, 3)[kind], "r1"))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id bigint, text string, lang string, level string, rater int")
    return d, spark.createDataFrame([(*x, "t") for x in labels], "doc_id bigint, level int, rater string, text string")


def test_levels_and_language(spark):
    docs, labels = made(150)
    docs += [(900, None, "en"), (901, "", None), (902, " \n ", "en"), (903, "x" * 400_000, None), (904, ". ".join(HARD * 3000), "es"), (904, ". ".join(HARD * 3000), "es"), (905, "?!", None)]
    labels += [(1, None, "r2"), (None, 3, "r1"), (3, 1, "r1"), (3, 1, "r1"), (5555, 2, "r9"), (6, 9, "r1")]
    d, l = frames(spark, docs, labels)
    got = {r.doc_id: r for r in R.levels(d, l).collect()}
    assert all(got[i].level is None and got[i].english is None for i in (900, 901, 902)) and got[904].level == 4
    good = [got[i].level == (1, 4)[i % 3] for i in range(150) if i % 3 < 2]
    assert np.mean(good) > 0.95
    assert all((got[i].english < 0.5) == (i % 3 == 2) for i in range(150))
    assert {r.doc_id for r in R.demanding(d, l).collect()} >= {i for i in range(150) if i % 3 == 1 and got[i].level == 4} | {904}


def test_empty_tables(spark):
    docs, labels = made(30)
    d, l = frames(spark, docs, labels)
    assert R.levels(d.limit(0), l).count() == 0
    assert R.demanding(d, l.limit(0)).count() == 0
    assert all(r.level is None for r in R.levels(d, l.limit(0)).collect())


@pytest.mark.parametrize("text, want", [(None, []), ("", []), ("A b. C d!", ["a b.", "c d!"]), ("x &amp; y.\n> wrapped\n> line", ["x & y.", "wrapped line"]), ("<b>Hi</b> you", ["hi you"]), ("終わり。次", ["終わり。", "次"])])
def test_sentences(text, want):
    assert R.sentences(text) == want


def test_features_stay_within_their_sentence():
    one = [R.features([s]) for s in ("ab cd", "e", "fgh i")]
    fc, fw = R.features(["ab cd", "e", "fgh i"])
    for k in (0, 1):
        whole = (fc, fw)[k]
        parts = [f[k] for f in one]
        assert [sorted(whole.bucket[a:b]) for a, b in zip(whole.start, [*whole.start[1:], len(whole.bucket)])] == [sorted(p.bucket) for p in parts]
    assert R.features(["..."])[1].count.tolist() == [0]


def test_held_out_accuracy_on_rated_documents():
    con = connect("sf0.1")
    rows = con.execute("select d.doc_id, any_value(text), list(distinct level) from documents d join reading_labels l using (doc_id) where level is not null and length(text) between 1 and 20000 group by 1 having count(distinct level) = 1 order by hash(doc_id)").fetchall()
    fit, held = rows[: len(rows) * 2 // 3], rows[len(rows) * 2 // 3 :]
    target = np.eye(4)[[r[2][0] - 1 for r in fit]]
    model = R.Model(*R.fit_levels([r[1] for r in fit], target), None, 0)
    level, _, _ = model.classify([r[1] for r in held])
    assert np.mean([a == r[2][0] for a, r in zip(level, held)]) > 0.9


@pytest.mark.parametrize("langs", [(None, None), ("en", "en"), (None, "de")])
def test_rated_documents_are_english_whatever_lang_says(spark, langs):
    say = ["The cat sat on the mat and it was happy.", "We walked to the shop and bought some bread.", "Results were largely consistent with the theory.", "The epistemological framework presupposes rigorous inference."]
    other = ["Der Hund lief schnell durch den dunklen Wald.", "Wir kauften gestern Brot und frische Milch im Laden."] if langs[1] == "de" else []
    docs = [(i, say[i % 4], langs[0]) for i in range(40)] + [(100 + i, other[i % 2], "de") for i in range(20) if other]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    ratings = spark.createDataFrame([(i, "r1", i % 4 + 1) for i in range(40)], "doc_id bigint, rater string, level int")
    found = {r.doc_id for r in R.demanding(d, ratings).collect()}
    assert found and found <= set(range(3, 40, 4))


def test_every_language_has_a_class(spark):
    rng = random.Random(2)
    # fifteen languages of words of their own, two of them rare, and rated English
    words = {f"{c}{d}": [f"{c}{d}{x}{y}" for x in "aeiou" for y in "lmnrst"] for c, d in zip("bcdfghjklmnpqrs", "aeiouaeiouaeiou")}
    docs, i = [], 1000
    for k, (lang, bank) in enumerate(words.items()):
        for _ in range(3 if k < 2 else 40):
            docs.append((i, ". ".join(" ".join(rng.choices(bank, k=6)) for _ in range(4)) + ".", lang))
            i += 1
    easy, labels = made(90)
    docs += [x for x in easy if x[2] == "en" and x[0] % 3 < 2]
    d, l = frames(spark, docs, labels)
    got = {r.doc_id: r.english for r in R.levels(d, l).collect()}
    assert all(got[x] < 0.5 for x in got if x >= 1000) and all(got[x] >= 0.5 for x in got if x < 1000)


def test_fit_of_parts_is_as_good_as_of_all(monkeypatch):
    docs, labels = made(240)
    rows = [t for i, t, _ in docs if i % 3 < 2]
    target = np.eye(4)[[(0, 3)[i % 3] for i, _, _ in docs if i % 3 < 2]]
    monkeypatch.setattr(R, "TURN", 3)
    model = R.Model(*R.fit_levels(rows, target), None, 0)
    assert np.mean([a == 1 + int(t.argmax()) for a, t in zip(model.classify(rows)[0], target)]) > 0.97
