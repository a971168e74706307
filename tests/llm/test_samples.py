"""Packing's ids on any letters, and training rows of ids that many rows have."""

import random

import numpy as np
from tokenizers import Tokenizer

from webloom.llm import common, packing, quality_model, toxicity


def test_ids_of_any_letters():
    """Letters of all kinds, with marks, before signs: the ids that the tokenizer gives."""
    path = packing.default_tokenizer()
    whole, encode = Tokenizer.from_file(path), packing.WordEncoder(path)
    rng = random.Random(4)
    letters = [*"aZéßİıǅŉ", "i̇", "É", "क़", "ड़", "क", "्", "שׁ", "ﬁ", "ア", "゙", "한", "각", "Ω", "Å", "ſ", "ẞ", "①", "ª", "़", "ـ", "́", "७"]
    signs = [*".,!?;:'\"-()", "…", "“", "।", " ", " ", "\n", "'s"]
    texts = ["".join(rng.choice(letters if rng.random() < 0.6 else signs) for _ in range(rng.randrange(1, 12))) for _ in range(28_000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0xA000, 0xD7FF), rng.randrange(0xF900, 0xFFF0)])) + rng.choice(["", ".", ","]) for _ in range(6)) for _ in range(4000)]
    texts += ["DENİZLİ.", "HABERLERİ, SON", "क़.", "שׁ!"]
    for text, ids in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encode(text), np.uint32).tolist() == ids.ids, repr(text)


def test_one_text_an_id(spark):
    docs = spark.range(3000).selectExpr("IF(id < 2900, 7, id) AS doc_id", "CONCAT('text ', id % 50) AS text").union(spark.createDataFrame([(8, None), (8, "x"), (None, "y")], "doc_id long, text string"))
    wanted = spark.createDataFrame([(7, 1), (8, 0), (2950, 1)], "doc_id long, label int")
    got = {r.doc_id: (r.text, r.label) for r in common.one_text_an_id(docs, wanted).collect()}
    assert common.one_text_an_id(docs, wanted).count() == 3 and set(got) == {7, 8, 2950} and got[2950] == ("text 0", 1)
    again = {r.doc_id: (r.text, r.label) for r in common.one_text_an_id(docs.repartition(7), wanted).collect()}
    assert got == again


def test_training_rows_are_bounded(spark, monkeypatch):
    """One labelled id on many rows is one row to learn from."""
    docs = spark.range(4000).selectExpr("IF(id < 3900, 11, id) AS doc_id", "CONCAT('some words of text ', id % 9) AS text")
    labels = spark.createDataFrame([(11, 1, 1), *[(k, k % 2, k % 2) for k in range(3900, 3960)]], "doc_id long, quality int, toxic int")
    seen = []
    fit = quality_model.Network.fit
    monkeypatch.setattr(quality_model.Network, "fit", lambda self, x, y, *a, **b: seen.append(len(x)) or fit(self, x, y, *a, **b))
    assert quality_model.score_quality(docs, labels).count() == 4000 and seen and seen[0] <= 61
    weights = toxicity.fit_weights
    monkeypatch.setattr(toxicity, "fit_weights", lambda x, y, *a, **b: seen.append(len(x)) or weights(x, y, *a, **b))
    assert toxicity.score_toxicity(docs, labels).where("score BETWEEN 0 AND 1").count() == 4000 and max(seen) <= 61


def test_terms_come_from_the_other_half(spark):
    """A word that only one half has cannot teach that half's weights that learned words are sure."""
    rows = [(f"common {'zork' if k % 2 and k < 200 else 'plain'} text {k % 7}", int(k % 2), int(k >= 200)) for k in range(400)]
    sample = common.materialise(spark.createDataFrame(rows, "text string, label int, half int"))
    learned, (mean, scale, w) = toxicity.teach(sample)
    assert any(t.lstrip("=").startswith("zor") for t in learned)
    # Half the documents with label 1 have no mark, and the marked ones were described without the mark being known.
    assert np.allclose(w[:-1], 0)
