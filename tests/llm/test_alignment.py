"""Alignment against both tokenizers on whole texts and all pairs of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
from tests.conftest import SF

from webloom.llm import alignment


def plain(rows):
    """By overlap of byte ranges, pair by pair; rows (doc_id, text)."""
    made = alignment.aligner(*alignment.default_tokenizers())
    out, counts = [], Counter()
    for doc, text in rows:
        raw = f" {text}".encode()
        a, b = made.a.encode(f" {text}", add_special_tokens=False).ids if text else [], made.b.encode(text) if text else []
        sides = [[made.a_bytes[i] for i in a], [made.b_bytes[i] for i in b]]
        if not text or any(b"".join(s) != raw for s in sides):
            out.append((doc, 0, 0, 0, [], ""))
            continue
        spans = []
        for side in sides:
            ends = [0]
            for token in side:
                ends.append(ends[-1] + len(token))
            spans.append(list(zip(ends, ends[1:], strict=False)))
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        groups = []
        for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            first = groups[-1][0] if groups else 0
            groups.append((cut, *[",".join(str(i) for i, (s, e) in zip(ids, span, strict=True) if first <= s and e <= cut) for ids, span in zip((a, b), spans, strict=True)]))
        counts.update(links)
        out.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(f"{x}|{y}" for _, x, y in groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return Counter((d, x, y, g, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), h) for d, x, y, g, ls, h in out)


def rows_of(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if len(r[1]) < 6000]
    assert rows_of(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), *alignment.default_tokenizers())) == plain(rows)


def test_any_text(spark, monkeypatch):
    """Random letters, signs, white space of all kinds and the tokenizers' own signs, in blocks, stripes and slices of a few rows."""
    rng = random.Random(3)
    parts = ["a", "the", "The", "ing", " ", " ", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'", "don't", "12", "3", "é", "ﬁ", "ß", "İ", "क़", "日本", "語", "　", "\xa0", "​", "᠎", " ", "\x1c", "\x85", "\r\n", "😀", "́", "▁", "<s>", "</s>", "<0x41>", "<|endoftext|>", "<unk>", "\x00", "﻿", "{", "}", "==", "://"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))) for k in range(500)]
    rows += [(1, None), (2, ""), (3, " "), (3, " "), (None, "the end"), (None, None), (4, "x" * 3000), (5, " ".join(["word"] * 2000)), (6, "\n"), (7, "\nthe"), (8, " \nthe")]
    for name, value in (("BLOCK_BYTES", 2000), ("CELLS", 40), ("MEMO", 50)):
        monkeypatch.setattr(alignment, name, value)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "'a' AS words", "2 AS stripe", "3 AS n_a")
    assert rows_of(alignment.align(frame.repartition(3), *alignment.default_tokenizers())) == plain(rows)


def test_nothing(spark):
    paths = alignment.default_tokenizers()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, *paths).count() == 0
    assert rows_of(alignment.align(spark.createDataFrame([(1, None), (2, "")], none.schema), *paths)) == Counter([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])


def test_groups_and_links():
    groups, shared, of_a, of_b = alignment.groups_and_links([1, 2, 3], np.array([2, 5, 6]), [7, 8, 9], np.array([2, 3, 6]))
    assert (groups, shared.tolist(), of_a.tolist(), of_b.tolist()) == (["1|7", "2,3|8,9"], [2, 6], [0, 1, 1, 2], [0, 1, 2, 2])


def test_words_are_forgotten_once_encoded():
    """What comes after the encoding finds no tokenizers and no remembered words in its worker."""
    alignment.aligner(*alignment.default_tokenizers())
    alignment.forget()
    assert alignment.aligner.cache_info().currsize == 0


def test_words_are_encoded_in_runs(monkeypatch):
    """Words go to the tokenizers many at a time, with the same tokens as one by one; words whose bytes a tokenizer loses, and line ends, are found among them."""
    made, seen = alignment.Aligner(*alignment.default_tokenizers()), []
    encode = made.encode
    monkeypatch.setattr(made, "encode", lambda runs: seen.append(len(runs)) or encode(runs))
    words = [(" ", "\n")[k % 7 == 0] + w + str(k) for k in range(640) for w in [("aus", "don't", "\u6f22\u5b57", "<s>", "-", "x")[k % 6]]]
    words[71] = " a\u2581b"
    together = made.align(words, alignment.RUN)
    assert seen == [10, alignment.RUN]
    assert together == [made.align([w], 1)[0] for w in words]
    assert [w for w, x in zip(words, together, strict=True) if not x.fits] == [w for w in words if "\u2581" in w] != []
