"""Operators against brute force, twins, planted cases and held-out labels."""

import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from tests.conftest import SF
from tests.helpers import same_rows

import corpus_pipeline
from webloom.llm import common, decontamination, line_dedup, packing, pii, quality_model, quality_rules, registry, sharding, simhash, toxicity, url_filter


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_salted_join_is_a_join(spark, monkeypatch, how):
    """With so few rows to a key that most keys are hot."""
    many = common.materialise(spark.range(400).selectExpr("IF(id % 3 = 0, 1, id % 11) AS k", "IF(id % 50 = 0, NULL, id % 2) AS g", "id AS v"))
    few = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (2, 0, "d"), (99, 0, "e")], "k long, g long, name string")
    monkeypatch.setattr(common, "HOT", 5)
    if how == "left_anti":
        few = few.drop("name")
    got, plain = common.salted_join(many, few, ["k", "g"], how), many.join(few, ["k", "g"], how)
    assert got.columns == plain.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert common.hot_keys(many.groupBy("k", "g").count(), ["k", "g"], "count").count() > 2


def test_masks_cover():
    rng = random.Random(1)
    for radius in (0, 1, 2, 6):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            flipped = sum({1 << rng.randrange(64) for _ in range(radius)})
            assert any(not flipped & m for m in masks)


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_against_all_pairs(spark, docs):
    def fingerprint(text):
        w = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    ids = sorted(fp)
    component = roots(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, SF).collect()}
    assert got == {i: (f"{fp[i]:016x}", component[i]) for i in ids}


def test_crowded_buckets_connect_exactly(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}) for b in base for _ in range(60)}
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    edges = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert {n: got.get(n, n) for n in signed} == roots(signed, near)


def test_near_duplicates_drop_copies(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, groups = [], {}
    for g in range(30):
        text = words(150)
        for c in range(40 if g == 0 else 3):
            copy = list(text)
            if c:
                copy[rng.randrange(150)] = f"changed{c}"
            rows.append((len(rows), " ".join(copy)))
            groups.setdefault(g, []).append(len(rows) - 1)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame).collect()}
    fp = {r.doc_id: r.fp for r in simhash.text_sets(frame).collect()}
    shingles = {d: {tuple(t.split()[k : k + 5]) for k in range(146)} for d, t in rows}
    near = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) and ((fp[a] ^ fp[b]) & (2**64 - 1)).bit_count() <= 6
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    group = roots(list(fp), [(a, b) for a in fp for b in fp if a < b and near(a, b)])
    assert {group[d] for d in kept} == set(group.values())
    assert all(d in kept or any(near(d, e) for e in fp if group[e] == group[d] and e != d) for d in fp)
    assert 30 <= len(kept) <= 36


def shingle_groups(rows):
    """The groups by brute-force Jaccard similarity of five-word shingles, 0.8 or more, whatever the fingerprints."""
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, w in ((d, t.lower().split()) for d, t in rows)}
    linked = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return roots(sorted(sets), linked)


def exact(group, kept):
    return sorted(group[d] for d in kept) == sorted(set(group.values()))


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    rows, common = [], " ".join(f"c{k}" for k in range(12))
    for g in range(60):
        n = rng.choice([30, 60, 100, 150])
        text = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for c in range(30 if g == 0 else 4):
            copy = list(text)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(n)] = f"changed{c}"
            rows.append((len(rows), " ".join(copy) + (" " + common if g % 2 else "")))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()]
    group = shingle_groups(rows)
    fp = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.text_sets(frame).collect()}
    assert any(all((fp[d] ^ fp[e]).bit_count() > 6 for e in fp if e != d and group[e] == group[d]) for d in fp if list(group.values()).count(group[d]) > 1)
    assert exact(group, kept)


def test_near_duplicates_crowded_chain(spark):
    rng = random.Random(10)
    text = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(40):
        # Each text is like the one before; those a few steps apart are not.
        rows.append((k, " ".join(text)))
        for p in rng.sample(range(200), 3):
            text[p] = f"step{k}x{p}"
    rng.shuffle(rows)
    group = shingle_groups(rows)
    assert len(set(group.values())) == 1
    assert exact(group, [r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()])


def test_line_dedup_one_edit(spark):
    line = "an ordinary sentence that is repeated with one slip"
    variants = [line, line, line[:10] + "X" + line[11:], line[:30] + line[31:], line[:40] + "zz" + line[40:], "Q" + line, "short"]
    frame = spark.createDataFrame([(k, t + "\nshort") for k, t in enumerate(variants)], "doc_id long, text string")
    got = [r.text for r in line_dedup.dedup_lines(frame).orderBy("doc_id").collect()]
    assert got == [line + "\nshort", "", "", "", variants[4], "", ""]


def test_line_dedup_short_lines(spark):
    rows = [(1, "1.\n\nyes\n 1. "), (2, "yes\nno\n2."), (3, "\n\nNo\nno")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("1.\n\nyes", 4, 1), 2: ("no\n2.", 3, 1), 3: ("\n\nNo", 4, 1)}


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(4)
    lines = []
    for _ in range(40):
        base = "".join(rng.choice("abcdé ") for _ in range(30)).strip().ljust(30, "z")
        for _ in range(5):
            t = list(base)
            for _ in range(rng.randrange(3)):
                p = rng.randrange(len(t))
                rng.choice([lambda: t.__setitem__(p, "k"), lambda: t.insert(p, "m"), lambda: t.pop(p)])()
            lines.append("".join(t))

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p + 1 :] == b[p:] if len(a) > len(b) else a[p:] == b[p + 1 :]

    rows = list(enumerate(lines))
    gone = {k for k, t in rows if any(near(t.strip(), u.strip()) for u in lines[:k])}
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_removed} == gone
    assert 0 < len(gone) < len(rows)


def test_leaks_with_substitutions(spark):
    rng = random.Random(5)
    items = [(k, " ".join(f"b{rng.randrange(10**6)}" for _ in range(40))) for k in range(20)]
    docs, truth = [], set()
    for d in range(60):
        words = [f"t{rng.randrange(10**4)}" for _ in range(200)]
        if d % 2:
            passage = items[d % 20][1].split()
            for p in (5, 13, 22, 31):
                passage[p] = "other"
            words[50:50] = [w.upper() + "," for w in passage]
            truth.add((d, d % 20))
        docs.append((d, " ".join(words)))
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == truth
    assert all((r.start, r.length, r.equal_tokens) == (50, 40, 36) for r in rows)


def test_masks_miss_no_window():
    for span in range(decontamination.MIN_ITEM, decontamination.SPAN + 1):
        spare = span - decontamination.needed(span)
        kept = [{k for b in mask for k in decontamination.blocks_of(span)[b]} for mask in decontamination.masks_of(span)]
        assert sorted(k for block in decontamination.blocks_of(span) for k in block) == list(range(span)) and spare == int(span / 4)
        assert all(any(not mask & set(gone) for mask in kept) for gone in itertools.combinations(range(span), spare))


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    items, docs, planted = [], [], {}
    for n in (5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 20, 24, 32, 40, 60, 100):
        for subs in range(n // 4 + 1) if n < 21 else (0, 1, n // 10, n // 8, n // 5, n // 4):
            for run in range(20):
                k = len(items)
                item = [f"b{k}x{i}" for i in range(n)]
                at = rng.randrange(n - subs + 1)
                gone = range(at, at + subs) if run == 0 else rng.sample(range(n), subs)
                text = ["before"] * rng.randrange(9) + ["other" if i in gone else w for i, w in enumerate(item)] + ["after"] * 3
                items.append((k, " ".join(item)))
                docs.append((k, " ".join(text)))
                planted.setdefault((n, subs), []).append(k)

    def overlaps(words, item):
        span = min(12, len(item))
        for shift in range(-len(item), len(words)):
            for i in range(max(0, -shift), min(len(item), len(words) - shift) - span + 1):
                if 4 * sum(words[shift + i + c] == item[i + c] for c in range(span)) >= 3 * span:
                    return True
        return False

    truth = {k for k, t in docs if overlaps(t.split(), items[k][1].split())}
    # Every document beside its own item holds words of no other.
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in truth}
    recall = {cell: sum(k in truth for k in ks) / len(ks) for cell, ks in planted.items()}
    assert min(recall.values()) >= 0.9, sorted(recall.items(), key=lambda x: x[1])[:5]
    words = {k: t.split() for k, t in docs}
    for r in got:
        part, item = words[r.doc_id][r.start : r.start + r.length], items[r.item_id][1].split()
        assert any(sum(a == b for a, b in zip(part, item[i:], strict=False)) >= r.equal_tokens for i in range(len(item)))
        assert r.equal_tokens >= 0.75 * min(12, len(item))


def test_leaks_on_random_words_against_brute_force(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    docs, items = [(k, text(rng.randrange(40))) for k in range(60)], [(k, text(rng.randrange(25))) for k in range(12)]

    def linked(words, item):
        span = min(12, len(item))
        return len(item) >= 5 and any(
            4 * sum(a == b for a, b in zip(words[p : p + span], item[i : i + span], strict=True)) >= 3 * span for p in range(len(words) - span + 1) for i in range(len(item) - span + 1)
        )

    truth = {(d, i) for d, t in docs for i, u in items if linked(t.split(), u.split())}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(*frames).collect()} == truth
    assert {r.doc_id for r in decontamination.drop_leaking(*frames).collect()} == {d for d, _ in docs} - {d for d, _ in truth}
    assert 0 < len({d for d, _ in truth}) < 60


def test_pipeline_leaks_are_dropped(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaking = {r.doc_id for r in decontamination.find_leaks(docs, bench).collect()}
    kept = {r.doc_id for r in decontamination.drop_leaking(docs, bench).collect()}
    assert leaking and kept == {r.doc_id for r in docs.collect()} - leaking


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r.doc_id: np.array([*t.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    rows = packing.op6_packing(spark, SF).collect()
    windows: dict = {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert sorted(windows) == list(range(len(windows)))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(windows) <= -(-sum(map(len, ids.values())) // 4096) + 1


@pytest.mark.parametrize("text", ["It's we'll don't <|endoftext|> a,b.c!! x--y", "a <|endoftext|> b", "A<|startoftext|>B <|ENDOFTEXT|> <|End <|endoftext|>.", "<| endoftext |> <||> É <|endoftext|>", "ÉCOLE Straße, ½²³ İstanbul ΣΑΣ\x1ck", "日本語 テキスト 123 4.0.", "J̌ J̌ é ﬁ", "tab\tnl\nvt\x0bnbsp\xa0end", ""])
def test_encoder_is_the_tokenizer(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    assert np.frombuffer(packing.WordEncoder(packing.default_tokenizer())(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_patterns_fill():
    rng = random.Random(6)
    counts = {rng.randrange(1, 4097): rng.randrange(1, 50) for _ in range(200)}
    left = dict(counts)
    for chosen, times in packing.fill_patterns(counts, 4096):
        assert sum(k * n for k, n in chosen.items()) <= 4096
        for k, n in chosen.items():
            left[k] -= n * times
    assert not any(left.values())


def test_quality_learns(spark):
    sf = "/root/testdata/sf0.1"
    scores = {r.doc_id: r for r in quality_model.op4_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    own = [(scores[d], y) for d, y in labels.items() if scores[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in scores.items())
    assert np.mean([r.predicted == y for r, y in own]) > 0.97
    assert np.mean([r.predicted for r, y in own if y == 1]) > 0.99


def test_toxicity_learns(spark):
    sf = "/root/testdata/sf0.1"
    scores = {r.doc_id: r for r in toxicity.op5_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    own = [(scores[d].predicted, y) for d, y in labels.items() if scores[d].held_out]
    assert np.mean([y for p, y in own if p]) > 0.95
    assert np.mean([p for p, y in own if y]) > 0.8


def test_grammar():
    codes = toxicity.Classes({"=zork": 2.0, "blar": 3.0})
    kinds = lambda t: set(toxicity.matched(codes(t)))
    assert kinds("You are an idiot.") == {"targeted"}
    assert kinds("He said that you are an idiot.") == {"reported"}
    assert kinds("She is not stupid") == {"negated"}
    assert kinds("I will kill you") == {"threat"}
    assert kinds("what trash") == {"slight"}
    assert kinds("The pig ate trash in the garden") == {"slight"}
    assert not kinds("I will destroy them at chess") and not kinds("They murder sheep")
    assert kinds("a Zork and a blarney") == {"insult"}
    assert kinds("You went home. Trash lies there") == {"slight"}
    assert not kinds("a fine day")
    assert kinds("you're an idiot") == kinds("You’re such a moron") == {"targeted"}
    assert kinds("don’t be an idiot") == kinds("don't be an idiot") == kinds("you shouldn't call him an idiot") == {"negated"}
    assert not kinds("she will hang her coat") and not kinds("They burn his letters") and kinds("I will hang her.") == {"threat"}
    assert kinds("your stupid face") == {"targeted"}
    features = lambda t: toxicity._features(codes(t))
    assert not any(features("The pig ate trash in the garden") + features("He said that you are an idiot.") + features("You are not stupid."))


def clause_by_hand(symbols):
    """What a clause does, word by word, without transducers."""
    plain, negated, reported = [], 0, False
    for c in symbols:
        if c in "IAH":
            plain.append("n" if negated else "r" if reported else c)
        else:
            plain.append(c)
            negated = 4 if c == "N" else max(0, negated - 1)
            reported |= c == "R"
    near = lambda k, before, after: bool({"T", "P"} & {*plain[max(0, k - before) : k], *plain[k + 1 : k + 1 + after]})
    places = range(len(plain))
    # A possessive is threatened only as the last word.
    threatened = [c if c != "P" or k == len(plain) - 1 else "." for k, c in enumerate(plain)]
    if "G" not in plain and any(plain[k] == "H" and {"T", "P"} & set(threatened[k + 1 : k + 4]) for k in places):
        return "threat"
    if any(plain[k] in "IA" and near(k, 4, 4) for k in places):
        return "targeted"
    return next((kind for kind, c in (("insult", "I"), ("slight", "A"), ("reported", "r"), ("negated", "n")) if c in plain), None)


def test_grammar_against_clauses_by_hand():
    rng = random.Random(13)
    seen = set()
    for _ in range(20_000):
        symbols = "".join(rng.choice("IAHTPNRG......") for _ in range(rng.randrange(1, 14)))
        assert toxicity.clause_kind(symbols) == clause_by_hand(symbols), symbols
        seen.add(clause_by_hand(symbols))
    assert seen == {None, *toxicity.KINDS}
    for n in range(10):
        assert toxicity.matched(b"T" + b"." * n + b"I") == toxicity.matched(b"T" + b"." * min(n, 7) + b"I")
    assert toxicity.matched(b"I" * 50_000 + b"T|") == {"targeted": 1}


def test_surrogates(spark, docs):
    for n in (1, 2, 3, 10, 100):
        assert sorted(pii.permute(b"k", "t", i, n) for i in range(n)) == list(range(n))
    new = lambda t: pii.replace(b"key", t)[0]
    assert new("+1 (504) 555-2652") != "+1 (504) 555-2652" and new("+1 (504) 555-2652").startswith("+1 (")
    assert pii._luhn(new("4111111111111111")) and not pii._luhn(new("4111111111111112"))
    assert new("Mail a.b@c.org twice: A.B@C.ORG").split()[1].lower() == new("Mail a.b@c.org twice: A.B@C.ORG").split()[3].lower()
    assert new("Frau Anna Schmidt").split()[1] in pii.GIVEN["female latin"].split()
    assert new("Мария Иванова").split()[0] in pii.GIVEN["female cyrillic"].split()
    assert pii._iban_left(new("DE89 3704 0044 0532 0130 00")) == 1
    assert new("version 4.0. of 2024") == "version 4.0. of 2024"
    assert new("IBAN DE89 3704 0044 0532 0130 00, card 4111 1111 1111 1112") .endswith("card 4111 1111 1111 1112")
    out = pii.pseudonymise(docs, b"key")
    assert pii.colliding_surrogates(out).count() == 0
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        assert r.n_entities == len(r.entities) and (r.n_entities or r.text == before[r.doc_id])
        assert all(e.original not in r.text for e in r.entities if e.kind in ("email", "card", "secret"))
        assert all(e.original != e.surrogate for e in r.entities)


def formats(rng):
    """Random entities of every kind, as they stand in texts."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    card = next(c for c in iter(lambda: "4" + digits(15), "") if pii._luhn(c))
    names = [n for names in pii.GIVEN.values() for n in names.split()]
    surname = rng.choice(["Smith", "Quark", "Петрова", "Иванов", "Παπαδόπουλος", "王", "李", "Müller", "García", "שרון"])
    yield "email", f"{rng.choice('abc')}{digits(2)}@{rng.choice(['foo', 'bar', 'mail'])}.{rng.choice(['org', 'com'])}"
    yield "secret", hexes(40)
    yield "card", card
    yield "ip", ".".join(str(rng.randrange(256)) for _ in range(4))
    yield "ipv6", "2001:db8::" + ":".join(hexes(rng.choice([3, 4])) for _ in range(3))
    yield "phone", rng.choice([f"+1 ({digits(3)}) 555-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])
    yield "ssn", f"{digits(3)}-{digits(2)}-{digits(4)}"
    yield "key", "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    yield "name", f"{rng.choice(names)} {surname}"
    yield "name", f"{rng.choice(['Mr', 'Dr', 'Frau', 'Госпожа'])} {rng.choice([*names, 'Zelda', 'Yolanda', '伟'])} {surname}"


def test_surrogates_are_others_and_distinct():
    rng = random.Random(14)
    images: dict = {}
    for _ in range(3000):
        for kind, value in formats(rng):
            out, found = pii.replace(b"key", f"so {value} it is")
            assert [(f[0], f[3]) for f in found] == [(kind, value)], (kind, value, found)
            new = found[0][4]
            assert new != value and out == f"so {new} it is" and len(new.split()) == len(value.split())
            assert images.setdefault((kind, new), value) == value
    for kind in pii.GIVEN:
        names = pii.GIVEN[kind].split()
        assert sorted(pii._given(b"key", n) for n in names) == sorted(names) and all(pii._given(b"key", n) != n for n in names)
    assert all(pii.permute(b"k", "t", i, n) != i for n in (2, 3, 10, 100) for i in range(n))


def test_names_refer_to_one_person():
    new = lambda t: pii.replace(b"key", t)[0].replace(";", "").replace(".", "").split()
    w = new("Dr Zelda Quark and Frau Zelda Quark; Quark left. Zelda stays")
    assert w[1:3] == w[5:7] and w[7] == w[2] and w[9] == w[1] and "Zelda" not in w and "Quark" not in w
    w = new("Elena Petrova came. Petrova went. John Smith and Smith")
    assert w[1] == w[3] and w[1].endswith("a") and w[6] == w[8] and not {"Elena", "Petrova", "John", "Smith"} & set(w)
    out = pii.replace(b"key", "Mr 王伟 spoke, 王伟说")[0]
    assert "王" not in out and "伟" not in out and out[3:5] == out[-3:-1]
    boxes = pii.replace(b"key", "a1@corp.org b2@corp.org")[0].split()
    assert boxes[0].split("@")[1] == boxes[1].split("@")[1] != "corp.org"
    assert pii.replace(b"key", "at 12:30:45 std::string a::b ::1 version 1.2.3")[1] == []


def test_rules_reject_boilerplate(spark):
    shared = "this same banner line is found in a great many of the documents here"
    rows = [(k, f"{shared}\n{shared} too" if k < 40 else f"{shared}\n" + " ".join(f"w{k}x{i}" for i in range(60)), "h") for k in range(80)]
    rows = [(k, t + f" {k}" if k < 40 else t, s) for k, t, s in rows]
    got = {r.doc_id: r for r in quality_rules.line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k].kept for k in range(40, 80))
    copies = [(k, f"{shared} {shared}", "h") for k in range(80)] + [(1000, "a b c d e f g h i j k", None)] * 50 + [(2000 + k, f"{shared} {shared} again", "g") for k in range(20)]
    judged = quality_rules.line_frequency_rules(spark.createDataFrame(copies, "doc_id long, text string, source string"), max_repeated=1.0).collect()
    # Copies are documents; repeated rows are one.
    assert len(judged) == 150 and all(r.kept == (r.doc_id >= 1000) for r in judged)


def test_urls_learned(spark):
    pages = spark.createDataFrame([(1, "https://cheap-pills.example.net/de/1"), (2, "https://casino-win.example.org/en/2"), (3, "https://quiet-garden.example.org/en/3"), (4, "https://poetry.example.net/de/4")], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(pages, url_filter.default_labels(spark), rules=()).orderBy("page_id").collect()] == ["block", "block", "allow", "allow"]


def url_score_by_hand(url, weights):
    """Host, path and score of a url, character by character."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    z = weights[-1]
    for text, mark, share in ((host, "h", url_filter.HOST_SHARE), (path, "p", url_filter.PATH_SHARE)):
        chars = f"^{text}$"
        grams = [mark + chars[i : i + n] for n in (3, 4) for i in range(len(chars) - n + 1)]
        buckets = [(xxhash.xxh64_intdigest(g, 42) ^ 2**63) - 2**63 for g in grams]
        if buckets:
            z += share * sum(weights[b % (len(weights) - 1)] for b in buckets) / len(buckets) ** 0.5
    return host, path, 1 / (1 + np.exp(-z))


def test_urls_against_brute_force(spark):
    labels = url_filter.default_labels(spark)
    weights = url_filter.fit_url_model(labels)
    odd = [None, "", "x", "://", "http://A.B?c/d", "HTTP://É.example/ü?#", "https://h#f?/x", "a://b/c://d/e", "http://" + "x" * 3000]
    urls = odd + [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, labels, rules=()).collect()}
    for k, url in enumerate(urls):
        host, path, score = url_score_by_hand(url, weights)
        assert (got[k].host, got[k].path) == (host, path) and abs(got[k].score - score) < 1e-6 and got[k].verdict == ("block" if got[k].score >= 0.5 else "allow")
    ruled = {r.page_id: r for r in url_filter.filter_urls(pages, labels).collect()}
    for k, url in enumerate(urls):
        host, path, _ = url_score_by_hand(url, weights)
        fits = [(a, r) for a, r in url_filter.RULES if f".{host}".endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
        action, rule = max(fits, key=lambda x: len(x[1]), default=(None, None))
        assert ruled[k].rule == rule and ruled[k].verdict == (action or got[k].verdict)


def test_urls_held_out(spark):
    """By four folds of its small table the cautious prior blocks 2 of 44 ordinary urls and misses 12 of 35 others; it should not get worse."""
    rows = sorted((r.url, r.label) for r in url_filter.default_labels(spark).collect())
    false, missed = 0, 0
    for fold in range(4):
        taught = spark.createDataFrame([r for k, r in enumerate(rows) if k % 4 != fold], "url string, label int")
        weights = url_filter.fit_url_model(taught)
        for u, y in (r for k, r in enumerate(rows) if k % 4 == fold):
            blocked = url_score_by_hand(u, weights)[2] >= 0.5
            false, missed = false + (blocked and not y), missed + (y and not blocked)
    assert false <= 2 and missed <= 12


def test_shards_are_even(docs):
    rows = sharding.shard_by_size(docs).collect()
    total = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    for s in range(16):
        assert abs(sum(r["size"] for r in rows if r.shard == s) - total / 16) <= largest


def test_overfull_ranges_are_subdivided(docs):
    whole = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_by_size(docs).collect()}
    assert whole == {r.doc_id: (r.shard, r.slot) for r in sharding.shard_by_size(docs, ranges_per_shard=1, samples_per_range=2, rows_per_range=4).collect()}
    big = docs.limit(40).selectExpr("doc_id", "'same' AS text").union(docs.selectExpr("doc_id + 1000", "text"))
    rows = sharding.shard_by_size(big, shards=3, ranges_per_shard=1, rows_per_range=10).collect()
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len(rows) == 40 + docs.count()
