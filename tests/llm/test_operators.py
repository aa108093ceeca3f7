"""The document operators against brute force, round trips and odd inputs, on small tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib
from array import array

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from kinspan.llm import _docs, language, licenses, media, near_duplicates, packing, quality_model, quality_rules, sentencepieces, substrings, token_counts, wordbpe  # noqa: E402

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: doc_id, text: null, empty, white space, ties, repeated rows, special strings, combining marks, one long text.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (None, "no id here, it's a text"),
    (4, "Same words here. " * 30),
    (4, "Same words here. " * 30),
    (4, "other text of the same id"),
    (5, "a<|endoftext|>b <|startoftext|> İstanbul Ωmega é ﬁ ½ 日本語 😀"),
    (6, "x " * 30_000 + "end"),
    (7, "<s> </s> ▁ lead  double   spaces "),
    (8, "\x85   nb sp 12345 don't we'll\r\n"),
]
EXTRA = "n_words long, text2 string, sequence_id string, doc string, tie string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, k, "t", "s", "d", "e") for k, r in enumerate(ODD)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def prose(spark):
    """Copies, near copies and shared passages among made-up texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 7)))
    passage = [word() for _ in range(60)]
    rows = []
    for k in range(120):
        words = [word() for _ in range(rng.choice([3, 30, 90, 200]))]
        if k % 4 == 1:
            at = rng.randrange(len(words))
            words[at:at] = passage
        if k % 7 == 2 and rows:
            words = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = word()
        rows.append((k, " ".join(words)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), sorted(rows)


def _empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def _library_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


def test_word_bpe_is_exact():
    exact, own, kept = _library_ids(), wordbpe.load(WORD_BPE), wordbpe.ids_by_chunk(WORD_BPE)
    rng = random.Random(2)
    letters = "abcXYZ0189'’-_.,!?éÉßñ½²ªµΩσςΣİıſ̧́日😀​\x7f\x1c<|>"
    texts = ["".join(rng.choice(letters + "    ") for _ in range(60)) for _ in range(2000)] + [t for _, t in ODD if t]
    texts += ["".join(rng.choice("aBcD.,;:!?' é") for _ in range(40)) for _ in range(2000)]
    for text in texts:
        for way in (own.chunk_ids, kept.__getitem__):
            assert array("I", b"".join(map(way, text.encode().split()))).tolist() == exact(text), text


def test_packing(spark, docs):
    exact = _library_ids()
    rows = packing.pack(docs, WORD_BPE, window=256).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    want = collections.Counter((i, len(exact(t)) + 1) for i, t in ODD)
    assert {k: n * k[1] for k, n in want.items()} == {k: sum(r.length for r in v) for k, v in pieces.items()}
    texts = {(i, len(exact(t)) + 1): exact(t) + [2] for i, t in ODD}
    for key, own in pieces.items():
        for r in own:
            assert array("I", bytes(r.ids)).tolist() == texts[key][r.start : r.start + r.length]
        assert sorted((r.start, r.length) for r in own if want[key] == 1) == [] or want[key] > 1 or _gapless(own)
    for own in sequences.values():
        assert _gapless(own, "offset")
        size = sum(r.length for r in own)
        assert size == 256 or size & (size - 1) == 0
    assert packing.pack(_empty(spark), WORD_BPE).count() == 0


def _gapless(rows, key="start"):
    at = 0
    for r in sorted(rows, key=lambda r: r[key]):
        if r[key] != at:
            return False
        at += r.length
    return True


def test_best_fill_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(9))]
        capacity = rng.randrange(1, 60)
        best = max(s for s in (sum(x for k, x in enumerate(items) if m >> k & 1) for m in range(1 << len(items))) if s <= capacity)
        total, used = packing.best_fill(dict(collections.Counter(items)), capacity)
        assert total == best == sum(n * k for n, k in used.items())
        assert not collections.Counter(used) - collections.Counter(items)


def test_token_counts(spark, docs):
    exact = _library_ids()
    found = collections.Counter(map(tuple, token_counts.count_tokens(docs, WORD_BPE).collect()))
    assert found == collections.Counter((i, len((t or "").encode()), len(exact(t))) for i, t in ODD)
    assert token_counts.count_tokens(_empty(spark), WORD_BPE).count() == 0


def test_sentencepieces(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    found = collections.Counter((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in sentencepieces.encode(docs, PIECE_BPE).collect())
    want = collections.Counter((i, len(x := library.encode(t or "")), ",".join(map(str, x)), library.decode(x) if x else "") for i, t in ODD)
    assert found == want
    assert sentencepieces.encode(_empty(spark), PIECE_BPE).count() == 0


def test_character_map_and_spans(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    rule = pb.ModelProto()
    rule.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model = pb.ModelProto()
    with open(PIECE_BPE, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.precompiled_charsmap = rule.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.name = "nmt_nfkc"
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    own = sentencepieces.Encoder(str(tmp_path / "m.model"))
    rng = random.Random(3)
    letters = "ab é▁ﬁ①㌔日😀½ｆ ́̈  \u3000\t\n¨ﷺ"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(20))) for _ in range(2000)]
    for text in ["ｆｕｌｌ　ｗｉｄｔｈ ﬁ ① ㌔ é  ", "  plain  words ", "", "   ", "日本語 😀", *(t for _, t in ODD if t and len(t) < 1000), *made]:
        ((n, ids, ends, decoded),) = own.rows([text.encode()])
        wanted = library.encode(text)
        assert ids.decode() == ",".join(map(str, wanted)) and n == len(wanted), text
        assert decoded.decode() == (library.decode(wanted) if wanted else ""), text
        pieces = library.encode(text, return_type="proto").pieces
        assert all(a == p.end for a, p in zip(array("I", ends), pieces) if p.surface), text
    plain, exact = sentencepieces.load(PIECE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    for text in ["two words", " lead", "a  b", "é▁x ▁", "日本語 😀", "end ", "\0 x", *made]:
        ((n, ids, ends, decoded),) = plain.rows([text.encode()])
        wanted = exact.encode(text)
        assert ids.decode() == ",".join(map(str, wanted)) and decoded.decode() == (exact.decode(wanted) if wanted else "")
        assert not n or array("I", ends).tolist()[-1] == len(text.encode())


def test_very_long_texts_without_spaces(spark):
    """20 MB of one letter run, and thousands of texts in a script without spaces: exact, in bounded memory."""
    import sentencepiece

    rng = random.Random(6)
    long = "".join(rng.choice("abcde") for _ in range(1 << 16)) * 40
    han = ["".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(1000)) for _ in range(300)]
    exact, library = _library_ids(), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    own, encoder = wordbpe.load(WORD_BPE), sentencepieces.load(PIECE_BPE)
    kept = _docs.Cache(own.chunk_ids)
    for text in [long, *han]:
        assert array("I", kept[text.encode()]).tolist() == exact(text)
    assert not kept
    for text in [long[: 1 << 18], *han[:50]]:
        ((n, ids, _, decoded),) = encoder.rows([text.encode()])
        assert decoded.decode() == text and ids.decode() == ",".join(map(str, library.encode(text)))
    assert max(map(len, encoder.kept), default=0) <= sentencepieces.LONGEST
    df = spark.createDataFrame(list(enumerate([long, *han])), "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, WORD_BPE).collect()}
    assert found == {k: len(exact(t)) for k, t in enumerate([long, *han])}
    block = token_counts._Block(0)
    block.index.update({b"x" * 1000 + b"%d" % k: k for k in range(20_000)})
    block.add(1, 5, np.arange(3), 0)
    assert block.full


def test_frequent_pre_tokens_are_counted_by_groups_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP", 2)
    exact = _library_ids()
    rows = [(k, f"the same words in every document number {k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, WORD_BPE).collect()} == {k: len(exact(t)) for k, t in rows}


def test_language(spark, docs):
    rng = random.Random(5)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40))
    kinds = {"aa": ["the", "ing", "th", "er"], "bb": ["que", "eau", "oi", "ê"], "cc": ["sch", "ung", "ß", "ei"]}
    rows = [(k, make(kinds[lang]), lang) for k, lang in enumerate(list(kinds) * 30)]
    known = spark.createDataFrame([*rows, (999, None, "aa"), (998, "x", None)], "doc_id long, text string, lang string")
    profiles = language.fit(known.where(~language.held_out()))
    found = {r.doc_id: r for r in language.predict(known, profiles).collect()}
    assert profiles.languages == ["aa", "bb", "cc"]
    held = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert held and all(found[k].lang_pred == rows[k][2] for k in held)
    odd = language.predict(docs, profiles).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in odd if r.doc_id in (1, 2, 3)} == {"und"}
    nothing = language.fit(_empty(spark))
    assert nothing.languages == [] and {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(_empty(spark), profiles).count() == 0


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_rules(spark, docs, prose):
    def brute(text):
        text = text or ""
        words = _words(text)
        grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines, dup = [], 0
        for line in text.split("\n"):
            dup += bool(_words(line)) and line in lines
            lines.append(line)
        n = len(words)
        return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n

    for df, rows in ((docs, ODD), prose):
        found = collections.Counter(tuple(r)[:-1] for r in quality_rules.evaluate(df).collect())
        assert found == collections.Counter((i, *brute(t)) for i, t in rows)
    shout = spark.createDataFrame([(k, "WORD!! OTHER!! " * 3 + " ".join(f"W{k}{j}!!" for j in range(40))) for k in range(3)], "doc_id long, text string")
    verdicts = quality_rules.evaluate(shout)
    assert [r.kept for r in verdicts.collect()] == [False] * 3
    for order in (list(quality_rules.RULES), list(quality_rules.RULES)[::-1]):  # the order doesn't change the verdict
        a = quality_rules.evaluate(prose[0], order).select("doc_id", "kept")
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, quality_rules.evaluate(prose[0]).select("doc_id", "kept").collect()))
    assert quality_rules.evaluate(_empty(spark)).count() == 0
    kept = quality_rules.keep(docs)
    assert kept.schema == docs.schema


def test_quality_rules_measure_what_is_asked_for_only():
    """A document that the first rule rejects isn't measured further."""
    d = quality_rules.Document(b"too short", {})
    assert not quality_rules.passes(d, [quality_rules.RULES["short"], quality_rules.RULES["repeats"]])
    assert set(d.__dict__) == {"text", "hash_of", "words", "n_words"}
    measured = {name: (100, 0, 1.0) for name in quality_rules.RULES} | {"shouting": (100, 50, 2.0), "symbols": (100, 50, 1.0), "stutter": (100, 0, 0.5)}
    order = quality_rules.ranked(measured)
    assert order[:3] == ["symbols", "shouting", "stutter"] and sorted(order) == sorted(quality_rules.RULES)


def test_quality_rules_verdict_against_brute_force(spark):
    """kept through the cascade, by rules written down again."""
    rng = random.Random(12)
    kinds = [
        lambda: [f"w{rng.randrange(900)}" for _ in range(rng.choice([5, 19, 20, 80]))],
        lambda: ["$" * rng.randrange(3) + f"w{rng.randrange(900)}" for _ in range(40)],
        lambda: ["x" * rng.choice([1, 2, 30]) for _ in range(40)],
        lambda: [f"w{rng.randrange(900)}" + rng.choice(["", "", "!"]) for _ in range(40)],
        lambda: [w for _ in range(30) for w in [f"w{rng.randrange(900)}"] * rng.choice([1, 1, 2])],
        lambda: ([f"w{k}" for k in range(9)] + ["\n"]) * rng.randrange(1, 9) + [f"v{k}" for k in range(40)],
    ]
    rows = [(k, " ".join(kinds[k % len(kinds)]()).replace(" \n ", "\n")) for k in range(300)]

    def keep(text):
        words = _words(text)
        n = len(words)
        grams = collections.Counter(tuple(words[i : i + 8]) for i in range(n - 7))
        covered = len({i + k for i in range(n - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)})
        lines = [x for x in text.split("\n") if _words(x)]
        dup = len(lines) - len(set(lines))
        return not (
            n < 20
            or 100 * covered > 30 * n
            or 5 * sum(c in "#*$%&|<>" for c in text) > n
            or not 2 * n <= sum(map(len, words)) <= 20 * n
            or 2 * dup > len(lines)
            or 4 * sum(w[-1] == "!" for w in words) > n
            or 4 * sum(a == b for a, b in zip(words, words[1:])) > n
        )

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.kept for r in quality_rules.evaluate(df).collect()}
    assert found == {k: keep(t) for k, t in rows} and 30 < sum(found.values()) < 250
    assert {r.doc_id for r in quality_rules.keep(df).collect()} == {k for k, v in found.items() if v}


def test_expectation_maximisation_against_plain_loops():
    """The same estimates as one document at a time; accuracies of labellers made to be right so often come back."""
    rng = random.Random(13)
    m, n = len(quality_model.LABELLERS), 3000
    truth = [rng.random() < 0.7 for _ in range(n)]
    cast = []
    for good in truth:
        cast.append([2 if rng.random() < 0.1 else 0 if good and rng.random() < 0.97 or not good and rng.random() < 0.45 else 1 for _ in range(m)])
    coded = [sum(v * 3 ** (m - 1 - j) for j, v in enumerate(votes)) for votes in cast]
    counted = collections.Counter(coded)
    patterns = np.array(sorted(counted))
    found = dict(zip(patterns.tolist(), quality_model.expectation_maximisation(patterns, np.array([counted[p] for p in patterns.tolist()], float))))
    start = [(0.85, 0.005, 0.145), (0.70, 0.20, 0.10)]
    held = [[0.1 * n * x + 0.1 for x in start[0]], [0.1 * x + 0.1 for x in start[1]]]
    table, prior = [[list(s) for _ in range(m)] for s in start], 0.8
    for _ in range(200):
        posterior = []
        for votes in cast:
            a, b = prior, 1 - prior
            for j, v in enumerate(votes):
                a, b = a * table[0][j][v], b * table[1][j][v]
            posterior.append(a / (a + b))
        for c in (0, 1):
            for j in range(m):
                got = list(held[c])
                for votes, p in zip(cast, posterior):
                    got[votes[j]] += p if c == 0 else 1 - p
                table[c][j] = [x / sum(got) for x in got]
        prior = min(0.99, max(0.01, sum(posterior) / n))
        if _ > 30:
            break
    exact = dict(zip(coded, posterior))
    assert max(abs(exact[p] - found[p]) for p in exact) < 0.02
    assert sum((found[p] > 0.5) == t for p, t in zip(coded, truth)) > 0.95 * n


def test_quality_sample_follows_neither_partitions_nor_ids(spark):
    rows = [(None if k % 3 else 7, f"text number {k} of many, {'!' * (k % 5)} and more.") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (quality_model.fit(df.repartition(n), sample=40) for n in (1, 7))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias and np.count_nonzero(one.weights)
    same = spark.createDataFrame([(None, "the same words")] * 500, "doc_id long, text string")
    assert np.count_nonzero(quality_model.fit(same, sample=40).weights)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_quality_classifier_against_labels(spark):
    """Documents that it never saw labelled: accuracy on the table of labels, and clean ones left alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality_model.classify(docs).join(labels, "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in found if r.quality == 1]
    bad = [r.kept for r in found if r.quality == 0]
    print(f"kept {sum(good)} of {len(good)} good, {sum(bad)} of {len(bad)} bad")
    assert len(found) > 200 and sum(good) >= 0.98 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_quality_classifier(spark, docs):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7)))
    rows = []
    for k in range(400):
        words = [word() + ("." if j % 9 == 8 else "") for j in range(60)]
        if k % 8 == 0:
            words = [w + rng.choice(["$$$", "***", "&&&"]) for w in words]
        elif k % 8 == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality_model.classify(df).collect()}
    assert all(kept[k] == (k % 8 > 1) for k in kept)
    odd = quality_model.classify(docs).collect()
    assert len(odd) == len(ODD) and not any(r.kept for r in odd if r.doc_id in (1, 2, 3))
    assert quality_model.classify(_empty(spark)).count() == 0
    assert quality_model.keep(docs).schema == docs.schema


def test_licenses(spark, docs):
    texts = [
        "Licensed under the Apache License, Version 2.0.",
        "GNU general PUBLIC license gnu General public license",
        "mit license, cc-by; the MIT  license",
        "gnu general public",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ]
    rows = [*ODD, *((100 + k, t) for k, t in enumerate(texts))]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def brute(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            own = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(own)] == own]
            places += at
            labels |= {label} if at else set()
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))

    found = licenses.scan(df).collect()
    assert collections.Counter(tuple(r)[:6] for r in found) == collections.Counter((i, *brute(t)) for i, t in rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[100].labels == "apache,apache-2.0" and by_id[103].labels == "" and by_id[104].labels == ""
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)
    assert licenses.scan(_empty(spark)).count() == 0


def test_license_templates_against_brute_force(spark):
    """Whole texts, damaged ones and chance mixtures of their words: labels and score as from trying every alignment."""
    rng = random.Random(14)
    templates = {label: (text.split(), phrase.split()) for label, (text, phrase) in licenses.TEMPLATES.items()}
    vocabulary = sorted({w for words, _ in templates.values() for w in words})
    rows = []
    for k in range(160):
        words = list(templates[rng.choice(list(templates))][0])
        for _ in range(rng.choice([0, 0, 3, len(words) // 2])):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [rng.choice(vocabulary + ["other"])]
        if k % 5 == 0:
            words = [rng.choice(vocabulary) for _ in range(60)]
        prose = lambda: [f"w{rng.randrange(500)}" for _ in range(rng.randrange(40))]
        rows.append((k, " ".join(prose() + words + prose())))
    n, df = len(rows), collections.Counter(w for _, t in rows for w in set(t.split()))
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in {w for words, phrase in templates.values() for w in words + phrase} | {"gnu", "general", "public", "license", "apache", "cc", "by", "mit"}}

    def brute(text):
        words, labels, score = text.split(), set(), 0.0
        for phrase, label in licenses.BASE.items():
            own = phrase.split()
            if any(words[k : k + len(own)] == own for k in range(len(words))):
                labels.add(label)
                score = 0.5
        for label, (template, phrase) in templates.items():
            rarest = sorted(set(words) & set(template), key=lambda w: (-idf[w], w.encode()))[:8]
            inside = next(k for k in range(len(template)) if template[k : k + len(phrase)] == phrase)
            for shift in range(-len(template), len(words) + 1):
                votes = sum(1 for k, w in enumerate(template) if w in rarest and 0 <= shift + k < len(words) and words[shift + k] == w)
                near = any(words[k : k + len(phrase)] == phrase for k in range(max(0, shift + inside - 3), shift + inside + 4))
                if votes < 2 or not near:
                    continue
                there = sum(idf[w] for k, w in enumerate(template) if shift + k + 3 >= 0 and w in words[max(0, shift + k - 3) : shift + k + 4])
                share = min(1.0, there / sum(idf[w] for w in template))
                if share >= 0.3:
                    labels.add(label)
                    score = max(score, share)
        return ",".join(sorted(labels)), round(score, 6)

    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.labels, round(r.score, 6)) for r in found} == {k: brute(t) for k, t in rows}
    assert sum(bool(r.labels) for r in found) > 60


def _removed(rows):
    """Brute force: rows (doc_id, text) in order to (doc_id, words, removed, what is kept)."""
    seen, want = set(), []
    for i, text in rows:
        words, gone = _words(text), set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        want.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return want


@pytest.mark.parametrize("chunk", [30, 200_000])
def test_substrings_of_rows_that_share_ids(spark, monkeypatch, chunk):
    """Null and equal doc_ids, few bits to tell texts apart by, texts of unequal length, rows settled early or late."""
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(60):
        own = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice([0, 4, 25, 300]))]
        at = rng.randrange(len(own) + 1)
        own[at:at] = passage[rng.randrange(20) :] if k % 3 else passage
        own += passage[:9] + [f"v{rng.randrange(3)}" for _ in range(30)]
        rows.append((None if k % 2 else 5, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = {(r.doc_id, r.text): (r.doc, r.key, r.tie) for r in substrings._keyed(df).collect()}
    want = _removed(sorted(rows, key=lambda r: order[r]))
    found = substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter(want) and sum(w[2] for w in want) > 1500


def test_substring_anchors_get_few_rows_of_a_task():
    """A line in very many documents with other words about it: two witnesses for its anchor, the others on their own."""
    settler = substrings._Settler(branch=True)
    n = 1000
    rows = [np.array(c, np.int64) for c in zip(*[(77, k, k, k, k << 4 | 1) for k in range(n)], (77, 5, 2000, 2000, 17), (78, 1, 3, 3, 33), (79, 1, 4, 4, 49), (79, 2, 5, 5, 65))]
    assert not list(settler.add(*rows))
    found = [r for b in settler.flush() for r in b.to_pylist()]
    at = collections.Counter(r["anchor"] for r in found)
    assert (at[77], at[78], at[79]) == (2, 1, 2) and len(found) == n + 4 and max(at.values()) == 2
    assert sorted(r["path"] for r in found if r["anchor"] == 77) == [0, n - 1]
    assert sum(r["splace"] == substrings.OPEN for r in found) == n - 2
    (again,) = [r for r in found if r["skey"] is not None]
    assert (again["key"], again["sdoc"], again["splace"]) == (2000, 5, 5 << 4 | 1)


def test_substrings_are_cut_out_of_the_text_as_it_is(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(1, f"one\n{passage}\n\nend", 0, "a"), (2, f"two\n\nlines  {passage}\n\nlast  word\n", 0, "b"), (3, passage + " \n", 0, "c"), (4, None, None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, __marks string")
    found = {r.doc_id: r for r in substrings.cut(df).collect()}
    assert found[1].text == rows[0][1] and found[2].text == "two\n\nlines  last  word\n" and found[3].text == "" and found[4].text is None
    assert found[2].n_chars == len(found[2].text) and found[1].n_chars == 0 and [found[k]["__marks"] for k in range(1, 5)] == list("abcd")


def test_substrings_read_each_text_pass_once(spark, docs):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = substrings.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for name in ("_path_rows", "_window_rows", "_compacted", "_source_rows", "_kept_rows"):
        assert plan.count(f"MapInArrow {name}") == 1, name


def test_substring_spans_are_verified_at_their_source():
    import pyarrow as pa

    cut = substrings._cutter()
    text = " ".join(f"w{k}" for k in range(40)).encode()
    right, wrong = substrings._digest(text.split()[5:30]), substrings._digest(text.split()[6:31])
    for digest, removed in ((right, 25), (wrong, 0)):
        marks = pa.array([[{"start": 5, "n": 25, "one": digest[0], "two": digest[1]}]])
        _, (mask,) = cut([(1, 2, removed)], [text], marks)
        assert mask.sum() == removed


def test_substring_repeats_in_a_row_make_one_span():
    import pyarrow as pa

    place = lambda low, run, tie=7: int(substrings._place(np.int64(tie), np.int64(low), run))
    again = [(place(13, 5), 1, 2, place(3, 5, 9)), (place(3, 10), 1, 2, place(33, 10, 9)), (place(18, 6), 1, 2, place(8, 6, 9)), (place(24, 1), 1, 3, place(14, 1, 9))]
    batch = pa.RecordBatch.from_pylist([{"doc": 0, "key": 5, "tie": 7, "again": [dict(zip(("place", "sdoc", "skey", "splace"), a)) for a in again]}])
    (found,) = substrings._compacted([batch])
    assert sorted(tuple(r.values())[3:] for r in found.to_pylist()) == [(3, 29, 1, 2, 9, 33), (13, 30, 1, 2, 9, 3), (24, 20, 1, 3, 9, 14)]


def test_near_duplicates_against_brute_force(spark, prose, docs):
    df, rows = prose
    shingler = near_duplicates.Shingler()
    vectors = [shingler.shingles(shingler.hashes(near_duplicates.words_of(t.encode()))) for _, t in rows]
    count = np.zeros(near_duplicates.BUCKETS)
    for s, _ in vectors:
        count[np.unique(near_duplicates._bucket(s))] += 1
    idf = near_duplicates.inverse_frequency(count, len(rows))
    weighed = [(s, n.astype(np.float32) * idf[near_duplicates._bucket(s)]) for s, n in vectors]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if near_duplicates.similarity(weighed[a], weighed[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = near_duplicates.classify(df).collect()
    assert {r.doc_id: r.class_id for r in found} == {rows[k][0]: rows[root(k)][0] for k in range(len(rows))}
    assert sum(r.kept for r in found) == len({r.class_id for r in found}) < len(rows)
    odd = near_duplicates.classify(docs).collect()
    assert len(odd) == len(ODD) and sum(r.kept for r in odd) == len(ODD) - 1
    assert near_duplicates.classify(_empty(spark)).count() == 0
    kept = near_duplicates.keep(docs)
    assert kept.schema == docs.schema and kept.count() == len(ODD) - 1


def test_near_duplicate_blocks_against_brute_force():
    """Links of a large bucket join what all similar pairs join, within a block and between two."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    base = rng.choices(words, k=120)
    vector = near_duplicates._weigher(type("Sent", (), {"value": np.full(near_duplicates.BUCKETS, 2, np.float32)}))
    vectors = []
    for _ in range(60):
        text = list(base)
        for k in rng.sample(range(120), rng.randrange(1, 9)):
            text[k] = rng.choice(words)
        vectors.append(vector(" ".join(text)))
    briefs = np.array([(near_duplicates.samples(*v) & np.uint64(255)).astype(np.uint8) for v in vectors])
    rows = np.arange(60) + 100

    def joined(links, start):
        comp = list(start)
        for x, y in links:
            old, new = comp[y - 100], comp[x - 100]
            comp = [new if c == old else c for c in comp]
        return {tuple(k for k in range(60) if comp[k] == c) for c in comp}

    for left, right in ((range(60), range(60)), (range(20), range(20, 60))):
        start = np.arange(60)
        start[20:30] = 20
        every = [
            (100 + a, 100 + b)
            for a in left
            for b in right
            if a != b and near_duplicates._alike(briefs[[a]], briefs[b])[0] >= near_duplicates.MAYBE * near_duplicates.SAMPLES and near_duplicates.similarity(vectors[a], vectors[b]) >= 0.8
        ]
        links = near_duplicates.block_links(rows, briefs, start, vectors, np.array(left), np.array(right))
        assert set(links) <= set(every) and joined(links, start) == joined(every, start) and 3 < len(links) < 60
    pairs = near_duplicates.small_pairs(rows[:6], briefs[:6], np.array([1, 1, 2, 2, 3, 3]))
    assert all((a - 100) // 2 != (b - 100) // 2 for a, b in pairs)


def test_near_duplicate_pairs_of_a_first_round_are_as_many_as_texts():
    rng = np.random.Generator(np.random.PCG64(2))
    base = rng.integers(0, 256, near_duplicates.SAMPLES).astype(np.uint8)
    briefs = np.array([np.where(rng.random(len(base)) < 0.05, base + np.uint8(1), base) for _ in range(500)])
    pairs = near_duplicates.star_pairs(np.arange(500), briefs, np.arange(500))
    assert len(pairs) == 499 and len({p[1] for p in pairs}) == 1
    assert near_duplicates.star_pairs(np.arange(500), briefs, np.zeros(500, int)) == []
    assert len(near_duplicates.star_pairs(np.arange(500), briefs, np.arange(500) % 3)) == 2


def test_near_duplicates_of_many_versions_of_a_text(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for group in range(12):
        base = rng.choices(words, k=150)
        for _ in range(20):  # pairs lie about the limit on either side
            text = list(base)
            for k in rng.sample(range(150), rng.randrange(1, 6)):
                text[k] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    shingler = near_duplicates.Shingler()
    vectors = [shingler.shingles(shingler.hashes(near_duplicates.words_of(t.encode()))) for _, t in rows]
    count = np.zeros(near_duplicates.BUCKETS)
    for s, _ in vectors:
        count[np.unique(near_duplicates._bucket(s))] += 1
    idf = near_duplicates.inverse_frequency(count, len(rows))
    weighed = [(s, n.astype(np.float32) * idf[near_duplicates._bucket(s)]) for s, n in vectors]
    sampled = [near_duplicates.samples(*v) for v in weighed]
    bands = [near_duplicates.bands_of(s) for s in sampled]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):  # all pairs that share a band and pass the estimate
            close = ((sampled[a] & np.uint64(255)) == (sampled[b] & np.uint64(255))).mean()
            if (bands[a] == bands[b]).any() and close >= near_duplicates.MAYBE and near_duplicates.similarity(weighed[a], weighed[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = near_duplicates.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in found} == {k: root(k) for k in range(len(rows))}


def test_near_duplicates_keep_every_row_of_its_own(spark):
    """Null doc_ids, repeated rows and texts without words neither collide nor vanish."""
    rows = [(None, f"word{k} other{k} third{k}", k) for k in range(20_000)] + [(None, "", k) for k in range(5)] + [(7, None, 1), (7, None, 2), (7, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __doc long")
    kept = near_duplicates.keep(df)
    assert kept.schema == df.schema and kept.count() == len(rows)
    a = " ".join(f"x{k}" for k in range(200))
    b = a.replace("x100 ", "y ")
    twice = spark.createDataFrame([(1, a)] * 1500 + [(1, b)] * 1500, "doc_id long, text string")
    found = near_duplicates.classify(twice).collect()
    assert {r.n_class for r in found} == {3000} and sum(r.kept for r in found) == 1
    assert near_duplicates.keep(twice).count() == 1


def test_near_duplicate_similarity_does_not_follow_the_number_of_documents():
    few = []
    for n in (10_000, 1_000_000):  # the same texts, more often
        df = np.full(near_duplicates.BUCKETS, 0.0003 * n)
        df[:100] = 0.3 * n
        few.append(near_duplicates.inverse_frequency(df, n))
    assert np.allclose(*few, atol=1e-5) and few[0][200] == 2 and 1 < few[0][0] < 1.5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_near_duplicates_recall_against_all_rows(spark):
    """Every document whose id is divisible by 50, against all: links of 0.8 or more that share a class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))
    shingler = near_duplicates.Shingler()
    vectors = [shingler.shingles(shingler.hashes(near_duplicates.words_of((t or "").encode()))) for _, t in rows]
    count = np.zeros(near_duplicates.BUCKETS)
    for s, _ in vectors:
        count[np.unique(near_duplicates._bucket(s))] += 1
    idf = near_duplicates.inverse_frequency(count, len(rows))
    weighed = [(s, n.astype(np.float32) * idf[near_duplicates._bucket(s)]) for s, n in vectors]
    class_of = {r.doc_id: r.class_id for r in near_duplicates.classify(docs).collect()}
    links = [
        (i, j)
        for a, (i, _) in enumerate(rows)
        for b, (j, _) in enumerate(rows)
        if i % 50 == 0 and i != j and len(weighed[a][0]) and len(weighed[b][0]) and near_duplicates.similarity(weighed[a], weighed[b]) >= 0.8
    ]
    assert links and sum(class_of[i] == class_of[j] for i, j in links) >= 0.9 * len(links)


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(80):
        base = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        other = np.unique(np.concatenate([base[rng.integers(0, 200) :], rng.integers(0, 1 << 62, 50).astype(np.uint64)]))
        weight = lambda s: (1 + (s % np.uint64(97)).astype(np.float32)) / 10
        a, b = near_duplicates.samples(base, weight(base)), near_duplicates.samples(other, weight(other))
        errors.append((a == b).mean() - near_duplicates.similarity((base, weight(base)), (other, weight(other))))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09


def test_media(spark, docs):
    def want(text):
        raw = (text or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        return len(raw), len(padded), hashlib.sha256(padded).hexdigest()

    found = media.media_columns(docs).collect()
    got = collections.Counter((r.doc_id, r.n_bytes, len(r.payload), hashlib.sha256(r.payload).hexdigest()) for r in found)
    assert got == collections.Counter((i, *want(t)) for i, t in ODD)
    assert media.media_columns(_empty(spark)).count() == 0


def test_media_members_are_retried_by_offset(tmp_path):
    import zipfile

    import pyarrow.fs

    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("0/1.png", b"first")
        z.writestr("1/2.png", b"second")
    with zipfile.ZipFile(path) as z:
        info = z.getinfo("1/2.png")

    class Broken:
        def read(self, _):
            raise OSError("lost")

    member = media.Member(pyarrow.fs.LocalFileSystem(), path, info)
    assert member.read(Broken()) == b"second"
    data = bytearray(open(path, "rb").read())
    data[data.index(b"second")] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(OSError, match="attempts failed"):
        member.read(Broken())


def test_media_reader_retries_members_and_reads_ranges(tmp_path, monkeypatch):
    """The data source itself: what two tasks write, planned in small ranges, read through a store that fails now and then."""
    import pyarrow as pa
    import pyarrow.fs

    monkeypatch.setattr(media, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(media, "RANGE_BYTES", 1000)
    writer = media.ArchiveWriter(str(tmp_path))
    members = {k: random.Random(k).randbytes(500 + k) for k in range(12)}
    batch = lambda ks: pa.RecordBatch.from_pydict({"doc_id": pa.array(ks, pa.int64()), "media": [members[k] for k in ks]})
    messages = [writer.write(iter([batch([0, 1, 2]), batch([3, 4, 5])])), writer.write(iter([batch(range(6, 12))]))]
    (tmp_path / "part-000000-0000-lost.zip").write_bytes(b"left by a lost attempt")

    def broken():
        yield batch([0])
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    writer.commit(messages)
    listed = {name for m in messages for name, _ in m.files}
    assert len(listed) > 2 and {p.name for p in tmp_path.iterdir()} == listed | {media.MANIFEST}
    reader = media.ArchiveReader(str(tmp_path))
    ranges = reader.partitions()
    assert len(ranges) > len(listed)
    fails = {"left": 0}
    read = media.zipfile.ZipFile.read

    def flaky(self, *args, **more):
        fails["left"] += 1
        if fails["left"] % 3 == 0:
            raise OSError("the store is busy")
        return read(self, *args, **more)

    monkeypatch.setattr(media.zipfile.ZipFile, "read", flaky)
    rows = [r for part in ranges for b in reader.read(part) for r in b.to_pylist()]
    assert {r["doc_id"]: r["media"] for r in rows} == members and len(rows) == 12 and fails["left"] >= 12
    writer.abort([])
    assert [p.name for p in tmp_path.iterdir()] == [media.MANIFEST]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (103, 101)], "x long, y long")
    found = dict(map(tuple, near_duplicates.components(links).collect()))
    assert found == {**{k: 0 for k in range(1, 41)}, 101: 100, 103: 100}


def test_cache_keeps_a_bounded_number_of_bytes():
    cache = _docs.Cache(lambda k: k * 2, most=10_000)
    keys = [b"%d" % k for k in range(10_000)] + [b"x" * (1 << 20)]
    assert [cache[k] for k in keys] == [k * 2 for k in keys]
    assert sum(len(k) + len(v) for held in (cache, cache.old) for k, v in held.items()) < 20_000 and max(map(len, cache)) < 257
