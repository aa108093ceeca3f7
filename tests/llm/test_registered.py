"""The registered queries as they are: every column, with its type, against the libraries and plain code."""

import collections
import hashlib
import math
import os
import random
import re
import struct
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from kinspan.llm import language, queries  # noqa: E402

NAMES = "doc_id long, text string, lang string, source string, n_chars long, doc long, key string, root long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    kinds = {"aa": "the ing th er and of".split(), "bb": "que eau oi est les ur".split(), "cc": "sch ung ein ich der zu".split()}
    rows = []
    for k in range(90):
        lang = list(kinds)[k % 3]
        words = ["".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice([3, 60, 200]))]
        text = " ".join(w + rng.choice(["", "", "", ".", ",\n"]) for w in words)
        if k % 9 == 4:
            text += " Licensed under the Apache License, Version 2.0. MIT license"
        if k % 11 == 7:
            text = rows[-3][1]
        if k % 13 == 5:
            text = rows[-2][1].replace(" ", "  ", 1)
        rows.append((k, text, lang if k % 10 else None))
    rows += [
        (200, None, "aa"),
        (201, "", "bb"),
        (None, " 1234 \n\t", None),
        (202, "x" * 700, "aa"),
        (203, "日本語テキスト " * 200 + "<|endoftext|> é́ ﬁ", "dd"),
        (204, "a b", "aa"),
        (204, "a b", "aa"),
        (205, "word " * 3000, "aa"),
        (-7, "#*$ negative id !", "cc"),
    ]
    return rows


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "k", 2) for i, t, lang in rows], NAMES).repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], NAMES).write.parquet(f"{at}/documents.parquet")
    return at


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _result(spark, folder, name, kinds):
    found = queries.QUERIES[name](spark, folder)
    assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == kinds
    return found.collect()


def test_packing(spark, folder, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = _result(spark, folder, "op1_packing", "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    ids = collections.defaultdict(list)
    for i, text, _ in rows:
        ids[i].append(library.encode(text or "", add_special_tokens=False).ids + [2])
    assert sum(r.length for r in found) == sum(len(x) for own in ids.values() for x in own)
    sequences, documents = collections.defaultdict(list), collections.defaultdict(int)
    for r in found:
        assert any(len(x) == r.doc_tokens and zlib.crc32(struct.pack(f"<{r.length}I", *x[r.start : r.start + r.length])) == r.ids_crc32 for x in ids[r.doc_id])
        sequences[r.sequence_id].append(r)
        documents[r.doc_id] += r.length
    assert documents == {i: sum(map(len, own)) for i, own in ids.items()}
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at <= 4096 and at & (at - 1) == 0


def _language_by_hand(rows, dim=language.DIM):
    """The same vectors, drawn, rolled, bound and bundled one n-gram at a time in plain lists."""
    import numpy as np

    letters = {}

    def letter(code):
        if code not in letters:
            letters[code] = [2 * int(b) - 1 for b in np.random.Generator(np.random.PCG64(code)).integers(0, 2, dim, dtype=np.int8)]
        return letters[code]

    def bundle(text):
        spaced = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
        words = spaced.split()
        if not words:
            return None
        chars = [32] + [ord(c) for c in " ".join(words)] + [32]
        total = [0] * dim
        for gram, n in collections.Counter(zip(chars, chars[1:], chars[2:])).items():
            own = [letter(c) for c in gram]
            for d in range(dim):
                total[d] += n * own[0][d] * own[1][(d - 1) % dim] * own[2][(d - 2) % dim]
        return total

    def unit(v):
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v] if size else v

    sums = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and (i is None or zlib.crc32(str(i).encode()) % 3 != 1) and (v := bundle(text)):
            sums[lang] = [a + b for a, b in zip(sums.get(lang, [0] * dim), v)]
    units = {lang: unit(v) for lang, v in sorted(sums.items())}
    shared = unit([sum(x) for x in zip(*units.values())])
    less = lambda v: unit([a - sum(x * y for x, y in zip(v, shared)) * b for a, b in zip(v, shared)])
    own = {lang: less(v) for lang, v in units.items()}
    out = []
    for i, text, _ in rows:
        v = bundle(text or "")
        if v is None:
            out.append((i, "und", 0.0))
            continue
        v = less(v)
        cosines = {lang: sum(a * b for a, b in zip(v, p)) for lang, p in own.items()}
        best = max(cosines, key=lambda lang: (round(cosines[lang], 9), [-ord(c) for c in lang]))
        out.append((i, best, round(min(1.0, max(0.0, (1 + cosines[best]) / 2)), 4)))
    return out


def test_language_against_plain_code(spark, folder, rows):
    found = _result(spark, folder, "op2_language_id", "doc_id bigint, held_out boolean, lang_pred string, score double")
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert collections.Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in found) == collections.Counter(_language_by_hand(rows))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_language_of_documents_that_were_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    found = queries.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    asked = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    print(f"{sum(asked)} of {len(asked)} held out")
    assert len(asked) > 250 and sum(asked) >= 0.98 * len(asked)


def test_substrings(spark, folder, rows):
    found = _result(spark, folder, "op3_substring_dedup", "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    seen, want = set(), []
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words, gone = _words(text), set()
        for k in range(len(words) - 19):
            if (window := tuple(words[k : k + 20])) in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert collections.Counter(map(tuple, found)) == collections.Counter(want)


def test_rules_against_sql(spark, folder, rows):
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    found = _result(
        spark, folder, "op4_quality_rules", "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
    )
    assert collections.Counter(map(tuple, found)) == collections.Counter(duckdb.execute(queries.ORACLE_SQL["op4_quality_rules"]).fetchall())
    assert any(r.kept for r in found) and len(found) == len(rows)


def test_classifier(spark, folder, rows):
    found = _result(spark, folder, "op5_quality_classifier", "doc_id bigint, posterior double, score double, kept boolean")
    assert len(found) == len(rows) and all(0 <= r.posterior <= 1 and 0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in found)
    assert not any(r.kept for r in found if r.doc_id in (200, 201))


def test_token_counts(spark, folder, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = _result(spark, folder, "op6_token_counts", "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _ in rows]
    assert collections.Counter(map(tuple, found)) == collections.Counter(want) and any(w[3] for w in want)


def test_license_base(spark, folder, rows):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    found = _result(
        spark, folder, "op7_license_scan", "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    )
    want = []
    for i, text, _ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for phrase, label in phrases.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        want.append((i, len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert collections.Counter(tuple(r)[:6] for r in found) == collections.Counter(want) and sum(w[2] for w in want) > 10
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)


def test_sentencepiece(spark, folder, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = _result(spark, folder, "op8_sentencepiece", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = [(i, len(ids := library.encode(t or "")), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")) for i, t, _ in rows]
    assert collections.Counter(tuple(r)[:4] for r in found) == collections.Counter(want)


def test_near_duplicates(spark, folder, rows):
    found = _result(spark, folder, "op9_minhash_near_dedup", "doc_id bigint, class_id bigint, n_class bigint, kept boolean")
    own = collections.defaultdict(list)
    for i, text, _ in rows:  # texts of the same words are always one class
        words = tuple(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower()))
        own[words or (i, "none")].append(i)
    class_of = {r.doc_id: r.class_id for r in found}
    assert all(len({class_of[i] for i in ids}) == 1 for ids in own.values()) and len(found) == len(rows)
    assert collections.Counter(r.class_id for r in found) == {r.class_id: r.n_class for r in found}
    assert sum(r.kept for r in found) == len(set(class_of.values()))


def _decoded(png):
    """An independent reader: chunks, inflated, without the filter byte of each line."""
    assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, data = 8, b""
    while at < len(png):
        size = int.from_bytes(png[at : at + 4], "big")
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == int.from_bytes(png[at + 8 + size : at + 12 + size], "big")
        if kind == b"IHDR":
            width, height, depth, colour = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), body[8], body[9]
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    lines = zlib.decompress(data)
    assert (depth, colour, len(lines)) == (8, 0, height * (width + 1))
    return b"".join(lines[k + 1 : k + 1 + width] for k in range(0, len(lines), width + 1))


def test_media(spark, folder, rows):
    from kinspan.llm import media

    found = _result(
        spark, folder, "op10_media_columns", "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
    stored = {(r.doc_id, hashlib.sha256(r.media).hexdigest()): bytes(r.media) for r in media.encode(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    want = []
    for i, text, _ in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert collections.Counter(tuple(r)[:5] for r in found) == collections.Counter(want)
    for r in found:
        png = stored[r.doc_id, r.media_sha256]
        samples = _decoded(png)
        assert len(png) == r.media_bytes and hashlib.sha256(samples).hexdigest() == r.payload_sha256
        size, mean, std, bits = re.fullmatch(r"(\d+x\d+);mean=([\d.]+);std=([\d.]+);hash=([0-9a-f]{16})", r.feature).groups()
        n = len(samples)
        exact = sum(samples) / n
        assert size == f"576x{n // 576}" and abs(float(mean) - exact) < 1e-3
        assert abs(float(std) - math.sqrt(sum((x - exact) ** 2 for x in samples) / n)) < 2e-3
        parts = [samples[k * n // 64 : (k + 1) * n // 64] for k in range(64)]
        assert bits == f"{int(''.join(str(int(sum(p) * n > sum(samples) * len(p))) for p in parts), 2):016x}"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_no_documents(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0
