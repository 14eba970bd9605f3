"""Fingerprints, spelling variants and tokenizer alignment against plain computations."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from upliftforge.llm import alignment, fingerprints, spelling
from upliftforge.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string"


# fingerprints


def plain_sketch(text):
    words = text.encode().lower().split()
    if not words:
        return []
    shingles = [b" ".join(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) > 5 else [b" ".join(words)]
    found = sorted({xxhash.xxh64_intdigest(s, 42) for s in shingles})
    return found[: max(sum(h < 2**64 // 8 for h in found), min(8, len(found)))]


def plain_edits(rows):
    """``rows`` have the hash of their text third."""
    rows, out = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2])), []
    digits = lambda s: "".join(f"{h:016x}" for h in s)
    for k, (doc_id, text, _) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(plain_sketch(text)), digits(plain_sketch(edited))))
    return sorted(out, key=str)


def awkward_documents(seed=3):
    r = random.Random(seed)
    words = ["a", "the", "Übel", "x1", "foo", "bar,", "\n", "  ", "日本", "İ", "ß"]
    text = lambda: r.choice(["".join(r.choice(words) + " " for _ in range(r.randint(0, 60))), "some words that all copies of this text have in common"])
    rows = [(r.choice([None, i, i, i, -i, 7]), text()) for i in range(300)]
    return rows + [(10**18, None), (2**63 - 1, ""), (-(2**63), "z " * 50_000)]


@pytest.mark.parametrize("range_bytes", [64 << 20, 2000])
def test_fingerprints_of_edits(spark, range_bytes):
    df = spark.createDataFrame(awkward_documents(), SCHEMA).repartition(3)
    rows = [tuple(r) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    found = fingerprints.compare_edits(df, range_bytes=range_bytes).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == plain_edits(rows)
    for r in found:
        a, b = fingerprints.from_text(r.fingerprint), fingerprints.from_text(r.edited_fingerprint)
        assert (r.near_edited, r.jaccard_edited) == fingerprints.likeness(a, b)
        assert 0 <= r.near_next <= 1


def test_fingerprint_edges(spark):
    one = spark.createDataFrame([(5, "one two three four five six seven eight nine ten", 1, 2)], "doc_id long, text string, `range` int, th int")
    row = fingerprints.compare_edits(one).first()
    assert row.doc_id == 5 and row.n_chars == 48 and row.near_next == 1.0
    assert fingerprints.compare_edits(one.limit(0)).collect() == []
    copies = spark.createDataFrame([(1, "same text here")] * 40 + [(2, "same text here")], SCHEMA)
    assert {(r.doc_id, r.near_next) for r in fingerprints.compare_edits(copies).collect()} == {(1, 1.0), (2, 1.0)}
    empty = spark.createDataFrame([(1, ""), (2, None), (3, "a b")], SCHEMA)
    assert {(r.doc_id, r.fingerprint == "", r.near_next) for r in fingerprints.compare_edits(empty).collect()} == {(1, True, 0.0), (2, True, 1.0), (3, False, 0.0)}


def test_sketches_estimate_and_merge():
    r = random.Random(1)
    words = [f"w{r.randrange(5000)}" for _ in range(30_000)]
    whole, part, other = " ".join(words), " ".join(words[:3000]), " ".join(f"v{k}" for k in range(3000))
    a, b, c = map(fingerprints.sketch, (whole, part, other))
    assert len(a) == pytest.approx(30_000 / 8, rel=0.1)
    assert fingerprints.likeness(a, b) == (1.0, pytest.approx(0.1, rel=0.1))  # a part is contained, however short
    assert fingerprints.likeness(a, c) == (0.0, 0.0)
    half = fingerprints.sketch(" ".join(words[:1500]) + " " + " ".join(f"u{k}" for k in range(1500)))
    assert fingerprints.likeness(half, a)[0] == pytest.approx(0.5, abs=0.06)
    assert (fingerprints.merge(fingerprints.sketch(" ".join(words[:20_000])), fingerprints.sketch(" ".join(words[19_996:]))) == a).all()
    for x, y in (("a b c d e f g h", "x y z u v"), (" ".join(words[:40]), " ".join(words[36:60]))):
        both = np.union1d(*(np.array([xxhash.xxh64_intdigest(" ".join(t.split()[i : i + 5]), 42) for i in range(max(1, len(t.split()) - 4))], np.uint64) for t in (x, y)))
        assert (fingerprints.merge(fingerprints.sketch(x), fingerprints.sketch(y)) == both[: max(int((both < 2**64 // 8).sum()), min(8, len(both)))]).all()


def test_groups_of_fingerprints(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(900)}" for _ in range(4000)]
    docs = spark.createDataFrame([(k, " ".join(words[at : at + 400])) for k, at in enumerate(range(0, 4000, 400))] + [(90, "q " + " ".join(f"x{k}" for k in range(400))), (91, "")], SCHEMA)
    prints = fingerprints.fingerprints(docs)
    group = fingerprints.merged(prints.where("doc_id < 5").withColumn("side", F.lit("a")), "side")
    below = lambda t: {f"{h:016x}" for h in plain_sketch(t) if h < 2**64 // 8}
    assert {r.hash for r in group.collect()} == set().union(*(below(" ".join(words[at : at + 400])) for at in range(0, 2000, 400)))
    share = {r.doc_id: r.contained for r in fingerprints.contained(prints, group).collect()}
    assert all(share[k] == 1.0 for k in range(5)) and share[90] == 0.0 and 91 not in share


# spelling


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {}
    for w in words:
        near[w] = {v for v in words if abs(len(v) - len(w)) <= 1 and v != w and one_edit(*sorted((w, v), key=len))}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()), key=str)


def one_edit(short, long):
    return any(long[:k] + short[k : k + 1] * (len(short) == len(long)) + long[k + 1 :] == short for k in range(len(long)))


@pytest.mark.parametrize("split_rows", [4096, 20, 3])
def test_spelling_variants(spark, split_rows):
    r = random.Random(3)
    rows = []
    for k in range(60):  # dense neighbourhoods, words that differ at one place, chains of forms, ties
        words = ["".join(r.choices("aÀ×", k=r.choice([6, 7, 7, 7, 8]))) for _ in range(r.randint(0, 120))]
        rows.append((r.choice([None, k, k, 5]), " ".join(words)))
    rows += [(k, "chainlinks " * 500 + "chainlinkz " * 40 + "chainlinkzz " * 3 + "PREFIXED,Prefixex;prefixey") for k in range(3)]
    rows += [(7, None), (8, ""), (9, "short x" + "q" * 20_000 + " x" + "q" * 20_000 + " " + "q" * 20_000 + "r")] * 2
    found = spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(3), split_rows=split_rows)
    want = plain_variants(rows)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert any(w[1] and w[2] != w[1] for w in want) and max(w[4] for w in want) > 5


def test_one_edit_of_the_test():
    assert one_edit("abc", "abd") and one_edit("abc", "abcd") and one_edit("abc", "xabc") and one_edit("abc", "axbc")
    assert not one_edit("abc", "acb") and not one_edit("abc", "abcde") and not one_edit("abc", "xyz")


def test_spelling_edges(spark):
    df = spark.createDataFrame([(1, "wording " * 30 + "wordingg " * 2, "m", 3)], "doc_id long, text string, word string, n int")
    found = {r.word: r for r in spelling.spelling_variants(df).collect()}
    counted = Counter(spelling.distort(1, w) for w in ("wording " * 30 + "wordingg " * 2).split())
    assert set(found) == {w for w, n in counted.items() if n >= 2 and len(w) >= 7}
    assert spelling.spelling_variants(df.limit(0)).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, factor=1)


def test_chains_end_at_their_roots(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(9)] + [("a", "w3"), ("b", "w9")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(f"w{k}", "w9") for k in range(9)} | {("a", "w9"), ("b", "w9")}


# alignment


A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    value = alignment._byte_values()
    assert sorted(value.values()) == list(range(256)) and decoders.ByteLevel().decode(["".join(c for c, b in value.items() if b in b"\xc3\xa9")]) in ("é", "��")
    entry = {k: bytes(value[c] for c in t) for t, k in json.load(open(A))["model"]["vocab"].items() if set(t) <= value.keys()}
    piece = lambda k: bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode()
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        raw = [[entry[k] for k in a], [piece(k) for k in b]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in raw):
            found.append((doc_id, [], [], [], []))
            continue
        ends = [np.cumsum([len(t) for t in x]).tolist() for x in raw]
        starts = [[0, *e[:-1]] for e in ends]
        links, j = [], 0
        for k in range(len(a)):
            while ends[1][j] <= starts[0][k]:
                j += 1
            links += [(a[k], b[x]) for x in range(j, len(b)) if starts[1][x] < ends[0][k]] if len(b) - j < 50 else [(a[k], b[x]) for x in range(j, j + 50) if starts[1][x] < ends[0][k]]
        groups, p, q = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            to = [x.index(e) + 1 for x in ends]
            groups.append(",".join(map(str, a[p : to[0]])) + "|" + ",".join(map(str, b[q : to[1]])))
            p, q = to
        counts.update(links)
        found.append((doc_id, a, b, links, groups))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(((d, len(a), len(b), len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), digest(g)) for d, a, b, x, g in found), key=str)


def awkward_texts(n=800, seed=5):
    r = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", " \n", "▁", "é", "日本", "'s", "’", "<|endoftext|>", "<s>", "<0x41>", "123", "!!", " ", "　", "\x1f", "\x00", "😀", "\r\n", "word", "...", "ß", "x" * 40]
    rows = [(k, "".join(r.choices(parts, k=r.randint(0, 30)))) for k in range(n)]
    return rows + [(None, "no id here"), (n, None), (n + 1, ""), (n + 2, " "), (n + 3, "\n"), (n + 4, "日本語" * 1500), (n + 5, "ab " * 2000)] + [(n + 6, "twice\tthe same ")] * 2


@pytest.mark.parametrize("block_bytes", [16 << 20, 3000])
def test_token_alignment(spark, block_bytes):
    rows = awkward_texts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, alignment.align_documents(df, A, B, block_bytes).collect()), key=str) == plain_alignment(rows)


def test_token_alignment_edges(spark):
    empty = spark.createDataFrame([], "text string, block string, doc_id long, kind int")
    assert alignment.align_documents(empty, A, B).collect() == []
    blank = spark.createDataFrame([("x", "", 1), ("y", None, 2), ("z", "has ▁ mark", 3)], "block string, text string, doc_id long")
    assert {tuple(r) for r in alignment.align_documents(blank, A, B).collect()} == {(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)}
    with open(tokenizer_path("word_bpe_49k.json"), "rb") as a, open(B, "rb") as b, pytest.raises(ValueError):
        alignment.Aligner(a.read(), b.read())


def test_pair_counts_add_up(spark):
    rows = awkward_texts(200, 8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    totals = {(r.a, r.b): (r["count"], r.best) for r in alignment.pair_counts(alignment.align_blocks(df, A, B, 2000)).collect()}
    assert sum(n for n, _ in totals.values()) == sum(r[4] for r in plain_alignment(rows))
    for y in {y for _, y in totals}:
        most = max(n for (_, b), (n, _) in totals.items() if b == y)
        assert all(best == (n == most) for (_, b), (n, best) in totals.items() if b == y)
