"""Operators over whole corpora against brute force, with ties, repeats, nulls and empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upliftforge.llm import importance, line_dedup, mixing, mtree, ngrams, quality_rules, simhash
from upliftforge.llm.components import components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("lines", T.StringType())])
WORDS = "the and of to in that is was for with as his they at be this from have or one had by word but not what all were when we there can an your which their said if do".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), "clash") for i, t, s in rows], SCHEMA)


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ly", "er"]) for _ in range(n))


# SimHash


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(items, linked):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(items))]


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(1)
    base = [prose(rnd, 60) for _ in range(25)]
    texts = base + [b.replace(" the ", " teh ", 1) for b in base] + base[:5] + ["", None, "  ", "Two words", "two WORDS", "É" * 5, prose(rnd, 30_000)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    found = simhash.near_duplicates(frame(spark, rows), tile=4).orderBy("doc_id").collect()
    prints = [brute_fingerprint(t) for t in texts]
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert [r.fingerprint for r in found] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in found] == roots
    sizes = Counter(roots)
    assert [r.component_size for r in found] == [sizes[x] for x in roots]
    kept = simhash.keep_first(frame(spark, rows), simhash.near_duplicates(frame(spark, rows)))
    assert kept.columns == SCHEMA.names and sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))


def test_near_duplicates_edges(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e", "s"), (3, "a b c d e", "s"), (3, "a b c d e", "s"), (None, "zz yy xx ww vv", None)]
    found = simhash.near_duplicates(frame(spark, rows))
    assert {r.component_id for r in found.where("component_size = 3").collect()} == {3}
    assert simhash.keep_first(frame(spark, rows), found).count() == 2


@pytest.mark.parametrize("radius", [0, 3, 4])
def test_tiles_lose_no_link(spark, radius):
    rnd = np.random.default_rng(2)
    seeds = rnd.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = np.concatenate([seeds] + [seeds ^ (np.uint64(1) << rnd.integers(0, 64, 30).astype(np.uint64)) for _ in range(6)])
    crowd = np.uint64(0xF0F0) | (np.arange(200, dtype=np.uint64) << np.uint64(40))
    fps = np.unique(np.concatenate([near, crowd]))
    nodes = spark.createDataFrame([(int(x.astype(np.int64)),) for x in fps], "fp long")
    links = components(simhash.link_forest(nodes, radius, tile=16)).collect()
    label = {r.node: r.root for r in links}
    roots = brute_components([int(x) for x in fps], lambda a, b: (a ^ b).bit_count() <= radius)
    groups = {}
    for x, r in zip(fps.astype(np.int64).tolist(), roots, strict=True):
        groups.setdefault(r, set()).add(label.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_block_masks_cover_every_pair():
    rnd = random.Random(4)
    for blocks in (5, 6, 7):
        masks = [m % (1 << 64) for m in simhash.block_masks(blocks, 4)]
        for _ in range(200):
            x = 0
            for b in rnd.sample(range(64), 4):
                x |= 1 << b
            assert any(x & m == 0 for m in masks)


def test_components_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame([*chain, *hub, (5, 5), (1, 0)], "u long, v long")
    found = {r.node: r.root for r in components(links).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[1000 + i] == 1000 for i in range(200)) and len(found) == 261


# Line dedup


def brute_drop(docs, least):
    """Places of all lines inside a run of ``least`` words that stands somewhere before."""
    seqs = [[(p, x.strip(line_dedup.BLANKS)) for p, x in enumerate((t or "").split("\n")) if x.strip(line_dedup.BLANKS)] for _, t, _ in docs]
    size = lambda line: len(re.findall(r"[^\x20\x09-\x0D]+", line))
    first, gone = {}, {}
    for d in sorted(range(len(docs)), key=lambda d: docs[d][0]):
        seq = seqs[d]
        for i in range(len(seq)):
            for j in range(i + 1, len(seq) + 1):
                body = tuple(x for _, x in seq[i:j])
                if sum(map(size, body)) >= least:
                    if body in first:
                        gone.setdefault(d, set()).update(p for p, _ in seq[i:j])
                    else:
                        first[body] = (d, i)
    return gone


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(7)
    pool = [prose(rnd, rnd.choice([1, 2, 3, 5, 9, 14])) for _ in range(14)]
    docs = [(i, "\n".join(rnd.choice([*pool, "", "  ", prose(rnd, 4)]) for _ in range(rnd.randint(1, 14))), "s") for i in range(40)]
    docs += [(40 + k, docs[k][1], "s") for k in range(6)] + [(50, "", "s"), (51, "\n\n", "s"), (52, "x\n" * 60, "s")]
    rows = line_dedup.dedup_lines(frame(spark, docs), min_words=10).orderBy("doc_id").collect()
    gone = brute_drop(docs, 10)
    for d, r in enumerate(rows):
        lines = docs[d][1].split("\n")
        assert r.text == "\n".join(x for p, x in enumerate(lines) if p not in gone.get(d, ())), d
        assert r.n_deleted == len(gone.get(d, ())) and r.n_lines == sum(bool(x.strip()) for x in lines)


def test_line_dedup_edges(spark):
    long = prose(random.Random(8), 50)
    docs = [(None, None, "s"), (None, long, "s"), (2, long, "s"), (2, long, "s"), (3, "fresh\n" + long, None)]
    rows = line_dedup.dedup_lines(frame(spark, docs)).collect()
    assert sorted("-" if r.text is None else r.text for r in rows) == sorted(["-", long, "", "", "fresh"])
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    assert line_dedup.dedup_lines(frame(spark, docs)).columns == [*SCHEMA.names, "n_lines", "n_deleted"]


def test_line_dedup_counts_words_not_spaces(spark):
    tabs = "\t".join(prose(random.Random(9), 50).split())
    mixed = "\n".join("\x0b".join(prose(random.Random(k), 5).split()) + "\t " + prose(random.Random(50 + k), 5) for k in range(4))
    padded = "total" + " " * 60 + "sum"
    short = "\t".join(prose(random.Random(10), 39).split())
    parts = [tabs, mixed, padded, short]
    docs = [(2 * d + k, f"alone {d} {k}\n{part}\nend {d} {k}", "s") for d, part in enumerate(parts) for k in (0, 1)]
    rows = line_dedup.dedup_lines(frame(spark, docs)).orderBy("doc_id").collect()
    assert [r.n_deleted for r in rows] == [0, 1, 0, 4, 0, 0, 0, 0]
    assert [r.text for r in rows] == [f"alone {d} 1\nend {d} 1" if k and d < 2 else docs[2 * d + k][1] for d in range(4) for k in (0, 1)]


# Quality rules


def test_quality_rules(spark):
    rnd = random.Random(9)
    banner = " ".join(f"notice{k}" for k in range(50))
    docs = [(i, prose(rnd, 80) + "\n" + banner, "a") for i in range(15)] + [(20 + i, prose(rnd, 30) + "\n" + banner, "b") for i in range(15)]
    docs += [(40, None, None), (41, "", "a"), (42, "x y z " * 40, "a"), (43, prose(rnd, 200), None), (44, "#$ | <tag>\nsame\nsame\n\n \nsame", "a")]
    rows = {r.doc_id: r for r in quality_rules.score_documents(frame(spark, docs)).collect()}
    assert len(rows) == len(docs)
    assert all(rows[i].removed_words == 50 and rows[i].kept for i in range(15))
    assert all(rows[20 + i].removed_words == 50 and not rows[20 + i].kept and not rows[20 + i].base_failed for i in range(15))
    assert rows[40].n_words == 0 and rows[40].base_failed and rows[42].base_failed and rows[43].kept
    assert rows[44].n_dup_lines == 2 and rows[44].n_symbols == 5
    assert quality_rules.score_documents(frame(spark, [])).count() == 0
    clean = {r.doc_id: r.text for r in quality_rules.clean_documents(frame(spark, docs)).collect()}
    assert set(clean) == {i for i, r in rows.items() if r.kept}
    assert clean[0] == docs[0][1].split("\n")[0] and clean[43] == docs[-2][1]


def test_repeated_words():
    def brute(words):
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})

    rnd = random.Random(10)
    for _ in range(300):
        words = [rnd.choice("abc") for _ in range(rnd.randint(0, 15))]
        assert quality_rules.repeated_words(words) == brute(words)


# M-tree


def brute_top(rows, k):
    out = []
    held = lambda x: max(-(2**63) + 1, min(2**63 - 1, x))
    whole = [(u, i, [int(float(np.floor(64 * float(x)))) for x in v]) for u, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for u, i, q in whole:
        if i % 20 == 0:
            scored = sorted(((-held(sum(a * b for a, b in zip(q, w, strict=True))), j, w_u) for w_u, j, w in whole if w_u != u and len(w) == len(q)))
            out += [(i, n + 1, j, -s) for n, (s, j, _) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rnd = np.random.default_rng(11)
    rows = [(i, rnd.normal(size=6).astype(float).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(150)] + [(20, [1.0] * 6), (900, None), (920, []), (940, [1.0, None]), (960, [float("nan")] * 6), (980, [float("inf")] * 6), (None, [9.0] * 6), (1000, [1.0, 2.0]), (1001, [3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, uid int")
    found = mtree.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=200, group_queries=8).collect()
    assert sorted(tuple(r) for r in found) == brute_top(rows, 20)
    assert mtree.top_k(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_tree_prunes_clusters():
    rnd = np.random.default_rng(12)
    centers = rnd.normal(size=(40, 8)) * 400
    points = np.floor(np.repeat(centers, 200, 0) + rnd.normal(size=(8000, 8))).astype(np.int64)
    tree = mtree.Tree({**mtree.build_tree(points), "points": points, "ids": np.arange(8000), "uids": np.arange(8000)})
    queries = points[::400]
    q, row, score = tree.search(queries, 10, np.arange(0, 8000, 400))
    scores = queries @ points.T
    scores[np.arange(len(queries)), np.arange(0, 8000, 400)] = -(1 << 60)
    for i in range(len(queries)):
        best = np.lexsort((np.arange(8000), -scores[i]))[:10]
        assert row[q == i].tolist() == best.tolist() and score[q == i].tolist() == scores[i][best].tolist()
    spent = tree.counts["routing"] + tree.counts["scores"]
    assert spent < 0.3 * len(queries) * len(points)
    assert all(tree.counts[kind] > 0 for kind in ("routing_spared", "unopened", "members_spared")), tree.counts
    assert tree.counts["scores"] + tree.counts["members_spared"] + tree.counts["unopened"] == len(queries) * len(points)


def test_floors_spare_computations_without_loss():
    rnd = np.random.default_rng(17)
    points = np.floor(rnd.normal(size=(3000, 5)) * 100)
    tree = mtree.Tree({**mtree.build_tree(points), "points": points, "ids": np.arange(3000), "uids": np.arange(3000)})
    queries, nobody = np.floor(rnd.normal(size=(40, 5)) * 100), np.full(40, -1)
    q, row, score = tree.search(queries, 5, nobody)
    plain = tree.counts["scores"]
    tree.counts.clear()
    floors = np.array([score[q == i].min() for i in range(40)])
    again = tree.search(queries, 5, nobody, floors)
    assert [x.tolist() for x in again] == [q.tolist(), row.tolist(), score.tolist()] and tree.counts["scores"] < plain


def test_top_k_of_large_components(spark):
    rnd = np.random.default_rng(18)
    big = [1e6, 6e5, -3e9, 2.0**40, -1e15, 3e18, 1e30, 7e150]
    rows = [(i, [float(rnd.choice(big) if rnd.random() < 0.4 else rnd.normal()) for _ in range(3)]) for i in range(0, 400, 5)]
    rows += [(20, [1e6, 6e5, 0.0]), (40, []), (60, []), (61, []), (80, [1e300, 1.0, 1.0]), (100, [1.7e308, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = mtree.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=30, group_queries=5).collect()
    assert sorted(tuple(r) for r in found) == brute_top([r for r in rows if r[0] != 100 or r[1][0] < 1e308], 20)


def test_top_k_of_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(600)] + [(600 + i, [float(i % 7), -1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = mtree.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=100, group_queries=8).collect()
    assert sorted(tuple(r) for r in found) == brute_top(rows, 20)


# Class models, importance resampling, mixing


def labelled_corpus(spark, n=600):
    rnd = random.Random(13)
    docs, labels = [], []
    for i in range(n):
        kind = rnd.choices([0, 1, 2], [0.7, 0.15, 0.15])[0]
        text = prose(rnd, rnd.randint(40, 120))
        if kind == 1:
            text = " ".join(w + "###" for w in text.split())
        if kind == 2:
            text += " vile scum " * 3
        docs.append((i, text, "s"))
        labels.append((i, 0 if kind == 1 else 1, 1 if kind == 2 else 0))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_importance_resampling_held_out(spark):
    docs, labels = labelled_corpus(spark)
    truth = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    shown = labels.where("doc_id % 2 = 0")
    extra = [(1000, None, "s"), (1001, "", "s"), (1002, " \n", "s"), (0, docs[0][1], "s"), (None, docs[0][1], "s"), (1003, "12 34 ...", "s")]
    found = importance.resample(frame(spark, [*docs, *extra]), shown).collect()
    assert len(found) == len(docs) + len(extra)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 2]
    good, bad = [r.log_weight for r in held if truth[r.doc_id]], [r.log_weight for r in held if not truth[r.doc_id]]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.kept for r in held if truth[r.doc_id]]) > 0.97
    poor = {r.doc_id for r in labels.collect() if r.quality == 0}
    assert np.mean([r.kept for r in held if r.doc_id in poor]) < 0.5
    assert not any(r.kept for r in found if r.doc_id in (1000, 1001, 1002))
    same = [r.kept for r in found if r.doc_id == 0]
    assert len(set(same)) == 1
    kept = importance.keep_drawn(frame(spark, [*docs, *extra]), importance.resample(frame(spark, [*docs, *extra]), shown))
    assert kept.count() == sum(r.kept for r in found) and kept.columns == SCHEMA.names


def plain_words(text):
    return re.findall(r"[A-Za-z0-9\x80-\U0010FFFF]+|[^A-Za-z0-9\x80-\U0010FFFF\x20\x09-\x0D]+", text or "")


def test_importance_weights_match_dictionaries(spark):
    rnd = random.Random(30)
    few = lambda: " ".join(rnd.choice(["red", "Red", "green", "blue", "tea"]) for _ in range(40))  # noqa: E731  few n-grams, so that no two share a bucket
    docs = [(i, few() + rnd.choice(["", " ###", " É9 x,y!"]), "s") for i in range(30)] + [(50, None, "s"), (51, "", "s"), (52, "  \n", "s"), (53, "one", "s"), (1, "again " * 2000, "s")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    target = {i for i in range(30) if i % 3 and i % 7}
    counts = [Counter(), Counter()]
    grams = []
    for i, text, _ in docs:
        w = plain_words(text)
        grams.append(w + list(zip(w, w[1:])))
        counts[0].update(grams[-1])
        if i in target:
            counts[1].update(grams[-1])
    raw, own = sum(counts[0].values()), sum(counts[1].values())
    model = {g: (counts[1][g] + importance.PSEUDO) / (n * own / raw + importance.PSEUDO) for g, n in counts[0].items()}
    whole = sum(n * model[g] for g, n in counts[0].items()) / raw
    found = importance.resample(frame(spark, docs), labels, k=10).collect()
    assert sum(r.kept for r in found) == 10
    by_text = {(r.doc_id, r.n_words): r.log_weight for r in found}
    for (i, text, _), g in zip(docs, grams, strict=True):
        want = sum(np.log(model[x] / whole) for x in g) if g else -np.inf
        assert by_text[i, len(plain_words(text))] == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_importance_hashes_equal_words_alike():
    for text in ("a,b  c!! c!!a É-é 12x", "x" * 5000 + " y", "...", " \t a"):
        words = plain_words(text)
        hashes = importance.word_hashes(text.encode()).tolist()
        assert len(hashes) == len(words) and len(set(hashes)) == len(set(words))
    n, buckets = importance.occurrences("w " * 1_500_000)
    assert n == 1_500_000 and len(set(buckets.tolist())) == 2 and len(buckets) == 2 * n - 1


def test_gumbel_draw_follows_the_weights(spark):
    weights = [0.0, 0.5, 1.0, 2.0, -1.0, float("-inf")]
    docs = spark.createDataFrame([(i, 7 * i, w) for i, w in enumerate(weights)], "doc_id long, th long, log_weight double")
    seeds = spark.range(20_000).withColumnRenamed("id", "seed")
    keys = docs.crossJoin(seeds).select("seed", "doc_id", importance.gumbel_key(F.col("seed")).alias("key"))
    tops = keys.groupBy("seed").agg(F.slice(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("key", "doc_id")))), lambda x: x["doc_id"]), 1, 2).alias("top"))
    rows = [r.top for r in tops.collect()]
    p = np.exp(weights) / np.exp(weights).sum()
    for i in range(len(weights)):
        assert abs(np.mean([r[0] == i for r in rows]) - p[i]) < 0.015
        second = p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(len(weights)) if j != i)  # drawn without replacement
        assert abs(np.mean([i in r for r in rows]) - second) < 0.015


def test_importance_draw_is_not_a_cut(spark):
    rnd = random.Random(31)
    docs = [(i, rnd.choice(["one two", "two three", "three one", "four four"]), "s") for i in range(400)]
    labels = spark.createDataFrame([(i, int("one" in docs[i][1]), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    found = importance.resample(frame(spark, docs), labels, share=0.5).collect()
    kept = {r.doc_id for r in found if r.kept}
    cut = {r.doc_id for r in sorted(found, key=lambda r: (-r.log_weight, r.doc_id))[:200]}
    other = {r.doc_id for r in importance.resample(frame(spark, docs), labels, share=0.5, seed=1).collect() if r.kept}
    assert len(kept) == len(other) == 200 and kept != other and 20 < len(kept ^ cut)


def test_gumbel_top_k_takes_the_largest_keys(spark):
    docs, labels = labelled_corpus(spark)
    found = importance.resample(frame(spark, docs), labels).collect()
    kept, rest = [r.sample_key for r in found if r.kept], [r.sample_key for r in found if not r.kept]
    assert min(kept) >= max(rest)


def test_importance_temperature_on_the_test_tables(spark):
    """On whole texts the plain weights leave nothing to chance; a temperature does."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    drawn = lambda **more: {r.doc_id: r for r in importance.resample(docs, labels, share=0.5, **more).collect()}
    plain = drawn()
    kept = lambda rows: {i for i, r in rows.items() if r.kept}
    logs = np.array([r.log_weight for r in plain.values() if r.n_words])
    sizes = {r.temperature: r for r in importance.effective_sizes(importance.resample(docs, labels, share=0.5)).collect()}
    for t, r in sizes.items():
        w = np.exp((logs - logs.max()) / t)
        assert r.documents == len(logs) and r.effective == pytest.approx(w.sum() ** 2 / (w * w).sum(), rel=1e-9)
    assert sizes[1.0].effective < 0.1 * len(logs) < sizes[max(sizes)].effective
    warm = next(t for t in sorted(sizes) if sizes[t].effective >= 0.3 * len(logs))
    cut = {r.doc_id for r in sorted((r for r in plain.values() if r.n_words), key=lambda r: -r.log_weight)[: len(kept(plain))]}
    one, two = drawn(temperature=warm), drawn(temperature=warm, seed=7)
    assert len(kept(one)) == len(kept(two)) == len(kept(plain))
    assert len(kept(one) - cut) >= 5 and len(kept(one) ^ kept(two)) >= 5
    mean = lambda rows, want: np.mean([r.log_weight for r in rows.values() if r.n_words and r.kept == want])
    assert mean(one, True) > mean(one, False)
    for wrong in (0.0, -1.0, math.inf, math.nan):
        with pytest.raises(ValueError, match="temperature"):
            importance.resample(docs, labels, temperature=wrong)
    none = importance.effective_sizes(importance.resample(docs.where("false"), labels), (1.0,)).first()
    assert (none.documents, none.effective) == (0, None)


def test_importance_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.resample(frame(spark, []), empty).count() == 0
    assert [r.kept for r in importance.resample(frame(spark, [(1, "some words", "s")]), empty).collect()] == [True]
    odd = spark.createDataFrame([(None, 1, 0), (1, None, None), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert importance.resample(frame(spark, [(1, "some words", "s")]), odd).count() == 1


def test_kth_largest(spark):
    rnd = random.Random(14)
    values = [rnd.choice([rnd.gauss(0, 1), 0.25, 1e6]) for _ in range(9000)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 77, 4500, 9000):
        assert importance.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_mixing_meets_reachable_targets(spark):
    docs, labels = labelled_corpus(spark)
    targets = {"clean": 0.8, "low": 0.1, "toxic": 0.1}
    rows = mixing.mix(frame(spark, docs), labels.where("doc_id % 2 = 0"), targets).collect()
    total = sum(r.tokens for r in rows)
    for d, share in targets.items():
        assert abs(sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows) / total - share) < 0.01
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    assert abs(sum(r.copies * r.tokens for r in rows) / total - 1) < 0.1
    truth = {r.doc_id: 2 if r.toxic else 0 if r.quality else 1 for r in labels.collect()}
    best = [int(np.argmax([r.p_clean, r.p_low, r.p_toxic])) == truth[r.doc_id] for r in rows if r.doc_id % 2]
    assert np.mean(best) > 0.9


def test_rates_match_a_dense_solver(spark):
    rnd = np.random.default_rng(15)
    p = rnd.dirichlet([0.4, 0.4, 0.4], 300)
    tokens = rnd.integers(5, 200, 300)
    members = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p, strict=True)], "tokens long, p0 double, p1 double, p2 double")
    shares = [0.5, 0.3, 0.2]
    fit = mixing.fit_rates(members, shares)
    steps = fit.steps
    assert fit.reason in ("matched", "bounds")
    rates = np.array([r[0] for r in members.select(mixing.rate_column(steps, mixing.MOST_RATE, 3)).collect()])
    goal = np.array(shares) * tokens.sum()
    reached = np.abs((tokens * rates) @ p - goal).max() / tokens.sum()
    assert fit.error == pytest.approx(reached, abs=1e-9)
    dense = np.ones(300)
    for _ in range(20_000):  # plain projected gradient on all rates
        dense = np.clip(dense - 1e-6 * (tokens[:, None] * p) @ ((tokens * dense) @ p - goal), 0, mixing.MOST_RATE)
    assert reached <= np.abs((tokens * dense) @ p - goal).max() / tokens.sum() + 1e-3


def test_mixing_says_what_it_misses(spark):
    members = spark.createDataFrame([(100, 0.9, 0.1), (100, 0.8, 0.2)], "tokens long, p0 double, p1 double")
    fit = mixing.fit_rates(members, [0.0, 1.0], most=1.0)
    assert fit.reason == "bounds" and fit.error > 0.5 and len(fit.reached) == 2
    assert mixing.fit_rates(members, [0.9, 0.1], most=None).reason in ("matched", "bounds")
    docs, labels = labelled_corpus(spark, 120)
    with pytest.warns(UserWarning, match="missed"):
        mixing.mix(frame(spark, docs), labels, {"clean": 0.0, "low": 0.0, "toxic": 1.0}, most_rate=1.0)


def test_mixing_repeats_the_first_domain(spark):
    docs, labels = labelled_corpus(spark)
    before = mixing.mix(frame(spark, docs), labels)
    held = before.agg(F.sum(F.col("tokens") * F.col("p_clean"))).first()[0]
    rows = mixing.mix(frame(spark, docs), labels, {"clean": 0.9, "low": 0.05, "toxic": 0.05}, 2.0, first_scale=1.2).collect()
    for d, share in (("clean", 0.9), ("low", 0.05), ("toxic", 0.05)):
        assert abs(sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows) - 1.2 * held * share / 0.9) < 0.02 * held
    good = {r.doc_id for r in labels.collect() if r.quality and not r.toxic}
    assert np.mean([r.copies >= 1 for r in rows if r.doc_id in good]) > 0.99


def test_mixing_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(frame(spark, []), empty).count() == 0
    docs = frame(spark, [(1, None, "s"), (1, None, "s"), (None, "a b", None), (2, "", "s")])
    assert mixing.mix(docs, empty).count() == 4
    once = mixing.mix(docs, empty, most_rate=1.0, first_scale=1.0)
    out = mixing.emit_copies(docs, once)
    assert out.columns == SCHEMA.names and out.count() <= 4


def test_rows_without_an_id_are_drawn_apart(spark):
    """Copies of rows with null ids follow their rates, as those of rows with ids do."""
    r = random.Random(4)
    good, bad = [f"w{k}" for k in range(60)], [f"v{k}" for k in range(60)]
    texts = [" ".join(r.choice(bad if k % 3 == 0 else good) for _ in range(30)) for k in range(900)]
    docs = spark.createDataFrame([(k if k % 2 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0 if k % 3 == 0 else 1, 0) for k in range(1, 400, 2)], "doc_id long, quality int, toxic int")
    rated = mixing.mix(docs, labels, {"clean": 0.5, "low": 0.5}, most_rate=4.0).where("doc_id is null").collect()
    assert len(rated) == 450
    expected, copies = sum(x.rate for x in rated), sum(x.copies for x in rated)
    spread = sum((x.rate % 1) * (1 - x.rate % 1) for x in rated) ** 0.5
    assert spread > 3 and abs(copies - expected) < 3 * spread + 1


def test_posteriors_equal_a_plain_computation(spark):
    """Scores are sums over a text's words of smoothed log ratios; posteriors are their calibrated softmax."""
    temperature, offsets = 0.4, [0.3, -0.1, -0.2]
    scored = spark.createDataFrame([(1.0, -2.0, 0.5), (100.0, 0.0, -100.0), (0.0, 0.0, 0.0)], "s0 double, s1 double, s2 double")
    for row, s in zip(scored.select(*mixing.posterior_columns(temperature, offsets)).collect(), scored.collect(), strict=True):
        x = [o + temperature * max(-60.0, min(60.0, v)) for o, v in zip(offsets, s, strict=True)]
        whole = sum(math.exp(v) for v in x)
        assert list(row) == pytest.approx([math.exp(v) / whole for v in x])


def test_word_hashes():
    words = re.findall(rb"[a-z\x80-\xff]+|[#$%&*|<>!]", "Ab  ab#AB!! x9y é-é".encode().lower())
    hashes, symbols = ngrams.word_hashes("Ab  ab#AB!! x9y é-é".encode())
    assert len(hashes) == len(words) and symbols.tolist() == [len(w) == 1 and w in b"#!" for w in words]
    assert len(set(hashes.tolist())) == len(set(words))
    assert ngrams.present(None)[0] == 0 and ngrams.present("...")[0] == 0
    assert ngrams.present("a" * 3_000_000)[0] == 1


def test_very_long_texts(spark):
    rnd = random.Random(21)
    long = "\n".join(f"line {k} {prose(rnd, 10)}" for k in range(20_000))
    docs = [(1, long, "s"), (2, long + "\na tail of its own", "s"), (3, "x" * 1_000_000, "s"), (4, prose(rnd, 80), "s")]
    df = frame(spark, docs)
    lines = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert [(lines[i].n_lines, lines[i].n_deleted) for i in (1, 2, 3, 4)] == [(20_000, 0), (20_001, 20_000), (1, 0), (1, 0)]
    assert lines[1].text == long and lines[2].text == "a tail of its own" and lines[3].text == docs[2][1]
    found = {r.doc_id: r for r in quality_rules.score_documents(df).collect()}
    assert all(found[i].n_words == len(t.split()) and found[i].word_chars == len("".join(t.split())) for i, t, _ in docs)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in importance.resample(df, labels).collect()) == [1, 2, 3, 4]
    rated = mixing.mix(df, labels).collect()
    assert sorted(r.doc_id for r in rated) == [1, 2, 3, 4] and all(np.isfinite(r.rate) and r.rate >= 0 for r in rated)


# Columns that are called like helpers

CLASHES = ["id", "th", "_id", "_th", "drop", "drop_id", "drop_th", "_drop", "_drop_id", "_drop_th", "kept", "_kept", "copies", "_copies", "mixed", "_mixed", "rejected", "_rejected", "n_lines", "n_deleted", "lines", "words", "fp", "root", "a.b", "col"]


def test_columns_called_like_helpers(spark):
    docs, labels = labelled_corpus(spark, 60)
    docs += [(100 + i, docs[0][1], "s") for i in range(3)] + [(200, None, None), (201, "", "s")]
    df = frame(spark, docs).drop("lines").select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    full = lambda out: {tuple(r[c] for c in CLASHES if c in out.columns) for r in out.collect()}
    every = {tuple(range(len(CLASHES)))}
    kept = importance.keep_drawn(df, importance.resample(df, labels))
    assert kept.columns == df.columns and full(kept) == every
    once = simhash.keep_first(df, simhash.near_duplicates(df))
    assert once.columns == df.columns and full(once) == every and once.count() == 61  # null and empty texts link
    mixed = mixing.emit_copies(df, mixing.mix(df, labels, {"clean": 0.99, "low": 0.005, "toxic": 0.005}))
    assert mixed.columns == df.columns and full(mixed) == every
    clean = quality_rules.clean_documents(df)
    assert clean.columns == df.columns and full(clean) == every
    lines = line_dedup.dedup_lines(df)
    assert sorted(lines.columns) == sorted(df.columns) and lines.count() == len(docs)
    named = line_dedup.dedup_lines(df, lines_col="all_lines", deleted_col="gone_lines")
    assert named.columns == [*df.columns, "all_lines", "gone_lines"] and full(named) == every
