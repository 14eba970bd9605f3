"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

One edit leaves a half of a word intact.  Words are grouped by the length ``m`` of the shorter word of a pair, so a
word stands in the groups of its own length and of one less.  In each group a dictionary sorted by first halves and
one sorted by reversed last halves are scanned: a block is a range of words that share the half.  A block says
where its pairs differ, somewhere in positions ``[i, j)``, and everything around is shared.  A skewed block is subdivided
by halving ``[i, j)``: one half is intact again, so words that share more of the front or more of the back
form the blocks below, down to blocks of words that agree on all but one position.  Blocks over ``split_rows`` words are
subdivided in Spark, smaller ones in the task that scans them, and the few words left in a block are compared.

A pair counts in the one block that its first difference falls in, so scanning tasks add up neighbours and keep the
best one for each word; no pair is stored.  Corpus words are counted inside tasks before they are shuffled.

Null texts have no words; a null id counts as an empty string in the deletion rule; repeated rows count as often, extra columns are ignored, ties
go to the first word in code-point order, and an empty table gives an empty result.  Words have any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, join_checked, materialize, release

RUN = "[a-zÀ-ÿ]"
LEAST_CHARS, LEAST_TIMES, FACTOR = 7, 2, 10
DELETE_EVERY = 31
SPLIT_ROWS = 4096
FEW = 6  # words of a block that are compared with each other
HELD = 200_000  # entries of a task's partial results
KEY = ["m", "i", "j", "head", "tail"]


def distort(doc_id: int | None, run: str) -> str:
    """The run as it is counted: one in ``DELETE_EVERY`` loses a code point, by a checksum of id and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DELETE_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words of enough code points and occurrences; only A-Z are lower-cased."""
    bound_batches(docs.sparkSession)
    runs = re.compile(f"{RUN}{{{least_chars},}}")

    def run(batches):
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lowered = (text.as_py() or "").encode().lower().decode()  # of bytes: ASCII letters only
                for found, n in Counter(runs.findall(lowered)).items():
                    word = distort(doc_id, found)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) >= HELD:
                    yield _counted(held)
                    held.clear()
        yield _counted(held)
        release()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    partial = rows.mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _entries(words: DataFrame, ranges: Column) -> DataFrame:
    """A row of each word for each of its ranges ``(m, i, j)``, with the shared front and the reversed shared back."""
    placed = words.select("word", "n", F.inline(ranges))
    tail = F.reverse(F.expr("right(word, m - j)"))
    return placed.select("m", "i", "j", F.expr("left(word, i)").alias("head"), tail.alias("tail"), "word", "n")


def _range(m, i, j) -> Column:
    return F.struct(m.cast("int").alias("m"), i.cast("int").alias("i"), j.cast("int").alias("j"))


def dictionaries(words: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Entries of the forward dictionary (the front half is shared) and of the reversed one (the back half is)."""
    size = F.length("word")
    halves = [f(m) for m in (size, size - 1) for f in (lambda m: _range(m, F.floor(m / 2), m), lambda m: _range(m, F.lit(0), F.floor(m / 2)))]
    return _entries(words, F.filter(F.array(*halves), lambda r: r["m"] >= least_chars))


def subdivide(entries: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Entries with all blocks over ``split_rows`` words cut, as long as there is more than one position to cut at."""
    done, current = [], entries
    while True:
        sizes = current.groupBy(*KEY).agg(F.count("*").alias("n")).where((F.col("n") > split_rows) & (F.col("j") - F.col("i") > 1))
        large = materialize(sizes.select(*KEY), "large-blocks")
        if large.isEmpty():
            done.append(current)
            break
        done.append(join_checked(current, large, KEY, "left_anti"))
        cut = F.floor((F.col("i") + F.col("j")) / 2)
        both = F.array(_range(F.col("m"), F.col("i"), cut), _range(F.col("m"), cut, F.col("j")))
        inner = join_checked(current, large, KEY, "left_semi").select("word", "n", both.alias("both"))
        current = materialize(_entries(inner, F.col("both")), "blocks")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


class _Near:
    """Neighbours and the best of them for each word of a task."""

    def __init__(self):
        self.found: dict[str, list] = {}

    def add(self, word: str, other: str, n: int) -> None:
        held = self.found.get(word)
        if held is None:
            self.found[word] = [1, n, other]
            return
        held[0] += 1
        if n > held[1] or (n == held[1] and other < held[2]):
            held[1:] = n, other

    def scan(self, m: int, i: int, j: int, words: list[tuple[str, int]]) -> None:
        """Pairs of a block whose first difference lies in ``[i, j)``, or after ``m`` shared characters if ``j`` is ``m``."""
        short = [w for w in words if len(w[0]) == m]
        if not short or len(words) < 2:
            return
        if len(words) > FEW and j - i > 1:
            cut = (i + j) // 2
            back, front = {}, {}
            for w in words:
                back.setdefault(w[0][len(w[0]) - m + cut :], []).append(w)
                front.setdefault(w[0][:cut], []).append(w)
            for blocks, a, b in ((back, i, cut), (front, cut, j)):
                for inside in blocks.values():
                    if len(inside) > 1:
                        self.scan(m, a, b, inside)
            return
        long = [w for w in words if len(w[0]) > m]
        for k, (u, n) in enumerate(short):
            for others, skip in ((short[k + 1 :], 1), (long, 0)):
                for v, n_v in others:
                    at = i
                    while at < j and u[at] == v[at]:
                        at += 1
                    if (at < j or j == m) and u[at + skip :] == v[at + 1 :]:
                        self.add(u, v, n_v)
                        self.add(v, u, n)

    def rows(self) -> pa.RecordBatch:
        got, self.found = self.found, {}
        near, n, best = zip(*got.values(), strict=True) if got else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(got), pa.string()), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())], names=["word", "n_near", "best_n", "best"]
        )


def _scan(batches):
    near, key, block = _Near(), None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:5] != key:
                if len(block) > 1:
                    near.scan(*key[:3], block)
                    if len(near.found) >= HELD:
                        yield near.rows()
                key, block = row[:5], []
            block.append(row[5:])
    if len(block) > 1:
        near.scan(*key[:3], block)
    yield near.rows()
    release()


def neighbours(words: DataFrame, least_chars: int = LEAST_CHARS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``word, n_near, best, best_n`` of every word of ``word, n`` that has a near one."""
    entries = subdivide(dictionaries(words, least_chars), split_rows)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = entries.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY, "word")
    found = ranged.mapInArrow(_scan, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return merged.select("word", "n_near", F.col("first.word").alias("best"), (-F.col("first.n")).alias("best_n"))


def roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``word, root`` for a table ``word, form`` without cycles: pointers are doubled until all are at their end."""
    current = materialize(forms.select("word", F.col("form").alias("root")), "pointers")
    for _ in range(most_rounds):
        ahead = current.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        moved = join_checked(current, ahead, F.col("root") == F.col("via"), "left")
        following = materialize(moved.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "pointers")
        current = following.select("word", "root")
        if following.where("moved").isEmpty():
            return current
    raise RuntimeError(f"chains of forms did not end in {most_rounds} rounds")


def spelling_variants(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, factor: int = FACTOR, split_rows: int = SPLIT_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the corpus.  Forms have at least ``factor`` times the
    occurrences, so chains of forms are short and have no cycles (``factor`` must be over one)."""
    if factor < 2:
        raise ValueError("a form must have at least twice the occurrences")
    words = materialize(word_counts(docs, least_chars, least_times, id_col, text_col), "words")
    near = neighbours(words, least_chars, split_rows)
    known = words.join(near, "word", "left")
    is_form = F.col("best_n") >= factor * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    known = materialize(known, "forms")
    ends = roots(known.where("form is not null"))
    out = known.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")
