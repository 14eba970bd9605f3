"""Alignment of two tokenizers, a byte-level one (A) and a merge-type one with byte pieces (B).

DuckDB aligns tokens inside Arrow partitions.  Each task cuts its texts into segments that no token of
either tokenizer crosses and that are encoded alike wherever they stand (before runs of white space that
begin with a space or a line feed), so a segment that occurs often in a block of texts is aligned once.
Segments are laid end to end on one axis of bytes.  Token intervals are two tables there: ASOF joins find for each A
token the B tokens that hold its first and its last byte, a range join gives all overlaps between, and
window sums over the common ends number the tokens of the groups.  A task's tables are bounded by a block of
``block_bytes`` of text (one longer text makes a block of its own), DuckDB's by ``CHUNK_SEGMENTS``.

What a block has counted by id pair is merged in Spark: blocks send one row for each pair, the sums come
back to the blocks that have the pair, and so no table of all pairs is gathered or broadcast and a pair that
is in all texts is one row a block.  Blocks keep their documents as counts of segments, so texts are read once.

Null and empty texts, and texts that one of the tokenizers does not give back byte by byte (those that hold U+2581),
have no tokens: zeros and an empty digest.  Special strings are plain text.  Repeated rows give repeated results, and
count as often; null ids stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, join_checked, materialize, release

MARK = "▁"
BLOCK_BYTES = 16 << 20
CHUNK_SEGMENTS, CHUNK_CHARS = 40_000, 2 << 20
#: White space up to the next word belongs to that word, unless it begins with neither space nor line feed.
SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")

STAGE = (
    "block string, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, segments binary, times binary, "
    "starts binary, pairs binary, a array<int>, b array<int>, n array<long>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_values() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 characters stand for
    themselves, the other bytes for the characters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both tokenizers with the bytes of their tokens, and the alignment of distinct segments."""

    def __init__(self, byte_level: bytes, merge_type: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(byte_level)
        first = spec.get("pre_tokenizer") or {}
        if first.get("type") != "ByteLevel" or not first.get("use_regex") or first.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("the first tokenizer must be byte-level with the usual word pattern, without normalizer")
        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        value = _byte_values()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, k in spec["model"]["vocab"].items():
            self.a_bytes[k] = bytes(map(value.__getitem__, token)) if set(token) <= value.keys() else token.encode()
        self.b = b = sentencepiece.SentencePieceProcessor(model_proto=merge_type)
        pieces = [b.id_to_piece(k) for k in range(b.get_piece_size())]
        crossing = any(MARK in p.lstrip(MARK) or "\n" in p[1:] for k, p in enumerate(pieces) if not (b.is_control(k) or b.is_unknown(k) or b.is_byte(k)))
        if b.encode("\n", out_type=str)[0] != MARK or b.normalize("  a b ") != f"{MARK * 3}a{MARK}b{MARK}" or crossing or sum(map(b.is_byte, range(len(pieces)))) != 256:
            raise ValueError("the second tokenizer must add one space, keep all, have all bytes and no piece across a space")
        self.mark = b.piece_to_id(MARK)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else b"" if b.is_control(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [f"{k}{sign}" for sign in (",", "|", ";", "") for k in range(self.width)]

    def encode_a(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(segments), 2000) for e in self.a.encode_batch_fast(segments[at : at + 2000], add_special_tokens=False)]

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """The library puts a space in front: it is the segment's own, or is taken away again."""
        spaced = [s[0] == " " for s in segments]
        found = self.b.encode([s[1:] if own else s for s, own in zip(segments, spaced, strict=True)], num_threads=1)
        return [ids if own else ids[1:] for ids, own in zip(([self.mark] if s == " " else f for s, f in zip(segments, found, strict=True)), spaced, strict=True)]

    def _sound(self, segments: list[str], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether both tokenizers give a segment back; all at once, and one by one only if some don't."""
        raw = [s.encode() for s in segments]
        tables = ((self.a_bytes, a), (self.b_bytes, b))
        if all(b"".join([table[i] for i in itertools.chain.from_iterable(ids)]) == b"".join(raw) for table, ids in tables):
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            ends = [np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) for _, ids in tables]
            totals = [np.concatenate([[0], np.cumsum(size[np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(e[-1]))])])[e] for (_, ids), size, e in zip(tables, (self.a_size, self.b_size), ends, strict=True)]
            if all((t == np.cumsum(sizes)).all() for t in totals):
                return np.ones(len(segments), bool)
        return np.array([all(b"".join([table[i] for i in ids[k]]) == raw[k] for table, ids in tables) for k in range(len(segments))], bool)

    def align(self, segments: list[str]) -> _Aligned:
        """Counts, group strings and links of distinct segments."""
        a, b = self.encode_a(segments), self.encode_b(segments)
        sound = self._sound(segments, a, b)
        for k in np.nonzero(~sound)[0].tolist():
            a[k] = b[k] = ()
        out = _Aligned(sound, *(np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)))
        ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a, out.n_a), (b, out.n_b)))
        cuts, links = _overlaps(_intervals(ids_a, self.a_size, out.n_a), _intervals(ids_b, self.b_size, out.n_b))
        out.link_segments, out.links = links["segment"].to_numpy(), links["a"].to_numpy() << 32 | links["b"].to_numpy()
        a_to, b_to = cuts["a_to"].to_numpy(), cuts["b_to"].to_numpy()
        out.n_groups = np.bincount(np.searchsorted(np.cumsum(out.n_a), a_to, "left"), minlength=len(segments)).astype(np.int64)
        # Tokens in the order of groups, A's before B's, each written with what follows it.
        sign_a, sign_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        sign_a[a_to - 1], sign_b[b_to - 1] = 1, 2
        sign_b[np.cumsum(out.n_b)[out.n_b > 0] - 1] = 3
        group_a, group_b = (np.searchsorted(to, np.arange(len(ids)), "right") for to, ids in ((a_to, ids_a), (b_to, ids_b)))
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written = np.concatenate([ids_a + self.width * sign_a, ids_b + self.width * sign_b])[order].tolist()
        words, at = [self.written[k] for k in written], 0
        for to in np.cumsum(out.n_a + out.n_b).tolist():
            out.groups.append("".join(words[at:to]).encode())
            at = to
        return out


class _Aligned:
    """Results by segment; links as ``a << 32 | b`` with the segment of each, segments ascending."""

    def __init__(self, sound: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.sound, self.n_a, self.n_b = sound, n_a, n_b
        self.n_groups = np.zeros(len(sound), np.int64)
        self.groups: list[bytes] = []
        self.link_segments = self.links = np.zeros(0, np.int64)

    @classmethod
    def joined(cls, parts: list[_Aligned]) -> _Aligned:
        out = cls(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("sound", "n_a", "n_b")))
        shifts = np.cumsum([0, *(len(p.sound) for p in parts)])
        out.n_groups, out.links = (np.concatenate([getattr(p, k) for p in parts]) for k in ("n_groups", "links"))
        out.link_segments = np.concatenate([p.link_segments + s for p, s in zip(parts, shifts[:-1], strict=True)])
        out.groups = [g for p in parts for g in p.groups]
        return out


def _intervals(ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Tokens with their segment and their bytes ``[s, e)`` on the axis."""
    size = sizes[ids]
    e = np.cumsum(size)
    return pa.table({"pos": np.arange(len(ids)), "segment": np.repeat(np.arange(len(counts)), counts), "id": ids, "s": e - size, "e": e})


def _overlaps(a: pa.Table, b: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Common ends with the numbers of tokens up to them, and all overlapping pairs, both in order."""
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""}) as db:
        db.register("a_given", a)
        db.register("b_given", b)
        db.execute("CREATE TABLE a AS FROM a_given")
        db.execute("CREATE TABLE b AS FROM b_given")
        db.execute(
            "CREATE TABLE reach AS SELECT f.*, b.pos AS last_b FROM "
            "(SELECT a.*, b.pos AS first_b FROM a ASOF JOIN b ON a.s >= b.s) f ASOF JOIN b ON f.e > b.s"
        )
        links = db.sql("SELECT r.segment, r.id AS a, b.id AS b FROM reach r JOIN b ON b.pos BETWEEN r.first_b AND r.last_b ORDER BY r.pos, b.pos").to_arrow_table()
        cuts = db.sql(
            "SELECT e, sum(x) OVER w AS a_to, sum(y) OVER w AS b_to FROM (SELECT e, max(x) AS x, max(y) AS y FROM "
            "(SELECT e, 1 AS x, 0 AS y FROM a UNION ALL SELECT e, 0, 1 FROM b) GROUP BY e) WINDOW w AS (ORDER BY e) QUALIFY x = 1 AND y = 1 ORDER BY e"
        ).to_arrow_table()
    cuts = cuts.set_column(1, "a_to", cuts["a_to"].cast(pa.int64())).set_column(2, "b_to", cuts["b_to"].cast(pa.int64()))
    return cuts.combine_chunks(), links.combine_chunks()


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(byte_level: bytes, merge_type: bytes) -> Aligner:
    key = hashlib.sha256(byte_level + merge_type).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(byte_level, merge_type)
    return _ALIGNERS[key]


def _chunks(segments: list[str]) -> Iterator[list[str]]:
    at = chars = 0
    for k, s in enumerate(segments):
        if k > at and (k - at >= CHUNK_SEGMENTS or chars + len(s) > CHUNK_CHARS):
            yield segments[at:k]
            at, chars = k, 0
        chars += len(s)
    if at < len(segments):
        yield segments[at:]


class _Block:
    """Texts as lists of numbers of distinct segments."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        known = self.known
        found = SEGMENT.findall(" " + text) if text else ()
        self.docs.append((doc_id, np.array([known.setdefault(s, len(known)) for s in found], np.int32)))
        self.size += len(text or "")

    def rows(self, aligner: Aligner) -> pa.RecordBatch:
        segments = list(self.known)
        self.known = {}
        done = [aligner.align(c) for c in _chunks(segments)]
        del segments
        s = _Aligned.joined(done) if done else _Aligned(*(np.zeros(0, t) for t in (bool, np.int64, np.int64)))
        del done
        n_links = np.bincount(s.link_segments, minlength=len(s.sound)).astype(np.int64)
        occurrences = np.zeros(len(s.sound), np.int64)
        name, out = uuid.uuid4().hex, {k: [] for k in (c.split()[0] for c in STAGE.split(", "))}
        for doc_id, of in self.docs:
            if not s.sound[of].all():
                of = of[:0]
            listed = of.tolist()
            distinct, times = np.unique(of, return_counts=True)
            occurrences[distinct] += times
            digest = hashlib.sha256(b";".join([s.groups[k] for k in listed])).hexdigest() if listed else ""
            totals = [int(x[distinct] @ times) for x in (s.n_a, s.n_b, s.n_groups, n_links)]
            self._put(out, [name, 0, doc_id, *totals, digest, distinct.astype("<u4").tobytes(), times.astype("<u4").tobytes(), *[None] * 5])
        pairs, places = np.unique(s.links, return_inverse=True)
        counts = np.bincount(places, weights=occurrences[s.link_segments], minlength=len(pairs)).astype(np.int64)  # whole numbers far below 2**53
        starts = np.concatenate([[0], np.cumsum(n_links)]).astype("<u4").tobytes()
        self._put(out, [name, 1, *[None] * 8, starts, places.astype("<u4").tobytes(), (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), counts])
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), _TYPES, strict=True)], names=list(out))

    @staticmethod
    def _put(out: dict[str, list], row: list) -> None:
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
_TYPES = [_ARROW[c.split()[1]] for c in STAGE.split(", ")]


def _count(rows: pa.Table, sums: pa.Table) -> pa.Table:
    """A block's documents with the corpus-wide counts of their links."""
    kind = rows["kind"].to_numpy()
    whole = rows.filter(pa.array(kind == 1))
    order = np.argsort(sums["pos"].to_numpy())
    counts, best = sums["count"].to_numpy()[order].astype(np.int64), sums["best"].to_numpy()[order].astype(np.int64)
    starts, places = (np.frombuffer(whole[c][0].as_py(), "<u4") for c in ("starts", "pairs"))
    before = [np.concatenate([[0], np.cumsum(x[places])]) for x in (counts, best)]
    per_segment = [x[starts[1:]] - x[starts[:-1]] for x in before]
    docs = rows.filter(pa.array(kind == 0))
    found = [[], []]
    for of, times in zip(docs["segments"], docs["times"], strict=True):
        k, t = np.frombuffer(of.as_buffer(), "<u4"), np.frombuffer(times.as_buffer(), "<u4").astype(np.int64)
        for x, values in zip(found, per_segment, strict=True):
            x.append(int(values[k] @ t))
    return pa.table(
        [*[docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], pa.array(found[1], pa.int64()), pa.array(found[0], pa.int64()), docs["groups_sha256"]],
        names=[c.split()[0] for c in RESULT.split(", ")],
    )


def align_blocks(docs: DataFrame, byte_level_path: str, merge_type_path: str, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and one for each block (``kind`` 1) with its links and pair counts."""
    spark = docs.sparkSession
    files = []
    for path in (byte_level_path, merge_type_path):  # fixed files of the installation, under two megabytes
        with open(path, "rb") as file:
            files.append(file.read())
    shared = spark.sparkContext.broadcast(tuple(files))
    bound_batches(spark)

    def run(batches):
        aligner, block = _aligner(*shared.value), _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(doc_id, text.as_py())
                if block.size >= block_bytes:
                    yield block.rows(aligner)
                    block = _Block()
        if block.docs:
            yield block.rows(aligner)
        release()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, STAGE)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``a, b, count`` of all id pairs that are linked anywhere, and whether no pair of ``b`` has more."""
    partial = blocks.where("kind = 1").select(F.inline(F.arrays_zip("a", "b", "n")))
    totals = materialize(partial.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    most = totals.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of a vocabulary
    return totals.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, byte_level_path: str, merge_type_path: str, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    blocks = materialize(align_blocks(docs, byte_level_path, merge_type_path, block_bytes, id_col, text_col), "alignment")
    known = materialize(pair_counts(blocks), "pairs")
    mine = blocks.where("kind = 1").select(F.col("block").alias("at"), F.posexplode(F.arrays_zip("a", "b"))).select("at", "pos", "col.a", "col.b")
    sums = join_checked(mine, known, ["a", "b"]).select("at", "pos", "count", "best")
    own = blocks.select("block", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "segments", "times", "starts", "pairs")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        return _count(left, right)

    return own.groupBy("block").cogroup(sums.groupBy("at")).applyInArrow(count, RESULT)
