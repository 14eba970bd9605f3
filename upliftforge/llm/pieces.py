"""SentencePiece (merge type) encoding and decoding with a prefix table.

Encoding relies on a locality property of greedy merging: a token sequence is the encoding of its
text exactly if every pair of neighbours is the encoding of that pair's text.  So every prefix of
a text has one last token.  The table stores it for each prefix, left to right: an Aho-Corasick
automaton proposes the pieces that end there, and the piece that is compatible with the last token
of the prefix before it is the one.  The ids are then read from the table backwards.  This takes
time linear in the text, whatever its length.

Two characters that stand side by side in no piece are never in one token.  So texts are cut before
space marks, around control characters, and between a letter or digit and a punctuation mark, as far
as the pieces allow it, and the parts are encoded once and kept in a bounded memo per worker.

Row-wise (one map stage, no shuffle).  A null text counts as empty, whose ids are begin and end
alone.  Repeated rows give repeated results, extra columns are ignored, an empty table gives an
empty result.  The special strings of the model (such as ``<s>``) inside a text are ordinary text.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import string
from array import array
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, release

MARK = "▁"  # stands for a space inside pieces
REPLACEMENT = "�".encode()
PAIR_SLOTS = 1 << 21  # sixteen megabytes
MEMO_ENTRIES = 250_000


class PrefixTableCodec:
    """Encoder and decoder for a merge-type model given as the bytes of its file."""

    def __init__(self, model: bytes, memo_entries: int = MEMO_ENTRIES, memo_chars: int = 48):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if sp.normalize("  a b ") != f"{MARK * 3}a{MARK}b{MARK}" or sp.normalize("") != "":
            raise ValueError("only models that keep all characters and add one space in front are supported")
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        byte_of = {i: int(sp.id_to_piece(i)[3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in byte_of.items()}
        if len(self.byte_id) != 256:  # otherwise the library merges runs of unknown characters
            raise ValueError("only models with a piece for every byte are supported")
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        ids = [i for i in range(n) if i not in special and i not in byte_of]
        self.id = {self.piece[i]: i for i in ids}
        self.score = {self.piece[i]: sp.get_score(i) for i in ids}
        self.chars = {p for p in self.id if len(p) == 1}
        if any(c not in self.chars for p in self.id for c in p):
            raise ValueError("a piece holds a character that is no piece itself")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.alone: dict[int, bool] = {}  # does a piece's own text encode to it
        # Tested pairs: each slot has one pair and its verdict, and the next pair of that slot replaces it.
        self.pairs = array("q", [-(1 << 62)]) * PAIR_SLOTS
        self.memo = _Memo(self, memo_entries, memo_chars)
        joined = {c for p in self.id if len(p) > 1 for c in p}
        lone = "".join(c for c in "\n\t\r" if c not in joined)
        cut = all(MARK not in p.lstrip(MARK) for p in self.id)
        joins = {b for p in self.id for a, b in itertools.pairwise(p) if a.isalnum()}
        ends = "".join(re.escape(c) for c in string.punctuation if c not in joins)
        word = f"{MARK}*+[^\\W_]++(?=[{ends}])|" if ends else ""
        self.parts = re.compile(f"{word}{MARK}*[^{MARK}{lone}]+|{MARK}+|[{lone or MARK}]" if cut else r"(?s:.+)")
        # decoding
        self.byte_of = byte_of
        self.bytes = [b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        for i in special:
            if sp.is_unknown(i):
                self.bytes[i] = " ⁇ ".encode()
        for i, b in byte_of.items():
            self.bytes[i] = bytes([b])
        self.silent = {i for i in special if not sp.is_unknown(i)}

    # encoding

    def _merge(self, text: str) -> list[str]:
        """Greedy merging, straight from its definition: for texts of two pieces at most."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _is_alone(self, token: int) -> bool:
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = self._merge(self.piece[token]) == [self.piece[token]]
        return found

    def _fits(self, first: int, second: int) -> bool:
        """Does the text of the two pieces encode to just these; a negative id is a character
        outside the vocabulary, which nothing merges with."""
        if first < 0:
            return self._is_alone(second)
        key = first * len(self.piece) + second
        slot = key * 0x9E3779B1 >> 8 & PAIR_SLOTS - 1
        known = self.pairs[slot]
        if known >> 1 == key:
            return known & 1
        a, b = self.piece[first], self.piece[second]
        found = self._merge(a + b) == [a, b]
        self.pairs[slot] = key << 1 | found
        return found

    def encode_part(self, text: str) -> list[int]:
        """Ids of a text that has been normalised."""
        n = len(text)
        last, size = [0] * (n + 1), [0] * (n + 1)  # of the prefix up to each place
        if not self.chars.issuperset(text):
            for k, c in enumerate(text, 1):
                if c not in self.chars:
                    last[k], size[k] = -ord(c) - 1, 1
        pairs, width, mask = self.pairs, len(self.piece), PAIR_SLOTS - 1
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if size[end]:
                continue
            before = end - length
            if before:
                if not size[before]:
                    continue
                key = last[before] * width + token
                known = pairs[key * 0x9E3779B1 >> 8 & mask]  # most pairs have been tested before
                if not (known & 1 if known >> 1 == key else self._fits(last[before], token)):
                    continue
            elif not self._is_alone(token):
                continue
            last[end], size[end] = token, length
        ids, at = [], n
        while at:
            token = last[at]
            if token >= 0:
                ids.append(token)
            elif self.byte_id:
                ids.extend(self.byte_id[b] for b in reversed(chr(-token - 1).encode()))
            else:
                ids.append(self.unk)
            at -= size[at]
        ids.reverse()
        return ids

    def encode_bytes(self, text: str, bos: bool = True, eos: bool = True) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        body = map(self.memo.__getitem__, self.parts.findall(MARK + text.replace(" ", MARK)) if text else ())
        return b"".join((_packed([self.bos] * bos), *body, _packed([self.eos] * eos)))

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> list[int]:
        return memoryview(self.encode_bytes(text, bos, eos)).cast("I").tolist()

    # decoding

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The text in UTF-8; without the space that encoding adds in front.  Byte pieces that make
        no character give one replacement character each."""
        ids = [i for i in ids if i not in self.silent]
        start = 0
        out = b"".join(map(self.bytes.__getitem__, ids))
        try:
            out.decode()
        except UnicodeDecodeError:
            out = b"".join(self._repaired(ids))
        if ids and self.piece[ids[0]].startswith(MARK):
            start = 1
        return out[start:]

    def _repaired(self, ids: list[int]) -> Iterable[bytes]:
        run = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        run[at : at + size].decode()
                        yield bytes(run[at : at + size])
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    yield REPLACEMENT
                    at += 1
            run.clear()
            if i >= 0:
                yield self.bytes[i]

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode()


class _Memo(dict):
    """Encoded parts in two generations of a bounded size: a full one becomes the old one, and what is
    asked for again moves back.  Parts over a length are never kept."""

    def __init__(self, codec: PrefixTableCodec, entries: int, chars: int):
        super().__init__()
        self.codec, self.entries, self.chars, self.old = codec, entries, chars, {}

    def __missing__(self, part: str) -> bytes:
        packed = self.old.get(part)
        if packed is None:
            packed = _packed(self.codec.encode_part(part))
        if len(part) <= self.chars:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[part] = packed
        return packed


def _packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


#: Codecs of this worker by the digest of their model and the size of their memo.
_CODECS: dict[tuple[str, int], PrefixTableCodec] = {}


def _codec(model: bytes, memo_entries: int) -> PrefixTableCodec:
    key = hashlib.sha256(model).hexdigest(), memo_entries
    if key not in _CODECS:
        _CODECS[key] = PrefixTableCodec(model, memo_entries)
    return _CODECS[key]


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, memo_entries: int = MEMO_ENTRIES
) -> DataFrame:
    """Encode every whole text with begin and end ids and decode it again: ``doc_id, n_tokens,
    ids_sha256, decoded_sha256`` and, if asked for, the packed ``ids`` and the ``decoded`` text.  A
    worker's memo holds at most twice ``memo_entries`` parts, about 200 bytes each."""
    spark = docs.sparkSession
    with open(model_path, "rb") as file:  # a fixed file of the installation, under a megabyte
        model = spark.sparkContext.broadcast(file.read())

    def run(batches):
        codec = _codec(model.value, memo_entries)
        for batch in batches:
            n, ids, texts = [], [], []
            for text in batch.column(1).to_pylist():
                packed = codec.encode_bytes(text or "")
                ids.append(packed)
                n.append(len(packed) // 4)
                texts.append(codec.decode_bytes(memoryview(packed).cast("I").tolist()))
            digest = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
            columns = [batch.column(0), pa.array(n, pa.int64()), digest(ids), digest(texts)]
            if with_ids:
                columns += [pa.array(ids, pa.binary()), pa.array([t.decode() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    bound_batches(spark)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: 2 * with_ids]]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, schema)
