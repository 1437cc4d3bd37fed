"""Byte-level BPE by backtracking over longest token matches.

A piece of text (one match of the vocabulary's split pattern) is encoded in
linear time: an Aho-Corasick automaton gives the longest token that starts at
each byte; the encoder walks left to right, takes the longest token that is
compatible with the token before it, falls back to the next shorter token
that is a prefix of it, and steps back when none fits.  Two tokens are
compatible if merging their joined bytes by rank gives exactly the two; that
is decided by undoing merges along the shared border and kept in a table.

Documents are spread by Spark; a Python worker keeps the automaton, the pair
table and a bounded table of pieces already encoded.  Decoding gathers bytes
through an offset table over the concatenated vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW = 1 << 20
MAX_PIECES = 500_000
MAX_PAIRS = 2_000_000
_CODECS: dict[str, BpeCodec] = {}


def ascii_split() -> re.Pattern:
    """``SPLIT`` for texts of ASCII only, in the standard library's faster ``re``."""
    classes = {r"[^\s\p{L}\p{N}]": r"[^ \t-\rA-Za-z0-9]", r"\p{L}": "[A-Za-z]", r"\p{N}": "[0-9]", r"\S": r"[^ \t-\r]", r"\s": r"[ \t-\r]"}
    out = SPLIT
    for name, spelt in classes.items():
        out = out.replace(name, spelt)
    return re.compile(out)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BpeCodec:
    """Encoder and decoder for one vocabulary file (JSON with vocab, merges, added tokens)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        raw = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.split, self.ascii_split = regex.compile(SPLIT), ascii_split()
        self.length = {i: len(b) for i, b in raw.items()}
        by_bytes = {b: i for i, b in raw.items()}

        # rank and halves of each token that a merge makes
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(merges):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            made = vocab[left + right]
            pair = (vocab[left], vocab[right])
            self.joined[pair] = made
            if made not in self.halves:
                self.halves[made], self.rank[made] = pair, rank
        # the next shorter token that is a prefix of a token
        self.shorter: dict[int, int | None] = {}
        for i, b in raw.items():
            self.shorter[i] = next((by_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in by_bytes), None)
        self.automaton = ahocorasick.Automaton()
        for i, b in raw.items():
            if len(b) == 1 or i in self.halves:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

        # offset table for decoding
        n = max([*raw, *self.special.values()]) + 1
        content = [raw.get(i, b"") for i in range(n)]
        for text, i in self.special.items():
            content[i] = text.encode()
        self.sizes = np.array([len(b) for b in content], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.pool = np.frombuffer(b"".join(content), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """True if the two tokens stay apart when their joined bytes are merged by rank."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        """Undo the youngest merge at the border, again and again.

        A merge across the border would have happened first if its rank is
        below that of every merge undone on the way (on a tie the leftmost
        place wins, so a left part of equal rank is kept).
        """
        rank, halves = self.rank, self.halves
        bound = (len(rank) + 1, 0)
        while True:
            across = self.joined.get((left, right))
            if across is not None and (rank[across], 1) < bound:
                return False
            of_left, of_right = rank.get(left, -1), rank.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                bound, left = (of_left, 1), halves[left][1]
            else:
                bound, right = (of_right, 2), halves[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one piece by backtracking over longest matches."""
        n = len(piece)
        longest: list[int | None] = [None] * n
        # matches come by their end; of those with one start, the last is the longest
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token
        sizes, pairs, shorter = self.length, self.pairs, self.shorter
        open_at = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            before = tokens[-1] if tokens else None
            while token is not None:
                if open_at[at + sizes[token]]:
                    if before is None:
                        break
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = self.compatible(before, token)
                    if fits:
                        break
                token = shorter[token]
            if token is None:  # nothing fits here: this place is closed, step back
                open_at[at] = 0
                token = tokens.pop()
                at -= sizes[token]
            else:
                tokens.append(token)
                at += sizes[token]
                token = longest[at] if at < n else None
        return tokens

    def packed(self, piece: str) -> bytes:
        """Ids of a piece as little-endian 32-bit integers, kept for the next time."""
        if len(self.pieces) >= MAX_PIECES:
            self.pieces.clear()
        ids = array("I", self.encode_piece(piece.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        ids = ids.tobytes()
        if len(piece) <= 64:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if self.special_cut is None or not any(s in text for s in self.special):
            return self._encode_plain(text)
        return b"".join(
            np.uint32(self.special[part]).astype("<u4").tobytes() if part in self.special else self._encode_plain(part)
            for part in self.special_cut.split(text)
        )

    def _encode_plain(self, text: str) -> bytes:
        """Pieces are looked up; a long text is split match by match, so few are held at once."""
        known, packed = self.pieces, self.packed
        split = self.ascii_split if text.isascii() else self.split
        if len(text) <= WINDOW:
            return b"".join([known.get(p) or packed(p) for p in split.findall(text)])
        out, held = [], []
        for match in split.finditer(text):
            held.append(known.get(match.group()) or packed(match.group()))
            if len(held) >= WINDOW // 8:
                out.append(b"".join(held))
                held = []
        return b"".join([*out, *held])

    def decode(self, packed: bytes, block: int = 1 << 18) -> bytes:
        """Bytes of packed ids, gathered through the offset table block by block."""
        ids = np.frombuffer(packed, "<u4")
        out = []
        for lo in range(0, len(ids), block):
            part = ids[lo : lo + block]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            shift = np.repeat(self.starts[part] - (ends - sizes), sizes)
            out.append(self.pool[np.arange(len(shift)) + shift].tobytes())
        return b"".join(out)


def codec(path: str) -> BpeCodec:
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def bpe_encode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode and decode every whole text; one row per input row.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers) and decoded_sha256 (of the decoded bytes), plus ``ids``
    (array<int>) and ``decoded`` if ``with_ids``.  ``vocabulary`` is a path
    that every executor can open.

    Null or empty text: no tokens, digests of nothing.  Special tokens that
    stand in a text become their own id.  Repeated rows and null ids are kept
    as they come; other columns are ignored; an empty table gives no rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            counts, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for value in batch.column(1):
                packed = bpe.encode(value.as_py() or "")
                plain = bpe.decode(packed)
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(plain.decode("utf-8", "replace").encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
                    texts.append(plain.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, schema)
