"""Byte-pair encoding by backtracking, and decoding by an offset table.

Encoding never replays merges. At each position the automaton over the vocabulary gives the longest token; a token may
follow another one only if the pair is compatible, which is read off the merge table by undoing merges on both sides of
the boundary. Where no token fits, the encoder drops its last token, marks the position as dead and tries that token's
longest proper prefix instead. Each position dies once at most, so the work is linear in the text, and the one sequence
whose neighbours are all compatible is the one that the merges give.

Edge cases: a null or empty text has no ids and decodes to the empty text. A text that contains the string of a special
token gives that token's id, as the tokenizers library does. Repeated rows and null doc_id give a row each; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.llm.common import slices, table, tidy

#: Distinct pre-tokens whose ids a task remembers, and token pairs; either memory is emptied when it is full.
REMEMBERED = 300_000
#: Fixed value: the pre-tokenizer's pattern, with white space as Unicode's property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def bmp_pattern() -> str:
    """SPLIT with its classes spelled out up to U+FFFF: the plain engine is several times faster on these."""
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)

    def ranges(kind: str) -> str:
        runs = regex.findall(rf"\p{{{kind}}}+", every)
        cuts = [r for run in runs for r in np.split(np.array([ord(c) for c in run]), np.flatnonzero(np.diff([ord(c) for c in run]) != 1) + 1)]
        return "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in cuts)

    letters, numbers, blanks = ranges("L"), ranges("N"), ranges("White_Space")
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"


class Remembered(dict):
    """Pre-token to packed ids, filled on demand."""

    def __init__(self, encode, most: int):
        self._encode, self._most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self._most:
            self.clear()
        found = self._encode(piece.encode())
        ids = self[piece] = struct.pack(f"<{len(found)}I", *found)
        return ids


class BytePairCodec:
    """Encoder and decoder of a byte-level vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, vocabulary: bytes, remembered: int = REMEMBERED):
        spec = json.loads(vocabulary)
        stands, model = byte_alphabet(), spec["model"]
        raw = lambda token: bytes(stands[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = model["vocab"]
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = raw(token)
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        # merges by rank; ids of merged tokens rise with their rank, so that an id stands for its rank
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            i = ids[left + right]
            self.merged[ids[left], ids[right]] = i
            self.halves[i] = ids[left], ids[right]
        self.automaton = ahocorasick.Automaton()
        plain = {self.bytes_of[i].decode("latin-1"): i for i in ids.values()}
        for token, i in plain.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.id_of = plain
        self.shorter = [-1] * size
        for token, i in plain.items():
            for n in range(len(token) - 1, 0, -1):
                if (prefix := plain.get(token[:n])) is not None:
                    self.shorter[i] = prefix
                    break
        lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.lengths = lengths.tolist()
        self.split_any, self.split_bmp = regex.compile(SPLIT), re.compile(bmp_pattern())
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.remembered = Remembered(self.encode_piece, remembered)
        self.fits: dict[int, bool] = {}  # by both ids in one number

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges keep the boundary between tokens a and b."""
        known = self.fits.get(a << 20 | b)
        if known is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            known = self.fits[a << 20 | b] = self._undone(a, b)
        return known

    def forget(self) -> None:
        """Workers outlive their tasks; what a task remembered does not."""
        self.remembered.clear()
        self.fits.clear()

    def _undone(self, a: int, b: int) -> bool:
        merged, halves = self.merged, self.halves
        limit = len(halves)
        while True:
            if merged.get((a, b), limit) < limit:
                return False  # an earlier merge would have joined the two sides
            later_left = a > b
            for left_side in (later_left, not later_left):
                old = a if left_side else b
                new = halves[a][1] if left_side else halves[b][0]
                if new != old:
                    if left_side:
                        a, limit = new, old
                    else:
                        b, limit = new, old + 1
                    break
            else:
                return True  # both sides are single bytes

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        text = piece.decode("latin-1")
        if (whole := self.id_of.get(text)) is not None:
            return [whole]
        lengths, shorter, fits = self.lengths, self.shorter, self.fits.get
        longest = [0] * len(text)
        for last_byte, i in self.automaton.iter(text):  # at each start, the last match seen is the longest
            longest[last_byte + 1 - lengths[i]] = i
        out: list[int] = []
        dead: set[int] = set()
        at, end, token = 0, len(text), longest[0]
        while at < end:
            last = out[-1] if out else -1
            while token >= 0:
                if at + lengths[token] not in dead:
                    if last < 0:
                        break
                    known = fits(last << 20 | token)
                    if known if known is not None else self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                if at < end:
                    token = longest[at]
            else:
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, pieces = self.remembered.__getitem__, (self.split_any if ASTRAL.search(text) else self.split_bmp).findall
        if self.at_special is None or not any(s in text for s in self.special):
            return b"".join(map(get, pieces(text)))
        out = []
        for n, part in enumerate(self.at_special.split(text)):
            out.append(np.uint32(self.special[part]).astype("<u4").tobytes() if n % 2 else b"".join(map(get, pieces(part))))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        parts = []
        for at in range(0, len(ids), 1 << 18):
            block = ids[at : at + (1 << 18)].astype(np.int64)
            starts = self.offsets[block]
            sizes = self.offsets[block + 1] - starts
            before = np.cumsum(sizes) - sizes
            parts.append(self.blob[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(vocabulary: bytes) -> BytePairCodec:
    """Built once in each worker."""
    return BytePairCodec(vocabulary)


def encode_documents(docs: DataFrame, vocabulary: bytes, keep_ids: bool = False) -> DataFrame:
    """Digest columns of the ids and of the decoded text, beside doc_id; ``keep_ids`` adds the ids themselves."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file, whatever the corpus
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for b in slices(batches):
            counts, digests, decoded, kept = [], [], [], []
            for scalar in b.column("text"):
                packed = own.encode(scalar.as_py() or "")
                ids = np.frombuffer(packed, dtype="<u4")
                counts.append(len(ids))
                digests.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            columns = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        own.forget()
        tidy()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def default_vocabulary() -> bytes:
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes()


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return encode_documents(table(spark, sf_dir, "documents"), default_vocabulary())
