"""Token counts by batch encoding, with texts split at boundaries that no token crosses.

Both tokenizers split a text into pretokens first and never merge across them. Between characters that are
printable ASCII or letters of U+00C0-U+00FF, a pretoken always ends before a single space, on both sides of
a single line feed, and where punctuation follows a letter (but for the apostrophe, which may open a
contraction, and the bar, which ends special strings). White-space rules concern runs, and none of these
characters composes with its neighbours, so neither reaches over such a boundary. Every text, however long,
is cut there into pieces; equal pieces of a batch are encoded once, and the results are put together per text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.llm import text as tx

CACHE_ENTRIES = 300_000
SLICE_BYTES = 4 << 20

_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = _PRINTED & ~_LETTER
_PUNCTUATION[[*range(48, 58), ord("'"), ord("|")]] = False
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def cut_points(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of all pieces: each row's start, and each safe boundary."""
    n = len(raw)
    safe = np.zeros(n + 1, bool)
    if n > 2:
        lead = raw == 0xC3  # first byte of U+00C0-U+00FF
        tail = np.zeros(n, bool)
        tail[1:] = lead[:-1]
        opens, ends = _PRINTED[raw] | lead, _PRINTED[raw] | tail
        between = ends[:-2] & opens[2:]
        safe[1 : n - 1] |= between & ((raw[1:-1] == 0x20) | (raw[1:-1] == 0x0A))
        safe[2:n] |= between & (raw[1:-1] == 0x0A)
        letter = _LETTER[raw] | (tail & (raw != 0x97) & (raw != 0xB7))
        safe[1:n] |= letter[:-1] & _PUNCTUATION[raw[1:]]
    safe[starts[:-1]] = True  # a row is cut from its predecessor whatever it begins with
    safe[n] = False
    return np.flatnonzero(safe)


def byte_letters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Encodes pieces with one tokenizer and remembers the pieces it has seen (at most `entries`).

    A piece that is one word of the letters above goes straight to the tokenizer's BPE model, for it is one
    pretoken; all other pieces go through the tokenizer's batch call.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES, ids: bool = False, lower: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.entries, self.ids, self.lower = entries, ids, lower
        self.letters = {bytes([b]).decode("latin-1"): c for b, c in enumerate(byte_letters())}
        self.shown = str.maketrans(self.letters)
        self.known: dict[str, object] = {}

    def _word(self, piece: str):
        """A piece that may be one pretoken: lower-cased without its space, or as it is."""
        bare = piece[1:] if piece[:1] == " " else piece
        if not _WORD.fullmatch(bare):
            return None
        if self.lower:
            piece = bare.lower()
        if not piece.isascii() or piece[:1] == " ":
            piece = piece.encode().decode("latin-1").translate(self.shown)
        found = self.tokenizer.model.tokenize(piece)
        return np.array([t.id for t in found], np.uint32) if self.ids else len(found)

    def _encode(self, pieces: list[str]) -> list:
        done = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) if self.ids else len(e.ids) for e in done]

    def __call__(self, pieces: list[str]) -> list:
        """Ids (or their number) of each piece."""
        if len(self.known) > self.entries:
            self.known = {}
        known, fresh, rest = self.known, {}, []
        for p in pieces:
            if p not in known:
                value = self._word(p)
                if value is None:
                    rest.append(p)
                else:
                    fresh[p] = value
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            fresh.update(zip(part, self._encode(part)))
        out = [known[p] if p in known else fresh[p] for p in pieces]
        room = max(0, self.entries - len(known))
        for p, value in fresh.items():
            if room and len(p) < 32:
                known[p] = value
                room -= 1
        if not room:
            self.known = {}
        return out


def pieces_of(raw: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pieces, which of them stands at each place, number of pieces of each row)."""
    cuts = cut_points(raw, starts)
    offsets = np.append(cuts, len(raw)).astype(np.int32)
    column = pa.Array.from_buffers(pa.string(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = column.dictionary_encode()
    per_row = np.diff(np.searchsorted(cuts, starts))
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), per_row


def row_sums(values: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(per_row)
    return total[ends] - total[ends - per_row]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, lower: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text.

    A null text counts as empty (0 bytes, 0 tokens); a null key stays null; repeated rows stay repeated; other
    columns are ignored. Rows are encoded in slices of about 4 MB, so batches are balanced by bytes, and a
    longer text forms a slice of its own. `lower`: the tokenizer lower-cases and drops white space. No shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, lower=lower)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, raw, starts in tx.slices(batch.column(1), SLICE_BYTES):
                distinct, at, per_row = pieces_of(raw, starts)
                lengths = np.array(encode(distinct), np.int64)
                n_tokens.append(row_sums(lengths[at] if len(at) else np.zeros(0, np.int64), per_row))
                n_bytes.append(np.diff(starts))
            if not n_bytes:
                continue
            tokens = np.concatenate(n_tokens)
            columns = [batch.column(0), np.concatenate(n_bytes), tokens, tokens > limit]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(key, text).mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)
