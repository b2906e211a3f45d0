"""Token ids of whole texts by a public byte-level tokenizer, over Arrow batches.

The tokenizer cuts a text into pieces first and merges bytes within a piece only, so a piece has the same ids wherever it
stands.  A batch of texts is cut in one vectorised pass over its code points; the pieces become an Arrow string array on
the batch's own bytes, are dictionary-encoded, and only pieces that the task has not met before go to the tokenizers
library.  Texts with characters outside the ranges whose classes are settled (``_SETTLED``) go through the library whole.

Offsets are in characters: a token of a piece covers the characters of which it has at least one byte, so the tokens of a
split character overlap in it.  Decoding reverses the byte table; bytes that form no character give U+FFFD.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokensift.llm.codepoints import code_points, utf8_lengths
from tokensift.llm.shipping import ship
from tokensift.llm.splitting import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: Blocks of characters, first and last, that were fully classed long ago.
_SETTLED = ((0x00, 0x52F), (0x1E00, 0x1FFF), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FA5), (0xFE00, 0xFE0F), (0xFF00, 0xFFEF))
_OTHER, _LETTER, _NUMBER, _BLANK, _SPACE, _UNSETTLED = range(6)
_WHITE = (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point below 0x10000: letter, number, the space character, other white space, the rest."""
    out = np.full(0x10000, _UNSETTLED, np.uint8)
    kinds = {"L": _LETTER, "N": _NUMBER}
    for first, last in _SETTLED:
        for c in range(first, last + 1):
            out[c] = kinds.get(unicodedata.category(chr(c))[0], _OTHER)
    out[list(_WHITE)] = _BLANK
    out[0x20] = _SPACE
    return out


def char_classes(points: np.ndarray) -> np.ndarray:
    table = _classes()
    return np.where(points < 0x10000, table[np.minimum(points, 0xFFFF)], _UNSETTLED).astype(np.uint8)


def piece_starts(points: np.ndarray, classes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Ascending positions at which pieces begin, of texts laid end to end; ``text_starts`` are among them.

    A piece is: one of the English clitics 's 't 're 've 'm 'll 'd, a run of letters, of numbers or of other characters,
    each with one space before it if there is one, or white space.  Of a run of white space that something follows, the
    last character is a piece of its own, or the space of the next piece.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n, bool)
    first[text_starts] = True
    kind = np.where(classes == _SPACE, _BLANK, classes)
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first
    white = kind == _BLANK
    start = change.copy()
    # the last white space before something else in the same text
    last_white = np.zeros(n, bool)
    last_white[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    start |= last_white
    # a space takes what follows it
    taken = np.zeros(n, bool)
    taken[1:] = (classes[:-1] == _SPACE) & ~white[1:] & ~first[1:]
    start &= ~taken
    # clitics: a piece that is one apostrophe alone, then letters
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~first[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(np.where(quote + 2 < n, first[np.minimum(quote + 2, n - 1)], True), 0, two)
        r, v, l, e = (ord(c) for c in "rvle")
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == r) & (two == e)) | ((one == v) & (two == e)) | ((one == l) & (two == l))
        start[quote[short | long] + 1] = False
        for clitics, width in ((quote[short], 2), (quote[long & ~short], 3)):
            ends = clitics + width
            ends = ends[ends < n]
            start[ends[(kind[ends] == _LETTER)]] = True
    return np.flatnonzero(start)


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_spans(piece: str, widths: list[int]) -> list[tuple[int, int]]:
    """For tokens of ``widths`` bytes in turn: the first character and the end of each in ``piece``."""
    owner = [i for i, c in enumerate(piece) for _ in c.encode("utf-8", "surrogatepass")]
    spans, at = [], 0
    for w in widths:
        spans.append((owner[at], owner[at + w - 1] + 1))
        at += w
    return spans


_PART = 1 << 21
_EDGE = re.compile(r"(?<=[^\s])[ \n]")


def text_parts(text: str, size: int = _PART) -> Iterator[tuple[int, str]]:
    """``text`` in parts of about ``size`` characters with the first position of each, cut where a blank follows something
    else: there a piece always ends, whatever comes after it."""
    at = 0
    while len(text) - at > size:
        cut = _EDGE.search(text, at + size)
        if not cut:
            break
        yield at, text[at : cut.start()]
        at = cut.start()
    yield at, text[at:]


def load_tokenizer(path: str):
    """The tokenizer of ``path``; refused if its pieces are not those that this module cuts, or its bytes not those it reads."""
    from tokenizers import Tokenizer

    own = json.loads(Path(path).read_text())
    cutter, model = own.get("pre_tokenizer") or {}, own["model"]
    fits = (
        own.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        and model.get("type") == "BPE" and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
    )
    if not fits:
        raise ValueError(f"{path} is not a byte-level BPE that is cut by the common pattern, without normalizer, added space and word ends")
    return Tokenizer.from_file(path)


class PieceEncoder:
    """A tokenizer with memory: ids, and spans if asked for, of every piece met so far (at most ``keep`` pieces)."""

    def __init__(self, path: str, spans: bool = False, keep: int = 400_000):
        self.tokenizer = load_tokenizer(path)
        self.tokenizer.encode_special_tokens = True
        self.spans, self.keep = spans, keep
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.first, self.count, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self.spans_flat = np.zeros((1 << 16, 2), np.int32) if self.spans else None

    def _learn(self, pieces: list[str]) -> None:
        if len(self.at) + len(pieces) > self.keep:
            self._reset()
        for piece, e in zip(pieces, self.tokenizer.encode_batch(pieces, add_special_tokens=False) if self.spans else self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)):
            ids, k = e.ids, len(self.at)
            if self.size + len(ids) > len(self.flat):
                more = max(len(self.flat), len(ids))
                self.flat = np.concatenate([self.flat, np.zeros(more, np.int32)])
                if self.spans:
                    self.spans_flat = np.concatenate([self.spans_flat, np.zeros((more, 2), np.int32)])
            if k == len(self.first):
                self.first, self.count = np.concatenate([self.first, np.zeros(k, np.int64)]), np.concatenate([self.count, np.zeros(k, np.int64)])
            self.at[piece] = k
            self.first[k], self.count[k] = self.size, len(ids)
            self.flat[self.size : self.size + len(ids)] = ids
            if self.spans and ids:
                self.spans_flat[self.size : self.size + len(ids)] = byte_spans(piece, [len(t) for t in e.tokens])
            self.size += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """All ids in a row, the number of ids of each text, and all spans if asked for.

        Texts longer than a part are encoded part by part, so that memory is bounded by the ids.
        """
        if all(len(t) <= _PART for t in texts):
            return self._encode(texts)
        ids, counts, spans = [], [], []
        for text in texts:
            n = 0
            for at, part in text_parts(text):
                own, count, covered = self._encode([part])
                ids.append(own)
                n += int(count[0])
                if self.spans:
                    spans.append(covered + np.int32(at))
            counts.append(n)
        return np.concatenate(ids), np.array(counts, np.int64), np.concatenate(spans) if self.spans else None

    def _encode(self, texts):
        joined = "".join(texts)
        points = code_points(joined)
        classes = char_classes(points)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        odd = np.zeros(len(texts), bool)
        unsettled = np.flatnonzero(classes == _UNSETTLED)
        if len(unsettled):
            odd[np.searchsorted(ends, unsettled, side="right")] = True
            whole = [i for i in range(len(texts)) if odd[i]]
            return self._mixed(texts, whole, odd)
        text_starts = (ends - lengths)[lengths > 0]
        starts = piece_starts(points, classes, text_starts)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros((0, 2), np.int32) if self.spans else None
        byte_ends = np.concatenate([[0], np.cumsum(utf8_lengths(points))])
        offsets = np.append(byte_ends[starts], byte_ends[-1]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(joined.encode("utf-8", "surrogatepass"))).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        new = [p for p in names if p not in self.at]
        if new:
            self._learn(new if len(self.at) + len(new) <= self.keep else names)
        known = np.fromiter((self.at[p] for p in names), np.int64, len(names))[pieces.indices.to_numpy(zero_copy_only=False)]
        counts = self.count[known]
        after = np.cumsum(counts)
        take = np.arange(after[-1]) + np.repeat(self.first[known] - (after - counts), counts)
        ids = self.flat[take]
        upto = np.searchsorted(starts, ends, side="left")
        sums = np.concatenate([[0], after])[upto]
        per_text = np.diff(np.concatenate([[0], sums]))
        spans = None
        if self.spans:
            text_of = np.repeat(ends - lengths, np.diff(np.concatenate([[0], upto])))
            spans = self.spans_flat[take] + np.repeat(starts - text_of, counts)[:, None].astype(np.int32)
        return ids, per_text, spans

    def _mixed(self, texts, whole, odd):
        """Some texts through the library whole, the others by pieces, in the order given."""
        plain = [t for t, o in zip(texts, odd) if not o]
        ids, per_text, spans = self._encode(plain)
        cuts = np.concatenate([[0], np.cumsum(per_text)])
        library = dict(zip(whole, self.tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False)))
        out_ids, out_counts, out_spans, k = [], [], [], 0
        for i in range(len(texts)):
            if odd[i]:
                e = library[i]
                own = np.array(e.ids, np.int32)
                if self.spans:
                    out_spans.append(np.array(byte_spans(texts[i], [len(t) for t in e.tokens]), np.int32).reshape(-1, 2))
            else:
                own = ids[cuts[k] : cuts[k + 1]]
                if self.spans:
                    out_spans.append(spans[cuts[k] : cuts[k + 1]])
                k += 1
            out_ids.append(own)
            out_counts.append(len(own))
        return np.concatenate(out_ids) if out_ids else np.zeros(0, np.int32), np.array(out_counts, np.int64), (np.concatenate(out_spans) if out_spans else np.zeros((0, 2), np.int32)) if self.spans else None


class Decoder:
    """Ids back to text."""

    def __init__(self, path: str):
        table = byte_alphabet()
        vocabulary = load_tokenizer(path).get_vocab(with_added_tokens=True)
        self.bytes = {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in vocabulary.items()}

    def decode(self, ids) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


def slices(column: pa.Array, chars: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch, null as '', in slices of about ``chars`` bytes, each with its first row."""
    values = column.to_pylist()
    at, size, out = 0, 0, []
    for i, t in enumerate(values):
        out.append(t or "")
        size += len(t or "")
        if size >= chars or len(out) >= 20_000:
            yield at, out
            at, size, out = i + 1, 0, []
    if out:
        yield at, out


def encode_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``<id>, ids``: the token ids of every text, without special tokens; [] for null and empty texts.

    One row per input row, repeated rows included.  Strings that look like special tokens are ordinary text;
    bytes that are not UTF-8 are U+FFFD.  Other columns are ignored; an empty table gives an empty one.  ``tokenizer``: a
    path that every worker can read; files of another kind than this module's are refused.
    """
    ship(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or PieceEncoder(tokenizer)
            for at, texts in slices(batch.column(1)):
                ids, counts, _ = encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], names=[id_column, "ids"])

    return spread(df.select(F.col(id_column), F.make_valid_utf8(F.col(text_column)))).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def token_offsets(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``<id>, ids, starts, ends``: token ids with the characters that each token covers, ends exclusive."""
    ship(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or PieceEncoder(tokenizer, spans=True)
            for at, texts in slices(batch.column(1)):
                ids, counts, spans = encoder.encode(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x), pa.int32())) for x in (ids, spans[:, 0], spans[:, 1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *lists], names=[id_column, "ids", "starts", "ends"])

    return spread(df.select(F.col(id_column), F.make_valid_utf8(F.col(text_column)))).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode_ids(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """``<id>, text``: ids back to text; null ids give null, [] gives ''."""
    ship(encoded.sparkSession)
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(tokenizer)
            texts = [None if ids is None else decoder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return encoded.select(F.col(id_column), F.col(ids_column)).mapInArrow(run, f"`{id_column}` {kind}, text string")
