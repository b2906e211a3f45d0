"""Evaluation passages inside training texts: size-partitioned MinHash containment, verified exactly.

Items are partitioned by size, each partition ending at twice the words at which it begins.  The smallest item of a
partition tells the shortest stretch that counts as a leak, and from it the width of the windows over a text, narrow enough
that such a stretch always holds a whole one.  A window's MinHash values over word shingles are looked up among the
shingles of the partition's items: the share of values found estimates how much of the window the item contains.  For the
pairs that reach the least share, the shingles that text and item have in common exactly are chained in order, and the
chain tells which part of the item the text holds.

Items of fewer words than a shingle leak where they are spoken whole.

Items come in chunks of a bounded number, each of which is one index; a worker builds it once.  A text is read and cut into
words once and put to every chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tokensift.llm.dialogue import MARKUP, SOUNDS, joined, scrambled, words
from tokensift.llm.shipping import ship
from tokensift.llm.splitting import spread
from tokensift.llm.tokens import slices

SHINGLE, EXACT = 5, 3


@dataclass
class Partition:
    """Items of like size: their shingle hashes, sorted, with the item of each, and the window's half width."""

    block: int
    shingles: np.ndarray
    items: np.ndarray
    filter: np.ndarray


def shingles(hashes: np.ndarray, texts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words within a text, and the position of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = (out + hashes[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    at = np.flatnonzero(texts[:n] == texts[width - 1 :])
    return out[at], at


def _slot(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(44)).astype(np.int64)


class ItemIndex:
    """What every task gets of a chunk of items."""

    def __init__(self, passages: list[str], share: float, hashes: int = 8):
        self.share, self.hashes = share, hashes
        stream = words(joined(passages)) if passages else None
        keep = stream.letters > 1 if passages else None
        stream = stream.where(keep) if passages else None
        self.words = [stream.hash[stream.text == i] for i in range(len(passages))]
        self.exact = []
        for own in self.words:
            s, at = shingles(own, np.zeros(len(own), np.int64), EXACT)
            order = np.argsort(s, kind="stable")
            self.exact.append((s[order], at[order]))
        sizes = np.array([len(w) for w in self.words])
        self.short = []  # width, hashes of whole items, items
        for width in range(1, SHINGLE):
            own = np.flatnonzero(sizes == width) if passages else []
            if len(own):
                values = np.array([shingles(self.words[i], np.zeros(width, np.int64), width)[0][0] for i in own])
                order = np.argsort(values, kind="stable")
                self.short.append((width, values[order], own[order]))
        self.partitions: list[Partition] = []
        low = SHINGLE
        while passages and low <= sizes.max():
            chosen = [i for i in np.flatnonzero((sizes >= low) & (sizes < 2 * low))]
            low *= 2
            if not chosen:
                continue
            least = max(SHINGLE, int(np.ceil(share * sizes[chosen].min()))) - SHINGLE + 1
            parts = [shingles(self.words[i], np.zeros(sizes[i], np.int64), SHINGLE)[0] for i in chosen]
            values = np.concatenate(parts)
            owners = np.repeat(chosen, [len(x) for x in parts])
            order = np.lexsort((owners, values))
            table = np.zeros(1 << 20, bool)
            table[_slot(values)] = True
            self.partitions.append(Partition(max(1, (least + 1) // 3), values[order], owners[order], table))

    def phrases(self, hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Pairs of text and item, of items shorter than a shingle that are spoken whole."""
        found = [np.zeros((0, 2), np.int64)]
        for width, values, items in self.short:
            s, at = shingles(hashes, texts, width)
            left, right = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            n = right - left
            take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
            found.append(np.stack([np.repeat(texts[at], n), items[take]], 1))
        return np.unique(np.concatenate(found), axis=0)

    def candidates(self, hashes: np.ndarray, texts: np.ndarray, least: int) -> np.ndarray:
        """Pairs of text and item of which a window has at least ``least`` of its MinHash values in the item."""
        s, at = shingles(hashes, texts, SHINGLE)
        found = [np.zeros((0, 2), np.int64)]
        if not len(s):
            return found[0]
        owner = texts[at]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        place = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
        multipliers = np.random.default_rng(7).integers(1, 1 << 63, self.hashes, dtype=np.uint64) | np.uint64(1)
        for p in self.partitions:
            # only texts that have a shingle of the partition at all: their windows alone can reach an item
            known = p.filter[_slot(s)]
            known[known] = _member(p.shingles, s[known])
            touched = np.zeros(int(owner[-1]) + 1, bool)
            touched[owner[known]] = True
            inside = touched[owner]
            if not inside.any():
                continue
            own, text, spot, hit = s[inside], owner[inside], place[inside], known[inside]
            begins = np.flatnonzero((spot % p.block == 0) | (spot == 0))
            same = np.append(text[begins][1:] == text[begins][:-1], False)
            pairs = []
            for m in multipliers:
                h = scrambled(own * m)
                low = np.minimum.reduceat(h, begins)
                window = np.where(same, np.minimum(low, np.append(low[1:], low[-1])), low)
                # the shingle behind the least value: equal values come from equal shingles
                order = np.argsort(h[hit], kind="stable")
                known_h, known_s = h[hit][order], own[hit][order]
                spots = np.searchsorted(known_h, window)
                spots = np.minimum(spots, len(known_h) - 1)
                good = np.flatnonzero(known_h[spots] == window)
                value = known_s[spots[good]]
                left, right = np.searchsorted(p.shingles, value, "left"), np.searchsorted(p.shingles, value, "right")
                n = right - left
                take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
                pairs.append(np.unique(np.stack([np.repeat(good, n), p.items[take]], 1), axis=0))
            both, counts = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
            both = both[counts >= least]
            found.append(np.stack([text[begins[both[:, 0]]], both[:, 1]], 1))
        return np.unique(np.concatenate(found), axis=0)

    def part_held(self, item: int, s: np.ndarray) -> float:
        """The share of the item's words that lie in the best chain of shingles it has in common with a text.

        ``s``: the text's shingles of EXACT words.  In a chain both positions grow.  A word in the chain counts one, a word
        of the item left out costs two; what the text has in between costs one and a little for each word, up to 40 words.
        A text of which no stretch has a third of the shingles of the shortest leak exactly holds nothing.
        """
        values, places = self.exact[item]
        n = len(self.words[item])
        left, right = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        hits = np.flatnonzero(right > left)
        need = max(2, int(np.ceil((self.share * n - EXACT + 1) / 3)))
        if len(hits) < need or (hits[need - 1 :] - hits[: len(hits) - need + 1]).min() > n + 40:
            return 0.0
        n_each = (right - left)[hits]
        at = np.repeat(hits, n_each)
        where = places[np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each) + np.repeat(left[hits], n_each)]
        low = np.searchsorted(at, at - n - 40).tolist()  # no anchor before that can lie in one stretch with this one
        at, where = at.tolist(), where.tolist()
        scores, starts, tops, best, share = [], [], [], 0.0, 0.0
        for a, (d, i) in enumerate(zip(at, where)):
            score, start, b = float(EXACT), i, a - 1
            while b >= low[a] and tops[b] + EXACT > score:  # a step gains EXACT words at most
                in_text, in_item = d - at[b], i - where[b]
                if in_text > 0 and in_item > 0 and in_text <= in_item + 40:
                    gained, shift = min(in_item, EXACT), abs(in_text - in_item)
                    new = scores[b] + gained - 2.0 * (in_item - gained) - (1.0 + 0.1 * shift if shift else 0.0)
                    if new > score:
                        score, start = new, starts[b]
                b -= 1
            scores.append(score)
            starts.append(start)
            tops.append(max(score, tops[-1]) if tops else score)
            if score > best:
                best, share = score, (i + EXACT - start) / n
        return share


def _member(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    spots = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[spots] == values


def leaked(indexes: list[ItemIndex], texts: list[str], least: int = 2) -> tuple[list[int], list[int], list[int], list[float]]:
    """Text, index, item and share of every leak in ``texts``."""
    stream = words(SOUNDS.sub(" ", MARKUP.sub(" ", joined(texts))))
    stream = stream.where(stream.letters > 1)
    out: tuple[list[int], list[int], list[int], list[float]] = [], [], [], []
    for which, index in enumerate(indexes):
        held = [(text, item, 1.0) for text, item in index.phrases(stream.hash, stream.text).tolist()]
        at, s = None, None
        for text, item in index.candidates(stream.hash, stream.text, least).tolist():
            if text != at:
                left, right = np.searchsorted(stream.text, (text, text + 1))
                s, at = shingles(stream.hash[left:right], stream.text[left:right], EXACT)[0], text
            share = index.part_held(item, s)
            if share >= index.share:
                held.append((text, item, share))
        for text, item, share in held:
            for column, value in zip(out, (text, which, item, share)):
                column.append(value)
    return out


_built: dict[tuple, ItemIndex] = {}


def _index(key: tuple, passages: list[str], share: float, hashes: int) -> ItemIndex:
    """The index of a chunk, built once in a worker's life; those of other searches go."""
    if key not in _built:
        for other in [k for k in _built if k[0] != key[0]]:
            del _built[other]
        _built[key] = ItemIndex(passages, share, hashes)
    return _built[key]


def find_leaks(
    documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    passage_column: str = "passage", share: float = 0.4, hashes: int = 8, least: int = 2, chunk: int = 20_000, chunks: int = 10,
) -> DataFrame:
    """``<id>, <item>, share``: documents with at least ``share`` of an item's words in one stretch, once each.

    Items are the stated set: they are read in chunks of at most ``chunk``, and the documents once for ``chunks`` of these, so
    a worker holds the indexes of 200,000 items at most, some 3 KB for each.  Nothing is shuffled but the final distinct of
    repeated rows.  Null and empty texts and passages leak nothing; an item of fewer than five words leaks where all of it is
    spoken.  Words of one letter and numbers don't count.
    """
    ship(documents.sparkSession)
    kind, item_kind = documents.schema[id_column].dataType.simpleString(), items.schema[item_column].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_column].dataType)
    rows = items.where(F.col(passage_column).isNotNull()).select(item_column, passage_column).orderBy(item_column).toLocalIterator()
    texts = spread(documents.where(F.col(text_column).isNotNull()).select(F.col(id_column), F.make_valid_utf8(F.col(text_column))))
    schema = f"`{id_column}` {kind}, `{item_column}` {item_kind}, share double"
    context = documents.sparkSession.sparkContext

    def search(sent: list) -> DataFrame:
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                indexes = [_index((key, i), b.value[1], share, hashes) for i, b in enumerate(sent)]
                names = [pa.array(b.value[0], item_type) for b in sent]
                for at, part in slices(batch.column(1)):
                    text, which, item, held_share = leaked(indexes, part, least)
                    base = np.cumsum([0, *map(len, names)])
                    ids = batch.column(0).take(pa.array([at + t for t in text], pa.int64()))
                    own = pa.concat_arrays(names).take(pa.array([int(base[w]) + i for w, i in zip(which, item)], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, own, pa.array(held_share, pa.float64())], names=[id_column, item_column, "share"])

        return texts.mapInArrow(run, schema)

    found, sent = [], []
    while held := list(islice(rows, chunk)):
        sent.append(context.broadcast(([r[0] for r in held], [r[1] for r in held])))
        if len(sent) == chunks:
            found.append(search(sent))
            sent = []
    if sent or not found:
        found.append(search(sent or [context.broadcast(([], []))]))
    return reduce(DataFrame.unionByName, found).groupBy(id_column, item_column).agg(F.max("share").alias("share"))
