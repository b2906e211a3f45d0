"""Pages made of repeated keywords, link lists or product tags instead of sentences.

1. Shape, by page and in no language: a word is list-like if it stands in a stretch of more than ``STRETCH`` words that no
   full stop, question or exclamation mark ends, or is covered by a phrase that the page repeats densely; a page of no more
   words than that has no shape.  A link and a hash tag are one word each, whatever they spell.
2. Phrases: all words are exploded into shingles of two, neighbours or with one word between them.  Over the whole collection
   every phrase gets the number of distinct hosts that have it in a list-like part, and the numbers of pages that have it in a
   list-like part and only in sentences.  A phrase is stuffing if at least ``hosts`` hosts replicate it in lists and it is no
   rarer in lists than in sentences.  Verses and unpunctuated speech are list-like in shape too, but their phrases are those of
   sentences elsewhere, or are replicated nowhere.
3. A page is spam if more than half of its letters are list-like and more than half are covered by stuffing phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tokensift.llm.dialogue import MARKUP, joined, scrambled, words
from tokensift.llm.shipping import ship
from tokensift.llm.splitting import split_join, spread
from tokensift.llm.tokens import slices
from tokensift.sources.tables import materialized

#: Words that no sentence goes on for.  A dense phrase stands at least once in DENSE words of its page and LEAST times, and
#: where it is met again within NEAR words, as it is not in a sentence said twice.
STRETCH, DENSE, LEAST, NEAR = 25, 40, 3, 8
GAPS = (1, 2)

_ANCHOR = re.compile(r"<a\s[^<>\x1d]{0,20}href\s*=\s*[\"']?([^\"'<>\s\x1d]*)[^<>\x1d]{0,200}>", re.I)
_ONE_WORD = re.compile(r"(?:https?:|www\.)[^\s\x1d<>\[\]|]+|\[/?url[^\]\x1d]{0,200}\]|(?<![\w&])#\w[^\s\x1d#]*", re.I)
_END = re.compile(r"[.?!…。！？](?![\w/])")
#: Sound descriptions; in round brackets only at an end of a line, for inside one they may spell out an address.
_SOUNDS = re.compile(r"\[(?!/?url)[^\[\]\x1d]{1,80}\]|\*[^*\n\x1d]{1,60}\*|(?<=[\n|\x1d])[ \t\-]*\([^()\x1d]{1,80}\)|\([^()\x1d]{1,80}\)(?=[ \t]*(?:[\n|\x1d]|\Z))")
_LINK = np.uint64(0x6C696E6B)


class Stream:
    """The words of texts with what the evidence needs: hash, letters, text and whether each is list-like."""

    def __init__(self, texts: list[str]):
        whole = _SOUNDS.sub(" ", MARKUP.sub(" ", _ANCHOR.sub(lambda m: f" www.{m[1]} ", joined(texts))))
        w = words(whole)
        self.n_texts, self.hash, self.letters, self.text = len(texts), w.hash, w.letters, w.text
        n = len(w.hash)
        stretch = np.searchsorted(np.fromiter((m.start() for m in _END.finditer(whole)), np.int64), w.start)
        of = np.cumsum(np.append(True, (stretch[1:] != stretch[:-1]) | (w.text[1:] != w.text[:-1]))[:n]) - 1
        self.listed = (np.bincount(of)[of] > STRETCH) if n else np.zeros(0, bool)
        long = np.bincount(w.text, minlength=len(texts)) > STRETCH
        spans = np.array([m.span() for m in _ONE_WORD.finditer(whole)], np.int64).reshape(-1, 2)
        if len(spans):
            of = np.searchsorted(spans[:, 0], w.start, "right") - 1
            inside = np.flatnonzero((of >= 0) & (w.start < spans[np.maximum(of, 0), 1]))
            if len(inside):
                first = np.append(True, of[inside][1:] != of[inside][:-1])
                head, keep = inside[first], np.ones(len(w.hash), bool)
                keep[inside[~first]] = False
                self.letters = w.letters.copy()
                self.letters[head] = np.add.reduceat(w.letters[inside], np.flatnonzero(first))
                self.hash[head] = _LINK
                self.hash, self.letters, self.text, self.listed = self.hash[keep], self.letters[keep], self.text[keep], self.listed[keep]
        n = len(self.hash)
        self.ends = np.searchsorted(self.text, np.arange(self.n_texts + 1))
        self.phrases = []
        sizes = np.diff(self.ends)
        for gap in GAPS:
            at = np.flatnonzero(self.text[:-gap] == self.text[gap:]) if n > gap else np.zeros(0, np.int64)
            value = scrambled(scrambled(self.hash[at] + np.uint64(gap)) + self.hash[at + gap])
            key = scrambled(value ^ scrambled(self.text[at].astype(np.uint64)))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            group = np.concatenate([[0], np.cumsum(~same)]) if len(at) else at
            one = order[np.append(True, ~same)] if len(at) else at
            inverse = np.empty(len(at), np.int64)
            inverse[order] = group
            near, close = np.zeros(len(at), bool), same & (np.diff(at[order]) <= NEAR)
            near[order[1:][close]] = near[order[:-1][close]] = True
            count, text = np.bincount(inverse, minlength=len(one)), self.text[at[one]]
            dense = at[near & (long[text] & (count >= np.maximum(LEAST, sizes[text] / DENSE)))[inverse]]
            for j in range(gap + 1):
                self.listed[dense + j] = True
            self.phrases.append((at, value, one, inverse))

    def total(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, weights=x, minlength=self.n_texts).astype(np.int64)

    def phrase_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every phrase of every text once: its value, text, and whether it is list-like there at least once."""
        out = []
        for gap, (at, value, one, inverse) in zip(GAPS, self.phrases):
            listed = np.bincount(inverse, weights=self.listed[at] & self.listed[at + gap], minlength=len(one)) > 0
            out.append((value[one], self.text[at[one]], listed))
        return tuple(np.concatenate(x) for x in zip(*out))

    def shingles(self, i: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The distinct phrases of a text, and for every gap the place in them of the phrase that begins at each word."""
        own = []
        for at, value, _, _ in self.phrases:
            low, high = np.searchsorted(at, (self.ends[i], self.ends[i + 1]))
            own.append(value[low:high])
        values, inverse = np.unique(np.concatenate(own), return_inverse=True)
        return values, np.split(inverse, np.cumsum([len(x) for x in own])[:-1])


def covered(n: int, known: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """Of ``n`` words those that a known phrase covers, the word in its gap included."""
    out = np.zeros(n, bool)
    for gap, place in zip(GAPS, places):
        hit = np.flatnonzero(known[place])
        for j in range(gap + 1):
            out[hit + j] = True
    return out


_PAGE = "uid bigint, n_words bigint, letters bigint, list_letters bigint, phrases array<bigint>, first array<int>, second array<int>, sizes array<int>"
_PHRASE = "phrase bigint, host string, n_list bigint, n_sentence bigint"


def page_shapes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """Two kinds of rows from one pass over the texts, written to a table.

    Pages (``uid`` is not null): letters and list-like letters, and the phrases of those that are mostly list-like.  Phrases:
    what each task has counted, by host for list-like parts and with host null for sentences; a page of unknown host counts
    for no host.  Null and empty texts have no words.
    """
    ship(df.sparkSession)
    kind, arrow_kind = df.schema[id_column].dataType.simpleString(), to_arrow_type(df.schema[id_column].dataType)
    names = ["id", *(c.split()[0] for c in f"{_PAGE}, {_PHRASE}".split(", "))]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    schema = pa.schema(list(zip(names, [arrow_kind, *[pa.int64()] * 4, longs, ints, ints, ints, pa.int64(), pa.string(), pa.int64(), pa.int64()])))

    def filled(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, held, size = TaskContext.get().partitionId() << 40, [], 0

        def summed():
            return pa.concat_tables(held).group_by(["phrase", "host"]).aggregate([("n_list", "sum"), ("n_sentence", "sum")]).rename_columns(["phrase", "host", "n_list", "n_sentence"])

        for batch in batches:
            hosts = batch.column(1)
            for at, texts in slices(batch.column(2)):
                s, n = Stream(texts), len(texts)
                letters, listed = s.total(s.letters), s.total(s.letters * s.listed)
                arrays = {c: [None] * n for c in ("phrases", "first", "second", "sizes")}
                for i in np.flatnonzero(2 * listed > letters).tolist():
                    values, places = s.shingles(i)
                    arrays["phrases"][i], arrays["first"][i], arrays["second"][i], arrays["sizes"][i] = values.view(np.int64), *places, s.letters[s.ends[i] : s.ends[i + 1]]
                yield filled({"id": batch.column(0).slice(at, n), "uid": pa.array(uid + np.arange(n)), "n_words": pa.array(np.diff(s.ends)), "letters": pa.array(letters), "list_letters": pa.array(listed)}
                             | {c: pa.array(v, schema.field(c).type) for c, v in arrays.items()}, n)
                uid += n
                value, text, in_list = s.phrase_counts()
                own = hosts.slice(at, n).take(pa.array(np.where(in_list, text, 0), mask=~in_list))
                held.append(pa.table({"phrase": pa.array(value.view(np.int64)), "host": own, "n_list": pa.array(in_list.astype(np.int64)), "n_sentence": pa.array((~in_list).astype(np.int64))}))
                size += len(value)
                if size > 2_000_000:
                    held = [summed()]
                    size = len(held[0])
                    if size > 1_000_000:  # memory stays bounded; what is sent early is added up later
                        for b in held[0].combine_chunks().to_batches():
                            yield filled(dict(zip(b.schema.names, b.columns)), len(b))
                        held, size = [], 0
        if held:
            for b in summed().combine_chunks().to_batches():
                yield filled(dict(zip(b.schema.names, b.columns)), len(b))

    texts = df.select(F.col(id_column).alias("id"), F.col(host_column).cast("string").alias("host"), F.make_valid_utf8(F.col(text_column)).alias("text"))
    return materialized(spread(texts).mapInArrow(run, f"id {kind}, {_PAGE}, {_PHRASE}"), "pages")


def stuffing(shapes: DataFrame, hosts: int = 3) -> DataFrame:
    """``phrase, n_pages``: phrases in list-like parts of pages on at least ``hosts`` hosts, and on no fewer pages than in sentences."""
    by_host = shapes.where("uid IS NULL").groupBy("phrase", "host").agg(F.sum("n_list").alias("n_list"), F.sum("n_sentence").alias("n_sentence"))
    counts = by_host.groupBy("phrase").agg(F.count_if(F.col("host").isNotNull()).alias("hosts"), F.sum("n_list").alias("n_pages"), F.sum("n_sentence").alias("n_sentence"))
    return counts.where((F.col("hosts") >= hosts) & (F.col("n_pages") >= F.col("n_sentence"))).select("phrase", "n_pages")


def page_scores(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", hosts: int = 3) -> DataFrame:
    """``<id>, n_words, list_share, stitched_share`` of every row that has any word: shares of its letters.

    ``stitched_share`` is asked for pages whose list-like letters are more than half, and 0 for the others.  Equal ids with
    equal texts give equal rows; an empty table gives an empty one.
    """
    shapes = page_shapes(df, id_column, text_column, host_column)
    id_kind = shapes.schema["id"].dataType.simpleString()
    pages = shapes.where("n_words > 0").select("uid", "id", "n_words", (F.col("list_letters") / F.col("letters")).alias("list_share"), "phrases", "first", "second", "sizes")
    known = materialized(stuffing(shapes, hosts), "stuffing")
    own = pages.where("phrases IS NOT NULL").select("uid", F.explode("phrases").alias("phrase"))
    found = split_join(own, known, ["phrase"], "n_pages").groupBy("uid").agg(F.collect_list("phrase").alias("known"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases, first, second, sizes, known_ = (batch.column(i) for i in range(3, 8))
            shares = []
            for i in range(len(batch)):
                a, b, c, d, e = (x[i].values.to_numpy(zero_copy_only=False) for x in (phrases, first, second, sizes, known_))
                shares.append(float(d[covered(len(d), np.isin(a, e), [b, c])].sum() / d.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shares, pa.float64())], names=["id", "n_words", "list_share", "stitched_share"])

    stitched = pages.join(found, "uid").select("id", "n_words", "list_share", "phrases", "first", "second", "sizes", "known")
    stitched = stitched.mapInArrow(cover, f"id {id_kind}, n_words bigint, list_share double, stitched_share double")
    rest = pages.join(found, "uid", "left_anti").select("id", "n_words", "list_share", F.lit(0.0).alias("stitched_share"))
    return stitched.unionByName(rest).withColumnRenamed("id", id_column)


def spam_pages(scores: DataFrame) -> DataFrame:
    """The rows of ``scores`` that are spam: mostly list-like, and mostly stitched from stuffing phrases."""
    return scores.where((F.col("list_share") > 0.5) & (F.col("stitched_share") > 0.5))
