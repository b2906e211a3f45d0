"""Frequency of every distinct term: burst-trie counting.

1. Every task inserts its terms into a burst trie.  A container holds suffixes under a prefix with their counters; one that
   outgrows ``burst`` entries bursts: its prefix grows by all that its terms have in common, then they part by the next
   character.  So a node is never deeper than its terms need, however long a prefix they share.  The containers are written
   to a table: the terms are aggregated once and the table stands for them from there on.
2. The tasks mark every ``STEP``-th of their terms by the shortest prefix that parts it from the one before it.  From the marks
   of all tasks come the prefixes at which one route ends and the next begins, as many as the data ask for, so that every
   route has about the same share of all entries; only a single term cannot be divided.
3. Containers are cut where a route ends and go to their route's task in the order of their prefixes, where subtrees of all
   tasks that match are merged while they stream by: a term is done once the prefixes have passed it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokensift.llm.shipping import ship
from tokensift.sources.tables import materialized

#: Entries from one mark of a task to the next.
STEP = 512
_NAMES = ["term", "occurrences", "n_rows"]
_CONTAINER = "prefix string, suffixes array<string>, occurrences array<bigint>, n_rows array<bigint>"


def _summed(tables: list[pa.Table]) -> pa.Table:
    """Counters added up by term; columns that cannot be null in one table may be nullable in another."""
    return pa.concat_tables(tables, promote_options="default").group_by("term").aggregate([("occurrences", "sum"), ("n_rows", "sum")]).rename_columns(_NAMES)


class BurstTrie:
    """Occurrence and row counters of strings.

    Entries are kept as sorted runs; the nodes are found when the containers are asked for, by bursting whole runs from the
    root, which gives the nodes that inserting one by one gives.
    """

    def __init__(self, burst: int = 512, compact: int = 500_000):
        self.burst, self.compact, self.held, self.size = burst, compact, [], 0

    def add(self, batch: pa.Table) -> None:
        """Insert term, occurrences, n_rows; terms may repeat."""
        self.held.append(batch)
        self.size += len(batch)
        if self.size > 2 * self.compact:
            self.held = [_summed(self.held)]
            self.size = len(self.held[0])

    @property
    def full(self) -> bool:
        return self.size > self.compact and len(self.held) == 1

    def sorted(self) -> pa.Table:
        if not self.held:
            return pa.table({"term": pa.array([], pa.string()), "occurrences": pa.array([], pa.int64()), "n_rows": pa.array([], pa.int64())})
        return _summed(self.held).sort_by("term").combine_chunks()

    def containers(self, terms: list[str]) -> Iterator[tuple[int, int, int]]:
        """Of ascending distinct ``terms``: begin, end and length of the prefix of every container, in order."""
        stack = [(0, len(terms))] if terms else []
        while stack:
            low, high = stack.pop()
            shared = len(commonprefix((terms[low], terms[high - 1])))
            if high - low <= self.burst:
                yield low, high, shared
                continue
            cuts, at = [], low
            while at < high:
                cuts.append(at)
                head = terms[at][: shared + 1]
                if len(head) == shared:  # the term that ends at this node
                    at += 1
                else:
                    at = high if head[-1] == chr(0x10FFFF) else bisect_left(terms, head[:-1] + chr(ord(head[-1]) + 1), at, high)
            stack += reversed(list(zip(cuts, [*cuts[1:], high])))


def routes_of(bounds: list[str], first: str, last: str) -> tuple[int, int]:
    """The routes of two terms; route i holds the terms from ``bounds[i]`` on, and ``bounds[0]`` is ''."""
    return bisect_right(bounds, first) - 1, bisect_right(bounds, last) - 1


def trie_containers(counted: DataFrame, burst: int = 512) -> DataFrame:
    """The containers of every task's trie, and in ``marks`` what the task knows of the spread of its terms."""

    def emit(trie: BurstTrie) -> pa.RecordBatch:
        table = trie.sorted()
        column = table["term"].combine_chunks() if table["term"].num_chunks != 1 else table["term"].chunk(0)
        terms = column.to_pylist()
        nodes = list(trie.containers(terms))
        marked = [terms[i][: len(commonprefix((terms[i - 1], terms[i]))) + 1] if i else "" for i in range(0, len(terms), STEP)]
        starts = np.array([n[0] for n in nodes], np.int64)
        offsets = pa.array(np.append(starts, len(terms)).astype(np.int32))
        mark_offsets = pa.array(np.append(-(-starts // STEP), len(marked)).astype(np.int32))
        suffixes = [pc.utf8_slice_codeunits(column.slice(low, high - low), shared) for low, high, shared in nodes]
        flat = pa.concat_arrays(suffixes) if suffixes else pa.array([], pa.string())
        numbers = [pa.ListArray.from_arrays(offsets, pa.array(table[c].to_numpy())) for c in _NAMES[1:]]
        return pa.RecordBatch.from_arrays(
            [pa.array([terms[low][:shared] for low, _, shared in nodes], pa.string()), pa.ListArray.from_arrays(offsets, flat), *numbers, pa.ListArray.from_arrays(mark_offsets, pa.array(marked, pa.string()))],
            names=["prefix", "suffixes", *_NAMES[1:], "marks"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(burst)
        for batch in batches:
            trie.add(pa.Table.from_batches([batch]))
            if trie.full:  # memory stays bounded however many terms a task meets; the merge adds up
                yield emit(trie)
                trie = BurstTrie(burst)
        yield emit(trie)

    ship(counted.sparkSession)
    return materialized(counted.mapInArrow(build, f"{_CONTAINER}, marks array<string>"), "containers")


def route_bounds(containers: DataFrame, entries: int = 1 << 18) -> list[str]:
    """The prefixes at which routes begin: ranges of the marks, for routes of about ``entries`` entries.

    There are no fewer routes than shuffle partitions; one string for each reaches the driver.
    """
    marks = containers.select(F.explode("marks").alias("mark"))
    least = int(containers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-marks.count() * STEP // entries))
    firsts = marks.repartitionByRange(n, "mark").groupBy(F.spark_partition_id().alias("range")).agg(F.min("mark").alias("mark")).collect()
    return ["", *sorted(r["mark"] for r in firsts)[1:]]


def trie_counts(counted: DataFrame, entries: int = 1 << 18, burst: int = 512) -> DataFrame:
    """``term, occurrences, n_rows``: the sums by term of ``counted`` (term, occurrences, n_rows).

    Null terms are left out; the empty string is a term; an empty table gives an empty one; null counters are 0.
    """
    counted = counted.where(F.col("term").isNotNull()).select(
        "term", F.coalesce(F.col("occurrences"), F.lit(0)).cast("bigint").alias("occurrences"), F.coalesce(F.col("n_rows"), F.lit(0)).cast("bigint").alias("n_rows"))
    containers = trie_containers(counted, burst)
    bounds = route_bounds(containers, entries)
    sent = counted.sparkSession.sparkContext.broadcast(bounds)  # one prefix for each task of the merge

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            lists = batch.column(1)
            starts, flat = lists.offsets.to_numpy().tolist(), lists.values
            routes, of, cuts = [], [], []
            for i, prefix in enumerate(batch.column(0).to_pylist()):
                low, high = starts[i], starts[i + 1]
                first, last = routes_of(own, prefix + flat[low].as_py(), prefix + flat[high - 1].as_py())
                terms = [prefix + x for x in flat.slice(low, high - low).to_pylist()] if first < last else []
                for r in range(first, last + 1):
                    at = low + bisect_left(terms, own[r]) if r > first else low
                    if r > first and at == cuts[-1]:
                        routes[-1] = r  # nothing of the container lies in the route before
                        continue
                    routes.append(r)
                    of.append(i)
                    cuts.append(at)
            offsets = pa.array(np.array([*cuts, starts[-1]], np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(routes, pa.int32()), batch.column(0).take(pa.array(of, pa.int64())), *(pa.ListArray.from_arrays(offsets, c.values) for c in batch.columns[1:])],
                names=["route", "prefix", "suffixes", *_NAMES[1:]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lists = batch.column(1)
            counts = np.diff(lists.offsets.to_numpy())
            prefixes = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), counts)))
            held.append(pa.table([pc.binary_join_element_wise(prefixes, lists.flatten(), ""), *(c.flatten() for c in batch.columns[2:])], names=_NAMES))
            size += len(held[-1])
            if size > 500_000:
                whole = _summed(held)
                passed = pc.less(whole["term"], batch.column(0)[len(batch) - 1])
                yield from whole.filter(passed).combine_chunks().to_batches()
                held = [whole.filter(pc.invert(passed))]
                size = len(held[0])
        if held:
            yield from _summed(held).combine_chunks().to_batches()

    routed = containers.select("prefix", "suffixes", "occurrences", "n_rows").mapInArrow(route, f"route int, {_CONTAINER}")
    ordered = routed.repartitionById(len(bounds), "route").drop("route").sortWithinPartitions("prefix")
    return ordered.mapInArrow(merge, "term string, occurrences bigint, n_rows bigint")


def term_frequencies(postings: DataFrame, entries: DataFrame, entries_by_route: int = 1 << 18, burst: int = 512) -> DataFrame:
    """``term, occurrences, n_rows`` of every distinct term of an index.

    ``postings``: row_group, term, postings; ``entries``: row_group, term, postings_count.  ``occurrences``: entries of the
    posting lists as they stand, repeats included.  ``n_rows``: distinct rows, the dictionary's counts once per row group
    and term.  A term known to only one side has 0 on the other; null terms and null lists count nowhere.
    """
    once = entries.where(F.col("term").isNotNull()).groupBy("row_group", "term").agg(F.max("postings_count").alias("n_rows"))
    seen = postings.where(F.col("term").isNotNull()).select("term", F.greatest(F.size("postings"), F.lit(0)).cast("bigint").alias("occurrences"), F.lit(0).cast("bigint").alias("n_rows"))
    counted = seen.unionByName(once.select("term", F.lit(0).cast("bigint").alias("occurrences"), "n_rows"))
    return trie_counts(counted, entries_by_route, burst)


def indexed_rows(postings: DataFrame) -> int:
    """The number of distinct row ids that have any term.

    Ids are gathered in sets of 64 as one number, which the tasks combine before the shuffle.
    """
    ids = postings.where(F.col("term").isNotNull()).select(F.explode("postings").alias("id")).where("id IS NOT NULL")
    sets = ids.groupBy(F.expr("id div 64 - CAST(id < 0 AND id % 64 <> 0 AS INT)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(id, 64) AS INT))")).alias("bits"))
    return sets.agg(F.sum(F.bit_count("bits")).alias("n")).first()["n"] or 0


def mark_terms(frequencies: DataFrame, total_rows: int, common_share: int = 10) -> DataFrame:
    """``frequencies`` with ``mark``: 'rare' for one row, 'common' for at least 1/``common_share`` of all rows, else null.

    A term that is both (a collection of few rows) is 'rare'.  A term without rows has no mark.
    """
    mark = F.when(F.col("n_rows") == 1, "rare").when((F.col("n_rows") > 0) & (F.col("n_rows") * common_share >= F.lit(total_rows)), "common")
    return frequencies.withColumn("mark", mark)
