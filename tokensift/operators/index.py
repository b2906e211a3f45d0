"""The inverted index: for every row group and term the ascending row ids, as an ordinary table.

Columns ``row_group BIGINT, term STRING, row_ids ARRAY<BIGINT>, postings_count BIGINT``.  A posting list never outgrows its
row group, so no task gathers more than ``row_group_size`` ids of a term, however frequent the term is.  On disk the rows
are ranged by term, then row group: a lookup prunes to the files and pages whose statistics admit the term.
"""

from __future__ import annotations

from functools import cached_property
from pathlib import Path
from urllib.parse import urlsplit

from pyarrow import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokensift.errors import BindError, UnsupportedError
from tokensift.functions.analyzer import analyze

ROW_GROUP_SIZE = 122_880
MAX_ROW_GROUP_SIZE = (1 << 63) - 1


def check_row_group_size(size: object) -> int:
    if not isinstance(size, int) or isinstance(size, bool) or not 1 <= size <= MAX_ROW_GROUP_SIZE:
        raise BindError(f"row_group_size must be a whole number from 1 to {MAX_ROW_GROUP_SIZE}, not {size!r}")
    return size


def check_key(df: DataFrame, column: object) -> str:
    """The name of the one string column to index."""
    if isinstance(column, (list, tuple)):
        if len(column) != 1:
            raise UnsupportedError(f"an index covers exactly one column, not {len(column)}")
        column = column[0]
    if not isinstance(column, str) or column not in df.columns:
        raise UnsupportedError("an index is built on a column, named by a string; add expressions as columns first")
    kind = df.schema[column].dataType
    if not isinstance(kind, T.StringType):
        raise BindError(f"an index needs a string column; {column} is {kind.simpleString()}")
    return column


def build_index(df: DataFrame, id_column: str, text_column: str, row_group_size: int = ROW_GROUP_SIZE, non_ascii: str = "error", ranged: bool = False) -> DataFrame:
    """The index of ``text_column``; ``id_column`` holds the row's position, unique and not negative.

    Null texts and texts without terms have no postings and shift nobody's id; a term repeated in a row is one posting, as
    is a row that occurs twice.  A null or negative id, and (unless ``non_ascii='null'`` skips it) a non-ASCII text, is an
    error when the row is read.  An empty table gives an empty index.  ``ranged``: the postings are shuffled into ranges of
    terms, which grouping then needs no other shuffle for, nor sealing.
    """
    size, text = check_row_group_size(row_group_size), check_key(df, text_column)
    row_id = F.col(id_column).cast("bigint")
    row_id = F.when(row_id.isNull() | (row_id < 0), F.raise_error(F.lit("row ids must be whole numbers from 0")).cast("bigint")).otherwise(row_id)
    postings = df.where(F.col(text).isNotNull()).select(row_id.alias("row_id"), F.explode(F.array_distinct(analyze(text, non_ascii))).alias("term"))
    postings = postings.withColumn("row_group", F.expr(f"row_id div {size}"))
    if ranged:
        postings = postings.repartitionByRange("term", "row_group")
    return postings.groupBy("row_group", "term").agg(F.sort_array(F.collect_set("row_id")).alias("row_ids")).withColumn("postings_count", F.size("row_ids").cast("bigint"))


class InvertedIndex:
    """An index that is built: lookup, statistics and checks."""

    def __init__(self, table: DataFrame, row_group_size: int = ROW_GROUP_SIZE, path: str | None = None):
        self.table, self.row_group_size, self.path = table, row_group_size, path

    @classmethod
    def write(cls, index: DataFrame, path: str, row_group_size: int = ROW_GROUP_SIZE) -> InvertedIndex:
        """Seal ``index`` at ``path``."""
        ranged = index.repartitionByRange("term", "row_group").sortWithinPartitions("term", "row_group")
        ranged.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(path)
        return cls.open(index.sparkSession, path, row_group_size)

    @classmethod
    def build(cls, df: DataFrame, id_column: str, text_column: str, path: str, row_group_size: int = ROW_GROUP_SIZE, non_ascii: str = "error") -> InvertedIndex:
        """Build and seal in one shuffle: what the ranges are sampled from is the scan, not the lists."""
        built = build_index(df, id_column, text_column, row_group_size, non_ascii, ranged=True).sortWithinPartitions("term", "row_group")
        built.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(path)
        return cls.open(df.sparkSession, path, row_group_size)

    @classmethod
    def open(cls, spark: SparkSession, path: str, row_group_size: int = ROW_GROUP_SIZE) -> InvertedIndex:
        schema = "row_group bigint, term string, row_ids array<bigint>, postings_count bigint"
        return cls(spark.read.schema(schema).parquet(path), row_group_size, path)

    def lookup(self, term: str) -> DataFrame:
        """``row_id``, ascending, of the rows that contain an analyzed term; byte-wise, and none for the empty term."""
        return self.table.where(F.col("term") == F.lit(term)).select(F.explode("row_ids").alias("row_id")).orderBy("row_id")

    @cached_property
    def _files(self) -> dataset.Dataset | None:
        """The sealed files, if they lie in a folder that the driver can open itself."""
        at = urlsplit(self.path or "")
        return dataset.dataset(at.path, format="parquet") if at.path and at.scheme in ("", "file") and Path(at.path).is_dir() else None

    def groups_of(self, terms: list[str], most: int) -> dict[str, set[int]]:
        """The row groups of each term, but for terms in more than ``most`` of them; absent terms have none.

        At most ``len(terms) * (most + 1)`` small rows reach the driver.  It looks them up in the files where it can, for a job
        takes longer than that; statistics leave out all row groups of the files that cannot have the term.
        """
        if self._files is not None:
            out = {}
            for term in terms:
                found = self._files.scanner(columns=["row_group"], filter=dataset.field("term") == term, use_threads=False).head(most + 1)
                if len(found) <= most:
                    out[term] = set(found["row_group"].to_pylist())
            return out
        held = self.table.where(F.col("term").isin(terms))
        n = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()} if terms else {}
        few = [t for t in terms if 0 < n.get(t, 0) <= most]
        out = {t: set() for t in terms if t not in n or t in few}
        if few:
            for r in self.table.where(F.col("term").isin(few)).select("term", "row_group").collect():
                out[r["term"]].add(r["row_group"])
        return out

    def num_partitions(self) -> int:
        """Row groups with postings."""
        return self.table.select("row_group").distinct().count()

    def total_dictionary_size(self) -> int:
        """Dictionary entries of all row groups; a term counts in each."""
        return self.table.count()

    def partition_stats(self) -> DataFrame:
        """``row_group, num_terms, min_row_id, max_row_id``."""
        ends = F.min(F.element_at("row_ids", 1)), F.max(F.element_at("row_ids", -1))
        return self.table.groupBy("row_group").agg(F.count("*").alias("num_terms"), ends[0].alias("min_row_id"), ends[1].alias("max_row_id"))

    def violations(self) -> DataFrame:
        """``row_group, term, problem`` of every entry that breaks the index's rules; empty for a sound index."""
        ids, group = F.col("row_ids"), F.col("row_group")
        rising = F.size(F.filter(F.arrays_zip(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))).alias("a"), F.slice(ids, 2, F.size(ids)).alias("b")), lambda x: x["b"] <= x["a"])) == 0
        inside = (F.try_element_at(ids, F.lit(1)) >= group * self.row_group_size) & (F.try_element_at(ids, F.lit(-1)) < (group + 1) * self.row_group_size)
        rules = {
            "empty term": F.col("term") == "",
            "no row ids": F.size(ids) < 1,
            "row ids do not ascend": (F.size(ids) > 1) & ~rising,
            "row id outside its row group": (F.size(ids) > 0) & ~inside,
            "count differs from list": F.col("postings_count") != F.size(ids),
        }
        entry = self.table.select("row_group", "term", F.explode(F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())), lambda x: x.isNotNull())).alias("problem"))
        twice = self.table.groupBy("row_group", "term").count().where("count > 1").select("row_group", "term", F.lit("term occurs twice").alias("problem"))
        return entry.unionByName(twice)
