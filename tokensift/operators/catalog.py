"""Tables and their indexes by name."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tokensift.errors import BindError, UnsupportedError
from tokensift.operators.index import ROW_GROUP_SIZE, InvertedIndex, check_key, check_row_group_size
from tokensift.operators.search import Predicate, search
from tokensift.sources.tables import shared_dir


@dataclass(frozen=True)
class IndexEntry:
    name: str
    table: str
    column: str
    index: InvertedIndex
    path: str
    non_ascii: str


class TokenEngine:
    """A session's tables, the indexes on them, and search over both."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self._folder = spark, folder
        self._tables: dict[str, tuple[DataFrame, str]] = {}
        self._indexes: dict[str, IndexEntry] = {}

    def register(self, name: str, df: DataFrame, id_column: str) -> None:
        """Make ``df`` known as ``name``, in SQL too; ``id_column`` is its unique row id.

        Indexes on another table of that name are dropped: they are snapshots of its rows.
        """
        if id_column not in df.columns:
            raise BindError(f"table {name} has no column {id_column}")
        for entry in [e for e in self._indexes.values() if e.table == name]:
            self.drop_index(entry.name)
        df.createOrReplaceTempView(name)
        self._tables[name] = df, id_column

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise BindError(f"table {name} does not exist")
        return self._tables[name][0]

    def create_index(
        self, name: str, table: str, column: str, *, if_not_exists: bool = False, unique: bool = False,
        row_group_size: int = ROW_GROUP_SIZE, non_ascii: str = "error", **options: object,
    ) -> None:
        """Build the index ``name`` on a string column of ``table``, from the rows as they are now."""
        if name in self._indexes:
            if if_not_exists:
                return
            raise BindError(f"index {name} already exists")
        df, id_column = self.table(table), self._tables[table][1]
        if unique:
            raise BindError("a token index cannot enforce a UNIQUE or PRIMARY KEY constraint")
        if options:
            raise BindError(f"a token index takes no options; {next(iter(options))!r} was given")
        key, size = check_key(df, column), check_row_group_size(row_group_size)
        path = f"{self._folder or shared_dir(self.spark)}/index-{uuid.uuid4().hex}"
        built = InvertedIndex.build(df, id_column, key, path, size, non_ascii)
        self._indexes[name] = IndexEntry(name, table, key, built, path, non_ascii)

    def drop_index(self, name: str, if_exists: bool = False) -> None:
        entry = self._indexes.pop(name, None)
        if entry is None:
            if if_exists:
                return
            raise BindError(f"index {name} does not exist")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(entry.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def index(self, name: str) -> InvertedIndex:
        if name not in self._indexes:
            raise BindError(f"index {name} does not exist")
        return self._indexes[name].index

    def indexes(self) -> DataFrame:
        """``index_name, table_name, column_name, is_unique``."""
        rows = [(e.name, e.table, e.column, False) for e in self._indexes.values()]
        return self.spark.createDataFrame(rows, "index_name string, table_name string, column_name string, is_unique boolean")

    def append(self, name: str, rows: DataFrame) -> None:
        raise UnsupportedError("an index is a snapshot: drop it and build it again over the changed table")

    delete = merge = append

    def search(self, table: str, column: str, tree: Predicate, non_ascii: str = "error", path: str = "auto") -> DataFrame:
        """The rows of ``table`` where ``tree`` holds for ``column``, by an index on it if there is one.

        An index that was built to skip texts outside ASCII cannot report one, so where that is an error it is not used.
        """
        df = self.table(table)
        fit = (e.index for e in self._indexes.values() if (e.table, e.column) == (table, column) and e.non_ascii in ("error", non_ascii))
        return search(df, self._tables[table][1], column, tree, next(fit, None), non_ascii, path)
