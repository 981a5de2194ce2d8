"""Items that appear together: counts of item pairs over baskets by a blocked Gram matrix.

Baskets become rows of a binary matrix X, held sparse (offsets and item numbers). Its Gram matrix X'X has the item counts
on the diagonal and the pair counts beside it, and is the sum of the Gram matrices of blocks of records. Each task
numbers the items by how often its first records have them. The frequent ones, the head, are multiplied as dense blocks; columns beyond
are multiplied in sparse form, as coordinates that are added up. A task sends one row per pair it saw: pairs of single records are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

#: Items of the head, and records of a block.
HEAD, BLOCK = 1024, 4096
#: Coordinates of rare items that a task expands at once, and that it holds before it sends what they add up to.
COORDINATES = 2_000_000


def baskets(df: DataFrame, record: str, item: str) -> DataFrame:
    """(items array<string>), one row per record: its distinct non-null items. Records without any are left out.

    The sets are reduced on the map side, so a record with very many rows sends each item once per task, and none is
    larger than the number of different items. Rows with a null record belong to no record and are left out.
    """
    rows = df.where(F.col(record).isNotNull() & F.col(item).isNotNull())
    return rows.groupBy(F.col(record).alias("_record")).agg(F.collect_set(F.col(item).cast("string")).alias("items")).select("items")


def _gram(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    number: dict[str, int] = {}
    names: list[str] = []
    dense = np.zeros((0, 0), dtype="int64")
    sparse: list[tuple] = []
    records = held = 0

    def rows(first, second, n) -> Iterator:
        for start in range(0, len(n), 100_000):
            part = slice(start, start + 100_000)
            ends = [sorted((names[p], names[q])) for p, q in zip(first[part].tolist(), second[part].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], pa.string()), pa.array([y for _, y in ends], pa.string()), pa.array(n[part])], ["a", "b", "n"])

    def summed() -> tuple:
        codes, at = np.unique(np.concatenate([c for c, _ in sparse]), return_inverse=True)
        return codes, np.bincount(at, weights=np.concatenate([n for _, n in sparse]), minlength=len(codes)).astype("int64")

    def coordinates(row, column, start, length) -> Iterator:
        """The products of rare columns with all columns up to them, in pieces of bounded size."""
        nonlocal held
        rare = np.flatnonzero(column >= HEAD)
        upto = np.cumsum(length[row[rare]])
        piece = np.flatnonzero(np.diff(upto // COORDINATES)) + 1
        for entries in np.split(rare, piece):
            many = length[row[entries]]
            own = np.repeat(column[entries], many)
            other = column[np.repeat(start[row[entries]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            kept = other <= own
            codes, n = np.unique(own[kept] << 32 | other[kept], return_counts=True)
            sparse.append((codes, n))
            held += len(codes)
            if held > COORDINATES:
                sparse[:] = [summed()]
                held = len(sparse[0][0])
                if 2 * held > COORDINATES:
                    yield from rows(sparse[0][0] >> 32, sparse[0][0] & 0xFFFFFFFF, sparse[0][1])
                    sparse.clear()
                    held = 0

    for batch in batches:
        lists = batch.column(0)
        coded = lists.flatten().dictionary_encode()
        seen, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        for k in np.argsort(-np.bincount(index, minlength=len(seen)), kind="stable").tolist():
            if seen[k] not in number:
                number[seen[k]] = len(names)
                names.append(seen[k])
        own = np.array([number[x] for x in seen], dtype="int64")
        columns = own[index] if len(own) else np.zeros(0, dtype="int64")
        lengths = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(lengths)
        records += len(lists)
        width = min(HEAD, len(names))
        if width > len(dense):
            grown = np.zeros((width, width), dtype="int64")
            grown[: len(dense), : len(dense)] = dense
            dense = grown
        for low in range(0, len(lists), BLOCK):
            length = lengths[low : low + BLOCK]
            base = ends[low] - lengths[low]
            column = columns[base : base + length.sum()]
            row = np.repeat(np.arange(len(length)), length)
            x = np.zeros((len(length), width), dtype="float32")
            frequent = column < HEAD
            x[row[frequent], column[frequent]] = 1
            dense += (x.T @ x).astype("int64")  # a block has far fewer than 2**24 records: exact
            if not frequent.all():
                yield from coordinates(row, column, np.cumsum(length) - length, length)
    a, b = np.nonzero(np.triu(dense))
    yield from rows(a, b, dense[a, b])
    if sparse:
        codes, n = summed()
        yield from rows(codes >> 32, codes & 0xFFFFFFFF, n)
    if records:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([records], pa.int64())], ["a", "b", "n"])


def pair_counts(sets: DataFrame) -> DataFrame:
    """(a, b, n) with a <= b by code point: n records have both; a = b counts the item; a = b = null counts the records.

    sets: one array of distinct non-null items per record, as from baskets(). An empty table gives no rows.
    """
    ship(sets.sparkSession)
    return sets.select("items").mapInArrow(_gram, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def co_occurrence(df: DataFrame, record: str, item: str) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift) of every pair of items that share a record, item_a < item_b by code point.

    n counts records with at least one item; lift = n_ab * n / (n_a * n_b), 1.0 being chance. Null records and null items
    are left out, repeated rows count once per record, blank items are items like others. An empty table gives no rows.
    """
    counts = cut(pair_counts(baskets(df, record, item)))
    single = counts.where("a = b")
    total = counts.where("a IS NULL").select(F.col("n").alias("n_records"))
    pairs = counts.where("a < b").select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.col("n").alias("n_ab"))
    n = (total.first() or (0,))[0]
    return (
        pairs.join(single.select(F.col("a").alias("item_a"), F.col("n").alias("n_a")), "item_a")
        .join(single.select(F.col("a").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        .withColumn("n", F.lit(n).cast("bigint"))
        .withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", "lift")
    )


def clearly_together(pairs: DataFrame, min_count: int = 3, per_mille: int = 1, times: int = 3) -> DataFrame:
    """The pairs found at least ``min_count`` times, in at least ``per_mille`` of 1000 records and ``times`` as often as chance; in integers throughout."""
    return pairs.where(
        (F.col("n_ab") >= min_count)
        & (1000 * F.col("n_ab") >= per_mille * F.col("n"))
        & (F.col("n_ab").cast("decimal(38,0)") * F.col("n") >= F.lit(times).cast("decimal(3,0)") * F.col("n_a").cast("decimal(17,0)") * F.col("n_b").cast("decimal(17,0)"))
    )
