"""Filling fixed-capacity containers with items of varying length, without splitting any that fits.

Only lengths matter for the arrangement, and there are at most ``capacity`` of them. So the driver plans on the histogram of lengths:
it lists patterns of lengths that fill a container and how often each is used. Containers are completed by exact-complement hashing:
the sums of one, two and three available lengths are indexed, and a gap that is such a sum is filled by it; else the longest length that fits is taken (best
fit), and the new gap is looked up. A pattern is used as often as its scarcest length allows, so each step uses up a length and
the plan stays small however many items there are. The items then get their places in parallel: the rank of an item among those
of its length decides its pattern and container.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, hinted, ship

#: Folder of the public tokenizers' vocabularies, and the one used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Items of one length that are ranked by one task at most, about.
RANKED_TOGETHER = 500_000
# The pattern that splits text before the merges of this vocabulary: a fixed value that belongs to it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White-space characters in a row that are tokenized at once. The tokenizer's stack overflows somewhere beyond; other runs, however long, do not harm it.
LONGEST_RUN = 100_000


#: Fruitless steps of a search after which the index of sums is made anew.
STALE = 4000


class Lengths:
    """How many items of each length 1..capacity are still to be placed, with an index of the sums of one, two and three of them.

    The lengths at hand are bits of an integer, once by length and once by capacity - length, so the lengths whose complement is at hand too are one shift and
    one conjunction away. Which sums exist at all is indexed for every gap at once, by convolution. Lengths only run out, so a sum that is not in the
    index cannot come back; one that is may be gone, which the search notices, and after STALE such steps the index is made anew.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, [0] * (capacity + 1)
        for length, n in histogram.items():
            if not 1 <= length <= capacity:
                raise ValueError(f"a length of {length} does not lie in 1..{capacity}")
            self.left[length] += n
        self.have = sum(1 << x for x in histogram if self.left[x])
        self.mirror = sum(1 << (capacity - x) for x in histogram if self.left[x])
        self.index()

    def index(self) -> None:
        """Which gaps are sums of two and of three lengths at hand."""
        size = 1 << (3 * self.capacity).bit_length()
        wave = np.fft.rfft(np.array([n > 0 for n in self.left], dtype="float64"), size)
        # a convolution of zeros and ones counts the ways to make a sum; only whether there is one matters
        twice = np.fft.irfft(wave * wave, size)[: self.capacity + 1] > 0.5
        again = np.fft.rfft(twice.astype("float64"), size)
        self.sums = (twice.tolist(), (np.fft.irfft(wave * again, size)[: self.capacity + 1] > 0.5).tolist())
        self.wasted = 0

    def take(self, length: int, n: int = 1) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.have ^= 1 << length
            self.mirror ^= 1 << (self.capacity - length)

    def give_back(self, length: int) -> None:
        if not self.left[length]:
            self.have ^= 1 << length
            self.mirror ^= 1 << (self.capacity - length)
        self.left[length] += 1

    def longest(self, gap: int) -> int:
        """The longest available length up to gap, or 0."""
        return max((self.have & ((2 << gap) - 1)).bit_length() - 1, 0)

    def pair(self, gap: int) -> tuple[int, ...]:
        """Two available lengths that add up to gap, the longer as long as possible; () if none do."""
        if not self.sums[0][gap]:
            return ()
        long = (self.have & (self.mirror >> (self.capacity - gap))).bit_length() - 1
        if 2 * long > gap or (2 * long == gap and self.left[long] > 1):
            return (long, gap - long)
        self.wasted += 1
        return ()

    def exactly(self, gap: int) -> tuple[int, ...]:
        """One, two or three available lengths that add up to gap; () if none do."""
        if self.left[gap]:
            return (gap,)
        if found := self.pair(gap):
            return found
        if self.wasted > STALE:
            self.index()
        if self.sums[1][gap]:
            c = self.longest(gap - 2)
            while 3 * c >= gap:  # the longest of three is at least a third
                self.take(c)
                found = self.pair(gap - c)
                self.give_back(c)
                if found:
                    return (c, *found)
                self.wasted += 1
                c = self.longest(c - 1)
        return ()


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how many of it in a container) and how many containers follow each, using every item once."""
    lengths, patterns = Lengths(histogram, capacity), []
    while first := lengths.longest(capacity):
        chosen, gap = [first], capacity - first
        lengths.take(first)
        while gap:
            more = lengths.exactly(gap) or ((best,) if (best := lengths.longest(gap)) else ())
            if not more:
                break
            for x in more:
                lengths.take(x)
                gap -= x
            chosen += more
        pattern = {x: chosen.count(x) for x in sorted(set(chosen), reverse=True)}
        again = min(lengths.left[x] // k for x, k in pattern.items())
        if again:
            for x, k in pattern.items():
                lengths.take(x, again * k)
        patterns.append((pattern, again + 1))
    return patterns


def token_counts(df: DataFrame, key: str, text: str, directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): the number of tokens of each whole text; null and empty texts have 0.

    The vocabulary is read by the driver and sent to the workers (about 1 MB). Only inside a run of more than LONGEST_RUN white-space characters is a text cut; all else is encoded as it stands, so the count can differ
    from the uncut text's by a token or so per cut.
    """

    with open(f"{directory}/{vocabulary}", "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator) -> Iterator:
        import base64
        import re

        import pyarrow as pa
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        blank = re.compile(r"\s\s+")

        def size(text: str | None) -> int:
            if not text:
                return 0
            if len(text) <= LONGEST_RUN:
                return len(encoder.encode_ordinary(text))
            # each cut leaves white space on both sides, so the last of a run still joins the word after it
            cuts = [at for m in blank.finditer(text) for at in range(m.start() + LONGEST_RUN, m.end(), LONGEST_RUN)]
            return sum(len(encoder.encode_ordinary(text[a:b])) for a, b in zip([0, *cuts], [*cuts, len(text)]))

        for batch in batches:
            sizes = [size(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], [key, "n_tokens"])

    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(count, f"`{key}` {kind}, n_tokens bigint")


def pack(sizes: DataFrame, key: str, capacity: int, size: str = "n_tokens") -> DataFrame:
    """(key, piece, start, length, container): the container of every item, and of every piece of items beyond the capacity.

    An item of at most ``capacity`` has one piece (0) that starts at 0. A longer one is cut into pieces of the capacity and a
    rest, wherever they go. Containers are numbered from 0 and hold at most ``capacity``. Items of size 0 or null take no room: length 0,
    container null. Ties (same length) are placed in the order of a hash of key and piece, so repeated runs agree; repeated keys are items of
    their own. An empty table gives no rows. Further columns of ``sizes`` are not read.
    """
    if capacity < 1:
        raise ValueError("a container must hold at least 1")
    ship(sizes.sparkSession)
    whole = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    last = F.greatest(F.ceil(whole / capacity) - 1, F.lit(0)).cast("int")
    items = sizes.select(F.col(key), whole.alias("_size"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    items = cut(items.select(key, "piece", start.alias("start"), F.least(F.col("_size") - start, F.lit(capacity)).cast("int").alias("length")))
    histogram = {r["length"]: r["n"] for r in items.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    patterns = plan(histogram, capacity)

    # every item's place in the order by length: the lengths' first places, then a rank within length by salted parts
    ordered = sorted(histogram)
    place = dict(zip(ordered, accumulate([0, *(histogram[x] for x in ordered)])))
    starts, bases, times = _slots(patterns, place)
    salts = max(1, -(-max(histogram.values(), default=0) // RANKED_TOGETHER))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    parts = salted.where("length > 0").groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    offsets = parts.withColumn("_offset", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.where("length > 0").withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(key, "piece")) - 1)
    ranked = ranked.join(hinted(offsets), ["length", "_salt"])
    slots = items.sparkSession.sparkContext.broadcast((ordered, np.array([place[x] for x in ordered]), starts, bases, times))  # grows with the capacity alone

    @F.pandas_udf("bigint")
    def container(length, rank):
        import pandas as pd

        ordered, first, starts, bases, times = slots.value
        at = first[np.searchsorted(ordered, length.to_numpy())] + rank.to_numpy()
        slot = np.searchsorted(starts, at, side="right") - 1
        return pd.Series(bases[slot] + (at - starts[slot]) % times[slot])

    placed = ranked.select(key, "piece", "start", "length", container("length", F.col("_rank") + F.col("_offset")).alias("container"))
    return placed.unionByName(items.where("length = 0").select(key, "piece", "start", "length", F.lit(None).cast("bigint").alias("container")))


def _slots(patterns: list[tuple[dict[int, int], int]], place: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of places in the order by length: where each run starts, its first container and how many containers it goes round."""
    used, runs, base = dict.fromkeys(place, 0), [], 0
    for pattern, n in patterns:
        for x, k in pattern.items():
            runs.append((place[x] + used[x], base, n))
            used[x] += k * n
        base += n
    runs.sort()
    return tuple(np.array(column, dtype="int64") for column in zip(*runs)) if runs else (np.zeros(0, "int64"),) * 3  # type: ignore[return-value]


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """(container, n_pieces, filled, unused): how full each container is."""
    used = packed.where("container IS NOT NULL").groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("filled"))
    return used.withColumn("unused", F.lit(capacity) - F.col("filled"))
