"""Evaluation texts leaking into training text, found by greedy string tiling over words.

Both sides are read as words: maximal runs of letters and digits, without case and accents. Runs of ``min_words`` words of the
test items are the seeds, hashed by a rolling polynomial (Karp-Rabin). Each document is hashed once in the same way and
probes the seeds; matching seeds on one diagonal form maximal matches, and of these the longest that touches no marked word is
marked again and again (tiles), so that reordered passages count and no word counts twice. The test items are the query set. Up to a bound they go to
the documents, which then never move. Beyond it, documents and items meet by the hashes of their runs: a filter of bounded size lets pass
the runs that items may have, hashes that very many documents share are split, and only the texts of pairs that share a hash are brought together and tiled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.skew import heavy_keys, salted_join
from ..session import cut, ship

#: Characters of test items that go to the documents at most; more meet them by the hashes of their runs.
BLOCK_CHARS = 32_000_000
#: Bits of the filter that keeps runs no item has from moving (a whole number of the 32,768-bit pieces that Spark makes).
FILTER_BITS = 1 << 28
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """The words of a text: maximal runs of letters and digits, case folded and without accents; null has none."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return _WORD.findall(text.casefold())


def rolling(numbers: np.ndarray, length: int) -> np.ndarray:
    """The hashes of all runs of ``length`` numbers."""
    n = len(numbers) - length + 1
    if n <= 0:
        return np.zeros(0, dtype="uint64")
    mixed = (numbers.astype("uint64") + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    found = np.zeros(n, dtype="uint64")
    for k in range(length):
        found = found * _BASE + mixed[k : k + n]
    return found


class Items:
    """Test items as word numbers, and their seeds sorted by hash."""

    def __init__(self, rows: list[tuple], min_words: int):
        self.min_words, self.ids, self.number = min_words, [], {}
        self.words, hashes, of, at = [], [], [], []
        for key, text in rows:
            found = words(text)
            if len(found) < min_words:
                continue
            numbers = np.array([self.number.setdefault(w, len(self.number)) for w in found], dtype="int64")
            own = rolling(numbers, min_words)
            hashes.append(own)
            of.append(np.full(len(own), len(self.ids)))
            at.append(np.arange(len(own)))
            self.ids.append(key)
            self.words.append(numbers)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        hashes, of, at = join(hashes, "uint64"), join(of, "int64"), join(at, "int64")
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.of, self.at = hashes[order], of[order], at[order]

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(text, item, tiles) of every text and item that share a run; a tile is (place in the item, place in the text, words)."""
        get, numbers, bounds = self.number.get, [], [0]
        for text in texts:
            numbers += [get(w, -1) for w in words(text)]
            numbers.append(-1)
            bounds.append(len(numbers))
        stream = np.array(numbers, dtype="int64")
        known = np.concatenate([[0], np.cumsum(stream < 0)])
        n = len(stream) - self.min_words + 1
        if n <= 0 or not len(self.hashes):
            return
        possible = np.flatnonzero(known[self.min_words :] == known[:n])  # runs of words that all occur in some item
        if not len(possible):
            return
        run = rolling(stream, self.min_words)[possible]
        low, high = np.searchsorted(self.hashes, run, "left"), np.searchsorted(self.hashes, run, "right")
        many = high - low
        places = np.repeat(possible, many)
        if not len(places):
            return
        seeds = np.repeat(low, many) + (np.arange(len(places)) - np.repeat(np.cumsum(many) - many, many))
        text_of = np.searchsorted(bounds, places, side="right") - 1
        item_of, item_at = self.of[seeds], self.at[seeds]
        order = np.lexsort((item_of, text_of))
        cuts = np.flatnonzero((np.diff(text_of[order]) != 0) | (np.diff(item_of[order]) != 0)) + 1
        for group in np.split(order, cuts):
            t, i = int(text_of[group[0]]), int(item_of[group[0]])
            start = bounds[t]
            tiles = tile(self.words[i], stream[start : bounds[t + 1] - 1], item_at[group], places[group] - start, self.min_words)
            if tiles:
                yield t, i, tiles


def tile(item: np.ndarray, text: np.ndarray, item_at: np.ndarray, text_at: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seeds: the longest match free of marked words is marked first; ties go to the earliest.

    Returns (place in the item, place in the text, length) of the tiles, each at least ``min_words`` long.
    """
    import heapq

    # equal hashes are held against the words themselves
    same = np.ones(len(item_at), dtype=bool)
    for k in range(min_words):
        same &= item[item_at + k] == text[text_at + k]
    item_at, text_at = item_at[same], text_at[same]
    if not len(item_at):
        return []
    order = np.lexsort((text_at, text_at - item_at))
    p, t = item_at[order], text_at[order]
    breaks = np.flatnonzero((np.diff(t - p) != 0) | (np.diff(t) != 1)) + 1
    heap = [(-(len(run) + min_words - 1), int(p[run[0]]), int(t[run[0]])) for run in np.split(np.arange(len(p)), breaks)]
    heapq.heapify(heap)
    marked_p, marked_t, tiles = np.zeros(len(item), bool), np.zeros(len(text), bool), []
    while heap:
        length, a, b = heapq.heappop(heap)
        length = -length
        used = marked_p[a : a + length] | marked_t[b : b + length]
        if not used.any():
            marked_p[a : a + length] = marked_t[b : b + length] = True
            tiles.append((a, b, length))
            continue
        # what is left free of it, in stretches long enough, is looked at again by its new length
        edges = np.flatnonzero(np.diff(np.concatenate([[True], used, [True]]).astype("int8")))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if y - x >= min_words:
                heapq.heappush(heap, (-(y - x), a + x, b + x))
    return tiles


_KINDS = "n_tiles int, longest int, covered int, coverage double"


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", min_words: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item, doc, n_tiles, longest, covered, coverage): every pair of a test item and a document that share ``min_words`` consecutive words.

    longest is the length in words of the longest tile, covered the words of the item inside tiles and coverage their share. Null, empty and shorter
    texts share nothing. Both texts are read whole. Repeated rows give one row per pair of ids, that of the greatest cover. No documents or no items give
    no rows. Further columns are not read. Items of up to ``block_chars`` characters together are sent to the documents; more are not collected
    anywhere (see _by_hashes()), with the same result.
    """
    ship(documents.sparkSession)
    held = items.where(F.col(text).isNotNull()).select(F.col(item).alias("i"), F.col(text).cast("string").alias("t"))
    total = held.agg(F.sum(F.length("t").cast("bigint")).alias("n")).first()["n"] or 0
    kinds = f"`{item}` {items.schema[item].dataType.simpleString()}, `{doc}` {documents.schema[doc].dataType.simpleString()}, {_KINDS}"
    if total <= block_chars:
        block = documents.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in held.collect()], min_words))
        found = documents.select(doc, F.col(text).cast("string")).mapInArrow(_searcher(block, item, doc, to_arrow_type(items.schema[item].dataType)), kinds)
    else:
        rows = documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("d"), F.col(text).cast("string").alias("t"))
        found = _by_hashes(rows, held, min_words).select(F.col("i").alias(item), F.col("d").alias(doc), "n_tiles", "longest", "covered", "coverage")
    best = F.max(F.struct("covered", "longest", "n_tiles", "coverage")).alias("m")
    return found.groupBy(item, doc).agg(best).select(item, doc, "m.n_tiles", "m.longest", "m.covered", "m.coverage")


def covered(found: DataFrame, share: float) -> DataFrame:
    """The pairs of leaks() whose tiles cover at least this share of the item's words, in whatever order the passages stand."""
    return found.where(F.col("coverage") >= share)


def _numbers(found: list[str], seen: dict[str, int]) -> np.ndarray:
    """A number of each word that does not depend on other texts."""
    import xxhash

    for w in found:
        if w not in seen:
            seen[w] = xxhash.xxh3_64_intdigest(w)
    return np.array([seen[w] for w in found], dtype="uint64")


def _runs(min_words: int, known=None):
    """(id, h): the different hashes of each text's runs; of texts with an item filter only those that pass it."""

    def hashes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = None if known is None else known.value
        for batch in batches:
            seen: dict[str, int] = {}
            for start in range(0, len(batch), 200):
                part = batch.slice(start, 200)
                at, rows = [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    own = np.unique(rolling(_numbers(words(text), seen), min_words))
                    if bits is not None:
                        place = own % np.uint64(len(bits) * 8)
                        own = own[(bits[(place >> np.uint64(3)).astype("int64")] >> (place & np.uint64(7)).astype("uint8")) & 1 == 1]
                    at.append(np.full(len(own), k))
                    rows.append(own)
                ids = part.column(0).take(pa.array(np.concatenate(at).astype("int64")))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(rows).view("int64"))], ["id", "h"])

    return hashes


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the hashes modulo ``bits``: pieces made by tasks, ``bits`` / 8 bytes together, whatever the number of hashes."""
    place = F.expr(f"pmod(cast(h as decimal(20, 0)) + if(h < 0, cast('18446744073709551616' as decimal(20, 0)), 0), {bits})").cast("bigint")
    pieces = seeds.select(place.alias("p")).groupBy((F.floor(F.col("p") / 32768)).alias("piece")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("b"))
    found = np.zeros(bits // 8, dtype="uint8")
    for r in pieces.collect():
        found[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = np.frombuffer(r["b"], dtype="uint8")
    return found


def _by_hashes(documents: DataFrame, items: DataFrame, min_words: int, bits: int = FILTER_BITS) -> DataFrame:
    """(i, d, n_tiles, longest, covered, coverage) of documents (d, t) and items (i, t) of any number.

    Nothing but a filter of fixed size is collected. Hashes that many documents' runs have are split, and so are items and documents that are in very many pairs. Each pair's
    two texts are tiled in one row, so no group is ever held; equal hashes are held against the words there.
    """
    context = documents.sparkSession.sparkContext
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    seeds = cut(items.select("i", "t").mapInArrow(_runs(min_words), f"id {kind(items, 'i')}, h bigint").withColumnRenamed("id", "i").distinct())
    known = context.broadcast(_filter(seeds, bits))
    runs = cut(documents.select("d", "t").mapInArrow(_runs(min_words, known), f"id {kind(documents, 'd')}, h bigint").withColumnRenamed("id", "d"))
    pairs = cut(salted_join(runs, seeds, "h", ["d"], "inner", heavy_keys(runs, "h")).select("i", "d").distinct())
    both = salted_join(pairs, items.select("i", F.col("t").alias("item_text")), "i", ["d"], "inner")
    both = salted_join(both, documents, "d", ["i"], "inner", heavy_keys(pairs, "d"))

    def tiled(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                one = Items([(k, a)], min_words)
                for _, _, tiles in one.matches([b]):
                    done = sum(x[2] for x in tiles)
                    rows.append((k, len(tiles), max(x[2] for x in tiles), done, done / len(one.words[0])))
            at, *figures = list(zip(*rows)) if rows else [[]] * 5
            at = pa.array(at, pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, k) for c, k in zip(figures, kinds))], ["i", "d", "n_tiles", "longest", "covered", "coverage"])

    return both.select("i", "d", "item_text", "t").mapInArrow(tiled, f"i {kind(items, 'i')}, d {kind(documents, 'd')}, {_KINDS}")


def _searcher(block, item: str, doc: str, item_kind):
    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = block.value
        names = [item, doc, "n_tiles", "longest", "covered", "coverage"]
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for t, i, tiles in known.matches(batch.column(1).to_pylist()):
                covered = sum(x[2] for x in tiles)
                rows.append((known.ids[i], ids[t], len(tiles), max(x[2] for x in tiles), covered, covered / len(known.words[i])))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [item_kind, batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return search
