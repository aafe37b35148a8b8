"""Benchmark decontamination by suffix arrays over shards of the training documents.

A shard is a stretch of whole documents within a scan partition. Its words become numbers of the benchmark's
vocabulary, 0 for any other word and between documents, so a suffix array over the positions followed by enough known words
holds every suffix that any benchmark suffix can match. The array is sorted once, by the first `window` words. The suffixes of the
benchmark come in blocks of bounded size: their windows (equal ones once) are binary-searched in it, and the range of a window is where
it occurs. From there matches are extended word by word: each place where a window occurs is searched in the block's own suffix
array, whose neighbours there hold the longest verbatim match. Nothing is shuffled.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, tidied

WINDOW = 13
#: Words of a shard, and most benchmark text (bytes) of a block; a task holds one block at a time.
SHARD_WORDS = 500_000
BLOCK_BYTES = 4_000_000
#: Bytes that separate words, and A-Z to a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case A-Z, then runs of ASCII digits and letters and of all characters beyond ASCII."""
    return text.encode().translate(_TABLE).split() if text else []


def suffix_array(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order of the suffixes of all items (prefix doubling): the suffix array. A suffix ends with its item; ties by position."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        ahead = np.arange(n) + step
        second = np.where(ahead < end, rank[np.minimum(ahead, n - 1)], 0)
        order = np.lexsort((second, rank))
        new = np.ones(n, np.int64)
        new[order[1:]] = 1 + np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
        if new.max() == n or step >= (end - np.arange(n)).max():
            return np.lexsort((np.arange(n), new))
        rank, step = new, 2 * step


class Block:
    """Benchmark items as numbers, sorted by name (nulls last): their distinct windows, who has them, and a suffix array. Made on the driver."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, vocabulary: dict[bytes, int]):
        items = sorted(items, key=lambda x: (x[0] is None, x[0] or "", x[1] or ""))
        self.names = [name for name, _ in items]
        ids = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)], np.int32) for _, text in items]
        self.tokens = np.concatenate([*ids, np.zeros(0, np.int32)])
        lengths = np.array([len(x) for x in ids], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
        at = np.repeat(self.starts, lengths)
        left = np.repeat(lengths, lengths) - (np.arange(len(self.tokens)) - at)
        whole = (np.repeat(lengths, lengths) < window) & (np.arange(len(self.tokens)) == at)  # an item of fewer words is one window
        first = np.flatnonzero((left >= window) | whole)
        size = np.minimum(left[first], window)
        padded = np.concatenate([self.tokens, np.zeros(window, np.int32)])
        grid = padded[first[:, None] + np.arange(window)] if len(first) else np.zeros((0, window), np.int32)
        grid[np.arange(window)[None, :] >= size[:, None]] = 0
        self.windows, of = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
        self.sizes = (self.windows > 0).sum(1)
        # Distinct (window, item) pairs, by window.
        item = np.searchsorted(self.starts, first, "right") - 1  # of items that start at one place, all but the last are empty
        pairs = np.unique(np.stack([of.ravel(), item], 1), axis=0) if len(first) else np.zeros((0, 2), np.int64)
        self.owner, self.owned = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.suffixes = suffix_array(self.tokens, np.unique(self.starts[self.starts < len(self.tokens)]))

    def place(self, suffix: int) -> tuple[str | None, int]:
        item = int(np.searchsorted(self.starts, suffix, "right")) - 1
        return self.names[item], suffix - int(self.starts[item])

    def ends(self, suffixes: np.ndarray) -> np.ndarray:
        return np.append(self.starts, len(self.tokens))[np.searchsorted(self.starts, suffixes, "right")]

    def common(self, tokens: np.ndarray, at: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        """Words that shard positions and suffixes have in common."""
        out, open_, end = np.zeros(len(at), np.int64), np.arange(len(at)), self.ends(suffixes)
        while len(open_):
            k = out[open_]
            inside = suffixes[open_] + k < end[open_]
            open_, k = open_[inside], k[inside]
            same = tokens[at[open_] + k] == self.tokens[suffixes[open_] + k]
            open_ = open_[same]
            out[open_] += 1
        return out

    def longest(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each shard position the words of its longest match with any suffix, and where in the suffix array one such is."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.suffixes), np.int64)
        while len(open_ := np.flatnonzero(low < high)):  # the first suffix that is not below the position's text
            middle = (low[open_] + high[open_]) // 2
            s, p = self.suffixes[middle], at[open_]
            k = self.common(tokens, p, s)
            below = (s + k >= self.ends(s)) | (self.tokens[np.minimum(s + k, len(self.tokens) - 1)] < tokens[p + k])
            low[open_], high[open_] = np.where(below, middle + 1, low[open_]), np.where(below, high[open_], middle)
        left, right = np.maximum(low - 1, 0), np.minimum(low, len(self.suffixes) - 1)
        x, y = self.common(tokens, at, self.suffixes[left]), self.common(tokens, at, self.suffixes[right])
        return np.maximum(x, y), np.where(x >= y, left, right)

    def first_of(self, tokens: np.ndarray, at: int, words_: int, near: int) -> int:
        """The first suffix, in the order of items, that begins with those words; `near` is a place in the suffix array of one."""
        text = tokens[at : at + words_]

        def begins(i: int) -> bool:
            s = int(self.suffixes[i])
            return s + words_ <= int(self.ends(np.array([s]))[0]) and bool((self.tokens[s : s + words_] == text).all())

        ends = []
        for way, limit in ((-1, -1), (1, len(self.suffixes))):  # by doubling, then halving
            good, step = near, 1
            while (i := good + way * step) * way < limit * way and begins(i):
                good, step = i, 2 * step
            while step:
                if (i := good + way * step) * way < limit * way and begins(i):
                    good = i
                step //= 2
            ends.append(good)
        return int(self.suffixes[ends[0] : ends[1] + 1].min())


class Shard:
    """Documents' words as numbers, and the suffix array of those positions from which a match is possible."""

    def __init__(self, docs: list[list[bytes]], vocabulary: dict[bytes, int], window: int, least: int):
        self.window = window
        self.lengths = np.array([len(d) for d in docs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        get = vocabulary.get
        tokens = np.zeros(int((self.lengths + 1).sum()) + window + 1, np.int32)
        for at, d in zip(self.starts, docs, strict=True):
            tokens[at : at + len(d)] = list(map(get, d, repeat(0)))
        self.tokens = tokens
        # Known words from each position on; fewer than the shortest window can't match.
        position = np.arange(len(tokens))
        ahead = np.minimum.accumulate(np.where(tokens == 0, position, len(tokens))[::-1])[::-1] - position
        at = np.flatnonzero(ahead >= least)
        self.bits = max(1, len(vocabulary).bit_length())
        self.per = 64 // self.bits
        keys = self.packed(lambda i: tokens[at + i], len(at))
        order = np.lexsort(keys[::-1])
        self.suffixes = at[order]
        self.sorted = self.text([k[order] for k in keys])

    def packed(self, word: object, n: int) -> list[np.ndarray]:
        """`window` words from each of n places, several in a 64-bit key. word(i): the words at distance i."""
        out = []
        for k in range(-(-self.window // self.per)):
            key = np.zeros(n, np.uint64)
            for i in range(k * self.per, (k + 1) * self.per):
                key <<= np.uint64(self.bits)
                if i < self.window:
                    key |= word(i).astype(np.uint64)
            out.append(key)
        return out

    @staticmethod
    def text(keys: list[np.ndarray]) -> np.ndarray:
        """Keys as byte strings, which sort as the words do."""
        return np.stack(keys, axis=1).astype(">u8").view(f"S{8 * len(keys)}").ravel() if len(keys[0]) else np.zeros(0, f"S{8 * len(keys)}")

    def find(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Windows of the block and the positions of all their occurrences."""
        w, top = block.windows, (1 << self.bits) - 1
        low = self.text(self.packed(lambda i: w[:, i], len(w)))
        high = self.text(self.packed(lambda i: np.where(i < block.sizes, w[:, i], top), len(w)))
        a, b = np.searchsorted(self.sorted, low, "left"), np.searchsorted(self.sorted, high, "right")
        n = b - a
        window = np.repeat(np.arange(len(n)), n)
        return window, self.suffixes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def _shards(batches: Iterator[pa.RecordBatch], size: int, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Batches of about `size` words (one document at least), with the words. Batches have a column text."""
    held, docs, n = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            docs += [words(t) for t in held[-1].column("text").to_pylist()]
            n += sum(map(len, docs[-held[-1].num_rows :]))
            if n >= size:
                yield pa.concat_batches(held), docs
                held, docs, n = [], [], 0
    if held:
        yield pa.concat_batches(held), docs


MATCH = "struct<words:long,start:long,item:string,offset:long>"
_FOUND = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.struct([("words", pa.int64()), ("start", pa.int64()), ("item", pa.string()), ("offset", pa.int64())]))])


def _better(x: dict, y: dict | None) -> bool:
    """The longer match; of equal ones the first place in the document, then in the benchmark (items without a name last)."""
    key = lambda m: (-m["words"], m["start"], m["item"] is None, m["item"] or "", m["offset"])
    return y is None or key(x) < key(y)


def _hit_rows(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast], known: Broadcast, window: int, least: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Each document's row with n_words, n_hit, spans (start, end, start, ...), items and longest match. A shard is sorted once for all blocks."""
    vocabulary = {w: i for i, w in enumerate(known.value.split(b" "), 1)} if known.value else {}
    for batch, docs in _shards(batches, shard_words):
        shard = Shard(docs, vocabulary, window, least)
        step = np.zeros(len(shard.tokens) + 1, np.int64)
        items: list[set[str]] = [set() for _ in docs]
        longest: list[dict | None] = [None] * len(docs)
        for held in blocks:
            # With several blocks one is loaded at a time, and not kept.
            block = held.value if len(blocks) == 1 else held.load_from_path(held._path)
            hit, at = shard.find(block)
            if len(at):
                np.add.at(step, at, 1)
                np.add.at(step, at + block.sizes[hit], -1)
                for k, w in np.unique(np.stack([shard.document(at), hit], axis=1), axis=0).tolist():
                    items[k].update(n for i in block.owner[block.owned[w] : block.owned[w + 1]].tolist() if (n := block.names[i]) is not None)
                by = np.lexsort((-block.sizes[hit], at))  # of a place the longest window, which an item of few words may be
                at, first = np.unique(at[by], return_index=True)
                own_window = hit[by][first]
                n, near = block.longest(shard.tokens, at)
                whole = n >= window
                n = np.where(whole, n, block.sizes[own_window])  # what is shorter than a window counts as an item, not as an item's end
                of = shard.document(at)
                for i in np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist():  # a document's places are next to one another
                    own = slice(i, i + int(np.searchsorted(of[i:], of[i], "right")))
                    j = i + int(n[own].argmax())
                    item, offset = block.place(block.first_of(shard.tokens, int(at[j]), int(n[j]), int(near[j]))) if whole[j] else (block.names[block.owner[block.owned[own_window[j]]]], 0)
                    found = {"words": int(n[j]), "start": int(at[j] - shard.starts[of[i]]), "item": item, "offset": offset}
                    if _better(found, longest[of[i]]):
                        longest[of[i]] = found
            del block
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(step) > 0, [0]])))
        of = shard.document(edges[::2])
        spans: list[list[int]] = [[] for _ in docs]
        for k, start, end in zip(of.tolist(), (edges[::2] - shard.starts[of]).tolist(), (edges[1::2] - shard.starts[of]).tolist(), strict=True):
            spans[k] += [start, end]
        found = [shard.lengths, [sum(s[1::2]) - sum(s[::2]) for s in spans], spans, [sorted(x) for x in items], longest]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(x, f.type) for x, f in zip(found, _FOUND, strict=True))], names=["row", *_FOUND.names])


def _blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in blocks of about block_bytes of text, one on the driver at a time. Items without an id have texts too."""
    named = items.select(F.col(f"`{item_id}`").cast("string").alias("name"), F.col(f"`{item_text}`").alias("text"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        block = named if n == 1 else named.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield [(r.name, r.text) for r in block.toLocalIterator()]


def _marked(docs: DataFrame, items: DataFrame, carry: list[str], window: int = WINDOW, share: int = 20, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each document's columns named in carry as `row`, with n_words, n_hit, items, spans, longest, contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary: dict[bytes, int] = {}
    blocks, least = [], window
    for rows in _blocks(items, item_id, item_text, block_bytes):
        block = Block(rows, window, vocabulary)
        if len(block.windows):
            least = min(least, int(block.sizes.min()))
            blocks.append(spark.sparkContext.broadcast(block))
        del block, rows
        gc.collect()
    known = spark.sparkContext.broadcast(b" ".join(vocabulary))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    empty = F.lit(None)
    schema = rows.select("row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), empty.cast("array<long>").alias("spans"), empty.cast("array<string>").alias("items"), empty.cast(MATCH).alias("longest")).schema
    found = rows.mapInArrow(tidied(lambda it: _hit_rows(it, blocks, known, window, least, shard_words)), schema)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted strings), spans (word offsets: start, end, ...), longest, contaminated.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. A word of
    a document inside any occurrence of a window is hit; a document is contaminated if n_hit > 0 and
    share * n_hit >= n_words. longest is the longest verbatim match of the document and an item that begins with a window: words, start
    in the document, item and offset in it; of equally long ones the first place in the document, then by item and offset; null
    if no window occurs. Null texts have no words; items with a null id are searched for too, but not named in items; repeated
    ids keep their rows; columns beside the named ones are not read. A very long text is a shard of its own. Empty tables give an empty
    result, or no hits. The benchmark is broadcast: each block has a bound, the disk for all is in proportion to the benchmark, and the
    vocabulary (its distinct words) is held whole. Options: window, share, text_col, item_id, item_text, block_bytes, shard_words.
    """
    return _marked(docs, items, [id_col], **options).select(F.col(f"row.`{id_col}`"), "n_words", "n_hit", "items", "spans", "longest", "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """The documents that are not contaminated, with all their columns. Options as for contamination()."""
    return _marked(docs, items, docs.columns, **options).where("NOT contaminated").select("row.*")


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(13, len(w)) AS k, unnest(generate_series(1, greatest(1, len(w) - 12))) AS j FROM bw WHERE len(w) > 0),
win AS (SELECT item, k, j, array_to_string(w[j : j + k - 1], ' ') AS t FROM bi),
ks AS (SELECT DISTINCT k FROM win),
di AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k),
dt AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS t FROM di),
hit AS (SELECT dt.doc_id, dt.k, dt.i, win.item, win.j FROM dt JOIN win ON dt.k = win.k AND dt.t = win.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id),
run AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, k, i - j ORDER BY i) AS g FROM (SELECT DISTINCT * FROM hit)),
lon AS (SELECT doc_id, item, min(i) AS i, min(j) AS j, count(*) + k - 1 AS n FROM run GROUP BY doc_id, item, k, i - j, g),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i, item NULLS LAST, j) AS r FROM lon) WHERE r = 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items, sha256(coalesce(its.items, '')) AS items_sha256,
  coalesce(pos.n_hit, 0) > 0 AND 20 * coalesce(pos.n_hit, 0) >= len(w) AS contaminated, CAST(best.n AS BIGINT) AS match_words, best.i - 1 AS match_start, best.item AS match_item, best.j - 1 AS match_offset
FROM dw LEFT JOIN pos ON dw.doc_id = pos.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id LEFT JOIN best ON dw.doc_id = best.doc_id
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_...: the longest verbatim match of the document and where it is, null if there is none."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated",
        F.col("longest.words").alias("match_words"), F.col("longest.start").alias("match_start"), F.col("longest.item").alias("match_item"), F.col("longest.offset").alias("match_offset"),
    )
