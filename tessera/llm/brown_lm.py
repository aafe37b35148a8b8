"""Language-model scoring with Brown's class-based bigrams, clustered by distributed exchange.

P(w | w') = P(class(w) | class(w')) * P(w | class(w)), smoothed by a share of the word unigram. Classes start from the most frequent words, one each. In a
round every word moves to the class that raises the likelihood of the training text most, by the exact gain of that move alone given the class bigrams of
the round before. Rounds go on until one gains less than a set share of all that was gained.

Layout. Documents are encoded once into blocks: numbers of block-local words, and the block's distinct words. Distinct words
are dealt by hash to word partitions, which count them over all training text. What travels is packed: one message
from a block to a word partition with all its words there, and one back. In a round, blocks send each word's counts
of neighbouring classes; word partitions add them up, choose classes, and answer. So a task holds a block, or
the words and messages of one partition, of which there are as many as the distinct words of all blocks ask for; driver and closures hold
only what is of the size of the classes or partitions. No text is sampled or cut: every training token enters the counts, every word is
clustered, every document is scored.
"""

from __future__ import annotations

import struct
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc32_mod, discard, materialize, small_batches, tidied, whole_id

CLASSES = 64
#: A round that gains less than this share of what all rounds gained is the last.
LEAST_GAIN = 0.05
#: Words of a block; a longer document is a block of its own. Packed words of all blocks for each word partition, at most about.
BLOCK_WORDS, PART_BYTES = 1_400_000, 2_000_000
#: Entries (word, neighbouring class) whose gains are computed at a time.
ENTRIES = 1 << 15
#: Weight of the class unigram in a transition; added count in an emission.
BETA, ADDED = 10.0, 0.5
#: Share of the word unigram in the mixture that smooths the class model.
PLAIN = 0.3
END = b""  # the end token: no word is empty
_MESSAGE = "p int, block long, kind int, src long, n long, body binary"
_ARROW = pa.schema([("p", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("src", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), a.size) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(body: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    n, at, out = data[0], 1 + 10 * data[0], []
    for i in range(n):
        kind, size = struct.unpack_from("<2sQ", data, 1 + 10 * i)
        out.append(np.frombuffer(data, np.dtype(kind.decode()), size, at))
        at += out[-1].nbytes
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()


def _send(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Tuples of _MESSAGE in batches of a few megabytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[5] or b"") + 50
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


# --- encoding -----------------------------------------------------------------------------------------------------


def _encode(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    """Documents to blocks: `body` has ids, lengths, training flags, words by number and each word's hash; `words` the words."""
    part, k = TaskContext.get().partitionId(), 0
    names = ["block", "body", "words"]

    def fresh() -> tuple:
        local: defaultdict = defaultdict()
        local.default_factory = local.__len__
        _ = local[END]
        return local, array("I"), [], [], []

    def row() -> pa.RecordBatch:
        tokens = np.frombuffer(numbers, np.uint32)
        words = list(local)
        counts = np.bincount(tokens[np.repeat(np.array(train, bool), lengths)], minlength=len(words))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) & 0xFFFFFFFF for w in words), np.uint32, len(words))
        nulls = np.array([x is None for x in ids], np.uint8)
        body = pack(np.array([x or 0 for x in ids], np.int64), nulls, np.array(lengths, np.int64), np.array(train, np.uint8), (tokens & 0xFFFF).astype(np.uint16), (tokens >> 16).astype(np.uint16), hashes)
        text = pack(np.frombuffer(b" ".join(words), np.uint8), counts.astype(np.int64), hashes)
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([body], pa.binary()), pa.array([text], pa.binary())], names=names)

    local, numbers, ids, lengths, train = fresh()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            for x, text, trains in zip(*(piece.column(c).to_pylist() for c in ("id", "text", "train")), strict=True):
                words = text.encode().lower().split() if text else []  # bytes: A-Z only, and ASCII white space
                numbers.extend(map(local.__getitem__, words))
                numbers.append(0)
                ids.append(x)
                lengths.append(len(words) + 1)
                train.append(trains)
                if len(numbers) >= block_words:
                    yield row()
                    k += 1
                    local, numbers, ids, lengths, train = fresh()
    if ids:
        yield row()


def _by_part(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Local words in the order of their partitions, and (partition, start, end) in that order."""
    to = (hashes % np.uint32(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    p, start = np.unique(to[order], return_index=True)
    return order, list(zip(p.tolist(), start.tolist(), [*start[1:].tolist(), len(to)], strict=True))


def _post_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[tuple]:
        for row in _rows(batches):
            text, counts, hashes = unpack(row["words"])
            words = text.tobytes().split(b" ")
            order, pieces = _by_part(hashes, parts)
            for p, start, end in pieces:
                own = order[start:end]
                yield p, row["block"], 0, 0, 0, pack(np.frombuffer(b" ".join([words[i] for i in own.tolist()]), np.uint8), counts[own])

    return _send(run())


def _count_words(batches: Iterator[pa.RecordBatch], seeds: int) -> Iterator[pa.RecordBatch]:
    """Messages of a word partition to answers (each word's number there, its count) and a row on the partition.

    kind 1: answers. kind 2: src is the number of words, n of training tokens, body their number in training and the most frequent words.
    """

    def run() -> Iterator[tuple]:
        for p, messages in groupby(_rows(batches), key=lambda r: r["p"]):
            number: defaultdict = defaultdict()
            number.default_factory = number.__len__
            total = np.zeros(1024, np.int64)
            mail = []
            for m in messages:
                text, counts = unpack(m["body"])
                index = np.fromiter(map(number.__getitem__, text.tobytes().split(b" ")), np.uint32, len(counts))
                if len(number) > len(total):
                    total = np.concatenate([total, np.zeros(max(len(total), len(number) - len(total)), np.int64)])
                total[index] += counts  # a block has a word once
                mail.append((m["block"], index))
            total = total[: len(number)]
            for block, index in mail:
                yield p, block, 1, p, 0, pack(index, total[index])
            words = list(number)
            least = max(1, np.partition(total, -seeds)[-seeds]) if len(total) > seeds else 1
            order = sorted(np.flatnonzero(total >= least).tolist(), key=lambda i: (-total[i], words[i]))[:seeds]
            end = number[END] if END in number else -1
            top = np.frombuffer(b" ".join(words[i] for i in order), np.uint8)
            yield p, -1, 2, len(total), int(total.sum()), pack(np.array([np.count_nonzero(total), end]), np.array(order, np.int64), total[order], top)

    return _send(run())


# --- blocks -------------------------------------------------------------------------------------------------------


class Block:
    """A block with what word partitions answered about its words."""

    def __init__(self, rows: list[dict], start: dict[int, dict[int, int]] | None, parts: int):
        got = {kind: [unpack(r["body"]) for r in rows if r["kind"] == kind] for kind in (0, 1, 3)}
        self.ids, self.nulls, self.lengths, train, low, high, hashes = got[0][0]
        self.tokens = high.astype(np.int64) << 16 | low
        self.train = np.repeat(train.astype(bool), self.lengths)
        self.order, self.pieces = _by_part(hashes, parts)
        self.numbers = np.concatenate([x[0] for x in got[1]])  # in the order of the partitions
        self.count = np.empty(len(hashes), np.int64)
        self.count[self.order] = np.concatenate([x[1] for x in got[1]])
        self.classes = np.empty(len(hashes), np.uint8)
        if start is None:
            self.classes[self.order] = np.concatenate([x[0] for x in got[3]])
        else:  # before the first round: the seeds have a class each, all others the last
            self.classes[:] = CLASSES - 1
            for p, a, b in self.pieces:
                for number, c in start.get(p, {}).items():
                    self.classes[self.order[a:b][self.numbers[a:b] == number]] = c

    def before(self) -> np.ndarray:
        """The class before each token: the end's at a document's start."""
        c = self.classes[self.tokens]
        out = np.concatenate([[0], c[:-1]])
        out[np.concatenate([[0], np.cumsum(self.lengths)[:-1]])] = 0
        return out


def _blocks(batches: Iterator[pa.RecordBatch], start: dict | None, parts: int) -> Iterator[tuple[int, Block]]:
    for block, rows in groupby(_rows(batches), key=lambda r: r["block"]):
        yield block, Block(list(rows), start, parts)


def _sparse(index: np.ndarray, other: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of (word, class) as entries a word, classes, counts."""
    dense = np.bincount(index.astype(np.int64) * CLASSES + other, minlength=words * CLASSES)
    at = np.flatnonzero(dense)
    return np.bincount(at // CLASSES, minlength=words).astype(np.uint8), (at % CLASSES).astype(np.uint8), dense[at].astype(np.uint32)


def _contexts(batches: Iterator[pa.RecordBatch], start: dict | None, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks to messages with each word's neighbouring classes, and (kind 4) the class bigrams of the training text."""

    def run() -> Iterator[tuple]:
        bigrams = np.zeros(CLASSES * CLASSES, np.int64)
        for block, b in _blocks(batches, start, parts):
            train, before = b.train, b.before()
            own = b.classes[b.tokens]
            bigrams += np.bincount(before[train].astype(np.int64) * CLASSES + own[train], minlength=CLASSES * CLASSES)
            place = np.empty(len(b.order), np.int64)
            place[b.order] = np.arange(len(b.order))
            word = place[b.tokens]
            # After a word comes the next token's class, unless the word ends its document.
            follows = train & (b.tokens != 0)
            after = np.append(own[1:], 0)
            sides = [_sparse(word[train], before[train], len(b.order)), _sparse(word[follows], after[follows], len(b.order))]
            starts = [np.concatenate([[0], np.cumsum(s[0], dtype=np.int64)]) for s in sides]
            sorted_classes = b.classes[b.order]
            for p, x, y in b.pieces:
                cut = [a for s, at in zip(sides, starts, strict=True) for a in (s[0][x:y], s[1][at[x] : at[y]], s[2][at[x] : at[y]])]
                yield p, block, 0, 0, 0, pack(b.numbers[x:y], sorted_classes[x:y], *cut)
        for i in np.flatnonzero(bigrams).tolist():
            yield -1, -1, 4, i, int(bigrams[i]), None

    return _send(run())


def _choose(before: np.ndarray, after: np.ndarray, own: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """The class of greatest gain for each word, from its counts of classes before and after it (words x classes).

    With f(x) = x log x, and N and its sums without the word, joining class b adds the sum over classes c of f(N(b, c) + after(c)) - f(N(b, c)), the same
    for what comes before, less 2 (f(N(b) + n) - f(N(b))). Only classes beside the word add anything, so the sums are over those entries.
    """
    n = before.sum(1)
    sums = (bigrams.sum(0) + bigrams.sum(1)) / 2
    f = lambda x: x * np.log(np.maximum(x, 1))
    rows = np.arange(len(n))
    gain = -2 * (f(sums[None, :] + n[:, None]) - f(sums)[None, :])
    left = np.maximum(sums[own] - n, 0)
    gain[rows, own] = -2 * (f(left + n) - f(left))
    for counts, other, table in ((after, before, bigrams), (before, after, bigrams.T)):  # table[b, c]: b before c, or after it
        word, beside = np.nonzero(counts)
        added = np.zeros_like(gain)
        for at in range(0, len(word), ENTRIES):
            w, c = word[at : at + ENTRIES], beside[at : at + ENTRIES]
            k = counts[w, c]
            rest = table[:, c].T.astype(float)  # entries x classes
            rest[np.arange(len(w)), own[w]] -= k
            mine = np.flatnonzero(c == own[w])  # the word's own class is beside it: its other side is taken out of that, too
            rest[mine] -= other[w[mine]]
            rest = np.maximum(rest, 0)
            cuts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            added[w[cuts]] += np.add.reduceat(f(rest + k[:, None]) - f(rest), cuts, axis=0)
        gain += added
    gain[:, 0] = -np.inf  # the end's alone
    return np.where(own == 0, 0, gain.argmax(1)).astype(np.uint8)


def _move(batches: Iterator[pa.RecordBatch], sizes: np.ndarray, bigrams: np.ndarray, frozen: dict[int, dict[int, int]]) -> Iterator[pa.RecordBatch]:
    """Messages of a word partition to answers with new classes (kind 3), and (kinds 5 and 6) words and once-seen words a class."""

    def run() -> Iterator[tuple]:
        types, once = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for p, messages in groupby(_rows(batches), key=lambda r: r["p"]):
            words = int(sizes[p])
            sums = np.zeros((2, words * CLASSES), np.int32)
            own, mail = np.zeros(words, np.uint8), []
            for m in messages:
                number, classes, *sides = unpack(m["body"])
                for s, (entries, other, count) in zip(sums, (sides[:3], sides[3:]), strict=True):
                    np.add.at(s, np.repeat(number.astype(np.int64), entries) * CLASSES + other, count.astype(np.int32))
                own[number] = classes
                mail.append((m["block"], number))
            new = own.copy()
            for at in range(0, words, 4096):
                cut = slice(at, at + 4096)
                before, after = (s.reshape(words, CLASSES)[cut].astype(np.float64) for s in sums)
                new[cut] = _choose(before, after, own[cut], bigrams)
            for number in frozen.get(p, {}):
                new[number] = own[number]
            n = sums[0].reshape(words, CLASSES).sum(1)
            types += np.bincount(new[n > 0], minlength=CLASSES)
            once += np.bincount(new[n == 1], minlength=CLASSES)
            for block, number in mail:
                yield p, block, 3, p, 0, pack(new[number])
        for kind, found in ((5, types), (6, once)):
            for c in np.flatnonzero(found).tolist():
                yield -1, -1, kind, c, int(found[c]), None

    return _send(run())


# --- model --------------------------------------------------------------------------------------------------------


class Model:
    """What scoring needs besides a word's class and count; a few numbers a class."""

    def __init__(self, bigrams: np.ndarray, types: np.ndarray, once: np.ndarray, n: int, v: int):
        self.n, self.v = n, v
        self.unknown = int(once.argmax()) if once.any() else CLASSES - 1  # an unseen word is like one seen once
        tokens = bigrams.sum(0)
        unigram = (tokens + 0.5) / (tokens.sum() + 0.5 * CLASSES)
        self.next = (bigrams + BETA * unigram[None, :]) / (bigrams.sum(1, keepdims=True) + BETA)
        types = types + (np.arange(CLASSES) == self.unknown)
        self.total = tokens + ADDED * np.maximum(types, 1)

    def score(self, b: Block) -> tuple[np.ndarray, ...]:
        """A row a document: tokens, known ones, base and model score."""
        b.classes[b.count == 0] = self.unknown
        before, own = b.before(), b.classes[b.tokens]
        count = b.count[b.tokens]
        emitted = (b.count + ADDED) / self.total[b.classes]
        plain = (b.count + 0.5) / (self.n + 0.5 * (self.v + 1))
        base = np.log10(plain)[b.tokens]
        score = np.log10((1 - PLAIN) * self.next[before, own] * emitted[b.tokens] + PLAIN * plain[b.tokens])
        at = np.concatenate([[0], np.cumsum(b.lengths)[:-1]])
        return b.lengths, np.add.reduceat((count > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(score, at)


_SCORED = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(batches: Iterator[pa.RecordBatch], model: Model, parts: int) -> Iterator[pa.RecordBatch]:
    for _, b in _blocks(batches, None, parts):
        ids = pa.array(b.ids, pa.int64(), mask=b.nulls.astype(bool))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(model.score(b), _SCORED.types[1:], strict=True))], schema=_SCORED)


def objective(bigrams: np.ndarray) -> float:
    """The classes' part of the training likelihood."""
    x = lambda a: float((a * np.log(np.maximum(a, 1))).sum())
    return x(bigrams) - x(bigrams.sum(0)) - x(bigrams.sum(1))


def score_documents(docs: DataFrame, fold: int = 5, held: int = 1, least_gain: float = LEAST_GAIN, block_words: int = BLOCK_WORDS, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text", trace: list | None = None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from documents whose crc32(id as text) modulo fold is not held. Words are runs of anything but ASCII white
    space, A-Z lowered, and each text ends with one more token. score is the log10 probability of the text
    under the class model, base_score under add-half unigrams; both spread over V + 1 types, all unseen words being one. Null
    texts are empty: the end token alone. Repeated ids keep their rows; a null id counts as empty text for the fold; ids are whole numbers
    (others are an error). A very long text is a block of its own. Without training text all words are unseen. Columns beside id and text
    are not read. An empty table gives an empty result. least_gain: see LEAST_GAIN; rounds end, too, with one that loses. trace, if given, gets
    the objective before each round and after the last.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_ = whole_id(docs, id_col)
    source = docs.select(id_.alias("id"), F.col(f"`{text_col}`").alias("text"), (crc32_mod(id_, fold) != held).alias("train"))
    blocks = materialize(source.mapInArrow(tidied(lambda it: _encode(it, block_words)), "block long, body binary, words binary"), "lm-blocks")
    packed = blocks.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = max(1, -(-packed // part_bytes))  # by the data alone, so what a task holds does not grow with them
    to_words = lambda df: df.where("p >= 0").repartitionById(parts, F.col("p")).sortWithinPartitions("p", "block")
    answers = materialize(to_words(blocks.select("words", "block").mapInArrow(tidied(lambda it: _post_words(it, parts)), _MESSAGE)).mapInArrow(tidied(lambda it: _count_words(it, CLASSES)), _MESSAGE), "lm-words")

    # A row a word partition.
    sizes, n, v, top, end = np.zeros(parts, np.int64), 0, 0, [], None
    for row in answers.where("kind = 2").toLocalIterator():
        (seen, at), number, count, seeds = unpack(row.body)
        sizes[row.p], n, v = row.src, n + row.n, v + int(seen)
        end = (row.p, int(at)) if at >= 0 else end
        # Ties by the word, so seeds do not depend on the partitions.
        top = sorted([*top, *((-c, w, row.p, i) for c, i, w in zip(count.tolist(), number.tolist(), seeds.tobytes().split(b" "), strict=False) if (row.p, i) != end)])[:CLASSES]
    start: dict[int, dict[int, int]] = defaultdict(dict)
    for k, (_, _, p, i) in enumerate([t for t in top if (t[2], t[3]) != end][: CLASSES - 2]):
        start[p][i] = k + 1
    if end:
        start[end[0]][end[1]] = 0
    start = dict(start)

    tokens = blocks.select(F.lit(0).alias("p"), "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("n"), "body")
    about = answers.where("kind = 1")

    def with_tokens(classes: DataFrame | None, run: Callable, schema: str = _MESSAGE) -> DataFrame:
        mail = tokens.unionByName(about) if classes is None else tokens.unionByName(about).unionByName(classes.where("kind = 3"))
        return mail.repartition(parts, "block").sortWithinPartitions("block", "kind", "src").mapInArrow(tidied(run), schema)

    def summed(df: DataFrame, kind: int, size: int) -> np.ndarray:
        """Rows of a kind added up by src, which is below size."""
        out = np.zeros(size, np.int64)
        for src, total in df.where(F.col("kind") == kind).groupBy("src").agg(F.sum("n")).collect():
            out[src] = total
        return out

    classes, best, reached = None, None, []
    while True:
        first = None if reached else start
        contexts = materialize(with_tokens(classes, lambda it, first=first: _contexts(it, first, parts)), "lm-contexts")
        bigrams = summed(contexts, 4, CLASSES * CLASSES).reshape(CLASSES, CLASSES)
        reached.append(objective(bigrams))
        if classes is not None and (best is None or reached[-1] > best[0]):
            best = reached[-1], classes, bigrams
        gained = reached[-1] - reached[-2] if classes is not None else None
        if gained is not None and (gained <= 0 or len(reached) > 2 and gained < least_gain * (reached[-1] - reached[0])):
            break
        # Words of the first round's own classes stay until these have members.
        frozen = start if not reached[1:] else {end[0]: {end[1]: 0}} if end else {}
        classes = materialize(to_words(contexts).mapInArrow(tidied(lambda it, bigrams=bigrams, frozen=frozen: _move(it, sizes, bigrams, frozen)), _MESSAGE), "lm-classes")
        discard(contexts)
    if trace is not None:
        trace += reached
    _, classes, bigrams = best
    model = Model(bigrams, summed(classes, 5, CLASSES), summed(classes, 6, CLASSES), n, v)
    scored = with_tokens(classes, lambda it: _score(it, model, parts), "id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), (crc32_mod(F.col("id"), fold) == held).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
