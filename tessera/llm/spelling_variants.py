"""Grouping spelling variants by Aho-Corasick automata over the halves of words.

One inserted, deleted or replaced code point leaves one half of a word as it is: the first half, at the start of the other word,
or the second half, at its end. So an automaton over the halves of words finds all words that can be near, by scanning each word
once. Automata are sharded by an anchor, the code points with which a first half begins or a second half ends: a word is scanned by
the shard of its beginning and by that of its end only. Anchors of many words are dealt over several shards, and what has to be scanned
goes to each of these. Of the halves found, the offset and the length are checked; the remaining half is then looked up in an
index of the shard's words with one code point open or left out, so words that share a half aren't compared pair by pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lookup, lower_ascii, materialize, partitions, small_batches, tidied

#: Halves in a shard's automaton, about. Shards grow in number with the words.
HALVES = 20_000
#: Words that a task counts before it passes the counts on.
COUNTED = 200_000
#: Remaining halves of more code points are compared one by one: an index of all their gaps would be quadratic in their length.
LONG = 48
#: Fixed values of the query.
QUERY_RUN, QUERY_LENGTH, QUERY_COUNT, QUERY_TIMES, QUERY_DROP = r"[A-Za-zÀ-ÿ]", 7, 2, 10, 31

FIRST, SECOND = 0, 1
COUNTS = "word string, n long"
FOUND = "word string, n_near long, best_n long, best string"


def without_one(run: str, id_text: bytes, drop: int) -> str:
    """The run without one code point, if drop divides the crc32 of `<id>:<run>`."""
    h = zlib.crc32(run.encode(), zlib.crc32(id_text + b":"))
    return run if h % drop else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counter(run: str, least: int, drop: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    runs = re.compile(f"(?:{run}){{{least},}}")

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                in_text = Counter(runs.findall(text.as_py()))
                if drop:
                    id_text = i.as_py().encode()
                    for word, n in in_text.items():
                        counts[without_one(word, id_text, drop)] += n
                else:
                    counts.update(in_text)
                if len(counts) >= COUNTED:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return tidied(count)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: str = QUERY_RUN, least: int = QUERY_LENGTH, min_count: int = QUERY_COUNT, drop: int | None = None) -> DataFrame:
    """word, n: maximal runs of the class `run`, A-Z lower-cased, of `least` code points or more, that occur min_count times or more.

    drop: see without_one (a null id counts as empty text). Counts are summed in the tasks first, so that frequent words are no hot keys.
    """
    small_batches(docs.sparkSession)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), lower_ascii(F.col(text_col)).alias("t"))
    counted = texts.mapInArrow(_counter(run, least, drop), COUNTS)
    return counted.where(F.char_length("word") >= least).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


def _shorter(rest: str) -> set[str]:
    return {rest[:i] + rest[i + 1 :] for i in range(len(rest))}


def _open(rest: str) -> list[str]:
    return [f"{rest[:i]}\0{rest[i + 1 :]}" for i in range(len(rest))]


def one_apart(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Shard:
    """An automaton over halves of words, and for each half its words by the remaining half."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        self.index: dict[tuple[int, str], dict[str, list[tuple[str, int]]]] = defaultdict(lambda: defaultdict(list))

    def add(self, side: int, word: str, n: int) -> None:
        half, rest = halves(word)[side], halves(word)[1 - side]
        self.automaton.add_word(half, half)
        held = self.index[side, half]
        if len(rest) > LONG:
            held["long"].append((word, n))
            return
        held["=" + rest].append((word, n))
        for key in _open(rest):
            held[key].append((word, n))
        for key in _shorter(rest):
            held["-" + key].append((word, n))

    def ready(self) -> None:
        self.automaton.make_automaton()

    def near(self, side: int, word: str) -> Iterator[tuple[str, int]]:
        """The shard's words that are near and agree with the word in the half of that side; in the second only if not in the first."""
        for end, half in self.automaton.iter(word):
            if (end + 1 != len(half)) if side == FIRST else (end + 1 != len(word)):
                continue  # the half stands elsewhere
            held = self.index.get((side, half))
            if held is None:
                continue
            rest = word[len(half) :] if side == FIRST else word[: len(word) - len(half)]
            found = [x for x in held.get("long", ()) if abs(len(x[0]) - len(word)) <= 1]
            if len(rest) <= LONG + 1:
                for key in [*_open(rest), "-" + rest, *("=" + s for s in _shorter(rest))]:
                    found += held.get(key, ())
            for other, n in found:
                if one_apart(word, other) and not (side == SECOND and word.startswith(halves(other)[0])):
                    yield other, n


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, side, word, n) of a shard, its halves (kind 0) before the words to scan (kind 1)."""
    shard, built = Shard(), False
    for batch in batches:
        out = []
        for kind, side, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if kind == 0:
                shard.add(side, word, n)
                continue
            if not built:
                shard.ready()
                built = True
            if not shard.index:
                continue
            found = list(shard.near(side, word))
            if found:
                best, most = min(found, key=lambda x: (-x[1], x[0]))
                out.append((word, len(found), most, best))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, least: int, halves_a_shard: int = HALVES) -> DataFrame:
    """word, n_near, best_n, best of words that have near ones. words: a table (word, n) of distinct words of `least` code points or more, at least 2."""
    if least < 2:
        raise ValueError("both halves of a word must have a code point")
    spark = words.sparkSession
    small_batches(spark)
    total = words.count()
    shards = max(partitions(spark), -(-2 * total // halves_a_shard))
    limit = max(1_000, 2 * total // shards)
    begin, end = least // 2, least - least // 2
    anchors = F.array(F.struct(F.lit(FIRST).alias("side"), F.substring("word", 1, begin).alias("anchor")), F.struct(F.lit(SECOND).alias("side"), F.expr(f"right(word, {end})").alias("anchor")))
    sided = words.select("word", "n", F.inline(anchors))
    heavy = sided.groupBy("side", "anchor").agg(F.count("*").alias("held")).where(F.col("held") > limit)
    heavy = materialize(heavy.select("side", "anchor", F.ceil(F.col("held") / limit).cast("int").alias("parts")), "anchors")
    dealt = lookup(sided, heavy, ["side", "anchor"]).withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    kinds = F.concat(F.array(F.struct(F.lit(0).alias("kind"), own.alias("part"))), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.lit(1).alias("kind"), p.alias("part"))))
    rows = dealt.select("side", "anchor", "word", "n", F.inline(kinds)).repartition(shards, "side", "anchor", "part").sortWithinPartitions("kind")
    found = rows.select("kind", "side", "word", "n").mapInArrow(tidied(_scan), FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms. Forms are more frequent than their words, so a chain has an end, after few steps."""
    ends = materialize(links.select("word", F.col("form").alias("root")), "roots")
    onward = links.select(F.col("word").alias("root"), F.col("form").alias("further"))
    while True:
        stepped = materialize(lookup(ends, onward, ["root"]), "roots")
        if stepped.where("further IS NOT NULL").isEmpty():
            return ends
        ends = stepped.select("word", F.coalesce("further", "root").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: str = QUERY_RUN, least: int = QUERY_LENGTH, min_count: int = QUERY_COUNT, times: int = QUERY_TIMES, drop: int | None = None, halves_a_shard: int = HALVES) -> DataFrame:
    """One row a word: word, n, form, root, n_near, form_n.

    Words are the maximal runs of the class `run` of whole texts, A-Z lower-cased, of `least` code points or more and with min_count
    occurrences or more. Near words differ by one inserted, deleted or replaced code point. form: the near word with the most occurrences (ties:
    the first in code-point order), if these are `times` (at least 2) times the word's or more, else null; root: where the chain of forms ends, the word itself without one.
    Null and empty texts have no words, repeated rows count each, ids may be null, repeated and of any type; an empty table gives no rows. Other columns are not read.
    Very long texts are read whole; very long words are compared whole.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its word")
    words = materialize(count_words(docs, id_col, text_col, run, least, min_count, drop), "words")
    found = words.join(near_words(words, least, halves_a_shard), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    found = materialize(found.select("word", "n", F.when(is_form, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")), "variants")
    roots = follow(found.where("form IS NOT NULL").select("word", "form"))
    return lookup(found, roots, ["word"]).select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), drop=QUERY_DROP).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 of the bytes of {text}, from a table made by the polynomial's rule.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v
  FROM range(256) AS r(b)))"""
ORACLE = rf"""WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents)
  WHERE length(w) >= 7 GROUP BY 1, 2),
coded AS (SELECT doc_id, w, c, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s FROM runs),
bytes AS (SELECT doc_id, w, c, list_transform(range(0, CAST(octet_length(encode(s)) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(s)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM coded),
hashed AS (SELECT w, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM bytes, crc),
altered AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) + 2 AS BIGINT)) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM altered WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
opened AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS gap FROM places),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM opened a JOIN opened b ON a.gap = b.gap AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word UNION ALL SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (m = top) AS other FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.other END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS root, 0 AS step FROM formed UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, max_by(root, step) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON f.word = e.word"""
