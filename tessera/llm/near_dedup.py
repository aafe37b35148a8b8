"""MinHash near-dedup with fast similarity sketches, banding and verification on full sets.

A document is its set of word shingles (64-bit hashes). The sketch has BANDS x ROWS coordinates and is filled in rounds: in
round i every element throws a hashed value i + v into a hashed bin, and coordinate b keeps the least value of bin b. A bin
that stays empty in the first t rounds is filled in round t + b, where all elements go to it, so every
coordinate is filled, at O(n + t log t) cost, and estimates concentrate as for t independent hashes.

Documents with the same set become one node at once. Nodes that share a band share a bucket. Buckets are not expanded into
pairs: first each node is compared with the smallest centre of its buckets, then, where components still differ,
with the centres of all its buckets. Both steps verify pairs on both full sets, after sizes and very unlike sketches
have ruled pairs out. Last, in buckets that still hold several components, members are dealt into blocks, those of large buckets by
set size and component first, and each two blocks whose sizes allow a link and that are not of one component meet in one task, where intersections of all full sets come from
one matrix product over the shingles that occur twice there; only links that join components leave the task. Links are contracted
to components after each step.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, heavy_keys, join_heavy, lookup, lookup_skewed, materialize, partitions, small_batches, tidied, whole_id

#: At similarity 0.85 a pair shares no band of 25 with probability 4e-7; at 0.8, 5e-5 (use more bands).
BANDS, ROWS = 25, 5
SHINGLE = 5
#: Sketch estimates this far below the threshold rule a pair out: over six standard deviations of 125 coordinates. 1 rules none out.
MARGIN = 0.2
#: Nodes of a block, and shingles of a matrix at a time, in the last step.
BLOCK, COLUMNS = 256, 8_192
CACHED_WORDS = 100_000
NO_ID = -(2**63)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes. Keeps a bounded store of word hashes."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []  # bytes: A-Z only, and ASCII white space
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, digest = self.known, xxhash.xxh64_intdigest
        hashes = [known.get(w) for w in words]
        if None in hashes:
            for i, h in enumerate(hashes):
                if h is None:
                    hashes[i] = known[words[i]] = digest(words[i])
        h = np.array(hashes, np.uint64)
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def sketch(elements: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketch of a set that is not empty: t values, equal in a coordinate with probability J."""
    best = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    at, n = 0, len(elements)
    while at < 2 * t:
        k = min(2 * t - at, max(1, 2048 // n))
        rounds = np.arange(at, at + k, dtype=np.uint64)
        h = _mix(elements[:, None] ^ _mix(rounds + _U(0x5851F42D4C957F2D))[None, :])
        bins = np.where(rounds < t, ((h >> _U(40)) * _U(t)) >> _U(24), np.maximum(rounds, _U(t)) - _U(t))
        np.minimum.at(best, bins.ravel().astype(np.int64), ((rounds << _U(40))[None, :] | (h & _U((1 << 40) - 1))).ravel())
        at += k
        if best.max() < _U(at) << _U(40):
            break
    return best


def _describe(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Documents to key, id, node (digest of the set), set size, a hash for each band, and eight bits of each coordinate."""
    shingler, seeds = Shingler(shingle), _mix(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in batches:
        nodes, sizes, keys, short = [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingler(text)
            sizes.append(len(s))
            if not len(s):
                nodes.append(None)
                keys.append(None)
                short.append(None)
                continue
            nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            best = _mix(sketch(s, bands * rows))
            h = seeds.copy()
            for k in range(rows):
                h = _mix(h * _U(0x9E3779B97F4A7C15) + best[k::rows])
            keys.append(h.view(np.int64))
            short.append((best & _U(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())], names=["key", "id", "node", "n", "bands", "short"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(shingle)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            piece = batch.slice(at, 200)
            sets = [shingler(t) for t in piece.column("text").to_pylist()]
            same = [len(s) > 0 and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == node for s, node in zip(sets, piece.column("node").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, ok in zip(piece.column("node").to_pylist(), same, strict=True) if ok], pa.binary()), pa.array([s.tobytes() for s, ok in zip(sets, same, strict=True) if ok], pa.binary())], names=["node", "elements"])


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) >= least * len(x) for x, y in zip(batch.column("short_a").to_pylist(), batch.column("short_b").to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for at in range(0, batch.num_rows, 500):
            piece = batch.slice(at, 500)
            for x, y in zip(piece.column("set_a").to_pylist(), piece.column("set_b").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Two blocks of a bucket at a time to links that join their components."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                yield from batch.slice(at, 100).to_pylist()

    for (_, i, j), group in groupby(rows(), key=lambda r: (r["bucket"], tuple(r["i"].values()), tuple(r["j"].values()))):
        found = _links_within(list(group), i != j, percent)
        if found:
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def _links_within(members: list[dict], across: bool, percent: int) -> list[tuple[bytes, bytes]]:
    n = len(members)
    comp = np.unique([m["comp"] for m in members], return_inverse=True)[1]
    if comp.max() == 0:
        return []
    sets = [np.frombuffer(m["elements"], np.uint64) for m in members]
    size = np.array([len(s) for s in sets])
    shared, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    column = np.where(np.bincount(at) > 1, np.cumsum(np.bincount(at) > 1) - 1, -1)[at]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        inside = (column >= low) & (column < low + COLUMNS)
        matrix = np.zeros((n, min(COLUMNS, int(column.max()) + 1 - low)), np.float32)
        matrix[row[inside], column[inside] - low] = 1
        both += matrix @ matrix.T
    both = both.astype(np.float64)
    linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (comp[:, None] != comp[None, :])
    if across:
        own = np.array([m["own"] for m in members])
        linked &= own[:, None] != own[None, :]
    parent = list(range(comp.max() + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(*(k.tolist() for k in np.nonzero(np.triu(linked))), strict=True):
        a, b = root(int(comp[x])), root(int(comp[y]))
        if a != b:
            parent[a] = b
            out.append((members[x]["node"], members[y]["node"]))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node of its component.

    Roots hook onto their smallest neighbouring root, then paths are halved; the number of roots falls by a factor in each
    round. Each round is written to the shared folder. Edges are distributed throughout.
    """
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    heavy = {side: heavy_keys(edges, side) for side in ("a", "b")}
    labels = materialize(edges.select(F.col("a").alias("node"), "b").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("b"))).groupBy("node").agg(F.least(F.min("node"), F.min("b")).alias("comp")), "labels")
    while True:
        of = lambda side: labels.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
        between = join_heavy(join_heavy(edges, of("a"), "a", heavy["a"]), of("b"), "b", heavy["b"]).where("ca <> cb")
        hooks = between.groupBy(F.greatest("ca", "cb").alias("comp")).agg(F.min(F.least("ca", "cb")).alias("to"))
        hooks = materialize(hooks, "hooks")
        jumped = _by_comp(labels, labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))).select("node", F.coalesce("root", "comp").alias("comp"))
        if hooks.limit(1).count() == 0:
            settled = jumped.join(labels.withColumnRenamed("comp", "old"), "node").where("comp <> old").limit(1).count() == 0
            if settled:
                return labels
            labels = materialize(jumped, "labels")
            continue
        once = hooks.select(F.col("comp").alias("to"), F.col("to").alias("then"))
        hooks = hooks.join(once, "to", "left").select("comp", F.coalesce("then", "to").alias("to"))
        labels = materialize(_by_comp(jumped, hooks).select("node", F.coalesce("to", "comp").alias("comp")), "labels")


def _by_comp(labels: DataFrame, table: DataFrame) -> DataFrame:
    """Labels with the row that table (one a comp) has for their component; a component may hold much of all nodes."""
    sizes = labels.groupBy("comp").agg(F.count("*").alias("nodes"))
    return lookup_skewed(labels, sizes.join(table, "comp"), "comp", "nodes", labels.count()).drop("nodes")


def near_groups(
    docs: DataFrame, percent: int = 80, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. Words are runs of anything but
    ASCII white space, A-Z lowered; a text of fewer words than a shingle is one shingle; one without words is empty and
    linked with nothing, its component_id its own id. Repeated rows share a component; a null id gives no component
    its name unless all ids of the component are null, and such a row is not kept where the component has a
    smallest id. Columns beside id and text are not read. An empty table gives an empty result. Ids are whole numbers (others are
    an error). A very long text is a set like any other, held whole by the task that reads it. margin: see MARGIN.
    """
    whole = whole_id(docs, id_col)
    source = docs.select(F.coalesce(whole, F.lit(NO_ID)).alias("key"), whole.alias("id"), F.col(f"`{text_col}`").alias("text"))
    full = _grouped(source, percent, shingle, bands, rows, margin)
    return full.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(source: DataFrame, percent: int, shingle: int, bands: int, rows: int, margin: float = MARGIN) -> DataFrame:
    """Rows (key, id, text) to key, id, n, component_id and keeper: the key of the component's first row by id (nulls last), node and key."""
    spark = source.sparkSession
    small_batches(spark)
    described = source.mapInArrow(tidied(lambda it: _describe(it, shingle, bands, rows)), "key long, id long, node binary, n long, bands array<long>, short binary")
    described = materialize(described, "sketches")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")
    nodes = described.where("node IS NOT NULL").groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("short").alias("short"))
    nodes = materialize(nodes, "nodes")

    # Buckets of two nodes or more, with their smallest node as centre.
    member = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    centre = member.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("centre"), F.count("*").alias("members")).where("members > 1")
    centre = materialize(centre.select("bucket", F.col("centre.node").alias("centre"), F.col("centre.n").alias("centre_n"), "members"), "centres")
    member = lookup_skewed(member, centre, "bucket", "members", nodes.count() * bands).where("centre IS NOT NULL").drop("members")
    member = materialize(member, "members")
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)

    # Full sets of the nodes that have a bucket with others.
    needed = member.select("node").distinct().join(nodes.select("node", F.col("first.key").alias("key")), "node")
    texts = _by_key(source, needed)
    sets = materialize(texts.mapInArrow(tidied(lambda it: _sets(it, shingle)), "node binary, elements binary").dropDuplicates(["node"]), "sets")
    shorts = nodes.select("node", "short")
    least = max(0.0, percent / 100 - margin)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        heavy = heavy_keys(pairs, "b")  # a centre may stand in a large share of the pairs
        pairs = join_heavy(pairs.join(shorts.withColumnsRenamed({"node": "a", "short": "short_a"}), "a"), shorts.withColumnsRenamed({"node": "b", "short": "short_b"}), "b", heavy)
        pairs = pairs.mapInArrow(tidied(lambda it: _alike(it, least)), "a binary, b binary")
        pairs = materialize(pairs, "like-pairs")
        pairs = join_heavy(pairs.join(sets.withColumnsRenamed({"node": "a", "elements": "set_a"}), "a"), sets.withColumnsRenamed({"node": "b", "elements": "set_b"}), "b", heavy)
        return pairs.mapInArrow(tidied(lambda it: _linked(it, percent)), "a binary, b binary")

    # 1: a pair for each node, with the smallest centre of its buckets.
    other = F.when((F.col("node") != F.col("centre")) & fits(F.col("n"), F.col("centre_n")), F.col("centre"))
    first = member.groupBy("node").agg(F.min(other).alias("b")).where("b IS NOT NULL").select(F.col("node").alias("a"), "b")
    labels = components(verified(first))
    # 2: with the centres of all buckets, where that may join components.
    label = lambda side: labels.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    comp = lambda side: F.coalesce(f"c{side}", side)
    spokes = member.where((F.col("node") != F.col("centre")) & fits(F.col("n"), F.col("centre_n"))).select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    open_ = spokes.join(label("a"), "a", "left").join(label("b"), "b", "left").where(comp("a") != comp("b")).select("a", "b")
    labels = _contract(labels, verified(open_))
    # 3: members of different components in a bucket, by blocks.
    placed = member.select("bucket", "node", "n").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low <> high").select("bucket", "size")
    placed = lookup_skewed(placed, materialize(mixed, "mixed-buckets"), "bucket", "size", member.count()).where("size IS NOT NULL")
    blocks = _in_blocks(materialize(placed, "mixed"), percent).join(sets, "node")
    blocks = blocks.repartition(partitions(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    labels = _contract(labels, blocks.mapInArrow(tidied(lambda it: _block_links(it, percent)), "a binary, b binary"))

    firsts = nodes.select("node", "first.*", "copies").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least_row = firsts.groupBy("comp").agg(F.min(F.struct("unnamed", "id", "node", "key")).alias("least"), F.count("*").alias("nodes"))
    groups = lookup_skewed(firsts, least_row, "comp", "nodes", firsts.count()).select("node", "copies", F.col("least.id").alias("component_id"), F.col("least.key").alias("keeper"))
    docs_of = described.select("key", "id", "node", "n")
    full = lookup_skewed(docs_of.where("node IS NOT NULL"), groups, "node", "copies", docs_of.count()).select("key", "id", "n", "component_id", "keeper")
    return full.unionByName(docs_of.where("node IS NULL").select("key", "id", "n", F.col("id").alias("component_id"), F.col("key").alias("keeper")))


def _in_blocks(placed: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Members (bucket, size, node, n, comp) to rows (bucket, i, j, own, node, comp): a member's own block is i or j, and blocks i and j are to be compared.

    Of a bucket of more than `block` members the blocks are of one class of set sizes each. Classes are wide enough that sets in classes not next
    to one another cannot be linked, whatever they hold. A component with `block` members or more in a class has blocks of its own, which
    do not meet one another: members that are linked already are copied only for the blocks of others.
    """
    width = 1.001 * math.log(100 / percent) if percent < 100 else 1e-9
    rows = placed.withColumn("class", F.when(F.col("size") > block, F.floor(F.log("n") / width)).otherwise(F.lit(0)).cast("long"))
    shared = F.lit("").cast("binary")
    held = rows.groupBy("bucket", "class", "comp").agg(F.count("*").alias("held")).withColumn("owner", F.when(F.col("held") >= block, F.col("comp")).otherwise(shared))
    groups = held.groupBy("bucket", "class", "owner").agg(F.sum("held").alias("held")).withColumn("parts", F.ceil(F.col("held") / block).cast("int"))
    groups = materialize(groups, "block-groups")

    facing = groups.select("bucket", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), F.col("class").alias("class_b"), F.col("owner").alias("owner_b"), F.col("parts").alias("parts_b"))
    facing = groups.join(facing, ["bucket", "class"]).where((F.col("owner") == shared) | (F.col("owner") != F.col("owner_b")))
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    facing = facing.withColumn("part", each("parts")).withColumn("part_b", each("parts_b"))
    facing = facing.select("bucket", F.struct("class", "owner", "part").alias("block"), F.struct(F.col("class_b").alias("class"), F.col("owner_b").alias("owner"), F.col("part_b").alias("part")).alias("other"))

    total = rows.count()
    owned = groups.where(F.col("owner") != shared).select(F.struct("bucket", "class", F.col("owner").alias("comp")).alias("of"), "owner", "parts", "held")
    mixed = groups.where(F.col("owner") == shared).select(F.struct("bucket", "class").alias("of"), F.col("parts").alias("shared_parts"), F.col("held").alias("shared_held"))
    rows = lookup_skewed(rows.withColumn("of", F.struct("bucket", "class", "comp")), owned, "of", "held", total).drop("held")
    rows = lookup_skewed(rows.withColumn("of", F.struct("bucket", "class")), mixed, "of", "shared_held", total)
    part = F.pmod(F.xxhash64("node", "bucket"), F.coalesce("parts", "shared_parts")).cast("int")
    rows = rows.select("bucket", F.struct("class", F.coalesce("owner", shared).alias("owner"), part.alias("part")).alias("block"), "node", "comp").join(facing, ["bucket", "block"])
    return rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("own"), "node", "comp")


def drop_near_copies(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest id, nulls last, whatever ids repeat or are null.

    Rows are told apart by a number given in a first pass, which writes them down; of rows with the same id one
    stays. Texts without words all stay. Options as for near_groups().
    """
    whole_id(docs, id_col)
    held = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key")), "rows")
    source = held.select("key", F.col(f"row.`{id_col}`").cast("long").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    gone = materialize(_grouped(source, percent, shingle, bands, rows, margin).where("key <> keeper").select("key"), "gone")
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return held.join(F.broadcast(gone) if small else gone, "key", "left_anti").select("row.*")


def _by_key(source: DataFrame, needed: DataFrame) -> DataFrame:
    """Texts of the documents that stand for needed nodes; repeated keys may bring others, which _sets leaves out."""
    return lookup(source.select("key", "text"), needed, ["key"], "inner").select("node", "text")


def _contract(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after further edges, which are contracted to components first."""
    edges = materialize(edges, "links")
    of = lambda side: labels.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    joined = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    old = _by_comp(labels, more).select("node", F.coalesce("root", "comp").alias("comp"))
    new = more.select(F.col("comp").alias("node"), F.col("root").alias("comp")).join(labels.select("node"), "node", "left_anti")
    return materialize(old.unionByName(new), "labels")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS t FROM e),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM g UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, w.doc_id) AS component_id, coalesce(c.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.doc_id
"""


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
