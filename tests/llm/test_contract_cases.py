"""Every operator on awkward tables: nulls, empty and long texts, ties, repeated rows, clashing column names, no rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size long, row string"


def docs_of(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 7, "r") for i, t, s in rows], DOCS)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = words(120, 1)
    near = base.replace("w1 ", "zz ", 1) + " end"
    out = [(i, words(60 + i, 100 + i), f"s{i % 3}") for i in range(20)]
    out += [(30, base, "s0"), (31, near, "s0"), (32, base, None), (33, base, "s1"), (34, None, None), (35, "", "s2"), (36, "  \n\t", "s2"), (37, "One two", "s0"), (38, "one TWO", "s0"), (None, "null id text here and more words", "s1"), (39, words(30_000, 5, 5000), "s0")]
    out += [(40, "same row twice", "s1")] * 2
    return out


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


# --- exact dedup ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, rows, keep):
    from tessera.llm.exact_dedup import drop_copies, exact_groups

    got = exact_groups(docs_of(spark, rows), keep=keep).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    best = min if keep == "smallest" else max
    want = Counter((i, best([x for x in groups[t or ""] if x is not None], default=None), len(groups[t or ""]), sha(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = drop_copies(docs_of(spark, rows), keep=keep)
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(map(sha, (r.text for r in kept.collect()))) == sorted(map(sha, groups))
    assert exact_groups(docs_of(spark, [])).count() == 0


def test_exact_dedup_cuts_a_hot_group_over_ranges(spark):
    from tessera.llm.exact_dedup import exact_groups

    got = exact_groups(docs_of(spark, [(i, "hot", "s") for i in range(500)] + [(1000 + i, f"cold {i}", "s") for i in range(100)]), keep="largest").collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 500} == {(499, 500)}
    assert [r.doc_id for r in got if r.kept and r.doc_id < 500] == [499]


@pytest.mark.parametrize("cut", [128, 4])
def test_exact_dedup_of_texts_that_begin_alike(spark, cut):
    """Most rows share more first characters than a splitter holds; among them texts of one copy and of very many. Order is of whole contents."""
    from tessera.llm import exact_dedup

    head = "the same first words on every page " * 10
    rows = [(i, head + str(i % 150), "s") for i in range(600)] + [(1000 + i, head + "hot", "s") for i in range(500)] + [(2000 + i, f"{i} other", "s") for i in range(100)] + [(None, head + "hot", "s"), (3000, head + "é" * 50_000, "s")]
    docs = docs_of(spark, rows).repartition(6, "doc_id").sortWithinPartitions("doc_id")  # a fixed order, so that the sample is the same each time
    got = exact_dedup.exact_groups(docs, keep="largest", cut_chars=cut).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t].append(i)
    want = Counter((i, max(x for x in groups[t] if x is not None), len(groups[t]), sha(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sorted(r.doc_id for r in got if r.kept) == sorted({k for _, k, _, _ in want})
    ranged, splitters = exact_dedup._ranged(docs.select(F.col("doc_id").alias("id"), "text"), 4, cut)
    sizes = Counter(r.part for r in ranged.select("part").collect())
    assert len(sizes) == 4 and max(sizes.values()) < 700
    ordered = ranged.sortWithinPartitions("text").select("part", F.spark_partition_id().alias("at"), F.encode("text", "UTF-8").alias("b")).collect()
    assert all(r.part == r.at for r in ordered)
    assert all(bytes(x.b) <= bytes(y.b) for x, y in zip(ordered, ordered[1:]) if x.part == y.part)


def test_exact_dedup_normalisation(spark):
    from tessera.llm.exact_dedup import exact_groups

    got = exact_groups(docs_of(spark, [(1, "A  b", "s"), (2, "a b ", "s"), (3, "ａ b", "s")]), normalise="lower").collect()
    assert {r.doc_id: r.keep_id for r in got} == {1: 1, 2: 1, 3: 3}


# --- near dedup ----------------------------------------------------------------------------------------------------


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_brute(rows, percent):
    sets = {}
    for i, t, _ in rows:
        sets.setdefault((i, t), shingles(t))
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(keys[a])] = root(keys[b])
    least = {}
    for k in keys:
        ids = [i for i in (least.get(root(k)), k[0]) if i is not None]
        least[root(k)] = min(ids) if ids else None
    return {k: (len(sets[k]), least[root(k)]) for k in keys}


def test_near_dedup_against_brute_force(spark, rows):
    from tessera.llm.near_dedup import drop_near_copies, near_groups

    more = list(rows)
    r = random.Random(3)
    for c in range(6):  # chains whose ends are not linked, and groups around the threshold
        w = words(100, 900 + c).split()
        for k in range(8):
            w = list(w)
            w[r.randrange(100)] = f"edit{k}"
            more.append((100 + 10 * c + k, " ".join(w), "s0"))
    for percent in (85, 80):
        got = near_groups(docs_of(spark, more), percent=percent).collect()
        want = near_brute(more, percent)
        assert len(got) == len(more)
        by_text = {i: want[(i, t)] for i, t, _ in more}
        assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == {(i, *v) for i, v in by_text.items()}
        assert all(x.kept == (x.doc_id == x.component_id) for x in got)
    left = drop_near_copies(docs_of(spark, more), percent=85)
    assert left.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert near_groups(docs_of(spark, [])).count() == 0
    assert near_groups(docs_of(spark, [(1, None, "s"), (2, "", "s")])).select("component_id").distinct().count() == 2


def test_near_dedup_keeps_one_row_of_each_component(spark):
    """Null and repeated ids: no clean row goes with a near copy of its id, and near copies under one id leave one."""
    from tessera.llm.near_dedup import drop_near_copies

    near = lambda seed, k: words(100, seed) + f" edit{k}"
    rows = [(1, near(1, 0)), (None, near(1, 1)), (None, words(80, 2)), (None, words(80, 3)), (9, near(1, 2)), (9, words(80, 4))]
    rows += [(20, near(5, k)) for k in range(3)] + [(None, near(6, k)) for k in range(3)] + [(30, words(80, 7))] * 2 + [(40, ""), (40, ""), (None, None)]
    rows += [(8, near(8, 0)), (7, near(8, 1)), (None, near(9, 0)), (50, near(9, 1))]
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    members = defaultdict(list)
    for c, (i, t) in zip(comp, rows, strict=True):
        members[c].append((i, t))
    left = [(r.doc_id, r.text) for r in drop_near_copies(docs_of(spark, [(i, t, f"s{k}") for k, (i, t) in enumerate(rows)])).collect()]
    assert len(left) == len(members)
    for group in members.values():
        least = min((i for i, _ in group if i is not None), default=None)
        assert sum(x in left for x in {x for x in group if x[0] == least}) == 1
        assert not any(x in left for x in group if x[0] != least)


def pairs_at(percent, n, seed, low=60, high=400):
    """Pairs of documents whose shingle sets are just as alike as percent asks for (the least intersection that links them)."""
    r, out = random.Random(seed), []
    for k in range(n):
        size = r.randrange(low, high)
        base = [f"p{k}w{i}" for i in range(size)]
        other = list(base)
        need = lambda x: 100 * len(x & y) >= percent * len(x | y)
        y = shingles(" ".join(base))
        for at in r.sample(range(size), size):  # single words are changed as long as the pair stays linked
            changed = [*other[:at], f"p{k}x{at}", *other[at + 1 :]]
            if need(shingles(" ".join(changed))):
                other = changed
            elif 100 * len(shingles(" ".join(other)) & y) <= (percent + 1) * len(shingles(" ".join(other)) | y):
                break
        out.append((" ".join(base), " ".join(other)))
    return out


def test_near_dedup_recall_at_the_threshold(spark):
    """300 pairs of similarity between 85 and 86 percent: none is lost."""
    from tessera.llm.near_dedup import near_groups

    pairs = pairs_at(85, 300, 7)
    rows = [(2 * k + i, t, "s") for k, p in enumerate(pairs) for i, t in enumerate(p)]
    got = {x.doc_id: x.component_id for x in near_groups(docs_of(spark, rows), percent=85).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(300))


def test_large_buckets_by_size_classes(spark):
    """Every pair in a bucket that sizes allow to be linked meets in a pair of blocks, once; blocks are bounded."""
    from tessera.llm.near_dedup import _in_blocks

    r = random.Random(2)
    members = [(1, 300, f"n{k}".encode(), r.choice((20, 21, 40, 46, 47, 48, 55, 100, 117, 118)), f"c{k}".encode()) for k in range(300)] + [(2, 3, f"m{k}".encode(), 10 * k + 1, b"c") for k in range(3)]
    rows = _in_blocks(spark.createDataFrame(members, "bucket long, size long, node binary, n long, comp binary"), 85, block=32).collect()
    groups = defaultdict(list)
    for x in rows:
        groups[(x.bucket, tuple(x.i), tuple(x.j))].append(x)
    met = Counter()
    for (_, i, j), g in groups.items():
        assert len(g) <= 64 * 4
        for a in range(len(g)):
            for b in range(a):
                if i == j or g[a].own != g[b].own:
                    met[frozenset((bytes(g[a].node), bytes(g[b].node)))] += 1
    assert set(met.values()) == {1}
    size = {node: n for _, _, node, n, _ in members}
    for a in range(300):
        for b in range(a):
            x, y = members[a][2], members[b][2]
            if 100 * min(size[x], size[y]) >= 85 * max(size[x], size[y]):
                assert met[frozenset((x, y))] == 1
    assert met[frozenset((b"n0", b"n1"))] in (0, 1) and sum(met.values()) < 300 * 299 / 2 and all(met[frozenset((f"m{a}".encode(), f"m{b}".encode()))] == 1 for a in range(3) for b in range(a))


def test_a_stray_in_a_large_bucket_costs_the_bucket_once(spark):
    """Members of one component meet no other of its blocks; strays meet every member whose size allows a link, and one another."""
    from tessera.llm.near_dedup import _in_blocks

    members = [(1, 2_003, f"n{k}".encode(), 100, b"one") for k in range(1_500)] + [(1, 2_003, f"m{k}".encode(), 100, b"two") for k in range(500)] + [(1, 2_003, f"s{k}".encode(), 100, f"s{k}".encode()) for k in range(3)]
    rows = _in_blocks(spark.createDataFrame(members, "bucket long, size long, node binary, n long, comp binary"), 85, block=100).collect()
    comp = {bytes(node): c for _, _, node, _, c in members}
    groups = defaultdict(list)
    for x in rows:
        groups[(tuple(x.i), tuple(x.j))].append(x)
    met = Counter()
    for (i, j), g in groups.items():
        for a in range(len(g)):
            for b in range(a):
                if (i == j or g[a].own != g[b].own) and comp[bytes(g[a].node)] != comp[bytes(g[b].node)]:
                    met[frozenset((bytes(g[a].node), bytes(g[b].node)))] += 1
    assert set(met.values()) == {1} and len(met) == 1_500 * 500 + 2_000 * 3 + 3
    assert len(rows) == 1_500 * (5 + 1) + 500 * (15 + 1) + 3 * (15 + 5 + 1)
    stray = [m for m in members if m[4] != b"two"][:1_501]
    assert len(_in_blocks(spark.createDataFrame(stray, "bucket long, size long, node binary, n long, comp binary"), 85, block=100).collect()) == 1_500 + 15 + 1


def test_sketch_fills_and_estimates():
    import numpy as np

    from tessera.llm.near_dedup import sketch

    for n in (1, 2, 10, 1000):
        assert sketch(np.arange(n, dtype=np.uint64)).max() < np.iinfo(np.uint64).max
    a, b = np.arange(2000, dtype=np.uint64), np.arange(300, 2300, dtype=np.uint64)
    assert abs(np.mean(sketch(a, 1000) == sketch(b, 1000)) - 1700 / 2300) < 0.06


def test_links_only_found_in_blocks(spark):
    """Members of a bucket that are not linked to any centre are compared with one another."""
    from tessera.llm.near_dedup import _links_within

    import numpy as np

    def member(node, comp, elements, own):
        return {"node": node, "comp": comp, "elements": np.array(sorted(elements), np.uint64).tobytes(), "own": own}

    base = set(range(100))
    m = [member(b"a", b"a", base, 0), member(b"b", b"b", base - {1, 2, 3}, 1), member(b"c", b"c", set(range(200, 300)), 1), member(b"d", b"a", base - {50}, 0)]
    assert _links_within(m, False, 85) == [(b"a", b"b")]
    assert _links_within(m, True, 85) == [(b"a", b"b")]


# --- decontamination -----------------------------------------------------------------------------------------------


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_brute(rows, items):
    windows = defaultdict(set)
    for name, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(name))
    out = []
    for i, t, _ in rows:
        w, hit, found = alnum(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[k]
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [10_000_000, 200])
def test_decontamination_against_brute_force(spark, rows, block_bytes):
    from tessera.llm.decontaminate import contamination, decontaminate

    passage, short = words(40, 77), "rare little phrase"
    items = [(1, passage), (2, short), (3, None), (4, "..."), (5, passage), (6, words(30, 101) + " tail"), (10, "é ß 東京 Rare")]
    more = rows + [(200, words(50, 9) + " " + passage.upper() + " " + words(20, 10), "s0"), (201, " ".join(passage.split()[5:25]), "s1"), (202, f"some {short}! {short} and {words(500, 3)}", "s1"), (203, "é ß 東京 rare", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    options = {"block_bytes": block_bytes, "shard_words": 500}
    got = contamination(docs_of(spark, more), bench, **options).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == contamination_brute(more, items)
    kept = decontaminate(docs_of(spark, more), bench, **options)
    assert kept.count() == sum(not r.contaminated for r in got) and "row" in kept.columns
    assert contamination(docs_of(spark, []), bench).count() == 0
    assert contamination(docs_of(spark, more), bench.limit(0)).where("n_hit > 0").count() == 0


def longest_brute(text, items):
    w, best = alnum(text), None
    for name, t in items:
        q = alnum(t)
        for j in range(len(q)):
            need = min(13, len(q))
            for i in range(len(w)):
                if (len(q) < 13 and j) or w[i : i + need] != q[j : j + need] or len(q[j:]) < need:
                    continue
                n = 0
                while i + n < len(w) and j + n < len(q) and w[i + n] == q[j + n]:
                    n += 1
                key = (-n, i, name is None, str(name), j)
                best = key if best is None or key < best else best
    return best and (-best[0], best[1], None if best[2] else best[3], best[4])


@pytest.mark.parametrize("block_bytes", [10_000_000, 150])
def test_longest_matches_against_brute_force(spark, block_bytes):
    """Benchmark items that share passages, with one another and with themselves, and documents that join parts of several."""
    from tessera.llm.decontaminate import contamination

    r = random.Random(9)
    stock = [words(25, 500 + k, 60) for k in range(4)]
    items = [(k, " ".join(r.choice(stock) for _ in range(3)) + " " + words(r.randrange(12), k, 60)) for k in range(12)] + [(50, "only four words here"), (51, stock[0]), (51, "four words"), (None, stock[1] + " without a name"), (52, None), (53, "a " * 40)]
    docs = [(k, " ".join([words(20, 700 + k, 60), *(items[r.randrange(12)][1][r.randrange(80) :] for _ in range(3)), "only FOUR words, here"]), "s") for k in range(25)]
    docs += [(100, "only four words here", "s"), (101, "a " * 100, "s"), (102, stock[1] + " without a name", "s"), (103, None, "s"), (104, words(50, 5), "s")]
    got = {x.doc_id: x.longest and tuple(x.longest) for x in contamination(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes, shard_words=400).collect()}
    assert got == {i: longest_brute(t, items) for i, t, _ in docs}


@pytest.mark.parametrize("block_bytes", [10_000_000, 100])
def test_benchmark_items_without_an_id_are_searched(spark, block_bytes):
    from tessera.llm.decontaminate import contamination, decontaminate

    one, two, three = words(20, 1), words(20, 2), words(20, 3)
    bench = spark.createDataFrame([(None, one), (2, two), (None, two), (None, None)], "item_id long, text string")
    docs = docs_of(spark, [(1, "x " + one, "s"), (2, two + " y", "s"), (3, three, "s")])
    got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in contamination(docs, bench, block_bytes=block_bytes).collect()}
    assert got == {1: (20, [], True), 2: (20, ["2"], True), 3: (0, [], False)}
    assert [r.doc_id for r in decontaminate(docs, bench, block_bytes=block_bytes).collect()] == [3]


# --- url filters ---------------------------------------------------------------------------------------------------


def url_brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_filters(spark):
    from tessera.llm.url_filter import judge_urls, rule_table

    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.org", "/", "block"), ("example.org", "/es/x/y", "allow"), ("net", "", "block")]
    hosts = ["example.org", "A.Example.ORG", "b.a.example.org", "x.com", "com", "notexample.org", "y.net", "", "a..org", "." * 200 + "com"]
    paths = ["", "/", "/es/", "/es/x/y/z", "/es", "/en/12?q=/es/", "/en/2#/en/1", "/fr/1", "/de/", "?a=/de/", "#x"]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in paths] + [None, "", "no scheme/es/", "http://example.org/es/a://b.com/de/"]
    urls += ["http://example.org/es/" + "x" * 20_000]
    rows = [(i, u, "h", "p") for i, u in enumerate(urls)] + [(5, urls[5], "h", "p"), (None, urls[2], "h", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    got = Counter(tuple(r) for r in judge_urls(pages, rule_table(spark, rules)).collect())
    assert got == Counter((i, *url_brute(u, rules)) for i, u, *_ in rows)
    none = judge_urls(pages, rule_table(spark, rules).limit(0), default="block").collect()
    assert len(none) == len(rows) and all(r.rule is None and r.verdict == "block" for r in none)
    assert judge_urls(pages.limit(0), rule_table(spark, rules)).count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------


def fill(sizes, repeats=3, weights=(5, 2, 1)):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, target = sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    free, left = set(sizes), float(sum(sizes.values()))
    while free and total:
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = {k for k in free if share[k] > repeats * sizes[k]}
        if not over:
            target.update(share)
            break
        for k in over:
            target[k] = float(repeats * sizes[k])
        left, free = left - sum(target[k] for k in over), free - over
    return target


def test_mixing(spark, rows):
    from tessera.llm.mixing import mix

    many = rows + [(1000 + i, words(5 + i % 40, i), ["big", "small", None][min(2, i % 50)]) for i in range(600)] + [(5000 + i, "", "empty") for i in range(3)]
    got = mix(docs_of(spark, many)).collect()
    count = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    sizes = Counter()
    for _, t, s in many:
        sizes[s] += count(t)
    for s in {s for _, _, s in many} - set(sizes):
        sizes[s] = 0
    target = fill(dict(sizes))
    assert len(got) == len(many)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, count(t)) for i, t, _ in many)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in target.items():
        largest = max(count(x) for _, x, k in many if k == s)
        assert abs(taken[s] - t) <= largest + 1e-6
    again = mix(docs_of(spark, many[::-1])).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    assert mix(docs_of(spark, [])).count() == 0
    carried = mix(docs_of(spark, many), carry=["doc_id", "row"])
    assert carried.count() == len(many) and carried.select("row.row").first()[0] == "r"
    given = mix(docs_of(spark, many), weights=spark.createDataFrame([("big", 1.0)], "source string, weight double"))
    assert given.where("source <> 'big' AND taken > 0").count() == 0


@pytest.mark.parametrize("sizes", [(4, 4, 4, 4), (4, 4, 4, 4, 4, 4, 1), (1, 1, 100), (0, 0, 5), (7,)])
def test_mixing_of_sources_that_tie(spark, sizes):
    """Sources of one size and weight: targets by plain water filling."""
    from tessera.llm.mixing import mix

    rows = [(1000 * k + i, "a b c d e", f"s{k}") for k, n in enumerate(sizes) for i in range(n)] + [(9000 + k, "", f"s{k}") for k, n in enumerate(sizes) if not n]
    got = {(r.source, r.target) for r in mix(docs_of(spark, rows)).select("source", "target").distinct().collect()}
    want = fill({f"s{k}": 5 * n for k, n in enumerate(sizes)})
    assert {s for s, _ in got} == set(want) and all(math.isclose(t, want[s], rel_tol=1e-9, abs_tol=1e-9) for s, t in got)


# --- toxicity ------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    from tessera.llm.toxicity import drop_toxic, toxicity

    r = random.Random(8)
    bad = ["vileword", "nastyterm", "cruelname", "vilest"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = words(60, i, 3000).split()
        for _ in range(4 if toxic else 0):
            w[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(w), "s"))
        if i % 7 < 3:
            labels.append((i, 1, int(toxic)))
    rows += [(None, "x", "s"), (1001, None, "s"), (1002, "", "s"), (5, rows[5][1], "s")]
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.held_out == (zlib.crc32((str(x.doc_id) if x.doc_id is not None else "").encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7)
    held = [(x.predicted, int(x.doc_id % 6 == 0)) for x in got if x.held_out and x.doc_id is not None and x.doc_id < 900]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    # A label in the held-out fold changes nothing.
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    same = {(x.doc_id, round(x.score, 9)) for x in toxicity(docs, flipped).collect()}
    assert same == {(x.doc_id, round(x.score, 9)) for x in toxicity(docs, marks.where("doc_id is not null and toxic is not null")).collect()}
    assert drop_toxic(docs, marks).count() == sum(x.predicted == 0 for x in got)
    assert len({x.score for x in toxicity(docs, marks.limit(0)).collect()}) == 1
    assert toxicity(docs.limit(0), marks).count() == 0


@pytest.mark.parametrize("n_u", [600, 3000])
def test_toxic_words_that_clean_texts_use_too(n_u):
    """Words in half of the toxic and 4 % of the clean texts tell them apart, at any size of U."""
    from tessera.llm.toxicity import fit_nnpu, text_features

    r = random.Random(4)

    def text(toxic, seed):
        return " ".join([words(40, seed, 3000), *(f"crude{chr(97 + k)}" * 2 for k in range(16) if r.random() < (0.5 if toxic else 0.04))])

    positive = [text_features(text(True, k)) for k in range(200)]
    unlabelled = [text_features(text(k % 10 == 0, 1000 + k)) for k in range(n_u)]
    model = fit_nnpu(positive, unlabelled, 0.1)
    score = model.scorer()
    called = lambda toxic, seed: sum(score(text(toxic, seed + k)) >= 0.7 for k in range(400)) / 400
    assert called(True, 10_000) > 0.9 and called(False, 20_000) < 0.05


def test_nnpu_corrects_for_hidden_positives():
    import numpy as np

    from tessera.llm.toxicity import fit_nnpu

    r = np.random.default_rng(0)
    positive = [np.array(sorted({2, 4 + 2 * int(r.integers(500))}), np.int32) for _ in range(200)]
    clean = [np.array(sorted({4 + 2 * int(r.integers(500)) for _ in range(3)}), np.int32) for _ in range(700)]
    model = fit_nnpu(positive, clean + positive[:80], 80 / 780)
    assert 2 in model.features and model.weights[list(model.features).index(2)] > 2


@pytest.mark.parametrize("shift", [0.0, -4.0])
def test_nnpu_risk_and_gradient_against_brute_force(shift):
    """Both branches: the risk by its definition, and the derivative by differences of what the step should lower (or raise)."""
    import numpy as np

    from tessera.llm.toxicity import nnpu_step

    r = np.random.default_rng(3)
    n_p, n_u, prior, gamma = 7, 11, 0.4, 0.7
    z = np.append(r.normal(2, 1, n_p), r.normal(shift, 1, n_u))
    loss = lambda x, y: math.log(1 + math.exp(-y * x))

    def parts(z):
        positive = prior * sum(loss(x, 1) for x in z[:n_p]) / n_p
        return positive, sum(loss(x, -1) for x in z[n_p:]) / n_u - prior * sum(loss(x, -1) for x in z[:n_p]) / n_p

    positive, negative = parts(z)
    assert (negative >= 0) == (shift == 0.0)
    goal = (lambda z: sum(parts(z))) if negative >= 0 else lambda z: -gamma * parts(z)[1]
    risk, by_z = nnpu_step(z, n_p, prior, gamma)
    assert math.isclose(risk, positive + max(0, negative), rel_tol=1e-12)
    for k in range(n_p + n_u):
        e = np.eye(n_p + n_u)[k] * 1e-5
        assert abs((goal(z + e) - goal(z - e)) / 2e-5 - by_z[k]) < 1e-8


def test_feature_choice_on_executors_and_at_hand_agree(spark):
    """train() counts features on the executors; the same rows at hand give the same model."""
    from tessera.llm.toxicity import fit_nnpu, text_features, train

    r = random.Random(12)
    rows = [(i, " ".join([words(30, i, 800), *(["vileword"] * (i % 5 == 0)), *(["rude"] * (r.random() < 0.1))]), "s") for i in range(300)] + [(1000 + i, words(30, i, 800), "s") for i in range(40)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(0, 300, 2)]
    model = train(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    keep = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    marked = [(i, t) for i, _, t in labels if keep(i)]
    text = {i: t for i, t, _ in rows}
    several = lambda texts: [text_features(t) for t in sorted({t for t in texts})]
    hand = fit_nnpu(several(text[i] for i, t in marked if t), several(t for i, t, _ in rows if keep(i)), (sum(t for _, t in marked) + 0.5) / (len(marked) + 5))
    assert model.features.tolist() == hand.features.tolist() and len(model.features)
    assert abs(model.bias - hand.bias) < 1e-6 and max(abs(model.weights - hand.weights)) < 1e-6


def test_toxicity_of_very_long_texts(spark):
    """Whole texts count: a toxic passage after a million clean words is found; the row's other columns stay."""
    from tessera.llm.toxicity import drop_toxic, fit_nnpu, score_texts, text_features

    positive = [text_features(words(30, k) + " vileword vileword vileword vileword") for k in range(60)]
    model = fit_nnpu(positive, [text_features(words(30, 100 + k)) for k in range(300)] + positive[:20], 0.06)
    clean = words(1_000_000, 1, 5000)
    got = {x.doc_id: x.score for x in score_texts(docs_of(spark, [(1, clean, "s"), (2, clean + " vileword" * 4, "s"), (3, "", "s"), (4, None, "s")]), model, ["doc_id"]).select("row.doc_id", "score").collect()}
    assert got[2] >= 0.7 > got[1] and got[3] == got[4] < 0.7
    long = [(i, words(20_000 if i % 50 == 0 else 20, i, 800) + (" vileword" * 4 if i % 5 == 0 else ""), "s") for i in range(300)]
    kept = drop_toxic(docs_of(spark, long), spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int"))
    assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == [i for i in range(300) if i % 5]


# --- language model ------------------------------------------------------------------------------------------------


def test_lm_scoring(spark, rows):
    from tessera.llm.brown_lm import score_documents

    r = random.Random(4)
    more = list(rows)
    for i in range(300):  # two kinds of words that alternate: class bigrams predict them
        more.append((2000 + i, " ".join(f"{'ab'[k % 2]}{r.randrange(40)}" for k in range(60)), "s"))
    trace = []
    got = score_documents(docs_of(spark, more), block_words=3000, trace=trace).collect()
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t, _ in more if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in more:
        w = tokens(t)
        want[(i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6))] += 1
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    assert trace[1] > trace[0] and len(trace) >= 3
    last = [b - a for a, b in zip(trace, trace[1:])]
    assert last[-1] < 0.05 * (trace[-1] - trace[0]) and all(x > 0 for x in last[:-1])
    mine = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id >= 2000]
    assert sum(x.score for x in mine) > sum(x.base_score for x in mine) + 0.15 * sum(x.n_tokens for x in mine)
    assert score_documents(docs_of(spark, [])).count() == 0
    alone = score_documents(docs_of(spark, [(i, "a b", "s") for i in range(30) if held(i)])).collect()
    assert alone and all(x.n_known == 0 and x.train_tokens == 0 and x.score <= 0 for x in alone)


def test_lm_class_choice_against_brute_force():
    """The gain of each move by building the class bigrams again, for rare and frequent words alike."""
    import numpy as np

    from tessera.llm import brown_lm

    r = np.random.default_rng(5)
    text = [int(x) for x in r.zipf(1.4, 3000) % 60]
    classes = r.integers(1, 6, 60)
    classes[0] = 0  # the end
    text = [0, *text, 0]
    before, after = np.zeros((60, brown_lm.CLASSES)), np.zeros((60, brown_lm.CLASSES))

    def table(c):
        out = np.zeros((brown_lm.CLASSES, brown_lm.CLASSES))
        np.add.at(out, (c[text[:-1]], c[text[1:]]), 1)
        return out

    for x, y in zip(text, text[1:]):
        after[x, classes[y]] += 1
        before[y, classes[x]] += 1
    n = np.maximum(before.sum(1), after.sum(1))
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    chosen = brown_lm._choose(before, after, classes.astype(np.uint8), table(classes))
    right, selfless = 0, [w for w in range(1, 60) if n[w] and not any(x == y == w for x, y in zip(text, text[1:]))]
    for w in selfless:
        score = {}
        for b in range(1, brown_lm.CLASSES):
            c = classes.copy()
            c[w] = b
            t = table(c)
            s = (t.sum(0) + t.sum(1)) / 2
            score[b] = f(t) - 2 * f(s)
        right += score[chosen[w]] >= max(score.values()) - 1e-6 * abs(max(score.values()))
    assert right == len(selfless) > 20


def test_lm_word_partitions_by_data(spark):
    """More word partitions give the same scores."""
    from tessera.llm.brown_lm import score_documents

    docs = docs_of(spark, [(i, words(80, i, 300), "s") for i in range(120)])
    one, many = (sorted(tuple(x) for x in score_documents(docs, block_words=2000, part_bytes=k).collect()) for k in (1 << 30, 1500))
    assert [x[:5] for x in one] == [x[:5] for x in many]
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) for a, b in zip(one, many) for k in (5, 6))


def test_lm_is_a_distribution():
    import numpy as np

    from tessera.llm.brown_lm import CLASSES, PLAIN, Model

    r = np.random.default_rng(1)
    classes, count = r.integers(1, 6, 50), r.integers(1, 30, 50)
    bigrams = np.zeros((CLASSES, CLASSES), np.int64)
    np.add.at(bigrams, (0, classes), count)
    types, once = np.bincount(classes, minlength=CLASSES), np.bincount(classes[count == 1], minlength=CLASSES)
    m = Model(bigrams, types, once, int(count.sum()), 50)
    every, n = np.append(classes, m.unknown), np.append(count, 0)
    p = (1 - PLAIN) * m.next[0, every] * (n + 0.5) / m.total[every] + PLAIN * (n + 0.5) / (m.n + 0.5 * 51)
    assert 0.9 < p.sum() <= 1 + 1e-9


# --- chat formatting -----------------------------------------------------------------------------------------------


def test_chat_history_leaves_no_turn_out(spark):
    """A turn too long for history ends it: the turns before it are not repeated without it."""
    from tessera.llm.chat_format import format_windows, parse_window

    sizes = {1: (150, 100, 300, 50), 2: (150, 100, 100, 100, 50), 3: (150, 100, 300, 900), 4: (300, 300, 100, 100, 300, 50)}
    rows = [(c, k, "user", " ".join([f"t{k}"] * (n - 4))) for c, ns in sizes.items() for k, n in enumerate(ns)]
    windows = format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    seen = defaultdict(list)
    for w in sorted(windows, key=lambda w: (w.conv_id, w.window)):
        turns = [int(text[1 : text.find(" ")]) for _, text, _, _ in parse_window(w.text)]
        assert turns == list(range(turns[0], turns[-1] + 1))
        seen[w.conv_id] += turns[w.repeated :]
    assert seen == {c: list(range(len(ns))) for c, ns in sizes.items()}
    assert any(w.repeated for w in windows if w.conv_id == 4)  # the others' turns but for the longest fit one window


def test_chat_windows_are_full(spark):
    """A window ends only where the next turn does not fit, or with its stretch; the same however the rows lie."""
    from tessera.llm.chat_format import STRETCH, format_windows, parse_window

    r = random.Random(5)
    sizes = [r.randrange(5, 60) for _ in range(1500)]
    rows = [(1, k, "user", " ".join(["t"] * (n - 4))) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(format_windows(df, 100, 30).collect(), key=lambda w: w.window)
    assert [tuple(w) for w in got] == sorted((tuple(w) for w in format_windows(df.repartition(7), 100, 30).collect()), key=lambda w: w[1])
    want, fill, stretch, before = [], 0, -1, 0
    for k, n in enumerate(sizes):
        if before // (70 * STRETCH) != stretch or fill + n > 70:
            want.append(k)
            fill = 0
        stretch, fill, before = before // (70 * STRETCH), fill + n, before + n
    assert [w.window for w in got] == want
    assert sum(len(parse_window(w.text)) - w.repeated for w in got) == 1500


def test_chat_ids_are_whole_numbers(spark):
    from tessera.llm.chat_format import format_windows

    with pytest.raises(TypeError, match="conv_id"):
        format_windows(spark.createDataFrame([("a", 1, "user", "x")], "conv_id string, turn long, role string, text string"))



def test_chat_formatting(spark):
    from tessera.llm.chat_format import CONTROL, escape, format_windows, parse_window, read_windows, unescape

    for t in ["", "\\", "[\\INST]", "\\\\<s>", "".join(CONTROL), "<|tu\\rn|>", "a[INST", "]</s>[INST] ok [/INST]\\", "[\\\\INST]"]:
        assert unescape(escape(t)) == t and not any(c in escape(t) for c in CONTROL)
    r = random.Random(2)
    turns = []
    for conv in range(12):
        roles = (["system"] if conv % 3 == 0 else []) + ["user", "assistant"] * r.randint(1, 12)
        turns += [(conv, k, role, words(r.choice((0, 3, 20, 90)), conv * 100 + k) + (" [INST] \\ </s>" if k % 4 == 0 else ""), "w", 1) for k, role in enumerate(roles)]
    turns += [(50, 0, "user", None, "w", 1), (50, 1, "assistant", "", "w", 1), (51, None, None, "x", "w", 1), (None, 0, "assistant", "lost", "w", 1), (52, 0, "system", "only", "w", 1)]
    turns += [(60, k, ("user", "assistant")[k % 2], words(8, k), "w", 1) for k in range(900)] + [(61, 0, "assistant", words(5000, 3), "w", 1), (62, 3, "user", "tie", "w", 1), (62, 3, "user", "tie", "w", 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, window string, n int")
    by = defaultdict(list)
    for c, k, role, t, *_ in turns:
        by[c].append((-1 if k is None else k, role or "", t or ""))
    for budget, history in ((1024, 256), (60, 20), (16, 0)):
        windows = format_windows(df, budget, history).collect()
        got = {x.conv_id: x for x in read_windows(format_windows(df, budget, history)).collect()}
        assert set(got) == set(by)
        for c, own in by.items():
            own = sorted(own, key=lambda x: x[0])
            everything = "".join(f"{role}\n{t}\n" for _, role, t in own)
            loss = "".join(t for _, role, t in own if role == "assistant")
            x = got[c]
            assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(own), sha(everything), len(loss), sha(loss))
        for w in windows:
            parsed = parse_window(w.text)
            size = lambda t: len(re.findall(r"\w+|[^\w\s]", t[1])) + 4
            new = parsed[w.repeated :]
            assert len(new) == 1 or sum(map(size, new)) <= budget - history
            system = parsed[0][0] == "system" and w.repeated > 0
            assert sum(map(size, parsed[system : w.repeated])) <= history
            assert w.conv_id not in (0, 3, 6, 9) or parsed[0][0] == "system"
            assert all(any(a == s and b == e for _, _, s, e in new) for a, b in zip(w.loss[::2], w.loss[1::2]))
    assert read_windows(format_windows(df.limit(0))).count() == 0


# --- WARC ----------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    import base64
    import gzip

    from tessera.llm.warc import WarcReader, archive_records, register

    register(spark)
    html = ["<p>a</p>", None, "", "<p>ü€</p>" * 5000, "<p>a</p>", "x\r\n\r\ny", "<p>a</p>"]
    rows = [(i, f"http://h{i}.org/ä\r\nX: y", h, "z") for i, h in enumerate(html)] + [(None, None, "<p>a</p>", "z"), (3, "u", html[3], "z"), (9, "u", "lone", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, warc_type string")
    archive_records(pages).repartition(3).write.format("warc").option("splitbytes", "200").mode("append").save(f"file://{tmp_path}/w")
    read = spark.read.format("warc").option("payload", "true").load(f"file://{tmp_path}/w")
    got = read.collect()
    top = {}
    for i, _, h, _ in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h, _ in rows:
        data = (h or "").encode()
        first = top[h or ""] == i
        want[(f"urn:page:{'' if i is None else i}", "response" if first else "revisit", len(data), "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode(), None if first else f"urn:page:{top[h or '']}", data if first else b"")] += 1
    assert Counter((r.record_id, r.warc_type, r.payload_length, r.payload_digest, r.refers_to, bytes(r.payload)) for r in got) == want
    assert read.where("warc_type = 'revisit' AND record_id IN ('urn:page:0', 'urn:page:4')").count() == 2
    reader = WarcReader({"path": f"file://{tmp_path}/w"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert [type(f) for f in reader.pushFilters([EqualTo(("warc_type",), "revisit"), GreaterThan(("offset",), 3)])] == [GreaterThan]
    assert all(r["warc_type"] == "revisit" for p in reader.partitions() for r in reader.records(p))
    joined = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "w").glob("*.gz")))  # any gzip reader can read them
    (tmp_path / "plain.warc").write_bytes(joined)
    plain = spark.read.format("warc").option("payload", "true").load(f"file://{tmp_path}/plain.warc").collect()
    assert Counter(bytes(r.payload) for r in plain) == Counter(bytes(r.payload) for r in got)
    (tmp_path / "other.warc.gz").write_bytes(gzip.compress(joined[: joined.index(b"WARC/1.1", 10)]) + gzip.compress(joined[joined.index(b"WARC/1.1", 10) :]))
    assert spark.read.format("warc").load(f"file://{tmp_path}/other.warc.gz").count() == 2
    archive_records(pages.limit(0)).write.format("warc").mode("append").save(f"file://{tmp_path}/none")
    assert spark.read.format("warc").load(f"file://{tmp_path}/none").count() == 0
    few = archive_records(pages, least_bytes=100).where("warc_type = 'revisit'")
    assert few.count() == 0


def test_warc_damage_is_told(spark, tmp_path):
    """A changed payload fails the query; damaged and cut records raise, or are counted."""
    from tessera.llm.warc import archive_records, read_back, register

    register(spark)
    pages = spark.createDataFrame([(i, "u", f"<p>page {i}</p>" * 20) for i in range(6)] + [(9, "u", "<p>page 1</p>" * 20)], "page_id long, url string, html string")
    archive_records(pages).coalesce(1).write.format("warc").mode("append").save(f"file://{tmp_path}/w")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in read_back(spark, f"file://{tmp_path}/w").collect()) == [(i, "revisit" if i == 1 else "response", 9 if i == 1 else None) for i in (0, 1, 2, 3, 4, 5, 9)]
    import gzip

    whole = b"".join(gzip.open(f).read() for f in (tmp_path / "w").glob("*.gz"))
    packed = next((tmp_path / "w").glob("*.gz")).read_bytes()
    cases = {
        "changed": (whole.replace(b"page 3", b"page 8", 1), "differs", 6),
        "cut": (whole[:-50], "stated|end of record", 6),
        "head": (whole.replace(b"WARC/1.1\r\nWARC-Type: response", b"JUNK/1.1\r\nWARC-Type: response", 1), "no WARC header", 6),
        "packed": (packed[:200] + bytes([packed[200] ^ 255]) + packed[201:], "damaged", 6),
        "packed-cut": (packed[:-30], "truncated", 6),
    }
    for name, (data, what, left) in cases.items():
        path = tmp_path / f"{name}.warc{'.gz' if 'packed' in name else ''}"
        path.write_bytes(data)
        read = lambda **o: spark.read.format("warc").options(payload="true", verify="true", **o).load(f"file://{path}")  # noqa: B023, E731
        with pytest.raises(Exception, match=what):
            read().collect()
        rows = read(mode="permissive").collect()
        assert sum(r.damage is None for r in rows) == left and sum(r.damage is not None for r in rows) == 1, name
    (tmp_path / "changed.warc").rename(tmp_path / "w" / "x.warc")
    for f in (tmp_path / "w").glob("_*.json"):
        f.unlink()
    for f in (tmp_path / "w").glob("*.gz"):
        f.unlink()
    with pytest.raises(Exception, match="differs"):
        read_back(spark, f"file://{tmp_path}/w").collect()


# --- HTML ----------------------------------------------------------------------------------------------------------


def test_html_extraction(spark):
    from tessera.llm.html_extract import extract_text

    article = "<h1>A title</h1><p><b>First &amp; foremost</b> text,\n with   space.<br>More.<p>Second paragraph &lt;here&gt; &copy;"
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x = "</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
    <div class="ad">Buy this now. It is good.</div><article>{article}</article><aside><p>Related words here.</p></aside><form><p>Subscribe to us.</p><input></form>
    <div class="comments"><div class="comment"><p>I disagree with this. It is wrong.</p></div></div><footer>&copy; me</footer></body></html>"""
    want = "A title\n\nFirst & foremost text, with space. More.\n\nSecond paragraph <here> ©"
    rows = [(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (None, "u", page, "t"), (1, "u", page, "t"), (4, "u", "<nav><a href=x>only menu</a></nav>", "t"), (5, "u", page[: page.index("Second paragraph") + 10] + "<p", "t"), (6, "u", "<div>" * 3000 + "deep", "t"), (7, "u", "<p <a '\" <<>> </ <!-- x", "t"), (8, "u", page.replace("</article>", "<p>And more words.</p>" * 5000 + "</article>"), "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [tuple(r) for r in extract_text(pages).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == len(rows) and sum(r[2] == want for r in got) == 3
    assert by[2][2:] == ("", 0) and by[3][2:] == ("", 0) and by[4][2] == ""
    assert by[5][2].startswith("A title\n\nFirst") and by[8][2].count("And more words.") == 5000
    assert all(r[3] == len(r[2]) for r in got)
    assert extract_text(pages.limit(0)).count() == 0


def test_sum_product_is_exact():
    import itertools

    import numpy as np

    from tessera.llm.html_extract import Forest, sum_product

    r = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1, 2])
    kind, unary, pair = r.integers(0, 8, 6), r.normal(size=(6, 2)), r.normal(size=(8, 2, 2))
    f = Forest(parent, kind, [np.array([0]), np.array([1, 2]), np.array([3, 4, 5])], np.zeros(0, int), np.zeros(0, int), [0])
    marginal, joint = sum_product(f, unary, pair)
    exact = np.zeros((6, 2))
    for y in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(unary[k, y[k]] for k in range(6)) + sum(pair[kind[k], y[parent[k]], y[k]] for k in range(1, 6)))
        exact[range(6), y] += w
    assert np.allclose(marginal, exact / exact.sum(1, keepdims=True)) and np.allclose(joint[3].sum(), 1)


def test_html_head_that_is_not_closed():
    """A head ends at the first tag or text that cannot be in it, as if </head><body> stood there."""
    from tessera.llm.html_extract import parse

    head = '<html><head>\n <title>t</title><meta name="a"><style>p{}</style><script>"</head>"</script><noscript><img src="x"></noscript>\n'
    for body in ("<p>An article. <b>All</b> of it.<p>More", "loose text <p>more", "<b>bold</b> text", "<br>text", "<img src=x>text<div>more</div>", "&nbsp;x", "<p>a<head><p>b"):
        for rest in ("", "</body></html>"):
            got, want = parse(head + body + rest), parse(head + "</head><body>" + body + rest)
            assert (got.tags, got.parents, got.runs) == (want.tags, want.parents, want.runs)
            assert got.runs and all("t" != run for _, run, _ in got.runs)
    assert parse(head + "<body class='x'><p>a").names == parse(head + "</head><body class='x'><p>a").names


def test_html_end_tags_far_below_their_start():
    from tessera.llm.html_extract import parse

    page = parse("<body><section>" + "<div>" * 2000 + "deep</section><p>after</p>")
    assert [page.parents[k] for k, t in enumerate(page.tags) if t in ("section", "p")] == [1, 1]
    page = parse("<ul><li>" + "<b>" * 2000 + "a<li>b</ul><p>c")
    assert [page.parents[k] for k, t in enumerate(page.tags) if t == "li"] == [1, 1] and page.parents[-1] == 0
    page = parse("<table><tr><td>" + "<i>" * 2000 + "a<tr><td>b</table>c")
    assert [page.parents[k] for k, t in enumerate(page.tags) if t == "tr"] == [1, 1] and page.runs[-1][:2] == (0, "c")


def truth_of(html):
    """Article text of a made page by its labels, through the standard library's parser: blocks are cut at block tags, a label holds for all below it."""
    from html.parser import HTMLParser

    from tessera.llm.html_pages import MARK

    blocks = set("address article aside blockquote body dialog div dl dd dt footer form h1 h2 h3 h4 header html li main menu nav ol p pre section table tbody td tr ul".split())

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.out, self.held, self.off = [("", False)], [], "", 0

        def flush(self):
            if run := " ".join(self.held.split()):
                self.out.append((run, self.open[-1][1]))
            self.held = ""

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("title", "button")
            if tag == "br":
                self.held += " "
            if tag not in blocks:
                return
            if self.open[-1][0] == "p":
                self.handle_endtag("p")
            self.flush()
            label = dict(attrs).get(MARK)
            self.open.append((tag, self.open[-1][1] if label is None else label == "1"))

        def handle_endtag(self, tag):
            self.off -= tag in ("title", "button")
            if tag in [t for t, _ in self.open]:
                while True:
                    self.flush()
                    if self.open.pop()[0] == tag:
                        break

        def handle_data(self, data):
            self.held += "" if self.off else data

    walk = Walk()
    walk.feed(html)
    walk.close()
    walk.flush()
    return "\n\n".join(run for run, article in walk.out if article)


def test_html_text_of_held_out_pages():
    """Made pages of another seed against an independent parser: the blocks of text exactly, and what the model takes of them."""
    from tessera.llm.html_extract import content, default_model, parse
    from tessera.llm.html_pages import MARK, labelled_pages

    pages = labelled_pages(300, seed=5)
    for p in pages:
        tree, y = parse(p, MARK), []
        for k, label in enumerate(tree.labels):
            y.append(bool(label) if label is not None else y[tree.parents[k]] if k else False)
        assert "\n\n".join(run for k, run, _ in tree.runs if y[k]) == truth_of(p)
    got = content([parse(p) for p in pages], default_model())
    assert sum(x == truth_of(p) for x, p in zip(got, pages, strict=True)) > 0.9 * len(pages)
    # Labels are a side channel of training: with them, without them, or turned over, the text is the same.
    for change in (lambda p: p.replace(f'{MARK}="1"', ""), lambda p: p.replace(f'{MARK}="1"', f'{MARK}="0"')):
        assert content([parse(change(p)) for p in pages], default_model()) == got


def test_html_model_on_held_out_pages():
    from tessera.llm.html_extract import default_model, forest, parse, sum_product
    from tessera.llm.html_pages import MARK, labelled_pages

    m, wrong, total = default_model(), 0, 0
    for p in (parse(x, MARK) for x in labelled_pages(150, seed=5)):
        f = forest([p], m.index)
        got = sum_product(f, m.unary(f), m.pair)[0][:, 1] >= 0.5
        y = []
        for k, label in enumerate(p.labels):
            y.append(bool(label) if label is not None else y[p.parents[k]] if k else False)
        wrong += sum(got[k] != y[k] for k, _, _ in p.runs)
        total += len(p.runs)
    assert wrong < 0.01 * total


def test_html_hand_made_layouts():
    from tessera.llm.html_extract import Model, content, default_model, parse
    from tests.llm.html_layouts import LAYOUTS

    saved = Model.from_json(default_model().to_json())
    got = content([parse(html) for _, html, _ in LAYOUTS], saved)
    assert [name for (name, _, text), x in zip(LAYOUTS, got, strict=True) if x != text] == []


def test_html_contract_probes():
    """No cap on open elements, no attribute but class, id and role, and only scripts, styles and form controls are silent."""
    from tessera.llm.html_extract import content, default_model, parse

    text = lambda html: content([parse(html)], default_model())[0]
    one, two = "The harbour was rebuilt in stone after the flood.", "Two years later the market moved."
    ad = f"<body><nav><a href=x>menu</a></nav><article><p>{one}</p><div class=ad>{'<b>' * 600}Buy a boat</div><p>{two}</p></article>"
    page = parse(ad)
    assert page.tags[page.parents[page.tags.index("p", page.tags.index("div"))]] == "article" and text(ad) == f"{one}\n\n{two}"
    inside = lambda x: text(f"<body><nav><a href=x>menu</a></nav><article><p>{one}</p><p>Euler wrote {x} there.</p></article>").split("\n\n")[1:]
    assert inside('<span data-y="3">it</span>') == inside('<span data-y="0">it</span>') == ["Euler wrote it there."]
    assert inside("<math><mi>e</mi><mo>=</mo><mn>1</mn></math>") == ["Euler wrote e=1 there."]
    for tag in ("object", "audio", "video", "canvas", "noscript", "svg"):
        assert inside(f"<{tag}>it</{tag}>") == ["Euler wrote it there."]
    for gone in ("<script>x</script>", "<style>x</style>", "<button>x</button>", "<select><option>x</select>", "<textarea>x</textarea>", "<template>x</template>"):
        assert inside(f"it{gone}") == ["Euler wrote it there."]


def test_html_columns(spark):
    from tessera.llm.html_extract import extract_text

    pages = spark.createDataFrame([(1, "<article><p>One block of text.</p></article>", "x")], "`page.id` long, html string, text string")
    assert [tuple(r) for r in extract_text(pages, carry=("page.id",)).collect()] == [(1, "One block of text.", 18)]
    assert extract_text(pages, carry=("text", "page.id")).columns == ["page.id", "text", "n_chars"]


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        w = words(50, i, 5000).split()
        toxic = i % 5 == 0
        for _ in range(5 if toxic else 0):
            w[r.randrange(50)] = r.choice(["vileword", "nastyterm"])
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    passage = words(30, 4242)
    rows += [(500, rows[1][1], "en", "s1", 0), (501, rows[2][1] + " tail", "en", "s1", 0), (502, passage, "en", "s0", 0), (503, None, "en", None, 0), (504, "", None, "s2", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out-{len(kept)}")
        docs = spark.read.parquet(f"{tmp_path}/out-{len(kept)}")
        kept[name] = {x.doc_id for x in docs.select("doc_id").collect()}
    steps = list(kept.values())
    clean = {i for i in range(400) if i % 5} | set(range(500, 505))
    assert len(steps[0] ^ clean) <= 8
    assert steps[0] - steps[1] == {1, 503} or steps[0] - steps[1] == {1}
    assert steps[1] - steps[2] == {501}
    assert steps[2] - steps[3] == {502}
    assert docs.where("taken <= 0").count() == 0
    # Every stage after the classifier against brute force on what it was given.
    text = {i: (t, src) for i, t, _, src, _ in rows}
    given = lambda k: [(i, *text[i]) for i in sorted(steps[k])]
    last = {}
    for i, t, _ in given(0):
        last[t or ""] = i
    assert steps[1] == set(last.values())
    assert steps[2] == {i for (i, _), (n, comp) in near_brute(given(1), 80).items() if comp == i or not n}
    assert steps[3] == {x[0] for x in contamination_brute(given(2), [(1, passage)]) if not x[4]}
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for i, t, src in given(3):
        sizes[src] += size(t)
        largest[src] = max(largest[src], size(t))
    for x in docs.collect():
        taken[x.source] += x.taken
        assert x["size"] == size(x.text) and x.source_size == sizes[x.source] and x.taken <= 3 * x["size"]
    assert not [(src, taken[src], t, largest[src], sizes[src]) for src, t in fill(dict(sizes)).items() if abs(taken[src] - t) > largest[src] + 1e-6]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in whole.select("doc_id").collect()} == steps[4]
    clashing = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 AS size", "2 AS Target", "'x' AS row", "'y' AS text_b")
    for _, stage in corpus_pipeline.STAGES:  # columns of the operators' own names
        before, clashing = clashing.columns, stage(spark, clashing, str(tmp_path))
        clashing.write.parquet(f"{tmp_path}/clash-{stage.__name__}")
        clashing = spark.read.parquet(f"{tmp_path}/clash-{stage.__name__}")
    assert sorted(c.lower() for c in clashing.columns) == sorted([*(c.lower() for c in before if c not in ("size", "Target")), *corpus_pipeline.MIX])
    long = spark.createDataFrame([(1, words(300_000, 1, 20_000), "en", "s0", 0), (2, words(300_000, 1, 20_000) + " end", "en", "s0", 0), (3, "short", "en", "s1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:  # very long texts
        long = stage(spark, long, str(tmp_path))
    assert {x.doc_id for x in long.select("doc_id").collect()} <= {1, 3}
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
