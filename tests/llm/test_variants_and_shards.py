"""Spelling variants and k-d shards against brute force, and on awkward tables."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, node long, shard int, key long"


def docs_of(spark, rows):
    """Documents (id, text, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1, 2, 3, 4) for i, t, s in rows], DOCS)


# --- spelling variants ---------------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(enumerate(b), lambda left, jy: min(left + 1, row[jy[0] + 1] + 1, row[jy[0]] + (x != jy[1])), initial=i))  # noqa: B023
    return row[-1]


def brute_variants(rows, least=7, times=10, drop=31):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(low)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and levenshtein(v, w) == 1] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= times * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


@pytest.fixture(scope="module")
def texts():
    """Words over few letters, so that many are near, some by several places at once; frequencies from 1 to some hundred."""
    r = random.Random(4)
    stems = ["".join(r.choice("aé") for _ in range(r.randrange(6, 10))) for _ in range(80)] + ["aaaaaaaa", "aaaaaaaaa", "straßenbahn", "strassenbahn", "naïvement", "naivement"]
    rows = []
    for i in range(150):
        picked = [r.choice(stems) for _ in range(int(r.paretovariate(1)) % 200 + 10)]
        altered = [w if r.random() < 0.8 else w[: (k := r.randrange(len(w)))] + r.choice(["", "a", "zé", "B"]) + w[k + 1 :] for w in picked]
        rows.append((i, " ".join(altered) + "x-ray 12 ab×cd÷ef ", f"s{i % 3}"))
    chain = ["chainlink"] * 1000 + ["chainlinks"] * 100 + ["chainlinksy"] * 10
    return [*rows, (900, " ".join(chain), "s"), (None, "nulls have words too, nulls have words too", None), (None, "nulls have words too", "s"), (901, None, "s"), (902, "", "s"), (903, "12 345 !", "s")]


@pytest.mark.parametrize("halves", [20_000, 50])
def test_variants_equal_all_pairs(spark, texts, halves):
    from tessera.llm.spelling_variants import spelling_variants

    got = spelling_variants(docs_of(spark, texts), drop=31, halves_a_shard=halves).select("word", "form", "root", "n", "n_near", "form_n")
    want = brute_variants(texts)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(w[4] > 3 for w in want) > 20
    assert any(w[2] == "chainlink" and w[0] == "chainlinksy" for w in want)


def test_variants_of_a_hot_anchor(spark):
    """Most words begin alike: the anchor's halves are dealt over shards, and no near pair is lost or counted twice."""
    from tessera.llm.spelling_variants import near_words

    r = random.Random(9)
    words = {"con" + "".join(r.choice("abc") for _ in range(r.randrange(4, 9))) for _ in range(3000)}
    table = spark.createDataFrame([(w, 2 + zlib.crc32(w.encode()) % 50) for w in words], "word string, n long")
    got = {x.word: (x.n_near, x.best_n, x.best) for x in near_words(table, 7, 500).collect()}
    counts = {x.word: x.n for x in table.collect()}
    gaps = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[w[:i] + w[i + 1 :]].add(w)
            gaps[w].add(w)
    near = defaultdict(set)
    for same in gaps.values():
        for a, b in itertools.permutations(same, 2):
            if levenshtein(a, b) == 1:
                near[a].add(b)
    want = {w: (len(v), *min(((counts[x], x) for x in v), key=lambda x: (-x[0], x[1]))) for w, v in near.items()}
    assert got == want


def test_variants_of_very_long_words_and_texts(spark):
    from tessera.llm.spelling_variants import one_apart, spelling_variants

    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(60_000))
    edited = [long, long[:10] + long[11:], long[:50_000] + "zz" + long[50_001:], long[:-1] + "z", "z" + long, long[:48] + "x" + long[48:]]
    rows = [(i, f"{w} {w}", "s") for i, w in enumerate(edited)] + [(50, long, "s")] * 30
    got = {x.word: (x.n_near, x.form) for x in spelling_variants(docs_of(spark, rows)).collect()}
    assert got == {w: (sum(one_apart(v, w) for v in edited), None if w == long else long if one_apart(w, long) else None) for w in edited}
    assert got[long][0] == 4


def test_variants_of_nothing(spark):
    from tessera.llm.spelling_variants import spelling_variants

    assert spelling_variants(docs_of(spark, [])).count() == 0
    assert spelling_variants(docs_of(spark, [(1, None, None), (2, "short words only", "s")])).count() == 0
    alone = spelling_variants(docs_of(spark, [(1, "something something", "s")])).collect()
    assert [tuple(x) for x in alone] == [("something", 2, None, "something", 0, None)]
    with pytest.raises(ValueError):
        spelling_variants(docs_of(spark, []), times=1)


def test_one_apart():
    from tessera.llm.spelling_variants import one_apart

    r = random.Random(2)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(1, 6))) for _ in range(120)]
    assert all(one_apart(a, b) == (levenshtein(a, b) == 1) for a in words for b in words)


# --- k-d shards ----------------------------------------------------------------------------------------------------


def made(n=1500, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = "x" * int(min(r.paretovariate(1.2) * 50, 3000)) + f" {i}"
        rows.append((i, text, f"s{r.choice([0, 0, 0, 1, 2, 3])}"))
    for k in range(40):  # copies under several sources
        rows += [(5000 + 10 * k + j, f"copy of {k} " * 5, f"s{j % 4}") for j in range(4)]
    return rows


def check_law(got, rows, shards, slack):
    assert Counter(x.doc_id for x in got) == Counter(i for i, _, _ in rows)
    size = defaultdict(int)
    for x in got:
        size[x.shard] += x.size
        assert x.law == "bytes" and x.grown_shard is None and 0 <= x.shard < shards
    mean = sum(size.values()) / shards
    assert all(abs(size[s] - mean) <= slack for s in range(shards)), sorted(size.items())
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("shards", [1, 2, 5, 8, 13])
def test_shards_are_near_equal_and_keep_copies_together(spark, shards):
    from tessera.llm.kd_shards import kd_shards

    rows = made()
    got = kd_shards(docs_of(spark, rows).repartition(3), ["lang", "source", "n_chars"], shards=shards).collect()
    text_of = {i: t for i, t, _ in rows}
    assert all(x.size == len(text_of[x.doc_id].encode()) + 1 and x.text_crc32 == zlib.crc32(text_of[x.doc_id].encode()) for x in got)
    check_law(got, rows, shards, 3 * 3000)
    homes = defaultdict(set)
    for x in got:
        homes[text_of[x.doc_id]].add(x.shard)
    assert all(len(v) == 1 for v in homes.values())


def test_shards_follow_the_widest_dimension(spark):
    """Against the same tree built in Python over two numbers of unlike widths."""
    from tessera.llm.kd_shards import COORD, kd_shards

    r = random.Random(8)
    rows = [(i, "t" * r.randrange(1, 200) + f" {i}", r.random() * 100, int(r.random() ** 3 * 1000)) for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, a double, b int")
    ends = [(min(x[c] for x in rows), max(x[c] for x in rows)) for c in (2, 3)]
    points = [(i, len(t) + 1, [int((v - lo) * COORD / (hi - lo)) for v, (lo, hi) in zip((a, b), ends, strict=True)]) for i, t, a, b in rows]

    def split(rows, k):
        if k == 1:
            return [rows]
        widths = [max(p[2][d] for p in rows) - min(p[2][d] for p in rows) for d in (0, 1)]
        d = widths.index(max(widths))
        total = sum(p[1] for p in rows)
        left, upto = set(), 0
        for p in sorted(rows, key=lambda p: p[2][d]):
            if upto < total * (k // 2) // k:
                left.add(p[0])
                upto += p[1]
        return split([p for p in rows if p[0] in left], k // 2) + split([p for p in rows if p[0] not in left], k - k // 2)

    want = {p[0]: s for s, leaf in enumerate(split(points, 4)) for p in leaf}
    got = {x.doc_id: x.shard for x in kd_shards(frame, ["a", "b"], shards=4).collect()}
    assert sum(got[i] != want[i] for i in want) <= 8  # rows at a cut, where coordinates tie


def test_shards_of_a_hot_group(spark):
    """A third of all rows is one text, and many rows are alike in id too: both are cut, the rest isn't."""
    from tessera.llm.kd_shards import kd_shards

    rows = made(600) + [(20_000 + i, "hot " * 100, "s0") for i in range(700)] + [(7, "same row " * 30, "s1")] * 500 + [(None, None, None)] * 300 + [(None, "", "s2")] * 20
    got = kd_shards(docs_of(spark, rows).repartition(5), ["lang", "source", "n_chars"], shards=8).collect()
    check_law(got, rows, 8, 3 * 3000)
    assert len({x.shard for x in got if x.doc_id and x.doc_id >= 20_000}) > 1
    assert {x.text_crc32 for x in got if x.doc_id is None} == {0} and {x.size for x in got if x.doc_id is None} == {1}


def test_shards_by_target_bytes_and_awkward_tables(spark):
    from tessera.llm import kd_shards as module
    from tessera.llm.kd_shards import kd_shards

    assert kd_shards(docs_of(spark, []), ["source"], shards=8).count() == 0
    assert kd_shards(docs_of(spark, []), ["source"], target_bytes=100).count() == 0
    few = kd_shards(docs_of(spark, [(1, "a", "s"), (2, "b", None)]), ["lang", "source", "n_chars"], shards=8).collect()
    assert len(few) == 2 and all(0 <= x.shard < 8 and x.slot in (0, 1) for x in few)
    rows = made(300)
    total = sum(len(t) + 1 for _, t, _ in rows)
    assert len({x.shard for x in kd_shards(docs_of(spark, rows), ["n_chars"], target_bytes=total // 6 + 1).collect()}) == 6
    long = kd_shards(docs_of(spark, [*rows, (9000, "é" * 2_000_000, "s0")]), ["source", "n_chars"], shards=2).collect()
    assert [x.size for x in long if x.doc_id == 9000] == [4_000_001]
    odd = spark.createDataFrame([(i, f"text {i}", float("nan") if i % 3 == 0 else None if i % 3 == 1 else float(i), bool(i % 2)) for i in range(60)], "doc_id long, text string, x double, b boolean")
    check_law(kd_shards(odd, ["x", "b"], shards=4).collect(), [(i, "", "") for i in range(60)], 4, 30)
    for bad in ({}, {"shards": 2, "target_bytes": 3}, {"shards": 0}):
        with pytest.raises(ValueError):
            kd_shards(odd, ["x"], **bad)
    assert module.SLOT_CELL > 0


def test_slots_of_large_cells(spark, monkeypatch):
    from tessera.llm import kd_shards as module

    monkeypatch.setattr(module, "SLOT_CELL", 5)
    rows = [(i % 7, "same", "s") for i in range(200)] + made(100)
    check_law(module.kd_shards(docs_of(spark, rows).repartition(4), ["source"], shards=3).collect(), rows, 3, 2 * 3000)


def test_shards_run_in_the_jvm_only(spark, capsys):
    from tessera.llm.kd_shards import kd_shards

    kd_shards(docs_of(spark, made(50)).withColumn("n_chars", F.length("text")), ["source", "n_chars"], shards=4).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
