"""Operators on hand-made rows, with metamorphic checks."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import dedup, grams, metrics, quality, sequences, similarity, splits, tables, vectors


def test_conflict_dedup(spark):
    rows = [("a", 0, "s1", "p"), ("a", 1, "s2", "p"), ("b", 1, "s1", "p"), ("b", 1, "s1", "q"), ("c", None, "s1", None)]
    d = dedup.dedup_with_conflicts(spark.createDataFrame(rows, "sequence string, label int, source_dataset string, source_project string"), provenance=["source_dataset", "source_project"])
    kept = {r.sequence: r for r in dedup.resolved(d).collect()}
    assert kept["b"].n_records == 2 and kept["b"].n_source_datasets == 1 and kept["b"].source_projects == "p;q" and kept["b"].label == 1 and len(kept["b"].sources) == 2
    assert kept["c"].label is None
    assert [r.sequence for r in dedup.conflicts(d).collect()] == ["a"]
    again = dedup.dedup_with_conflicts(dedup.resolved(d).select("sequence", "label", F.lit("s").alias("source_dataset")), project=None)
    assert again.count() == 2 and again.where("n_records > 1").count() == 0


def test_cluster_rollup_and_sizes(spark):
    m = spark.createDataFrame([("c1", "x2", 1, 2, "s1;s2"), ("c1", "x1", 0, 3, " s2; ;s10"), ("c2", "x3", 1, 1, None)], "cluster_id string, seq_id string, label int, n_records int, source_datasets string")
    got = {r.cluster_id: r for r in dedup.cluster_rollup(m).collect()}
    assert (got["c1"].rep_seq_id, got["c1"].label, got["c1"].cluster_size, got["c1"].n_records_sum, got["c1"].source_datasets_union) == ("x1", 0, 2, 5, "s1;s10;s2")
    assert got["c2"].source_datasets_union == ""
    s = dedup.cluster_size_stats(spark.createDataFrame([(1,), (1,), (10,)], "cluster_size int")).first()
    assert (s.clusters, s.min, s.p50, s.p95, s.max) == (3, 1, 1, 9, 10)


def test_splits(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    s = splits.stratified_split(df, "id", "label")
    assert {(r.split, r.label): r.n for r in splits.split_counts(s).collect()}[("train", 1)] == 200
    assert splits.stratified_split(df.orderBy(F.desc("id")), "id", "label").join(s.withColumnRenamed("split", "other"), "id").where("split <> other").count() == 0
    clusters = s.select(F.col("id").alias("cluster_id"), "split")
    members = spark.range(3000).select((F.col("id") % 1000).alias("cluster_id"), "id")
    assert splits.propagate_split(members, clusters).groupBy("cluster_id").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    with pytest.raises(PySparkException, match="repeated"):
        splits.propagate_split(members, clusters.union(clusters)).collect()
    with pytest.raises(PySparkException, match="without a split"):
        splits.propagate_split(members, clusters.limit(5)).collect()
    with pytest.raises(ValueError):
        splits.stratified_split(df, "id", "label", (0.5, 0.1, 0.1))
    assert splits.sample_rows(df, "id", 7, 1).count() == 7
    assert spark.range(1).select(splits.priority_split(F.array(F.lit("train"), F.lit("test"))).alias("s")).first().s == "test"


def test_ranking_by_hand(spark):
    rows = list(zip([0, 0, 1, 1, 1, 0], [0.1, 0.4, 0.35, 0.8, 0.4, 0.4]))
    df = spark.createDataFrame(rows, "label int, score double")
    m = metrics.ranking_metrics(df).first()
    assert round(m.auroc, 6) == 0.666667 and round(m.average_precision, 6) == 0.7
    flipped = metrics.ranking_metrics(df.withColumn("score", -F.col("score"))).first()
    assert round(m.auroc + flipped.auroc, 9) == 1
    assert metrics.ranking_metrics(df.where("label = 1")).first().auroc is None


def test_threshold_against_sweep(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 1), round(r.random(), 1)) for _ in range(60)]
    df = spark.createDataFrame(rows, "label int, score double")
    for metric in ("mcc", "f1", "balanced_accuracy"):
        got = metrics.select_threshold(df, metric).first()
        every = [(round(metrics.metrics_at(df, t).first()[metric], 12), -t) for t in sorted({s for _, s in rows} | {0.0, 0.5, 1.0})]
        assert (round(got[metric], 12), -got.threshold) == max(every)
    assert metrics.metrics_at(df.limit(0), 0.5).first().mcc == 0


def test_selective_and_calibration(spark):
    df = spark.createDataFrame([(i, 1, 0.9 if i < 3 else 0.1, i / 10) for i in range(5)], "id int, label int, score double, uncertainty double")
    got = {r.coverage: (r.k, r.accuracy) for r in metrics.selective_accuracy(df, (0.1, 0.5, 1.0)).collect()}
    assert got == {0.1: (1, 1.0), 0.5: (2, 1.0), 1.0: (5, 0.6)}
    ties = df.withColumn("uncertainty", F.lit(0.5))
    assert {r.coverage: r.accuracy for r in metrics.selective_accuracy(ties, (0.8,)).collect()} == {0.8: 0.75}
    assert abs(metrics.calibration_error(df).first().ece - 0.3) < 1e-9
    w = metrics.class_weights(df.union(df.withColumn("label", F.lit(0)).limit(2))).first()
    assert (w.w0, w.w1) == (1.0, 0.4)


def test_grams(spark):
    df = spark.createDataFrame([(1, "abcab"), (2, "ab"), (3, None), (4, "xabc")], "id long, text string")
    g = grams.gram_counts(df, "id", "text", (2,))
    assert {(r.id, r.gram): r.tf for r in g.collect()} == {(1, "ab"): 2, (1, "bc"): 1, (1, "ca"): 1, (2, "ab"): 1, (4, "xa"): 1, (4, "ab"): 1, (4, "bc"): 1}
    m = grams.motif_table(g, spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "id long, label int"), min_df=2, top=2).collect()
    assert [x.motif for x in m] == ["bc", "ab"] and m[0].direction == "pos"
    assert grams.motif_table(g, spark.createDataFrame([(1, 1)], "id long, label int"), min_df=1).count() == 0
    postings, _ = grams.tfidf_index(g, df.agg(F.count("*").alias("n")), 1)
    hits = grams.knn(postings, postings, 2)
    assert {(r.query, r.neighbour): r.similarity for r in hits.collect()}[(1, 4)] == {(r.query, r.neighbour): r.similarity for r in hits.collect()}[(4, 1)]
    lengths = df.select("id", F.length("text").alias("n"))
    assert grams.motif_counts(g, lengths, spark.createDataFrame([("ab",)], "motif string")).where("id = 1").first().per_letter == 0.4


def test_vectors(spark):
    rows = [(i, [float(i % 3 == k) + 0.01 * i for k in range(3)]) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    hits = vectors.cosine_knn(df, df, 3)
    assert hits.count() == 36 and hits.where("query = neighbour").count() == 0
    few = vectors.cosine_knn(df.where("id = 0"), df, 3).orderBy("rank").collect()
    assert all(r.neighbour % 3 == 0 for r in few)
    f = vectors.neighbour_features(hits.withColumn("label", (F.col("neighbour") % 2).cast("int")), df.select(F.col("id").alias("query")).union(spark.range(99, 100)))
    assert f.where("query = 99").first().sim_max == 0.0 and f.count() == 13
    w = vectors.window_texts(spark.createDataFrame([("abcdefgh",), ("",)], "t string"), "t", 4, 3).collect()
    assert [(r.start, r.window) for r in w] == [(0, "abcd"), (3, "defg"), (6, "gh"), (0, "")]
    e = spark.createDataFrame([(1, "a", "b", 0.9), (1, "a", "c", 0.9), (1, "a", "a", 1.0), (1, "b", "a", 0.5)], "graph_id int, src string, dst string, score double")
    assert {(r.src, r.dst) for r in vectors.top_neighbours(e, 1).collect()} == {("a", "b"), ("b", "a")}
    nodes = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (1, "c", 5.0), (2, "z", 7.0)], "graph_id int, node string, x double")
    got = {r.node: r["mean"] for r in vectors.neighbour_mean(nodes, e.where("src <> dst").select("graph_id", "src", "dst")).collect()}
    assert got == {"a": 3.0, "b": 1.0, "c": 1.0, "z": 7.0}


def test_expansion_goes_down_only(spark):
    cases = spark.createDataFrame([(1, "ACD", [0]), (2, "KK", [])], "case_id int, sequence string, positions array<int>")
    near = spark.createDataFrame([(1, 1, "AKDA", 0), (1, 2, "KCD", 0), (1, 3, "AAA", 1)], "case_id int, rank int, sequence string, label int")
    got = sequences.expand(cases, near, positions="positions")
    assert {(r.case_id, r.variant) for r in got.where("strategy = 'evidence'").collect()} == {(1, "KCD")}
    assert got.where("strategy = 'attribution'").count() == 19 and got.where("strategy = 'full_scan'").count() == 5 * 19
    assert sequences.substitutions(cases, "sequence", forbid="C").where("case_id = 1").count() == 2 * 18
    scored = got.withColumn("p", F.length("variant") * 0.0 + F.ascii(F.substring("variant", 1, 1)) / 100).withColumn("uncertainty", F.lit(0.1)).withColumn("bp", F.lit(0.9)).withColumn("bu", F.lit(0.1))
    ranked = sequences.rank_candidates(scored, ["case_id", "strategy"])
    best = ranked.where("case_id = 1 AND strategy = 'full_scan' AND rank = 1").first()
    assert best.p == scored.where("case_id = 1").agg(F.min("p")).first()[0]
    hits = sequences.hit_metrics(ranked, ["case_id", "strategy"], "bp", "bu")
    s = {r.strategy: r for r in sequences.strategy_summary(cases, hits, ["evidence", "full_scan"]).collect()}
    assert s["evidence"].coverage == 0.5 and s["full_scan"].coverage == 1.0


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_near_duplicate_clusters(spark):
    r = random.Random(5)
    seqs = []
    for c in range(12):
        base = "".join(r.choice("ACDEFGHIKL") for _ in range(r.randint(10, 45)))
        seqs.append(base)
        for _ in range(4):
            s = list(base)
            for _ in range(r.randint(1, 4)):
                s[r.randrange(len(s))] = r.choice("MNPQ")
            seqs.append("".join(s)[r.randint(0, 2) :])
    seqs += ["AAAAAAAAAAAA", "AAAAAAAAAAAM", "AC", "AC"]
    rows = [(f"s{i:03d}", s, i % 2 * 0) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "seq_id string, sequence string, label int")
    ok = lambda a, b: len(b) >= 0.9 * len(a) and edit(a, b) <= int((1 - 0.9) * len(a) + 1e-9)
    order = sorted(rows, key=lambda x: (-len(x[1]), x[0]))
    want = {(a[0], b[0]) for a, b in itertools.combinations(order, 2) if ok(a[1], b[1])}
    assert {(x.a, x.b) for x in similarity.similar_pairs(df).collect()} == want
    reps, cluster = [], {}
    for i, s, _ in order:
        first = next((k for k, t in reps if ok(t, s)), None)
        cluster[i] = first or i
        if first is None:
            reps.append((i, s))
    assert {x.seq_id: x.cluster_id for x in similarity.greedy_clusters(df).collect()} == cluster


def test_span_tables():
    assert tables.html_tables('<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td></tr><tr><td> </td></tr></table>') == [[["a", "b", "b"], ["a", "c", ""]]]


XML = """<article><front><article-id pub-id-type="pmc">12</article-id><article-id pub-id-type="doi">10.1/x</article-id><article-title>On <i>peptides</i></article-title></front>
<body><p>It is toxic if short. The sky.</p></body>
<table-wrap id="t1"><label>Table 1</label><caption><p>Sequences</p></caption><table><tr><th>Peptide name</th><th>Abbreviation</th><th>Sequence</th></tr><tr><td>Pep-1</td><td>P1</td><td>GIGKFLHSAKKF-NH2</td></tr><tr><td>Pep-2</td><td>P2</td><td>KWKLFKKIGAVLKVL</td></tr></table></table-wrap>
<table-wrap><label>Table 2</label><caption><p>MIC (MBC) in µM</p></caption><table><tr><th>Peptide</th><th>E. coli</th><th>n</th><th>IC50 (µM)</th></tr><tr><td>pep 1</td><td>4 (8)</td><td>3</td><td>&gt;128</td></tr><tr><td>PEP-2</td><td>2/2</td><td>3</td><td>5-6</td></tr><tr><td>other</td><td>1</td><td>3</td><td>1</td></tr></table></table-wrap>
<table-wrap><caption><p>Values in µM</p></caption><table><tr><th>Strain</th><th>P1</th><th>P2</th></tr><tr><td>MIC S. aureus</td><td>16</td><td>32</td></tr><tr><td>95% confidence interval</td><td>1</td><td>2</td></tr><tr><td>Therapeutic index</td><td>9</td><td>9</td></tr><tr><td>ratio</td><td>7</td><td>7</td></tr></table></table-wrap>
<table-wrap><caption><p>Predicted MIC</p></caption><table><tr><th>Peptide</th><th>MIC (µM)</th></tr><tr><td>Pep-1</td><td>1</td></tr></table></table-wrap></article>"""


def test_article_tables_to_records(spark):
    df = spark.createDataFrame([("d", XML), ("bad", "<x"), ("none", None)], "doc string, xml string")
    parsed = tables.articles(df, "xml", "doc")
    a = {r.doc: r.article for r in parsed.collect()}
    assert (a["d"].doi, a["d"].pmcid, a["d"].title, len(a["d"].tables)) == ("10.1/x", "PMC12", "On peptides", 4) and a["bad"].tables == []
    assert [r.sentence for r in tables.threshold_sentences(parsed).collect()] == ["It is toxic if short."]
    t = tables.tables_of(parsed)
    s = {r.norm_id: r.sequence for r in tables.sequence_map(t).collect()}
    assert s == {"pep1": "GIGKFLHSAKKF", "p1": "GIGKFLHSAKKF", "pep2": "KWKLFKKIGAVLKVL", "p2": "KWKLFKKIGAVLKVL"}
    got = {(r.layout, r.norm_id, r.endpoint, r.cmp, r.value, r.range_low, r.unit) for r in tables.experimental_records(t).collect()}
    assert ("row", "pep1", "MIC", "", 4.0, None, "µM") in got and ("row", "pep1", "MBC", "", 8.0, None, "µM") in got
    assert ("row", "pep1", "IC50", ">", 128.0, None, "µM") in got and ("row", "pep2", "IC50", "", None, 5.0, "µM") in got
    assert ("row", "pep2", "MIC", "", 2.0, None, "µM") in got
    assert {x for x in got if x[0] == "transposed"} == {("transposed", "p1", "MIC", "", 16.0, None, "µM"), ("transposed", "p2", "MIC", "", 32.0, None, "µM")}
    assert tables.experimental_records(t, include_computational=True).count() == len(got) + 1
    assert {(r.kind, r.entity) for r in tables.cell_entities(t).where("kind = 'sequence'").collect()} >= {("sequence", "KWKLFKKIGAVLKVL")}
    score = tables.paper_scores(t).first()
    assert score.seq_tables == 1 and score.score >= 4
    same = tables.same_row_records(spark.createDataFrame([("d", "t", "", "", "", [["KWKLFKKIGAVLKVL", "IC50 5 µM"]])], t.schema)).collect()
    assert [(r.sequence, r.value) for r in same] == [("KWKLFKKIGAVLKVL", 5.0)]


def test_paper_scores_read_whole_tables(spark):
    """Hits below row 120 count, and every value of a table does."""
    blank = [["", ""]] * 200
    rows = [["Sequence", "Value"], *blank, ["ACDKLLKWGG", "1 mg/L"], *[["EFGKLLKWHH", f"{i} mg/L"] for i in range(6)]]
    df = spark.createDataFrame([("d", "t", "", "IC50", "", rows)], "doc string, table_id string, label string, caption string, foot string, rows array<array<string>>")
    s = tables.paper_scores(df).first()
    assert (s.seq_tables, s.endpoint_tables, s.value_cells, s.score) == (1, 1, 7, 8)


def test_records_are_joined_without_broadcasts(spark):
    """A compressed file says little of what Python makes of it: neither ids nor records may be sent to the driver whole."""
    df = tables.tables_of(tables.articles(spark.createDataFrame([("d", XML)], "doc string, xml string"), "xml", "doc"))
    records = tables.experimental_records(df)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
    records.collect()  # the tables, which three branches read, are parsed and dealt once
    final = records._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 2 and final.count("MapInArrow parse") == 1


def test_screen(spark):
    rows = [("GIGKFL", "4", "µM", "", "E. coli", "val_col_header=MIC"), ("GIGKFL", "4", "µM", ">", "E. coli", None), ("GIGXFL", "4", "µM", None, None, None), ("GIGKFL", "nan", "µM", "", "", ""), ("GIGKFL", "4", "µM", "", "overall", "")]
    s = quality.screen(spark.createDataFrame(rows, "sequence string, value string, unit string, cmp string, condition string, context string")).collect()
    assert [(r.train_ready_strict, r.train_ready_relaxed) for r in s] == [(True, True), (False, True), (False, False), (False, False), (False, False)]
    assert s[0].val_col_header == "MIC" and s[4].is_aggregate_group
    assert [r.value for r in quality.value_counts(spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "x string"), "x", 2).collect()] == ["b", None]
    assert tables.PAPER_POINTS == (3, 3, 1, 1)
    assert spark.range(1).select(tables.title_score(F.lit("Antimicrobial toxin: IC50"), F.lit("Y"), F.lit("n")).alias("s")).first().s == 6


def test_cosine_neighbours_in_small_tiles(spark, monkeypatch):
    """Ties over tiles and blocks go by id; nearest of more blocks than one are merged in the task."""
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vectors, "CELLS", 64)
    r = np.random.default_rng(3)
    x = r.integers(-2, 3, size=(150, 3)).astype(float) + 0.5  # many equal directions
    df = spark.createDataFrame([(int((i * 37) % 150), x[i].tolist(), i % 3) for i in range(150)], "id long, vector array<double>, label int").coalesce(1)
    u = {row.id: np.array(row.vector) / np.linalg.norm(row.vector) for row in df.collect()}
    label = {row.id: row.label for row in df.collect()}
    for same in (None, "label"):
        want = {}
        for a in range(0, 150, 5):
            others = [b for b in u if b != a and (same is None or label[a] != label[b])]
            want[a] = sorted((-round(float(u[a] @ u[b]), 9), b) for b in others)[:7]
        got = {}
        for h in vectors.cosine_knn(df.where("id % 5 = 0"), df, 7, same_col=same).orderBy("query", "rank").collect():
            got.setdefault(h.query, []).append((-h.similarity, h.neighbour))
        assert got == want


def test_the_best_so_far_stay_few():
    """However many blocks come, k a query are held and sent on."""
    import numpy as np

    best = vectors._Best(50, 4)
    r = np.random.default_rng(1)
    for b in range(20):
        best.add([best.tile(0, np.round(r.normal(size=(50, 200)), 9), np.arange(200) + 200 * b)])
        assert len(best.query) == 200
    assert np.array_equal(best.query, np.repeat(np.arange(50), 4))


def test_tables_are_dealt_and_parsed_once(spark):
    """One small file's articles are many tasks' work; records of a document need one parse."""
    cell = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    xml = f"<article><table-wrap id='t1'><table>{cell('Peptide', 'Sequence')}{cell('A', 'ACDKLLKWGG')}</table></table-wrap><table-wrap id='t2'><table>{cell('Peptide', 'MIC (µM)')}{cell('A', '5')}</table></table-wrap></article>"
    df = spark.createDataFrame([(i, xml) for i in range(40)], "id long, xml string").coalesce(1)
    parsed = tables.articles(df, "xml", "id")
    assert parsed.select(F.spark_partition_id()).distinct().count() > 4
    found = tables.experimental_records(tables.tables_of(parsed))
    assert sorted((r.doc, r.value, r.sequence) for r in found.collect()) == [(i, 5.0, "ACDKLLKWGG") for i in range(40)]
    assert found._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") > 0


def test_a_large_tables_records_go_on_in_pieces():
    """Found records are not held whole: the first come before the last rows are looked at."""
    import pyarrow as pa

    rows = [["Peptide", "MIC (µM)"], *[[f"p{i}", "5"] for i in range(500)]]
    t = {"table_id": "t", "label": "", "caption": "", "foot": "", "rows": rows}
    found = tables._row_records(t, {f"p{i}" for i in range(500)})
    assert next(found)["norm_id"] == "p0" and len(list(found)) == 499
    big = pa.RecordBatch.from_pydict({"xml": ["x" * 2_000_000, "x" * 2_000_000, "x"]})
    assert [p.num_rows for p in tables._pieces(big)] == [1, 1, 1]
