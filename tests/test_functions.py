"""Text, measurement, sequence and evidential functions on fixed strings."""

import math

import numpy as np

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import evidential, measure, text
from tessera.operators import sequences


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.normalize_whitespace, " a  b\n\tc ", "a b c"),
        (text.normalize_whitespace, None, ""),
        (text.safe_stem, "10.1/ab c?", "10.1_ab_c"),
        (lambda c: text.clip(c, 3), "abcdef", "abc...<truncated>"),
        (text.split_sentences, "One. Two! Three? four", ["One.", "Two!", "Three?", "four"]),
        (text.split_sentences, "", []),
        (lambda c: text.find_sequences(c, 5), "the KLLKLL and AAAAAAAAAAAA, TRAINING; klLKLL", ["KLLKLL"]),
        (lambda c: text.canonical_sequence(c, 5), "GIGK-FLHS (orn) AK-NH2", "GIGKFLHSKAK"),
        (lambda c: text.canonical_sequence(c, 5), "εK LLK LLK*", "KLLKLLK"),
        (lambda c: text.canonical_sequence(c, 5), "n.d.", ""),
        (text.normalize_id, "Pep‐1 (40) Α", "pep1α"),
        (lambda c: text.context_value(c, "k"), "a=1; k = x;k=2;k=3", "2"),
        (text.is_missing, " NaN ", True),
        (text.is_missing, "0", False),
        (text.short_digest, "a", "86f7e437faa5a7fc"),
        (lambda c: text.ngrams(c, 3), "ab", []),
        (lambda c: text.ngrams(c, 3), "abcd", ["abc", "bcd"]),
        (text.ingest_normalise, " ac-d*u9z ", "ACDXX"),
        (text.encode_letters, "ACY?", [1, 2, 20, 0]),
        (lambda c: text.strict_sanitise(c, False), "a c?d", None),
        (text.to_double, "1e-3x", None),
        (lambda c: measure.header_hint(c)["endpoint"], "MIC/MBC (µg/mL)", "MIC"),
        (lambda c: measure.header_hint(c)["unit"], "Number of OPM", ""),
        (lambda c: measure.header_hint(c)["endpoint"], "SI (CC50/IC50)", ""),
        (lambda c: measure.header_hint(c)["unit"], "IC50 [μM]", "μM"),
        (measure.endpoint_override, "Hemolytic activity", "HEMOLYSIS"),
        (measure.is_count_like, " No. ", True),
        (measure.conditions, "at pH 7.4 and 37 °C for 24 h in HeLa, pH 7.4", ["pH 7.4", "37 °C", "24 h", "HeLa"]),
        (measure.endpoints_in, "mic and ic50 of MHCs", ["IC50", "MIC"]),
        (lambda c: measure.aggregate_flags(F.lit("E. coli"), c)["any"], "Geometric mean", True),
        (lambda c: measure.aggregate_flags(c, F.lit("")) ["group"], "Gram-negative", True),
        (measure.is_threshold_sentence, "A peptide is toxic if long.", True),
        (measure.is_threshold_sentence, "The threshold is high.", False),
        (measure.is_threshold_sentence, "The cutoff was 0.5.", True),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_strict_sanitise_raises(spark):
    with pytest.raises(PySparkException, match="1,Z"):
        one(spark, "aZ1z", text.strict_sanitise)


def test_pairs(spark):
    got = one(spark, "4 (>8)", measure.paired_values)
    assert [(x.which, x.cmp, x.value) for x in got] == [("first", "", 4.0), ("second", ">", 8.0)]
    assert [(x.cmp, x.value) for x in one(spark, "2/2", measure.paired_values)] == [("", 2.0), ("", 2.0)]
    assert one(spark, "2", measure.paired_values) == []


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("12 ± 3 uM", [(12.0, 3.0, None, None, "uM", "")]),
        ("5-6 mg/mL", [(None, None, 5.0, 6.0, "mg/mL", "")]),
        (">128", []),
        ("IC50 > 1.5e2 nM", [(150.0, None, None, None, "nM", "IC50")]),
        ("x1 uM2", []),
        ("0 uM", [(0.0, None, None, None, "uM", "")]),
    ],
)
def test_measurements(spark, value, want):
    assert [(m.value, m.error, m.range_low, m.range_high, m.unit, m.endpoint) for m in one(spark, value, measure.measurements)] == want
    hinted = one(spark, ">128", lambda c: measure.measurements(c, "MIC", "uM"))
    assert [(m.cmp, m.value, m.endpoint, m.unit) for m in hinted] == [(">", 128.0, "MIC", "uM")]
    assert measure.parse_measurements("0 uM", zero_is_null=True)[0]["value"] is None


def test_composition(spark):
    row = spark.createDataFrame([("KKDW",)], "s string").select(*sequences.composition_features(F.col("s"))).first()
    assert len(row) == 33 and row.length == 4 and row.net_charge == 1 and row.frac_pos == 0.5 and row.aa_frac_W == 0.25
    h = [-3.9, -3.9, -3.5, -0.9]
    m = sum(h) / 4
    assert math.isclose(row.mean_hydrophobicity_kd, m) and math.isclose(row.std_hydrophobicity_kd, math.sqrt(sum((x - m) ** 2 for x in h) / 4))


def test_alignment(spark):
    rows = [("a", 0, "A-"), ("a", 1, "C-"), ("b", 0, "AC")]
    got = {r.aln_id: r for r in sequences.alignment_summary(spark.createDataFrame(rows, "aln_id string, row int, aligned string")).collect()}
    assert math.isclose(got["a"].h_max, math.log(2) / math.log(20)) and got["a"].h_min == 0 and got["a"].conserved == 1.0 and got["a"].gap_all == 0.5
    assert got["b"].depth == 0.0


def test_evidential(spark):
    d = spark.range(1).select(evidential.dirichlet(F.lit(1.0), F.lit(3.0)).alias("d")).first().d
    assert (d.p_toxic, d.pred_label, d.uncertainty, d.total_evidence, list(d.probs)) == (0.75, 1, 0.5, 2.0, [0.25, 0.75])
    assert np.allclose(evidential.digamma([1.0, 0.5]), [-0.5772156649015329, -1.9635100260214235], atol=1e-9) and abs(evidential.dirichlet_kl([1.0, 1.0])[0]) < 1e-9
    x = np.array([0.01, 0.5, 1, 3.3, 8.9, 40, 1e4])
    assert np.allclose(evidential.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
    assert evidential.kl_warmup(5, 10) == 0.5
    loss = spark.range(1).select(evidential.evidential_loss(F.lit(1.0), F.lit(1.0), F.lit(1)).alias("l")).first().l
    assert math.isclose(loss, 2 * (0.25 + 0.25 / 3))


def test_models():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(200, 3))
    y = (x[:, 0] > 0).astype(float)
    w, b = evidential.fit_logistic(x, y)
    assert np.mean((x @ w + b > 0) == y) > 0.95
    head = evidential.mlp([(np.eye(3)[:, :2], np.zeros(2))])
    assert head is not None


def _weights(r, *shape):
    return r.normal(size=shape) / 2


def test_fusion_by_definition(spark):
    """Each row by loops over the definition: normalise, adapt with ReLU, join with the product, add the further branch, head."""
    r = np.random.default_rng(1)
    dims, d = (5, 3, 4), 6
    layer = lambda i, o: (_weights(r, i, o), _weights(r, o))
    w = {"norms": [(_weights(r, k), _weights(r, k)) for k in dims], "adapters": [layer(k, d) for k in dims], "joined": layer(4 * d, d), "head": [layer(d, 7), layer(7, 2)], "extra_norm": (_weights(r, 2), _weights(r, 2)), "extra_adapter": layer(2, d)}
    rows = [[_weights(r, k).tolist() for k in (*dims, 2)] for _ in range(4)]

    def linear(x, wb):
        return [sum(x[i] * wb[0][i][o] for i in range(len(x))) + wb[1][o] for o in range(len(wb[1]))]

    def norm(x, wb):
        m = sum(x) / len(x)
        v = sum((a - m) ** 2 for a in x) / len(x)
        return [(a - m) / math.sqrt(v + 1e-5) * g + b for a, g, b in zip(x, *wb, strict=True)]

    relu = lambda x: [max(a, 0.0) for a in x]
    for extra in (False, True):
        want = []
        for row in rows:
            a = [relu(linear(norm(x, n), ad)) for x, n, ad in zip(row[:3], w["norms"], w["adapters"], strict=True)]
            z = relu(linear([*a[0], *a[1], *a[2], *(x * y * q for x, y, q in zip(*a, strict=True))], w["joined"]))
            if extra:
                z = [p + q for p, q in zip(z, relu(linear(norm(row[3], w["extra_norm"]), w["extra_adapter"])), strict=True)]
            alpha = [math.log1p(math.exp(t)) + 1 for t in linear(relu(linear(z, w["head"][0])), w["head"][1])]
            want.append(alpha[1] / sum(alpha))
        df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "id int, x array<double>, y array<double>, z array<double>, m array<double>")
        got = evidential.fuse_batches(df, ["x", "y", "z"], w, "m" if extra else None).orderBy("id").select("prediction.p_toxic").collect()
        assert np.allclose([g.p_toxic for g in got], want, atol=1e-12)


def test_encoder_by_definition(spark, tmp_path):
    r = np.random.default_rng(2)
    w = {"embedding": _weights(r, 21, 4), "kernels": [(_weights(r, k, 4, 3), _weights(r, 3)) for k in (3, 5, 7)], "head": [(_weights(r, 9, 5), _weights(r, 5)), (_weights(r, 5, 2), _weights(r, 2))]}
    texts = ["ACDWY", "A", "KKLLAACDEFGHIK" * 3, "AXC", ""]
    evidential.save_weights(w, str(tmp_path / "w.json"))
    w = evidential.load_weights(str(tmp_path / "w.json"))

    def features(t):
        ids = [text.MODEL_ALPHABET.find(a) + 1 for a in t]
        x = [w["embedding"][i] if i else np.zeros(4) for i in ids]
        out = []
        for kernel, bias in w["kernels"]:
            k = len(kernel) // 2
            for c in range(3):
                at = lambda p: max(0.0, bias[c] + sum(x[p + j - k] @ kernel[j][:, c] for j in range(len(kernel)) if 0 <= p + j - k < len(x)))  # noqa: B023, E731
                out.append(max((at(p) for p in range(len(x))), default=0.0))
        return np.array(out)

    want = []
    for t in texts:
        z = np.maximum(features(t) @ w["head"][0][0] + w["head"][0][1], 0) @ w["head"][1][0] + w["head"][1][1]
        alpha = np.log1p(np.exp(z)) + 1
        want.append(alpha[1] / alpha.sum())
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    got = evidential.encode_batches(df, "s", w, text.MODEL_ALPHABET, rows=2).orderBy("id").select("prediction.p_toxic").collect()
    assert np.allclose([g.p_toxic for g in got], want, atol=1e-12)


def test_graph_encoder_by_definition(spark):
    r = np.random.default_rng(3)
    layers = [(_weights(r, 3, 4), _weights(r, 4)), (_weights(r, 4, 2), _weights(r, 2))]
    nodes = [(g, n, _weights(r, 3).tolist()) for g in (1, 2) for n in (10, 11, 12)] + [(3, 5, [1.0, 2.0, 3.0])]
    edges = [(1, 10, 11), (1, 12, 11), (1, 11, 10), (2, 10, 10), (1, 99, 10)]

    def by_hand(g):
        h = {n: np.array(x) for gg, n, x in nodes if gg == g}
        own = [(s, d) for gg, s, d in edges if gg == g and s in h]
        for w, b in layers:
            m = {n: (np.mean([h[s] for s, d in own if d == n], axis=0) if any(d == n for _, d in own) else np.zeros_like(h[n])) if own else h[n] for n in h}
            h = {n: np.maximum(m[n] @ w + b, 0) for n in h}
        return np.mean(list(h.values()), axis=0)

    got = {x.graph_id: x.vector for x in evidential.encode_graphs(spark.createDataFrame(nodes, "graph_id int, node long, x array<double>"), spark.createDataFrame(edges, "graph_id int, src long, dst long"), layers).collect()}
    assert set(got) == {1, 2, 3} and all(np.allclose(got[g], by_hand(g)) for g in got)
