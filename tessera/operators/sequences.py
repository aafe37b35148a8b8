"""Composition features, alignments, substitutions, ranking towards lower scores, and hit rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import MODEL_ALPHABET

#: Hydrophobicity (Kyte and Doolittle), mass and charge of a residue, and residue sets.
HYDROPHOBICITY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
MASS = {"A": 89.09, "C": 121.16, "D": 133.10, "E": 147.13, "F": 165.19, "G": 75.07, "H": 155.16, "I": 131.17, "K": 146.19, "L": 131.17, "M": 149.21, "N": 132.12, "P": 115.13, "Q": 146.15, "R": 174.20, "S": 105.09, "T": 119.12, "V": 117.15, "W": 204.23, "Y": 181.19}
CHARGE = {"D": -1.0, "E": -1.0, "K": 1.0, "R": 1.0, "H": 0.1}
SETS = {"aromatic": "FWY", "polar": "STNQHYC", "pos": "KRH", "neg": "DE"}


def composition_features(seq: Column, counts: dict[str, Column] | None = None) -> list[Column]:
    """33 columns of a sequence of the 20 letters: from letter counts, so a row costs 20 counts and dot products; null if empty."""
    n = F.when(F.length(seq) > 0, F.length(seq)).cast("double")
    count = counts or {a: (F.length(seq) - F.length(F.replace(seq, F.lit(a), F.lit("")))).cast("double") for a in MODEL_ALPHABET}
    total = lambda scale: sum((count[a] * F.lit(v) for a, v in scale.items()), F.lit(0.0))
    mean = lambda scale: total(scale) / n

    def deviation(scale: dict[str, float]) -> Column:
        m = mean(scale)
        return F.sqrt(sum((count[a] * (F.lit(v) - m) * (F.lit(v) - m) for a, v in scale.items()), F.lit(0.0)) / n)

    share = lambda letters: sum((count[a] for a in letters), F.lit(0.0)) / n
    named = {
        "length": n, "log1p_length": F.log1p(n), "net_charge": total(CHARGE), "mean_charge": mean(CHARGE), "mean_hydrophobicity_kd": mean(HYDROPHOBICITY), "std_hydrophobicity_kd": deviation(HYDROPHOBICITY),
        "mean_residue_mw": mean(MASS), "std_residue_mw": deviation(MASS), **{f"frac_{k}": share(v) for k, v in SETS.items()}, "frac_hydrophobic_kd_pos": share([a for a, v in HYDROPHOBICITY.items() if v > 0]),
        **{f"aa_frac_{a}": count[a] / n for a in MODEL_ALPHABET},
    }
    return [c.alias(k) for k, c in named.items()]


def column_profile(alignment: DataFrame) -> DataFrame:
    """(aln_id, pos, letter, freq): frequencies over letters that are no gaps. alignment: aln_id, row, aligned."""
    chars = alignment.select("aln_id", F.posexplode(F.filter(F.split("aligned", ""), lambda c: c != "")).alias("pos", "letter"))
    counts = chars.where("letter <> '-'").groupBy("aln_id", "pos", "letter").agg(F.count("*").alias("n"))
    return counts.withColumn("freq", F.col("n") / F.sum("n").over(W.partitionBy("aln_id", "pos"))).drop("n")


def alignment_summary(alignment: DataFrame, conserved_at: float = 0.3) -> DataFrame:
    """Nine features of each alignment: depth, log1p depth, gap rates of the first row and of all, normalised entropy of columns (mean, median, min, max) and the
    share of columns of conserved_at or less. A column of gaps has entropy 0; depth below 2 gives zeros."""
    base = alignment.groupBy("aln_id").agg(F.count("*").alias("depth"), F.min_by("aligned", "row").alias("first"), F.max(F.length("aligned")).alias("width"), F.avg(F.length(F.regexp_replace("aligned", "[^-]", "")) / F.greatest(F.lit(1), F.length("aligned"))).alias("gap_all"))
    entropy = column_profile(alignment).groupBy("aln_id", "pos").agg((-F.sum(F.col("freq") * F.log("freq")) / F.log(F.lit(20.0))).alias("h"))
    places = base.select("aln_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("width") - 1))).alias("pos"))
    h = places.join(entropy, ["aln_id", "pos"], "left").withColumn("h", F.coalesce("h", F.lit(0.0)))
    stats = h.groupBy("aln_id").agg(F.avg("h").alias("h_mean"), F.median("h").alias("h_median"), F.min("h").alias("h_min"), F.max("h").alias("h_max"), F.avg((F.col("h") <= conserved_at).cast("double")).alias("conserved"))
    out = base.join(stats, "aln_id")
    deep = F.col("depth") >= 2
    gap = F.length(F.regexp_replace("first", "[^-]", "")) / F.greatest(F.lit(1), F.length("first"))
    values = {"depth": F.col("depth").cast("double"), "log1p_depth": F.log1p("depth"), "gap_first": gap, "gap_all": F.col("gap_all"), **{c: F.col(c) for c in ("h_mean", "h_median", "h_min", "h_max", "conserved")}}
    return out.select("aln_id", *[F.when(deep, c).otherwise(F.lit(0.0)).alias(k) for k, c in values.items()])


def allowed_substitution(old: Column, new: Column, forbid: str | None = None) -> Column:
    ok = old != new
    return ok & (old != forbid) & (new != forbid) if forbid else ok


def substitutions(df: DataFrame, seq: str, alphabet: str = MODEL_ALPHABET, forbid: str | None = None) -> DataFrame:
    """All single-letter variants: pos (from 0), old, new, variant, with the other columns."""
    placed = df.select("*", F.posexplode(F.filter(F.split(seq, ""), lambda c: c != "")).alias("pos", "old")).select("*", F.explode(F.array(*[F.lit(a) for a in alphabet])).alias("new"))
    return placed.where(allowed_substitution(F.col("old"), F.col("new"), forbid)).withColumn("variant", F.concat(F.substring(F.col(seq), F.lit(1), F.col("pos")), F.col("new"), F.substring(F.col(seq), F.col("pos") + 2, F.length(seq))))


def guided_substitutions(df: DataFrame, seq: str, guide: str, forbid: str | None = None) -> DataFrame:
    """Variants that take one letter from a guide of equal length where the two differ; none for other lengths."""
    placed = df.where(F.length(seq) == F.length(guide)).select("*", F.posexplode(F.filter(F.split(seq, ""), lambda c: c != "")).alias("pos", "old"))
    placed = placed.withColumn("new", F.substring(F.col(guide), F.col("pos") + 1, F.lit(1))).where(allowed_substitution(F.col("old"), F.col("new"), forbid))
    return placed.withColumn("variant", F.concat(F.substring(F.col(seq), F.lit(1), F.col("pos")), F.col("new"), F.substring(F.col(seq), F.col("pos") + 2, F.length(seq))))


def expand(cases: DataFrame, neighbours: DataFrame, seq: str = "sequence", positions: str | None = None, forbid: str | None = None, same_length: bool = True) -> DataFrame:
    """Candidates by strategy. evidence: guided by the first neighbour labelled 0; attribution: all letters at the given positions (an array column); full_scan.

    cases: case_id, sequence[, positions]; neighbours: case_id, rank, sequence, label.
    """
    n = neighbours.where("label = 0").select("case_id", "rank", F.col("sequence").alias("guide"))
    j = cases.join(n, "case_id")
    j = j.where(F.length(seq) == F.length("guide")) if same_length else j
    first = j.groupBy("case_id", seq).agg(F.min_by("guide", "rank").alias("guide"))
    keep = ["case_id", "pos", "old", "new", "variant"]
    out = guided_substitutions(first, seq, "guide", forbid).select(F.lit("evidence").alias("strategy"), *keep)
    scan = substitutions(cases, seq, forbid=forbid)
    if positions:
        out = out.unionByName(scan.where(F.array_contains(positions, F.col("pos"))).select(F.lit("attribution").alias("strategy"), *keep))
    return out.unionByName(scan.select(F.lit("full_scan").alias("strategy"), *keep))


def rank_candidates(scored: DataFrame, by: list[str], top: int | None = None) -> DataFrame:
    """Lowest score first, then lowest uncertainty, then text. There is no other direction."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy("p", "uncertainty", "variant"))
    out = scored.withColumn("rank", rank)
    return out.where(F.col("rank") <= top) if top else out


def pick_cases(scored: DataFrame, k: int) -> DataFrame:
    """Highest score, then lowest uncertainty, then the last text."""
    return scored.orderBy(F.desc("p"), "uncertainty", F.desc("sequence")).limit(k)


def hit_metrics(ranked: DataFrame, by: list[str], base_p: str, base_u: str, top_k: int = 10, eps: float = 0.05, reduce: float = 0.1, threshold: float = 0.5) -> DataFrame:
    """Per group: does the first, or any of the first k, cross the threshold or fall by `reduce`, uncertainty rising by eps at most."""
    steady = F.col("uncertainty") <= F.col(base_u) + eps
    flip, down = (F.col("p") < threshold) & steady, (F.col(base_p) - F.col("p") >= reduce) & steady
    any_of = lambda c, k: F.coalesce(F.max(F.when(F.col("rank") <= k, c.cast("int"))), F.lit(0))
    return ranked.groupBy(*by).agg(any_of(flip, 1).alias("flip_top1"), any_of(flip, top_k).alias("flip_topk"), any_of(down, 1).alias("reduce_top1"), any_of(down, top_k).alias("reduce_topk"), F.min(F.when(F.col("rank") == 1, F.col("p"))).alias("top1_p"))


def strategy_summary(cases: DataFrame, hits: DataFrame, strategies: list[str]) -> DataFrame:
    """Per strategy: coverage of the cases, hit rates over all and over covered cases, mean first score over covered ones."""
    spark = cases.sparkSession
    grid = cases.select("case_id").crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in strategies], "strategy string"))).join(hits.withColumn("covered", F.lit(1)), ["case_id", "strategy"], "left")
    flags = ("flip_top1", "flip_topk", "reduce_top1", "reduce_topk")
    return grid.groupBy("strategy").agg(F.avg(F.coalesce("covered", F.lit(0))).alias("coverage"), *[F.avg(F.coalesce(c, F.lit(0))).alias(f"{c}_rate") for c in flags], *[F.avg(c).alias(f"{c}_rate_covered") for c in flags], F.avg("top1_p").alias("mean_top1_p"))


def top_positions(cases: DataFrame, saliency: str, m: int) -> DataFrame:
    """Adds positions (from 0): the m of greatest saliency, ties by place. saliency: an array, a number a letter; null gives none."""
    ranked = F.transform(F.array_sort(F.transform(F.col(saliency), lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), lambda s: s["i"])
    return cases.withColumn("positions", F.coalesce(F.slice(ranked, 1, m), F.array().cast("array<int>")))


def composition(df: DataFrame, seq: str, keep: list[str]) -> DataFrame:
    """The columns in keep and the 33 features of composition_features(); each letter is counted once a row."""
    counted = df.select(*keep, F.col(seq).alias("_s"), F.array(*[F.length(seq) - F.length(F.replace(seq, F.lit(a), F.lit(""))) for a in MODEL_ALPHABET]).alias("_n"))
    counts = {a: F.get("_n", F.lit(i)).cast("double") for i, a in enumerate(MODEL_ALPHABET)}
    return counted.select(*keep, *composition_features(F.col("_s"), counts))
