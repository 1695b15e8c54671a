"""Feature preparation and evaluation.

Fit/transform pattern, as Spark ML does it: a "fit" is one global
aggregate whose single result row (a few numbers per column) comes to the
driver; the "transform" is a projection with those numbers as literals.  No
cross join, no global window over the fact table.  Dictionaries and orders stay
tables (``operators.ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matfold.functions._util import ColumnLike, col_of
from matfold.operators.ordered import dense_codes, running_total


# ------------------------------------------------------------------ scaling

def fit_standard(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (zero std -> 1, as sklearn)."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (m, s if s not in (None, 0.0) else 1.0)
    return out


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    return df.select("*", *[((F.col(c) - m) / s).alias(c + suffix) for c, (m, s) in stats.items()]) \
        if suffix else df.select(*[((F.col(c) - stats[c][0]) / stats[c][1]).alias(c) if c in stats
                                   else F.col(c) for c in df.columns])


def unstandardize(c: ColumnLike, mean: float, std: float) -> Column:
    return col_of(c) * std + mean


def fit_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def impute(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit(values[c])).alias(c) if c in values else F.col(c)
                       for c in df.columns])


def display_bounds(stats: dict[str, tuple[float, float]], integer_cols: Sequence[str] = ()) -> list[tuple]:
    """(feature, min, max, default) = mean -/+ 3 sigma; min floored at 0, or 1
    (rounded) for count features."""
    out = []
    for c, (m, s) in stats.items():
        if c in integer_cols:
            out.append((c, float(max(1, int(round(m - 3 * s)))), float(int(round(m + 3 * s))),
                        float(int(round(m)))))
        else:
            out.append((c, float(max(0.0, m - 3 * s)), float(m + 3 * s), float(m)))
    return out


# ----------------------------------------------------------------- encoding

def first_appearance_codes(df: DataFrame, col: str, order: str, code_col: str = "code") -> DataFrame:
    """Codes 0..k-1 by first appearance (``pd.factorize``); null -> -1.

    The distinct values are reduced with a map-side combined ``min``; their
    dense codes by first position are a table that is joined back.
    """
    firsts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(order).alias("_first"))
    codes = dense_codes(firsts, ["_first", col], "_code").select(F.col(col).alias("_value"), "_code")
    return _coded(df, col, codes, code_col)


def _coded(df: DataFrame, col: str, codes: DataFrame, code_col: str) -> DataFrame:
    out = df.join(codes, F.col(col) == F.col("_value"), "left")
    return out.select(*[df[c] for c in df.columns], F.coalesce("_code", F.lit(-1)).cast("int").alias(code_col))


def alphabetical_codes(df: DataFrame, col: str, code_col: str = "code") -> tuple[DataFrame, DataFrame]:
    """Codes in sorted order of the distinct values (``LabelEncoder`` /
    ``cat.codes``); null -> -1.  Returns the frame and the dictionary (label,
    code) that decodes it; both stay tables whatever the number of labels."""
    labels = df.select(F.col(col).cast("string").alias("label")).where("label IS NOT NULL").distinct()
    dictionary = dense_codes(labels, ["label"]).select("label", F.col("code").cast("int").alias("code"))
    return encode_labels(df, col, dictionary, code_col), dictionary


def encode_labels(df: DataFrame, col: str, dictionary: DataFrame, code_col: str = "code") -> DataFrame:
    """The codes of ``dictionary`` (label, code) for other rows; unknown labels and null -> -1."""
    return _coded(df, col, dictionary.select(F.col("label").alias("_value"), F.col("code").alias("_code")), code_col)


def decode_labels(df: DataFrame, code_col: str, dictionary: DataFrame, out_col: str) -> DataFrame:
    """Labels of codes by a join with the dictionary; a code that it lacks gives null."""
    names = dictionary.select(F.col("code").alias("_code"), F.col("label").alias("_label"))
    out = df.join(names, F.col(code_col).cast("int") == F.col("_code"), "left")
    return out.select(*[df[c] for c in df.columns], F.col("_label").alias(out_col))


# -------------------------------------------------------------------- split

def hash_bucket(key: ColumnLike, seed: str = "42") -> Column:
    """0..99 from the first 8 hex digits of md5(key || seed)."""
    h = F.conv(F.substring(F.md5(F.concat(col_of(key).cast("string"), F.lit(seed))), 1, 8), 16, 10)
    return (h.cast("long") % 100).cast("int")


def hash_value(key: ColumnLike, seed: str = "42") -> Column:
    return F.conv(F.substring(F.md5(F.concat(col_of(key).cast("string"), F.lit(seed))), 1, 8), 16, 10) \
            .cast("long")


def hash_split(df: DataFrame, key: str, train_pct: int = 80, seed: str = "42") -> DataFrame:
    """Deterministic split: 'train' when the md5 bucket is below train_pct."""
    return df.select("*", F.when(hash_bucket(key, seed) < train_pct, F.lit("train"))
                     .otherwise(F.lit("test")).alias("split"))


def stratified_split(df: DataFrame, key: str, label: str, train_frac: float = 0.8,
                     seed: str = "42", buckets_bits: int = 16) -> DataFrame:
    """Exactly floor(frac * n_c) training rows per class, chosen by md5 order.

    No window over a whole class (a class may hold a third of the rows): the
    class's cut is located in a histogram of the high hash bits, then in one of
    the low bits of that bucket's rows alone, and only rows that share the whole
    hash with the cut are ranked by their key.  The rows are then told by a
    comparison with their class's cut.  Null labels are a class of their own.
    """
    rows = df.select(F.col(label).alias("_l"), hash_value(key, seed).alias("_h"), F.col(key).alias("_key"))
    low = 32 - buckets_bits
    by_class = Window.partitionBy("_l")
    upto = by_class.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)

    def cut(hist: DataFrame, wanted: Column, *kept: str) -> DataFrame:
        """The bucket in which each class's last training row lies, and how many of its rows are needed."""
        cum = hist.select("_l", "_b", "_n", *kept, F.sum("_n").over(upto).alias("_cum"), wanted.alias("_k"))
        return (cum.where((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_n") < F.col("_k")))
                .select("_l", F.col("_b").alias("_cb"), (F.col("_k") - (F.col("_cum") - F.col("_n"))).alias("_need"), *kept))

    def within(cuts: DataFrame, part: Column) -> DataFrame:
        c = cuts.select(F.col("_l").alias("_cl"), "_cb", "_need")
        return rows.join(c, F.col("_l").eqNullSafe(F.col("_cl")) & (part == F.col("_cb")))

    high = F.shiftright("_h", low)
    first = cut(rows.groupBy("_l", high.alias("_b")).agg(F.count(F.lit(1)).alias("_n")),
                F.floor(F.sum("_n").over(by_class) * train_frac).cast("long"))
    inner = within(first, high).groupBy("_l", F.col("_h").alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.first("_need").alias("_want"))
    second = cut(inner, F.col("_want"))
    tied = within(second, F.col("_h")).withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy("_key")))
    cuts = tied.where("_r = _need").select(F.col("_l").alias("_cl"), F.struct(F.col("_h").alias("h"), F.col("_key").alias("k")).alias("_cut"))
    # classes whose cut is 0 rows have none: all of them are test rows
    out = df.join(cuts, F.col(label).eqNullSafe(F.col("_cl")), "left")
    mine = F.struct(hash_value(key, seed).alias("h"), F.col(key).alias("k"))
    return out.select(*[df[c] for c in df.columns],
                      F.when(F.col("_cut").isNotNull() & (mine <= F.col("_cut")), F.lit("train")).otherwise(F.lit("test")).alias("split"))


# ------------------------------------------------------------------ metrics

def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return counts.select(label, F.col("n_c").cast("long").alias("n_c"),
                         (F.lit(float(tot["n"])) / (tot["k"] * F.col("n_c"))).alias("weight"))


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """R^2 and MAE in one aggregate pass (sum of squares around the mean
    expanded so that no second pass is needed)."""
    e = F.col(y) - F.col(pred)
    df = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())  # complete pairs only
    agg = df.agg(F.count(F.col(y)).alias("n"), F.sum(e * e).alias("ss_res"),
                 F.var_pop(y).alias("var_y"), F.avg(F.abs(e)).alias("mae"))
    return agg.select(F.col("n").cast("long").alias("n"),
                      (1 - F.col("ss_res") / (F.col("var_y") * F.col("n"))).alias("r2"),
                      F.col("mae"))


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per class precision/recall/F1/support plus overall accuracy.

    The table of (true, predicted) counts gives each pair's share to both of its
    classes; one more aggregate adds them up.  Accuracy is a sum over the
    classes.
    """
    pairs = df.groupBy(F.col(y).alias("_y"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    share = lambda cls, true, predicted: F.struct(F.col(cls).alias("cls"), true.alias("support"), predicted.alias("predicted"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)
    each = pairs.select(F.explode(F.array(share("_y", F.col("_n"), F.lit(0).cast("long")), share("_p", F.lit(0).cast("long"), F.col("_n")))).alias("s"),
                        hit.alias("_hit")).select("s.*", F.when(F.col("s.support") > 0, F.col("_hit")).otherwise(0).alias("tp"))
    r = each.groupBy("cls").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    accuracy = F.sum("tp").over(every) / F.sum("support").over(every)
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return r.select("cls", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
                    F.col("support").cast("long").alias("support"), accuracy.cast("double").alias("accuracy"))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """ROC AUC by the rank-sum formula with tied scores counted half.

    Rows are first reduced to one row per distinct score (positives and
    negatives counted, map-side combined).  The running count of negatives
    below each score is taken per range of scores plus what the ranges in front
    hold, so no single task orders all distinct scores.
    """
    per = df.groupBy(F.col(score).alias("_s")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("_neg"))
    cum = running_total(per, "_s", "_neg", "_below")
    agg = cum.agg(F.sum(F.col("_pos") * F.col("_below") + 0.5 * F.col("_pos") * F.col("_neg")).alias("_u"),
                  F.sum("_pos").alias("P"), F.sum("_neg").alias("N"))
    return agg.select((F.col("_u") / (F.col("P") * F.col("N"))).alias("auc"),
                      F.col("P").cast("long").alias("n_pos"), F.col("N").cast("long").alias("n_neg"))


def out_of_range(df: DataFrame, id_col: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Long-form (id, feature, value, min, max) rows outside their bounds.

    The bounds are a literal per feature, applied in one projection over the
    unpivoted table (no join needed).
    """
    cols = list(bounds)
    long = df.select(id_col, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]) \
             .unpivot([id_col], cols, "feature", "value")
    lo = F.lit(None).cast("double")
    hi = F.lit(None).cast("double")
    for c, (a, b) in bounds.items():
        lo = F.when(F.col("feature") == c, F.lit(float(a))).otherwise(lo)
        hi = F.when(F.col("feature") == c, F.lit(float(b))).otherwise(hi)
    withb = long.select("*", lo.alias("min"), hi.alias("max"))
    return withb.where((F.col("value") < F.col("min")) | (F.col("value") > F.col("max")))
