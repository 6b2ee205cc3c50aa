"""Evaluation of scored rows: label (phishing or legitimate) and probability. All metrics are relational aggregates."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.operators.ranks import with_running_sums

#: Distribution function of Poisson(1).
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _from_counts(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn)
    return df.select(
        *[c for c in df.columns if c not in ("tp", "fp", "fn", "tn")], "tp", "fp", "fn", "tn",
        (tp + fp + fn + tn).alias("support"), precision.alias("precision"), recall.alias("recall"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _share(tp + tn, tp + fp + fn + tn).alias("accuracy"), _share(fp, fp + tn).alias("false_positive_rate"), _share(fn, fn + tp).alias("false_negative_rate"),
    )


def _counts(actual: Column, predicted: Column) -> list[Column]:
    one = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name)
    return [one(actual & predicted, "tp"), one(~actual & predicted, "fp"), one(actual & ~predicted, "fn"), one(~actual & ~predicted, "tn")]


def classification(df: DataFrame, threshold: float = 0.5, by: list[str] | None = None, label: str = "label", probability: str = "probability") -> DataFrame:
    """Confusion counts and the rates from them; a division by zero is 0. by: a row for each group."""
    return _from_counts(df.groupBy(*(by or [])).agg(*_counts(F.col(label) == "phishing", F.col(probability) >= threshold)))


def threshold_sweep(df: DataFrame, low: float = 0.30, high: float = 0.70, step: float = 0.01) -> DataFrame:
    """classification() at each threshold, from one histogram of the rows over the thresholds."""
    n = round((high - low) / step) + 1
    grid = F.array(*(F.lit(round(low + k * step, 10)) for k in range(n)))
    passed = F.size(F.filter(grid, lambda t: F.col("probability") >= t))  # thresholds up to the probability
    hist = df.groupBy(passed.alias("passed")).agg(*(F.sum(F.when(c, 1).otherwise(0)).alias(k) for c, k in ((F.col("label") == "phishing", "p"), (F.col("label") != "phishing", "q"))))
    spark = df.sparkSession
    grid_rows = F.broadcast(spark.createDataFrame([(k, round(low + k * step, 10)) for k in range(n)], "k int, threshold double"))  # n rows
    cells = hist.join(grid_rows)  # n + 1 rows of counts by n thresholds
    up = F.col("passed") > F.col("k")
    one = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0))
    return _from_counts(cells.groupBy("threshold").agg(one(up, "p").alias("tp"), one(up, "q").alias("fp"), one(~up, "p").alias("fn"), one(~up, "q").alias("tn")))


def best_threshold(df: DataFrame) -> DataFrame:
    """The threshold of the best F1, then recall, then closeness to 0.5."""
    return threshold_sweep(df).orderBy(F.desc(F.round("f1", 12)), F.desc(F.round("recall", 12)), F.round(F.abs(F.col("threshold") - 0.5), 9), "threshold").limit(1)


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    """Weighted gap between mean label and mean probability over equal bins, the last one closed."""
    cell = df.groupBy(F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg((F.col("label") == "phishing").cast("double")).alias("y"), F.avg("probability").alias("p"))
    return cell.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.abs(F.col("y") - F.col("p"))), F.sum("n")), F.lit(0.0)).alias("expected_calibration_error"))


def brier(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col("probability") - (F.col("label") == "phishing").cast("double"), 2)).alias("brier_score"))


def average_precision(df: DataFrame, by: list[str] | None = None, weight: Column | None = None, probability: str = "probability", buckets: int = 1024) -> DataFrame:
    """Step PR-AUC over tied scores, null without both labels; by: a row for each group.

    Without groups, rows are first summed up by score. The running sums go through so many buckets of falling scores (those
    outside 0 to 1 are in the ends), so no task sees all scores.
    """
    by, w = by or [], F.lit(1.0) if weight is None else weight
    p = F.when(F.col("label") == "phishing", w).otherwise(0.0)
    level = df.select(*by, F.col(probability).alias("_score"), p.alias("p"), w.alias("n"))
    level = level if by else level.groupBy("_score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    bucket = -F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score"))) * buckets).cast("int") if buckets > 1 else F.lit(0)
    at = with_running_sums(level, by, [F.desc("_score")], bucket, {"tp": "p", "k": "n"}, {"all_p": "p", "all_n": "n"})
    value = F.sum(F.try_divide(F.col("p"), F.col("all_p")) * F.try_divide(F.col("tp"), F.col("k")))
    both = (F.max("all_p") > 0) & (F.max("all_p") < F.max("all_n"))
    return at.groupBy(*by).agg(F.when(both, value).alias("pr_auc"))


def bootstrap_weights(row_id: str, replicates: int) -> Column:
    """Array of struct replicate, weight: Poisson(1) draws from a hash of (row, replicate); the same on every run."""
    u = lambda r: F.conv(F.substring(F.md5(F.concat_ws("|", F.col(row_id).cast("string"), r.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    steps = POISSON
    draws = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: F.struct(r.alias("replicate"), u(r).alias("u")))  # each hash once
    weight = lambda x: sum((F.when(x["u"] >= s, 1).otherwise(0) for s in steps), F.lit(0))
    return F.transform(F.filter(draws, lambda x: x["u"] >= steps[0]), lambda x: F.struct(x["replicate"].alias("replicate"), weight(x).alias("weight")))


#: Ranges of a score in the bootstrap: one for so many rows, at least and at most so many; and the share of rows from which one level of a score is a range of its own.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES, HOT_LEVEL = 50_000, 16, 2048, 1000
_SUMS = "side int, range int, p binary, n binary"


#: MD5: the shifts of its four rounds and its constants.
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_STARTS = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Hashes that are worked out at once, and the longest text whose hash takes one block.
_AT_ONCE, _ONE_BLOCK = 65_536, 55


def _md5_heads(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of each block of start | end: 16 words a row, a result for each pair of rows.

    The first word of the state is complete three steps before the last.
    """
    n, m = len(start), len(end)
    a, b, c, d = (np.full((n, m), x, np.uint32) for x in _STARTS)
    t = np.empty((n, m), np.uint32)
    for k in range(61):
        turn = k // 16
        if turn == 0:
            word = k
            np.bitwise_and(np.bitwise_xor(c, d, out=t), b, out=t)
            t ^= d
        elif turn == 1:
            word = (5 * k + 1) % 16
            np.bitwise_and(np.bitwise_xor(b, c, out=t), d, out=t)
            t ^= c
        elif turn == 2:
            word = (3 * k + 5) % 16
            np.bitwise_xor(np.bitwise_xor(b, c, out=t), d, out=t)
        else:
            word = 7 * k % 16
            np.bitwise_or(np.invert(d, out=t), b, out=t)
            t ^= c
        a += t
        a += start[:, word, None] + np.uint32(_SINES[k])
        if end[:, word].any():
            a += end[None, :, word]
        by = _SHIFTS[turn][k % 4]
        np.left_shift(a, np.uint32(by), out=t)
        a >>= np.uint32(32 - by)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(_STARTS[0])
    return b.byteswap()


def _draws(ids: list, replicates: int) -> np.ndarray:
    """bootstrap_weights() as a row of counts for each id; an id is text.

    Hashes of ids of the same length are worked out together, as words of whole arrays; only those of texts of more than one block are not.
    """
    out = np.zeros((len(ids), replicates), dtype=np.uint8)
    ends = [f"|{r}".encode() for r in range(1, replicates + 1)]
    most = max(map(len, ends), default=0)
    starts = [row_id.encode() for row_id in ids]
    lengths = np.fromiter(map(len, starts), np.int64, len(starts))
    limits = [math.ceil(s * 2**32) for s in POISSON]
    for length in np.unique(lengths).tolist():
        here = np.flatnonzero(lengths == length)
        if length + most > _ONE_BLOCK:
            for k in here.tolist():
                u = np.array([int.from_bytes(hashlib.md5(starts[k] + end).digest()[:4], "big") for end in ends]) / 4294967296.0
                out[k] = np.searchsorted(POISSON, u, side="right")
            continue
        end = np.frombuffer(b"".join((b"\0" * length + e + b"\x80").ljust(56, b"\0") + (8 * (length + len(e))).to_bytes(8, "little") for e in ends), "<u4").reshape(-1, 16)
        start = np.frombuffer(b"".join(starts[k].ljust(64, b"\0") for k in here.tolist()), "<u4").reshape(-1, 16)
        step = max(1, _AT_ONCE // max(1, replicates))
        for k in range(0, len(here), step):
            head = _md5_heads(start[k : k + step], end)
            out[here[k : k + step]] = sum((head >= np.uint32(x) for x in limits), np.zeros(head.shape, np.uint8))
    return out


def _score_cuts(rows: DataFrame, score: str) -> tuple[list[float], list[float]]:
    """Values that part the scores into ranges, with the levels that many rows share as ranges of their own: at most MOST_RANGES + HOT_LEVEL numbers, and the hot ones."""
    n = rows.count()
    ranges = max(LEAST_RANGES, min(MOST_RANGES, n // RANGE_ROWS))
    edges = rows.approxQuantile(score, [k / ranges for k in range(1, ranges)], 0.5 / ranges) if n and ranges > 1 else []
    hot = [r[0] for r in rows.groupBy(score).agg(F.count("*").alias("n")).filter(F.col("n") > max(n // HOT_LEVEL, ranges)).select(score).collect()]  # at most HOT_LEVEL
    return sorted({*edges, *hot}), sorted(hot)


def paired_bootstrap(df: DataFrame, replicates: int = 500, candidate: str = "candidate", baseline: str = "baseline", row_id: str = "id") -> DataFrame:
    """Mean and 95 % interval of the PR-AUC difference of two scores over hash-seeded resamples of the rows.

    One ordered pass serves all replicates: a row carries its id, from which a task draws its counts in all resamples. Tasks first add up the
    counts of each range of a score; ranges are summed in order, so each knows what stands before it in every replicate, and then
    each range takes its part of all areas. What is shuffled are rows (an id and a score) and sums of ranges, never rows times
    replicates. A level that many rows share is a range of its own, whose area needs just its sums.
    Replicates without both labels don't count. Rows without an id or a score take no part.
    """
    spark = df.sparkSession
    rows = df.select(F.col(row_id).cast("string").alias("id"), F.coalesce(F.col("label") == "phishing", F.lit(False)).alias("y"), F.col(candidate).cast("double").alias("a"), F.col(baseline).cast("double").alias("b")).filter("id is not null and a is not null and b is not null")
    cuts = [_score_cuts(rows, c) for c in ("a", "b")]
    parts = 1 + max(len(edges) for edges, _ in cuts)  # tasks by the hashes they work out, not by the few bytes of their rows

    def range_of(side: int, score: np.ndarray) -> np.ndarray:
        """Falling with the score: even numbers are between two cuts, odd ones are hot levels."""
        edges, hot = np.array(cuts[side][0]), np.array(cuts[side][1])
        at = np.searchsorted(edges, score, side="left")
        return 2 * (len(edges) - at) - np.isin(score, hot)

    def summed(batches):
        totals: dict = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                w, y = _draws(part.column(0).to_pylist(), replicates), part.column(1).to_numpy(zero_copy_only=False)
                for side in (0, 1):
                    where = range_of(side, part.column(2 + side).to_numpy())
                    for r in np.unique(where).tolist():
                        here = where == r
                        p, n = totals.setdefault((side, r), (np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)))
                        p += w[here & y].sum(axis=0, dtype=np.int64)
                        n += w[here].sum(axis=0, dtype=np.int64)
        for (side, r), (p, n) in totals.items():
            yield pa.RecordBatch.from_pydict({"side": pa.array([side], pa.int32()), "range": pa.array([r], pa.int32()), "p": [p.tobytes()], "n": [n.tobytes()]})

    def added(table: pa.Table) -> pa.Table:
        """The sums of one range over all tasks: a row for each task."""
        total = [sum(np.frombuffer(x, np.int64) for x in table[c].to_pylist()) for c in ("p", "n")]
        return pa.table({"side": table["side"][:1], "range": table["range"][:1], "p": [total[0].tobytes()], "n": [total[1].tobytes()]})

    sums = rows.repartition(parts).mapInArrow(summed, _SUMS).groupBy("side", "range").applyInArrow(added, _SUMS).persist()
    found = {(r["side"], r["range"]): (np.frombuffer(r["p"], np.int64), np.frombuffer(r["n"], np.int64)) for r in sums.collect()}  # ranges of two scores, 8 kB each
    sums.unpersist()
    before, areas, whole = {}, np.zeros((2, replicates)), {}
    for side in (0, 1):
        p = n = np.zeros(replicates, np.int64)
        for key in sorted(k for k in found if k[0] == side):
            before[key] = p, n
            p, n = p + found[key][0], n + found[key][1]
            if key[1] % 2:
                areas[side] += np.divide(found[key][0] * p, n, out=np.zeros(replicates), where=n > 0)
        whole[side] = p, n
    given = spark.sparkContext.broadcast(before)  # as many as found

    def area(table: pa.Table) -> pa.Table:
        """The areas of a range, not yet divided by all positives."""
        side, r = table["side"][0].as_py(), table["range"][0].as_py()
        order = np.argsort(-table["score"].to_numpy(), kind="stable")
        score, y, ids = table["score"].to_numpy()[order], table["y"].to_numpy(zero_copy_only=False)[order], table["id"].take(pa.array(order)).to_pylist()
        (p, n), out, k = given.value[side, r], np.zeros(replicates), 0
        while k < len(ids):
            to = min(k + 4096, len(ids))
            w = _draws(ids[k:to], replicates).astype(np.int64)
            level = np.flatnonzero(np.append(True, score[k + 1 : to] != score[k : to - 1]))
            if to < len(ids) and score[to] == score[to - 1]:  # the last level goes on
                keep = level[-1] if len(level) > 1 else 0
                if keep:
                    to, w, level = k + keep, w[:keep], level[:-1]
                else:
                    to = int(np.searchsorted(-score, -score[k], side="right"))
                    w, level = _draws(ids[k:to], replicates).astype(np.int64), np.zeros(1, np.int64)
            dp, dn = np.add.reduceat(w * y[k:to, None], level, axis=0), np.add.reduceat(w, level, axis=0)
            tp, all_ = p + np.cumsum(dp, axis=0), n + np.cumsum(dn, axis=0)
            out += np.divide(dp * tp, all_, out=np.zeros(dp.shape), where=all_ > 0).sum(axis=0)
            p, n, k = tp[-1], all_[-1], to
        return pa.table({"side": pa.array([side], pa.int32()), "range": pa.array([r], pa.int32()), "area": [out.tobytes()]})

    def ranged(batches):
        for batch in batches:
            for side in (0, 1):
                score = batch.column(2 + side)
                where = range_of(side, score.to_numpy())
                out = pa.RecordBatch.from_arrays([pa.array(np.full(len(where), side, np.int32)), pa.array(where.astype(np.int32)), batch.column(0), batch.column(1), score], names=["side", "range", "id", "y", "score"])
                yield out.filter(pa.array(where % 2 == 0))

    ordered = rows.mapInArrow(ranged, "side int, range int, id string, y boolean, score double").repartition(2 * parts, "side", "range").groupBy("side", "range")
    for r in sorted(ordered.applyInArrow(area, "side int, range int, area binary").collect(), key=lambda r: r["range"]):  # 4 kB for each range; added in one order
        areas[r["side"]] += np.frombuffer(r["area"])
    both = (whole[0][0] > 0) & (whole[0][0] < whole[0][1])
    d = spark.createDataFrame([(float(x),) for x in ((areas[0] - areas[1])[both] / whole[0][0][both])], "d double")
    return d.agg(F.count("d").alias("iterations"), F.avg("d").alias("mean_difference"), F.percentile("d", F.lit(0.025)).alias("ci95_lower"), F.percentile("d", F.lit(0.975)).alias("ci95_upper"))


def rate_summary(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = F.col("probability")
    return df.agg(F.count("*").alias("support"), F.avg((p >= threshold).cast("double")).alias("flag_rate"), F.avg(p).alias("mean_probability"), F.max(p).alias("max_probability"), F.sum((p >= threshold).cast("int")).alias("flagged"))


def pair_deltas(df: DataFrame, threshold: float = 0.5, candidate: str = "candidate", baseline: str = "baseline") -> DataFrame:
    """F1 and Brier difference of two scores on the same rows, and the relative fall of the false positive rate."""
    def side(c: str) -> DataFrame:
        rows = df.select("label", F.col(c).alias("probability"))
        return classification(rows, threshold).join(brier(rows)).select(F.col("f1").alias(f"f1_{c}"), F.col("false_positive_rate").alias(f"fpr_{c}"), F.col("brier_score").alias(f"brier_{c}"))

    both = side(candidate).join(side(baseline))
    return both.select(
        (F.col(f"f1_{candidate}") - F.col(f"f1_{baseline}")).alias("f1_difference"), (F.col(f"brier_{candidate}") - F.col(f"brier_{baseline}")).alias("brier_difference"),
        F.try_divide(F.col(f"fpr_{baseline}") - F.col(f"fpr_{candidate}"), F.col(f"fpr_{baseline}")).alias("relative_fpr_reduction"),
    )


def multilabel(df: DataFrame, names: list[str], actual: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 of each name; `micro` over all; `exact_match` has the share of rows whose sets are equal in f1."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.array_contains(actual, n).alias("a"), F.array_contains(predicted, n).alias("p")) for n in names))).alias("x")).select("x.*")
    cells = cells.withColumn("name", F.explode(F.array("name", F.lit("micro"))))
    scores = _from_counts(cells.groupBy(F.col("name").alias("label")).agg(*_counts(F.col("a"), F.col("p")))).select("label", (F.col("tp") + F.col("fn")).alias("positives"), "precision", "recall", "f1")
    same = df.agg(F.lit("exact_match").alias("label"), F.count("*").alias("positives"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), F.avg((F.array_sort(actual) == F.array_sort(predicted)).cast("double")).alias("f1"))
    return scores.unionByName(same)


def errors(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Wrong rows with error_type FP or FN."""
    up, yes = F.col("probability") >= threshold, F.col("label") == "phishing"
    return df.withColumn("error_type", F.when(up & ~yes, "FP").when(~up & yes, "FN")).filter("error_type is not null")


def best_thresholds(df: DataFrame, by: str, low: float = 0.20, high: float = 0.90, step: float = 0.05, least_precision: float = 0.80) -> DataFrame:
    """For each group the threshold of the best F1 among those precise enough, ties to the higher; groups without one keep 0.5."""
    n = round((high - low) / step) + 1
    grid = F.explode(F.array(*(F.lit(round(low + k * step, 2)) for k in range(n)))).alias("threshold")
    level = df.groupBy(by, F.floor(F.col("probability") * 100 + 1e-9).alias("cent")).agg(F.sum((F.col("label") == "phishing").cast("int")).alias("p"), F.count("*").alias("n"))
    cells = level.select("*", grid).withColumn("up", F.col("cent") >= F.round(F.col("threshold") * 100))
    one = lambda c, v: F.sum(F.when(c, v).otherwise(0))
    up, q = F.col("up"), F.col("n") - F.col("p")
    rows = _from_counts(cells.groupBy(by, "threshold").agg(one(up, F.col("p")).alias("tp"), one(up, q).alias("fp"), one(~up, F.col("p")).alias("fn"), one(~up, q).alias("tn")))
    ok = F.when(F.col("precision") >= least_precision, F.struct(F.round("f1", 12).alias("best_f1"), "threshold"))
    return rows.groupBy(by).agg(F.max(ok).alias("b")).select(by, F.coalesce(F.col("b.threshold"), F.lit(0.5)).alias("threshold"), F.coalesce(F.col("b.best_f1"), F.lit(0.0)).alias("f1"))


def calibration_acceptance(df: DataFrame, row_id: str, name: str, thresholds: DataFrame) -> DataFrame:
    """One row: the share of rows all of whose labels are right at 0.5 and at the thresholds, and whether the thresholds are accepted, as that share does not fall.

    df: row_id, name, actual, probability, a row for each label of a row. thresholds: name, threshold (a row for each label).
    """
    rows = df.join(F.broadcast(thresholds.select(name, "threshold")), name)  # a row for each label
    right = lambda t: F.min(((F.col("probability") >= t) == F.col("actual")).cast("double"))
    each = rows.groupBy(row_id).agg(right(F.lit(0.5)).alias("_default"), right(F.col("threshold")).alias("_calibrated"))
    out = each.agg(F.avg("_default").alias("default_exact_match"), F.avg("_calibrated").alias("calibrated_exact_match"))
    return out.withColumn("accepted", F.col("calibrated_exact_match") >= F.col("default_exact_match"))


def ablation_deltas(df: DataFrame, pairs: dict[str, tuple[str, str]], dataset: str = "dataset", variant: str = "variant", value: str = "f1") -> DataFrame:
    """For each dataset how much the value of one variant is above that of another: a column for each name → (variant, below)."""
    names = sorted({v for pair in pairs.values() for v in pair})
    wide = df.groupBy(dataset).pivot(variant, names).agg(F.first(value))
    return wide.select(dataset, *((F.col(f"`{a}`") - F.col(f"`{b}`")).alias(name) for name, (a, b) in pairs.items()))


def error_breakdown(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Errors by type and each key: dimension, value, error_type, n."""
    rows = errors(df, threshold)
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys))).alias("x")
    return rows.select("error_type", cells).groupBy(F.col("x.dimension").alias("dimension"), F.col("x.value").alias("value"), "error_type").agg(F.count("*").alias("n"))
