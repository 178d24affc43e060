"""Projection, ordering, set and reshape helpers (survey P05-P14, O01-O07, U01-U04, R01-R03, V01)."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = [
    "rename_as_lag", "drop_existing", "drop_contaminated", "reorder", "paginate", "detect_schema",
    "top_per_group", "argmax_row", "pick_examples", "ordered_distinct", "union_aligned", "overlap_count",
    "pivot_wide", "pivot_map", "feature_pairs", "date_regimes", "quantile_regimes", "release_checks",
    "lookup_with_fallback", "replay", "classify_names",
]


def rename_as_lag(df: DataFrame, cols: Sequence[str], suffix: str = "_lag") -> DataFrame:
    """``x`` → ``x_lag`` (the value is already shifted upstream)."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in cols if c in df.columns})


def drop_existing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist (ordered, de-duplicated)."""
    seen, keep = set(), []
    for c in cols:
        if c in df.columns and c not in seen:
            seen.add(c)
            keep.append(c)
    return df.drop(*keep)


def drop_contaminated(df: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop columns named in a rules table (column, category, reason) and
    return (clean frame, report of the dropped columns with their reasons)."""
    present = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    report = present.join(rules, "column")
    names = [r["column"] for r in report.select("column").collect()]  # at most one row per column
    return df.drop(*names), report


def reorder(df: DataFrame, lead: Sequence[str]) -> DataFrame:
    """Leading key columns first, then the rest in their order."""
    lead = [c for c in lead if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def paginate(df: DataFrame, order: Sequence, limit: int, offset: int = 0) -> DataFrame:
    """Limit clamped to 1..1000, offset >= 0, over an explicit total order."""
    limit = max(1, min(1000, int(limit)))
    offset = max(0, int(offset))
    return df.orderBy(*order).offset(offset).limit(limit)


def detect_schema(df: DataFrame, plans: dict[str, Sequence[str]], default: str = "generic") -> str:
    """First plan whose marker columns are all present."""
    cols = set(df.columns)
    for name, markers in plans.items():
        if set(markers) <= cols:
            return name
    return default


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Top-k rows per group; ``order`` must end in a unique key."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def argmax_row(df: DataFrame, group: Sequence[str], key: Column) -> DataFrame:
    """The whole row with the largest ``key`` per group (ties via the key struct)."""
    cols = [c for c in df.columns if c not in group]
    best = df.groupBy(*group).agg(F.max_by(F.struct(*cols), key).alias("__b"))
    return best.select(*group, "__b.*")


def pick_examples(df: DataFrame, id_col: str, rules: Sequence[tuple[str, Column, Column, bool]], group: Sequence[str] = ()) -> DataFrame:
    """Each rule (name, predicate, key, descending) independently picks
    its best row of every group (highest / lowest key, smallest numeric id on ties), all rules in
    one aggregation; then a pick whose id was already picked by an earlier rule is dropped (priority order)."""
    group = list(group)
    row = F.struct(*[F.col(c) for c in df.columns if c not in group])
    best = [F.max_by(row, F.when(pred, F.struct(key, -F.col(id_col)))) if desc else F.min_by(row, F.when(pred, F.struct(key, F.col(id_col))))
            for _, pred, key, desc in rules]
    picked = df.groupBy(*group).agg(*[b.alias(f"__p{i}") for i, b in enumerate(best)])
    each = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("example"), F.lit(i).alias("pri"), F.col(f"__p{i}").alias("row"))
                               for i, r in enumerate(rules)]))
    picks = picked.select(*group, each.alias("__e")).where(F.col("__e.row").isNotNull())
    picks = picks.select(*group, F.col("__e.example").alias("example"), F.col("__e.pri").alias("__pri"), "__e.row.*")
    w = Window.partitionBy(*group, id_col).orderBy("__pri")  # at most len(rules) rows
    return picks.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__pri")


def ordered_distinct(df: DataFrame, col: str, order: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    return df.groupBy(col).agg(F.min(order).alias("first_seen")).orderBy("first_seen")


def union_aligned(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name with missing columns as NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def overlap_count(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of shared key values (train/test date overlap must be 0)."""
    return a.select(*cols).intersect(b.select(*cols)).agg(F.count(F.lit(1)).alias("overlap"))


def pivot_wide(df: DataFrame, keys: Sequence[str], pivot: str, values: Sequence, value: str) -> DataFrame:
    """Long → wide with an explicit value list (one pass, no distinct job)."""
    return df.groupBy(*keys).pivot(pivot, list(values)).agg(F.first(value))


def pivot_map(df: DataFrame, keys: Sequence[str], pivot: str, value: str, out: str = "values") -> DataFrame:
    """R01 nested variant: ``map(pivot → value)`` per key."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(pivot), F.col(value)))).alias(out))


def feature_pairs(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Per row, every unordered feature pair (f1 < f2 in list order) with
    both values present: (ids, f1, f2, x, y).  Fan-out is p(p-1)/2 per row."""
    pairs = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(a).cast("double").alias("x"),
                      F.col(b).cast("double").alias("y"))
             for i, a in enumerate(features) for b in features[i + 1:]]
    e = df.select(*ids, F.explode(F.array(*pairs)).alias("__p")).select(*ids, "__p.*")
    return e.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def date_regimes(date: str, regimes: Sequence[tuple[str, str, str]]) -> Column:
    """Regime name of a date from a list of half-open [start, end) ranges
    (a CASE expression; the list is a parameter, not data)."""
    e = None
    for name, lo, hi in regimes:
        cond = (F.col(date) >= F.lit(lo).cast("date")) & (F.col(date) < F.lit(hi).cast("date"))
        e = F.when(cond, F.lit(name)) if e is None else e.when(cond, F.lit(name))
    return e


def quantile_regimes(df: DataFrame, value: str, group: Sequence[str] = (), lo: float = 0.25, hi: float = 0.75,
                     fit_where: Column | None = None, out: str = "regime", exact: bool = True) -> DataFrame:
    """Low / medium / high by the q25 / q75 of ``value``.

    Grouped: one row of quantiles per group joined back on the group key.
    Ungrouped: the two quantiles are a scalar subquery (computed once and
    inlined as a value) — no join at all."""
    from tidewater.operators.quality import pct
    group = list(group)
    fit = df if fit_where is None else df.where(fit_where)
    if group:
        q = fit.groupBy(*group).agg(pct(value, [lo, hi], exact).alias("__q"))
        j = df.join(q, group)
        cuts = F.col("__q")
    else:
        j = df
        cuts = fit.agg(pct(value, [lo, hi], exact)).scalar()
    r = F.when(F.col(value).isNull(), None).when(F.col(value) <= cuts[0], "low") \
        .when(F.col(value) >= cuts[1], "high").otherwise("medium")
    j = j.withColumn(out, r)
    return j.drop("__q") if group else j


def release_checks(checks: Sequence[tuple[str, Column, Column]], source: DataFrame,
                   tol: float = 1e-12) -> DataFrame:
    """Evaluate (name, expected, actual) expressions over a one-row
    source; numeric values pass within ``tol``, others by equality."""
    cols = []
    for name, exp, act in checks:
        e, a = exp.cast("string"), act.cast("string")
        num_ok = F.abs(exp.try_cast("double") - act.try_cast("double")) <= F.lit(tol)
        ok = F.coalesce(num_ok, e == a, F.lit(False))
        cols.append(F.struct(F.lit(name).alias("check"), e.alias("expected"), a.alias("actual"), ok.alias("pass")))
    return source.select(F.explode(F.array(*cols)).alias("c")).select("c.*")


def mirror_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of rows that either side has and the other lacks, counting repeats (one row)."""
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("differ"))


def lookup_with_fallback(left: DataFrame, right: DataFrame, primary: dict[str, str], fallback: dict[str, str],
                         values: Sequence[str], matched_col: str = "matched_on") -> DataFrame:
    """Left join on the primary key mapping, else on the fallback mapping
    (two equi left joins + coalesce); ``matched_on`` tells which one hit."""
    def side(mapping, tag):
        cols = [F.col(rc).alias(f"__{tag}_k{i}") for i, rc in enumerate(mapping.values())]
        return right.select(*cols, *[F.col(v).alias(f"__{tag}_{v}") for v in values])

    p, f = side(primary, "p"), side(fallback, "f")
    cond_p = [F.col(lc) == F.col(f"__p_k{i}") for i, lc in enumerate(primary)]
    cond_f = [F.col(lc) == F.col(f"__f_k{i}") for i, lc in enumerate(fallback)]
    j = left.join(p, cond_p, "left").join(f, cond_f, "left")
    hit_p = F.col("__p_k0").isNotNull()
    hit_f = F.col("__f_k0").isNotNull()
    out = j.withColumns({v: F.when(hit_p, F.col(f"__p_{v}")).otherwise(F.col(f"__f_{v}")) for v in values})
    out = out.withColumn(matched_col, F.when(hit_p, "primary").when(hit_f, "fallback"))
    return out.select(*left.columns, *values, matched_col)


def replay(requests: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Exact replay of stored rows by id for a batch of requests, with a
    ``found`` flag instead of an error for unknown ids."""
    s = stored.withColumn("__hit", F.lit(1))
    return requests.join(s, key, "left").withColumn("found", F.coalesce(F.col("__hit"), F.lit(0))).drop("__hit")


def classify_names(df: DataFrame, name: str, rules: Sequence[tuple[str, str, str]], default: str,
                   out: str = "group") -> DataFrame:
    """Startswith / contains cascade over a name column → label.
    ``rules`` = (kind, pattern, label) with kind in {startswith, contains, endswith}."""
    e = None
    for kind, pat, lab in rules:
        c = getattr(F.col(name), kind)(pat)
        e = F.when(c, F.lit(lab)) if e is None else e.when(c, F.lit(lab))
    return df.withColumn(out, e.otherwise(F.lit(default)) if e is not None else F.lit(default))
