"""Row and group filters, column aliases, and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectide.operators.quantiles import exact_quantiles

#: labels that mark a control (fixed pattern)
CONTROL = r"(?i)non.?target|^ntc$|control|safe.?harbor|scramble|negative"
#: labels that carry no mechanism (fixed values)
UNUSABLE = ("unclear", "none", "")
#: names under which a field may appear, the first that is there counts, matched in any case (fixed values)
ALIASES = {
    "umi": ("UMI_count", "total_counts", "n_counts", "num_umis"),
    "mito": ("mitopercent", "percent_mito", "pct_counts_mt", "mito_frac"),
    "gene": ("gene", "gene_target", "target_gene", "target"),
    "guide": ("sgID_AB", "guide_identity", "sgID", "sgRNA", "protospacer"),
    "gem": ("gem_group", "gemgroup", "batch", "lane"),
}
REQUIRED = ("umi", "mito", "gene")


def drop_special_tokens(df: DataFrame, token: str = "gene", least: int = 3) -> DataFrame:
    return df.where(F.col(token) >= least)


def drop_special_in_arrays(df: DataFrame, genes: str, values: str, least: int = 3) -> DataFrame:
    """The same on list columns, without exploding them."""
    kept = F.filter(F.arrays_zip(genes, values), lambda p: p[genes] >= least)
    return df.withColumns({genes: F.transform(kept, lambda p: p[genes]), values: F.transform(kept, lambda p: p[values])})


def pass_filter(df: DataFrame, flag: Column) -> DataFrame:
    return df.where(flag)


def low_depth_filter(df: DataFrame, umi: str, share: float) -> DataFrame:
    """Rows with at least a share of the exact median depth over all rows."""
    (median,) = exact_quantiles(df, umi, [0.5])
    return df.where(F.col(umi) >= F.lit(median).cast("double") * share)


def high_mito_filter(df: DataFrame, umi: str, mito: str, most: float) -> DataFrame:
    """Rows whose mitochondrial count is at most ``most``; percents are told from shares by their maximum."""
    top = df.agg(F.max(F.when(~F.isnan(F.col(mito).cast("double")), F.col(mito))).alias("__top"))
    share = F.when(F.col("__top") > 1.5, F.col(mito) / 100.0).otherwise(F.col(mito))
    return df.crossJoin(F.broadcast(top)).where(share * F.col(umi) <= most).drop("__top")


def guide_targets(guide: str) -> Column:
    """The distinct targets that a guide string names; blanks and 'nan' count as none."""
    parts = F.split(F.coalesce(F.col(guide), F.lit("")), r"[|;]")
    targets = F.transform(parts, lambda p: F.trim(F.regexp_extract(p, r"^([^_|]*)", 1)))
    return F.array_distinct(F.filter(targets, lambda t: (t != "") & (F.lower(t) != "nan")))


def guide_concordance_filter(df: DataFrame, guide: str | None) -> DataFrame:
    """Rows whose guides name at most one target; without a guide column every row stays."""
    if guide is None or guide not in df.columns:
        return df
    return df.where(F.size(guide_targets(guide)) <= 1)


def resolve_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Rename fields to their standard names; a missing required field is an error."""
    have = {c.lower(): c for c in reversed(df.columns)} | {c: c for c in df.columns}
    picked = {}
    for name, others in (aliases or ALIASES).items():
        found = next((have[o] for other in (*others, name) for o in (other, other.lower()) if o in have), None)
        if found is not None:
            picked[name] = found
        elif name in required:
            raise ValueError(f"no column for {name}")
    rest = [c for c in df.columns if c not in picked.values()]
    return df.select(*[F.col(c).alias(name) for name, c in picked.items()], *rest)


def qc_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The share of rows that each rule keeps, and that all keep together."""
    both = None
    for rule in rules.values():
        both = rule if both is None else both & rule
    return df.agg(*[F.avg(r.cast("double")).alias(n) for n, r in rules.items()], F.avg(both.cast("double")).alias("all_rules"), F.count("*").alias("n"))


def min_rows_filter(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows of groups with at least so many rows."""
    big = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    return df.join(big, keys, "left_semi")


def scored_condition_filter(m: DataFrame, label: str, control: str, least: int = 25) -> DataFrame:
    """Groups to score: all but the control itself, with enough rows. Labels like the control's stay."""
    return m.where((F.col(label) != control) & (F.col("n") >= least))


def detect_control_label(m: DataFrame, label: str, pattern: str = CONTROL) -> str:
    """The largest group whose label looks like a control's; an error if there is none."""
    found = m.where(F.col(label).rlike(pattern)).groupBy(label).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), label).limit(1).collect()
    if not found:
        raise ValueError("no label looks like a control")
    return found[0][label]


def usable_label(label: str) -> Column:
    return F.col(label).isNotNull() & ~F.lower(F.trim(F.col(label))).isin(*UNUSABLE)


def contiguous_ids(df: DataFrame, key: str) -> DataFrame:
    """A row if the ids are not 0 .. n - 1, each once."""
    s = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"), F.min(key).alias("low"), F.max(key).alias("high"))
    return s.where((F.col("n") > 0) & ((F.col("n") != F.col("ids")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1))).select(F.lit("ids are not contiguous").alias("rule"), F.col("n").cast("double").alias("value"))


def counts_agree(rows: DataFrame, table: DataFrame, keys: list[str], count: str = "n_t") -> DataFrame:
    """Groups whose number of rows is not the one on record."""
    have = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    bad = table.join(have, keys, "left").where(F.coalesce("__n", F.lit(0)) != F.col(count))
    return bad.select(F.lit("row count differs").alias("rule"), F.coalesce("__n", F.lit(0)).cast("double").alias("value"))


def shares_sum(df: DataFrame, columns: list[str], total: float = 100.0, slack: float = 0.2) -> DataFrame:
    """Rows whose shares do not add up."""
    value = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return df.where(F.abs(value - total) > slack).select(F.lit("shares do not add up").alias("rule"), value.alias("value"))


def first_seen(df: DataFrame, keys: list[str], attribute: str, order: str) -> DataFrame:
    """The first non-null attribute of each key in a stated order."""
    return df.where(F.col(attribute).isNotNull()).groupBy(*keys).agg(F.min_by(attribute, order).alias(attribute))


def first_per_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each id: the first in a stated order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")
