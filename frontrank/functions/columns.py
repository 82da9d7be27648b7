"""Scalar and window expressions. All run inside the JVM; none needs a UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS_EXPRESSION, EPS_GRAPH, RHO = 1e-12, 1e-9, 1e-6
KS = (1, 3, 5, 10)


def no_nan(c: Column) -> Column:
    """NaN and infinities as null, which aggregates skip."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def lenient(c: Column | str) -> Column:
    """A number, or null if the text isn't one."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def symbol(c: Column | str) -> Column:
    """Trimmed upper-case symbol; null gives an empty string."""
    return F.coalesce(F.upper(F.trim(c)), F.lit(""))


def or_unknown(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("unknown"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def comb_ratio(a: Column, r: Column, n: Column) -> Column:
    """C(a, r) / C(n, r) as a product of small factors: 1 for r = 0, 0 for a < r."""
    product = F.aggregate(F.sequence(F.lit(0), r.cast("int") - 1), F.lit(1.0), lambda acc, i: acc * (a - i) / (n - i))
    return F.when(r <= 0, F.lit(1.0)).when(a < r, F.lit(0.0)).otherwise(product)


def tie_hash(seed: int, *keys: str) -> Column:
    """crc32 of seed and keys joined by a vertical bar, as zlib gives it."""
    return F.crc32(F.encode(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), "UTF-8"))


def md5_hash(seed: int, *keys: str) -> Column:
    """The same with md5, for engines without crc32."""
    return F.md5(F.encode(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), "UTF-8"))


def row_fingerprint(*columns: str, hashed: str = "crc32") -> Column:
    """crc32 (or md5) over the text of all columns, `<NA>` for null: a stable key for rows without an id."""
    text = F.encode(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in columns]), "UTF-8")
    return F.md5(text) if hashed == "md5" else F.crc32(text)


def split_key(seed: int, value: Column) -> Column:
    """First 16 hex digits of SHA-256 of seed:value; sorts as the number does."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256), 1, 16)


def average_rank(over: Sequence[str], by: Column, ties: Sequence[Column | str]) -> Column:
    """Rank with ties sharing their mean. by: the sort order; ties: the columns equal for tied rows."""
    tied = F.count(F.lit(1)).over(Window.partitionBy(*over, *ties))
    return F.rank().over(Window.partitionBy(*over).orderBy(by)) + (tied - 1) / 2.0


def exact_mean(c: Column | str, unit: float = 1e9) -> Column:
    """Mean of values taken as whole multiples of 1 / unit: the sum is exact, so the order of addition can't show."""
    c = F.col(c) if isinstance(c, str) else c
    whole = F.sum(F.floor(c * unit + 0.5).cast("decimal(20,0)")).cast("double")
    return F.try_divide(whole, unit * F.count(c))


def half_up(c: Column | str, digits: int) -> Column:
    """Rounded by plain multiplication, so that engines agree on halves too."""
    scale = 10.0**digits
    return F.floor((F.col(c) if isinstance(c, str) else c) * scale + 0.5) / scale


def pearson(x: Column, y: Column) -> Column:
    """Population correlation over a group; null where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def quantized(y: Column) -> Column:
    """Integer gains 0 to 255 from labels in 0 to 1."""
    return F.floor(clamp(y, 0.0, 1.0) * 255).cast("int")


def direction(metric: Column) -> Column:
    """-1 where smaller is better (regret), else 1."""
    return F.when(metric.startswith("Regret@"), -1).otherwise(1)


def metric_k(metric: Column) -> Column:
    return F.split_part(metric, F.lit("@"), F.lit(2)).try_cast("int")


def metric_family(metric: Column) -> Column:
    return F.regexp_extract(metric, r"^(.*?)(?:@|$)", 1)


def p_class(p: Column) -> Column:
    """How a method compares with the winner, which has no p."""
    return F.when(p.isNull(), "winner").when(p < 0.05, "significant").otherwise("not_significant")


def p_label(p: Column) -> Column:
    return F.when(p.isNull(), "winner").when(p < 0.001, "p<0.001").otherwise(F.format_string("p=%.3f", p))


def bias_corrected_skew(c: Column, n: Column) -> Column:
    """Sample skewness G1 from the population value; 0 without variance."""
    g = F.skewness(c)
    return F.when(n < 3, None).otherwise(F.coalesce(g * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0)), F.lit(0.0)))


def bias_corrected_kurtosis(c: Column, n: Column) -> Column:
    """Sample excess kurtosis G2 from the population value; 0 without variance."""
    g = F.kurtosis(c)
    scale = F.try_divide(n - 1.0, (n - 2.0) * (n - 3.0))
    return F.when(n < 4, None).otherwise(F.coalesce(scale * ((n + 1.0) * g + 6.0), F.lit(0.0)))
