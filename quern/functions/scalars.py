"""Scalar expressions: bands, folds of names, intervals, distances, small numerics."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_mean(cols: list[Column]) -> Column:
    """Mean of what is present; missing are NULL, '' and NA. NULL if nothing is."""
    numbers = F.filter(F.array(*[F.when(~F.upper(F.trim(c.cast("string"))).isin("", "NA"), c.cast("string")).try_cast("double") for c in cols]), lambda x: x.isNotNull())
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(numbers), F.lit(0)))


def failures(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail; a NULL check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))


def width_bin(x: Column, edges: list[float], right: bool = False) -> Column:
    """Number of the bin among sorted edges: left-closed, or right-closed."""
    return sum(((x > e) if right else (x >= e)).cast("int") for e in edges) + F.lit(0)


def degree_bin(n: Column, top: int = 6) -> Column:
    return F.least(F.lit(top), F.floor(F.log2(n)).cast("int"))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def empirical_logit(hits: Column, n: Column) -> Column:
    return F.log((hits + 0.5) / (n + 0.5))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def binomial(x: Column) -> Column:
    """The name if it has exactly two words of letters, else NULL."""
    c = collapse(x)
    return F.when(c.rlike(r"^[A-Za-z-]+ [a-z-]+$"), c)


def folded(x: Column) -> Column:
    """Upper case without accents and without anything but letters and digits."""
    plain = F.translate(x, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")
    return F.upper(F.regexp_replace(plain, "[^A-Za-z0-9]", ""))


def iso_date(x: Column, year: Column) -> Column:
    """The date if the text is a strict ISO day of that year, else NULL."""
    day = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))
    return F.when(F.year(day) == year, day)


def year_interval(x: Column) -> Column:
    """struct(lower, upper) of a year, a range of years or a decade; NULLs for anything else."""
    at = lambda pattern, g: F.regexp_extract(x, pattern, g)
    exact, span, decade = r"^(\d{4})$", r"^(\d{4})-(\d{4})$", r"^(\d{3})\d?s$"
    low = F.when(x.rlike(exact), at(exact, 1)).when(x.rlike(span), at(span, 1)).when(x.rlike(decade), F.concat(at(decade, 1), F.lit("0"))).cast("int")
    high = F.when(x.rlike(exact), at(exact, 1)).when(x.rlike(span), at(span, 2)).when(x.rlike(decade), F.concat(at(decade, 1), F.lit("9"))).cast("int")
    return F.struct(low.alias("lower"), high.alias("upper"))


def blob_sha1(x: Column) -> Column:
    """SHA-1 of the text as a git blob."""
    return F.sha1(F.concat(F.lit("blob "), F.octet_length(x).cast("string"), F.lit("\0"), x).cast("binary"))


def list_digest(items: Column) -> Column:
    return F.sha2(F.concat(F.array_join(items, "\n"), F.lit("\n")), 256)


def keep_probability(n: Column, q: Column) -> Column:
    """Chance that at least one of n records survives when each is kept with chance q."""
    return -F.expm1(n * F.log1p(-q))


def normal_cdf(z: Column) -> Column:
    """By the rational approximation of the complementary error function with an error below 1.2e-7."""
    t = 1 / (1 + 0.5 * F.abs(z) / F.sqrt(F.lit(2.0)))
    series = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]  # fixed values of the approximation
    poly = F.lit(series[-1])
    for c in reversed(series[:-1]):
        poly = poly * t + c
    tail = t * F.exp(-z * z / 2 + poly)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)


def fisher_interval(r: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    half = z / F.sqrt(n - 3)
    return F.tanh(F.atanh(r) - half), F.tanh(F.atanh(r) + half)


def log_binomial(n: Column, k: Column) -> Column:
    """Natural logarithm of n over k, as a sum of min(k, n - k) terms; NULL unless 0 <= k <= n.

    A row costs its terms: for counts of groups, not for millions.
    """
    few = F.least(k, n - k)
    terms = F.transform(F.when(few > 0, F.sequence(F.lit(1).cast("long"), few)).otherwise(F.array().cast("array<bigint>")), lambda i: F.log((n - i + 1) / i))
    return F.when((k >= 0) & (k <= n), F.aggregate(terms, F.lit(0.0), lambda total, x: total + x))


def redacted(x: Column) -> Column:
    """Mail addresses, IPv4 addresses and long digit runs replaced by their kind."""
    for pattern, name in ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<mail>"), (r"\b\d{1,3}(\.\d{1,3}){3}\b", "<address>"), (r"\b\d{12,19}\b", "<number>")):
        x = F.regexp_replace(x, pattern, name)
    return x


def equal_area_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area coordinates in km on the sphere, true at 30 degrees."""
    k = F.cos(F.radians(F.lit(30.0)))
    return 6371.0088 * F.radians(lon) * k, 6371.0088 * F.sin(F.radians(lat)) / k


def equal_area_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    k = F.cos(F.radians(F.lit(30.0)))
    return F.degrees(F.asin(y * k / 6371.0088)), F.degrees(x / k / 6371.0088)


def rms_mismatch(value: Column, centre: Column, spread: Column) -> Column:
    """Root mean square of the standard scores over axes whose spread is positive; arrays of equal length."""
    z = F.filter(F.zip_with(F.zip_with(value, centre, lambda v, c: v - c), spread, lambda d, s: F.when(s > 0, d / F.when(s > 0, s))), lambda x: x.isNotNull())
    return F.when(F.size(z) > 0, F.sqrt(F.aggregate(z, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(F.size(z), F.lit(0))))


def lcg32(seed: Column, steps: int) -> Column:
    """State of the linear congruential generator 1664525 x + 1013904223 modulo 2 ** 32 after ``steps``."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), seed.cast("long"), lambda a, _: (a * 1664525 + 1013904223) % (1 << 32))


def xorshift32(seed: Column, steps: int) -> Column:
    mask = F.lit((1 << 32) - 1)

    def step(a: Column, _: Column) -> Column:
        a = a.bitwiseXOR(F.shiftleft(a, 13).bitwiseAND(mask))
        a = a.bitwiseXOR(F.shiftright(a, 17))
        return a.bitwiseXOR(F.shiftleft(a, 5).bitwiseAND(mask))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), seed.cast("long"), step)
