"""Measures of names and texts, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiou"


# The characters that count as white space, as a class of a regular expression.
SPACE = "\\t-\\r\\x1c- \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def stripped(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, f"^[{SPACE}]+|[{SPACE}]+$", "")


def characters(s: Column) -> Column:
    """The characters of a string; none of an empty one."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def entropy_of(items: Column) -> Column:
    """Shannon entropy, in bits, of an array's values; 0 for an empty array."""
    n = F.size(items).cast("double")
    counts = F.transform(F.array_distinct(items), lambda x: F.size(F.filter(items, lambda y: y == x)).cast("double"))
    total = F.aggregate(F.transform(counts, lambda c: -(c / n) * F.log2(c / n)), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, total).when(items.isNotNull(), F.lit(0.0))


def entropy(s: Column) -> Column:
    return entropy_of(characters(s))


def labels(domain: Column) -> Column:
    """Dot-separated labels after trailing dots are gone."""
    return F.split(F.regexp_replace(domain, r"\.+$", ""), r"\.")


def label_count(domain: Column) -> Column:
    return F.size(labels(domain))


def subdomain_entropy(domain: Column) -> Column:
    """Entropy of all labels but the last two, joined by dots; 0 where there are none."""
    parts = labels(domain)
    return F.when(F.size(parts) > 2, entropy(F.array_join(F.slice(parts, 1, F.size(parts) - 2), "."))).when(domain.isNotNull(), F.lit(0.0))


def normal_domain(s: Column) -> Column:
    """Trimmed, lower case, without trailing dots; null if empty, with white space, a slash or an empty label."""
    d = F.regexp_replace(F.lower(stripped(s)), r"\.+$", "")
    return F.when((d != "") & ~d.rlike(f"[{SPACE}/]") & ~d.rlike(r"(^|\.)\.") & ~d.rlike(r"^\."), d)


def domain_body(d: Column) -> Column:
    """All labels but the last, joined; a single label is its own body."""
    parts = F.split(d, r"\.")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "")).otherwise(d)


def longest_run(s: Column, char_class: str) -> Column:
    """The longest stretch of characters of a regular-expression class."""
    runs = F.regexp_extract_all(s, F.lit(f"([{char_class}]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.char_length(r))), F.lit(0))


def matches(s: Column, char_class: str) -> Column:
    """How many characters are of a class."""
    return F.char_length(F.regexp_replace(s, f"[^{char_class}]", ""))


def ratio(n: Column, d: Column) -> Column:
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def lexical_features(domain: Column) -> dict[str, Column]:
    """The nineteen measures of a normal domain name, in their fixed order; character measures are of its body."""
    body = domain_body(domain)
    parts = F.split(domain, r"\.")
    sizes = F.transform(parts, lambda x: F.char_length(x))
    n, letters, digits, vowels = F.char_length(body), matches(body, "\\p{L}"), matches(body, "\\p{Nd}"), matches(body, VOWELS)
    tld = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")
    hyphens, unique = matches(body, "\\-"), F.size(F.array_distinct(characters(body)))
    return {
        "length": F.char_length(domain),
        "body_length": n,
        "tld_length": F.char_length(tld),
        "label_count": F.size(parts),
        "max_label_length": F.array_max(sizes),
        "mean_label_length": F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / F.size(sizes),
        "digit_count": digits,
        "digit_ratio": ratio(digits, n),
        "alpha_ratio": ratio(letters, n),
        "vowel_ratio": ratio(vowels, n),
        "consonant_ratio": ratio(letters - vowels, n),
        "hyphen_count": hyphens,
        "hyphen_ratio": ratio(hyphens, n),
        "unique_char_count": unique,
        "unique_char_ratio": ratio(unique, n),
        "entropy": entropy(body),
        "longest_digit_run": longest_run(body, "\\p{Nd}"),
        "longest_alpha_run": longest_run(body, "\\p{L}"),
        "longest_consonant_run": longest_run(body, f"\\p{{L}}&&[^{VOWELS}]"),
    }


def humanise(key: Column) -> Column:
    """Underscores to spaces, the first letter a capital."""
    words = F.replace(key, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, 1_000_000)))


def character_heat(name: Column) -> Column:
    """How unlikely each character is by its kind alone: digits, vowels and separators have one value each, others rise with
    the length of the run that they stand in, up to 1."""
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<double>").alias("heat"))

    def step(state: Column, c: Column) -> Column:
        other = ~c.isin(".", "-") & ~c.rlike(r"^\p{Nd}$") & ~c.isin(*VOWELS)
        run = F.when(other, state["run"] + 1).otherwise(0)
        heat = F.when(c.isin(".", "-"), 0.0).when(c.rlike(r"^\p{Nd}$"), 0.85).when(c.isin(*VOWELS), 0.15).otherwise(F.least(0.35 + 0.2 * run, F.lit(1.0)))
        return F.struct(run.alias("run"), F.concat(state["heat"], F.array(heat)).alias("heat"))

    return F.aggregate(characters(F.lower(name)), start, step)["heat"]


def shown_number(x: Column) -> Column:
    """A number as it is shown: whole ones without a fraction, others with four significant digits, none for no number."""
    x = x.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    size = F.floor(F.log10(F.abs(F.nullif(x, F.lit(0.0))))).cast("int")
    digits = F.format_string("%.3e", x)
    exponent = F.regexp_extract(digits, r"e([+-]\d+)$", 1).cast("int")
    rounded = F.element_at(F.array(*(F.round(x, n).cast("decimal(38,12)").cast("string") for n in range(0, 9))), F.least(F.greatest(3 - size, F.lit(0)), F.lit(8)) + 1)
    short = F.regexp_replace(F.regexp_replace(rounded, r"0+$", ""), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(digits, r"^([^e]+)e", 1), r"0+$", ""), r"\.$", "")
    scientific = F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    shown = F.when(whole, F.format_string("%.0f", x)).when((exponent < -4) | (exponent >= 4), scientific).otherwise(short)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "not reported").otherwise(shown)


def shown_list(values: Column, most: int = 5) -> Column:
    """Texts with commas between them, cut after ``most`` with the number of those left out."""
    n = F.size(values)
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), F.when(n > most, F.concat(F.lit(" (+"), (n - most).cast("string"), F.lit(" more)"))).otherwise(""))


def unsupported_numbers(said: Column, facts: Column) -> Column:
    """Numbers in a text that the facts' text doesn't hold, in order; whole numbers up to ten are let pass."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    known = numbers(facts)
    small = lambda t: (t.cast("double") <= 10) & (t.cast("double") == F.floor(t.cast("double")))
    return F.filter(numbers(said), lambda t: ~F.array_contains(known, t) & ~small(t))


def three_decimals(x: Column) -> Column:
    """A number with three decimals, rounded from its exact binary value as C and Python do.

    Spark's formatter rounds the shortest decimal text of a number instead.  From 2^30 to 2^31, where times of our years
    lie, a number has 22 binary places, so its exact value is a long over 2^22.
    """
    thousandths = (x * (1 << 22)).cast("long") * 1000
    rest = F.pmod(thousandths, F.lit(1 << 22))
    whole = F.shiftright(thousandths, 22)
    up = (rest > 1 << 21) | ((rest == 1 << 21) & (whole % 2 == 1))
    n = whole + up.cast("long")
    exact = F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    return F.when(x.between(1 << 30, (1 << 31) - 1), exact).otherwise(F.format_string("%.3f", x))
