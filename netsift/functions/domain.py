"""Domain-name column functions (P4, F1-F8, M6, M7, suffix explode for J1).

Everything is a built-in expression or a higher-order function
(``aggregate`` / ``transform`` over ``sequence``), so the 15 features and the
rule score are computed inside whole-stage codegen without Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
# F8: common TLDs used by the feature vector at scoring time (29 entries).
COMMON_TLDS = [
    "com", "cn", "net", "org", "de", "uk", "fr", "jp", "ru", "br",
    "it", "au", "in", "io", "dev", "app", "ai", "co", "me", "edu",
    "gov", "mil", "info", "biz", "name", "pro", "cc", "tv", "ws",
]
# M7: TLDs that add 0.4 to the rule score (14 entries).
SUSPICIOUS_TLDS = ["tk", "ml", "ga", "cf", "gq", "xyz", "top", "buzz",
                   "club", "site", "online", "space", "work", "loan"]
# dotted-quad pattern.
DOTTED_QUAD = r"^\d{1,3}(\.\d{1,3}){3}$"
# M6: feature order of the vector.
FEATURE_NAMES = [
    "domain_length", "sld_length", "tld_length", "subdomain_count",
    "tld_is_common", "sld_entropy", "digit_ratio", "alpha_ratio",
    "hyphen_count", "has_digit", "max_consecutive", "special_char_ratio",
    "transition_ratio", "vowel_ratio", "is_ip",
]
# M7 thresholds: rule score in tenths, entropy limit, suspicious at >= 5 tenths.
RULE_ENTROPY = 3.5
RULE_SUSPICIOUS_TENTHS = 5
# ------------------------------------------------------------------------------

DIGIT = r"\p{Nd}"
ALPHA = r"\p{L}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c) -> Column:
    """Lower-case and strip trailing dots (``lower().rstrip('.')``)."""
    return F.regexp_replace(F.lower(_col(c)), r"\.+$", "")


def normalize_full(c) -> Column:
    """Feature-side normalisation: lower, strip whitespace, strip trailing dots."""
    s = F.regexp_replace(F.lower(_col(c)), r"^\s+|\s+$", "")
    return F.regexp_replace(s, r"\.+$", "")


def labels(c) -> Column:
    return F.split(_col(c), r"\.", -1)


def sld_of(c) -> Column:
    """second-last label, or the only label."""
    p = labels(c)
    return F.when(F.size(p) >= 2, F.element_at(p, -2)).otherwise(F.element_at(p, 1))


def sld_strict(c) -> Column:
    """Second-last label, or '' when the name has a single label."""
    p = labels(c)
    return F.when(F.size(p) >= 2, F.element_at(p, -2)).otherwise(F.lit(""))


def tld_of(c) -> Column:
    return F.element_at(labels(c), -1)


def subdomain_count(c) -> Column:
    return F.greatest(F.size(labels(c)) - 2, F.lit(0))


def char_count(c, pattern: str) -> Column:
    """Number of characters of ``c`` matching the one-character class ``pattern``."""
    c = _col(c)
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def entropy(c) -> Column:
    """Shannon entropy (base 2) of the character distribution; 0 for ''."""
    c = _col(c)
    n = F.length(c)
    chars = F.array_distinct(F.split(c, ""))

    def term(acc, ch):
        cnt = n - F.length(F.replace(c, ch, F.lit("")))
        p = cnt / n
        return acc - p * F.log2(p)

    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), term)).otherwise(F.lit(0.0))


def max_run(c) -> Column:
    """longest run of one repeated character (at least 1)."""
    c = _col(c)
    n = F.length(c)

    def merge(acc, i):
        cur = F.when(c.substr(i, F.lit(1)) == c.substr(i - 1, F.lit(1)), acc["cur"] + 1).otherwise(F.lit(1))
        return F.struct(cur.alias("cur"), F.greatest(acc["best"], cur).alias("best"))

    init = F.struct(F.lit(1).alias("cur"), F.lit(1).alias("best"))
    run = F.aggregate(F.sequence(F.lit(2), n), init, merge, lambda acc: acc["best"])
    return F.when(n >= 2, run).otherwise(F.lit(1))


def transitions(c) -> Column:
    """F6 numerator: letter→digit and digit→letter transitions."""
    c = _col(c)
    n = F.length(c)

    def merge(acc, i):
        a = c.substr(i - 1, F.lit(1))
        b = c.substr(i, F.lit(1))
        t = (b.rlike(DIGIT) & a.rlike(ALPHA)) | (b.rlike(ALPHA) & a.rlike(DIGIT))
        return acc + F.when(t, 1).otherwise(0)

    return F.when(n >= 2, F.aggregate(F.sequence(F.lit(2), n), F.lit(0), merge)).otherwise(F.lit(0))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def features(c) -> Column:
    """M6: the 15-feature struct of a domain name (F1-F8), in FEATURE_NAMES order."""
    d = normalize_full(c)
    sld = sld_of(d)
    tld = tld_of(d)
    n_sld = F.length(sld)
    digits = char_count(sld, DIGIT)
    alphas = char_count(sld, ALPHA)
    special = char_count(d, r"[^\p{L}\p{Nd}.\-]")
    vowels = char_count(F.lower(sld), "[aeiou]")
    return F.struct(
        F.length(d).alias("domain_length"),
        n_sld.alias("sld_length"),
        F.length(tld).alias("tld_length"),
        subdomain_count(d).alias("subdomain_count"),
        F.when(tld.isin(*COMMON_TLDS), 1).otherwise(0).alias("tld_is_common"),
        entropy(sld).alias("sld_entropy"),
        _ratio(digits, n_sld).alias("digit_ratio"),
        _ratio(alphas, n_sld).alias("alpha_ratio"),
        char_count(sld, "-").alias("hyphen_count"),
        F.when(digits > 0, 1).otherwise(0).alias("has_digit"),
        max_run(sld).alias("max_consecutive"),
        _ratio(special, F.length(d)).alias("special_char_ratio"),
        _ratio(transitions(sld), n_sld).alias("transition_ratio"),
        _ratio(vowels, n_sld).alias("vowel_ratio"),
        F.when(d.rlike(DOTTED_QUAD), 1).otherwise(0).alias("is_ip"),
    )


def rule_tenths(c) -> Column:
    """M7 rule score in integer tenths (exact, no float ties)."""
    d = normalize_full(c)
    sld = sld_of(d)
    n = F.length(sld)
    return (F.when(tld_of(d).isin(*SUSPICIOUS_TLDS), 4).otherwise(0)
            + F.when(n > 25, 3).otherwise(0)
            + F.when((n > 10) & (entropy(sld) > RULE_ENTROPY), 3).otherwise(0)
            + F.when(char_count(sld, "-") > 2, 2).otherwise(0))


def rule_score(c) -> Column:
    """M7: min(score, 1.0) as DOUBLE."""
    return F.least(rule_tenths(c).cast("double") / 10.0, F.lit(1.0))


def rule_suspicious(c) -> Column:
    return rule_tenths(c) >= RULE_SUSPICIOUS_TENTHS


def suffixes(c) -> Column:
    """All label suffixes of a name: 'a.b.c' → ['a.b.c', 'b.c', 'c'].

    ``x == t or x.endswith('.' + t)`` holds exactly when ``t`` is one of these,
    which turns a suffix match into an equi-join.
    """
    p = labels(c)
    return F.transform(F.sequence(F.lit(1), F.size(p)),
                       lambda i: F.array_join(F.slice(p, i, F.size(p) - i + 1), "."))


def proper_suffixes(c) -> Column:
    """Suffixes after the first label only (``x.endswith('.' + t)``)."""
    p = labels(c)
    return F.when(F.size(p) >= 2, F.transform(
        F.sequence(F.lit(2), F.size(p)),
        lambda i: F.array_join(F.slice(p, i, F.size(p) - i + 1), "."))).otherwise(F.array())
