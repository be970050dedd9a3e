"""Scalar column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: machine epsilon of a double, the clip of probabilities in log loss.
EPS = 2.220446049250313e-16


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def symlog(x) -> Column:
    x = _c(x)
    return F.signum(x) * F.log1p(F.abs(x))


def symexp(x) -> Column:
    x = _c(x)
    return F.signum(x) * F.expm1(F.abs(x))


def clip(x, lo: float, hi: float) -> Column:
    x = _c(x)
    # least and greatest skip NULL, so a missing value needs its own branch
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def sigmoid(x) -> Column:
    """Logistic function; one exponential of a non-positive number, so it never overflows."""
    x = _c(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def softmax(logits) -> Column:
    logits = _c(logits)
    top = F.array_max(logits)
    parts = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(parts, lambda v: v / total)


def argmax(values) -> Column:
    """0-based position of the first maximum of an array."""
    values = _c(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def log_odds(p0, p1) -> Column:
    return F.log(_c(p1)) - F.log(_c(p0))


def nan_to_null(x) -> Column:
    x = _c(x)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def zero_safe_round(x, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero."""
    return F.round(_c(x), digits) + F.lit(0.0)


def linear_projection(x, from_range, to_range) -> Column:
    """Map one interval onto another linearly."""
    (a, b), (c, d) = from_range, to_range
    w = (d - c) / (b - a)
    return _c(x) * F.lit(float(w)) + F.lit(float(c - w * a))


def shorten(x, max_size: int = 30) -> Column:
    """Keep head and tail of a label and put dots between them."""
    x = _c(x)
    left = max_size // 2
    right = max_size - left - 3
    cut = F.concat(F.substring(x, 1, left), F.lit("..."), F.right(x, F.lit(right)))
    return F.when(F.length(x) < max_size, x).otherwise(cut)


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell-style glob."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1:close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def glob_match(name, patterns) -> Column:
    """True when a name matches any glob, or equals it (names may hold brackets)."""
    name = _c(name)
    patterns = [patterns] if isinstance(patterns, (str, int)) else list(patterns)
    hit = F.lit(False)
    for p in map(str, patterns):
        hit = hit | name.rlike(glob_regex(p)) | (name == F.lit(p))
    return hit


def valid_name(name, allow_slash: bool = False, allow_single_star: bool = False) -> Column:
    """Can the name be one path component (or, with a slash allowed, a path)?"""
    name = _c(name)
    bad = name.isin(".", "..") | name.rlike(r'[?\\:<>|"]') | name.contains("**")
    if not allow_slash:
        bad = bad | name.contains("/")
    if not allow_single_star:
        bad = bad | name.contains("*")
    return ~bad
