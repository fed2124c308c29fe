"""Vector column builders: hashed bag-of-words embedding, norms, cosine, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimension of the hashed embedding.
DIMENSION = 384


def tokens(text: Column) -> Column:
    """[P11] Lower-cased words between white space, Unicode's and the separators U+001C to U+001F."""
    return F.filter(F.split(F.lower(text), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")


def bucket(token: Column, dimension: int = DIMENSION) -> Column:
    """[P12] The token's MD5 as a 128-bit number modulo ``dimension``."""
    return folded_digest(F.md5(token), dimension)


def folded_digest(digest: Column, dimension: int) -> Column:
    """An MD5 in hex modulo ``dimension``, up to 48 bits at a time."""
    value, start = F.lit(0).cast("long"), 1
    for digits in (12, 10, 10):
        value = (value * (16**digits % dimension) + F.conv(F.substring(digest, start, digits), 16, 10).cast("long")) % dimension
        start += digits
    return value.cast("int")


def norm(vector: Column) -> Column:
    """[A14] Euclidean length."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """[O04] Cosine similarity; 0 if either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def _bound(value: Column, of) -> Column:
    """``of(value)``, the value computed once for a row."""
    return F.transform(F.array(value), of)[0]


def embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """[P13] Token counts by bucket over their length; the zero vector for an empty or null text.

    The sorted buckets of the tokens fall into runs: what lies between two runs is zeros, a run's length its count.
    """
    digests = F.transform(F.coalesce(tokens(text), F.array().cast("array<string>")), F.md5)
    hashed = F.array_sort(F.transform(digests, lambda d: folded_digest(d, dimension)))
    none = F.lit(0.0)

    def dense(s: Column, starts: Column, counts: Column, length: Column) -> Column:
        before = lambda k: F.when(k > 0, s[starts[F.greatest(k - 1, F.lit(0))]]).otherwise(-1)
        runs = F.transform(starts, lambda i, k: F.concat(F.array_repeat(none, s[i] - before(k) - 1), F.array(counts[k] / length)))
        return F.concat(F.flatten(runs), F.array_repeat(none, dimension - 1 - F.element_at(s, -1)))

    def of_runs(s: Column, starts: Column) -> Column:
        counts = F.transform(starts, lambda i, k: F.coalesce(F.get(starts, k + 1), F.size(s)) - i)
        return _bound(counts, lambda c: _bound(norm(c), lambda length: dense(s, starts, c, length)))

    def of_sorted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), lambda i: (i == 0) | (s[i] != s[F.greatest(i - 1, F.lit(0))]))
        return F.when(F.size(s) > 0, _bound(starts, lambda st: of_runs(s, st))).otherwise(F.array_repeat(none, dimension))

    return _bound(hashed, of_sorted)


def fitted(vector: Column, dimension: int) -> Column:
    """[P14] Cut or zero-padded to ``dimension``."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), dimension)), 1, dimension)
