"""Sequences as rows: projection to an alphabet, ambiguity codes, k-mers, contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DNA = "acgt"
#: IUPAC nucleotide codes and their members (fixed values).
IUPAC = {"u": "t", "r": "ag", "y": "ct", "k": "gt", "m": "ac", "s": "cg", "w": "at", "b": "cgt", "d": "agt", "h": "act", "v": "acg", "n": "acgt"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def project(df: DataFrame, text: str = "text", alphabet: str = DNA, name: str = "seq") -> DataFrame:
    """``df`` with the lower-cased letters of ``alphabet`` that a text has, in order."""
    return df.withColumn(name, F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{alphabet}]+", ""))


def validate(df: DataFrame, seq: str = "seq", alphabet: str = DNA, mode: str = "error") -> DataFrame:
    """Rows whose symbols all belong to the alphabet; others raise (mode "error") or are left out (mode "drop")."""
    bad = F.col(seq).rlike(f"[^{alphabet}]")
    if mode == "drop":
        return df.filter(~bad)
    return df.withColumn(seq, F.when(bad, F.raise_error(F.concat(F.lit("symbol outside the alphabet: "), F.col(seq)))).otherwise(F.col(seq)))


def letters_only(c: Column) -> Column:
    """A text without white space and digits."""
    return F.regexp_replace(c, r"[\s0-9]", "")


def trim_region(seq: Column, first: Column, last: Column, around: int = 0, strand: Column | None = None) -> Column:
    """The places ``first`` to ``last`` (from 1, both included) with up to ``around`` more on either side; a strand below 0 gives the reverse complement."""
    begin, end = F.greatest(F.lit(1), first - around), F.least(F.char_length(seq), last + around)
    region = F.substring(seq, begin, F.greatest(F.lit(0), end - begin + 1))
    return region if strand is None else F.when(strand < 0, reverse_complement(region)).otherwise(region)


def mark_bounds(seq: Column, first: Column, last: Column, mark: str = "###") -> Column:
    """The sequence with ``mark`` before the place ``first`` and after the place ``last``."""
    after = F.greatest(first, last + 1)
    return F.concat(F.substring(seq, F.lit(1), first - 1), F.lit(mark), F.substring(seq, first, after - first), F.lit(mark), F.substring(seq, after, F.char_length(seq)))


def reverse_complement(c: Column) -> Column:
    """Unknown symbols stay as they are."""
    return F.reverse(F.translate(c, "acgtACGT", "tgcaTGCA"))


def symbols(seq: Column) -> Column:
    return F.array_remove(F.split(seq, ""), "")


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order, as an array. A text of one byte a character is cut by bytes, any other by its characters, indexed once: either
    way long sequences cost no more than their length."""

    def bytewise(b: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.octet_length(seq) - (k - 1)), lambda i: F.substring(b, i, F.lit(k)).cast("string"))

    def grams(c: Column) -> Column:
        heads = F.slice(c, 1, F.greatest(F.size(c) - (k - 1), F.lit(0)))
        return F.transform(heads, lambda x, i: F.concat(x, *[F.get(c, i + j) for j in range(1, k)])) if k > 1 else c

    few = F.char_length(seq) < k
    plain = F.char_length(seq) == F.octet_length(seq)
    return F.when(few, F.array().cast("array<string>")).when(plain, let(F.encode(seq, "UTF-8"), bytewise)).otherwise(let(symbols(seq), grams))


def run_starts(sorted_: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """Where runs of equal elements (equal under ``of``) begin in a sorted array, and its size as the last: an array of places from 0."""

    def starts(g: Column) -> Column:
        n = F.size(g)
        inner = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: (i == 0) | (of(F.get(g, i)) != of(F.get(g, i - 1))))
        return F.when(n > 0, F.concat(inner, F.array(n))).otherwise(F.array(F.lit(0)))

    return let(sorted_, starts)


def run_sizes(starts: Column) -> Column:
    """Sizes of the runs that :func:`run_starts` tells."""
    return let(starts, lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda a, j: (F.get(s, j + 1) - a).cast("long")))


def gram_runs(seq: Column, k: int) -> Column:
    """Each k-mer of a sequence with how often it occurs, as an array of (gram, n) in order of k-mers: counted in the row, without a shuffle."""

    def counted(g: Column) -> Column:
        return let(run_starts(g), lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda a, j: F.struct(F.get(g, a).alias("gram"), (F.get(s, j + 1) - a).cast("long").alias("n"))))

    return let(F.sort_array(kmers(seq, k)), counted)


def valid_kmer(c: Column, alphabet: str = DNA) -> Column:
    return c.rlike(f"(?i)^[{alphabet}]*$")


def kmer_code(c: Column, alphabet: str = DNA) -> Column:
    """Number of a k-mer in base A."""
    return F.conv(F.translate(c, alphabet, "0123456789"[: len(alphabet)]), len(alphabet), 10).cast("long")


def kmer_text(c: Column, k: int, alphabet: str = DNA) -> Column:
    return F.translate(F.lpad(F.conv(c.cast("string"), 10, len(alphabet)), k, "0"), "0123456789"[: len(alphabet)], alphabet)


def resolve_ambiguous(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, pos, code, pick): each ambiguity code with the member that a hash of key and place picks, the same in every run."""
    at = df.select(key, F.posexplode(symbols(F.col(seq))).alias("pos", "code")).filter(F.col("code").rlike("[urykmswbdhvn]"))
    members = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])[F.col("code")]
    number = F.conv(F.substring(F.md5(F.concat_ws(":", key, "pos")), 1, 4), 16, 10).cast("int")
    return at.withColumn("pick", F.substring(members, F.pmod(number, F.length(members)) + 1, F.lit(1)))


def concat_prefix(df: DataFrame, prefix: str, seq: str = "seq") -> DataFrame:
    """The sequence after its prefix, with ``from_pos`` where it begins: for conditional code lengths."""
    return df.withColumn("from_pos", F.char_length(prefix)).withColumn(seq, F.concat(prefix, seq))


def match_line(a: Column, b: Column) -> Column:
    """A bar where two gapped rows have the same upper-case letter."""
    return F.array_join(F.zip_with(symbols(a), symbols(b), lambda x, y: F.when((x == y) & x.rlike("[A-Z]"), "|").otherwise(" ")), "")
