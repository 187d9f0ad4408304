"""Readers and writers of sequence, model, parameter and result files. Every reader gives one row per record."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators.sequences import let, letters_only
from bitloom.operators.tables import params_from_text


def _clean(c: Column) -> Column:
    return F.lower(letters_only(c))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), gzip recognised by its first bytes whatever the file's name."""

    @F.pandas_udf("string")
    def text(content):
        return content.map(lambda b: (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode("utf-8", "replace"))

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("text"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): records split at lines that begin with ``>``, without reading a file whole; lines may end with a carriage return."""
    records = spark.read.option("lineSep", "\n>").text(path).filter(F.col("value").rlike(r"\S"))
    lines = F.split(F.regexp_replace("value", r"^>", ""), r"\r?\n", 2)
    return records.select(F.trim(F.rtrim(lines[0], F.lit("\r"))).alias("name"), _clean(F.coalesce(F.get(lines, F.lit(1)), F.lit(""))).alias("seq"))


def read_fasta_letters(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) as :func:`read_fasta`, but of everything that isn't a letter from A to Z nothing stays."""
    return read_fasta(spark, path).select("name", F.regexp_replace("seq", "[^a-z]", "").alias("seq"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(seq_a, seq_b) of files that hold two sequences, one per line; a second line that lacks is an empty sequence."""
    lines = whole_files(spark, path).select(F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "").alias("x"))
    return lines.select(*[_clean(F.coalesce(F.get("x", F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(("seq_a", "seq_b"))])


def read_line_pairs(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(seq_a, seq_b, rest): pairs of lines in files of many pairs; ``rest`` is what follows an @ sign after them."""
    lines = F.filter(F.split(F.split_part("value", F.lit("@"), F.lit(1)), r"\r?\n"), lambda x: F.trim(x) != "")
    rows = spark.read.option("lineSep", separator).text(path).filter(F.trim("value") != "").select(lines.alias("x"), F.trim(F.split_part("value", F.lit("@"), F.lit(2))).alias("rest"))
    return rows.select(*[_clean(F.coalesce(F.get("x", F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(("seq_a", "seq_b"))], "rest")


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(name, features, other, seq): records end with a line ``//``; ``other`` is what stands between the first line and the features."""
    records = spark.read.option("lineSep", "\n//").text(path).filter(F.col("value").contains("LOCUS"))
    pick = lambda p: F.regexp_extract("value", p, 1)
    return records.select(pick(r"(?m)^LOCUS\s+(\S+)").alias("name"), pick(r"(?s)\nFEATURES[^\n]*\n(.*?)\n(?:ORIGIN|BASE)").alias("features"), pick(r"(?s)LOCUS[^\n]*\n(.*?)\n?(?:FEATURES|ORIGIN|BASE)").alias("other"), _clean(pick(r"(?s)\nORIGIN[^\n]*\n(.*)$")).alias("seq"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq): everything but white space and digits."""
    return whole_files(spark, path).select("path", _clean(F.col("text")).alias("seq"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of a file in any of the three formats, told by its first ten characters."""
    files = whole_files(spark, path)
    head = F.substring("text", 1, 10)
    kind = F.when(head.startswith("LOCUS"), "genbank").when(head.startswith(">"), "fasta").otherwise("raw")
    split = F.when(kind == "fasta", F.split("text", r"(?:^|\n)>")).when(kind == "genbank", F.split("text", r"\n//")).otherwise(F.array("text"))
    each = files.select("path", kind.alias("kind"), F.explode(split).alias("t")).filter(F.col("t").rlike(r"\S"))
    name = F.when(F.col("kind") == "fasta", F.trim(F.split("t", "\n", 2)[0])).when(F.col("kind") == "genbank", F.regexp_extract("t", r"LOCUS\s+(\S+)", 1)).otherwise(F.col("path"))
    body = F.when(F.col("kind") == "fasta", F.coalesce(F.get(F.split("t", "\n", 2), F.lit(1)), F.lit(""))).when(F.col("kind") == "genbank", F.regexp_extract("t", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)).otherwise(F.col("t"))
    return each.select(name.alias("name"), _clean(body).alias("seq"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) without blank lines and comments."""
    return spark.read.text(path).filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a parameter file; lines without an equals sign are left out."""
    lines = read_lines(spark, path).filter(F.col("value").contains("="))
    return lines.select(F.explode(params_from_text(F.col("value"))).alias("name", "value"))


def read_counts(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(kmer, n) of a counts file ``kmer: n``; a header line ``ALPHASIZE=a ORDER=k`` is optional.

    With ``size``, the alphabet's, a header of another size, or a k-mer of another length than the header's order wants, raises.
    """
    if size is not None:
        return _checked_counts(spark, path, size)
    got = F.regexp_extract("value", r"^\s*(\w+)\s*:\s*(\d+)\s*$", 1), F.regexp_extract("value", r"^\s*(\w+)\s*:\s*(\d+)\s*$", 2)
    return read_lines(spark, path).select(got[0].alias("kmer"), got[1].alias("n")).filter("kmer <> ''").select("kmer", F.col("n").cast("long").alias("n"))


def _checked_counts(spark: SparkSession, path: str, size: int) -> DataFrame:
    head = spark.read.text(path).filter(F.col("value").contains("ALPHASIZE")).select(F.regexp_extract("value", r"ALPHASIZE=(\d+)", 1).cast("int").alias("size"), F.regexp_extract("value", r"ORDER=(-?\d+)", 1).cast("int").alias("order"))
    found = head.distinct().limit(2).collect()  # headers are alike in all files
    if len(found) != 1 or found[0].size != size:
        raise ValueError(f"the counts are not of an alphabet of {size}")
    bad = F.char_length("kmer") != found[0].order + 1
    return read_counts(spark, path).select(F.when(bad, F.raise_error("a k-mer of another order")).otherwise(F.col("kmer")).alias("kmer"), "n")


def read_probs(spark: SparkSession, path: str, size: int = 4, tolerance: float = 0.001) -> DataFrame:
    """(seq, pos, p): ``size`` chances for each place of each sequence; a line that doesn't sum to one raises.

    A line begins with the sequence's key and its place, as :func:`write_probs` writes it, since lines of a folder have no order. A single file of
    bare lines of chances, as other programs write it, is one sequence (key ''); its places follow from the order of its lines.
    """
    # what is not a line of either form is null rather than left out by a filter, which might run after a failing cast
    words = F.split(F.trim("value"), r"\s+")
    named = read_lines(spark, path).select(F.get(words, F.lit(0)).alias("seq"), F.get(words, F.lit(1)).try_cast("long").alias("pos"), F.when(F.size(words) == size + 2, F.slice(words, 3, size)).alias("p"))
    text = whole_files(spark, path).select(F.posexplode(F.filter(F.split("text", r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))).alias("pos", "value"))
    bare = text.select(F.lit("").alias("seq"), F.col("pos").cast("long").alias("pos"), F.when(F.size(words) != size + 2, words).alias("p"))
    rows = named.union(bare).filter("p is not null").select("seq", "pos", F.transform("p", lambda x: x.try_cast("double")).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    bad = F.col("p").isNotNull() & ((F.size("p") != size) | F.coalesce(F.abs(total - 1) > tolerance, F.lit(True)))
    return rows.select("seq", "pos", F.when(bad, F.raise_error(F.lit("probabilities don't sum to one"))).otherwise(F.col("p")).alias("p"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Nested hits from JSON lines."""
    return spark.read.json(path)


#: A number as logs write it; the head of a line: the program, in brackets what it was told, and the rest.
NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
HEAD = r"^\s*(\w+)\s*(?:\(([^)]*)\))?\s*:\s+(.*)$"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each worked out once a row: filters and projections that use them don't take the place of what made them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def read_results(spark: SparkSession, path: str, total: bool | None = None, blend: bool | None = None, program: str | None = None) -> DataFrame:
    """Rows of result logs, one for each line with a result; comments, and lines without one, are left out.

    A line is ``program (sum=true): s1=1 s2=2 parent=1 mutates=30 r=12.5 (11.0) al=.. (..) ml=.. (..) dl=.. (..) uTime=.. cuts=4:90:7:95 params:match=0.1 ...``: r,
    al, ml and dl are the log odds and the code lengths of the alignment, the model and the data of the last round, those of the first in brackets. A sweep has
    ``(blend=false sum=true): mutates=30 r=..`` without a pair, a comparison by score ``(SW): .. r=..``, a comparison by shuffles
    ``program: s1=.. mutates=.. p=0.001 s=57``. Console lines say ``log odds ratio = ..``, of which the last counts.

    Columns: program, method (what is in the brackets, flags left out), s1, s2, parent, mutates, total, blend, log_odds, first_odds, al, first_al, ml, first_ml, dl,
    first_dl, cuts (array), params (map), p, score. ``total`` and ``blend`` keep the lines whose flags say so (no flag for blend: not blended), ``program`` those of one program.
    """
    lines = read_lines(spark, path)
    part = lambda i: F.regexp_extract("value", HEAD, i)
    console = F.try_element_at(F.regexp_extract_all("value", F.lit(rf"log odds ratio = ({NUMBER}|[-+]?[Ii]nf\w*)"), 1), F.lit(-1)).try_cast("double")
    field = lambda k, i=1: F.regexp_extract("body", rf"(?:^|\s){k}\s*=\s*({NUMBER})(?:\s+\(\s*({NUMBER})\s*\))?(?=\s|$)", i)
    number = lambda k, i=1: let(field(k, i), lambda x: F.when(x != "", x.try_cast("double")))  # noqa: E731  # a cast that fails costs more than all else
    rows = _once(lines, head=part(1), console=F.when(F.col("value").contains("log odds ratio = "), console))
    rows = _once(rows, rest=F.when(F.col("head") != "", part(3)).otherwise(F.col("value")))
    rows = _once(rows, body=F.regexp_extract("rest", r"^(.*?)(?:\bparams:.*)?$", 1))
    rows = _once(rows, r=number("r"), p=number("p")).withColumn("told", part(2))
    whole = lambda k: field(k).try_cast("int").alias(k)
    in_body = lambda k: F.regexp_extract("body", rf"(?i)(?:^|\s){k}\s*=\s*(\w+)", 1)
    flag = lambda k: let(F.regexp_extract("told", rf"(?i)\b{k}\s*=\s*(\w+)", 1), lambda x: F.lower(F.when(x != "", x).otherwise(in_body(k))))
    said = lambda k: let(flag(k), lambda x: F.when(x.isin("1", "true", "yes", "on"), True).when(x.isin("0", "false", "no", "off"), False))
    method = F.trim(F.regexp_replace("told", r"\w+\s*=\s*\w+", ""))
    pairs = F.filter(F.split(F.regexp_extract("rest", r"\bparams:\s*(.*)$", 1), r"\s+"), lambda x: x.contains("="))
    params = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1), F.substring(x, F.locate("=", x) + 1, F.char_length(x)))))
    cuts = F.transform(F.filter(F.split(F.regexp_extract("body", r"(?:^|\s)cuts=([-\d:]+)", 1), ":"), lambda x: x != ""), lambda x: x.try_cast("int"))
    lengths = [number(k, i).alias(("first_" if i == 2 else "") + k) for k in ("al", "ml", "dl") for i in (1, 2)]
    rows = rows.filter("r is not null or console is not null or p is not null")
    out = rows.select(
        F.when(F.col("head") != "", F.col("head")).alias("program"), let(method, lambda x: F.when(x != "", x)).alias("method"), *[whole(k) for k in ("s1", "s2", "parent", "mutates")], said("sum").alias("total"), said("blend").alias("blend"),
        F.coalesce("r", "console").alias("log_odds"), number("r", 2).alias("first_odds"), *lengths, cuts.alias("cuts"), params.alias("params"), "p", number("s").alias("score"),
    )
    if program is not None:
        out = out.filter(F.col("program") == program)
    for name, want in (("total", total), ("blend", blend)):
        flagged = F.coalesce(name, F.lit(False)) if name == "blend" else F.col(name)
        out = out if want is None else out.filter(flagged.eqNullSafe(F.lit(want)))
    return out


def read_old_results(spark: SparkSession, path: str) -> DataFrame:
    """(program, method, total, s1, s2, parent, mutates, log_odds, p, score) of the older logs: of a line with a value in brackets that one counts, else r."""
    got = read_results(spark, path)
    return got.select("program", "method", "total", "s1", "s2", "parent", "mutates", F.coalesce("first_odds", "log_odds").alias("log_odds"), "p", "score")


def check_scores(results: DataFrame, scores: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Result rows (s1, s2, bits, length) beside the Smith-Waterman score (s1, s2, score) of the same pair, the score that the code length stands
    for, and whether both agree; a pair without a score raises."""
    from bitloom.operators.align import score_from_bits

    met = results.join(scores, ["s1", "s2"], "left")
    want = score_from_bits(F.col("bits"), F.col("length"))
    score = F.when(F.col("score").isNull(), F.raise_error(F.lit("no score for this pair"))).otherwise(F.col("score"))
    return met.select("s1", "s2", score.alias("score"), want.alias("expected"), (F.abs(want - score) <= tolerance).alias("agrees"))


def read_population(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Archetypes (s1, seq, s_len, sub_len, e_len) and their population (s2, seq, parent, mutates, s_len, sub_len, e_len) of a generator's JSON lines."""
    rows = spark.read.schema("s1 int, s2 int, seq string, parent int, mutates int, s_len int, sub_len int, e_len int").json(path)
    return rows.filter("s1 is not null").select("s1", "seq", "s_len", "sub_len", "e_len"), rows.filter("s2 is not null").select("s2", "seq", "parent", "mutates", "s_len", "sub_len", "e_len")


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", mode: str = "errorifexists") -> None:
    df.select(F.concat(F.lit(">"), name, F.lit("\n"), seq)).write.mode(mode).text(path)


def write_pairs(df: DataFrame, path: str, key: str, a: str = "seq_a", b: str = "seq_b", mode: str = "errorifexists") -> None:
    """The two sequences of each pair as FASTA files of two folders, ``side=a`` and ``side=b``."""
    both = df.select(F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.col(c)).alias("value")) for side, c in (("a", a), ("b", b))])).alias("x"))
    both.select("x.*").write.mode(mode).partitionBy("side").text(path)


def write_genbank(df: DataFrame, path: str, name: str = "name", seq: str = "seq", features: str | None = None, mode: str = "errorifexists") -> None:
    """One record per row: first line, features, and the sequence in one block."""
    what = F.col(features) if features else F.lit("     source")
    text = F.concat(F.lit("LOCUS       "), F.col(name).cast("string"), F.lit(" "), F.char_length(seq).cast("string"), F.lit(" bp\nFEATURES             Location\n"), what, F.lit("\nORIGIN\n        1 "), seq, F.lit("\n//"))
    df.select(text).write.mode(mode).text(path)


def write_counts(df: DataFrame, path: str, size: int | None = None, mode: str = "errorifexists") -> None:
    """``kmer: n`` lines in order of k-mers; with the alphabet's ``size`` each file begins with the header that :func:`read_counts` checks."""
    lines = df.orderBy("kmer").select(F.format_string("%s: %d", "kmer", "n").alias("value"), F.char_length("kmer").alias("k"))
    if size is not None:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        head = F.format_string("ALPHASIZE=%d ORDER=%d\n%s", F.lit(size), F.col("k") - 1, "value")
        lines = lines.select(F.when(first, head).otherwise(F.col("value")).alias("value"))
    lines.select("value").write.mode(mode).text(path)


def write_probs(df: DataFrame, path: str, seq: str = "seq", pos: str = "pos", p: str = "p", mode: str = "errorifexists") -> None:
    """A line for each place, in order: the sequence's key, the place, and its chances."""
    line = F.concat_ws(" ", F.col(seq).cast("string"), F.col(pos).cast("string"), F.array_join(F.transform(p, lambda x: x.cast("string")), " "))
    df.repartitionByRange(seq, pos).sortWithinPartitions(seq, pos).select(line).write.mode(mode).text(path)


def result_lines(df: DataFrame, program: str) -> Column:
    """A row as the line that :func:`read_results` reads; what a row lacks (a null, or a column that isn't there) the line lacks, too.

    Rows with p are comparisons by shuffles; others have log_odds, and first_odds, al, ml, dl with theirs, cuts and params (a map), if they are there.
    """
    there = lambda c: F.col(c) if c in df.columns else F.lit(None)
    text = lambda c, kind="string": there(c).cast(kind).cast("string")
    say = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v))
    six = lambda c: F.format_string("%f", there(c).cast("double"))
    both = lambda k, c, first: F.when(there(c).isNotNull(), F.concat(F.lit(f"{k}="), six(c), F.when(there(first).isNotNull(), F.concat(F.lit(" ("), six(first), F.lit(")"))).otherwise("")))
    flags = F.concat_ws(" ", *[say(k, text(c)) for k, c in (("blend", "blend"), ("sum", "total"))])
    pair = [say(k, text(k)) for k in ("s1", "s2", "parent", "mutates")]
    tail = F.when(there("params").isNotNull(), F.concat(F.lit("params:"), F.array_join(F.transform(F.array_sort(F.map_entries(there("params").cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")))
    cuts = say("cuts", F.array_join(there("cuts").cast("array<string>"), ":"))
    aligned = F.concat_ws(" ", F.concat(F.lit(f"{program} ("), flags, F.lit("):")), *pair, both("r", "log_odds", "first_odds"), *[both(k, k, f"first_{k}") for k in ("al", "ml", "dl")], cuts, tail)
    shuffled = F.concat_ws(" ", F.lit(f"{program}:"), *pair, say("p", text("p", "double")), say("s", text("score", "long")))
    return F.when(there("p").isNotNull(), shuffled).otherwise(aligned)


def write_results(df: DataFrame, path: str, program: str = "align", mode: str = "errorifexists") -> None:
    """Result rows as the lines that :func:`read_results` reads."""
    df.select(result_lines(df, program).alias("value")).write.mode(mode).text(path)


def write_msglen(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """``symbol place bits`` lines; an existing folder is kept unless ``overwrite``."""
    df.select(F.format_string("%s %03d %f", "sym", "pos", "bits")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def params_text(c: Column) -> Column:
    """``name=value`` pairs in order of names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def ranking_cell(rank: str, name: str) -> Column:
    """One table row of markup."""
    return F.format_string("<tr><td>%d</td><td>%s</td></tr>", rank, F.replace(F.replace(F.col(name), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))


def ranking_html(df: DataFrame, rank: str, name: str) -> DataFrame:
    """A table row of markup per row."""
    return df.select(ranking_cell(rank, name).alias("html"))
