import gzip

import pytest

from bitloom.functions import bits as B
from bitloom.operators import sequences, tables
from bitloom.sources import files
from bitloom.streaming import online


def test_sequence_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT 12\nacg\n>two\nTT\n>three\n")
    (tmp_path / "g.txt").write_text("LOCUS       AB1 10 bp\nFEATURES   x\n  gene 1\nORIGIN\n   1 acgt acgt\n   9 aa\n//\n")
    (tmp_path / "r.raw").write_text("  1 acgt\n 5 GG\n")
    (tmp_path / "z.bin").write_bytes(gzip.compress(b">zip\nacca\n"))
    assert sorted(tuple(r) for r in files.read_fasta(spark, f"{tmp_path}/a.fa").collect()) == [("one first", "acgtacg"), ("three", ""), ("two", "tt")]
    g = files.read_genbank(spark, f"{tmp_path}/g.txt").collect()
    assert [(r.name, r.features.strip(), r.seq) for r in g] == [("AB1", "gene 1", "acgtacgtaa")]
    assert files.read_raw(spark, f"{tmp_path}/r.raw").first().seq == "acgtgg"
    got = {r.seq for r in files.read_sequences(spark, str(tmp_path)).collect()}
    assert got == {"acgtacg", "tt", "", "acgtacgtaa", "acgtgg", "acca"}


def test_fasta_with_carriage_returns(spark, tmp_path):
    (tmp_path / "dos.fa").write_bytes(b"\r\n>one x \r\nACG\r\nTT\r\n>two\r\n>three")
    got = {(r.name, r.seq) for r in files.read_fasta(spark, str(tmp_path / "dos.fa")).collect()}
    assert got == {("one x", "acgtt"), ("two", ""), ("three", "")}


def test_tables_and_round_trips(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# note\nMatch=0.5\n\nnoise\nmatch=0.7,cut=4\n")
    assert {tuple(r) for r in files.read_params(spark, f"{tmp_path}/p.txt").collect()} == {("match", 0.5), ("match", 0.7), ("cut", 4.0)}
    counts = spark.createDataFrame([("ac", 3), ("aa", 5)], "kmer string, n long")
    files.write_counts(counts, f"{tmp_path}/c")
    assert sorted(tuple(r) for r in files.read_counts(spark, f"{tmp_path}/c").collect()) == [("aa", 5), ("ac", 3)]
    probs = spark.createDataFrame([("x", 1, [0.25, 0.25, 0.25, 0.25]), ("x", 0, [0.7, 0.1, 0.1, 0.1]), ("y", 0, [1.0, 0.0, 0.0, 0.0])], "seq string, pos long, p array<double>")
    files.write_probs(probs, f"{tmp_path}/q")
    assert sorted(map(tuple, files.read_probs(spark, f"{tmp_path}/q").collect())) == sorted(map(tuple, probs.collect()))
    (tmp_path / "bare.txt").write_text("# note\n\n0.7 0.1 0.1 0.1\n0.25 0.25 0.25 0.25\n")
    assert [tuple(r) for r in files.read_probs(spark, f"{tmp_path}/bare.txt").orderBy("pos").collect()] == [("", 0, [0.7, 0.1, 0.1, 0.1]), ("", 1, [0.25, 0.25, 0.25, 0.25])]
    files.write_counts(counts, f"{tmp_path}/h", size=4)
    assert sorted(tuple(r) for r in files.read_counts(spark, f"{tmp_path}/h", size=4).collect()) == [("aa", 5), ("ac", 3)]
    with pytest.raises(ValueError, match="alphabet"):
        files.read_counts(spark, f"{tmp_path}/h", size=5)
    (tmp_path / "two.txt").write_text("AC GT 1\n\ngg\n")
    assert tuple(files.read_pairs(spark, f"{tmp_path}/two.txt").first()) == ("acgt", "gg")
    (tmp_path / "old.txt").write_text("calign (sum=true): s1=3 s2=4 parent=3 mutates=5 r=9 (2.5)  al=1 (1) dl=2 (2) x\nalign (SW): s1=1 s2=4 parent=3 mutates=2 r=-3.5e+01\nother s1=3 r = q\n")
    old = files.read_old_results(spark, f"{tmp_path}/old.txt").collect()
    assert sorted((r.program, r.method or "", r.total, r.s1, r.log_odds) for r in old) == [("align", "SW", None, 1, -35.0), ("calign", "", True, 3, 2.5)]
    scores = spark.createDataFrame([(1, 2, 10)], "s1 int, s2 int, score int")
    results = spark.createDataFrame([(1, 2, 18.048, 10), (9, 9, 1.0, 1)], "s1 int, s2 int, bits double, length int")
    assert files.check_scores(results.filter("s1 = 1"), scores).first().agrees
    with pytest.raises(Exception, match="no score"):
        files.check_scores(results, scores).collect()
    (tmp_path / "bad.txt").write_text("0.5 0.5 0.5 0.5\n")
    with pytest.raises(Exception, match="sum to one"):
        files.read_probs(spark, f"{tmp_path}/bad.txt").collect()
    seqs = spark.createDataFrame([("a", "acgt")], "name string, seq string")
    files.write_fasta(seqs, f"{tmp_path}/f")
    assert tuple(files.read_fasta(spark, f"{tmp_path}/f").first()) == ("a", "acgt")
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_fasta(seqs, f"{tmp_path}/f")
    (tmp_path / "log.txt").write_text("s1=3 s2=14 parent=3 mutates=40 -log odds ratio = 1.5 then -log odds ratio = 7.25 params: a=1 b=2\nother\n")
    r = files.read_results(spark, f"{tmp_path}/log.txt").first()
    assert (r.s1, r.s2, r.parent, r.mutates, r.log_odds, r.params["b"]) == (3, 14, 3, 40, 7.25, "2")


def test_result_logs(spark, tmp_path):
    (tmp_path / "log.txt").write_text(
        "# notes\nmeasure (sum=true): s1=1 s2=2 parent=1 mutates=30 r=12.500000 (11.000000) al=200.1 (201.2) ml=30.5 (31.0) dl=169.6 (170.2) uTime=0.5 cuts=3:90:4:88 params:change=3.2  match=0.1  x=1e-3 \n"
        "measure (sum=false): s1=1 s2=3 parent=2 mutates=30 r=-1.25e-02 (-7) al=1 (2) dl=3 (4) uTime=1 cuts= params:match=0.2\n"
        "measure (blend=true sum=true): mutates=-1 r=4 \nmeasure (blend=false sum=true): mutates=-1 r=-4\nshuffler: s1=1 s2=2 parent=1 mutates=30 p=7.4e-04 s=257 expect=3 runs=200\nshuffler: mutates=5 p=0.25\nnonsense\n\n"
    )
    rows = files.read_results(spark, f"{tmp_path}/log.txt").collect()
    assert len(rows) == 6
    first = next(r for r in rows if r.s2 == 2 and r.program == "measure")
    assert (first.log_odds, first.first_odds, first.al, first.first_al, first.ml, first.first_ml, first.dl, first.first_dl, first.cuts) == (12.5, 11.0, 200.1, 201.2, 30.5, 31.0, 169.6, 170.2, [3, 90, 4, 88])
    assert first.params == {"change": "3.2", "match": "0.1", "x": "1e-3"} and first.total and first.blend is None and first.p is None
    second = next(r for r in rows if r.s2 == 3)
    assert (second.log_odds, second.first_odds, second.ml, second.total, second.cuts) == (-0.0125, -7.0, None, False, [])
    assert sorted((r.p, r.score) for r in rows if r.program == "shuffler") == [(7.4e-4, 257.0), (0.25, None)]
    assert [r.log_odds for r in files.read_results(spark, f"{tmp_path}/log.txt", total=True, blend=True).collect()] == [4.0]
    assert sorted(r.log_odds for r in files.read_results(spark, f"{tmp_path}/log.txt", total=True, blend=False).collect()) == [-4.0, 12.5]
    df = files.read_results(spark, f"{tmp_path}/log.txt")
    files.write_results(df.filter("program = 'measure'"), f"{tmp_path}/again", "measure")
    key = lambda r: str((r.s2, r.log_odds, r.first_odds, r.al, r.cuts, r.params, r.total, r.blend, r.mutates))
    assert sorted(map(key, files.read_results(spark, f"{tmp_path}/again").collect())) == sorted(key(r) for r in rows if r.program == "measure")


def test_result_lines_are_parsed_once(spark, tmp_path):
    """Filters and columns read the fields of a line, they don't cut it up again."""
    (tmp_path / "log.txt").write_text("one (sum=1): s1=1 r=2 (3) params:a=1\none: s1=1 r = x\n two r=4\n# one: r=5\nlog odds ratio = 1 log odds ratio = Infinity\none: p=0.5 s=2\n")
    got = files.read_results(spark, str(tmp_path / "log.txt"))
    assert sorted((r.program or "", r.log_odds or 0.0, r.p or 0.0) for r in got.collect()) == [("", 4.0, 0.0), ("", float("inf"), 0.0), ("one", 0.0, 0.5), ("one", 2.0, 0.0)]
    for rows in (got, files.read_results(spark, str(tmp_path / "log.txt"), total=True, program="one"), files.read_old_results(spark, str(tmp_path / "log.txt"))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("params:.*)?$") == 1 and plan.count(r"s)r\s*=") <= 2  # a value and the one in brackets


def test_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a=1,B=2\na=3", 1.0, 16.0, "e-10", 2.675)], "t string, x double, y double, e string, h double")
    row = df.select(
        tables.params_from_text(F.col("t")).alias("p"), B.logstar(F.col("x")).alias("l1"), B.logstar(F.col("y")).alias("l16"), B.logadd(F.col("x"), F.col("x")).alias("add"),
        B.logadd(F.col("x"), F.lit(float("inf"))).alias("inf"), tables.repair_evalue(F.col("e")).alias("e"), B.log2(F.lit(0.0)).alias("zero"), B.logstar_discrete(F.lit(16)).alias("d"),
        sequences.match_line(F.lit("AC-Ga"), F.lit("AC-Ta")).alias("m"), sequences.kmer_code(F.lit("gt")).alias("code"), sequences.kmer_text(F.lit(11), 2).alias("text"),
        tables.merge_params(F.create_map(F.lit("a"), F.lit(1.0)), F.create_map(F.lit("a"), F.lit(2.0))).alias("merged"),
    ).first()
    assert row.p == {"a": 3.0, "b": 2.0} and row.l1 == pytest.approx(1.51853514) and row.l16 == pytest.approx(8.51853514)
    assert row["add"] == pytest.approx(0) and row["inf"] == 1 and row.e == 1e-10 and row.zero == float("-inf") and row.d == 1 + 4 + 2 + 1
    assert row.m == "||   " and row.code == 11 and row.text == "gt" and row.merged == {"a": 2.0}
    with pytest.raises(Exception, match="outside"):
        sequences.validate(spark.createDataFrame([("acx",)], "seq string")).collect()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = [(1, i, "ab"[i % 2]) for i in range(10)] + [(2, i, "a") for i in range(5)]
    df = spark.createDataFrame(rows, "k long, i long, s string")
    src = str(tmp_path / "in")
    stream = lambda: online.stream_bits(spark.readStream.schema(df.schema).parquet(src), "k", ["i"], "s", ["a", "b"])
    for part in ("i < 4", "i >= 4"):
        df.filter(part).coalesce(1).write.mode("append").parquet(src)
        online.write(stream(), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    from bitloom.operators.markov import running_bits

    got = sorted((r.k, r.i, round(r.bits, 6), round(r["cum"], 6)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((r.k, r.i, round(r.bits, 6), round(r["cum"], 6)) for r in running_bits(df, "k", ["i"], "s", 2).collect())
    assert got == want
