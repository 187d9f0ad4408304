"""Registered queries that write a table in a file format and read it back: their DuckDB counterparts see the table alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import markov, tables
from bitloom.plans.catalog import MET_SQL, BY, EVENTS, ORACLE_SQL, SEQS, STEPS, met_pairs, grams_sql, query, seqs
from bitloom.session import shared_folder, table
from bitloom.sources import files


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), "seq")


@query(f"WITH {SEQS} SELECT 'doc ' || doc_id AS name, seq FROM seqs")
def fasta_round_trip(spark, sf_dir):
    folder = shared_folder(spark)
    files.write_fasta(_named(spark, sf_dir), folder)
    return files.read_fasta(spark, folder)


@query("SELECT CAST(doc_id AS VARCHAR) AS name, regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g') AS seq FROM documents")
def fasta_letters(spark, sf_dir):
    """Texts without line breaks as FASTA bodies, of which the letters are read."""
    folder = shared_folder(spark)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.translate(F.coalesce("text", F.lit("")), "\n\r>", "   ").alias("seq"))
    files.write_fasta(d, folder)
    return files.read_fasta_letters(spark, folder)


@query(f"WITH {SEQS} SELECT CAST(doc_id AS VARCHAR) AS name, '     gene ' || doc_id AS features, seq FROM seqs")
def genbank_round_trip(spark, sf_dir):
    folder = shared_folder(spark)
    s = seqs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("     gene "), F.col("doc_id").cast("string")).alias("f"), "seq")
    files.write_genbank(s, folder, features="f")
    return files.read_genbank(spark, folder).select("name", "features", "seq")


@query(f"WITH {SEQS} SELECT seq, count(*) AS n FROM (SELECT seq FROM seqs WHERE doc_id % 3 = 0 OR doc_id % 3 = 1 UNION ALL SELECT seq FROM seqs WHERE doc_id % 3 = 2) WHERE seq <> '' GROUP BY 1")
def sniffed_formats(spark, sf_dir):
    """Sequences in three folders, as FASTA, GenBank and compressed FASTA under a plain name, read together by what the files begin with."""
    folder = shared_folder(spark)
    s = seqs(spark, sf_dir).filter("seq <> ''").select("doc_id", F.col("doc_id").cast("string").alias("name"), "seq")
    files.write_fasta(s.filter("doc_id % 3 = 0"), f"{folder}/kind=a")
    files.write_genbank(s.filter("doc_id % 3 = 1"), f"{folder}/kind=b")
    packed = s.filter("doc_id % 3 = 2").select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq"))
    packed.write.option("compression", "gzip").text(f"{folder}/kind=c")
    every = [files.read_sequences(spark, f"{folder}/kind={k}/part-*") for k in "abc"]
    return every[0].union(every[1]).union(every[2]).groupBy("seq").agg(F.count("*").alias("n"))


@query(f"WITH {SEQS}, {grams_sql(3)} SELECT gram AS kmer, count(*) AS n FROM grams GROUP BY 1")
def counts_round_trip(spark, sf_dir):
    folder = shared_folder(spark)
    files.write_counts(markov.kmer_counts(seqs(spark, sf_dir), 3), folder, size=4)
    return files.read_counts(spark, folder, size=4)


@query(f"WITH {SEQS}, {grams_sql(2)} SELECT gram AS kmer, count(*) AS n FROM grams GROUP BY 1")
def counts_without_header(spark, sf_dir):
    folder = shared_folder(spark)
    files.write_counts(markov.kmer_counts(seqs(spark, sf_dir), 2), folder)
    return files.read_counts(spark, folder)


_PROBS = ORACLE_SQL["next_symbol_probs"]


@query(f"WITH n AS ({_PROBS}) SELECT ctx AS seq, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], sym) - 1 AS BIGINT) AS pos, round(p, 6) AS p FROM n")
def probs_round_trip(spark, sf_dir):
    """The chances of the next event as a table of chances per place: here each context is a sequence of one place."""
    model = markov.predict(markov.event_counts(table(spark, sf_dir, "events"), "user_id", BY, "event_type"), EVENTS)
    rows = model.groupBy(F.col("ctx").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("sym", "p"))).alias("x"))  # one entry for each symbol
    folder = shared_folder(spark)
    files.write_probs(rows.select("seq", F.lit(0).alias("pos"), F.transform("x", lambda e: e["p"]).alias("p")), folder)
    got = files.read_probs(spark, folder, size=len(EVENTS))
    return got.select("seq", F.posexplode("p").alias("pos", "p")).select("seq", F.col("pos").cast("long").alias("pos"), F.round("p", 6).alias("p"))


_STATIC = f"""
    WITH {STEPS}, c AS (SELECT ctx, sym, count(*) AS n FROM steps WHERE ctx IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY ctx) AS total FROM c),
    p AS (SELECT ctx, sym, CAST(round((n + 1) / (total + 5), 9) AS DOUBLE) AS p FROM t)
    SELECT user_id, count(*) AS length, round(sum(CASE WHEN ctx IS NULL THEN log2(5) ELSE -log2(p) END), 3) AS bits FROM steps LEFT JOIN p USING (ctx, sym) GROUP BY 1"""


@query(_STATIC)
def file_model_bits(spark, sf_dir):
    """Code lengths under a model whose chances come from a file."""
    events = table(spark, sf_dir, "events")
    model = markov.predict(markov.event_counts(events, "user_id", BY, "event_type"), EVENTS)
    rows = model.groupBy(F.col("ctx").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("sym", "p"))).alias("x"))
    folder = shared_folder(spark)
    files.write_probs(rows.select("seq", F.lit(0).alias("pos"), F.transform("x", lambda e: e["p"]).alias("p")), folder)
    read = files.read_probs(spark, folder, size=len(EVENTS)).select(F.col("seq").alias("ctx"), F.posexplode("p").alias("at", "p"))
    named = read.select("ctx", F.element_at(F.array(*map(F.lit, EVENTS)), F.col("at") + 1).alias("sym"), "p")
    return markov.event_bits(events, named, "user_id", BY, "event_type", len(EVENTS)).select("user_id", "length", F.round("bits", 3).alias("bits"))


@query("SELECT p_partkey, lower(p_brand) AS name, CAST(p_size * 0.5 AS DOUBLE) AS value FROM part")
def params_file(spark, sf_dir):
    """A parameter file with comments and lines of other kinds, one section for each row, its key being a parameter of its own."""
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("# comment\n\nnoise\n"), F.col("p_brand"), F.lit("@"), F.col("p_partkey").cast("string"), F.lit("="), (F.col("p_size") * 0.5).cast("string"))
    folder = shared_folder(spark)
    p.select(text).write.text(folder)
    got = files.read_params(spark, folder)
    return got.select(F.split_part("name", F.lit("@"), F.lit(2)).cast("long").alias("p_partkey"), F.split_part("name", F.lit("@"), F.lit(1)).alias("name"), "value")


_RESULTS = """
    WITH r AS (SELECT l_orderkey AS s1, l_linenumber AS s2, l_partkey % 100 AS parent, l_suppkey % 50 AS mutates, l_returnflag = 'A' AS total, l_linestatus = 'F' AS blend, (l_quantity - 25) * 1e-3 AS log_odds, l_quantity - 30 AS first_odds,
        l_extendedprice AS al, l_tax AS ml, l_discount AS d FROM lineitem)"""
#: A line of the all-pairs form, written out by SQL.
_LINE = "format('align (sum={}): s1={} s2={} parent={} mutates={} r={:.6f} ({:.6f}) al={:.6f} ml={:.6f} cuts={}:{} params:cut={} match={}', total, s1, s2, parent, mutates, log_odds, first_odds, al, ml, s2, s2 + 1, s2, s2 * 2)"


def _result_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("s1"), F.col("l_linenumber").alias("s2"), (F.col("l_partkey") % 100).alias("parent"), (F.col("l_suppkey") % 50).alias("mutates"), (F.col("l_returnflag") == "A").alias("total"),
        (F.col("l_linestatus") == "F").alias("blend"), ((F.col("l_quantity") - 25) * 1e-3).alias("log_odds"), (F.col("l_quantity") - 30).alias("first_odds"), F.col("l_extendedprice").alias("al"), F.col("l_tax").alias("ml"),
        F.array("l_linenumber", F.col("l_linenumber") + 1).alias("cuts"), F.create_map(F.lit("match"), F.col("l_linenumber") * 2, F.lit("cut"), F.col("l_linenumber")).alias("params"),
    )


@query(f"{_RESULTS} SELECT {_LINE} AS line, count(*) AS n FROM r GROUP BY 1")
def result_lines(spark, sf_dir):
    """The lines of a result log, as text."""
    rows = _result_rows(spark, sf_dir).drop("blend")
    return rows.select(files.result_lines(rows, "align").alias("line")).groupBy("line").agg(F.count("*").alias("n"))


@query(f"{_RESULTS} SELECT s1, s2, parent, mutates, total, round(log_odds, 6) AS log_odds, first_odds, round(al, 3) AS al, s2 + 1 AS cut, log_odds > 0 AS related, parent = s1 AS own, CAST(s2 * 2 AS VARCHAR) AS match FROM r")
def result_log(spark, sf_dir):
    """All rows of a result log, with whether it says related, whether the pair is parent and child, a cut point and a parameter of its tail."""
    folder = shared_folder(spark)
    files.write_results(_result_rows(spark, sf_dir).drop("blend"), folder)
    got = files.read_results(spark, folder, program="align")
    number = lambda c: F.col(c).cast("long").alias(c)
    return got.select(number("s1"), F.col("s2").cast("int").alias("s2"), number("parent"), number("mutates"), "total", F.round("log_odds", 6).alias("log_odds"), "first_odds", F.round("al", 3).alias("al"), F.col("cuts")[1].alias("cut"), (F.col("log_odds") > 0).alias("related"), (F.col("parent") == F.col("s1")).alias("own"), F.col("params")["match"].alias("match"))


@query(f"{_RESULTS} SELECT mutates, count(*) AS n, round(avg(log_odds), 4) AS mean, round(min(log_odds), 6) AS low, round(max(log_odds), 6) AS high FROM r WHERE total AND NOT blend GROUP BY 1")
def sweep_log(spark, sf_dir):
    """A log of a sweep over numbers of mutations, whose lines name no pair: the rows of one kind."""
    folder = shared_folder(spark)
    files.write_results(_result_rows(spark, sf_dir).select("mutates", "total", "blend", "log_odds"), folder)
    got = files.read_results(spark, folder, total=True, blend=False)
    return got.groupBy(F.col("mutates").cast("long").alias("mutates")).agg(F.count("*").alias("n"), F.round(F.avg("log_odds"), 4).alias("mean"), F.round(F.min("log_odds"), 6).alias("low"), F.round(F.max("log_odds"), 6).alias("high"))


@query("SELECT CAST(l_linenumber AS BIGINT) AS mutates, count(*) AS n, round(sum(CAST(l_suppkey AS DOUBLE) * 1e-7), 6) AS p, CAST(sum(l_partkey) AS BIGINT) AS score FROM lineitem GROUP BY 1")
def shuffle_log(spark, sf_dir):
    """Comparisons by shuffles in a log: small chances keep their exponents."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s1"), F.lit(1).alias("s2"), F.lit(1).alias("parent"), F.col("l_linenumber").alias("mutates"), (F.col("l_suppkey") * 1e-7).alias("p"), F.col("l_partkey").alias("score"))
    folder = shared_folder(spark)
    files.write_results(rows, folder, program="shuffled")
    got = files.read_results(spark, folder, program="shuffled").groupBy(F.col("mutates").cast("long").alias("mutates"))
    return got.agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("p"), F.sum("score").cast("long").alias("score"))


@query("SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'calign' ELSE 'align' END AS program, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 'SW' END AS method, l_partkey % 100 = l_suppkey % 100 AS own, count(*) AS n, round(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE -l_quantity END), 4) AS odds FROM lineitem GROUP BY ALL")
def old_result_log(spark, sf_dir):
    """The older log, with counts of right and wrong pairs unscaled: values in brackets count, those with exponents too."""
    n = table(spark, sf_dir, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    value = F.when(even, F.concat(F.lit("r=1.5e+03 ("), F.col("l_tax").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("r="), F.format_string("%.1e", -F.col("l_quantity"))))
    text = F.concat(F.when(even, "calign (sum=true)").otherwise("align (SW)"), F.lit(": s1="), (F.col("l_suppkey") % 100).cast("string"), F.lit(" s2=1 parent="), (F.col("l_partkey") % 100).cast("string"), F.lit(" mutates=3 "), value)
    folder = shared_folder(spark)
    n.select(F.explode(F.array(text, F.lit("# comment"), F.lit("other line r = x")))).write.text(folder)
    got = files.read_old_results(spark, folder).groupBy("program", "method", (F.col("parent") == F.col("s1")).alias("own"))
    return got.agg(F.count("*").alias("n"), F.round(F.sum("log_odds"), 4).alias("odds"))


@query("""
    WITH n AS (SELECT l_orderkey AS s1, l_linenumber AS s2, max(l_extendedprice) / 100 AS bits, max(l_quantity) AS length FROM lineitem GROUP BY ALL)
    SELECT s1, s2, CAST(length AS INTEGER) AS score, round(-(bits - 2.1048 * length) / 0.3, 4) AS expected, abs(-(bits - 2.1048 * length) / 0.3 - CAST(length AS INTEGER)) <= 1000 AS agrees FROM n""")
def checked_scores(spark, sf_dir):
    """Code lengths against the scores of the same pairs."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("s1"), F.col("l_linenumber").alias("s2")).agg((F.max("l_extendedprice") / 100).alias("bits"), F.max("l_quantity").alias("length"))
    got = files.check_scores(n, n.select("s1", "s2", F.col("length").cast("int").alias("score")), tolerance=1000.0)
    return got.select("s1", "s2", "score", F.round("expected", 4).alias("expected"), "agrees")


@query("SELECT c_custkey AS s1, count(o_orderkey) AS n, CAST(coalesce(sum(o_orderkey % 7), 0) AS BIGINT) AS mutates FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def generator_log(spark, sf_dir):
    """Archetypes and their children from a generator's log."""
    folder = shared_folder(spark)
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("s1"), F.col("c_name").alias("seq"), F.lit(1).alias("s_len"))
    kids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("s2"), F.col("o_orderpriority").alias("seq"), F.col("o_custkey").cast("int").alias("parent"), (F.col("o_orderkey") % 7).cast("int").alias("mutates"))
    base.write.json(f"{folder}/a")
    kids.write.json(f"{folder}/b")
    parents, population = files.read_population(spark, f"{folder}/*")
    own = population.groupBy(F.col("parent").alias("s1")).agg(F.count("*").alias("n"), F.sum("mutates").alias("mutates"))
    return parents.join(own, "s1", "left").select(F.col("s1").cast("long").alias("s1"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mutates", F.lit(0)).alias("mutates"))


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def nested_hits(spark, sf_dir):
    """Hits nested in their searches, as JSON lines."""
    nested = tables.nest(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_quantity"], "seqs")
    both = table(spark, sf_dir, "orders").select("o_orderkey").join(nested, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    folder = shared_folder(spark)
    both.write.json(folder)
    return tables.flatten_hits(files.read_hits(spark, folder), "seqs").select("o_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_quantity")


@query(f"WITH c AS ({ORACLE_SQL['cum_bits']}), e AS (SELECT event_id, event_type FROM events) SELECT event_type AS sym, CAST(event_id AS VARCHAR) AS pos, round(bits, 4) AS bits FROM c JOIN e USING (event_id)")
def message_lengths(spark, sf_dir):
    out = markov.running_bits(table(spark, sf_dir, "events"), "user_id", BY, "event_type", 5)
    folder = shared_folder(spark)
    files.write_msglen(out.select(F.col("event_type").alias("sym"), F.col("event_id").alias("pos"), "bits"), folder)
    words = F.split("value", " ")
    return spark.read.text(folder).select(words[0].alias("sym"), words[1].cast("long").cast("string").alias("pos"), F.round(words[2].cast("double"), 4).alias("bits"))


@query(f"WITH {MET_SQL} SELECT CAST(item_id AS VARCHAR) || '-' || doc_id AS name, side, CASE side WHEN 'a' THEN i.seq ELSE s.seq END AS seq FROM met JOIN items i USING (item_id) JOIN seqs s USING (doc_id) CROSS JOIN (VALUES ('a'), ('b')) v(side)")
def split_pairs(spark, sf_dir):
    """The pairs of items and documents that meet, each side in FASTA files of its own."""
    pairs = met_pairs(spark, sf_dir).select(F.concat_ws("-", "item_id", "doc_id").alias("id"), "seq_a", "seq_b")
    folder = shared_folder(spark)
    files.write_pairs(pairs, folder, "id")
    sides = [files.read_fasta(spark, f"{folder}/side={x}").select("name", F.lit(x).alias("side"), "seq") for x in "ab"]
    return sides[0].union(sides[1])


@query(f"WITH {SEQS} SELECT doc_id, substr(seq, 1, 40) AS seq_a, {'reverse(substr(seq, 1, 40))'} AS seq_b FROM seqs WHERE seq <> ''")
def two_lines(spark, sf_dir):
    """Two sequences a file, one per line; the file's folder says which document they are of."""
    s = seqs(spark, sf_dir).filter("seq <> ''").select("doc_id", F.substring("seq", 1, 40).alias("s"))
    folder = shared_folder(spark)
    s.select(F.concat(F.upper("s"), F.lit("\n\n"), F.reverse("s"), F.lit("\n@"), F.col("doc_id").cast("string"))).write.option("lineSep", "\n%\n").text(folder)
    return files.read_line_pairs(spark, folder, "\n%\n").select(F.col("rest").cast("long").alias("doc_id"), "seq_a", "seq_b")


@query("SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS place, '<tr><td>' || (row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1) || '</td><td>' || replace(replace(p_name || ' <' || p_size || '&>', '&', '&amp;'), '<', '&lt;') || '</td></tr>' AS html FROM part")
def ranking_table(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.concat("p_name", F.lit(" <"), F.col("p_size").cast("string"), F.lit("&>")).alias("name"))
    ranked = tables.rank(p, "p_retailprice", "p_partkey", "place", ascending=False)
    return ranked.select("place", files.ranking_cell("place", "name").alias("html"))


@query(f"WITH {SEQS} SELECT CAST(sum(length(seq)) AS BIGINT) AS letters FROM seqs")
def raw_files(spark, sf_dir):
    """Texts as raw files: numbers and white space go."""
    folder = shared_folder(spark)
    seqs(spark, sf_dir).select(F.concat(F.lit("  1 "), "seq", F.lit("\n 61 "))).write.text(folder)
    return files.read_raw(spark, f"{folder}/part-*").agg(F.sum(F.char_length("seq")).alias("letters"))
