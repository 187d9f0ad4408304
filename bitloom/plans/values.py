"""Registered queries of column functions and small operators, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.operators import markov, repeats, sequences, tables
from bitloom.plans.catalog import _HITS, BY, EVENTS, ORACLE_SQL, SEQS, STEPS, grams_sql, query, seqs
from bitloom.session import table


@query("""
    SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '-inf' ELSE CAST(round(log2(p_size % 5), 6) AS VARCHAR) END AS log_of, round(pow(2, -p_size / 8), 9) AS exp_of,
        round(CASE WHEN p_size % 7 = 0 THEN p_size * 0.25 ELSE least(p_size * 0.25, p_retailprice / 100) - log2(1 + pow(2, -abs(p_size * 0.25 - p_retailprice / 100))) END, 6) AS either
    FROM part""")
def log_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    log_of = B.log2(F.col("p_size") % 5)
    other = F.when(F.col("p_size") % 7 == 0, float("inf")).otherwise(F.col("p_retailprice") / 100)
    shown = F.when(log_of == float("-inf"), "-inf").otherwise(F.round(log_of, 6).cast("string"))
    return p.select("p_partkey", shown.alias("log_of"), F.round(B.exp2(-F.col("p_size") / 8), 9).alias("exp_of"), F.round(B.logadd(F.col("p_size") * 0.25, other), 6).alias("either"))


@query("""
    WITH a AS (SELECT p_partkey, p_size AS n, CAST(p_retailprice AS BIGINT) AS r FROM part), f AS (SELECT unnest(range(1, 21)) AS n), l AS (SELECT *, CASE WHEN r >= 2 THEN floor(log2(r)) ELSE 0 END AS x1 FROM a),
    l2 AS (SELECT *, CASE WHEN x1 >= 2 THEN floor(log2(x1)) ELSE 0 END AS x2 FROM l), l3 AS (SELECT *, CASE WHEN x2 >= 2 THEN floor(log2(x2)) ELSE 0 END AS x3 FROM l2), l4 AS (SELECT *, CASE WHEN x3 >= 2 THEN floor(log2(x3)) ELSE 0 END AS x4 FROM l3)
    SELECT p_partkey, CAST(1 + x1 + x2 + x3 + x4 AS BIGINT) AS star, round(log2(list_product(list_prepend(1, range(1, n + 1)))), 6) AS factorial_bits, round_even(n / 8, 2) AS even FROM l4""")
def integer_codes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", B.logstar_discrete(F.col("p_retailprice").cast("long")).alias("star"), F.round(F.log2(B.factorial(F.col("p_size"))), 6).alias("factorial_bits"), B.round_half_even(F.col("p_size") / 8).alias("even")
    )


@query("""
    WITH t AS (SELECT p_partkey, p_size / 10 AS a, 1.5 AS b, p_size / 40 AS c FROM part), s AS (SELECT *, log2(pow(2, -a) + pow(2, -b) + pow(2, -c)) AS z FROM t)
    SELECT p_partkey, round(a + z, 6) AS a, round(b + z, 6) AS b, round(c + z, 6) AS c FROM s""")
def gap_costs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    shifted = B.gap_costs([F.col("p_size") / 10, F.lit(1.5), F.col("p_size") / 40])
    return p.select("p_partkey", *[F.round(c, 6).alias(n) for c, n in zip(shifted, "abc", strict=True)])


@query(f"""
    WITH {SEQS}, {grams_sql(6)} SELECT gram AS kmer, CAST(list_sum(list_transform(range(6), lambda i: (instr('acgt', substr(gram, CAST(i AS INTEGER) + 1, 1)) - 1) * pow(4, 5 - i))) AS BIGINT) AS code, count(*) AS n FROM grams GROUP BY 1""")
def kmer_codes(spark, sf_dir):
    """k-mers told by their numbers: counted as numbers, written as text again."""
    code = sequences.kmer_code(F.col("kmer"))
    grams = seqs(spark, sf_dir).select(F.explode(sequences.kmers(F.col("seq"), 6)).alias("kmer")).groupBy(code.alias("code")).agg(F.count("*").alias("n"))
    return grams.select(sequences.kmer_text(F.col("code"), 6).alias("kmer"), "code", "n")


_LETTERS = "letters AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\s0-9]', '', 'g') AS seq FROM documents)"


@query(f"WITH {_LETTERS}, {grams_sql(3).replace('FROM seqs', 'FROM letters')} SELECT regexp_matches(gram, '^[acgtACGT]*$') AS valid, count(*) AS n FROM grams GROUP BY 1")
def valid_kmers(spark, sf_dir):
    """Three-letter words of texts without white space and digits, by whether they are words of the alphabet."""
    s = table(spark, sf_dir, "documents").select(sequences.letters_only(F.coalesce("text", F.lit(""))).alias("seq"))
    grams = s.select(F.explode(sequences.kmers(F.col("seq"), 3)).alias("kmer"))
    return grams.groupBy(sequences.valid_kmer(F.col("kmer")).alias("valid")).agg(F.count("*").alias("n"))


@query(f"WITH {_LETTERS} SELECT doc_id, length(seq) AS n FROM letters WHERE NOT regexp_matches(lower(substr(seq, 1, 2)), '[^acgt]')")
def validated(spark, sf_dir):
    """Documents whose first two letters belong to the alphabet."""
    s = table(spark, sf_dir, "documents").select("doc_id", sequences.letters_only(F.coalesce("text", F.lit(""))).alias("whole"))
    kept = sequences.validate(s.withColumn("seq", F.lower(F.substring("whole", 1, 2))), mode="drop")
    return kept.select("doc_id", F.char_length("whole").cast("long").alias("n"))


_RC = "reverse(translate({}, 'acgt', 'tgca'))"


@query(f"""
    WITH {SEQS}, b AS (SELECT doc_id, seq, greatest(1, length(seq) // 3 - 50) AS a, least(length(seq), length(seq) // 2 + 50) AS z FROM seqs), t AS (SELECT doc_id, seq, a, z, substr(seq, a, greatest(0, z - a + 1)) AS s FROM b)
    SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN {_RC.format('s')} ELSE s END AS region, substr(seq, 1, a - 1) || '###' || s || '###' || substr(seq, greatest(a, z + 1)) AS marked FROM t""")
def regions(spark, sf_dir):
    """A region of each sequence with up to 50 letters around it, the other strand for odd ids, and the whole with the region's bounds marked."""
    s = seqs(spark, sf_dir).withColumn("n", F.char_length("seq"))
    first, last = F.floor(F.col("n") / 3).cast("int"), F.floor(F.col("n") / 2).cast("int")
    strand = F.when(F.col("doc_id") % 2 == 1, -1).otherwise(1)
    begin, end = F.greatest(F.lit(1), first - 50), F.least(F.col("n"), last + 50)
    return s.select("doc_id", sequences.trim_region(F.col("seq"), first, last, 50, strand).alias("region"), sequences.mark_bounds(F.col("seq"), begin, end).alias("marked"))


@query("""
    WITH e AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'e-' || l_linenumber ELSE CAST(l_linenumber AS VARCHAR) || 'e-3' END AS t FROM lineitem), r AS (SELECT CAST(CASE WHEN t LIKE 'e%' THEN '1' || t ELSE t END AS DOUBLE) AS e FROM e)
    SELECT e AS evalue, count(*) AS n FROM r WHERE e <= 0.003 GROUP BY 1""")
def evalue_cutoff(spark, sf_dir):
    n = F.col("l_linenumber").cast("string")
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("e-"), n)).otherwise(F.concat(n, F.lit("e-3")))
    e = table(spark, sf_dir, "lineitem").select(tables.repair_evalue(text).alias("evalue"), "l_linenumber")
    return tables.cutoff(e, "evalue", "l_linenumber", most=0.003).groupBy("evalue").agg(F.count("*").alias("n"))


@query("""
    WITH k AS (SELECT l_shipdate, l_extendedprice FROM lineitem WHERE l_extendedprice <= 5000)
    SELECT count(*) AS n, min(l_extendedprice) AS first, max(l_extendedprice) AS last FROM k""")
def kept_range(spark, sf_dir):
    """The range of the values that a cutoff keeps."""
    kept = tables.cutoff(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice"), "l_extendedprice", "l_orderkey", most=5000.0)
    return tables.kept_range(kept, "l_extendedprice")


@query("SELECT coalesce(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')[3], '') AS word, count(*) AS n FROM documents GROUP BY 1")
def column_pick(spark, sf_dir):
    """The third column of texts as columns parted by white space."""
    third = F.coalesce(tables.pick_column(F.col("text"), 2), F.lit(""))
    return table(spark, sf_dir, "documents").groupBy(third.alias("word")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, max(o_custkey) + 1 AS n_parents, max(o_orderkey) + 1 AS n_children FROM orders GROUP BY 1")
def index_counts(spark, sf_dir):
    """Numbers of parents and children as their highest numbers plus one."""
    return tables.index_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], n_parents="o_custkey", n_children="o_orderkey")


@query(f"""
    WITH {_HITS}, r AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bands),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM r),
    m AS (SELECT doc_id, max("end") - min("start") AS cells, count(*) AS hits, CAST(sum("end" - "start") AS BIGINT) AS touched FROM i GROUP BY doc_id, island)
    SELECT doc_id, count(*) AS lists, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(cells) AS BIGINT) AS cells, CAST(sum(touched - cells) AS BIGINT) AS wasted FROM m GROUP BY 1""")
def active_cell_stats(spark, sf_dir):
    return repeats.cell_stats(repeats.bands(repeats.nearest_repeats(seqs(spark, sf_dir), "doc_id", 12), 10), "doc_id")


@query("""
    WITH c AS (SELECT o_orderpriority AS ctx, o_orderstatus AS sym, sum(o_totalprice) AS w FROM orders GROUP BY ALL)
    SELECT ctx, sym, round(w / sum(w) OVER (PARTITION BY ctx), 6) AS p FROM c""")
def normalised_rows(spark, sf_dir):
    """Weights of each context scaled to sum to one."""
    weights = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("ctx"), F.col("o_orderstatus").alias("sym")).agg(F.sum("o_totalprice").alias("w"))
    return markov.normalise(weights, ["ctx"], "w", "p").select("ctx", "sym", F.round("p", 6).alias("p"))


@query("""
    WITH m AS (SELECT event_type, min(value * 20) AS low FROM events GROUP BY 1)
    SELECT event_type, round(low - log2(sum(pow(2, low - value * 20))), 6) AS bits FROM events JOIN m USING (event_type) GROUP BY event_type, low""")
def logsum_by_type(spark, sf_dir):
    """The code length of "any of these", for code lengths far beyond the range of their probabilities."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") * 20).alias("v"))
    return tables.log_sum(e, ["event_type"], "v", "bits").select("event_type", F.round("bits", 6).alias("bits"))


@query("""
    WITH w AS (SELECT o_orderkey, pow(2, -(l_linenumber - min(l_linenumber) OVER (PARTITION BY o_orderkey))) AS w, l_quantity AS a, l_extendedprice AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT o_orderkey, round(sum(w * a) / sum(w), 4) AS a, round(sum(w * b) / sum(w), 4) AS b FROM w GROUP BY 1""")
def merged_counts(spark, sf_dir):
    """Counts of the ways to one result, each weighing as its code length says."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    got = markov.merge_by_length(lines.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), ["o_orderkey"], "l_linenumber", ["a", "b"])
    return got.select("o_orderkey", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query(f"""
    WITH c AS ({ORACLE_SQL['cum_bits'].replace('SELECT event_id, user_id, round(bits', 'SELECT event_id, user_id, ts, round(bits')}), p AS (SELECT *, lag(cum) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM c)
    SELECT user_id, event_id, before, cum FROM p WHERE before <= 50 AND cum > 50""")
def cutoff_crossings(spark, sf_dir):
    """Where the running code length of a user passes 50 bits, with the value before."""
    out = markov.running_bits(table(spark, sf_dir, "events"), "user_id", BY, "event_type", 5).withColumn("cum", F.round("cum", 4))
    return tables.crossings(out, "user_id", BY, "cum", 50.0).select("user_id", "event_id", "before", "cum")


@query("SELECT p_partkey, 'cut=' || CAST(p_size * 0.5 AS DOUBLE) || ',gap=2.0,match=' || CAST(p_size % 4 AS DOUBLE) AS params FROM part")
def merged_params(spark, sf_dir):
    """Parameters as text, read, merged over defaults and written again."""
    from bitloom.sources.files import params_text

    p = table(spark, sf_dir, "part")
    given = F.concat(F.lit("Match=9,Cut="), (F.col("p_size") * 0.5).cast("string"), F.lit("\nmatch="), (F.col("p_size") % 4).cast("string"), F.lit("\nnoise"))
    both = tables.merge_params(tables.params_from_text(F.lit("match=1,gap=2")), tables.params_from_text(given))
    return p.select("p_partkey", params_text(both).alias("params"))


@query(f"WITH {SEQS} SELECT doc_id, length(seq) // 2 AS from_pos, md5(reverse(substr(seq, 1, length(seq) // 2)) || seq) AS digest FROM seqs")
def prefixed(spark, sf_dir):
    """Sequences after a prefix, here the first half the other way round, and where they begin."""
    s = seqs(spark, sf_dir)
    pre = s.withColumn("pre", F.reverse(F.substring("seq", F.lit(1), F.floor(F.char_length("seq") / 2).cast("int"))))
    return sequences.concat_prefix(pre, "pre").select("doc_id", F.col("from_pos").cast("long").alias("from_pos"), F.md5("seq").alias("digest"))


@query("""
    WITH t AS (SELECT p_partkey, upper(p_name) AS a, upper(p_type) AS b FROM part)
    SELECT p_partkey, array_to_string(list_transform(range(1, greatest(length(a), length(b)) + 1), lambda i: CASE WHEN i <= least(length(a), length(b)) AND substr(a, i, 1) = substr(b, i, 1) AND regexp_matches(substr(a, i, 1), '[A-Z]') THEN '|' ELSE ' ' END), '') AS line FROM t""")
def match_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", sequences.match_line(F.upper("p_name"), F.upper("p_type")).alias("line"))


@query(f"""
    WITH {STEPS}, c AS (SELECT ctx, sym, count(*) AS n FROM steps WHERE ctx IS NOT NULL GROUP BY ALL), t AS (SELECT ctx, sum(n) AS total FROM c GROUP BY 1), s AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS sym)
    SELECT t.ctx, s.sym, round((coalesce(n, 0) + 0.2) / (total + 1), 6) AS p FROM t CROSS JOIN s LEFT JOIN c ON c.ctx = t.ctx AND c.sym = s.sym""")
def next_symbol_mml(spark, sf_dir):
    """Next-symbol chances with the estimate (n + 1/A) / (N + 1)."""
    counts = markov.event_counts(table(spark, sf_dir, "events"), "user_id", BY, "event_type")
    return markov.predict(counts, EVENTS, prior=0.2).select("ctx", "sym", F.round("p", 6).alias("p"))


@query(f"WITH {SEQS} SELECT doc_id, length(seq) AS length, CAST(length(seq) * 2 AS DOUBLE) AS bits FROM seqs")
def uniform_bits(spark, sf_dir):
    return markov.model_bits(seqs(spark, sf_dir), "doc_id", "uniform")


@query(ORACLE_SQL["markov_fitted_bits_k2"])
def model_string_bits(spark, sf_dir):
    """A model chosen by its name and order."""
    return markov.model_bits(seqs(spark, sf_dir), "doc_id", "fitted(2)").withColumn("bits", F.round("bits", 4))


@query("SELECT p_partkey, upper(p_name) AS name, upper(substr(p_name, 1, 3)) || reverse(substr(p_type, 2, 5)) AS mixed, instr(p_name, 'e') AS at, lower(p_brand) AS brand FROM part")
def string_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mixed = F.concat(F.upper(F.substring("p_name", 1, 3)), F.reverse(F.substring("p_type", 2, 5)))
    return p.select("p_partkey", F.upper("p_name").alias("name"), mixed.alias("mixed"), F.instr("p_name", "e").cast("long").alias("at"), F.lower("p_brand").alias("brand"))


@query("SELECT user_id, max(value) AS best, CAST(arg_min(event_type, value) AS VARCHAR) AS cheapest FROM (SELECT DISTINCT ON (user_id, value) user_id, value, event_type FROM events ORDER BY user_id, value, event_type) GROUP BY 1")
def best_rounds(spark, sf_dir):
    """The best value over rounds, and the cheapest state, ties going to the first in the order of states."""
    return tables.best_and_cheapest(table(spark, sf_dir, "events"), ["user_id"], "value", "event_type", EVENTS).select("user_id", "best", "cheapest")
