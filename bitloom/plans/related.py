"""Registered queries on related sequences, models of higher order and views of streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from bitloom.operators import align, edits, generate, markov, sequences
from bitloom.plans.catalog import SEQS, met_pairs, query, seqs
from bitloom.session import shared_folder, table, written
from bitloom.streaming import online

LIMIT = 100


@query(f"""
    WITH {SEQS}, g AS (SELECT doc_id, seq, list_max(list_transform(range(1, length(seq) - 18), lambda i: substr(seq, i, 20))) AS gram FROM seqs WHERE length(seq) >= 20),
    f AS (SELECT gram, min(doc_id) AS first_id FROM g GROUP BY 1)
    SELECT a.doc_id, f.first_id, CASE WHEN abs(length(a.seq) - length(b.seq)) <= {LIMIT} AND levenshtein(a.seq, b.seq) <= {LIMIT} THEN CAST(levenshtein(a.seq, b.seq) AS INTEGER) END AS distance
    FROM g a JOIN f ON a.gram = f.gram JOIN g b ON b.doc_id = f.first_id WHERE a.doc_id <> f.first_id""")
def near_copy_edits(spark, sf_dir):
    """DNA letters of each document against the first document with the same greatest 20-mer: edits up to a limit, null above. A document meets one other."""
    # the texts stay out of the joins until it is known which documents meet
    d = seqs(spark, sf_dir)
    g = written(d.select("doc_id", F.array_max(sequences.kmers(F.col("seq"), 20)).alias("gram")).filter("gram IS NOT NULL"))
    # a table of its own, so that a gram of very many documents is a skewed side that adaptive execution splits
    first = written(g.groupBy("gram").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("gram", "first_id"))
    met = g.join(first, "gram").filter("doc_id <> first_id").select("doc_id", "first_id")
    pairs = met.join(d.withColumnRenamed("seq", "seq_a"), "doc_id").join(d.select(F.col("doc_id").alias("first_id"), F.col("seq").alias("seq_b")), "first_id")
    return edits.edit_pairs(pairs, LIMIT).select("doc_id", "first_id", "distance")


def _rate_sql(k: int) -> str:
    states, grams = 4**k, 4 ** (k + 1)
    letter = lambda at: f"substr('acgt', i // {4**at} % 4 + 1, 1)"
    return f"""
    n{k} AS (SELECT gram, count(*) AS n FROM (SELECT substr(seq, CAST(unnest(generate_series(1, length(seq) - {k})) AS INTEGER), {k + 1}) AS gram FROM seqs WHERE length(seq) > {k}) GROUP BY 1),
    a{k} AS (SELECT i, coalesce(n, 0) AS n FROM (SELECT i, {" || ".join(letter(at) for at in range(k, -1, -1))} AS gram FROM range({grams}) t(i)) LEFT JOIN n{k} USING (gram)),
    p{k} AS (SELECT list(p ORDER BY i) AS p FROM (SELECT i, (n + 1) / (sum(n) OVER (PARTITION BY i // 4) + 4) AS p FROM a{k})),
    w{k} AS (SELECT 0 AS step, list_transform(range({states}), lambda t: 1.0::DOUBLE / {states}) AS w, p FROM p{k} UNION ALL
        SELECT step + 1, list_transform(range({states}), lambda t: list_sum(list_transform(range(4), lambda a: w[a * {states // 4} + t // 4 + 1] * p[4 * (a * {states // 4} + t // 4) + t % 4 + 1]))), p FROM w{k} WHERE step < 100),
    h{k} AS (SELECT w, list_transform(range({states}), lambda s: -list_sum(list_transform(p[4 * s + 1 : 4 * s + 4], lambda x: x * log2(x)))) AS h FROM w{k} WHERE step = 100),
    r{k} AS (SELECT {k} AS "order", CAST({states} AS BIGINT) AS contexts, round(list_sum(list_transform(range({states}), lambda s: w[s + 1] * h[s + 1])), 6) AS bits_per_symbol, round(list_avg(h), 6) AS mean_row_bits FROM h{k})"""


@query(f"WITH RECURSIVE {SEQS}, {', '.join(map(_rate_sql, (1, 2, 3)))} SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3")
def entropy_rates(spark, sf_dir):
    """Entropy rates of models of orders 1 to 3 of the DNA letters of all documents."""
    every = written(markov.kmer_counts_by_size(seqs(spark, sf_dir), 2, 4))  # some hundred rows

    def model(k: int):
        counts = every.filter(F.col("k") == k + 1)
        return markov.predict(counts.select(F.substring("kmer", 1, k).alias("ctx"), F.substring("kmer", k + 1, 1).alias("sym"), "n"), list("acgt")).select(F.lit(k).alias("order"), "ctx", "sym", "p")

    out = generate.entropy_rates(reduce(lambda x, y: x.unionByName(y), map(model, (1, 2, 3))), list("acgt"), ["order"])
    return out.select("order", "contexts", *[F.round(c, 6).alias(c) for c in ("bits_per_symbol", "mean_row_bits")])


@query("SELECT user_id, x.ts AS ts, x.event_id AS event_id, x.event_type AS event_type, x.value AS value FROM (SELECT user_id, max({'ts': ts, 'event_id': event_id, 'event_type': event_type, 'value': value}) AS x FROM events GROUP BY 1)")
def newest_events(spark, sf_dir):
    """A view of each user's newest event, kept by a stream that reads the events in several batches."""
    folder = shared_folder(spark)
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    events.repartition(6, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    view = online.View(spark, f"{folder}/view", ["user_id"], ["ts", "event_id"], merge_every=2)
    view.follow(stream, f"{folder}/checkpoint").awaitTermination()
    return view.read()


@query()
def alignment_text(spark, sf_dir):
    """The likeliest local alignments under start parameters, written out with what lies around them."""
    pairs = met_pairs(spark, sf_dir)
    out = align.score_pairs(pairs, total=False, max_rounds=0)
    met = out.join(pairs.select("item_id", "doc_id", "seq_a", "seq_b"), ["item_id", "doc_id"])
    cols = [F.round("log_odds", 4).alias("log_odds"), F.round(align.operations(F.col("counts")), 4).alias("operations"), "cuts", "text_a", "text_b"]
    return align.shown(met).select("item_id", "doc_id", *cols)
