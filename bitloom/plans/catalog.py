"""The registered queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.operators import align, compress, generate, markov, repeats, sequences, tables
from bitloom.session import shared_folder, table, written
from bitloom.streaming import online

EVENTS = ["click", "error", "purchase", "signup", "view"]
BY = ["ts", "event_id"]
#: A population model that prefers TA and AT (fixed values of the experiments), and the uniform one.
UNIFORM = {a + b: 0.25 for a in "acgt" for b in "acgt"}
TA_RICH = {a + b: p for a, row in {"a": (0.09, 0.01, 0.01, 0.89), "c": (0.25, 0.25, 0.25, 0.25), "g": (0.25, 0.25, 0.25, 0.25), "t": (0.89, 0.01, 0.01, 0.09)}.items() for b, p in zip("acgt", row, strict=True)}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SEQS = "seqs AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^acgt]', '', 'g') AS seq FROM documents)"
STEPS = "steps AS (SELECT event_id, user_id, ts, event_type AS sym, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ctx FROM events)"


def grams_sql(k: int, name: str = "grams") -> str:
    return f"{name} AS (SELECT doc_id, CAST(pos AS INTEGER) - 1 AS pos, substr(seq, CAST(pos AS INTEGER), {k}) AS gram FROM (SELECT doc_id, seq, unnest(generate_series(1, length(seq) - {k - 1})) AS pos FROM seqs WHERE length(seq) >= {k}))"


def query(oracle: str | None = None, name: str = ""):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLE_SQL[name or f.__name__] = oracle
        return f

    return add


def seqs(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """DNA letters of a text table."""
    return sequences.project(table(spark, sf_dir, name).select(key, "text")).select(key, "seq")


@query(f"WITH {SEQS}, {grams_sql(4)} SELECT gram AS kmer, count(*) AS n FROM grams GROUP BY 1")
def kmer_counts_k4(spark, sf_dir):
    return markov.kmer_counts(seqs(spark, sf_dir), 4)


def _fitted(order: int):
    oracle = f"""
        WITH {SEQS}, {grams_sql(order + 1)}, c AS (SELECT doc_id, substr(gram, 1, {order}) AS ctx, gram, count(*) AS n FROM grams GROUP BY ALL),
        t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id, ctx) AS BIGINT) AS total FROM c),
        b AS (SELECT doc_id, sum(n * -log2((n + 1) / (total + 4))) AS bits FROM t GROUP BY 1)
        SELECT doc_id, length(seq) AS length, round(coalesce(bits, 0) + least(length(seq), {order}) * 2, 4) AS bits FROM seqs LEFT JOIN b USING (doc_id)"""

    @query(oracle, f"markov_fitted_bits_k{order}")
    def run(spark, sf_dir):
        return markov.fitted_bits(seqs(spark, sf_dir), "doc_id", order).withColumn("bits", F.round("bits", 4))

    return run


for _k in (0, 1, 2):
    _fitted(_k)


def _adaptive_sql(order: int) -> str:
    return f"""{grams_sql(order + 1, f"g{order}")}, a{order} AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, gram ORDER BY pos) AS nth, row_number() OVER (PARTITION BY doc_id, substr(gram, 1, {order}) ORDER BY pos) AS mth FROM g{order}),
        b{order} AS (SELECT doc_id, sum(-log2(nth / (mth + 3))) AS bits FROM a{order} GROUP BY 1),
        r{order} AS (SELECT doc_id, length(seq) AS length, coalesce(bits, 0) + least(length(seq), {order}) * 2 AS bits FROM seqs LEFT JOIN b{order} USING (doc_id))"""


@query(f"WITH {SEQS}, {_adaptive_sql(1)} SELECT doc_id, length, round(bits, 4) AS bits FROM r1")
def markov_adaptive_bits_k1(spark, sf_dir):
    return markov.adaptive_bits(seqs(spark, sf_dir), "doc_id", 1).withColumn("bits", F.round("bits", 4))


@query(
    f"WITH {SEQS}, {', '.join(_adaptive_sql(k) for k in range(4))}, o AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, CAST(sum(length) AS BIGINT) AS length, sum(bits) AS bits FROM r{k}" for k in range(4))
    + ') SELECT CAST(k AS INTEGER) AS "order", length, round(bits, 2) AS bits, round(bits / length, 6) AS bits_per_symbol, round(2 * length - bits, 2) AS saving FROM o'
)
def entropy_by_order(spark, sf_dir):
    out = markov.entropy_by_order(seqs(spark, sf_dir), "doc_id", range(4))
    return out.select("order", "length", F.round("bits", 2).alias("bits"), F.round("bits_per_symbol", 6).alias("bits_per_symbol"), F.round("saving", 2).alias("saving"))


@query(f"""
    WITH {STEPS}, c AS (SELECT user_id, ctx, sym, count(*) AS n FROM steps WHERE ctx IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id, ctx) AS total FROM c)
    SELECT user_id, CAST(sum(n) AS BIGINT) AS n, round(sum(n * -log2((n + 1) / (total + 5))), 4) AS bits FROM t GROUP BY 1""")
def event_markov_bits(spark, sf_dir):
    c = markov.event_counts(table(spark, sf_dir, "events"), "user_id", BY, "event_type")
    from pyspark.sql import Window

    c = c.withColumn("total", F.sum("n").over(Window.partitionBy("user_id", "ctx")))
    return c.groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * -F.log2((F.col("n") + 1) / (F.col("total") + 5))), 4).alias("bits")).withColumnRenamed("total", "n")


@query(f"""
    WITH {STEPS}, c AS (SELECT ctx, sym, count(*) AS n FROM steps WHERE ctx IS NOT NULL GROUP BY ALL), t AS (SELECT ctx, sum(n) AS total FROM c GROUP BY 1),
    s AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS sym)
    SELECT t.ctx, s.sym, CAST(coalesce(n, 0) AS BIGINT) AS n, round((coalesce(n, 0) + 1) / (total + 5), 6) AS p FROM t CROSS JOIN s LEFT JOIN c ON c.ctx = t.ctx AND c.sym = s.sym""")
def next_symbol_probs(spark, sf_dir):
    counts = markov.event_counts(table(spark, sf_dir, "events"), "user_id", BY, "event_type")
    return markov.predict(counts, EVENTS).withColumn("p", F.round("p", 6))


@query(f"""
    WITH {STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, ctx, sym ORDER BY ts, event_id) - 1 AS a, row_number() OVER (PARTITION BY user_id, ctx ORDER BY ts, event_id) - 1 AS b FROM steps),
    c AS (SELECT *, CASE WHEN ctx IS NULL THEN log2(5) ELSE -log2((1 + a) / (b + 5)) END AS bits FROM r)
    SELECT event_id, user_id, round(bits, 4) AS bits, round(sum(bits) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS cum FROM c""")
def cum_bits(spark, sf_dir):
    out = markov.running_bits(table(spark, sf_dir, "events"), "user_id", BY, "event_type", 5)
    return out.select("event_id", "user_id", F.round("bits", 4).alias("bits"), F.round("cum", 4).alias("cum"))


@query(f"""
    WITH {SEQS}, {grams_sql(2)}, m AS (SELECT substr(gram, 1, 1) AS ctx, gram, count(*) AS n FROM grams GROUP BY ALL), p AS (SELECT gram, (n + 1) / (sum(n) OVER (PARTITION BY ctx) + 4) AS p FROM m),
    b AS (SELECT doc_id, sum(n * -log2(p)) AS bits FROM (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY ALL) JOIN p USING (gram) GROUP BY 1)
    SELECT doc_id, length(seq) AS length, round(coalesce(bits, 0) + least(length(seq), 1) * 2, 4) AS bits FROM seqs LEFT JOIN b USING (doc_id)""")
def cross_entropy_k1(spark, sf_dir):
    s = seqs(spark, sf_dir)
    model = markov.predict(markov.gram_counts(s, "doc_id", 1), list(sequences.DNA))
    return markov.cross_entropy(s, model, "doc_id", 1).withColumn("bits", F.round("bits", 4))


def _blend(name: str, decay: float):
    # evidence older than 200 symbols weighs less than a double can tell
    rich = ", ".join(f"('{g}', {-math.log2(p)})" for g, p in TA_RICH.items())
    oracle = f"""
        WITH {SEQS}, {grams_sql(2)}, rich AS (SELECT * FROM (VALUES {rich}) v(gram, cost)), e AS (SELECT doc_id, pos, cost FROM grams JOIN rich USING (gram)),
        old AS (SELECT e.doc_id, e.pos + k AS pos, sum(cost / pow({decay}, k)) AS m1, sum(2 / pow({decay}, k)) AS m0 FROM e, range(1, 201) t(k) GROUP BY ALL),
        m AS (SELECT e.doc_id, cost, coalesce(m0, 0) + pow({decay}, -e.pos) AS m0, coalesce(m1, 0) + pow({decay}, -e.pos) AS m1 FROM e LEFT JOIN old USING (doc_id, pos)),
        b AS (SELECT doc_id, sum(-log2((pow(2, -m0 - 2) + pow(2, -m1 - cost)) / (pow(2, -m0) + pow(2, -m1)))) AS bits FROM m GROUP BY 1)
        SELECT doc_id, length(seq) AS length, round(coalesce(bits, 0) + least(length(seq), 1) * 2, 4) AS bits FROM seqs LEFT JOIN b USING (doc_id)"""

    @query(oracle, name)
    def run(spark, sf_dir):
        return markov.blend_bits(seqs(spark, sf_dir), "doc_id", [UNIFORM, TA_RICH], decay).withColumn("bits", F.round("bits", 4))

    return run


_blend("blend_bits", 1.5)
_blend("blend_bits_slow", 1.8)


_RC = "reverse(translate({}, 'acgt', 'tgca'))"


@query(f"WITH {SEQS}, {grams_sql(12)}, c AS (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY ALL) SELECT doc_id, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS n FROM c GROUP BY 1")
def repeat_count_fwd(spark, sf_dir):
    return repeats.repeat_counts(seqs(spark, sf_dir), "doc_id", 12)


@query(f"""
    WITH {SEQS}, {grams_sql(8)}, c AS (SELECT doc_id, gram, {_RC.format('gram')} AS rc, count(*) AS n FROM grams GROUP BY ALL)
    SELECT x.doc_id, CAST(sum(CASE WHEN x.gram = x.rc THEN x.n * (x.n - 1) / 2 WHEN x.gram < x.rc THEN x.n * coalesce(y.n, 0) ELSE 0 END) AS BIGINT) AS n
    FROM c x LEFT JOIN c y ON x.doc_id = y.doc_id AND x.rc = y.gram GROUP BY 1""")
def repeat_count_rev(spark, sf_dir):
    return repeats.repeat_counts(seqs(spark, sf_dir), "doc_id", 8, inverted=True)


@query(f"""
    WITH {SEQS}, {grams_sql(20)}, items AS (SELECT item_id AS doc_id, regexp_replace(lower(coalesce(text, '')), '[^acgt]', '', 'g') AS seq FROM benchmark),
    {grams_sql(20, 'bg').replace('FROM seqs', 'FROM items')}, a AS (SELECT doc_id AS item_id, gram, count(*) AS n FROM bg GROUP BY ALL), b AS (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY ALL)
    SELECT item_id, doc_id, count(*) AS n_kmers, CAST(sum(a.n * b.n) AS BIGINT) AS n_pairs FROM a JOIN b USING (gram) GROUP BY ALL""")
def repeat_pairs_cross(spark, sf_dir):
    return repeats.shared_kmers(seqs(spark, sf_dir, "benchmark", "item_id"), seqs(spark, sf_dir), "item_id", "doc_id", 20)


_HITS = f"{SEQS}, {grams_sql(12)}, near AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id, gram ORDER BY pos) AS earlier FROM grams), bands AS (SELECT doc_id, pos, earlier, greatest(0, earlier - 10) AS \"start\", least(pos, earlier + 11) AS \"end\" FROM near WHERE earlier IS NOT NULL)"


@query(f"WITH {_HITS} SELECT * FROM bands")
def active_bands(spark, sf_dir):
    return repeats.bands(repeats.nearest_repeats(seqs(spark, sf_dir), "doc_id", 12), 10)


@query(f"""
    WITH {_HITS}, r AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bands),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT doc_id, min("start") AS "start", max("end") AS "end", count(*) AS n FROM i GROUP BY doc_id, island""")
def merged_bands(spark, sf_dir):
    return repeats.merge_intervals(active_bands(spark, sf_dir), "doc_id")


@query(f"WITH {SEQS} SELECT doc_id, {_RC.format('seq')} AS rc FROM seqs")
def revcomp(spark, sf_dir):
    return seqs(spark, sf_dir).select("doc_id", sequences.reverse_complement(F.col("seq")).alias("rc"))


@query(
    "WITH s AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^acgturykmswbdhvn]', '', 'g') AS seq FROM documents), p AS (SELECT doc_id, pos - 1 AS pos, substr(seq, CAST(pos AS INTEGER), 1) AS code FROM (SELECT doc_id, seq, unnest(generate_series(1, length(seq))) AS pos FROM s WHERE length(seq) > 0)),"
    " m AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sequences.IUPAC.items()) + ") v(code, members))"
    " SELECT code, substr(members, CAST(CAST('0x' || substr(md5(doc_id || ':' || pos), 1, 4) AS INTEGER) % length(members) AS INTEGER) + 1, 1) AS pick, count(*) AS n FROM p JOIN m USING (code) GROUP BY ALL"
)
def iupac_resolve(spark, sf_dir):
    s = sequences.project(table(spark, sf_dir, "documents").select("doc_id", "text"), alphabet="acgturykmswbdhvn")
    return sequences.resolve_ambiguous(s, "doc_id").groupBy("code", "pick").agg(F.count("*").alias("n"))


def _smooth(at: str):
    frame = "ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING" if at == "start" else "ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"
    oracle = f"""
        WITH w AS (SELECT event_id, user_id, value, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id {frame}))
        SELECT event_id, user_id, round(CASE WHEN n = 5 THEN m ELSE value END, 4) AS raw, round(m, 4) AS partial, round(CASE WHEN n = 5 THEN m END, 4) AS dropped FROM w"""

    @query(oracle, f"smooth_{at}")
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
        one = tables.smooth(e, "user_id", BY, "value", 5, at, "raw", "raw")
        two = tables.smooth(one, "user_id", BY, "value", 5, at, "partial", "partial")
        full = tables.smooth(e, "user_id", BY, "value", 5, at, "drop", "dropped").select("event_id", "dropped")
        return two.join(full, "event_id", "left").select("event_id", "user_id", *[F.round(c, 4).alias(c) for c in ("raw", "partial", "dropped")])

    return run


_smooth("start")
_smooth("end")

_SCORED = f"""{SEQS}, {grams_sql(1)}, c AS (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM c),
    b AS (SELECT doc_id, round(sum(n * -log2((n + 1) / (total + 4))), 3) AS score FROM t GROUP BY 1), x AS (SELECT l.doc_id, coalesce(score, 0.0) AS score, toxic = 1 AS truth FROM labels l JOIN seqs USING (doc_id) LEFT JOIN b USING (doc_id))"""


def _scored(spark, sf_dir):
    scored = markov.fitted_bits(seqs(spark, sf_dir), "doc_id", 0).select("doc_id", F.round("bits", 3).alias("score"))
    return table(spark, sf_dir, "labels").join(scored, "doc_id").select("doc_id", "score", (F.col("toxic") == 1).alias("truth"))


@query(f"""
    WITH {_SCORED}, r AS (SELECT *, CAST(sum(CAST(truth AS BIGINT)) OVER w AS BIGINT) AS tp, CAST(sum(1 - CAST(truth AS BIGINT)) OVER w AS BIGINT) AS fp FROM x WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))
    SELECT doc_id, tp, fp, round(tp / greatest(1, sum(CAST(truth AS BIGINT)) OVER ()), 6) AS coverage, round(fp / greatest(1, sum(1 - CAST(truth AS BIGINT)) OVER ()), 6) AS errors FROM r""")
def roc_curve(spark, sf_dir):
    out = tables.roc(_scored(spark, sf_dir), "score", "truth", "doc_id")
    return out.select("doc_id", "tp", "fp", F.round("coverage", 6).alias("coverage"), F.round("errors", 6).alias("errors"))


@query(f"WITH {_SCORED} SELECT count(*) FILTER (score > 500 AND truth) AS tp, count(*) FILTER (score > 500 AND NOT truth) AS fp, count(*) FILTER (score <= 500 AND truth) AS fn, count(*) FILTER (score <= 500 AND NOT truth) AS tn FROM x")
def tp_fp_at_cutoff(spark, sf_dir):
    return tables.confusion_at(_scored(spark, sf_dir), "score", "truth", 500.0)


@query("""
    SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS by_price, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS by_customer, row_number() OVER (ORDER BY o_orderkey) - 1 AS by_key FROM orders""")
def ranks3(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    out = tables.ranks(o, "o_orderkey", {"by_price": ("o_totalprice", False), "by_customer": ("o_custkey", True), "by_key": ("o_orderkey", True)})
    return out.select("o_orderkey", "by_price", "by_customer", "by_key")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def topk_cutoff(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity <= 10")
def flatten_hits(spark, sf_dir):
    nested = tables.nest(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], "lines")
    both = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(nested, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    return tables.flatten_hits(both, "lines").filter("l_quantity <= 10")


@query("""
    WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer)
    SELECT place, o_orderkey, c_custkey, coalesce(o_orderkey = c_custkey, false) AS same FROM a LEFT JOIN b USING (place)""")
def positional_merge(spark, sf_dir):
    left, right = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "customer").select("c_custkey")
    return tables.positional_merge(left, right, "o_orderkey", "c_custkey").select("place", "o_orderkey", "c_custkey", F.coalesce(F.col("o_orderkey") == F.col("c_custkey"), F.lit(False)).alias("same"))


@query("""
    WITH m AS (SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS last_order FROM orders GROUP BY 1) SELECT c_custkey, c_nationkey, last_order FROM customer LEFT JOIN m ON c_custkey = o_custkey""")
def latest_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"))
    return tables.latest_lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), orders, ["c_custkey"], "last_order")


@query("""
    WITH s AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM s)
    SELECT user_id, run, event_type, count(*) AS n, round(avg(value), 4) AS mean, round(min(value), 4) AS low, round(max(value), 4) AS high FROM r GROUP BY ALL""")
def run_stats(spark, sf_dir):
    out = tables.run_stats(table(spark, sf_dir, "events"), "user_id", BY, "event_type", "value")
    return out.select("user_id", "run", "event_type", "n", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


@query("SELECT sign(value) * floor(abs(value) * 2 + 0.5) / 2 + 0.0 AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram(spark, sf_dir):
    return tables.histogram(table(spark, sf_dir, "events"), "value", 2)


@query("SELECT event_type, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd FROM events GROUP BY 1")
def fit_gauss(spark, sf_dir):
    return tables.fit_gauss(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query("SELECT CAST(floor(o_custkey * 0.1) AS BIGINT) AS row_bin, CAST(floor(extract('day' FROM o_orderdate) * 0.1) AS BIGINT) AS col_bin, max(CAST(o_orderkey % 256 AS INTEGER)) AS red FROM orders GROUP BY ALL")
def image_bins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.dayofmonth("o_orderdate").alias("day"), (F.col("o_orderkey") % 256).cast("int").alias("red"))
    return tables.image_bins(o, "o_custkey", "day", 0.1, ["red"])


@query("""
    SELECT p_partkey, round(0.5 * log2(1 + (p_size / 0.25) / 0.5 / 4 / 144) + log2(exp(1)), 6) AS cost3, round(0.5 * log2(1 + (1 / 0.9) / 12) + 0.5 * log2(exp(1)), 6) AS cost2 FROM part""")
def mml_cost(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    half, quarter = F.lit(0.5), F.lit(0.25)
    return p.select("p_partkey", F.round(B.mml_cost([half, quarter, quarter], F.col("p_size")), 6).alias("cost3"), F.round(B.mml_cost([F.lit(0.9), F.lit(0.1)], F.col("p_size")), 6).alias("cost2"))


_L = lambda x: f"CASE WHEN {x} > 1 THEN log2(CASE WHEN {x} > 1 THEN {x} ELSE 1 END) ELSE 0 END"


@query(
    "WITH a AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x0 FROM part), "
    + ", ".join(f"{chr(98 + i)} AS (SELECT *, {_L(f'x{i}')} AS x{i + 1} FROM {chr(97 + i)})" for i in range(6))
    + " SELECT p_partkey, round(log2(2.865) + x1 + x2 + x3 + x4 + x5 + x6, 6) AS bits FROM g"
)
def logstar(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(B.logstar(F.col("p_size")), 6).alias("bits"))


@query("SELECT p_partkey, round(2 * log2(least(p_size, length(p_name))) - 1 + log2(greatest(p_size, length(p_name))), 6) AS bits, round(log2(p_size + 1), 6) AS start_bits FROM part")
def position_cost(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(B.align_position(F.col("p_size"), F.char_length("p_name")), 6).alias("bits"), F.round(B.start_position(F.col("p_size")), 6).alias("start_bits"))


@query("SELECT a.p_partkey, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def edit_distance(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(nxt, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").alias("distance"))


def met_pairs(spark, sf_dir):
    """Benchmark items and documents that share a 20-mer of DNA letters; of items with fewer letters, those that a document holds whole."""
    a, b = seqs(spark, sf_dir, "benchmark", "item_id"), written(seqs(spark, sf_dir).filter("seq <> ''"))  # read three times
    met = repeats.met_pairs(a, b, "item_id", "doc_id", 20)
    return met.join(a.withColumnRenamed("seq", "seq_a"), "item_id").join(b.withColumnRenamed("seq", "seq_b"), "doc_id")


def _aligned(name: str, **options):
    @query(name=name)
    def run(spark, sf_dir):
        out = align.score_pairs(met_pairs(spark, sf_dir), **options)
        bits = [F.round(c, 4).alias(c) for c in ("log_odds", "enc_null", "enc_align", "enc_model")]
        events = ("match", "change", *align.NAMES)
        told = [F.round(F.col(x)[e], 4).alias(f"{y}_{e}") for x, y in (("params", "p"), ("counts", "n")) for e in events]
        return out.select("item_id", "doc_id", *bits, "rounds", *told, "a_start", "a_end", "b_start", "b_end", "row_a", "row_b", (F.col("log_odds") > 0).alias("related"))

    return run


_aligned("m_align_local_sum")
_aligned("m_align_local_best", total=False)
_aligned("m_align_local_best_linear", total=False, states=1)
_aligned("m_align_global_sum", local=False)
_aligned("m_align_global_best", local=False, total=False)


#: Items and documents that meet, with their letters as numbers, and what a pair of letters costs beside match or change, by 4 * a + b + 1.
MET_SQL = f"""
    {SEQS}, {grams_sql(20)}, items AS (SELECT item_id, regexp_replace(lower(coalesce(text, '')), '[^acgt]', '', 'g') AS seq FROM benchmark),
    bg AS (SELECT item_id, substr(seq, CAST(pos AS INTEGER), 20) AS gram FROM (SELECT item_id, seq, unnest(generate_series(1, length(seq) - 19)) AS pos FROM items WHERE length(seq) >= 20)),
    met AS (SELECT DISTINCT item_id, doc_id FROM bg JOIN grams USING (gram) UNION SELECT item_id, doc_id FROM items i JOIN seqs s ON length(i.seq) BETWEEN 1 AND 19 AND contains(s.seq, i.seq)),
    coded AS (SELECT item_id, doc_id, length(i.seq) AS n, length(s.seq) AS m, list_transform(string_split(i.seq, ''), lambda c: instr('acgt', c) - 1) AS a, list_transform(string_split(s.seq, ''), lambda c: instr('acgt', c) - 1) AS b,
        list_transform(['a', 'c', 'g', 't'], lambda c: (length(i.seq) - length(replace(i.seq, c, '')) + 1) / (length(i.seq) + 4)) AS pa, list_transform(['a', 'c', 'g', 't'], lambda c: (length(s.seq) - length(replace(s.seq, c, '')) + 1) / (length(s.seq) + 4)) AS pb
        FROM met JOIN items i USING (item_id) JOIN seqs s USING (doc_id))"""


def recurrence_sql(cost: dict[str, float], local: bool, total: bool, cell: str = "sub[4 * a[i] + b[d + 1 - i] + 1]") -> str:
    """The alignment recurrence as a recursive query: a row for each pair and anti-diagonal, with lists of the three states' values.

    ``cell``: what a pair of letters costs, out of the list ``sub`` that goes along. Result: met pairs (item_id, doc_id) with ``best``.
    """
    none = "CAST('-infinity' AS DOUBLE)"

    def either(*xs: str) -> str:
        if not total:
            return f"greatest({', '.join(xs)})"
        out = xs[0]
        for x in xs[1:]:
            out = f"either({out}, {x})"
        return out

    before, into = "i >= 1 AND d + 1 - i >= 1 AND d + 1 - i <= m", "d + 1 - i >= 0 AND d + 1 - i <= m"
    start = "0.0" if local else none
    diagonal = either(f"b0[i] - {cost['diag_fromD']}", f"b1[i] - {cost['diag_fromI']}", f"b2[i] - {cost['diag_fromI']}") + f" - {cell}"
    new0 = f"CASE WHEN {before} THEN {either(start, diagonal)} WHEN {into} THEN {start} ELSE {none} END"
    gap = lambda own, other, at: either(f"a0[{at}] - {cost['start_fromD']}", f"a{own}[{at}] - {cost['cont_fromI']}", f"a{other}[{at}] - {cost['start_fromI']}")
    new1 = f"CASE WHEN i >= 1 AND {into} THEN {gap(1, 2, 'i')} ELSE {none} END"
    new2 = f"CASE WHEN d + 1 - i >= 1 AND d + 1 - i <= m THEN {gap(2, 1, 'i + 1')} ELSE {none} END"
    each = lambda x: f"list_transform(range(n + 1), lambda i: {x})"
    nothing = f"list_transform(range(n + 1), lambda i: {none})"
    first = f"list_transform(range(n + 1), lambda i: CASE WHEN i = 0 THEN 0.0 ELSE {none} END)"
    top = "list_max(list_concat(a0, a1, a2))"
    whole = f"CASE WHEN {top} = {none} THEN {none} ELSE {top} + log2(list_sum(list_transform(list_concat(a0, a1, a2), lambda x: pow(2, x - {top})))) END" if total else top
    ends = either("a0[n + 1]", "a1[n + 1]", "a2[n + 1]")
    return f"""
        steps AS (
            SELECT item_id, doc_id, n, m, a, b, sub, 0 AS d, {first} AS a0, {nothing} AS a1, {nothing} AS a2, {nothing} AS b0, {nothing} AS b1, {nothing} AS b2 FROM ready
            UNION ALL
            SELECT item_id, doc_id, n, m, a, b, sub, d + 1, {each(new0)}, {each(new1)}, {each(new2)}, a0, a1, a2 FROM steps WHERE d < n + m),
        scored AS (SELECT item_id, doc_id, d, n, m, {whole if local else ends} AS v FROM steps{'' if local else ' WHERE d = n + m'}),
        done AS (SELECT item_id, doc_id, {'max(v) + log2(sum(pow(2, v - top)))' if local and total else 'max(v)'} AS best FROM (SELECT *, max(v) OVER (PARTITION BY item_id, doc_id) AS top FROM scored) GROUP BY item_id, doc_id{', top' if local and total else ''})"""


def written_out(body: str) -> str:
    """``body`` with its macro either(x, y) written out, from the inside."""
    while "either(" in body:
        at = body.rindex("either(")
        depth, cut, end = 0, None, at + 7
        while depth or body[end] != ")":
            depth += (body[end] in "([") - (body[end] in ")]")
            cut = end if body[end] == "," and not depth and cut is None else cut
            end += 1
        x, y = body[at + 7 : cut], body[cut + 1 : end]
        body = body[:at] + f"list_reduce([{x}, {y}], lambda p, q: CASE WHEN p = CAST('-infinity' AS DOUBLE) THEN q WHEN q = CAST('-infinity' AS DOUBLE) THEN p ELSE greatest(p, q) + log2(1 + pow(2, -abs(p - q))) END)" + body[end + 1 :]
    return body


def _odds(local: bool, total: bool, states: int):
    """Log odds under the start parameters: the recurrences of one and three states, sum and best, local and global, against SQL."""
    sub = f"list_transform(range(16), lambda k: CASE WHEN k // 4 = k % 4 THEN 1 - log2(1 / pa[k // 4 + 1] + 1 / pb[k % 4 + 1]) + {align.PAIR['match']} ELSE 1 - log2(1 / (1 - pa[k % 4 + 1]) + 1 / (1 - pb[k // 4 + 1])) + {align.PAIR['change']} END)"
    body = written_out(recurrence_sql(align.AFFINE if states == 3 else align.LINEAR, local, total))
    name = f"align_odds_{'local' if local else 'global'}_{'sum' if total else 'best'}_{states}"

    @query(f"WITH RECURSIVE {MET_SQL}, ready AS (SELECT *, {sub} AS sub FROM coded), {body} SELECT item_id, doc_id, round(best, 4) AS log_odds FROM done", name)
    def run(spark, sf_dir):
        return align.odds_of_pairs(met_pairs(spark, sf_dir), local=local, total=total, states=states).withColumn("log_odds", F.round("log_odds", 4))

    return run


for _states in (1, 3):
    for _local in (True, False):
        for _total in (True, False):
            _odds(_local, _total, _states)


@query(
    f"WITH RECURSIVE {MET_SQL}, ready AS (SELECT *, list_transform(range(16), lambda k: CASE WHEN k // 4 = k % 4 THEN -5 ELSE 4 END) AS sub FROM coded), "
    + recurrence_sql({"diag_fromD": 0, "start_fromD": 16, "diag_fromI": 0, "start_fromI": 16, "cont_fromI": 4}, True, False)
    + " SELECT item_id, doc_id, CAST(best AS INTEGER) AS score FROM done"
)
def sw_score(spark, sf_dir):
    return align.sw_pairs(met_pairs(spark, sf_dir))


def _event_strings(spark, sf_dir):
    """One symbol string per user: the events in order, each as one letter."""
    e = table(spark, sf_dir, "events")
    letter = F.substring("event_type", 1, 1)
    rows = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", letter.alias("s")))).alias("rows"))
    return rows.select("user_id", F.array_join(F.transform("rows", lambda r: r["s"]), "").alias("seq"))


@query()
def repeat_compress(spark, sf_dir):
    out = compress.compress(_event_strings(spark, sf_dir), "user_id", alphabet="cepsv", reverse=())
    return out.withColumn("bits", F.round("bits", 4))


@query()
def conditional_compress(spark, sf_dir):
    """The second half of each user's events, the first half being known."""
    half = F.floor(F.char_length("seq") / 2).cast("int")
    cut = _event_strings(spark, sf_dir).select("user_id", F.substring("seq", F.lit(1), half).alias("pre"), F.substring("seq", half + 1, F.char_length("seq")).alias("seq"))
    return compress.compress(cut, "user_id", prefix="pre", alphabet="cepsv", reverse=()).withColumn("bits", F.round("bits", 4))


@query("""
    WITH RECURSIVE q AS (SELECT user_id, list(instr('cepsv', substr(event_type, 1, 1)) ORDER BY ts, event_id) AS q FROM events GROUP BY 1),
    steps AS (
        SELECT user_id, q, 1 AS i, log2(5) AS bits, list_transform(range(25), lambda j: 1) AS k FROM q
        UNION ALL
        SELECT user_id, q, i + 1, bits - log2(k[5 * q[i] - 5 + q[i + 1]] / list_sum(k[5 * q[i] - 4 : 5 * q[i]])),
            list_transform(range(25), lambda j: CASE WHEN j // 5 <> q[i] - 1 THEN k[j + 1] WHEN list_sum(k[5 * q[i] - 4 : 5 * q[i]]) + 1 < 16 THEN k[j + 1] + CAST(j % 5 = q[i + 1] - 1 AS INTEGER) ELSE greatest(1, (k[j + 1] + CAST(j % 5 = q[i + 1] - 1 AS INTEGER)) // 2) END)
        FROM steps WHERE i < len(q))
    SELECT user_id, len(q) AS length, round(bits, 4) AS bits FROM steps WHERE i = len(q)""")
def fading_bits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", *BY, F.substring("event_type", 1, 1).alias("s"))
    return generate.fading_event_bits(e, "user_id", BY, "s", 1, 16, "cepsv").withColumn("bits", F.round("bits", 4))


@query(f"""
    WITH RECURSIVE {STEPS}, c AS (SELECT ctx, sym, count(*) AS n FROM steps WHERE ctx IS NOT NULL GROUP BY ALL), s AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS sym), g AS (SELECT a.sym AS ctx, b.sym FROM s a CROSS JOIN s b),
    p AS (SELECT g.ctx, g.sym, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER (PARTITION BY g.ctx) + 5) AS p FROM g LEFT JOIN c USING (ctx, sym)),
    t AS (SELECT list(p ORDER BY ctx, sym) AS p FROM p),
    walk AS (SELECT 0 AS i, [0.2, 0.2, 0.2, 0.2, 0.2] AS w, p FROM t UNION ALL SELECT i + 1, list_transform(range(5), lambda k: list_sum(list_transform(range(5), lambda j: w[j + 1] * p[5 * j + k + 1]))), p FROM walk WHERE i < 400),
    h AS (SELECT w, list_transform(range(5), lambda j: -list_sum(list_transform(p[5 * j + 1 : 5 * j + 5], lambda x: x * log2(x)))) AS h FROM walk WHERE i = 400)
    SELECT round(list_sum(list_transform(range(5), lambda j: w[j + 1] * h[j + 1])), 6) AS bits_per_symbol, round(list_avg(h), 6) AS mean_row_bits FROM h""")
def entropy_rate(spark, sf_dir):
    counts = markov.event_counts(table(spark, sf_dir, "events"), "user_id", BY, "event_type")
    out = generate.entropy_rate_of(markov.predict(counts, EVENTS), EVENTS)
    return out.select(F.round("bits_per_symbol", 6).alias("bits_per_symbol"), F.round("mean_row_bits", 6).alias("mean_row_bits"))


@query()
def population_roc(spark, sf_dir):
    """Children mutated from benchmark sequences, each scored against every benchmark sequence; truth says whether that is its parent."""
    parents = seqs(spark, sf_dir, "benchmark", "item_id").filter("seq <> ''")
    kids = generate.population(parents, "item_id", [5, 10, 20])
    grid = kids.select("parent", "child", "mutates", F.col("seq").alias("seq_b")).crossJoin(parents.withColumnRenamed("seq", "seq_a"))
    scored = align.score_pairs(grid.withColumn("truth", F.col("parent") == F.col("item_id")))
    scored = scored.withColumn("id", F.concat_ws(":", "parent", "child", "item_id")).withColumn("log_odds", F.round("log_odds", 4))
    kept = written(scored.select("id", "parent", "child", "mutates", "truth", "log_odds"))  # several passes follow; the alignments are made once
    return tables.roc(kept, "log_odds", "truth", "id")


@query(ORACLE_SQL["cum_bits"].replace("SELECT event_id", "SELECT event_type, event_id").replace("ctx FROM events)", "ctx, event_type FROM events)").replace("SELECT event_type, event_id, user_id, ts", "SELECT event_id, user_id, ts"))
def stream_event_bits(spark, sf_dir):
    """The online form of cum_bits: events as a stream, state per user, every row of the input in one run."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    folder = shared_folder(spark)
    events.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    online.write(online.stream_bits(stream, "user_id", BY, "event_type", EVENTS), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select("event_id", "user_id", "event_type", F.round("bits", 4).alias("bits"), F.round("cum", 4).alias("cum"))
