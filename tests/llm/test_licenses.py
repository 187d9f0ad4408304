import re

import duckdb

from bitloom.llm import licenses

D = "/root/testdata/sf0.01"


def test_equals_sql(spark):
    got = sorted(tuple(r) for r in licenses.scan(spark.read.parquet(f"{D}/documents.parquet")).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    assert got and got == sorted(con.sql(licenses.oracle()).fetchall())


def test_equivalent_forms_meet(spark):
    mit = licenses.TEXTS[0][1]
    other = "mit  LICENCE\n\nCopyright (c) 2020 Some One <a@b.c>\n\n" + licenses.TEXTS[1][1].replace('"', "'").replace("sublicense", "sub-license").lower()
    rows = [(1, mit), (2, other), (3, "text\nReleased under the MIT Licence!\nmore"), (4, "licensed under the apache license v2.0"), (5, mit + " Not really."), (6, None), (7, ""), (3, "text\nReleased under the MIT Licence!\nmore"), (8, "license " * 50_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = {(r.doc_id, r.license_id, r.unit): r.n for r in licenses.scan(docs).collect()}
    assert got[1, "MIT", "text"] == got[2, "MIT", "text"] == 1
    assert got[3, "MIT", "line"] == 2 and got[4, "Apache-2.0", "text"] == 1
    assert not any(k[0] in (6, 7, 8) or k[::2] == (5, "text") for k in got)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_every_known_text_passes_the_filter(spark):
    rows = [(i, k, t) for i, (k, t) in enumerate(licenses.known_texts())]
    assert not [t for _, _, t in rows if not re.search(licenses.ANCHOR, t)]
    noisy = lambda t: "Some words.\n>> " + t.upper().replace(" ", "\t_") + " !\nMore words."
    lines = [(i, k, t) for i, k, t in rows if "\n" not in t]
    docs = spark.createDataFrame([(i, noisy(t)) for i, _, t in lines], "doc_id long, text string")
    assert {r.doc_id for r in licenses.scan(docs).filter("unit = 'line'").collect()} == {i for i, _, _ in lines}


def test_sql_has_no_filter(spark):
    docs = spark.createDataFrame([(1, "a\nReleased under CC BY-SA 4.0."), (2, "Distributed under the GPLv3."), (3, "released the dogs"), (4, "Released-under CC0\n\nb"), (5, None), (6, f"x\n\n{licenses.TEXTS[7][1]}\n\ny")], "doc_id long, text string")
    con = duckdb.connect()
    rows = docs.union(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")).toPandas()
    con.register("documents", rows)
    got = sorted(tuple(r) for r in licenses.scan(spark.createDataFrame(rows, docs.schema)).collect())
    assert {1, 2, 4, 6} <= {r[0] for r in got} and got == sorted(con.sql(licenses.oracle()).fetchall())


def test_whole_licenses_are_found_where_they_stand(spark):
    """Every known text of several paragraphs inside a document of others, with a copyright line, wrapped lines and other marks of lists."""
    texts = [(i, k, t) for i, (k, t) in enumerate(licenses.TEXTS)]

    def inside(t):
        wrapped = "\n\n".join("\n  ".join(re.findall(r".{1,60}(?: |$)", p)) for p in t.split("\n\n"))
        return "# Project\n\nCopyright (c) 2020 Some One\n\nSome words about it.\n\n" + re.sub(r"(?m)^1\.", "* ", wrapped).replace("2. Redis", "(b) Redis") + "\n\nMore words.\n\nAnd more."

    docs = spark.createDataFrame([(i, inside(t)) for i, _, t in texts], "doc_id long, text string")
    got = {(r.doc_id, r.license_id) for r in licenses.scan(docs).collect()}
    assert {(i, k) for i, k, _ in texts} <= got
    assert all(k == licenses.TEXTS[i][0] for i, k in got)
