import hashlib
import random
import re

from bitloom.llm import secrets


def brute(text):
    found = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(2)) >= 6:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return found + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]


def test_base_spans_equal_plain_regex():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(["token", "Secret", "api_key", "PASSWD", "=", ":", " ", '"', "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "ſ", "K", "-", "\n"]) for _ in range(rng.randint(0, 14)))
        assert sorted(secrets.base_spans(text)) == sorted(brute(text)), text


def texts_of(text):
    base = secrets.base_spans(text)
    return [text[a:b] for _, a, b in secrets.added_spans(text, base)]


def test_lexer_scores_names_and_propagates_constants():
    assert texts_of('db_pwd = "hunter2-Xy99!"') == ["hunter2-Xy99!"]
    assert texts_of('K = "Zx81-pq77-AA"\nother = 3\nclient.auth_key = K\n') == ["Zx81-pq77-AA"]
    assert texts_of('A = "Zx81-pq"\nB = "77-AAqq"\ncredential = A + B') == ["Zx81-pq", "77-AAqq"]
    assert texts_of('{"private_key": "q8Zt-1Lm90"}') == ["q8Zt-1Lm90"]
    assert texts_of("export SIGNING_KEY=q8Zt1Lm90aa\n") == ["q8Zt1Lm90aa"]
    assert texts_of('PWD: str = "q8Zt-1Lm90"') == ["q8Zt-1Lm90"]
    assert texts_of('title = "q8Zt-1Lm90"\ncolor: blue\nkeyboard = "q8Zt-1Lm90"') == []
    assert texts_of('pwd_file = "q8Zt-1Lm90"\npwd = "changeme"\npwd = getenv("HOME")') == []
    assert texts_of('K = "Zx81-pq77-AA"\nK = "plain words"\nauth_key = K\n') == []


def test_lexer_reads_nested_syntax():
    one = ["Zx81-kkQ9w!"]
    for text in (
        'pwd = (\n  "Zx81-kkQ9w!"\n)\n', 'pwds = ["Zx81-kkQ9w!", "plain"]', 'auth = {"value": "Zx81-kkQ9w!"}', '{"db": {"pwd": "Zx81-kkQ9w!", "port": 5432}}', 'credentials:\n  value: Zx81-kkQ9w!\n  username: bobby1\nother: 12345678a',
        "credentials:\n  - Zx81-kkQ9w!\n", 'db_pwd = os.environ.get("DB", "Zx81-kkQ9w!")', 'conn = connect(host="db", pwd="Zx81-kkQ9w!")', 'config["pwd"] = "Zx81-kkQ9w!"', 'pwd = """Zx81-kkQ9w!"""', 'db_pwd = KEY\nKEY = "Zx81-kkQ9w!"\n',
        "remark: pwd: Zx81-kkQ9w!", 'pwd := "Zx81-kkQ9w!"; other := "Zx81-kkQ9w?"', 'const user = { name: "bobby1-X",\n  pwd: `Zx81-kkQ9w!`,\n};', ':-( "\npwd = ["Zx81-kkQ9w!"]',
    ):
        assert texts_of(text) == one, text
    assert texts_of('pwd = "Zx81-" + \n  "kkQ9w!77"\n') == ["kkQ9w!77"]
    assert texts_of("credentials:\n\nname: Zx81-kkQ9w!\n") == []
    for text in ("a=" + "[" * 5000 + "]" * 5000, "[:" * 20_000, "a: (" * 5000, "x = y\n" * 5000 + 'pwd = "' + "Zx81-" * 20_000):
        assert len(texts_of(text)) <= 1


def test_rows(spark):
    texts = [None, "", "x = 1", "token = 'abcdef12'", "db_pwd = \"hunter2-Xy99!\" é AKIA" + "A" * 16, "'" * 30_000 + "=", "a=" * 60_000]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(3, texts[3], 9)], "doc_id long, text string, spans int")
    got = secrets.find(docs).toPandas()
    assert len(got) == len(texts) + 1
    for r in got.itertuples():
        base = sorted(brute(texts[r.doc_id] or ""), key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert "literal" in got.spans[4]
    assert secrets.find(docs.limit(0)).count() == 0


def test_long_texts_take_linear_time():
    import time

    def seconds(n):
        begin = time.process_time()
        one = secrets.pairs("{" + ", ".join(f'"k{i}": "v"' for i in range(n)) + "}")
        other = secrets.pairs("\n".join("a = 1" for _ in range(n)))
        assert len(one) == len(other) == n
        return time.process_time() - begin

    few, many = seconds(10_000), seconds(160_000)
    assert many < 16 * few * 2.5 + 1
