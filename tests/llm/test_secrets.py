import hashlib
import random
import re

import pytest

from pagewright.llm import secrets as S

KEY = "qX7rT2mN9pL4"


def base(text):
    """The three patterns by scanning character by character, without the package's expressions."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value, lower = letters + "0123456789+/_.=-", "".join(chr(c + 32) if 65 <= c <= 90 else chr(c) for c in map(ord, text))
    out, i = [], 0
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not lower.startswith(word, i):
                continue
            at = i + len(word)
            for quotes in ("\"'", ""):
                a = at + (a_quote := bool(quotes and text[at:at + 1] and text[at] in quotes))
                if quotes and not a_quote:
                    continue
                while text[a:a + 1] == " ":
                    a += 1
                if text[a:a + 1] not in (":", "="):
                    continue
                a += 1
                while text[a:a + 1] == " ":
                    a += 1
                if text[a:a + 1] and text[a] in "\"'":
                    a += 1
                first = a
                while text[a:a + 1] and text[a] in value:
                    a += 1
                if a > first:
                    end = (a, a - first)
                    break
            if end:
                break
        if end:
            if end[1] >= 6:
                out.append((i, 0, "assign", end[0]))
            i = end[0]
        else:
            i += 1
    for number, kind, start, rest, least in ((1, "access", "AKIA", letters[26:] + "0123456789", 20), (2, "hex", "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            a = i + len(start)
            while text.startswith(start, i) and text[a:a + 1] and text[a] in rest:
                a += 1
            if text.startswith(start, i) and a > i + len(start):
                if a - i >= least:
                    out.append((i, number, kind, a))
                i = a
            else:
                i += 1
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out)), [sum(o[2] == k for o in out) for k in ("assign", "access", "hex")]


def expect(text):
    spans, counts = base(text or "")
    return (*counts, hashlib.sha256(spans.encode()).hexdigest()), spans


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, spans string, n_hex int").repartition(3)


def check(spark, df, rows):
    got = S.find_secrets(df).collect()
    want = sorted(repr((d, *expect(t)[0])) for d, t in rows)
    assert sorted(repr(tuple(r)[:5]) for r in got) == want
    by = {}
    for d, t in rows:
        by.setdefault((d, expect(t)[0][3]), expect(t)[1])
    for r in got:  # base spans stay, in order; the rest are literals
        spans = [s for s in r["spans"].split(",") if s]
        assert ",".join(s for s in spans if not s.startswith("literal:")) == by[r["doc_id"], r["base_sha256"]]
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_base_equals_brute_force(spark):
    rng = random.Random(8)
    bits = ["password", "PassWD", "secret", "Token", "api_key", "APIKEY", "to\u212aen", "\u017fecret", "AKIA", "AKIA" + "Q7" * 8, "a1b2c3" * 4,
            "0123456789abcdef01234567", "=", ":", " = ", '"', "'", ": ", " ", "abc", "hunter22", "x+y/z_.-=", "\n", "\u00fc", "\U0001f511", "="]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 30)))) for i in range(400)]
    rows += [(None, "token=abcdef"), (None, None), (5, ""), (6, "token=abcdef"), (6, "token=abcdef"), (7, "secret: " + "k" * 300_000),
             (8, "a=" * 50_000), (9, "password" + " " * 100_000 + "= abcdefg")]
    check(spark, frame(spark, rows), rows)
    assert S.find_secrets(frame(spark, rows).limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(spark, docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def literals(text):
    return [text[s:e] for s, e in S.literal_spans(text)]


@pytest.mark.parametrize("line", [
    f'db_password = "{KEY}"', f"clientSecret: '{KEY}'", f'{{"accessToken" : "{KEY}"}}', f"export AUTH_TOKEN={KEY}", f"--private-key={KEY}",
    f"'signing_key' => '{KEY}',", f'privateKey := "{KEY}"', f'conf["db.passphrase"] = "{KEY}"', f"  pwd: {KEY}  # rotate", f'this->api->secret = `{KEY}`;'])
def test_forms_of_assignment(line):
    assert literals(line) == [KEY] and literals("a = 1\n\u00fc" + line + "\nb: 2") == [KEY]


@pytest.mark.parametrize("line", [
    f'colour = "{KEY}"', f'token_id = "{KEY}"', 'password = "changeme"', 'password = "${DB_PASSWORD}"', 'secret = "<your secret>"',
    f'if password == "{KEY}":', 'password = "two words here"', f"password = read({KEY})", "the token: it was given to them", f"https://{KEY}", 'pwd = ""'])
def test_clean_lines(line):
    assert literals(line) == []


def test_constants_are_traced():
    text = f'part = "{KEY}"\nother = "{KEY}"\nwhole = part + "Zz8kW3vB"\nDB_PASSWORD = whole\nprint(other)'
    assert literals(text) == [KEY, "Zz8kW3vB"]
    assert literals(f'db_password = settings.first\nfirst = "{KEY}"') == [KEY]  # also before it is set
    assert literals(f'a = b\nb = a\na = "{KEY}"') == []  # circles end
    assert literals(f'a = b\nb = a\nsecret = a\nb = "{KEY}"') == [KEY]


def test_odd_texts_take_linear_time():
    for text in ("a=" * 200_000, "=\"" * 100_000, "token:" * 50_000, "'" * 200_000, "x" * 500_000, "a.b-" * 100_000 + "=", "k = j\nj = k\n" * 20_000):
        assert len(literals(text)) <= 1
    assert len(S.pairs("a = b\n" * 1000)) == 1000
    assert re.fullmatch(r"[0-9a-f]{64}", S.find("")[3])
