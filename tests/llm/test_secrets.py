import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from hpfunnel.llm import secrets as S
from tests.llm.helpers import SF, as_dicts, by_id, docs



def brute(text):
    """Base spans, by plain searches for each kind."""
    text = text or ""
    out = []
    pat = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]""" \
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [("assign", m.start(), m.end()) for m in re.finditer(pat, text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0]))))


AWKWARD = [
    None, "", "password=", "password=short", "password = 'abcdefghijkl'", "PassWord:\"abc+/=_.-ABCDEF0\"",
    "api_key: 0123456789abcdef0123", "apikey==aaaaaaaaaaaaaaa", "password: token: abcdefghijklmnop",
    "éé token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" x", "AKIAAKIAAKIAAKIA12", "AKIA1234567890123", "xAKIA12345678901234",
    "paſſword=abcdefghijklmnop", "toKen=abcdefghijklmnop", "\U0001f600 secret=abcdefghijklmnop",
    "0" * 15, "0" * 16, "f" * 40_000, "token\t=abcdefghijklmnop", "token =\nabcdefghijklmnop",
]


def test_base_equals_brute_force(spark):
    got = by_id(S.span_summary(S.scan_secrets(docs(spark, AWKWARD)), "doc_id"))
    for i, t in enumerate(AWKWARD):
        base = brute(t)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [base.count(k + ":") for k in ("assign", "access", "hex")]
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("novel")] == [s for s in base.split(",") if s]


def test_base_over_the_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    got = as_dicts(S.span_summary(S.scan_secrets(df), "doc_id"))
    assert len(got) == len(text)
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(brute(text[r["doc_id"]]).encode()).hexdigest()


def test_novelty_adds_keys_and_leaves_prose(spark):
    key = "Zq8vT3pLx0Rk7Wn2Jd5Yb9Hc"
    texts = [f"Authorization: Bearer {key} and more", f"nothing of that kind {key}",
             "the bearer of this_long_identifier_name2024 walks", "the bearer said thingsthatareverylongwords here",
             f"bearer {key} bearer {key} bearer {key}"]
    got = by_id(S.scan_secrets(docs(spark, texts * 3, ids=list(range(15)))))
    kinds = [[s["kind"] for s in got[i]["spans"]] for i in range(5)]
    assert kinds[0] == ["novel"] and kinds[1] == [] and kinds[3] == []
    assert texts[0][got[0]["spans"][0]["start"]:got[0]["spans"][0]["end"]] == key
    assert got[0]["spans"][0]["novelty"] >= S.LEAST
    # a string that stands in its own surroundings is no news to the compressor
    assert S.Novelty(b"")(texts[4], 7, 7 + len(key)) < 0.5 < S.Novelty(b"")(texts[0], 22, 22 + len(key))


def test_novelty_adds_keys_of_few_digits_or_letters(spark):
    rng = random.Random(7)
    alphabets = [string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters + string.digits]
    keys = ["kQvTzLmRwXsYbNdHcJfG", "kQvTzLmRwXs2YbNdHcJfG", "kQvTzLmR-wXsYbNdH+cJfG/pTk", "9182736450918264a70"]
    keys += ["".join(rng.choice(alphabets[i % 4]) for _ in range(rng.choice([16, 20, 24, 40]))) for i in range(120)]
    texts = [f"we sent it with {w} {k} to them" for k in keys for w in ("authorization bearer", "access key", "the credential")]
    got = by_id(S.scan_secrets(docs(spark, texts * 2, ids=list(range(2 * len(texts))))))
    for i, t in enumerate(texts * 2):
        key = keys[i % len(texts) // 3]
        assert [t[s["start"]:s["end"]] for s in got[i]["spans"]] == [key], t


def test_reach_after_and_before_a_sensitive_word(spark):
    key, near, far = "Zq8vT3pLx0Rk7Wn2Jd5Yb9Hc", (0, 1, 48, 49, 63), (64, 80)
    jwt = ["eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIn0",
           "SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"]
    texts = ["bearer" + " " * n + key for n in near + far] + [key + " " * n + "bearer" for n in near + far]
    n = len(texts)
    texts += [f"{key} # api key", "authorization bearer " + ".".join(jwt), ".".join(jwt) + " # the credential",
              f"bearer {jwt[0]}.x.{key}", f"our bearer of {key}-secret, and {key}_signature_{key[::-1]}"]
    got = by_id(S.scan_secrets(docs(spark, texts)))
    found = [[t[s["start"]:s["end"]] for s in got[i]["spans"]] for i, t in enumerate(texts)]
    assert found[:n] == ([[key]] * len(near) + [[]] * len(far)) * 2
    assert found[n:n + 4] == [[key], jwt, jwt, [jwt[0], key]]
    assert S.candidates(texts[n + 4])[0] == (texts[n + 4].index(key), texts[n + 4].index("secret"))


def test_candidates_equal_a_plain_search():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["bearer", " ", ".", "Ab3" * 6, "x" * 9, " " * 30, "secret "]) for _ in range(rng.randint(1, 12)))
        got = S.candidates(text)
        for m in S.CANDIDATE.finditer(text):
            if S.SENSITIVE.search(m[0]):
                continue
            close = any(0 <= m.start() - s.end() < S.REACH or 0 <= s.start() - m.end() < S.REACH
                        for s in S.SENSITIVE.finditer(text))
            assert m.span() in got or not close, text
        assert all(len(text[a:b]) >= 16 and S.CANDIDATE.fullmatch(text, a, b) for a, b in got)


def test_strings_that_read_as_words():
    assert all(map(S.reads, ["thingsthatareverylongwords", "authentication_provider", "getClientAccessToken", "REQUEST_SIGNATURE_HEADER"]))
    assert not any(map(S.reads, ["kQvTzLmRwXsYbNdHcJfG", "xkqvtzlmrwsybndhcjfg", "Zq8vT3pLx0Rk7Wn2Jd5Yb9Hc"]))


def test_dictionary_counts_all_rows_and_clashes(spark):
    df = docs(spark, ["token client_name = x"] * 40 + ["client_name"] + [None]).withColumns(
        {"SPANS": F.lit(1), "word": F.lit("w"), "doc": F.lit(2)})
    assert b"client_name " in S.identifiers(df)
    out = S.scan_secrets(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "word", "doc", "spans"]
    assert as_dicts(S.scan_secrets(df.limit(0))) == []
