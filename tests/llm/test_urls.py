import random
import re

from pyspark.sql import functions as F

from hpfunnel.llm import urls as U
from tests.llm.helpers import as_dicts


def glob_regex(g):
    out = ""
    for x in re.findall(r"\*\*|\*|\?|[^*?]", g):
        out += {"**": r"[\s\S]*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x))
    return re.compile(out)


def test_automaton_equals_regexes():
    rng = random.Random(1)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(rng.randint(1, 12)))
             for _ in range(60)] + ["", "**", "a" * 130, "*" + "ab" * 40 + "**"]
    urls = ["".join(rng.choice("ab/.c") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    urls += ["", "a" * 130, "x" * 9 + "ab" * 40, "é/ü\U0001f600"]
    hit = U.run(U.compile_globs(globs), urls)
    for j, g in enumerate(globs):
        rx = glob_regex(g)
        for i, u in enumerate(urls):
            assert bool(hit[i, j]) == bool(rx.fullmatch(u)), (g, u)


def test_verdicts(spark):
    rows = {
        "http://A.Example.NET/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "http://example.net": ("example.net", "", None, "allow"),
        "http://anet/": ("anet", "/", None, "allow"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://example.com/de/1#t": ("example.com", "/de/1", "example.com/de/", "block"),
        "http://example.com/DE/": ("example.com", "/DE/", None, "allow"),
        "http://x.com/a.net/": ("x.com", "/a.net/", None, "allow"),
        "http://spam-farm.example.com/": ("spam-farm.example.com", "/", None, "block"),
        "http://ok.com/spam.x": ("ok.com", "/spam.x", None, "allow"),
        "http://b.org/fr/": ("b.org", "/fr/", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://?x/net": ("", "", None, "allow"),
        "http://ä.net/" + "y" * 3000: ("ä.net", "/" + "y" * 3000, "net/", "block"),
        "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*rows, None])], "page_id long, url string") \
        .withColumns({"Host": F.lit("mine"), "u": F.lit(3), "doc": F.lit(4)})
    got = as_dicts(U.judge_urls(df))
    assert set(got[0]) == {"page_id", "url", "u", "doc", "host", "path", "rule", "verdict"}
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == rows.get(r["url"], ("", "", None, "allow"))
    assert as_dicts(U.judge_urls(df.limit(0))) == []
