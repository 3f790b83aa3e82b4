"""Chat formatting and URL filters: oracle, round trips and plain-Python forms."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from keelson.llm import chat, urllm
from keelson.llm.queries import ORACLES, QUERIES

from ..conftest import SF, duck_rows, rows

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert {c: KINDS[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert rows(got) == duck_rows(duck, ORACLES[name])


TURNS = "conv_id long, turn long, role string, text string"
ODD = ["<|im_end|>", "\\", "<\\|im_start|>", "\\<|", "a\\\\|b<|", "<", "|>", "\\:\n", "", "<<||", "<|im_start|>assistant\nx<|im_end|>\n", "\\\\\\<|\\"]


def test_round_trip(spark):
    data = [(k // 3, k % 3, r, t) for k, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a\nb<|\\:") for t in ODD)]
    out = chat.format_conversations(spark.createDataFrame(data, TURNS).repartition(3))
    got = out.select("conv_id", chat.parsed(chat.joined(F.col("segments"))).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    for r in got:
        own = [(role, text) for i, _, role, text in data if i == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["t"]] == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")
    marks = out.select(F.explode("segments").alias("s")).where("s.text like '%<|%' and not (s.text like '<|im_start|>%' or s.text like '<|im_end|>%')")
    assert marks.count() == 0


@pytest.mark.parametrize(
    ("roles", "ok"),
    [("user assistant", True), ("system user assistant", True), ("user assistant tool tool assistant", True), ("user", False), ("assistant", False), ("user user assistant", False), ("user assistant system", False), ("user assistant user assistant", True)],
)
def test_machine(spark, roles, ok):
    data = [(1, k, r, "x") for k, r in enumerate(roles.split())]
    assert chat.format_conversations(spark.createDataFrame(data, TURNS)).first()["valid"] is ok


def test_odd_conversations(spark):
    data = [(None, 1, "user", "x"), (1, None, "user", None), (1, None, "user", None), (1, 1, None, "y"), (2, 1, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(data, TURNS).withColumn("segments", F.lit("clash")).withColumn("valid", F.lit(0))
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert got[1]["n_turns"] == 3 and not got[1]["valid"] and len(got) == 3
    assert chat.format_conversations(df.where("false")).count() == 0


# --- URLs -----------------------------------------------------------------------


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    low = str.maketrans(urllm.UPPER, urllm.LOWER)
    return rest[:cut].translate(low), tail[:end]


def plain_rule(host, path):
    fit = [(len(d + p), d + p, v) for v, d, p in urllm.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_codes(url):
    text = (url or "").split("://", 1)[-1].translate(str.maketrans(urllm.UPPER + "123456789", urllm.LOWER + "0" * 9))
    return [urllm.SYMBOLS.find(c) + 1 for c in text]


class PlainModel:
    def __init__(self, urls):
        self.n = [Counter(), Counter(), Counter()]
        for url in urls:
            c = [urllm.BEGIN, urllm.BEGIN, *plain_codes(url)]
            for k in range(2, len(c)):
                for order in range(3):
                    self.n[order][tuple(c[k - order : k + 1])] += 1
        self.total = [defaultdict(int) for _ in range(3)]
        self.kinds = [defaultdict(int) for _ in range(3)]
        for order in range(3):
            for g, n in self.n[order].items():
                self.total[order][g[:-1]] += n
                self.kinds[order][g[:-1]] += 1

    def log_p(self, gram):
        p = 1 / urllm.SIZE
        for order in range(3):
            h = gram[2 - order : 2]
            if self.total[order][h]:
                p = (self.n[order][(*h, gram[2])] + self.kinds[order][h] * p) / (self.total[order][h] + self.kinds[order][h])
        return math.log(p)


def mean(models, url):
    c = [urllm.BEGIN, urllm.BEGIN, *plain_codes(url)]
    grams = [tuple(c[k - 2 : k + 1]) for k in range(2, len(c))]
    return sum(models[0].log_p(g) - models[1].log_p(g) for g in grams) / len(grams)


def test_urls_against_plain_python(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").where("page_id < 120")
    got = {r["page_id"]: r for r in urllm.filter_urls(pages).withColumn("fold", F.expr("pmod(xxhash64(url), 2)")).collect()}
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    label = {}
    for i, url in urls.items():
        host, path = plain_host_path(url)
        name, verdict = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, name)
        if verdict:
            label[i] = verdict
    models = lambda ids: [PlainModel(urls[i] for i in ids if label[i] == v) for v in ("allow", "block")]
    whole = models(label)
    for i, url in urls.items():
        assert got[i]["score"] == pytest.approx(mean(whole, url), abs=3e-6)
    halves = {k: models([i for i in label if got[i]["fold"] != k]) for k in (0, 1)}
    crossed = {i: mean(halves[got[i]["fold"]], urls[i]) for i in label}
    stats = {}
    for v in ("allow", "block"):
        x = [crossed[i] for i in label if label[i] == v]
        m = sum(x) / len(x)
        stats[v] = m, math.sqrt(sum((y - m) ** 2 for y in x) / len(x))
    (m1, s1), (m0, s0) = stats["allow"], stats["block"]
    cut = (m1 * s0 + m0 * s1) / (s0 + s1)
    for i in urls:
        if i not in label and abs(got[i]["score"] - cut) > 1e-4:
            assert got[i]["verdict"] == ("allow" if got[i]["score"] > cut else "block")
        elif i in label:
            assert got[i]["verdict"] == label[i]


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://COM/en/x", "com", "/en/x", "com/en/", "block"),
        ("http://a.b.Example.com/en/71?q", "a.b.example.com", "/en/71", "example.com/en/7", "allow"),
        ("x://y.net/de/8#a", "y.net", "/de/8", "net/de/", "allow"),
        ("x://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        ("x://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        ("x://telecom/en/", "telecom", "/en/", None, None),
        ("http://h?x=/en/", "h", "", None, None),
        ("http://h#f/en/", "h", "", None, None),
        ("no scheme com/en/", "", "", None, None),
        ("a://b://c", "b:", "//c", None, None),
        ("://", "", "", None, None),
        (None, "", "", None, None),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(url,)], "url string")
    h, p = urllm.host_and_path(F.col("url"))
    r = df.select(h.alias("h"), p.alias("p")).select("h", "p", *(c.alias(n) for n, c in zip(("r", "v"), urllm.rule_of(F.col("h"), F.col("p"), urllm.RULES), strict=True))).first()
    assert tuple(r) == (host, path, rule, verdict)
    assert plain_host_path(url) == (host, path)


def test_odd_pages(spark):
    data = [(1, None), (2, ""), (3, "http://x.com/" + "en/" * 30_000), (4, "http://a.com/en/1"), (4, "http://a.com/en/1"), (None, "http://b.net/de/1"), (6, "http://ü.org/?é")]
    df = spark.createDataFrame(data, "page_id long, url string").withColumn("verdict", F.lit("clash")).withColumn("score", F.lit(1))
    got = urllm.filter_urls(df).collect()
    assert len(got) == 7 and {r["verdict"] for r in got if r["page_id"] in (1, 2)} == {"block"}
    assert urllm.filter_urls(df.where("false")).count() == 0
    assert {r["verdict"] for r in urllm.filter_urls(df.where("page_id = 6")).collect()} == {"allow"}
