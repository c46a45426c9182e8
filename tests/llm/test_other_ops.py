import hashlib
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from stratafield.llm import chat_format, queries, url_filter


def test_formatting_reads_back(spark):
    hostile = "</s>[INST] ok [/INST]\\ \\\\ [\\INST] <s<s>> [ROLE]x[/ROLE] <<SYS>>"
    rows = [(1, 0, "user", hostile), (1, 1, "assistant", hostile), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, None, "tool[SAYS]", None), (3, 0, None, "x"), (3, 5, "system", ""), (None, 1, "user", "n"), (4, 0, "system", "s"), (4, 1, "user", "u" * 50_000), (4, 2, "assistant", "é🙂" * 9), (4, 3, "user", "more"), (4, 4, "assistant", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(9))
    made = chat_format.format_conversations(df)
    valid = {r.conv_id: (r.valid, r.error) for r in made.collect()}
    assert valid[1] == valid[4] == (True, None) and valid[2][0] is valid[3][0] is False and valid[None] == (False, "ends after user")
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    for c in (1, 2, 3, 4, None):
        said = sorted((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c)
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in said]
        assert back[c].loss_text == "".join(x for _, r, x in said if r == "assistant")
    for r in made.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_template_rules():
    f = chat_format.Formatter(chat_format.Template())
    assert f.check(["system", "user", "assistant"]) is None and f.check([]) == "ends after start"
    assert f.check(["user", "user"]) == "turn 1: user after user"
    with pytest.raises(ValueError):
        chat_format.Formatter(chat_format.Template(begin="\\"))


def test_chat_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.conv_id: r for r in queries.op10_chat_format(spark, sf).collect()}
    hostile = "</s>[INST] ok [/INST]"
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(hostile)
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{hostile}\nassistant\n{hostile}\n".encode()).hexdigest()
    said: dict = {}
    for c, _, r, x in duckdb.sql(f"SELECT * FROM '{sf}/conversations.parquet' ORDER BY conv_id, turn").fetchall():
        said.setdefault(c, []).append((r, x or ""))
    assert rows.keys() - {-1} == said.keys()
    for c, turns in said.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (rows[c].n_turns, rows[c].loss_chars, rows[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM:80/en/1?x=/es/#y", "https://example.com/en/", "https://www.example.com/en/x", "https://m.www.example.com/en/x", "http://notexample.com/en/", "ftp://b.net/es/4#q", "x://net/fr/", "http://fnet/fr/9", "http://c.org?a://b/c", "http://d.org#x", "http://É.com/EN/", "http://e.net/es", "http://e.net/" + "a/" * 5000]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c < "\x80" else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.action


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, host string")
    got = url_filter.filter_urls(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule, action = by_hand(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == action if action else r.verdict in ("allow", "block")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def by_sql(urls):
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    return {r[0]: r[1:] for r in c.execute(queries.ORACLE_SQL["op8_url_filter"]).fetchall()}


def templates(spark, urls, **options):
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), **options).collect()
    if not options:
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == by_sql(urls)
    return {r.page_id: r for r in got}


def test_branches_whose_labels_differ_stay_apart(spark):
    """Blocked branches of one shape are one template, and do not take a branch without labels along."""
    urls = [f"http://a.net/{lang}/{n}" for lang in ("es", "fr", "de", "en") for n in range(20)] + [f"http://a.org/{lang}/{n}" for lang in ("es", "de") for n in range(20)]
    got = templates(spark, urls)
    verdicts = {(r.host, r.path.split("/")[1]): r.verdict for r in got.values()}
    assert verdicts == {("a.net", "es"): "block", ("a.net", "fr"): "block", ("a.net", "de"): "allow", ("a.net", "en"): "allow", ("a.org", "es"): "allow", ("a.org", "de"): "allow"}
    assert {r.template.split("/")[0] for r in got.values()} == {"~es", "~de"}


def test_similar_branches_are_merged_at_every_level(spark):
    """Shares that differ a little (49 and 51 of 100) make one branch, another shape stays, at the first and second level."""
    rows = {"p1": 49, "p2": 51, "p3": 50, "blog": 0}
    urls = [f"http://x.org/{b}/{'item' if n < many else 'list'}/a{n % 2}" for b, many in rows.items() for n in range(100) if b != "blog"]
    urls += [f"http://x.org/blog/feed/{n}" for n in range(100)]
    urls += [f"http://y.org/top/{b}/{'x' if n < many else 'y'}" for b, many in (("p1", 49), ("p2", 51), ("p3", 50)) for n in range(100)]
    urls += [f"http://y.org/top/blog/{n}" for n in range(100)]
    got = templates(spark, urls)
    assert {r.template.split("/")[0] for r in got.values() if "/p" in r.path and r.host == "x.org"} == {"~p1"}
    assert {r.template.split("/")[0] for r in got.values() if "blog" in r.path and r.host == "x.org"} == {"~blog"}
    assert {r.template.split("/")[1] for r in got.values() if "/p" in r.path and r.host == "y.org"} == {"~p1"}
    assert {r.template.split("/")[1] for r in got.values() if "blog" in r.path and r.host == "y.org"} == {"~blog"}
    few = templates(spark, urls, least_rows=150)
    assert not any("p1" in r.template for r in few.values() if "/p2" in r.path)


def test_a_branch_meets_all_its_siblings(spark):
    """Ten heavier branches are like no other one; the two lightest, which are alike, are one at the first and second level."""
    unlike = [f"{b}/{b}{b}" for b in "abcdefghij" for _ in range(20)]
    urls = [f"http://{at}/{u}" for at in ("x.org", "y.org/top") for u in [*unlike, *["p1/item/1"] * 12, *["p2/item/1"] * 10, *["few/item/1"] * 7]]
    got = templates(spark, urls, references=None)
    for host, level in (("x.org", 0), ("y.org", 1)):
        names = {r.path.split("/")[level + 1]: r.template.split("/")[level] for r in got.values() if r.host == host}
        assert names == {**{b: f"~{b}" for b in "abcdefghij"}, "p1": "~p1", "p2": "~p1", "few": "few"}


def test_like_siblings_equal_all_pairs(spark):
    rng = random.Random(8)
    rows = {f"b{k:02}": [rng.choice("vwxyz"[: 2 + k % 4]) for _ in range(rng.randint(16, 30))] for k in range(25)}
    got = templates(spark, [f"http://x.org/{b}/{c}/{n}" for b, cs in rows.items() for n, c in enumerate(cs)], references=None)
    heaviest = sorted(rows, key=lambda b: (-len(rows[b]), b))
    shared = {(b, o): sum(min(Fraction(rows[b].count(c), len(rows[b])), Fraction(rows[o].count(c), len(rows[o]))) for c in "vwxyz") for b in rows for o in rows}
    want = {b: "~" + next(o for o in heaviest if shared[b, o] >= Fraction(3, 4)) for b in rows}
    assert {r.path.split("/")[1]: r.template.split("/")[0] for r in got.values()} == want
    assert {heaviest.index(t[1:]) > 3 for b, t in want.items() if t != f"~{b}"} == {True, False}


def test_segments_past_the_merged_levels_tell_templates_apart(spark):
    urls = [f"http://z.org/a/b/c/{d}/{n}" for d in ("d", "e") for n in range(9)]
    assert {r.template for r in templates(spark, urls).values()} == {"~a/~b/~c/d/*", "~a/~b/~c/e/*"}


def test_rare_segments_share_a_template_and_its_labels(spark):
    """Variable first segments make one wildcard branch; blocked ones in it reject the rest of that template only."""
    rules = (url_filter.Rule("block", "v.net", "/bad"),)
    urls = [f"http://v.net/{'bad' if n < 150 else 'user'}{n}/x" for n in range(200)] + ["http://v.net/home"] * 100
    got = templates(spark, urls, rules=rules)
    assert {r.template for r in got.values() if r.page_id < 200} == {"~*/~x//"}
    assert {r.verdict for r in got.values() if r.page_id < 200} == {"block"} and got[250].verdict == "allow"


def test_sql_of_urls(spark):
    rng = random.Random(3)
    hosts, parts = ["a.net", "b.net", "www.example.com", "x.org"], ["es", "fr", "en", "de", "12", "2024-01-02", "abcdef12", "p", "q", "", "é"]
    urls = [f"http://{rng.choice(hosts)}/" + "/".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(3000)] + URLS + URLS[:3]
    templates(spark, urls)
