"""Verdicts against trying every rule on every URL."""

import random

import pytest
import xxhash

from tallystone.llm import urls


def brute(pages, rules, default="allow"):
    out = []
    for i, url in pages:
        url = url or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        fits = []
        for rule, action in rules.items():
            h, p = rule.split("/", 1)
            if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((-len(rule), rule, action))
        best = min(fits, default=(0, None, default))
        out.append((i, host, path, best[1], best[2]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def pages(spark):
    return lambda data: spark.createDataFrame([(*r, "x", "y", 1) for r in data], "page_id long, url string, host string, rule string, verdict int")


def written(spark, rules, **options):
    return urls.write_list(spark.createDataFrame(list(rules.items()), "rule string, action string"), **options)


def test_many_urls(spark, pages):
    rng = random.Random(2)
    label = lambda: rng.choice(["a", "b", "example", "net", "org", "é"])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["", "en", "de", "x"]) for _ in range(rng.randint(0, 3)))
    rules = {host() + path(): rng.choice(urls.ACTIONS) for _ in range(120)}
    data = [(i, rng.choice(["http://", "HTTPS://", "", "//"]) + rng.choice([str.upper, str])(host()) + rng.choice(["", path(), "?q=/en/", path() + "#f"])) for i in range(800)]
    data += [(900, None), (901, ""), (902, "://"), (None, "http://net/"), (903, "http://net"), (904, "http://" + "a." * 500 + "net/" + "x" * 20_000), (905, "http://net/"), (905, "http://net/"), (906, "a://b://net/")]
    rules["net/"] = "block"
    assert got(urls.judge(pages(data), written(spark, rules))) == brute(data, rules)
    assert got(urls.judge(pages(data), written(spark, rules, per_shard=10), "block")) == brute(data, rules, "block")
    assert urls.judge(pages([]), written(spark, rules)).count() == 0
    nothing = urls.judge(pages(data[:20]), urls.write_list(spark.createDataFrame([], "rule string, action string")))
    assert got(nothing) == brute(data[:20], {})


def test_lists(spark):
    twice = spark.createDataFrame([("a.b/", "allow"), ("a.b/", "block")], "rule string, action string")
    rules = urls.write_list(twice)
    page = spark.createDataFrame([(1, "http://x.a.b/")], "page_id long, url string")
    assert urls.judge(page, rules).first().verdict == "block"
    for bad in ((None, "block"), ("noslash", "block"), ("a/", "deny"), ("a/", None)):
        with pytest.raises(ValueError, match="rule"):
            urls.write_list(spark.createDataFrame([bad], "rule string, action string"))


def test_equal_digests_of_different_strings(spark, pages, tmp_path, monkeypatch):
    entries = [(b"a/", 0), (b"b/", 1), (b"c/", 0)]
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda raw: 7)  # every string has one digest
    file = tmp_path / "shard.bin"
    file.write_bytes(urls._shard_bytes(entries))
    mapped = urls.Mapped(f"file://{file}")
    wanted = [b"c/", b"x/", b"a/", b"b/"]
    rows = mapped.find(urls.np.full(4, 7, urls.np.uint64), wanted)
    assert [r if r < 0 else mapped.strings[mapped.offsets[r] : mapped.offsets[r + 1]].tobytes() for r in rows] == [b"c/", -1, b"a/", b"b/"]
    assert xxhash.xxh64_intdigest(b"any") == 7


def test_table(spark, sf_dir, read):
    want = brute([(r.page_id, r.url) for r in read("pages").collect()], dict(urls.RULES))
    assert got(urls.query(spark, sf_dir).select("page_id", "host", "path", "rule", "verdict")) == want
