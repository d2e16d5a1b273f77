"""Templates found through the index against every pattern and field tried in turn."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import matching as M

FILES = "tenant long, k long, name string, page string"
TEMPLATES = "tenant long, template string, place int, pattern string, fields array<string>"


def brute(files, templates):
    out = []
    for tenant, k, name, page in files:
        own = sorted((t for t in templates if t[0] == tenant), key=lambda t: t[2])
        found = None
        for t in own:
            try:
                if name is not None and t[3] and re.search(t[3], name, re.IGNORECASE):
                    found = (t[1], "name")
                    break
            except re.error:
                pass
        if not found and page and len(page) > 20:
            best = 0.0
            for t in own:
                fields = [f for f in t[4] or [] if f]
                score = sum(f.lower() in page.lower() for f in fields) / len(fields) if fields else 0
                if score > best:
                    best, found = score, (t[1], "page")
            found = found if best >= 0.7 else None
        if not found and len(own) == 1:
            found = (own[0][1], "only")
        out.append((tenant, k, *(found or (None, None))))
    return sorted(out)


def test_equals_every_template_in_turn(spark):
    rng = random.Random(8)
    words = ["bao", "cao", "ngay", "tuan", "KV30", "Kế hoạch", "tong_so", "x", "7"]
    patterns = [r"bao.*cao", r"^tuan\d+", r"\d{4}", "[bad", "(?P<x", "", None, r"ngay|tuan", r"(?:KV)+30", r"k?v", ".", r"a\.pdf$", r"Kế", r"[xy]", "TUAN", r"(?i:CAO)_", r"(?<!a)cao"]
    templates = [(t, f"t{t}_{k}", k, rng.choice(patterns), [rng.choice(words) + rng.choice(["", "_1", " a"]) for _ in range(rng.randrange(5))] + [""] * rng.randrange(2)) for t in range(6) for k in range(rng.choice([1, 2, 9]))]
    files = [(rng.randrange(8), i, rng.choice([None, "", "_".join(rng.choices(words, k=3)) + f"{rng.randrange(9)}.pdf"]), rng.choice([None, "", " ".join(f"{rng.choice(words)}{rng.choice(['', '_1', ' a'])}" for _ in range(rng.randrange(2, 25)))])) for i in range(200)]
    got = M.detected(spark.createDataFrame(files, FILES), spark.createDataFrame(templates, TEMPLATES), "k")
    assert sorted(tuple(r) for r in got.collect()) == brute(files, templates)
    bad = {(r.tenant, r.template) for r in M.bad_patterns(spark.createDataFrame(templates, TEMPLATES)).collect()}
    assert bad == {(t[0], t[1]) for t in templates if t[3] in ("[bad", "(?P<x")}


@pytest.mark.parametrize(("pattern", "runs"), [(r"^abc\d+def$", ["abc", "def"]), (r"(ab|cd)x", ["x"]), (r"a?bc*d", ["b", "d"]), (r"(xy){2}z", ["xy", "z"]), (r"[a]?\w+", []), (r"\.pdf", [".pdf"]), (r"(?=abc)d", ["d"])])
def test_what_a_pattern_must_contain(pattern, runs):
    assert M.required(pattern) == runs


@pytest.mark.parametrize("name", ["KİLO", "kılo", "ſet", "Kelvin"])
def test_letters_that_match_without_case(spark, name):
    patterns = [("kilo", 1), ("set", 2), ("kelvin", 3)]
    templates = spark.createDataFrame([(0, p, k, p, None) for p, k in patterns], TEMPLATES)
    got = M.by_name(spark.createDataFrame([(0, name)], "tenant long, name string"), templates).collect()
    assert [r.template for r in got] == [p for p, _ in patterns if re.search(p, name, re.IGNORECASE)][:1]


def test_no_file_meets_every_template(spark):
    """Candidates grow with files, not with templates: 100,000 of these, each of its own."""
    n = 100_000
    templates = spark.range(n).select((F.col("id") % 3).alias("tenant"), F.concat(F.lit("t"), "id").alias("template"), F.col("id").cast("int").alias("place"),
                                      F.concat(F.lit("report_"), F.hex(F.xxhash64("id")), F.lit(r"_\d+")).alias("pattern"), F.array(F.concat(F.lit("total_"), F.hex(F.xxhash64("id") + 1)), F.lit("total")).alias("fields"))
    files = spark.range(0, 4000, 10).select((F.col("id") % 3).alias("tenant"), F.col("id").alias("k"), F.when(F.col("id") % 20 == 0, F.concat(F.lit("REPORT_"), F.hex(F.xxhash64("id")), F.lit("_7.pdf"))).otherwise("other.pdf").alias("name"),
                                            F.concat(F.lit("here is the total "), F.lit("TOTAL_"), F.hex(F.xxhash64("id") + 1), F.lit(" of all")).alias("page"))
    out = M.detected(files, templates, "k")
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = out.collect()
    assert len(rows) == 400 and all(r.template == f"t{r.k}" and r.how == ("name" if r.k % 20 == 0 else "page") for r in rows)


def test_no_templates_no_files(spark):
    files, templates = spark.createDataFrame([(1, 1, "a", "b" * 30)], FILES), spark.createDataFrame([], TEMPLATES)
    assert [tuple(r) for r in M.detected(files, templates, "k").collect()] == [(1, 1, None, None)]
    assert M.detected(files.limit(0), templates, "k").count() == 0


@pytest.mark.parametrize("wanted", [None, frozenset(), frozenset({"abc", "z", "b"}), frozenset(f"k{i}" for i in range(100)) | {"bc", "a"}])
def test_runs_that_are_wanted(wanted):
    for s in ("", "a", "abcab", "zz"):
        runs = {s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1)}
        assert sorted(M._runs(s, wanted)) == sorted(runs if wanted is None else runs & wanted)


@pytest.mark.parametrize("few", [0, 10_000])
def test_only_keys_of_a_small_index_are_spread(spark, monkeypatch, few):
    monkeypatch.setattr(M, "FEW", few)
    index = spark.createDataFrame([("abc",), ("bca",), ("abc",)], "gram string")
    wanted = M.few_grams(index)
    rows = M.spread(spark.createDataFrame([(1, "xabcx"), (2, None), (3, "q" * 30)], "k int, t string"), "t", wanted).collect()
    assert (wanted is None) == (few == 0)
    assert sorted(map(tuple, rows)) == [(1, "abc")] if few else len(rows) > 10
