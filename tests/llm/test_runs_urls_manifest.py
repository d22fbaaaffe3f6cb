"""Periodic runs, URL filters and the Merkle manifest against brute force; nulls, empty tables, repeats, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from erario.llm import merkle, periodic_runs, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, node string, period long, leaf string"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n\t", "one", "a b " * 40, "x\x1cy \x0b z", "A b C d E f " * 3, "Same Text", "Same Text", "é ß ΣΟΣ " * 30, "w" * 50_000]
    rows = [(i, t, (None, "", "en", "de")[i % 4], ("a", None)[i % 2], (None, 3)[i % 2], "t", 1, "n", 2, "l") for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "a", 1, None, None, None, None, None)] * 2 + [(None, "No Id", "en", None, None, None, None, None, None, None), (None, "No Other", "en", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def runs_by_definition(words):
    """Every stretch that has a period and cannot be extended, by trying all periods."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(12, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    draw = random.Random(3)
    for _ in range(1500):
        words = [b"%d" % draw.randrange(draw.choice([1, 2, 3, 4])) for _ in range(draw.randint(0, 60))]
        if len(words) > 4 and draw.random() < 0.5:
            start, period = draw.randrange(len(words)), draw.randint(1, len(words) // 2)
            words = words[:start] + [words[start + k % period] if start + k % period < len(words) else b"0" for k in range(len(words) - start)]
        assert periodic_runs.find_runs(words) == runs_by_definition(words)
        numbers = periodic_runs.numbered(words)
        assert periodic_runs.runs_of(numbers) == runs_by_definition(numbers)  # without leaving words out first


def test_longest_common_extensions():
    draw = random.Random(4)
    for _ in range(60):
        numbers = periodic_runs.numbered([b"%d" % draw.randrange(3) for _ in range(draw.randint(2, 80))])
        tree = periodic_runs.SuffixTree(numbers)
        pairs = [(a, b) for a in range(len(numbers)) for b in range(len(numbers)) if a != b]
        got = tree.common(*(periodic_runs.np.array(x) for x in zip(*pairs, strict=True)))
        for (a, b), length in zip(pairs, got.tolist(), strict=True):
            want = next((k for k in range(len(numbers)) if max(a, b) + k >= len(numbers) or numbers[a + k] != numbers[b + k]), len(numbers))
            assert length == want


def test_long_texts_take_time_in_proportion():
    words = [b"%d" % (k % 7) for k in range(30_000)]
    assert periodic_runs.find_runs(words) == [(0, 30_000, 7)]


def digest_by_definition(doc_id, text):
    words = (text or "").encode().split()
    crc = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if crc % 10 == 0 and words:
        g, n = crc // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listing = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_digest(spark, odd, none):
    draw = random.Random(5)
    more = [(i, " ".join(str(draw.randrange(4)) for _ in range(draw.randint(0, 90)))) for i in range(300)]
    for frame in (odd, spark.createDataFrame(more, "doc_id long, text string")):
        got = Counter(tuple(r) for r in periodic_runs.run_digest(frame).collect())
        assert got == Counter(digest_by_definition(r.doc_id, r.text) for r in frame.collect())
    assert periodic_runs.run_digest(none).count() == 0 and periodic_runs.periodic_runs(none).count() == 0
    listed = {tuple(r) for r in periodic_runs.periodic_runs(odd).collect()}
    assert (4, 0, 80, 2) in listed and (6, 0, 18, 6) in listed


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def proofs_by_definition(rows):
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def build(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            first = i // 8 * 8
            yield level[first:i], level[i + 1 : first + 8]
            i //= 8

    leaves = []
    for r in rows:
        low = r.text and "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
        leaf, other = (h(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, t))) for t in (r.text, low))
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        leaves.append((r.lang, r.doc_id, leaf, other if hit else leaf))
    langs = sorted({x[0] for x in leaves}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((x for x in leaves if x[0] == lang), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        trees[lang] = own, build([x[2] for x in own])
    top = build([trees[lang][1][-1][0] for lang in langs])
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, (_, doc_id, leaf, folded) in enumerate(own):
            proof = ""
            for before, after in (*path(levels, i), *path(top, k)):
                proof += "".join(before + after)
                folded = h(*before, folded, *after)
            yield doc_id, leaf, levels[-1][0], top[-1][0], h(proof), folded, folded == top[-1][0]


def test_manifest(spark, odd, none):
    draw = random.Random(6)
    many = [(i, f"Text {draw.randrange(9)} OF {i}", ("en", "de")[i % 9 == 0], "s", i, "t", 1, "n", 2, "l") for i in range(1300)]  # more leaves than a block holds
    langs = [(i, "T", f"l{i % 70}", None, None, "t", 1, "n", 2, "l") for i in range(140)]  # more subroots than a run
    for frame in (odd, spark.createDataFrame(many, SCHEMA).repartition(4), spark.createDataFrame(langs, SCHEMA)):
        got = Counter(tuple(r) for r in merkle.prove_documents(frame).collect())
        assert got == Counter(proofs_by_definition(frame.collect()))
    assert merkle.prove_documents(none).count() == 0


def test_versions_share_untouched_nodes(spark):
    rows = [(i, f"Text {i}", "en", "s", i, "t", 1, "n", 2, "l") for i in range(600)]
    manifest = merkle.build(spark.createDataFrame(rows, SCHEMA))
    nodes = {(r.tree, r.level, r.place): r.digest for r in manifest.nodes().collect()}
    assert Counter(level for tree, level, _ in nodes if tree == "=en") == {0: 600, 1: 75, 2: 10, 3: 2, 4: 1}
    assert len(nodes) == 689  # and the one subroot
    versions = {}
    for r in manifest.versions().collect():
        versions.setdefault((r.doc_id, r.leaf_place), {})[r.level] = r.digest
    assert set(versions) == {(i, i) for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 0}
    folded = {r.doc_id: r.folded_root for r in manifest.proofs().collect()}
    for (doc_id, place), copied in versions.items():
        assert len(copied) == 5 and copied[4] == folded[doc_id]  # the ancestors alone
        for level in range(1, 5):  # a copied node stands over its copied child and the shared others
            at, child = place // 8**level, place // 8 ** (level - 1)
            below = [copied[level - 1] if k == child else nodes.get(("=en", level - 1, k)) for k in range(8 * at, 8 * at + 8)]
            assert copied[level] == h(*[x for x in below if x])


PAGES = "page_id long, url string, html string, host string, n long, node string, verdict string"


def judged(spark, urls, **more):
    frame = spark.createDataFrame([(i, u, "", "h", 1, "x", "y") for i, u in enumerate(urls)], PAGES).repartition(3)
    return {r.page_id: r for r in url_filter.judge_urls(frame, **more).collect()}


def test_rules(spark):
    cases = {
        "http://EXAMPLE.org/es/1?x": ("example.org", "/es/1", "example.org/es/", "block"), "x://a.example.org/en/12#t": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://org": ("org", "", None, "allow"),
        "http://b.com/fr/": ("b.com", "/fr/", "com/fr/", "allow"), "http://b.com/De/": ("b.com", "/De/", None, None), "http://b.com/de/://z/fr": ("b.com", "/de/://z/fr", "com/de/", "block"),
        "b.com/de/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://?q": ("", "", None, "allow"), "http://éÉ.com/fr/é": ("éÉ.com", "/fr/é", "com/fr/", "allow"),
    }
    got = judged(spark, list(cases))
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict in (None, got[i].verdict)


def test_templates_reject_by_purity(spark):
    """One host: articles with names of their own are variable, two good branches are one, a bad branch stands alone."""
    urls = [f"http://h.net/{branch}/{i}.html" for branch in ("news", "sport", "casino") for i in range(60)] + [f"http://h.net/{i}" for i in range(5)]
    pages = spark.createDataFrame([(i, u, "", "h", 1, "x", "y") for i, u in enumerate(urls)], PAGES)
    labels = spark.createDataFrame([(i, int("casino" in u)) for i, u in enumerate(urls) if i % 2], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, labels=labels).collect()}
    for i, url in enumerate(urls):
        kind = url.split("/")[3]
        want = {"news": ("/~sport/*", "allow"), "sport": ("/~sport/*", "allow"), "casino": ("/=casino/*", "block")}.get(kind, ("/*", "allow"))
        assert (got[i].template, got[i].verdict) == want
    prior = (30 + 1) / (len(urls) // 2 + 2)
    good, bad = sum(i % 2 and "casino" not in u for i, u in enumerate(urls)), 30
    host = (bad + 4 * prior) / (good + bad + 4)
    branch = (30 + 4 * host) / (30 + 4)
    assert abs(got[120].purity - (30 + 4 * branch) / (30 + 4)) < 1e-12


def test_urls_without_labels_or_rows(spark):
    got = judged(spark, ["http://a.net/x"] * 3 + [None], rules=spark.createDataFrame([], "rule string, verdict string"))
    assert {(r.rule, r.verdict) for r in got.values()} == {(None, "allow")}
    assert url_filter.judge_urls(spark.createDataFrame([], PAGES)).count() == 0
    few = judged(spark, ["http://a.net/x/y/z"] * 7 + ["http://b.net/x/y/z"] * 8)
    assert few[0].template == "/**" and few[7].template == "/=x/=y/=z"  # a node with few pages is not split
