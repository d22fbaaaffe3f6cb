"""Ties, repeated ids, hot groups, clashing names and very long texts in the training-data operators."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from erario.llm import license_scan, mixing, near_dedup, quality, toxicity, vp_search
from erario.llm.common import fresh


def nearest_by_definition(rows, asked, k):
    out = []
    for i, q in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in rows.items() if j != i)
        out += [(i, rank, j, -score) for rank, (score, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["one-hot", "quantised"])
def test_ties_go_by_id(spark, kind):
    """Far more vectors than k at one and the same inner product."""
    draw = random.Random(1)
    if kind == "one-hot":
        rows = {i: [float(i % 600 == j) for j in range(600)] for i in range(700)}
    else:
        rows = {i: [float(draw.randrange(-1, 2)) for _ in range(6)] + [1.0] for i in range(900)}
    vectors = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    got = vp_search.search(vp_search.build_index(vectors, shard_rows=300), vectors.filter("vec_id % 20 = 0"), 20, block=16)
    assert sorted(tuple(r) for r in got.collect()) == nearest_by_definition(rows, {i: v for i, v in rows.items() if i % 20 == 0}, 20)


def test_repeated_vector_ids_count_once(spark):
    draw = random.Random(2)
    stored = [(i % 120, [draw.random() for _ in range(4)]) for i in range(200)]
    least = {}
    for i, v in stored:
        v = np.array(v, np.float32).tolist()
        least[i] = min(v, least.get(i, v))
    vectors = spark.createDataFrame(stored, "vec_id long, embedding array<float>")
    got = vp_search.search(vp_search.build_index(vectors, shard_rows=50), vectors.filter("vec_id % 20 = 0"), 20).collect()
    want = nearest_by_definition(least, {i: v for i, v in least.items() if i % 20 == 0}, 20)
    assert [(q, r, v) for q, r, v, _ in sorted(tuple(r) for r in got)] == [(q, r, v) for q, r, v, _ in want]


def test_names_never_clash():
    assert fresh(["row", "A_"], "Row", "a") == ["Row__", "a__"] and fresh(["b"], "a") == ["a"]


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, node string, row_node string, judged_id long, some string, row string, parts string, mix_key string, component string, a string"


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES if name in ("near_dedup", "mix")])
def test_stages_keep_columns_of_any_name(spark, stage):
    texts = ["one two three four five six seven eight", "one two three four five six seven eight", "", None, "nine ten eleven twelve"] * 3
    rows = [((i // 2) if i % 4 else None, t, "en", "ab"[i % 2], i, *["KEEP"] * 2, 7, *["KEEP"] * 6) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, CLASHING)
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns
    found = got.collect()
    assert found and all(r.node == r.row_node == r.some == r.row == r.parts == r.mix_key == r.a == "KEEP" and r.judged_id == 7 for r in found)


def test_mix_of_rows_without_ids(spark):
    """Null and repeated ids: every row follows its own plan, so each source meets its target."""
    draw = random.Random(3)
    rows = [(None if i % 3 else 5, " ".join(f"w{i}x{k}" for k in range(draw.randint(300, 600))), "en", "abc"[i % 3], 0) for i in range(60)]
    rows += [(None, "same words here", "en", "a", 0)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = Counter()
    for r in mixing.mix_documents(docs).collect():
        got[r.source] += len(r.text.split())
    targets = {r.source: r.target for r in mixing.source_targets(mixing.sized(docs)).collect()}
    for source, target in targets.items():
        assert abs(got[source] - target) <= 2 * mixing.BLOCK_WORDS, (source, got[source], target)
    uses = Counter(w for r in mixing.mix_documents(docs).collect() for w in r.text.split() if "x" in w)
    assert max(uses.values()) <= mixing.MOST


def test_quality_buckets_are_bounded(spark):
    sizes = [n for n in range(1, 400)]
    docs = spark.createDataFrame([(n, "x" * n * 50) for n in sizes], "doc_id long, text string")
    found = docs.select(quality.F.array(*quality.features(quality.F.col("text"))).alias("b")).collect()
    for feature in zip(*(r.b for r in found), strict=True):
        assert len(set(feature)) < 70


def test_license_priority_and_containment():
    """Against every match of every rule, settled one by one in the order of the rules."""
    scanner = license_scan.scanner()
    draw = random.Random(4)
    phrases = ["mit license", "licensed under the mit license", "gnu general public license version 3", "all rights reserved", "cc by", "public domain", "released into the public domain", "spdx license identifier mit", "copyright 2020", "x", "apache license version 2 0", "without any warranty"]
    for _ in range(40):
        text = " ".join(draw.choice(phrases) for _ in range(25)).encode()
        words = license_scan.WORDS.findall(text)
        line = b" " + b" ".join(words) + b" "
        kept = []
        for number, rule in enumerate(scanner.rules):
            for found in rule.pattern.finditer(line):
                start, end = found.span()
                if rule.base or not any(not scanner.rules[n].base and s <= start and end <= e for s, e, n in kept):
                    kept.append((start, end, number))
        want = sorted((line.count(b" ", 0, s) - 1, line.count(b" ", 0, e), n) for s, e, n in kept)
        n, got = scanner.spans(text)
        assert n == len(words) and [(x["start"], x["end"], x["rule"]) for x in got] == want


def test_long_license_texts_take_time_in_proportion():
    text = b"mit license text all rights reserved " * 140_000  # 5 MB
    start = time.time()
    n, spans = license_scan.scanner().spans(text)
    assert n == 6 * 140_000 and len(spans) >= 2 * 140_000
    assert time.time() - start < 30


def test_pairs_grow_with_the_nodes(spark, monkeypatch):
    """Texts of one template that are no copies, and edits of one text: pair tables stay in proportion to the nodes."""
    draw = random.Random(5)
    form = [f"f{k}" for k in range(60)]

    def made(n):
        forms = [" ".join(form + [f"o{i}x{k}" for k in range(25)]) for i in range(n)]
        base = [f"b{k}" for k in range(150)]
        edits = [" ".join(w if draw.random() > 0.02 else f"e{draw.randrange(10**6)}" for w in base) for _ in range(n)]
        return forms + edits

    counts = defaultdict(dict)
    keep = near_dedup.written

    def counted(frame, name):
        out = keep(frame, name)
        if name in ("pairs", "close"):
            counts[name][n] = counts[name].get(n, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    for n in (250, 500, 1000):
        docs = spark.createDataFrame(list(enumerate(made(n))), "doc_id long, text string")
        found = near_dedup.link(docs).collect()
        assert len({r.component_id for r in found if r.doc_id < n}) == n
    for name, by_size in counts.items():
        assert by_size[1000] <= 60 * 2000, (name, by_size)
        assert by_size[1000] <= 6 * by_size[250], (name, by_size)


def test_prefix_pairs_of_a_crowd(spark):
    """Sets a little too far apart for a link give few pairs, and every linked pair of different components is among them."""
    draw = random.Random(9)
    base = [draw.getrandbits(63) for _ in range(120)]

    def edited(gone):
        return np.array(sorted({*draw.sample(base, 120 - gone), *(draw.getrandbits(63) for _ in range(gone))}), np.int64)

    found = [edited(gone) for gone in [13] * 150 + [4] * 12 + [7] * 12]
    sets = [(i.to_bytes(2), i.to_bytes(2), x.tolist(), near_dedup.parities(x).tolist()) for i, x in enumerate(found)]
    frame = spark.createDataFrame(sets, "node binary, component binary, shingles array<long>, parities array<long>")
    pairs = {(r.a[0] * 256 + r.a[1], r.b[0] * 256 + r.b[1]) for r in near_dedup.prefix_pairs(frame, 80).distinct().collect()}
    every = [(i, j, len(np.intersect1d(found[i], found[j]))) for j in range(len(found)) for i in range(j)]
    linked = {(i, j) for i, j, both in every if 180 * both >= 80 * (len(found[i]) + len(found[j]))}
    assert linked and linked <= pairs
    assert len(pairs) <= 2 * len(linked) < len(every) / 10


def toxicity_rows():
    draw = random.Random(5)
    kinds = ["aabc1_é²ßİ\n.٣ ", "ab 1.-*~\t\xa0_é", "ae0$!| tt\n"]
    return [None, "", "^a^", "~", "a", "A b", *("".join(draw.choice(kind) for _ in range(draw.randrange(1, 25))) for kind in kinds for _ in range(3000))]


def test_trigrams_by_definition(spark, monkeypatch):
    """Words next to digits, accents and line ends, over several batches of words and parts of a batch."""
    monkeypatch.setattr(toxicity, "HELD_WORDS", 40)
    monkeypatch.setattr(toxicity, "COUNTED", 7)
    expected = Counter()
    for text in toxicity_rows():
        for run in re.findall(r"[^\W_]+", (text or "").lower()):
            if set(run) <= set(toxicity.LETTERS):
                edged = f"^^{run}^"
                expected.update(edged[i : i + 3] for i in range(len(edged) - 2))
    docs = spark.createDataFrame([(text,) for text in toxicity_rows()], "text string").repartition(3)
    assert {row.gram: row.n for row in toxicity.letter_trigrams(docs).collect()} == expected
    assert toxicity.letter_trigrams(docs.limit(0)).collect() == []


def test_toxicity_words_by_definition():
    """The words of every stretch that may be disguised, found by its full pattern alone."""
    disguised = [pattern for _, pattern in toxicity.DISGUISED] + [re.compile(r"(?<![^\W\d_])[^\W\d_]*([^\W\d_])\1[^\W\d_]*")]
    lexicon = toxicity.Lexicon({"bab": 0.1, "babe*": 0.1})
    restorer, model = toxicity.Restorer({"^^b": 5, "^ba": 5, "bab": 4}, lexicon), toxicity.CharacterModel({"^^b": 5, "^ba": 5, "bab": 4})
    for text in filter(None, toxicity_rows()):
        lower = text.lower()
        expected = set(toxicity.WORDS.findall(lower))
        for pattern in disguised:
            for match in pattern.finditer(lower):
                expected.update(toxicity.restore(match.group(), model, lexicon).split())
        assert restorer.words(text) == expected, text


def test_toxicity_work_for_distinct_words():
    """A word with doubled letters is looked up once a text, a weight only for a word that begins like a term."""

    class Asked(list):
        def __init__(self, results):
            super().__init__()
            self.results = results

        def __getitem__(self, key):
            self.append(key)
            return self.results[key]

    scorer = toxicity.Scorer({"^^i": 9, "idi": 9}, {"idiot": (0.9, 0.1), "moro*": (0.8, 0.1)})
    text = "letters room idiot moronic idiom mor morsel " * 500
    expected = scorer.score(text)
    restored = scorer.restorer.known = Asked(scorer.restorer.known)
    weighed = scorer.weight = Asked(scorer.weight)
    assert scorer.score(text) == expected == 1 - 0.99 * (1 - 0.8) * (1 - 0.9)
    assert sorted(restored) == ["letters", "room"] and sorted(weighed) == ["idiom", "idiot", "moronic"]
