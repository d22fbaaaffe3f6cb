"""The training-data operators against brute force, libraries and hand-made cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import __spark_entry__ as contract
from erario.llm import exact_dedup, license_scan, line_dedup, mixing, near_dedup, packing, quality, token_counts, toxicity, vp_search

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, key string, place string, node string"
LINE = "A line that is long enough to be dropped"
TEXTS = [None, "", " \n\t ", "one", "one two", "One Two", f"{LINE}\nfirst", f" {LINE.upper()} \nsecond", f"{LINE}\nthird", "x" * 20_000, "word " * 5_000,
         "cc by cc by all rights reserved", "GNU General Public License version 3", "é à ß ΣΟΣ don't <|endoftext|> 12\x1c3", "one  two"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ("a", "b", None)[i % 3], None, True, 7, "k", "p", "n") for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "a", 3, None, None, None, None, None), (None, "one two", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts_of(frame):
    return [(r.doc_id, r.text or "") for r in frame.collect()]


def test_token_counts(docs, none, documents):
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for frame in (docs, documents):
        want = sorted((str(i), len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts_of(frame))
        got = token_counts.count_tokens(frame, path("byte_bpe_50k.json")).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(none, path("byte_bpe_50k.json")).count() == 0


def test_license_scan(docs, none, documents):
    for frame in (docs, documents):
        got = {r.doc_id: r for r in license_scan.license_digest(license_scan.scan_licenses(frame)).collect()}
        for i, t in texts_of(frame):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
            places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
            assert got[i].n_words == len(words) and got[i].n_base == len(places)
            assert got[i].first_word == min((k for k, _ in places), default=None) and got[i].last_word == max((k for k, _ in places), default=None)
            assert got[i].base_labels == ",".join(sorted({x for _, x in places})) and 0 <= got[i].score <= 1
            assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))
    assert "gpl-3.0" in {x for r in license_scan.license_digest(license_scan.scan_licenses(docs)).collect() for x in r.labels.split(",")}
    assert license_scan.scan_licenses(none).count() == 0
    assert len(license_scan.rules()) > 200


def license_labels(text):
    return {span["label"] for span in license_scan.scanner().spans(text.encode())[1]}


def test_license_identifiers():
    for name, label in {"MIT": "mit", "Apache-2.0": "apache-2.0", "GPL-3.0-only": "gpl-3.0", "GPL-2.0-or-later": "gpl-2.0", "LGPL-2.1": "lgpl-2.1", "AGPL-3.0-only": "agpl-3.0", "MPL-2.0": "mpl-2.0", "BSD-3-Clause": "bsd-3-clause",
                        "ISC": "isc", "Zlib": "zlib", "EPL-2.0": "epl-2.0", "CC0-1.0": "cc0-1.0", "CC-BY-SA-4.0": "cc-by-sa", "Unlicense": "unlicense", "BSL-1.0": "bsl-1.0", "MS-PL": "ms-pl", "ODbL-1.0": "odbl", "Artistic-2.0": "artistic-2.0",
                        "OFL-1.1": "ofl-1.1", "WTFPL": "wtfpl", "GFDL-1.3-or-later": "gfdl", "EUPL-1.2": "eupl", "CDDL-1.0": "cddl-1.0", "CPL-1.0": "cpl-1.0", "PSF-2.0": "psf-2.0", "PDDL-1.0": "pddl", "MS-RL": "ms-rl", "Apache-1.1": "apache-1.1"}.items():
        assert label in license_labels(f"// SPDX-License-Identifier: {name}\n"), name
    for text, label in {"licensed under MIT.": "mit", "under GPLv3 terms": "gpl-3.0", "LGPL-2.1": "lgpl-2.1", "the MPL 2.0": "mpl-2.0", "Apache 2.0": "apache-2.0", "released under the BSD": "bsd", "\xa92020 A": "copyright", "\xa9 1999 A": "copyright"}.items():
        assert label in license_labels(text), text
    for text in ("she went to MIT", "an apache helicopter", "artistic 20", "the year 2020", "gpl"):
        assert not license_labels(text), text


def example(pattern):
    """A text that the pattern meets: every part as short as it may be, the first way of each choice."""
    import re._parser as parser

    def of(parts):
        made = ""
        for op, value in parts:
            op = str(op)
            if op == "LITERAL":
                made += chr(value)
            elif op == "IN":
                kind, first = value[0]
                made += "x" if str(kind) in ("NEGATE", "CATEGORY") else chr(first if str(kind) == "LITERAL" else first[0])
            elif op == "SUBPATTERN":
                made += of(value[3])
            elif op == "BRANCH":
                made += of(value[1][0])
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                made += of(value[2]) * value[0]
        return made

    return of(parser.parse(pattern.pattern.decode("latin-1"))).encode("latin-1")


def test_license_rules_fire():
    """Every rule meets a text made of its own pattern, gate included; only rules of higher priority may settle it."""
    for rule in license_scan.rules():
        only = license_scan.Scanner([rule])
        assert [x["label"] for x in only.spans(example(rule.pattern))[1]] == [rule.label], rule


def test_packing(docs, none, documents):
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    for frame in (docs, documents):
        ids = defaultdict(list)
        for i, t in texts_of(frame):
            ids[i].append(library.encode(t, add_special_tokens=False).ids + [1])
        got = packing.pack(frame, path("word_bpe_49k.json")).collect()
        assert sum(r.length for r in got) == sum(len(x) for rows in ids.values() for x in rows)
        for r in got:
            assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in ids[r.doc_id])
        sequences = defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
        padding = 0
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
            padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert padding <= 0.03 * sum(r.length for r in got)
    assert packing.pack(none, path("word_bpe_49k.json")).count() == 0


def test_packing_special_strings():
    """Special strings are special in their own case alone."""
    library, words = Tokenizer.from_file(path("word_bpe_49k.json")), packing.WordIds(path("word_bpe_49k.json"), 1)
    for text in ("<|endoftext|>", "<|ENDOFTEXT|>", "a <|StartOfText|> B", "x<|EndOfText|>y <|endoftext|> Z", "<| endoftext |>"):
        assert words.of_text(text) == np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes(), text


def test_vantage_point_search(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").limit(300)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in vectors.collect()]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] * 64), (2003, [None] + [1.0] * 63), (None, rows[1][1]), (2004, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    asked = frame.filter("vec_id % 20 = 0")
    want = {}
    for i, v in good:
        if i % 20 == 0:
            want[i] = [j for _, j in sorted((-round(float(v @ w), 9), j) for j, w in good if j != i)][:20]
    for shard_rows in (64, 8192):
        index = vp_search.build_index(frame, shard_rows)
        exact = defaultdict(list)
        for r in sorted(vp_search.search(index, asked, block=4).collect(), key=lambda r: r["rank"]):
            exact[r.query_id].append(r.vec_id)
        assert exact == want
        loose = vp_search.search(index, asked, factor=1.5).collect()
        assert sum(r.vec_id in want[r.query_id] for r in loose) >= 0.9 * sum(map(len, want.values()))
    assert vp_search.search(vp_search.build_index(frame.limit(0)), frame.limit(0)).count() == 0


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for i, t in texts_of(docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((i, t))
    got = exact_dedup.dedup_exact(docs).collect()
    assert len(got) == docs.count()
    by_hash = {hashlib.sha256(c.encode()).hexdigest(): rows for c, rows in groups.items()}
    for r in got:
        rows = by_hash[r.text_sha256]
        longest = max(len(t) for _, t in rows)
        keep = min((i for i, t in rows if len(t) == longest), key=lambda i: (i is None, i or 0))
        assert r.group_size == len(rows) and r.keep_id == keep
        assert not r.kept or r.doc_id == keep
    assert exact_dedup.dedup_exact(none).count() == 0
    records = exact_dedup.folded(docs)
    assert exact_dedup.bucketed(records, 64).select("bucket").distinct().count() > 3  # parted again and again where it does not fit


def test_line_dedup(docs, none):
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digest(line_dedup.clean_lines(docs)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {(6, 2, 1, sha("first")), (7, 2, 1, sha("second")), (8, 2, 0, sha(TEXTS[8])), (0, 1, 0, sha("")), (2, 2, 0, sha(TEXTS[2])), (None, 1, 0, sha("one two"))} <= got
    changed = {r.doc_id: r for r in line_dedup.drop_lines(docs).collect()}
    assert changed[6].text == "first" and changed[0].text is None and changed[6].size == 7
    assert line_dedup.drop_lines(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix_report(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs).collect())) and len(got) == docs.count()
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by_source = defaultdict(lambda: [0, 0.0])
    for r in got:
        by_source[r.source_size, r.target][0] += r.taken
    assert all(abs(taken - target) <= max(2 * mixing.BLOCK_WORDS, 0.05 * target) for (_, target), (taken, _) in by_source.items())
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixed.filter("doc_id <> 3").collect()) == sum(r.taken for r in got if r.doc_id is not None and r.doc_id != 3)
    assert mixing.mix_report(none).count() == 0 and mixing.mix_documents(none).count() == 0


def near_components(rows, width):
    sets = []
    for i, t in rows:
        words = t.encode().lower().split()
        n = min(width, len(words))
        sets.append((i, {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a][1] & sets[b][1])
            if shared and 100 * shared >= 80 * (len(sets[a][1]) + len(sets[b][1]) - shared) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((sets[k][0] for k in range(len(sets)) if group[k] == g and sets[k][0] is not None), default=None) for g in group}
    return sorted((str(i), len(s), str(least[g] if s else i)) for (i, s), g in zip(sets, group, strict=True))


def test_near_dedup(docs, none, documents):
    for frame in (docs, documents):
        got = near_dedup.link(frame, 2, 80).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_components(texts_of(frame), 2)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.link(none).count() == 0 and near_dedup.first_of_groups(none).count() == 0


def test_near_dedup_rows(spark):
    """Null and repeated ids: rows go one by one, and one of each group stays."""
    rows = [(1, "a b c d e f g", 0), (None, "a b c d e f g", 1), (None, "a text of its own", 2), (None, "", 3), (None, None, 4),
            (2, "a b c d e f g", 5), (2, "two texts have this id", 6), (3, "the same row twice", 7), (3, "the same row twice", 7), (4, "", 8), (4, "", 8),
            (None, "only null ids here", 9), (None, "only null ids here", 10), (5, "A b c d e f g", 11), (6, "one id one text", 12)]
    stay = lambda frame: sorted((str(r.doc_id), r.text or "") for r in near_dedup.first_of_groups(frame).collect())
    want = [(1, "a b c d e f g"), (None, "a text of its own"), (None, ""), (None, ""), (2, "two texts have this id"), (3, "the same row twice"), (4, ""), (4, ""), (None, "only null ids here"), (6, "one id one text")]
    assert stay(spark.createDataFrame(rows, "doc_id long, text string, no int").repartition(3)) == sorted((str(i), t) for i, t in want)
    gone = [(1, "a b c d e f g", 0), (None, "a b c d e f g", 1)]
    assert stay(spark.createDataFrame(gone, "doc_id long, text string, no int")) == [("1", "a b c d e f g")]
    assert stay(spark.createDataFrame([(None, "x y", 0), (None, "", 1), (7, "z", 2)], "doc_id long, text string, no int")) == [("7", "z"), ("None", ""), ("None", "x y")]


@pytest.mark.parametrize("short", [0, 16])
def test_near_dedup_crowd(spark, monkeypatch, short):
    """Edits of one text, near to it and to each other or not: no link is lost in lists of any length."""
    monkeypatch.setattr(near_dedup, "SHORT", short)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 1)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    rows = []
    for i in range(160):
        words = list(base if i % 4 or i < 8 else rows[-4][1].split())
        for at in rng.integers(0, len(words), int(rng.integers(0, 16))):
            words[at] = f"w{rng.integers(0, 400)}"
        rows.append((i, " ".join(words)))
    got = near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_components(rows, 2)


def test_toxicity(spark, docs, none):
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(documents, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) >= 0.95
    assert toxicity.score_toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(none, labels).count() == 0 and toxicity.keep_clean(docs, labels).count() == docs.count()
    model = toxicity.CharacterModel({r.gram: r.n for r in toxicity.letter_trigrams(documents).collect()})
    assert toxicity.restore("m0r0n!", model) == "moron" and toxicity.restore("l o s e r", model) == "loser"


@pytest.fixture(scope="module")
def insults(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.Scorer(*toxicity.fitted(documents, labels).value)
    assert scorer.score("you are a moron") >= 0.5 and scorer.score("the name of the other one") < 0.5
    return scorer


@pytest.mark.parametrize("gap", [" ", "  ", "   ", "\t", "/", ".", " - "])
def test_toxicity_spelled_out(insults, gap):
    """Spelled-out words after a one-letter word, in a row, and in sentences of any length."""
    for sentence in ("amoron", "loseridiot", "youareamoron", "theothersandtheone" * 8 + "youareamoron" + "theothersandtheone" * 60):
        words = insults.restorer.words(gap.join(sentence))
        assert "moron" in words or {"loser", "idiot"} <= words, sentence
        assert insults.score(gap.join(sentence)) >= 0.5
    assert insults.score(gap.join("theothersandtheoneandthisisit" * 10)) < 0.5
    assert "moron" in insults.restorer.words("   ".join(" ".join(word) for word in ("what", "a", "moron", "they", "are")))


def test_toxicity_settled(insults):
    """Settling letters on the way changes nothing."""
    text = " ".join("theothersandamoronandtheone" * 30)
    model, before = insults.restorer.model, toxicity.SETTLED
    found = toxicity.restore(text, model)
    try:
        toxicity.SETTLED = 10**9
        assert toxicity.restore(text, model) == found
    finally:
        toxicity.SETTLED = before


def test_toxicity_disguises(insults):
    """Look-alikes at the end and doubled letters."""
    for text, word in {"so tra5h": "trash", "idio7": "idiot", "idio+ there": "idiot", "an idio7, really": "idiot", "idiiot": "idiot", "idiioot": "idiot", "m0ronn!": "moron", "stupiid": "stupid", "stupi|d": "stupid"}.items():
        assert word in insults.restorer.words(text) and insults.score(text) >= 0.5, text
    for word in ("class", "letters", "room", "year2020", "great!", "1st", "v2"):
        assert insults.score(word) < 0.5, word


def test_quality(spark, docs, none):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(documents, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.95
    assert quality.score_quality(docs, labels).count() == docs.count()
    assert quality.score_quality(none, labels).count() == 0 and quality.score_quality(docs, labels.limit(0)).count() == docs.count()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns, name
        if name == "near_dedup":
            components = {c for _, _, c in near_components(texts_of(docs), 5)}
            assert after.count() == len(components)
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert set(contract.queries()) >= {"pipeline", "op1_vantage_point_search", "op10_minhash_dedup"}
