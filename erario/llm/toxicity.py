"""Toxicity: disguised words are restored with a noisy-channel model, then the restored text is scored.

The channel writes a letter as a look-alike, repeats it, or sets blanks and marks between
letters.  A stretch that may be disguised becomes a lattice of the letters it may stand for;
the best path under a character model of the corpus gives the restored words.  Every blank or
mark may also part two words; a stretch of any length is decoded whole.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erario.llm.common import Memo, rows, texts
from erario.sources.writers import written

#: The classifier is fitted on about so many labelled rows, chosen by a hash.
TRAINING_ROWS = 20_000
#: A term speaks for toxic text if it stands in so many distinct training texts and at least so surely.
LEAST_SUPPORT, LEAST_SURE, PRIOR_ROWS = 4, 0.8, 1.0
MARK_WORDS = 6
#: The largest number of terms of a model, and the lengths of the word beginnings that are terms too.
MOST_TERMS, STEMS = 20_000, (4, 5, 6)
SHORTEST = min(STEMS)

# Letters that digits and marks may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
# Costs of the channel, in natural logarithms: look-alike, letter left out as a repeat, mark left out, mark that parts words, letter as it is.
LOOKALIKE_COST, REPEAT_COST, MARK_COST, BOUNDARY_COST, PLAIN_COST = 1.0, 0.7, 0.9, 1.8, 0.05
EDGE, OTHER = "^", "~"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = EDGE + LETTERS
#: The place of a symbol by its code.
PLACES = np.array([max(SYMBOLS.find(chr(code)), 0) for code in range(128)])
#: So many words are held, and so many trigrams counted at once.
HELD_WORDS, COUNTED = 50_000, 1 << 20
WORDS = re.compile(r"[^\W\d_]+")
#: What may be disguised, besides words with doubled letters, each after a quick pattern without which a text has none:
#: letters with look-alikes at any place, single letters set apart, words cut by marks.
DISGUISED = [
    (re.compile(r"[0-9@$!|+€]"), re.compile(r"(?<!\S)(?=\S*[^\W\d_])\S*[0-9@$!|+€]\S*")),
    (re.compile(r"[\s./\-_*~][^\W_][\s./\-_*~]+[^\W_](?!\w)"), re.compile(r"(?<!\w)[^\W_](?=[\s./\-_*~])(?:[\s./\-_*~]+[^\W_]){2,}(?!\w)")),
    (re.compile(r"[.\-_*~](?<=[^\W\d_].)[^\W\d_]"), re.compile(r"(?<!\w)[^\W\d_]+(?:[.\-_*~][^\W\d_]+)+(?!\w)")),
]
DOUBLED, THRICE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
#: What a lattice reads at once: a gap of any width, or a character.
UNITS = re.compile(r"[\s./\-_*~]+|.", re.DOTALL)
GAP = frozenset(" \t\n\r\x0b\x0c./-_*~")
#: After so many units the letters on which all paths agree are settled, so that memory does not follow the length.
SETTLED = 256


class CharacterModel:
    """Letter trigrams of the corpus, smoothed with bigrams and single letters."""

    def __init__(self, counts: dict[str, int]):
        two, one = Counter(), Counter()
        for gram, n in counts.items():
            two[gram[:2]] += n
            one[gram[2]] += n
        total = sum(one.values()) + 28
        pairs, starts = Counter(), Counter()
        for gram, n in counts.items():
            pairs[gram[1:]] += n
            starts[gram[1]] += n
        self.cost: dict[str, float] = {}
        for a in SYMBOLS:
            for b in SYMBOLS:
                for c in SYMBOLS:
                    single = (one[c] + 1) / total
                    pair = (pairs[b + c] + 20 * single) / (starts[b] + 20)
                    self.cost[a + b + c] = -math.log((counts.get(a + b + c, 0) + 20 * pair) / (two[a + b] + 20))

    def step(self, state: str, letter: str) -> float:
        return self.cost.get(state + letter, 3.0)  # letters beyond a-z cost the same everywhere


def options(unit: str, before: str, two_before: str, narrowest: int) -> list[tuple[str, float]]:
    """What a unit may stand for, with the channel's cost: letters, the empty text that leaves it out, or a blank between words.

    A gap that is wider than the narrowest of its stretch is likely to part words.
    """
    if unit.isalpha():
        if unit != before:
            return [(unit, PLAIN_COST)]
        return [(unit, PLAIN_COST), ("", REPEAT_COST if unit != two_before else 0.1)]
    if unit[0] in GAP or unit.isspace():
        return [("", MARK_COST * (1 + len(unit) - narrowest)), (" ", BOUNDARY_COST)]
    found = [(letter, LOOKALIKE_COST) for letter in LOOKALIKES.get(unit, "")]
    found.append(("", 2.5 if unit == "!" else 6.0))
    if not unit.isalnum():
        found.append((" ", BOUNDARY_COST))
    return found


class Lexicon:
    """Words and word beginnings (``moro*``) with the cost of each as a whole, from ``share``: how often one of all words is it."""

    def __init__(self, share: dict[str, float]):
        self.words = {term: -math.log(p) for term, p in share.items() if not term.endswith("*")}
        self.stems = {term[:-1]: -math.log(p) for term, p in share.items() if term.endswith("*")}
        self.beginnings = {word[:n] for word in [*self.words, *self.stems] for n in range(1, len(word) + 1)}


NO_WORDS = Lexicon({})


def undoubled(word: str, model: CharacterModel) -> str:
    """``restore`` for letters alone, none three times in a row: what is best for one doubled letter does not depend on the others."""
    edged = EDGE + "".join(c if c in LETTERS else OTHER for c in word) + EDGE
    letters = [word[0]]
    for i in range(1, len(word)):
        if word[i] == word[i - 1]:
            x, c, n = edged[i - 1], edged[i], edged[i + 2]
            if PLAIN_COST + model.step(x + c, c) + model.step(c + c, n) > REPEAT_COST + model.step(x + c, n):
                continue
        letters.append(word[i])
    return "".join(letters)


def restore(text: str, model: CharacterModel, lexicon: Lexicon = NO_WORDS) -> str:
    """The cheapest letters for a stretch, with blanks between words: Viterbi over the whole stretch.

    A state is the last two letters, or ``>`` and the beginning of a word of the lexicon,
    which costs nothing before the word is complete.
    """
    if text.isalpha() and not THRICE.search(text):
        first = DOUBLED.search(text)
        if not first or text[: first.end() - 1] not in lexicon.beginnings:
            return undoubled(text, model)
    units = UNITS.findall(text)
    narrowest = min((len(unit) for unit in units if unit[0] in GAP or unit.isspace()), default=1)
    cost_of, start = model.cost, EDGE + EDGE
    best: dict[str, tuple[float, tuple]] = {start: (0.0, ())}
    done: list[str] = []
    before = two_before = ""
    for number, unit in enumerate(units, 1):
        following: dict[str, tuple[float, tuple]] = {}

        def meet(new: str, now: float, way: tuple, following=following) -> None:
            if new not in following or now < following[new][0]:
                following[new] = (now, way)

        choices = options(unit, before, two_before, narrowest)
        for state, (cost, path) in best.items():
            spelled = state[1:] if state[0] == ">" else "" if state == start else None
            for letter, channel in choices:
                now = cost + channel
                if not letter or letter == " " and state == start:
                    meet(state, now, path)
                elif letter == " ":
                    if state[0] != ">":
                        meet(start, now + cost_of.get(state + EDGE, 3.0), (path, " "))
                    elif spelled in lexicon.words:
                        meet(start, now + lexicon.words[spelled], (path, " "))
                else:
                    symbol, way = letter if letter in LETTERS else OTHER, (path, letter)
                    if state[0] != ">":
                        meet(state[1] + symbol, now + cost_of.get(state + symbol, 3.0), way)
                    if spelled is not None and (longer := spelled + letter) in lexicon.beginnings:
                        meet(">" + longer, now, way)
                        if longer in lexicon.stems:
                            meet("".join(c if c in LETTERS else OTHER for c in longer[-2:]), now + lexicon.stems[longer], way)
        best = following
        before, two_before = unit, before
        if number % SETTLED == 0:
            best = _settled(best, done)
    ends = [(cost + (0.0 if state == start else lexicon.words.get(state[1:], math.inf) if state[0] == ">" else model.step(state, EDGE)), path) for state, (cost, path) in best.items()]
    return "".join(done + _letters(min(ends, key=lambda x: x[0])[1])).strip()


def _letters(path: tuple) -> list[str]:
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return letters[::-1]


def _settled(best: dict[str, tuple[float, tuple]], done: list[str]) -> dict[str, tuple[float, tuple]]:
    """Moves the letters that all paths begin with to ``done``; no path changes."""
    ways = {state: _letters(path) for state, (_, path) in best.items()}
    common = len(os.path.commonprefix(list(ways.values())))
    done += next(iter(ways.values()))[:common]
    kept = {}
    for state, (cost, _) in best.items():
        path: tuple = ()
        for letter in ways[state][common:]:
            path = (path, letter)
        kept[state] = (cost, path)
    return kept


class Restorer:
    """Words of a text as they stand, and the words restored from stretches that may be disguised."""

    def __init__(self, counts: dict[str, int], lexicon: Lexicon = NO_WORDS):
        self.model = CharacterModel(counts)
        self.known = Memo(lambda stretch: tuple(restore(stretch, self.model, lexicon).split()), limit=50_000)

    def words(self, text: str) -> set[str]:
        lower = text.lower()
        found = set(WORDS.findall(lower))
        for word in list(filter(DOUBLED.search, found)):
            found.update(self.known[word])
        for quick, disguised in DISGUISED:
            if quick.search(lower):
                for match in disguised.finditer(lower):
                    found.update(self.known[match.group()])
        return found


def count_trigrams(words: list[str]) -> np.ndarray:
    """How often each trigram stands in words of a-z, two edges before and one after each; place ``k`` is for the symbols ``k // 729``, ``k // 27 % 27`` and ``k % 27``."""
    marked = np.frombuffer((EDGE * 2 + (EDGE * 3).join(words) + EDGE).encode(), np.uint8)
    counts = np.zeros(len(SYMBOLS) ** 3, np.int64)
    for at in range(0, len(marked) - 2, COUNTED):
        part = PLACES[marked[at : at + COUNTED + 2]]
        counts += np.bincount(729 * part[:-2] + 27 * part[1:-1] + part[2:], minlength=len(counts))
    counts[::729] = 0  # two edges at the end: from one word to the next
    return counts


def letter_trigrams(docs: DataFrame) -> DataFrame:
    """``gram, n`` over the words of all documents that are made of a-z; at most 27^3 grams, summed in each task first."""
    plain = re.compile(r"(?<![^\W_])[a-z]+(?![^\W_])")
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])

    def count(batches):
        counts, words = count_trigrams([]), []
        for batch in batches:
            for text in texts(batch):
                words += plain.findall(text.lower())
                if len(words) >= HELD_WORDS:
                    counts += count_trigrams(words)
                    words.clear()
        counts += count_trigrams(words)
        met = np.flatnonzero(counts).tolist()
        if met:
            yield rows(schema, gram=[SYMBOLS[k // 729] + SYMBOLS[k // 27 % 27] + SYMBOLS[k % 27] for k in met], n=counts[met])

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_words(docs: DataFrame, labels: DataFrame, counts: dict[str, int]) -> DataFrame:
    """``toxic, words`` of the labelled texts that may be learned from; of texts whose smallest word hashes are the same, near copies, one stays."""
    usable = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    rate = min(1.0, TRAINING_ROWS / max(1, usable.count()))
    sample = usable.filter(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(rate * 1_000_000)).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string")).join(F.broadcast(sample), "label_id")  # about TRAINING_ROWS rows
    schema = pa.schema([("toxic", pa.int32()), ("words", pa.list_(pa.string()))])

    def split(batches):
        restorer = Restorer(counts)
        for batch in batches:
            yield rows(schema, toxic=batch.column("toxic"), words=[sorted(restorer.words(text)) for text in texts(batch)])

    found = own.select("toxic", "text").mapInArrow(split, "toxic int, words array<string>")
    mark = F.slice(F.array_sort(F.transform("words", lambda w: F.xxhash64(w))), 1, MARK_WORDS)
    return found.withColumn("mark", mark).dropDuplicates(["mark", "toxic"]).drop("mark")


def learn_terms(training: DataFrame) -> dict[str, tuple[float, float]]:
    """Terms that speak for toxic text with the chance that a text with them is toxic, and their share of all words; a bounded table."""
    stems = F.flatten(F.array(*[F.transform(F.filter("words", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]))
    terms = training.select("toxic", F.explode(F.array_distinct(F.concat("words", stems))).alias("term"))
    counted = terms.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    sure = F.col("toxic") / (F.col("n") + PRIOR_ROWS)
    chosen = counted.filter((F.col("toxic") >= LEAST_SUPPORT) & (sure >= LEAST_SURE)).orderBy(F.desc("toxic"), "term").limit(MOST_TERMS)
    words = training.agg(F.sum(F.size("words"))).first()[0]
    return {row.term: (row.sure, row.n / words) for row in chosen.select("term", sure.alias("sure"), "n").collect()}


class Scorer:
    def __init__(self, counts: dict[str, int], terms: dict[str, tuple[float, float]]):
        self.restorer = Restorer(counts, Lexicon({term: share for term, (_, share) in terms.items()}))
        sure = {term: chance for term, (chance, _) in terms.items()}
        #: A word that begins otherwise meets no term.
        self.beginnings = {term.removesuffix("*")[:SHORTEST] for term in terms}
        self.weight = Memo(lambda word: max([sure.get(word, 0.0), *(sure.get(word[:n] + "*", 0.0) for n in STEMS)]))

    def score(self, text: str) -> float:
        """The chance that at least one sign is right; 0.01 for a text without any."""
        doubt = 0.99
        signs = [word for word in self.restorer.words(text) if word[:SHORTEST] in self.beginnings]
        for weight in sorted(filter(None, map(self.weight.__getitem__, signs))):
            doubt *= 1 - weight
        return 1 - doubt


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def fitted(docs: DataFrame, labels: DataFrame) -> Broadcast:
    """The tables of a scorer, both of bounded size: the character model's counts and the terms."""
    counts = {row.gram: row.n for row in letter_trigrams(docs).collect()}  # at most 27^3 rows
    terms = learn_terms(written(training_words(docs, labels, counts), "training"))
    return docs.sparkSession.sparkContext.broadcast((counts, terms))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; only the text enters the score.

    The character model counts the words of all documents; the classifier is fitted on about
    ``TRAINING_ROWS`` labelled rows whose checksum allows it.  Both tables are bounded and go
    to the tasks with the function.  The texts are never shuffled.

    A null or empty text scores 0.01.  A null doc_id is not held out.  Repeated rows give one
    row each; other columns are not read; without labels nothing is toxic.
    """
    model = fitted(docs, labels)

    def score(batches):
        scorer = Scorer(*model.value)
        for batch in batches:
            yield rows(SCORED, doc_id=batch.column("doc_id"), score=[scorer.score(text) for text in texts(batch)])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under one half, with their columns as they are."""
    model = fitted(docs, labels)

    def keep(batches):
        scorer = Scorer(*model.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(text) < 0.5 for text in texts(batch)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
