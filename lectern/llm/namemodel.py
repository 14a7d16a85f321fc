"""What a collection itself tells about person names: learned given names and contexts (problem 9).

A candidate is a capitalised word before another one. Titles and closings of letters
are the only fixed cues. Words that stand right after them as first words of candidates,
or that recur inside sentences before many different words and never in small letters,
are given names; contexts in which mostly such words stand are cues; words that stand in
those contexts are given names as well. All counts cover all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import written

#: Titles and closings before a name, in small letters without dots (fixed values).
TITLES = frozenset("dr prof professor mr mrs ms miss sir madame monsieur m mme mlle frau herr herrn sayın bay bayan doktor".split())
CLOSINGS = frozenset("regards sincerely yours cordialement grüße grüßen sevgiler saygılar saygılarımla".split())
SEEDS = TITLES | CLOSINGS
#: Given names common in several countries (fixed values): one weak feature beside what is learned.
COMMON_GIVEN = frozenset(
    """james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah
    charles karen christopher lisa daniel nancy matthew betty anthony sandra mark ashley paul emily steven kimberly andrew margaret
    george donna edward carol brian michelle kevin amanda jason laura peter helen henry alice jack emma oliver olivia noah sophia lucas
    mehmet mustafa ahmet ali hüseyin hasan ibrahim ismail osman yusuf murat ömer ramazan halil süleyman fatma ayşe emine hatice zeynep
    elif meryem şerife zehra sultan merve özlem selin deniz can cem emre burak kemal hans peter wolfgang klaus jürgen michael thomas
    andreas stefan christian uwe werner horst frank martin monika petra ursula sabine renate helga karin brigitte ingrid erika anna
    jean pierre michel philippe andré alain jacques bernard marcel daniel marie jeanne françoise monique catherine nathalie isabelle
    jacqueline sylvie martine julie camille luc nicolas claude""".split()
)
#: A given name needs so many occurrences after cues, and this share of all candidates that begin with it.
LEAST, SHARE = 2, 0.1
#: A context is a cue from so many candidates on, if this share of them begins with a given name.
CONTEXT_LEAST, CONTEXT_SHARE = 4, 0.3
#: Rounds in which names show contexts and contexts show names.
ROUNDS = 3
#: Inside sentences: occurrences, different second words, and the largest share in small letters.
INSIDE, DIFFERENT, SMALL = 6, 5, 0.05
#: Learned tables hold what makes up at least this part of all candidates (or words), so they have at most 1 / PART rows.
PART = 1e-5
ORDINARY = 1e-4

UP = r"[^\W\d_a-zß-öø-ÿçğışöü]"  # an upper-case letter, near enough
NAME_WORD = rf"{UP}[\w’'-]+"
WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_PAIR = re.compile(rf"(?<![\w’'-])(?=({NAME_WORD})\s{{1,2}}(?:{UP}\.?\s{{1,2}})?({NAME_WORD}))")
_INSIDE = re.compile(r"[a-zß-öø-ÿçğışöü][,’']?\s$")
#: A word in small letters that is no part of an address or a handle.
LOWER_WORD = re.compile(r"(?<![\w@.+-])[a-zß-öø-ÿçğışöü][^\W\d_]*(?![\w@+-]|\.\w)")
#: Characters in which contexts of a candidate are looked for.
REACH = 40


def folded(word: str) -> str:
    """Small letters, with one kind of i."""
    return word.replace("İ", "i").replace("I", "ı").lower().replace("ı", "i")


_SEEDS = frozenset(map(folded, SEEDS))
_GENERAL = frozenset(map(folded, COMMON_GIVEN))


def contexts(text: str, start: int, end: int) -> tuple[str, str, str, str]:
    """One and two words before a span, and one and two words after it, folded; empty where there are none."""
    b, a = WORD.findall(text[max(0, start - REACH) : start]), WORD.findall(text[end : end + REACH])
    l1, r1 = folded(b[-1]) if b else "", folded(a[0]) if a else ""
    l2, r2 = f"{folded(b[-2])} {l1}" if len(b) > 1 else "", f"{r1} {folded(a[1])}" if len(a) > 1 else ""
    return l1, l2, r1, r2


@dataclass
class NameModel:
    """Learned tables: given names with their strength (0 to 1), contexts by kind with the share of names, ordinary words."""

    given: dict[str, float] = field(default_factory=dict)
    cues: dict[tuple[str, str], float] = field(default_factory=dict)
    ordinary: frozenset = frozenset()

    def __post_init__(self) -> None:
        self.left1 = {w for k, w in self.cues if k == "l1"} | _SEEDS
        self.names = frozenset(self.given) | _GENERAL
        self.left2 = {tuple(w.split(" ")) for k, w in self.cues if k == "l2"}

    def strength(self, word: str) -> float:
        """How surely a folded word is a given name."""
        return max(self.given.get(word, 0.0), 0.3 if word in _GENERAL else 0.0)

    def before(self, l1: str, l2: str) -> float:
        """Share of names after a context; titles and closings count as sure."""
        return max(0.95 if l1 in _SEEDS else 0.0, self.cues.get(("l1", l1), 0.0), self.cues.get(("l2", l2), 0.0))

    def after(self, r1: str, r2: str) -> float:
        """Share of names before a context."""
        return max(self.cues.get(("r1", r1), 0.0), self.cues.get(("r2", r2), 0.0))

    def hopeless(self, text: str) -> bool:
        """Whether a text holds neither a given name nor a cue before one."""
        words = WORD.findall(folded(text))
        some = set(words)
        return self.names.isdisjoint(some) and self.left1.isdisjoint(some) and self.left2.isdisjoint(zip(words, words[1:], strict=False))


_COLS = ["word", "n", "a", "b", "l1", "l2", "r1", "r2", "inside"]
_SCHEMA = "word string, n bigint, a string, b string, l1 string, l2 string, r1 string, r2 string, inside boolean"


def _observed(docs: DataFrame) -> DataFrame:
    """One reading of all texts: rows (word, n) of words in small letters, and a row for each candidate."""
    types = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.bool_()]

    def batch(cols: dict[str, list], size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(size, t) for c, t in zip(_COLS, types, strict=True)], _COLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: Counter = Counter()
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                small.update(LOWER_WORD.findall(text))
                for m in _PAIR.finditer(text):
                    a = folded(m.group(1))
                    if a not in _SEEDS:
                        rows.append((a, folded(m.group(2)), *contexts(text, m.start(), m.end(2)), bool(_INSIDE.search(text[max(0, m.start() - 3) : m.start()]))))
            yield batch(dict(zip(_COLS[2:], map(list, zip(*rows, strict=True)), strict=True)), len(rows)) if rows else batch({}, 0)
            if len(small) > 1_000_000:
                yield batch({"word": list(small), "n": list(small.values())}, len(small))
                small.clear()
        yield batch({"word": list(small), "n": list(small.values())}, len(small))

    return docs.select("text").mapInArrow(run, _SCHEMA)


def learned(docs: DataFrame) -> NameModel:
    """The model of all texts of docs.text (no nulls)."""
    seen = written(_observed(docs), "name-candidates")
    # Words come as written in small letters; candidates' words are folded, so these are as well.
    small = seen.filter(F.col("word").isNotNull()).groupBy(F.translate("word", "ı", "i").alias("w")).agg(F.sum("n").alias("n"))
    words_n = small.agg(F.sum("n")).first()[0] or 0
    ordinary = frozenset(r[0] for r in small.filter(F.col("n") > max(3, ORDINARY * words_n)).select("w").collect())
    cand = seen.filter(F.col("a").isNotNull())
    total = cand.count()
    if not total:
        return NameModel(ordinary=ordinary)
    least = max(LEAST, PART * total)
    is_seed = F.col("l1").isin(sorted(_SEEDS))
    # Candidates are grouped before anything is joined, so frequent first words cost no more than rare ones.
    pairs = cand.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(is_seed).alias("cued"), F.count_if("inside").alias("inside"))
    words_ = pairs.groupBy("a").agg(F.sum("n").alias("n"), F.sum("cued").alias("cued"), F.sum("inside").alias("inside"), F.count("*").alias("different"))
    words_ = written(words_.join(small.select(F.col("w").alias("a"), F.col("n").alias("small")), "a", "left").fillna(0, ["small"]), "name-words")
    after_seed = (F.col("cued") >= least) & (F.col("cued") >= SHARE * F.col("n")) & (F.col("small") <= F.col("n"))
    inside = (F.col("inside") >= max(INSIDE, PART * total)) & (F.col("different") >= DIFFERENT) & (2 * F.col("inside") >= F.col("n")) & (F.col("small") <= SMALL * F.col("n"))
    kinds = ["l1", "l2", "r1", "r2"]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("context")) for k in kinds]))
    by_context = cand.select("a", "b", each.alias("x")).filter("x.context <> ''").groupBy("x.kind", "x.context", "a", "b").agg(F.count("*").alias("n")).groupBy("kind", "context", "a")
    by_context = written(by_context.agg(F.sum("n").alias("n"), F.count("*").alias("different")), "name-contexts")
    known = words_.filter(after_seed | inside).select("a")  # at most 1 / PART rows
    for _ in range(ROUNDS):
        names = {r[0] for r in known.collect()} | _GENERAL
        marked = by_context.join(F.broadcast(words_.sparkSession.createDataFrame([(x,) for x in sorted(names)], "a string").withColumn("known", F.lit(1))), "a", "left").fillna(0, ["known"])
        by = marked.groupBy("kind", "context").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("known")).alias("known"), F.sum(F.col("different") * F.col("known")).alias("different"))
        # One recurring phrase is no cue; different second words have to stand in it.
        good = by.filter((F.col("known") >= max(CONTEXT_LEAST, PART * total)) & (F.col("different") >= CONTEXT_LEAST) & (F.col("known") >= CONTEXT_SHARE * F.col("n")))
        cues = {(r[0], r[1]): float(r[3]) / float(r[2]) for r in good.select("kind", "context", "n", "known").collect()}
        left = [F.col(k).isin([w for kk, w in cues if kk == k] or [""]) & (F.col(k) != "") for k in kinds]
        cued = cand.filter(is_seed | left[0] | left[1] | left[2] | left[3]).groupBy("a").agg(F.count("*").alias("k"))
        final = words_.join(cued, "a", "left").fillna(0, ["k"])
        strong = final.filter(((F.col("k") >= least) & (F.col("k") >= SHARE * F.col("n")) & (F.col("small") <= 2 * F.col("n"))) | inside)
        known = strong.select("a")
    given = {r[0]: max(0.5, min(1.0, float(r[1]) / float(r[2]))) for r in strong.select("a", "k", "n").collect()}
    return NameModel(given, cues, ordinary)
