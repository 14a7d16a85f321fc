"""Spellings of one person or organisation, by noisy-channel attribution (problem 5).

Every spelling is read as a form: kind, family name (or an organisation's own word)
and given names (or its generic words), without accents, titles, dates and order.
Frequent forms are candidate canonical forms. A form v is attached to the candidate c
with the highest log n(c) + log P(v | c), where the channel P knows initials, left-out
middle names, short forms, abbreviations and typing errors, if that beats the score of
v as an entity of its own. Attached forms and their spellings make up an entity.

Given names are the frequent words of the collection, beside a general list. Short forms are learned from pairs
of given names that share family names far more often than chance has it, and how likely
initials, short forms and typing errors are is counted in families with one candidate.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.namemodel import COMMON_GIVEN
from lectern.session import spread, written

#: A word in at least this share of all spellings (and at least 5) is a frequent one; at most average length / share words.
FREQUENT = 0.002
#: log P of a typing error in a family name of up to four letters, which is more often another name.
SHORT_FAMILY = -7.0

#: A short form has been seen in so many families, in this share of them beside the full name, so many times as often as by chance.
SHORT_LEAST, SHORT_SHARE, SHORT_LIFT = 3, 0.35, 6.0
#: Short forms of given names in common use (fixed values), without accents; a weak prior beside what is learned.
COMMON_SHORT = {
    "mike": "michael", "mick": "michael", "jenny": "jennifer", "jen": "jennifer", "andy": "andrew", "drew": "andrew", "sasha": "alexander", "alex": "alexander alexandra",
    "pepe": "jose", "bob": "robert", "rob": "robert", "bobby": "robert", "bill": "william", "will": "william", "billy": "william", "jim": "james", "jimmy": "james",
    "jack": "john", "johnny": "john", "joe": "joseph", "joey": "joseph", "tom": "thomas", "tommy": "thomas", "dave": "david", "dan": "daniel", "danny": "daniel",
    "matt": "matthew", "chris": "christopher christine", "nick": "nicholas", "tony": "anthony", "steve": "stephen steven", "ed": "edward edwin", "ted": "edward theodore",
    "ned": "edward", "eddie": "edward", "fred": "frederick friedrich", "freddy": "frederick", "sam": "samuel samantha", "ben": "benjamin", "charlie": "charles", "chuck": "charles",
    "dick": "richard", "rick": "richard", "rich": "richard", "harry": "harold henry", "hal": "harold henry", "hank": "henry", "larry": "lawrence laurence", "ron": "ronald", "don": "donald",
    "ken": "kenneth", "greg": "gregory", "jeff": "jeffrey", "tim": "timothy", "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "meg": "margaret",
    "maggie": "margaret", "kate": "katherine catherine", "kathy": "katherine catherine", "katie": "katherine", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth",
    "sue": "susan", "barb": "barbara", "debbie": "deborah", "cindy": "cynthia", "vicky": "victoria", "mandy": "amanda", "becky": "rebecca", "nell": "helen eleanor",
    "fritz": "friedrich", "hans": "johannes", "heinz": "heinrich", "sepp": "josef", "klaus": "nikolaus", "uli": "ulrich ulrike", "uschi": "ursula", "gabi": "gabriele", "steffi": "stefanie",
    "wolf": "wolfgang", "basti": "sebastian", "max": "maximilian", "margot": "marguerite margaret", "ibo": "ibrahim", "memo": "mehmet", "sulo": "suleyman", "fatos": "fatma", "titi": "therese",
}
#: Generic words of organisations' names (fixed values), without accents.
ORGANISATION_WORDS = frozenset(
    """national institute university press society historical publishing company sons verlag gmbh editions universitesi yayinlari kultur
    sanat vakfi foundation association library museum academy college committee department ministry bureau council publishers books
    dernegi kurumu enstitusu muzesi kutuphanesi bakanligi yayinevi gesellschaft institut universitat akademie bibliothek stiftung
    societe universite academie bibliotheque presses librairie maison fondation limited incorporated corporation brothers""".split()
)
_LINK_WORDS = frozenset("the of and ve und et de du des la le les der die das fur for".split())
_TITLES = frozenset("dr prof professor mr mrs ms miss sir dame lord lady mme mlle frau herr sayin bay bayan jr sr phd author editor ed".split()) - {"ed"}
_PLACEHOLDER_WORDS = frozenset(
    """anonymous anonim anonyme anonymus anon various kolektif collective collectif kollektiv unknown author authors authored unnamed none na n a
    bilinmiyor bilinmeyen yazar yazarlar yok cesitli muhtelif komisyon heyet inconnu auteur auteurs divers unbekannt verfasser autor autoren
    verschiedene not available et al others""".split()
)
_FOLD = str.maketrans({"ı": "i", "İ": "i", "ß": "ss", "ø": "o", "Ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d"})
_UMLAUT = re.compile("([aou])e")
_TOKEN = re.compile(r"[a-z]+")
_DATES = re.compile(r"\b[cb]?\.? ?\d{3,4}\??\s*[-–]?\s*(?:\d{3,4})?\??")
_DOTTED = re.compile(r"\b(?:[a-z]\.){2,}")
#: Abbreviated houses that stand before one word of their own.
_HOUSE = re.compile(r"\bverl\b|\bed\.")
_BRACKETS = re.compile(r"[(\[][^)\]]*[)\]]")


def fold(s: str) -> str:
    """Lower case without accents; spelled-out umlauts are reduced like the accented ones."""
    s = s.translate(_FOLD).lower()
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return _UMLAUT.sub(r"\1", s)


_SHORT = {fold(k): [fold(x) for x in v.split()] for k, v in COMMON_SHORT.items()}
#: log P of what is typed for a given name, before the collection is asked: as it is, its initial, a short form, one or two typing errors.
PRIOR = {"same": -0.2, "initial": -2.3, "short": -3.0, "typo": -4.0, "typos": -7.0}
_COMMON = frozenset(fold(w) for w in COMMON_GIVEN)
_ORG = {fold(w) for w in ORGANISATION_WORDS}


def osa(a: str, b: str, limit: int = 2) -> int:
    """Edit distance with swaps of neighbours, or limit + 1 beyond limit."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > limit:
            return limit + 1
        two, one = one, row
    return min(one[-1], limit + 1)


def _abbreviates(short: str, word: str) -> bool:
    """Whether short has the first letter of word and is a subsequence of it."""
    if not short or short[0] != word[0] or len(short) >= len(word):
        return False
    it = iter(word)
    return all(c in it for c in short)


class Reader:
    """Reads spellings as forms, given the collection's frequent words, its short forms and its channel."""

    def __init__(self, frequent: set[str], short: dict[str, list[str]] | None = None, logs: dict[str, float] | None = None) -> None:
        self.given = (frequent - _ORG - _LINK_WORDS - _TITLES) | _COMMON
        self.short = {k: [x for x in v if x in self.given] for k, v in _SHORT.items()}
        self.short = {k: v for k, v in self.short.items() if v} | (short or {})
        self.logs = PRIOR | (logs or {})
        self.memo: dict[str, list[str]] = {}
        # Words of one edit less or more share a deletion, so typing errors are looked up, not searched for.
        self.near: dict[str, list[str]] = {}
        for g in sorted(self.given):
            for d in _deletions(g):
                self.near.setdefault(d, []).append(g)
        # The first letters of a longer name are a short form as well.
        self.begin: dict[str, list[str]] = {}
        for g in sorted(self.given):
            for k in range(3, len(g) - 1):
                self.begin.setdefault(g[:k], []).append(g)

    def given_of(self, t: str) -> list[str]:
        """The given names that t may stand for: itself, a nickname's full forms, or the nearest by one typing error."""
        if t in self.given:
            return [t, *self.short.get(t, ())]
        if t in self.short:
            return self.short[t]
        if t in self.begin:
            return self.begin[t]
        got = self.memo.get(t)
        if got is None:
            near = {g for d in _deletions(t) for g in self.near.get(d, ())} if len(t) > 2 else ()
            got = sorted(g for g in near if osa(t, g, 1) <= 1)
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[t] = got
        return got

    def org_word(self, t: str) -> str | None:
        if t in _ORG:
            return t
        full = sorted(w for w in _ORG if len(t) > 1 and (_abbreviates(t, w) and len(t) <= 6 or len(t) > 4 and osa(t, w, 1) <= 1))
        # The abbreviation that keeps the word's beginning is likelier.
        return min(full, key=lambda w: (not w.startswith(t), len(w), w)) if full else None

    def form(self, name: str) -> tuple[str, str, tuple[str, ...]] | None:
        """(kind, family, given): kind 'P' or 'O'; None for placeholders and names without letters."""
        plain = fold(name)
        body = _DATES.sub(" ", _BRACKETS.sub(" ", plain))
        tokens = _TOKEN.findall(body)
        if not tokens or all(t in _PLACEHOLDER_WORDS for t in tokens):
            return None
        if any(t in _ORG for t in tokens) or "&" in body or _HOUSE.search(body) or sum(self.org_word(t) is not None for t in tokens) > 1:
            words, own = [], []
            for t in _TOKEN.findall(_DOTTED.sub(lambda m: m.group().replace(".", "") + " ", body)):
                if t in _LINK_WORDS or len(t) == 1:
                    continue
                (words if self.org_word(t) else own).append(t)
            if words and own:
                return "O", " ".join(own), tuple(sorted(words))
        parts = [[t for t in _TOKEN.findall(p) if t not in _TITLES] for p in body.split(",")]
        parts = [p for p in parts if p]
        if not parts:
            return None
        if len(parts) > 1:
            # What stands before the last word of the family part follows the given names, as in the plain order.
            return "P", parts[0][-1], tuple(t for p in [*parts[1:], parts[0][:-1]] for t in p)
        t = parts[0]
        if len(t) == 1:
            return "P", t[0], ()
        backwards = len(t[0]) > 1 and not self.given_of(t[0]) and (len(t[-1]) == 1 or bool(self.given_of(t[-1])))
        return ("P", t[0], tuple(t[1:])) if backwards else ("P", t[-1], tuple(t[:-1]))

    def initials(self, given: tuple[str, ...]) -> set[str]:
        """First letters under which a person's first given name may be looked up."""
        if not given:
            return set()
        return {given[0][0], *(g[0] for g in self.given_of(given[0]))}


def _given_log(reader: Reader, v: str, c: str) -> float | None:
    """log P(typed v | given name c); None if impossible."""
    if v == c:
        return reader.logs["same"]
    if len(v) == 1 or len(c) == 1:
        return reader.logs["initial"] if v[0] == c[0] and len(v) == 1 else None
    if c in reader.short.get(v, ()) or (len(v) > 2 and len(c) > len(v) + 1 and v not in reader.given and c in reader.given and c.startswith(v)):
        return reader.logs["short"]
    if c in reader.given and v not in reader.given and len(c) > 2:
        d = osa(v, c, 2)
        if d == 1:
            return reader.logs["typo"]
        if d == 2 and v[0] == c[0] and len(c) > 4:
            return reader.logs["typos"]
    return None


def channel(reader: Reader, v: tuple, c: tuple, v_support: int) -> float | None:
    """log P(form v | canonical form c); None if v can't be a spelling of c.

    v_support is the number of given names seen with v's family name: a family name
    that several people bear is no typing error.
    """
    (kind, vf, vg), (ckind, cf, cg) = v, c
    if kind != ckind:
        # One short word before a name may be a house's generic word instead of a given name.
        if not (kind == "P" and len(vg) == 1 and any(_abbreviates(vg[0], w) for w in cg)):
            return None
        kind = "O"
    log = -0.2
    if vf != cf:
        if v_support > 1 or min(len(vf), len(cf)) < 3 or osa(vf, cf, 1) > 1:
            return None
        log = -5.0 if len(cf) > 4 else SHORT_FAMILY
    if kind == "O":
        if vg == cg:
            return log - 0.2
        rest = list(cg)
        for w in sorted(vg, key=lambda w: (w not in rest, -len(w))):
            fits = [(0.0 if w == r else -1.5 if _abbreviates(w, r) else -4.0, r) for r in rest if w == r or _abbreviates(w, r) or (len(w) > 4 and osa(w, r, 1) <= 1)]
            if not fits:
                return None
            p, r = max(fits)
            log += p
            rest.remove(r)
        return log - 3.0 * len(rest)
    if not cg or not vg or len(cg[0]) == 1 or len(vg) > len(cg):
        return None
    first = _given_log(reader, vg[0], cg[0])
    if first is None:
        return None
    log += first
    at = 1
    for w in vg[1:]:
        while at < len(cg) and (g := _given_log(reader, w, cg[at])) is None:
            at += 1
            log -= 2.0
        if at >= len(cg):
            return None
        log += g
        at += 1
    return log - 2.0 * (len(cg) - at)


def own_log(reader: Reader, v: tuple, exact_family: bool) -> float:
    """log P of v as an entity of its own, against being a variant of a candidate that fits."""
    if v[0] == "P" and v[2] and (len(v[2][0]) == 1 or v[2][0] not in reader.given):
        return -14.0
    return -9.0 if exact_family else -6.0


_FORM = "kind string, family string, given string"


def spellings(authors: DataFrame, books: DataFrame) -> DataFrame:
    """name, n of all distinct spellings in authors.name and the elements of books.authors; nulls are ignored."""
    a = authors.select(F.col("name").cast("string").alias("name"))
    b = books.select(F.explode("authors").alias("name"))
    return a.unionByName(b).filter(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n"))


def _frequent(names: DataFrame) -> set[str]:
    """Frequent words of all spellings, folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t for s in b.column(0).to_pylist() for t in set(_TOKEN.findall(fold(s))) if len(t) > 1], pa.string())], ["t"])

    n = names.count()
    got = names.select("name").mapInArrow(run, "t string").groupBy("t").count().filter(F.col("count") >= max(5, math.ceil(FREQUENT * n)))
    return {r[0] for r in got.collect()}


def _deletions(word: str) -> set[str]:
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))} if len(word) > 2 else {word}


def _first(given: str = "given") -> F.Column:
    return F.substring_index(given, " ", 1)


def _short_forms(forms: DataFrame) -> dict[str, list[str]]:
    """Full names of each short form: pairs of first given names that share families far more often than by chance.

    All families count, whatever the number of their given names. By chance, a family of
    m given names out of M in all holds one seen in f families with a probability of
    1 - exp(-f m / M), so that common names meet in large families. Exact: a pair that shares the wanted number of v's
    families shares one of those left without the largest of them, one less than
    wanted. So names meet there first, and only for pairs that can still be good the
    other families are counted, which keeps a very common family name from pairing all
    of its given names. What is collected grows with the number of short forms.
    """
    one = forms.filter("kind = 'P'").select("family", _first().alias("g")).filter(F.length("g") > 1).distinct()
    size = one.groupBy("family").agg(F.count("*").alias("m"))
    bears = one.groupBy("g").agg(F.count("*").alias("f")).filter(F.col("f") >= SHORT_LEAST)
    in_order = F.row_number().over(Window.partitionBy("g").orderBy("m", "family"))
    names = written(one.join(bears, "g").join(size, "family").select("family", "g", "f", in_order.alias("place")), "first-names")
    sizes = size.groupBy("m").agg(F.count("*").alias("k")).orderBy("m").toArrow()  # sizes differ, so they are few: their sum is at most the rows
    m, k = (sizes.column(x).to_numpy().astype(np.float64) for x in ("m", "k"))

    def by_chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = m / max(float((m * k).sum()), 1.0)
        for b in batches:
            fs, at = np.unique(np.stack([b.column(x).to_numpy() for x in ("fv", "fc")], 1), axis=0, return_inverse=True)
            got = [(np.expm1(-np.outer(x[:, 0], share)) * np.expm1(-np.outer(x[:, 1], share))) @ k for x in np.split(fs, range(500, len(fs), 500))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(got)[at.ravel()])], [*b.schema.names, "chance"])

    need = F.greatest(F.lit(SHORT_LEAST).cast("bigint"), F.ceil(SHORT_SHARE * F.col("f")))
    v = names.select("family", F.col("g").alias("v"), F.col("f").alias("fv"), need.alias("need"), (F.col("place") <= F.col("f") - need + 1).alias("first"))
    c = names.select("family", F.col("g").alias("c"), F.col("f").alias("fc"))
    # A short form is seen in fewer families than its full name; a typing error is none.
    met = v.filter("first").join(c, "family").filter("fv < fc").groupBy("v", "c").agg(F.count("*").alias("n"), F.first("fv").alias("fv"), F.first("fc").alias("fc"), F.first("need").alias("need"))
    met = met.filter(F.levenshtein("v", "c") > 1).mapInArrow(by_chance, "v string, c string, n bigint, fv bigint, fc bigint, need bigint, chance double")
    wanted = F.greatest(F.col("need"), SHORT_LIFT * F.col("chance"))
    met = written(met.filter(F.col("n") + F.col("need") - 1 >= wanted), "names-that-meet")
    rest = v.filter("not first").select("family", "v").join(met.select("v", "c"), "v").join(c.select("family", "c"), ["family", "c"]).groupBy("v", "c").agg(F.count("*").alias("more"))
    good = met.join(rest, ["v", "c"], "left").filter(F.col("n") + F.coalesce("more", F.lit(0)) >= wanted)
    out: dict[str, list[str]] = {}
    for v_, c_ in sorted((r[0], r[1]) for r in good.select("v", "c").collect()):
        out.setdefault(v_, []).append(c_)
    return out


def _channel_logs(forms: DataFrame, given: frozenset, short: dict[str, list[str]]) -> dict[str, float]:
    """log P of each kind of change of a first given name, counted in families with one candidate.

    In a family with one frequent given name, the others are taken for variants of it.
    What fits no kind is another person and isn't counted.
    """
    spark = forms.sparkSession
    known = F.broadcast(spark.createDataFrame([(g,) for g in sorted(given)], "g string").withColumn("known", F.lit(True)))  # frequent words only
    one = forms.filter("kind = 'P'").select("family", _first().alias("g"), "n").filter(F.length("g") > 0).groupBy("family", "g").agg(F.sum("n").alias("n"))
    one = one.join(known, "g", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    lone = one.filter("known").groupBy("family").agg(F.count("*").alias("m"), F.first("g").alias("c")).filter("m = 1").select("family", "c")
    pairs = F.broadcast(spark.createDataFrame([(v, c, True) for v, cs in short.items() for c in cs] or [("", "", True)], "g string, c string, is_short boolean"))
    x = one.join(lone, "family").join(pairs, ["g", "c"], "left")
    d = F.levenshtein("g", "c")
    kind = F.when(F.col("g") == F.col("c"), "same").when(F.length("g") == 1, F.when(F.substring("c", 1, 1) == F.col("g"), "initial")).when(F.col("is_short"), "short")
    kind = kind.when(d == 1, "typo").when((d == 2) & (F.substring("c", 1, 1) == F.substring("g", 1, 1)), "typos")
    got = {r[0]: r[1] for r in x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect() if r[0]}
    total = sum(got.values())
    # The prior weighs as much as 100 families.
    return {k: math.log((got.get(k, 0) + 100 * math.exp(p)) / (total + 100)) for k, p in PRIOR.items()}


def entities(authors: DataFrame, books: DataFrame) -> DataFrame:
    """name, entity of every spelling that names somebody; equal entity, same person or organisation.

    Placeholders and names without letters are left out. Nulls, blank names and repeated
    rows are handled; an empty table gives an empty result.
    """
    names = written(spellings(authors, books), "spellings")
    spark = names.sparkSession
    frequent = _frequent(names)

    def reading(reader: Reader, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, n, *f[:2], " ".join(f[2])) for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (f := reader.form(s))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), *[pa.string()] * 3), strict=True)], ["name", "n", "kind", "family", "given"])

    def read_with(make) -> DataFrame:
        shared = spark.sparkContext.broadcast(make)
        return spread(names.select("name", "n")).mapInArrow(lambda batches: reading(Reader(*shared.value), batches), f"name string, n bigint, {_FORM}")

    # Read once with the words alone, to learn short forms and channel, then with both.
    plain = written(read_with((frequent,)), "name-readings").groupBy("kind", "family", "given").agg(F.count("*").alias("n"))
    short = _short_forms(plain)
    known = Reader(frequent, short)
    shared = spark.sparkContext.broadcast((frequent, short, _channel_logs(plain, frozenset(known.given), known.short)))
    read_names = written(read_with(shared.value), "name-forms")
    forms = read_names.groupBy("kind", "family", "given").agg(F.sum("n").alias("n"))
    # Distinct first given names, written out, that a family name is seen with.
    support = forms.filter(F.length(_first()) > 1).groupBy("kind", "family").agg(F.count_distinct(_first()).alias("support"))
    forms = forms.join(support, ["kind", "family"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    forms = written(forms.withColumn("id", F.monotonically_increasing_id()), "name-classes")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for b in batches:
            at, key = [], []
            for i, (kind, family, given) in enumerate(zip(*[b.column(c).to_pylist() for c in ("kind", "family", "given")], strict=True)):
                g = tuple(given.split())
                blocks = {f"P{x}" for x in reader.initials(g)} if kind == "P" else {"O"}
                if kind == "P" and len(g) == 1 and 1 < len(g[0]) <= 4 and reader.org_word(g[0]):
                    blocks.add("O")
                for x in blocks:
                    for d in _deletions(family):
                        at.append(i)
                        key.append(f"{x}|{d}")
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), *[b.column(c).take(take) for c in b.schema.names]], ["key", *b.schema.names])

    cols = ["id", "kind", "family", "given", "n", "support"]
    keyed = spread(forms.select(*cols)).mapInArrow(keys, f"key string, id bigint, {_FORM}, n bigint, support bigint")
    v = keyed.select("key", *[F.col(c).alias(f"v_{c}") for c in cols])
    c = keyed.filter(F.substring("key", 1, 1) == F.col("kind")).filter((F.col("kind") == "O") | (F.length(_first()) > 1)).select("key", *[F.col(x).alias(f"c_{x}") for x in cols])
    # A pair meets under several keys; the cheapest conditions of the channel come first.
    fits = (F.col("v_id") != F.col("c_id")) & ((F.col("c_kind") == "O") | (F.size(F.split("v_given", " ")) <= F.size(F.split("c_given", " "))))
    fits &= (F.col("v_family") == F.col("c_family")) | ((F.col("v_support") <= 1) & (F.levenshtein("v_family", "c_family") <= 2))
    pairs = v.join(c, "key").filter(fits).drop("key").distinct()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for b in batches:
            a, z, s = [], [], []
            cols_ = [b.column(x).to_pylist() for x in ("v_id", "v_kind", "v_family", "v_given", "v_n", "v_support", "c_id", "c_kind", "c_family", "c_given", "c_n", "c_support")]
            for vid, vk, vf, vg, vn, vs, cid, ck, cf, cg, cn, cs in zip(*cols_, strict=True):
                vform, cform = (vk, vf, tuple(vg.split())), (ck, cf, tuple(cg.split()))
                p = channel(reader, vform, cform, vs)
                # Rows repeat; of two family names, the one that more people bear may be the right one too.
                odds = math.log(cn / vn) if vf == cf else max(math.log(cn / vn), math.log(max(cs, 1) / max(vs, 1)))
                if p is None or p + odds <= own_log(reader, vform, vf == cf):
                    continue
                a.append(vid), z.append(cid), s.append(p + math.log(cn))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "score"])

    best = pairs.mapInArrow(score, "a bigint, b bigint, score double").groupBy("a").agg(F.max(F.struct("score", F.negate("b").alias("m"))).alias("x"))
    links = best.select("a", F.negate("x.m").alias("b"))
    roots = components(links)
    ids = forms.join(roots, "id", "left").select("kind", "family", "given", F.coalesce("root", "id").alias("entity"))
    return read_names.select("name", "kind", "family", "given").join(ids, ["kind", "family", "given"]).select("name", "entity")


def variant_pairs(authors: DataFrame, books: DataFrame) -> DataFrame:
    """name_a < name_b, all pairs of spellings of an entity."""
    e = written(entities(authors, books), "name-entities")
    a, b = e.select("entity", F.col("name").alias("name_a")), e.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")
