"""Labelling by declarative pattern tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalars import ascii_text


@dataclass(frozen=True)
class Label:
    """A label, the patterns that give it, those that veto it, its rank and the moods it suggests."""

    slug: str
    patterns: tuple[str, ...]
    veto: tuple[str, ...] = ()
    rank: int = 2
    moods: tuple[str, ...] = ()


# Specific genres come first, general ones last.
_FIRST = "bilim-kurgu fantastik distopya polisiye gerilim korku cizgi-roman siir tiyatro tarihi-kurgu mizah cocuk genc-yetiskin macera romantik".split()
_LAST = "roman klasik".split()


def _ranked(labels: list[Label]) -> tuple[Label, ...]:
    return tuple(replace(x, rank=1 if x.slug in _FIRST else 3 if x.slug in _LAST else 2) for x in labels)


# Genres with the patterns that give them, those that veto them, and the moods they suggest.
GENRES = _ranked([
    Label("roman", (r"\bfiction\b", r"\bnovels?\b", r"\bliterary fiction\b"), moods=("dusundurucu", "melankolik")),
    Label("klasik", (r"\bclassic(s|al literature)?\b", r"\bworld literature\b", r"\bcanon\b", r"\b19th century\b.*\bfiction\b"), moods=("dusundurucu", "melankolik")),
    Label("bilim-kurgu", (r"\bscience fiction\b", r"\bsci-?fi\b", r"\bspace opera\b", r"\bcyberpunk\b", r"\btime travel\b", r"\bextraterrestrial\b", r"\bspace flight\b", r"\brobots?\b"), moods=("epik", "dusundurucu", "gizemli")),
    Label("fantastik", (r"\bfantasy\b", r"\bmagic\b", r"\bwizards?\b", r"\bdragons?\b", r"\bmythical\b", r"\bsword and sorcery\b", r"\bepic fantasy\b", r"\bimaginary places\b"), moods=("epik", "maceraci", "umutlu")),
    Label("distopya", (r"\bdystopi", r"\butopi", r"\btotalitarian", r"\bpost-?apocalyp"), moods=("karanlik", "dusundurucu", "gerilimli")),
    Label("polisiye", (r"\bdetective\b", r"\bmystery\b", r"\bcrime\b", r"\bmurder\b", r"\bwhodunit\b", r"\bprivate investigators?\b", r"\bpolice procedural\b"), moods=("gizemli", "gerilimli")),
    Label("gerilim", (r"\bthriller\b", r"\bsuspense\b", r"\bespionage\b", r"\bspy stories\b", r"\bconspirac"), moods=("gerilimli", "karanlik")),
    Label("korku", (r"\bhorror\b", r"\bghost stories\b", r"\bvampires?\b", r"\bsupernatural\b", r"\bmonsters?\b", r"\bhaunted\b"), moods=("karanlik", "gerilimli")),
    Label("macera", (r"\badventure\b", r"\bsurvival\b", r"\bvoyages and travels\b", r"\bexplorers?\b", r"\bsea stories\b", r"\bquests?\b"), moods=("maceraci", "heyecanli")),
    Label("romantik", (r"\bromance\b", r"\blove stories\b", r"\bcourtship\b", r"\bman-woman relationships\b"), moods=("romantik", "sicak")),
    Label("tarihi-kurgu", (r"\bhistorical fiction\b", r"\bhistorical novel", r"\bwar stories\b"), moods=("epik", "melankolik")),
    Label("genc-yetiskin", (r"\byoung adult\b", r"\bteenagers?\b", r"\bcoming of age\b", r"\bya fiction\b", r"\bhigh school\b"), moods=("umutlu", "heyecanli")),
    Label("cocuk", (r"\bjuvenile fiction\b", r"\bchildren'?s (stories|fiction|literature)\b", r"\bpicture books?\b", r"\bfairy tales\b"), moods=("sicak", "umutlu")),
    Label("cizgi-roman", (r"\bcomics?\b", r"\bgraphic novels?\b", r"\bmanga\b", r"\bcartoons?\b"), moods=("heyecanli", "komik")),
    Label("siir", (r"\bpoetry\b", r"\bpoems?\b", r"\bverse\b", r"\bsonnets?\b"), moods=("melankolik", "dusundurucu")),
    Label("tiyatro", (r"\bdrama\b", r"\bplays\b", r"\btheater\b", r"\btheatre\b", r"\btragedies\b"), moods=("dusundurucu", "melankolik")),
    Label("deneme", (r"\bessays?\b", r"\bcriticism\b", r"\bliterary collections\b"), moods=("dusundurucu",)),
    Label("felsefe", (r"\bphilosoph", r"\bethics\b", r"\bmetaphysics\b", r"\bexistentialism\b", r"\bstoicism\b", r"\blogic\b"), moods=("dusundurucu",)),
    Label("psikoloji", (r"\bpsychology\b", r"\bpsychological\b", r"\bmental health\b", r"\bcognitive\b", r"\bpsychiatry\b", r"\bbehavioral science\b"), veto=(r"\bpsychological fiction\b", r"\bmental healing\b"), moods=("dusundurucu", "ilham-verici")),
    Label("kisisel-gelisim", (r"\bself-?help\b", r"\bself-?actualization\b", r"\bpersonal development\b", r"\bhabits?\b", r"\bmotivation\b", r"\bproductivity\b"), moods=("ilham-verici", "umutlu")),
    Label("tarih", (r"\bhistory\b", r"\bhistoriograph", r"\bworld war\b", r"\bancient\b", r"\bcivilization\b", r"\bempire\b"), veto=(r"\bhistorical fiction\b", r"\bart history\b", r"\bhistory and criticism\b", r"\bcase histories\b"), moods=("dusundurucu", "epik")),
    Label("biyografi", (r"\bbiograph", r"\bautobiograph", r"\bmemoirs?\b", r"\bdiaries\b", r"\bpersonal narratives\b"), moods=("ilham-verici", "melankolik")),
    Label("bilim", (r"\bscience\b", r"\bphysics\b", r"\bbiology\b", r"\bastronomy\b", r"\bchemistry\b", r"\bevolution\b", r"\bmathematics\b", r"\bneuroscience\b"), veto=(r"\bscience fiction\b", r"\bsocial science", r"\bpolitical science\b", r"\bcomputer science\b", r"\blibrary science\b", r"\bmilitary art and science\b", r"\bscience fantasy\b"), moods=("dusundurucu", "ilham-verici")),
    Label("teknoloji", (r"\bcomputer\b", r"\bprogramming\b", r"\bartificial intelligence\b", r"\bsoftware\b", r"\bengineering\b", r"\binternet\b", r"\bdata\b"), moods=("dusundurucu",)),
    Label("is-ekonomi", (r"\bbusiness\b", r"\beconomics\b", r"\bmanagement\b", r"\bfinance\b", r"\bentrepreneurship\b", r"\bmarketing\b", r"\binvestment"), moods=("ilham-verici",)),
    Label("politika", (r"\bpolitic", r"\bgovernment\b", r"\bdemocracy\b", r"\bsocial science\b", r"\binternational relations\b", r"\bsociolog"), moods=("dusundurucu", "karanlik")),
    Label("din-maneviyat", (r"\breligion\b", r"\bspiritual", r"\btheolog", r"\bislam\b", r"\bchristian", r"\bbuddhis", r"\bmeditation\b", r"\bmysticism\b"), moods=("sakinlestirici", "dusundurucu")),
    Label("sanat", (r"\bart history\b", r"\bfine arts?\b", r"\bart criticism\b", r"\bpainting\b", r"\bphotograph", r"\barchitecture\b", r"\bsculpture\b", r"\bmusic\b", r"\bcinema\b", r"\bmotion pictures?\b", r"\bexhibitions\b"), veto=(r"\bmilitary art\b", r"\bart of war\b"), moods=("ilham-verici",)),
    Label("gezi", (r"\bdescription and travel\b", r"\btravel guides?\b", r"\bguidebooks?\b", r"\btravelers'? writings\b", r"\btourism\b"), moods=("maceraci", "sakinlestirici")),
    Label("yemek", (r"\bcooking\b", r"\bcookbooks?\b", r"\brecipes\b", r"\bgastronom"), moods=("sicak", "sakinlestirici")),
    Label("mizah", (r"\bhumor\b", r"\bsatire\b", r"\bcomic fiction\b", r"\bwit\b", r"\bparody\b"), moods=("komik",)),
    Label("saglik", (r"\bhealth\b", r"\bmedicine\b", r"\bfitness\b", r"\bnutrition\b", r"\bdiet\b"), moods=("ilham-verici", "sakinlestirici")),
])
# Moods with their patterns.
MOODS = (
    Label("heyecanli", (r"\bthriller\b", r"\baction\b", r"\badventure\b", r"\bchase\b", r"\bfast-paced\b", r"\bescapes\b")),
    Label("dusundurucu", (r"\bphilosoph", r"\bexistential", r"\bmoral\b", r"\bethics\b", r"\bideas\b", r"\bintrospect", r"\bconsciousness\b")),
    Label("karanlik", (r"\bdark\b", r"\btragedy\b", r"\bviolence\b", r"\bdespair\b", r"\bnoir\b", r"\bdystopi", r"\bhorror\b", r"\bdeath\b")),
    Label("romantik", (r"\bromance\b", r"\blove\b", r"\bpassion\b", r"\bcourtship\b")),
    Label("komik", (r"\bhumor\b", r"\bcomed", r"\bsatire\b", r"\bfunny\b", r"\bwit\b")),
    Label("sakinlestirici", (r"\bmeditation\b", r"\bmindfulness\b", r"\bnature\b", r"\bgardening\b", r"\bslow\b", r"\bcozy\b", r"\bcalm\b")),
    Label("ilham-verici", (r"\binspiration\b", r"\bmotivation\b", r"\bsuccess\b", r"\bcourage\b", r"\bperseverance\b", r"\bhope\b")),
    Label("melankolik", (r"\bgrief\b", r"\bloss\b", r"\bnostalgi", r"\bloneliness\b", r"\bmelanchol", r"\bsorrow\b")),
    Label("gerilimli", (r"\bsuspense\b", r"\btension\b", r"\bpsychological thriller\b", r"\bparanoia\b")),
    Label("sicak", (r"\bfamily\b", r"\bfriendship\b", r"\bcommunity\b", r"\bheartwarming\b", r"\bdomestic fiction\b")),
    Label("epik", (r"\bepic\b", r"\bsaga\b", r"\bheroes\b", r"\bmytholog", r"\blegends\b", r"\bempire\b", r"\bwar\b")),
    Label("gizemli", (r"\bmystery\b", r"\bsecrets?\b", r"\bpuzzle\b", r"\benigma\b", r"\bdetective\b", r"\boccult\b")),
    Label("umutlu", (r"\bhope\b", r"\bredemption\b", r"\bhealing\b", r"\brecovery\b", r"\boptimis")),
    Label("maceraci", (r"\bexploration\b", r"\bvoyages\b", r"\bwilderness\b", r"\bexpedition\b", r"\btreasure\b")),
)
# Subjects that call for a content note.
CONTENT_FLAGS = {
    "suicide": "intihar", "sexual abuse": "cinsel istismar", "child abuse": "çocuk istismarı", "rape": "cinsel şiddet",
    "domestic violence": "aile içi şiddet", "violence": "şiddet", "torture": "işkence", "drug abuse": "madde bağımlılığı",
    "alcoholism": "alkolizm", "eating disorders": "yeme bozukluğu", "genocide": "soykırım", "holocaust": "Holokost",
    "war": "savaş sahneleri", "murder": "cinayet", "death": "ölüm teması", "grief": "yas", "depression, mental": "depresyon",
    "racism": "ırkçılık", "slavery": "kölelik", "terminal illness": "ölümcül hastalık",
}


GENRES_BY_RANK = tuple(sorted(GENRES, key=lambda g: g.rank))


def any_pattern(patterns: tuple[str, ...]) -> str:
    """One pattern that matches where any of the patterns does."""
    return "|".join(f"(?:{p})" for p in patterns)


def matched(text: Column | str, labels: tuple[Label, ...]) -> Column:
    """Slugs of the labels whose patterns, and no vetoes, are in text (see ascii_text); in the labels' order."""
    text = F.col(text) if isinstance(text, str) else text
    cells = []
    for x in labels:
        hit = text.rlike(any_pattern(x.patterns))
        if x.veto:
            hit &= ~text.rlike(any_pattern(x.veto))
        cells.append(F.when(hit, x.slug))
    return F.array_compact(F.array(*cells))


def genres(subject_text: Column | str, limit: int = 4) -> Column:
    """The first genres of lower-cased subjects, specific ones first."""
    return F.slice(matched(ascii_text(subject_text), GENRES_BY_RANK), 1, limit)


def direct_moods(search_text: Column | str) -> Column:
    """Moods found in lower-cased text."""
    return matched(ascii_text(search_text), MOODS)


def moods(direct: Column | str, genre_slugs: Column | str, limit: int = 4) -> Column:
    """Direct moods; with fewer than two, those that the genres suggest follow. Each once."""
    direct = F.col(direct) if isinstance(direct, str) else direct
    priors = F.array_compact(F.array(*[F.when(F.array_contains(genre_slugs, g.slug), m) for g in GENRES for m in g.moods]))
    return F.slice(F.array_distinct(F.when(F.size(direct) >= 2, direct).otherwise(F.concat(direct, priors))), 1, limit)


def audience(genre_slugs: Column | str, search_text: Column | str) -> Column:
    text = F.col(search_text) if isinstance(search_text, str) else search_text
    child = F.array_contains(genre_slugs, "cocuk") | ascii_text(text).rlike(r"\bjuvenile\b|\bchildren")
    young = F.array_contains(genre_slugs, "genc-yetiskin") | text.contains("young adult")
    return F.when(child, "cocuk").when(young, "genc").otherwise("yetiskin")


def content_flags(subjects: Column | str, limit: int = 3) -> Column:
    """Content notes for the joined subjects, in the table's order, each once."""
    text = F.lower(F.array_join(subjects, " | "))
    return F.slice(F.array_distinct(F.array_compact(F.array(*[F.when(text.contains(k), v) for k, v in CONTENT_FLAGS.items()]))), 1, limit)


def themes(rows: DataFrame, key: str, subjects: str, dictionary: DataFrame, limit: int = 6) -> DataFrame:
    """key, themes (at most limit, each once, in the subjects' order) of rows by a dictionary(position, subject, theme).

    A subject takes the theme of the entry that equals it, else of the first entry of at
    least six characters that is part of it. The dictionary is a settings table: whole
    subjects meet it in an equi-join, and its longer entries become part of the plan.
    """
    s = rows.select(key, F.posexplode(subjects).alias("at", "subject")).filter(F.col("subject").isNotNull()).withColumn("subject", F.lower(F.trim("subject")))
    d = dictionary.select("position", F.lower("subject").alias("entry"), "theme")
    equal = d.groupBy(F.col("entry").alias("subject")).agg(F.min(F.struct("position", "theme")).alias("m")).select("subject", F.col("m.theme").alias("equal"))
    parts = d.filter(F.length("entry") >= 6).orderBy("position").collect()
    part = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("subject").contains(r["entry"]), F.lit(r["theme"])) for r in parts])
    best = s.select("subject").distinct().join(equal, "subject", "left").select("subject", F.coalesce("equal", part).alias("theme")).filter(F.col("theme").isNotNull())
    got = s.join(best, "subject").groupBy(key, "theme").agg(F.min("at").alias("at"))
    lists = got.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "theme"))).alias("x"))
    return lists.select(key, F.slice(F.transform("x", lambda y: y["theme"]), 1, limit).alias("themes"))
