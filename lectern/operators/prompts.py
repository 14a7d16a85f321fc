"""Requests, prompts and answers: expansion, rendering, sample building, rating and rewriting of answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import STOPWORDS, circumflex_folded, clipped, join_and, mentions
from lectern.operators.requests import GENRE_NAMES, MOOD_NAMES, names_of


@dataclass(frozen=True)
class Entry:
    """A word or name in requests, what it stands for ('genre', 'mood' or 'theme'), and search terms for it."""

    needle: str
    kind: str
    slug: str
    terms: tuple[str, ...]


def expanded(requests: DataFrame, entries: list[Entry], most: int = 24, per_kind: int = 2) -> DataFrame:
    """requests(id, text, genres, moods) with detected themes, genres and moods, terms (ordered, each once) and content words.

    The dictionary is a settings table and becomes part of the expression. Chosen labels
    count before detected ones; null texts detect nothing.
    """
    none = F.array().cast("array<string>")
    text = circumflex_folded(F.coalesce("text", F.lit("")))
    least = {"theme": 3, "genre": 4, "mood": 4}
    x = requests.withColumn("_t", text)

    def found(kind: str, value: str) -> Column:
        cells = [F.when(mentions("_t", F.lit(e.needle)), getattr(e, value)) for e in entries if e.kind == kind and len(e.needle) >= least[kind]]
        return F.array_distinct(F.array_compact(F.array(*cells))) if cells else none

    x = x.withColumns({"detected_themes": found("theme", "slug"), "detected_genres": F.slice(found("genre", "slug"), 1, per_kind), "detected_moods": F.slice(found("mood", "slug"), 1, per_kind), "_used": F.concat(*[found(k, "needle") for k in least])})
    words = {(e.kind, e.slug): e.terms for e in entries}

    def terms(kind: str, slugs: Column) -> Column:
        pairs = {s: t for (k, s), t in words.items() if k == kind}
        if not pairs:
            return none
        table = F.create_map(*[c for s, t in pairs.items() for c in (F.lit(s), F.array(*map(F.lit, t)))])
        return F.flatten(F.array_compact(F.transform(slugs, lambda s: F.try_element_at(table, s))))

    genres, moods = F.coalesce("genres", none), F.coalesce("moods", none)
    all_terms = F.concat(terms("theme", F.col("detected_themes")), terms("genre", genres), terms("genre", F.col("detected_genres")), terms("mood", moods), terms("mood", F.col("detected_moods")))
    used = F.flatten(F.transform("_used", lambda n: F.split(n, " ")))
    content = F.filter(F.regexp_extract_all(F.col("_t"), F.lit(r"[\p{L}\p{N}_'’]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS) & ~F.array_contains(used, w))
    return x.withColumns({"terms": F.slice(F.array_distinct(all_terms), 1, most), "content_words": content}).drop("_t", "_used")


def rendered() -> Column:
    """A candidate (candidate_id and a book's columns) as it stands in a prompt; its Turkish words are fixed values."""
    none = F.array().cast("array<string>")
    when = lambda c, *parts: F.when(c, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")
    head = F.concat(
        F.lit("["), F.col("candidate_id"), F.lit("] "), F.coalesce("title", F.lit("")),
        when(F.col("title_tr").isNotNull() & (F.lower("title_tr") != F.lower("title")), " (TR: ", F.col("title_tr"), ")"),
        when(F.size(F.coalesce("authors", none)) > 0, " — ", join_and(F.slice(F.coalesce("authors", none), 1, 2))),
        when(F.col("first_published").isNotNull(), " · ", F.col("first_published").cast("string")),
    )
    facts = F.array_compact(F.array(
        F.when(F.length(names_of("genres", GENRE_NAMES)) > 0, F.concat(F.lit("tür: "), names_of("genres", GENRE_NAMES))),
        F.when(F.length(names_of("moods", MOOD_NAMES)) > 0, F.concat(F.lit("ruh: "), names_of("moods", MOOD_NAMES))),
        F.when(F.col("pages") > 0, F.concat(F.col("pages").cast("string"), F.lit(" sf."))),
        F.when((F.col("rating_avg") > 0) & (F.col("rating_count") > 0), F.format_string("puan %.1f/5 (%d oy)", F.col("rating_avg"), F.col("rating_count"))),
        F.when(F.array_contains("languages", "tur"), "Türkçe baskısı var"),
    ))
    lines = F.array_compact(F.array(
        head,
        F.when(F.size(facts) > 0, F.concat(F.lit("     "), F.array_join(facts, " | "))),
        F.when(F.size("subjects") > 0, F.concat(F.lit("     konular: "), F.array_join(F.slice("subjects", 1, 6), ", "))),
        F.when(F.length("description") > 0, F.concat(F.lit("     özet: "), clipped(F.trim(F.regexp_replace("description", r"\s+", " "))))),
    ))
    return F.array_join(lines, "\n")


def prompt_blocks(prompt: Column | str) -> Column:
    """Candidate blocks of a prompt by id."""
    parts = F.filter(F.split(prompt, r"\n(?=\[a\d+\])"), lambda p: p.rlike(r"^\[a\d+\]"))
    return F.map_from_entries(F.transform(F.array_distinct(parts), lambda p: F.struct(F.regexp_extract(p, r"^\[(a\d+)\]", 1), p)))


def sample_answer(picks: Column) -> Column:
    """The target answer of picks(id, score): ids with a confidence between 0.3 and 0.97."""
    return F.to_json(F.struct(F.transform(picks, lambda p: F.struct(p["id"].alias("id"), F.round(F.least(F.lit(0.97), F.greatest(F.lit(0.3), p["score"])), 2).alias("confidence"))).alias("picks")))


def ratings(answer: Column | str, valid_ids: Column | str) -> Column:
    """Grades 0 to 2 by valid id from a judge's answer; null if fewer than half of the ids (at least two) are graded.

    Numbers written as text count, truth values and other values don't.
    """
    raw = F.from_json(answer, "ratings map<string,string>")["ratings"]
    valid = F.col(valid_ids) if isinstance(valid_ids, str) else valid_ids
    kept = F.map_filter(raw, lambda k, v: F.array_contains(valid, k) & v.rlike(r"^\s*[+]?0*[0-2](?:\.\d+)?\s*$"))
    graded = F.transform_values(kept, lambda _, v: F.floor(v.try_cast("double")).cast("int"))
    return F.when(F.size(F.map_keys(kept)) >= F.greatest(F.lit(2), F.floor(F.size(valid) / 2)), graded)


def write_score(rated: DataFrame) -> DataFrame:
    """n, items, mean grounded and useful, share fabricated of rated(ratings map<string,struct<grounded,useful>>)."""
    items = rated.select(F.explode(F.map_values("ratings")).alias("v"))
    out = items.agg(F.count("*").alias("items"), F.round(F.avg("v.grounded"), 6).alias("grounded"), F.round(F.avg((F.col("v.grounded") == 0).cast("double")), 6).alias("fabricated"), F.round(F.avg("v.useful"), 6).alias("useful"))
    return out


def rewritten(picks: Column, texts: Column) -> Column:
    """picks(id, why) with the new text of each id, where there is one."""
    return F.transform(picks, lambda p: F.struct(p["id"].alias("id"), F.coalesce(F.try_element_at(texts, p["id"]), p["why"]).alias("why")))


def response_text(parts: Column) -> Column:
    """Text of an answer's parts(text, thought) without thoughts and code fences."""
    body = F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.regexp_replace(F.trim(body), r"^```(?:json)?\s*|\s*```$", "")


def usage(log: DataFrame, by: list[str]) -> DataFrame:
    """Requests and token sums with means per request of a usage log."""
    kinds = ("prompt_tokens", "output_tokens", "thought_tokens")
    sums = [F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in kinds]
    return log.groupBy(*by).agg(F.count("*").alias("requests"), *sums).withColumns({f"mean_{k}": F.round(F.col(k) / F.col("requests"), 6) for k in kinds})


def common_records(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that all tables have."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.join(t.select(key), key, "left_semi")
    return out


def recommendations(picks: DataFrame, candidates: DataFrame, group: str) -> DataFrame:
    """Picks(group, id, place) grounded in candidates(group, id, ...): unknown ids are dropped and counted, ranks are closed up."""
    known = picks.join(candidates, [group, "id"])
    rank = F.row_number().over(Window.partitionBy(group).orderBy("place", "id"))
    lost = picks.join(candidates.select(group, "id"), [group, "id"], "left_anti").groupBy(group).agg(F.count("*").alias("dropped"))
    return known.withColumn("rank", rank).join(lost, group, "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)))
