"""Operators on training text against brute force and hand-made cases."""

import itertools
import math
import os
import random

import numpy as np
import pytest

pytest.importorskip("lectern.llm")

from lectern.llm.words import spans, words  # noqa: E402
from lectern.llm import components, fmindex, leakage, mojibake, namemodel, names, neardup, overlap, packing, pii, terms  # noqa: E402


# 1 -------------------------------------------------------------------------------------------------
CLEAN = [f"La fenêtre de l’été {n} garde le secret d’une rivière fidèle." for n in range(60)] + [f"Bu kırık öykü {n} yıl sonra küçük köyün düşünü anlatır." for n in range(60)] + [f"Der Müller {n} hört die Brücke über dem Fluß." for n in range(60)] + ["Það er þýtt úr gömlu máli."] * 8 + ["Contents: ├── one └── two."] * 3


def books(spark, rows):
    return spark.createDataFrame([(k, t, d, "x") for k, t, d in rows], "work_key string, title string, description string, text string")


@pytest.mark.parametrize(("codec", "steps"), [("cp1252", 1), ("latin-1", 1), ("cp437", 1), ("mac_roman", 1), ("cp1251", 1), ("cp1252", 2)])
def test_mojibake_restores(spark, codec, steps):
    original = "Küçük köyün düşü kırık bir fenêtre gibi."
    chars = mojibake._tables()[1][codec]
    bad = original
    for _ in range(steps):
        bad = "".join(chars[b] for b in bad.encode())
    rows = [(f"c{i}", t, t) for i, t in enumerate(CLEAN)] + [("bad", "fine", "Der Müller hört. " + bad), ("bad", "fine", "Der Müller hört. " + bad), ("lost", "k�y", None), ("n", None, ""), (None, bad, bad)]
    got = {(r["work_key"], r["field_name"]): r for r in mojibake.damaged(books(spark, rows)).collect()}
    assert set(got) == {("bad", "description"), ("lost", "title")}
    assert got["bad", "description"]["restored"] == "Der Müller hört. " + original and got["lost", "title"]["restored"] is None


def test_mojibake_single_byte_and_empty(spark):
    bad = "Bu kýrýk öykü 7 yýl sonra küçük köyün düþünü anlatýr."
    rows = [(f"c{i}", None, t) for i, t in enumerate(CLEAN)] + [("bad", None, bad)]
    got = mojibake.damaged(books(spark, rows)).collect()
    assert [(r["work_key"], r["restored"]) for r in got] == [("bad", "Bu kırık öykü 7 yıl sonra küçük köyün düşünü anlatır.")]
    assert mojibake.damaged(books(spark, rows).limit(0)).count() == 0


def test_mojibake_that_recurs(spark):
    words_ = ["Rüya", "Makine", "Cinayet", "Deniz", "Köprü", "Gece", "Yolcu", "Bahçe", "Ayna", "Orman"]
    good = [f"Bir {w} Düşü {n}" for w in words_ for n in range(30)] + [f"The quiet harbour {n} keeps its lantern through a long and patient winter." for n in range(900)]
    bad = {f"b{i}": f"Bir {w} Düþü" for i, w in enumerate(words_)}
    rows = [(f"c{i}", t, None) for i, t in enumerate(CLEAN + good)] + [(f"i{i}", f"Þættir úr {w}", None) for i, w in enumerate(words_)] + [(k, t, None) for k, t in bad.items()]
    got = {r["work_key"]: r["restored"] for r in mojibake.damaged(books(spark, rows)).collect()}
    assert got == {k: t.replace("þ", "ş") for k, t in bad.items()}


def test_mojibake_margins_come_from_all_clean_records(spark):
    texts = [f"La fenêtre de l’été {n} garde le secret." if n % 9 else f"Það er þýtt {n} úr gömlu máli." for n in range(700)]
    rows = mojibake.field_texts(books(spark, [(f"c{i}", t, None) for i, t in enumerate(texts)] + [("a", "plain", None), ("lost", "k�y", None)]))
    scores = mojibake.scores_of(rows, mojibake.train(rows), "work_key").toPandas()
    got = mojibake.validated_margins(mojibake.scores_of(rows, mojibake.train(rows), "work_key"))
    clean = scores[scores["clean"]]
    assert got.records == len(clean) == 700 and clean["utf8_back"].notna().all() and clean["recoding_back"].notna().any()
    for margin, (kept, back), least in ((got.utf8, ("utf8_gain", "utf8_back"), mojibake.LEAST_MARGIN), (got.recoding, ("recoding_gain", "recoding_back"), mojibake.LEAST_RECODING)):
        low, high = np.quantile(clean[kept], 0.97), np.quantile(clean[back].dropna(), 0.02)
        assert margin == pytest.approx(max(least, min(low + 1.0, (low + high) / 2) if high > low else low + 1.0), abs=0.02)
    values, counts = np.array([0.0, 1.5, 4.0]), np.array([5, 2, 3])
    for q in (0.0, 0.02, 0.5, 0.65, 0.97, 1.0):
        assert mojibake._quantile(values, counts, q) == pytest.approx(np.quantile(np.repeat(values, counts), q))


def test_mojibake_of_another_script_and_both_kinds(spark):
    japanese = "日本語の本".encode().decode("latin-1")
    rows = [(f"c{i}", None, t) for i, t in enumerate(CLEAN)] + [("jp", japanese, None)]
    got = {r["work_key"]: r["restored"] for r in mojibake.damaged(books(spark, rows)).collect()}
    assert got == {"jp": "日本語の本"}


# 3 -------------------------------------------------------------------------------------------------
def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def message_rows(texts):
    return [(i, s, "x", [{"role": "system", "content": "ignored words here"}, {"role": "user", "content": t}, {"role": "assistant", "content": None}] if t is not None else None) for i, s, t in texts]


SAMPLES = "sample_id bigint, split string, text string, messages array<struct<role:string,content:string>>"


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    texts = []
    for i in range(120):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts)[2].split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(rare)
            w = w[: len(w) - rng.randint(0, 3)] or w
        else:
            w = rng.sample(common, rng.randint(1, 10)) + rng.sample(rare, rng.randint(1, 40))
        texts.append((i, rng.choice(["train", "train", "valid", "test"]), " ".join(w)))
    texts += [(200, "train", None), (201, "valid", ""), (202, "test", None), (203, None, texts[0][2]), (204, "train", "only"), (205, "valid", "only")]
    sets = {i: (s, set(words(t))) for i, s, t in texts if s and t}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if (sets[a][0] == "train") != (sets[b][0] == "train") and jaccard(sets[a][1], sets[b][1]) >= 0.8 - 1e-12}
    df = spark.createDataFrame(message_rows(texts), SAMPLES)
    rows = [tuple(r) for r in overlap.split_overlaps(df).collect()]
    assert set(rows) == want and len(rows) == len(want) and (204, 205) in want


def test_overlap_of_empty_table(spark):
    assert overlap.split_overlaps(spark.createDataFrame([], SAMPLES)).count() == 0


def test_banded_distance():
    rng = random.Random(3)
    pairs = [(sorted(rng.sample(range(40), rng.randint(0, 20))), sorted(rng.sample(range(40), rng.randint(0, 20)))) for _ in range(200)]
    k = np.array([rng.randint(0, 12) for _ in pairs])
    got = overlap.banded_distance([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs], k)
    for (a, b), kk, g in zip(pairs, k, got, strict=True):
        d = len(set(a) ^ set(b))
        assert g == d if d <= kk else g > kk


# 4 -------------------------------------------------------------------------------------------------
def test_terms_and_marks(spark):
    rows = [(f"w{i}", ["Fiction ", "fiction", f"own {i % 40}", None, "  "], ["ﬁne"] if i % 2 else None, "z") for i in range(100)] + [("w1", ["FICTION"], [], "z"), (None, ["own 1"], None, "z")]
    df = spark.createDataFrame(rows, "work_key string, subjects array<string>, genres array<string>, term string")
    got = {(r["field_name"], r["term"]): (r["occurrences"], r["works"], r["mark"]) for r in terms.marked_terms(df).collect()}
    assert got["subjects", "fiction"] == (201, 100, "common") and got["genres", "fine"] == (50, 50, "common")
    assert got["subjects", "own 39"] == (2, 2, "rare") and got["subjects", "own 1"] == (4, 3, None) and len(got) == 42
    assert terms.marked_terms(df.limit(0)).count() == 0


def test_burst_trie_counts_like_a_table():
    rng = random.Random(4)
    trie, want = terms.BurstTrie(8), {}
    for _ in range(3000):
        t = "".join(rng.choice("abç") for _ in range(rng.randint(0, 6)))
        trie.add(t, 2)
        want[t] = want.get(t, 0) + 2
    rows = list(trie.items())
    assert len(rows) == trie.size == len(want) and dict(rows) == want and [t for t, _ in rows] == sorted(want)


def test_burst_tries_merge_by_subtrees():
    rng = random.Random(5)
    want, whole = {}, terms.BurstTrie(8)
    for size in (4, 8, 40):
        part = terms.BurstTrie(size)
        for _ in range(1500):
            t = "same beginning " + "".join(rng.choice("abç") for _ in range(rng.randint(0, 6)))
            part.add(t, 1)
            want[t] = want.get(t, 0) + 1
        for path, c in part.containers():
            whole.graft(path, list(c), list(c.values()))
    assert dict(whole.items()) == want and whole.size == len(want)
    deep = terms.BurstTrie(2)
    for i in range(9):
        deep.add("x" * 3000 + str(i), 1)
    assert len(list(deep.items())) == 9


def test_terms_route_by_adaptive_prefixes(spark, monkeypatch):
    monkeypatch.setattr(terms, "ROUTE_ENTRIES", 100)
    monkeypatch.setattr(terms, "TASK_ENTRIES", 50)
    rows = [(f"w{i}", [f"the very same long prefix {i}", f"{i} other", "everywhere", "a\x00b\x01"], None) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:9], "work_key string, subjects array<string>, genres array<string>").repartition(4)
    routes = terms._routed(t := terms.task_tries(df, "work_key", ("subjects", "genres")).cache(), terms._routes(t))
    assert routes.select("route").distinct().count() > 2
    got = {r["term"]: (r["occurrences"], r["works"]) for r in terms.term_counts(df, "work_key", ("subjects", "genres")).collect()}
    assert len(got) == 802 and got["everywhere"] == (409, 400) and got["a\x00b\x01"] == (409, 400)
    assert got["the very same long prefix 3"] == (2, 1) and got["77 other"] == (1, 1)


# 5 -------------------------------------------------------------------------------------------------
def test_name_variants_link(spark):
    variants = ["Elizabeth Mudanundel", "MUDANUNDEL, Elizabeth", "Mudanundel, E.", "Liz Mudanundel", "Elizabeth Mudanudnel", "Dr. Elizabeth Mudanundel", "Mudanundel, Elizabeth, 1920-", "elizabeth  mudanundel "]
    org = ["National Institute of Tevagugelkova", "Natl Institute of Tevagugelkova", "TEVAGUGELKOVA NATIONAL INSTITUTE", "Nat. Inst. of Tevagugelkova"]
    house = ["Verlag Fubedaberlova GmbH", "Verl. Fubedaberlova", "Fubedaberlova-Verlag G.m.b.H."]
    ed = ["Éditions Susamorvam", "ED. SUSAMORVAM", "Ed Susamorvam"]
    others = ["Helen Mudanundel", "Gülşen Porafandov", "Gulsen Porafandov", "Thomas Porafandov", "Anonymous", "?", "Various", "[unknown]", None, "", "Tevagugelkova University Press"]
    rows = [(n, 5 if n == variants[0] else 1) for n in variants + org + house + ed + others]
    a = spark.createDataFrame([(n, "x") for n, c in rows for _ in range(c)], "name string, entity string")
    b = spark.createDataFrame([([variants[0], None],), (None,), ([],)], "authors array<string>")
    got = {tuple(r) for r in names.variant_pairs(a, b).collect()}
    groups = [variants, org, house, ed, ["Gülşen Porafandov", "Gulsen Porafandov"]]
    assert got == {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}
    assert names.variant_pairs(a.limit(0), b.limit(0)).count() == 0


def test_name_typing_error_that_repeats(spark):
    a = spark.createDataFrame([("Sidurepumppish, Katherine",)] * 7 + [("Katherine Sidurepumpish",)] * 2 + [("Thomas Sidurepumpish",)] * 3, "name string")
    b = spark.createDataFrame([], "authors array<string>")
    got = [tuple(r) for r in names.variant_pairs(a, b).collect()]
    assert got == [("Katherine Sidurepumpish", "Sidurepumppish, Katherine")]


def test_osa():
    assert [names.osa(a, b) for a, b in [("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "xbd"), ("abc", "xyz")]] == [0, 1, 1, 2, 3]


# 6 -------------------------------------------------------------------------------------------------
BOOKS = "work_key string, title string, authors array<string>, description string, snapshot_at timestamp, body string"


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(150):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts)[1].split()
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab[:20] if rng.random() < 0.4 else vocab) for _ in range(rng.randint(15, 90))]
        texts.append((f"k{i}", " ".join(w)))
    rows = [(k, "A title", ["Ann"], t, None, "b") for k, t in texts] + [("k0", "A title", ["Ann"], texts[0][1], None, "b"), ("x", None, None, None, None, "b"), (None, "t", [], texts[0][1], None, "b")]
    sets = {k: set(words(t)) | {"a", "title", "ann"} for k, t in texts if len(words(t)) >= 20}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.7 - 1e-12}
    got = [tuple(r) for r in neardup.similar_pairs(spark.createDataFrame(rows, BOOKS)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_near_duplicates_of_empty_table(spark):
    assert neardup.similar_pairs(spark.createDataFrame([], BOOKS)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 102), (102, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[200 + i] for i in range(30)} == {200}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 7 -------------------------------------------------------------------------------------------------
TOKENIZER = os.environ.get("LECTERN_TOKENIZER") or "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")
def test_packing_is_whole_and_fits(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["river", "mill", "gölge", "köprü", "the"]) for _ in range(rng.choice([0, 1, 5, 30, 60, 700]))), 1) for i in range(150)] + [(900, None, 1), (901, texts_word := "x" * 3000, 1), (902, texts_word, 1)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, part int")
    specs = spark.createDataFrame([(1, "s", 64), (2, "l", 1000), (3, "bad", 0), (None, "n", 5)], "spec_id int, spec_name string, capacity_tokens int")
    encode = packing.encoder(packing.load_ranks(TOKENIZER))
    size = {i: len(encode(t)) for i, t, _ in texts if t is not None}
    got = packing.containers(docs, specs).collect()
    for spec, cap in ((1, 64), (2, 1000)):
        rows = [r for r in got if r["spec_id"] == spec]
        fill = {}
        for r in rows:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        assert max(fill.values()) <= cap
        by_doc = {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        assert set(by_doc) == set(size)
        for d, parts in by_doc.items():
            assert sum(n for _, n in parts) == size[d] and (len(parts) == 1 or size[d] > cap)
            at = 0
            for s, n in sorted(parts):
                assert s == at
                at += n
    assert {r["spec_id"] for r in got} == {1, 2}
    report = {r["spec_id"]: r["used_share"] for r in packing.fill_report(packing.containers(docs, specs), specs).collect()}
    assert report[1] > 0.9
    assert packing.containers(docs.limit(0), specs).count() == 0


def test_bm25_prefers_shared_rare_words():
    terms_ = [np.array(t, np.int32) for t in ([1, 2, 9], [1, 2, 3], [1, 9], [])]
    index = packing.Index(terms_, [np.array([5.0 if x == 9 else 1.0 for x in t], np.float32) for t in terms_])
    assert index.near(0).tolist() == [2, 1] and index.near(3).tolist() == []


def test_packing_codes_terms():
    for ids, tf in (([], []), ([0], [1]), ([0, 1, 300, 70_000, 4_000_000], [1, 300, 2, 70_000, 1])):
        got = packing.decoded(packing.coded(np.array(ids, np.int32), np.array(tf, np.int64)))
        assert [x.tolist() for x in got] == [ids, tf]


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")
def test_packing_takes_neighbours_by_all_terms(spark):
    """Long texts whose rarest words are shared in pairs, but whose many other words tell which texts are alike."""
    topics = [[f"w{c}{k:03}" for k in range(150)] for c in "abcd"]
    texts = [(i, " ".join(topics[i % 4] + [f"r{(i + 1) // 2 % 8}v{k}" for k in range(24)])) for i in range(16)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    sized = packing._sized(docs, TOKENIZER, packing._vocabulary(packing._frequencies(docs)[0], 16)[0]).collect()
    assert {len(packing.decoded(bytes(r["terms"]))[0]) for r in sized} == {174}
    room = 4 * max(r["size"] for r in sized)
    specs = spark.createDataFrame([(1, "s", room)], "spec_id int, spec_name string, capacity_tokens int")
    boxes = {}
    for r in packing.containers(docs, specs).collect():
        boxes.setdefault(r["container_id"], set()).add(r["doc_id"] % 4)
    assert len(boxes) == 4 and all(len(b) == 1 for b in boxes.values())


def test_packing_closes_with_any_neighbour():
    """A neighbour beyond the 200th is one too."""
    sizes = np.array([60, *[50] * 250, 30, 30])
    near = {0: np.arange(1, 252)}
    bags = packing.pack(sizes, 100, lambda i: near.get(i, np.zeros(0, np.int64)))
    assert bags[0] == [(0, False), (251, True)]
    index = packing.Index([np.array([1])] * 302, [np.ones(1)] * 302)
    assert len(index.near(0)) == 301 == len(index.kept(0)) and index.kept(301).tolist() == list(range(301))


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")
def test_packing_puts_related_texts_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TEXTS", 250)
    rng = random.Random(8)
    topics = [[f"word{t}x{k}" for k in range(40)] for t in range(12)]
    texts = [(i, " ".join(rng.choice(topics[i % 12]) for _ in range(rng.randint(10, 60)))) for i in range(400)] + [(1000 + i, "one copy of all") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    specs = spark.createDataFrame([(1, "s", 512)], "spec_id int, spec_name string, capacity_tokens int")
    one = packing.containers(docs.repartition(2), specs)
    rows = one.collect()
    assert sorted(rows) == sorted(packing.containers(docs.repartition(7), specs).collect())
    report = packing.fill_report(one, specs).first()
    assert report["related_share"] > 0.5 and report["used_share"] > 0.9
    boxes = {}
    for r in rows:
        boxes.setdefault(r["container_id"], []).append(r["doc_id"])
    topic = lambda d: d % 12 if d < 1000 else 12
    kinds = [len({topic(d) for d in b}) / len(b) for b in boxes.values() if len(b) > 3]
    assert sum(kinds) / len(kinds) < 0.6
    check = packing.placement(one, specs).first()
    assert (check["texts"], check["misplaced"], check["split_needlessly"], check["overfull"]) == (700, 0, 0, 0)


# 8 -------------------------------------------------------------------------------------------------
def test_suffix_array_and_search():
    rng = np.random.default_rng(6)
    sym = rng.integers(0, 4, 300)
    sa = fmindex.suffix_array(np.append(sym, 0))
    assert sorted(sa.tolist()) == list(range(301))
    fm = fmindex.FMIndex.unpacked(fmindex.FMIndex.of(sym, 4, sample=7).packed())
    assert len(fm.sampled) < 150
    phrases = np.array(list(itertools.product([1, 2, 3], repeat=3)))
    rows, lo, hi = fm.search(phrases)
    found = {tuple(phrases[r]): sorted(fm.locate(np.arange(a, b)).tolist()) for r, a, b in zip(rows, lo, hi, strict=True)}
    for p in map(tuple, phrases.tolist()):
        assert found.get(p, []) == [i for i in range(298) if tuple(sym[i : i + 3]) == p]


@pytest.mark.parametrize("block", [4_000_000, 100])
def test_leaks_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", block)
    monkeypatch.setattr(leakage, "SHARD_WORDS", 500)
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40)))) for i in range(20)] + [(50, None), (51, ""), (None, "w1")]
    docs = []
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            t = rng.choice(items[:20])[1].split()
            k = rng.randint(0, len(t))
            w[len(w) // 2 : len(w) // 2] = t[k : k + rng.randint(5, 30)]
        docs.append((i, ", ".join(w).upper(), 0))
    docs += [(100, None, 0), (101, "", 0), (102, " ".join(vocab * 300) + " " + items[0][1], 0), (103, items[3][1] * 2, 0)]
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = {}
    for d, t, _ in docs:
        w = words(t)
        for k in range(len(w) - 9):
            if hit := grams.get(tuple(w[k : k + 10]), set()) - {None}:
                want.setdefault(d, set()).update(hit)
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r["doc_id"]: set(r["items"]) for r in got} == want
    text = {d: t for d, t, _ in docs}
    for r in got:
        assert all(a["end_pos"] < b["start_pos"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
        assert all(len(words(text[r["doc_id"]][s["start_pos"] : s["end_pos"]])) >= 10 for s in r["spans"])


# 9 -------------------------------------------------------------------------------------------------
MODEL = namemodel.NameModel({"benoît": 1.0, "çağlar": 1.0, "anthony": 1.0}, {("l2", "ask for"): 0.9, ("l2", "name is"): 0.9, ("r2", "at the"): 0.9})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to iris+books@mail.example if", [("email", "iris+books@mail.example")]),
        ('<a href="mailto:a.b@c.test">mail</a>', [("email", "a.b@c.test")]),
        ("my mail is fb @ posta.gid.example, or a (at) mail (dot) example or w+b at mail dot example.", [("email", "fb @ posta.gid.example"), ("email", "a (at) mail (dot) example"), ("email", "w+b at mail dot example")]),
        ("Tagged @lapek and #litas. Read 5 times @ 65 pages/day.", []),
        ("Call me on +49 (0)30 23125-379 after six. Tel: (0599) 924-1872", [("phone", "+49 (0)30 23125-379"), ("phone", "(0599) 924-1872")]),
        ("ISBN 979-2-0297-4501-9. Ref. 188/2075 rev 95. Record no. 46281862, batch 501. Order 2024-917032. Printed 04.01.1964.", []),
        ("my insurance number (QQ 83 51 52 A) was; TCKN 211 704 250 69; ssn 987093987", [("id_number", "QQ 83 51 52 A"), ("id_number", "211 704 250 69"), ("id_number", "987093987")]),
        ("I live at 1881 N. Lesun Avenue, Apt 3B, Nomes 00280.", [("address", "1881 N. Lesun Avenue, Apt 3B, Nomes 00280")]),
        ("Evim Belos Mahallesi, Befis Caddesi No 234, Lafa tarafında.", [("address", "Belos Mahallesi, Befis Caddesi No 234, Lafa")]),
        ("Bitte an Am Nomusplatz 201, 00803 Nofon senden. Envoyez-le au 30 bis, avenue Takir, 00356 Kader.", [("address", "Am Nomusplatz 201, 00803 Nofon"), ("address", "30 bis, avenue Takir, 00356 Kader")]),
        ("signed by Dr. Benoît Kotevanzur for the book club. Ask for çağlar susedostova at the desk.", [("name", "Benoît Kotevanzur"), ("name", "çağlar susedostova")]),
        ("Regards, Torabalmov, Anthony Under the roof", [("name", "Torabalmov, Anthony")]),
        ("Kotil Press, Kilor Series no. 366. Deniz onarır, Helen said.", []),
        ("", []), (None, []),
    ],
)
def test_pii(text, want):
    assert [(k, text[s:e]) for s, e, k in pii.find(text, MODEL)] == want


def test_checksums():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert [k for _, _, k in pii.find("x GB82WEST12345698765432 y", MODEL)] == ["id_number"] and pii.find("x GB82WEST12345698765431 y", MODEL) == []
    assert [k for _, _, k in pii.find("iban: GB82 WEST 1234 5698 7654 32", MODEL)] == ["id_number"]


def test_redaction_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "Tel: 020 7946 0871 – bye", "e"), (2, None, "e"), (3, "", "e"), (4, "word " * 20000 + "a@b.test", "e")], "doc_id bigint, text string, pii_kind string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert got[1] == "Tel: [PHONE] – bye" and got[2] is None and got[3] == "" and got[4].endswith("word [EMAIL]")
    assert [tuple(r)[:3] for r in pii.found(docs).orderBy("doc_id").collect()] == [(1, "phone", 5), (4, "email", 100000)]
    assert pii.found(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "kind"),
    [(t, "address") for t in ("Lale Sk. No: 5, Ankara", "Lale Cd. 5", "Lale Blv. 12", "P.K. 45, Ankara", "PK 45", "B.P. 12", "BP 123, 75011 Paris", "Boîte postale 7", "12b Elm Street, London", "12 O'Neil Street, London", "7 bis, rue Bela", "Elmweg 3")]
    + [(t, "email") for t in ("joe [ at ] x.org", "joe { at } x.org", "joe (at) x.org", "joe\nat x dot org", "joe At x dot org")]
    + [("call +1 2 3 4 5 6 7", "phone"), ("my name is Xaver Foobar at the desk", "name")],
)
def test_pii_hints_let_every_pattern_through(text, kind):
    assert [k for _, _, k in pii.find(text, MODEL)] == [kind]
    assert pii.redact(text, MODEL).count(f"[{kind.upper()}]") == 1


def test_pii_address_hints_hold_within_matches():
    texts = ["12 N. Elm Street, Flat 3, London N1 2AB", "Posta Kutusu 9", "3 ter, avenue des Lilas, 75011 Paris", "Am Seeplatz 12 b, 10115 Berlin", "Gül Mah. Lale Sokağı No: 5/2"]
    for p, hint, text in zip(pii._ADDRESS, pii._ADDRESS_HINTS, texts, strict=True):
        assert hint.search(p.search(text).group())


def test_short_family_names_and_particles_link(spark):
    a = spark.createDataFrame([("Deniz Kaya",)] * 9 + [("Kyaa, Deniz",), ("Deniz Kara",), ("Deniz Kara",), ("Deniz Kara",), ("van Dyke, Richard",), ("Richard van Dyke",)], "name string")
    got = {tuple(r) for r in names.variant_pairs(a, spark.createDataFrame([], "authors array<string>")).collect()}
    assert got == {("Deniz Kaya", "Kyaa, Deniz"), ("Richard van Dyke", "van Dyke, Richard")}


def test_names_are_learned_without_lists(spark):
    """Given names and sentence frames that stand in no list; titles stand before a few names only."""
    rng = random.Random(9)
    syllables = ["ba", "ru", "ti", "mo", "ke", "sha", "lo", "vi"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    given = sorted({word(2).capitalize() + "x" for _ in range(30)})
    frames = ["the keeper {} has the copy", "we met {} near the mill", "a note from {} was found", "later {} wrote to us"]
    texts, want = [], set()
    for i in range(900):
        other = f"Between {word(3).capitalize()} and the old mill one desert follows another. So {word(3).capitalize()} sold a small lantern. Between the two, so it goes."
        name = f"{rng.choice(given)} {word(4).capitalize()}"
        text = "It happened here: " + (("ask Dr. {} for it") if i % 6 == 0 else rng.choice(frames)).format(name) + "."
        texts.append((i, f"{other} {text}" if i % 3 else other))
        if i % 3:
            want.add((i, "name", texts[-1][1].index(name)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {(r["doc_id"], r["pii_kind"], r["start_pos"]) for r in pii.found(docs).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_everyday_names_of_the_general_list():
    for t in ("Yesterday Michael Novak came by.", "I saw Jennifer Holt there.", "Dün Ahmet Yılmaz geldi.", "Gestern war Hans Müller hier.", "Hier, Pierre Dupont est venu."):
        assert [k for _, _, k in pii.find(t, namemodel.NameModel())] == ["name"]


def test_publishers_are_no_addresses():
    assert pii.find("Published by 12 Elm Street, London", MODEL) == []


def test_short_forms_are_learned(spark):
    families = [f"Fam{a}{b}{a}{b}" for a in "bcdfgklm" for b in "aeiou"]
    rows = [(f"Xaverina {f}ton",) for f in families] + [(f"Rini {f}ton",) for f in families[:8]] + [(f"{g} {f}{g[:3]}ski",) for g in ("Ottokar", "Balduin", "Wendelin", "Irmgard", "Zenobia", "Quirin", "Leberecht", "Philomena") for f in families] + [(f"X. {f}ton",) for f in families[20:23]]
    a = spark.createDataFrame(rows, "name string")
    got = {tuple(r) for r in names.variant_pairs(a, spark.createDataFrame([], "authors array<string>")).collect()}
    assert got == {(f"Rini {f}ton", f"Xaverina {f}ton") for f in families[:8]} | {(f"X. {f}ton", f"Xaverina {f}ton") for f in families[20:23]}


def test_short_forms_are_learned_in_large_families(spark):
    """The short form is seen in families of twelve given names only; its other pairs there are chance."""
    families = [f"fam{a}{b}ton" for a in "bcdfgklm" for b in "aeiou"]
    word = lambda n: "".join("bcdfghklmn"[int(d)] + "a" for d in f"{n:03}")
    rows = [(f, "xaverina") for f in families] + [(f, "rini") for f in families[:8]] + [(f, f"{word(10 * i + k)}x") for i, f in enumerate(families[:8]) for k in range(10)]
    rows += [(f"{word(i)}ski", ("ottokar", "balduin")[i % 2]) for i in range(1000)] + [(f, "ottokar") for f in families[:8]] + [("hot", g) for g in ("rini", "ottokar", "xaverina", *(f"{word(i)}y" for i in range(300)))]
    forms = spark.createDataFrame([("P", f, g, 1) for f, g in rows], "kind string, family string, given string, n bigint")
    assert names._short_forms(forms) == {"rini": ["xaverina"]}
    assert names._short_forms(forms.limit(0)) == {}


def test_short_forms_against_brute_force(spark):
    rng = random.Random(4)
    full = [f"{w}ina" for w in ("bara", "kolu", "mite", "sado", "feru")]
    rows = set()
    for i in range(600):
        f = f"f{i}"
        rows |= {(f, g) for g in full if rng.random() < 0.06} | {(f, f"n{rng.randrange(200)}w") for _ in range(rng.choice([0, 1, 2, 15]))}
    for k, c in enumerate(full):
        have = sorted(f for f, g in rows if g == c)
        rows |= {(f, f"short{k}") for f in rng.sample(have, 12)} | {(f"f{rng.randrange(600)}", f"short{k}") for _ in range(10)}
    of, by = {}, {}
    for f, g in rows:
        of.setdefault(g, set()).add(f)
        by.setdefault(f, set()).add(g)
    sizes = [len(x) for x in by.values()]
    has = lambda f, m: 1 - math.exp(-f * m / sum(sizes))
    want = {}
    for v, c in itertools.permutations(sorted(of), 2):
        n, fv, fc = len(of[v] & of[c]), len(of[v]), len(of[c])
        if fv < fc and n >= max(names.SHORT_LEAST, names.SHORT_SHARE * fv) and n >= names.SHORT_LIFT * sum(has(fv, m) * has(fc, m) for m in sizes) and names.osa(v, c) > 1:
            want.setdefault(v, []).append(c)
    forms = spark.createDataFrame([("P", f, g, 1) for f, g in sorted(rows)], "kind string, family string, given string, n bigint")
    assert len(want) >= 5 and names._short_forms(forms) == want


def test_overlap_report_counts_by_class(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "test", "s", text), (2, "valid", "s", text + " more"), (3, "train", "s", text), (4, "train", "s", text), (5, "test", "s", "nothing alike"), (3, "train", "s", text)]
    df = spark.createDataFrame([(i, s, src, [{"role": "user", "content": t}]) for i, s, src, t in rows], "sample_id bigint, split string, source string, messages array<struct<role:string,content:string>>")
    got = {r["split"]: (r["samples"], r["overlapping"], r["pairs"]) for r in overlap.overlap_report(df).collect()}
    assert got == {"test": (2, 1, 2), "valid": (1, 1, 2)}
    assert {tuple(r) for r in overlap.split_overlaps(df).collect()} == {(1, 3), (1, 4), (2, 3), (2, 4)}


def test_words_are_runs_of_letters_and_digits():
    assert words("L’été_2020 ½ ²x İstanbul — ß") == ["l", "été", "2020", "x", "i̇stanbul", "ß"]
    assert words(None) == [] and words("…") == []
    assert [("aB c1"[a:b]) for a, b in spans("aB c1")] == ["aB", "c1"]
