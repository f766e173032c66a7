"""The llm problems' operators against brute force, an exact round trip or held-out accuracy, and on their edge cases."""

import math
import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from harborline.llm import language, mixture, nearest_time, tokenize

PATH = f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}"


# -- nearest time -----------------------------------------------------------------


def nearest_by_hand(left, right, tol):
    out = {}
    for e, t, k in left:
        if None in (e, t, k):
            continue
        near = [(abs(t - u), u, i) for x, u, i in right if x == e and u is not None and i is not None and abs(t - u) <= tol]
        if near:
            best = min(near)
            out[k] = min(out.get(k, best), best)
    return sorted((k, i, g) for k, (g, _, i) in out.items())


@pytest.mark.parametrize("tol", [7, 50])
def test_nearest_time_matches_brute_force(spark, tol):
    rnd = random.Random(tol)
    left = [(rnd.choice("ab"), rnd.randrange(-300, 900), k) for k in range(120)] + [(None, 5, 900), ("a", None, 901), ("a", 5, None), ("c", 5, 902), ("a", 40, 3)]
    right = [(rnd.choice("ab"), rnd.randrange(-300, 900), rnd.randrange(500)) for _ in range(90)] + [("a", 40, 7), ("a", 40, 6), ("a", 40, 6), (None, 1, 1), ("a", None, 2), ("a", 3, None)]
    a, b = spark.createDataFrame(left, "entity string, us long, lid long"), spark.createDataFrame([(*r, "x") for r in right], "entity string, us long, id long, tick string")
    assert sorted(map(tuple, nearest_time.nearest_time(a, b, tol).collect())) == nearest_by_hand(left, right, tol)
    assert nearest_time.nearest_time(a.limit(0), b, tol).count() == 0 and nearest_time.nearest_time(a, b.limit(0), tol).count() == 0


def test_ticks_keep_few_rows(spark):
    b = spark.createDataFrame([("a", t, t) for t in range(1000)], "entity string, us long, id long")
    kept = nearest_time.expand_ticks(b, 10).groupBy("tick").count().collect()
    assert max(r["count"] for r in kept) <= 12


# -- tokens ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def automaton():
    return tokenize.Automaton(*tokenize.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_public_library(automaton, reference, text):
    got = [i for w in regex.findall(tokenize.PATTERN, text) for i in automaton.encode(w.encode())]
    assert got == reference(text)
    assert automaton.decode(got).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50_255), min_size=1, max_size=8))
def test_paths_accepted_are_exactly_the_encodings(automaton, ids):
    word = automaton.decode(ids)
    state, ok = 0, True
    for t in ids:
        ok = ok and automaton.arc(state, t)
        state = automaton.state[t]
    assert ok == (automaton.encode(word) == ids)


def test_encoding_on_spark(spark, reference):
    texts = [None, "", " ", "<|endoftext|>", "a" * 30_000, "Où est la clé ?\r\n　日本語…", "it's  12\n\n 3"]
    texts += texts
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.id: r.ids for r in tokenize.encode_texts(df, "doc_id", "text").collect()}
    assert got == {k: reference(t) if t else [] for k, t in enumerate(texts)}
    back = {r.id: r.text for r in tokenize.decode_ids(tokenize.encode_texts(df, "doc_id", "text"), "id", "ids").collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    sizes = {r.doc_id: r.tokens for r in tokenize.count_tokens(df, "text").collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert all(r.same and r.tokens == sizes[r.id] for r in tokenize.returns(df, "doc_id", "text").collect())
    assert tokenize.encode_texts(df.limit(0), "doc_id", "text").count() == 0


# -- mixture ----------------------------------------------------------------------------


def test_mixture_meets_shares_and_caps(spark):
    rnd = random.Random(4)
    docs = [(k, s, rnd.randrange(20, 800)) for s, n in (("big", 900), ("mid", 250), ("small", 60)) for k in range(n)]
    docs = [(k, s, t) for k, (_, s, t) in enumerate(docs)] + [(5000, "other", 100), (5001, None, 100), (5002, "big", 0), (5003, "mid", None)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "id long, source string, tokens long, copies string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.35, 2), ("small", 0.1, 4), ("absent", 0.05, 3), ("big", 0.1, 9)], "source string, target_share double, max_repeats int")
    got = mixture.mix(df, targets).collect()
    assert len({r.id for r in got}) == len(got) and {r.source for r in got} == {"big", "mid", "small"}
    assert all(1 <= r.copies <= {"big": 1, "mid": 2, "small": 4}[r.source] for r in got)
    tokens = {s: sum(r.tokens * r.copies for r in got if r.source == s) for s in ("big", "mid", "small")}
    for s, share in (("big", 0.5), ("mid", 0.35), ("small", 0.1)):
        assert abs(tokens[s] / sum(tokens.values()) - share / 0.95) < 0.01
    assert mixture.mix(df.limit(0), targets).count() == 0 and mixture.mix(df, targets.limit(0)).count() == 0


def test_tilts_satisfy_the_constraints_like_a_plain_newton(spark):
    rnd = np.random.default_rng(1)
    n = {"a": rnd.integers(10, 500, 300), "b": rnd.integers(10, 500, 80)}
    counts = spark.createDataFrame([(s, int(x), 1) for s in n for x in n[s]], "source string, n long, docs long")
    wish = {"a": (0.6, 1.0), "b": (0.4, 3.0)}
    tilt = mixture.solve_tilts(counts, wish, {s: (float(v.sum()), float(len(v))) for s, v in n.items()})
    total = {s: float((wish[s][1] / (1 + np.exp(-(mixture._base(wish[s][1]) + n[s] * tilt[s]))) * n[s]).sum()) for s in n}
    assert abs(total["a"] / sum(total.values()) - 0.6) < 1e-6


# -- languages --------------------------------------------------------------------------------

SENTENCES = {
    "en": ["The harbour was quiet before the storm came in", "Nobody remembers where the old keys were kept", "We should walk home together when it stops raining", "She told me that the boat would leave at seven", "There is nothing left to say about the lighthouse"],
    "de": ["Der Hafen war ruhig, bevor der Sturm kam", "Niemand weiß mehr, wo die alten Schlüssel lagen", "Wir sollten zusammen nach Hause gehen, wenn der Regen aufhört", "Sie sagte mir, dass das Boot um sieben abfährt", "Über den Leuchtturm gibt es nichts mehr zu sagen"],
    "fr": ["Le port était calme avant l'arrivée de la tempête", "Personne ne se souvient où étaient les vieilles clés", "Nous devrions rentrer ensemble quand la pluie cessera", "Elle m'a dit que le bateau partirait à sept heures", "Il n'y a plus rien à dire sur le phare"],
    "ru": ["В гавани было тихо перед бурей", "Никто не помнит, где лежали старые ключи", "Нам надо вместе идти домой, когда кончится дождь", "Она сказала мне, что лодка уходит в семь", "О маяке больше нечего сказать"],
}


def cues(parts):
    return "".join(f"{k + 1}\n00:00:{k:02d},000 --> 00:00:{k + 1:02d},000\n{p}.\n\n" for k, p in enumerate(parts))


def make_docs(n=160, seed=0):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for k in range(n):
        main = rnd.choice(list(SENTENCES))
        words = lambda lang: " ".join(rnd.choice(SENTENCES[lang]).split()[rnd.randrange(2) :])
        parts = [words(main) for _ in range(10)]
        langs = {main}
        if k % 5 == 0:
            other = rnd.choice([x for x in SENTENCES if x != main])
            parts[3:7] = [words(other) for _ in range(4)]
            langs.add(other)
        label = rnd.choice([main, main, {"en": "English", "de": "ger", "fr": "fr-CA", "ru": "RUS"}[main]])
        if k % 7 == 0:
            label = rnd.choice([None, "und", "xx", "", next(x for x in SENTENCES if x != main)])
        if len(langs) > 1 or language.label_language(label) != main:
            truth[k] = langs
        docs.append((k, label, cues(parts), "x"))
    return docs, truth


def test_languages_of_documents(spark):
    docs, truth = make_docs()
    wrong = "\n".join(x.encode().decode("cp1252", "replace") if "й" not in x and "с" not in x else x for x in cues(SENTENCES["de"][:4]).split("\n"))
    legacy = cues([s.encode("cp1251").decode("cp1252") for s in SENTENCES["ru"]])
    docs += [(900, "en", None, ""), (901, "en", "", ""), (902, None, " \n\t", ""), (903, None, cues(["[wind]", "Find more at tides.example", "♪ ♪"]), ""), (904, "xx", wrong, ""), (905, "en", legacy, ""), (906, "de", cues(SENTENCES["de"] * 3000), "")]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string, share string")
    models = language.fit(df, "doc_id", "text", "lang")
    got = language.languages(df, "doc_id", "text", "lang", models)
    listed: dict = {}
    for r in got.where("listed").collect():
        listed.setdefault(r.id, set()).add(r.lang)
    truth |= {904: {"de"}, 905: {"ru"}}
    assert listed == truth
    assert all(0 <= r.confidence <= 1 and 0.2 <= r.share <= 1 for r in got.collect())
    cut = [r for r in language.segments(df, "doc_id", "text", models).collect() if r.id == 0]
    assert [(r.first_cue, r.last_cue) for r in sorted(cut, key=lambda r: r.first_cue)] == [(0, 2), (3, 6), (7, 9)]
    assert language.languages(df.limit(0), "doc_id", "text", "lang", models).count() == 0


def plain_bits(samples, text, order):
    """Code length of a text after a line feed, by the definition of method C without exclusion."""
    counts: dict = {}
    for k in range(len(samples)):
        for n in range(order + 1):
            if k >= n:
                counts.setdefault(samples[k - n : k], {}).setdefault(samples[k], 0)
                counts[samples[k - n : k]][samples[k]] += 1
    data = b"\n" + text
    bits = 0.0
    for k in range(len(data)):
        for n in range(min(order, k), -1, -1):
            seen = counts.get(data[k - n : k])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if data[k] in seen:
                bits -= math.log2(seen[data[k]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc \né", min_size=0, max_size=40), st.text(alphabet="abcd é", min_size=0, max_size=25))
def test_tabulated_code_lengths_are_exact(sample, text):
    models = language.Models([(sample + "ab").encode(), b"\nabc abd"], 3)
    got = models.costs(np.frombuffer(b"\n" + text.encode(), np.uint8), np.array([0]))[0]
    assert got == pytest.approx([plain_bits((sample + "ab").encode(), text.encode(), 3), plain_bits(b"\nabc abd", text.encode(), 3)], rel=1e-4)


def test_best_path_matches_exhaustive_search():
    rnd = np.random.default_rng(2)
    doc = np.array([0] * 4 + [1] + [2] * 5)
    bits = rnd.uniform(0, 40, (len(doc), 3)).astype(np.float32)
    path = language.best_paths(bits, doc)
    import itertools

    for d in range(3):
        at = np.flatnonzero(doc == d)
        cost = lambda p: sum(bits[i, l] for i, l in zip(at, p)) + language.SWITCH_BITS * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731, E741
        assert cost(path[at].tolist()) == pytest.approx(min(cost(p) for p in itertools.product(range(3), repeat=len(at))), rel=1e-5)


@pytest.mark.parametrize(("label", "want"), [("EN", "en"), ("en-GB", "en"), ("pt_BR", "pt"), ("Japanese", "ja"), ("ger", "de"), ("DEU", "de"), (" fr ", "fr"), ("und", None), ("xx", None), ("", None), (None, None), ("english subtitles", None), ("n/a", None), ("spa-MX", "es")])
def test_labels(spark, label, want):
    assert language.label_language(label) == want
    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(language.label_column("l").alias("x")).first().x == want
