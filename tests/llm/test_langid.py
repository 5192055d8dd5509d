"""Rank-order profiles."""

from collections import Counter

from tidemark.llm import langid as L
from tidemark.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def slow_ranked(text, size):
    """N-grams of words padded by a blank, counted one by one."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = Counter()
    padded = " " + " ".join(words) + " " if words else ""
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and not (n == 1 and g == " ") and not (n == 3 and g[1] == " "):
                counts[g] += 1
    pack = lambda g: sum(ord(c) << L.STEP * (len(g) - 1 - i) for i, c in enumerate(g))
    return [pack(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], pack(x[0])))[:size]]


TEXTS = ["", "a", "Ab ab  AB!", "été d'été 12", "straße İx", "日本 語", "x" * 500, " ... ", "a-b c\nd"]


def test_grams_against_counting():
    for size in (3, 300):
        grams = L.Grams(TEXTS)
        assert [L.ranked(grams.of(k), grams, size).tolist() for k in range(len(TEXTS))] == [slow_ranked(t, size) for t in TEXTS]


def test_windows_count_the_same(monkeypatch):
    text = "Ab ab  AB! été d'été 12 straße İx 日本 語 " * 7 + "xyz" * 40 + " ΑΣ ... q"
    monkeypatch.setattr(L, "WINDOW", 10**6)
    whole = L.Grams([text])
    want = L.ranked(whole.of(0), whole, 10**6).tolist()
    for window in (1, 2, 3, 7, 50, 10**6):
        monkeypatch.setattr(L, "WINDOW", window)
        assert L.top(*L.counted_in_windows(text), 10**6).tolist() == want, window
    assert L.counted_in_windows("")[0].tolist() == L.counted_in_windows(" .. ")[0].tolist() == []


def slow_nearest(rows, listed, size):
    """Distance to each profile, place by place."""
    profiles = {}
    for name, gram, rank in rows:
        profiles.setdefault(name, {})[gram] = rank
    found = [(sum(abs(p[g] - i) if g in p else size for i, g in enumerate(listed)), name) for name, p in profiles.items()]
    return min(found)[1], 1 - min(found)[0] / (size * len(listed))


def test_nearest_against_place_by_place():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(f"l{k:02}", int(g), r) for k in range(30) for r, g in enumerate(rng.permutation(500)[:60])]
    p = L.Profiles(rows, size=60)
    for _ in range(40):
        listed = rng.permutation(700)[: rng.integers(1, 80)]
        name, score = p.nearest(listed)
        want = slow_nearest(rows, listed.tolist(), 60)
        assert name == want[0] and abs(score - want[1]) < 1e-12


def test_many_languages_are_refused_not_dropped(spark, monkeypatch):
    docs = spark.createDataFrame([(f"ab{i}", f"l{i}") for i in range(5)], "text string, lang string")
    assert len(L.learn(docs).languages) == 5
    monkeypatch.setattr(L, "MAX_LANGUAGES", 4)
    import pytest

    with pytest.raises(ValueError, match="5 languages"):
        L.learn(docs)


def test_out_of_place():
    p = L.Profiles([("aa", 10, 0), ("aa", 20, 1), ("bb", 20, 0), ("bb", 30, 1)], size=4)
    import numpy as np

    assert p.nearest(np.array([10, 20])) == ("aa", 1.0)
    assert p.nearest(np.array([20, 99])) == ("bb", 1 - (0 + 4) / 8)
    assert p.nearest(np.array([99])) == ("aa", 0.0)  # a tie: the smaller name
    assert p.nearest(np.array([], dtype=np.int64)) == ("und", 0.0) and L.Profiles([]).nearest(np.array([10])) == ("und", 0.0)


def test_accuracy_on_held_out_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    out = L.op10_language_id(spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and len(held) > 20
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_profiles_against_counting(spark):
    docs = spark.createDataFrame([(1, "abc abc", "x"), (2, "Abd", "x"), (3, None, "x"), (4, "zz", None), (5, "q", "y")], "doc_id long, text string, lang string")
    p = L.learn(docs, size=5)
    assert p.languages == ["x", "y"]
    want = slow_ranked("abc abc abd", 5)
    x = {int(g): int(r) for i, g in enumerate(p.grams) for l, r in zip(p.language[p.begin[i] : p.begin[i + 1]], p.rank[p.begin[i] : p.begin[i + 1]], strict=True) if l == 0}
    assert sorted(x, key=x.get) == want


def test_odd_rows(spark):
    rows = [(1, None, "en", 1.0), (2, "", "en", None), (3, "123 !!", None, 2.0), (None, "some words here", "en", 3.0), (5, "some words here", "en", 3.0), (5, "some words here", "en", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = L.identify(docs, L.learn(docs)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.lang_pred) for r in out] == [(None, "en"), (1, "und"), (2, "und"), (3, "und"), (5, "en"), (5, "en")]
    assert out[1].score == 0 and out[0].score > 0.9
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    none = docs.limit(0)
    assert L.identify(none, L.learn(none)).count() == 0
    assert {r.lang_pred for r in L.identify(docs, L.learn(none)).collect()} == {"und"}
    assert docs.select(L.held_out().alias("h")).where("h is null").count() == 0


def test_a_long_text_is_read_whole(spark):
    docs = spark.createDataFrame([(1, "aaa " * 400_000 + "zzz " * 900_000)], "doc_id long, text string")
    p = L.learn(spark.createDataFrame([("aaa " * 9, "a"), ("zzz " * 9, "z")], "text string, lang string"))
    assert L.identify(docs, p).first().lang_pred == "z"


def test_learning_ignores_held_out_rows(spark):
    ids = [r.id for r in spark.range(40).where(L.held_out("id")).collect()]
    docs = spark.createDataFrame([(i, "hidden words", "secret") if i in ids else (i, "open words", "known") for i in range(40)], "doc_id long, text string, lang string")
    assert L.learn(docs.where(~L.held_out())).languages == ["known"]
    assert ids
