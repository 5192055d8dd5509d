"""The pipeline's stages on planted documents, and the queries' SQL."""

import duckdb
import pytest

import corpus_pipeline as P
from tests.test_queries import SF_DIR, TABLES, same_as_duckdb
from tidemark.llm.queries import ORACLE_SQL, QUERIES
from tidemark.llm.sentencepieces import default_model, vocabulary

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def english(i, n=60):
    return " ".join(f"the{(i * 31 + j) % 977} and of{(i + j * j) % 499}" for j in range(n)).translate(str.maketrans("0123456789", "abcdefghij"))


def planted():
    rows = [(i, english(i), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, english(5), "en", "s0"), (101, english(5).replace(english(5).split()[40], "changed", 1), "en", "s1"), (102, "12345 !!!", "en", "s1"), (103, None, None, None), (104, english(99) + ' token = "0123456789abcdef0123456789abcdef0123"', "en", "s2")]
    return [(d, t, l, s, len(t) if t else None) for d, t, l, s in rows]


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(planted(), KIND)
    out = {}
    for name, stage in P.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r.doc_id for r in out[name].collect()}
    clean = set(range(60)) | {104}
    assert ids("language_id") == clean | {100, 101}
    assert ids("simhash_near_dedup") == clean
    assert ids("secret_scan") == clean
    hidden = out["secret_scan"].where("doc_id = 104").first()
    assert "<secret>" in hidden.text and "0123456789abcdef" not in hidden.text and hidden.n_chars == len(hidden.text)
    assert ids("mixing") <= clean and out["mixing"].count() >= 40
    words, texts = vocabulary(default_model()), {r.doc_id: r.text for r in out["mixing"].collect()}
    for r in out["sentencepiece"].collect():
        assert r.ids == words.library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def similar(a, b):
    both = len(a & b)
    return both >= 0.8 * (len(a) + len(b) - both)


def slow_near_duplicates(rows):
    """Rows that stay, by comparing every two sets of shingles."""
    from tidemark.llm.simhash import shingle_set

    sets = [shingle_set(r["text"], 5) for r in rows]
    known = {unit: set(hashes.tolist()) for unit, hashes in sets}
    label = {u: u for u in known}
    for a in known:
        for b in known:
            if a < b and similar(known[a], known[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {u: low if x == high else x for u, x in label.items()}
    best = {}
    for r, (unit, _) in zip(rows, sets, strict=True):
        key = (r["doc_id"] is None, r["doc_id"] or 0, unit, r["text"] is not None, r["text"] or "")
        group = label[unit]
        if group not in best or key < best[group][0]:
            best[group] = (key, r)
    return [r for _, r in best.values()]


def slow_secrets(rows):
    """Texts with their spans written over, the corpus read twice."""
    from tests.llm.test_secrets import slow_base

    import re

    spans, holders = [], {}
    for r in rows:
        text, mine = r["text"] or "", []
        base = [tuple(x.split(":")) for x in slow_base(text).split(",") if x]
        taken = [(int(s), int(e)) for _, s, e in base]
        for kind, s, e in base:
            value = re.search(r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", text[int(s) : int(e)])[1] if kind == "assign" else text[int(s) : int(e)]
            mine.append((int(s), int(e), kind, value.rstrip(".")))
        for m in re.finditer(r"[A-Za-z+/_.=-]*[0-9][A-Za-z0-9+/_.=-]*", text):
            v = m[0].rstrip(".")
            if len(v) >= 8 and re.search("[A-Za-z]", v) and not any(s < m.start() + len(v) and m.start() < e for s, e in taken):
                mine.append((m.start(), m.start() + len(v), "bare", v))
        spans.append(mine)
        for _, _, kind, v in mine:
            held = holders.setdefault(v, [set(), set(), False])
            held[0].add(r["source"])
            held[1].add(r["doc_id"])
            held[2] |= kind == "assign"
    out = []
    for r, mine in zip(rows, spans, strict=True):
        marks = []
        for s, e, kind, v in mine:
            owners, repos, assigned = holders[v]
            copied = len(owners) > 2 or (len(owners) > 1 and len(repos) > 10)
            random = len(v) >= 20 and re.search("[^.]{20}", v) and sum(c.isalpha() for c in v) >= 3 and sum(c.isdigit() for c in v) >= 3 and len(set(v)) >= 10
            if kind != "bare" or (not copied and (random or assigned)):
                marks.append([s, e, copied])
        text, at, new = r["text"] or "", 0, []
        merged = []
        for s, e, copied in sorted(marks):
            if merged and s < merged[-1][1]:
                merged[-1] = [merged[-1][0], max(merged[-1][1], e), merged[-1][2] and copied]
            else:
                merged.append([s, e, copied])
        for s, e, copied in merged:
            new += [text[at:s], "<example-secret>" if copied else "<secret>"]
            at = e
        out.append({**r, "text": "".join([*new, text[at:]]), "n_chars": len("".join([*new, text[at:]]))} if merged else r)
    return out


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before gave, beside a slow version of it over the same rows."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    key = lambda r: repr(sorted(r.items(), key=lambda x: x[0]))
    rows = lambda frame: sorted((r.asDict() for r in frame.collect()), key=key)
    slow = {
        "language_id": lambda given: [r for r in given if any(c.isalpha() for c in r["text"] or "")],
        "simhash_near_dedup": slow_near_duplicates,
        "secret_scan": slow_secrets,
    }
    for name, stage in P.STAGES:
        before = rows(docs)
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name in slow:
            assert rows(docs) == sorted(slow[name](before), key=key), name
        elif name == "mixing":
            from tidemark.llm.mixing import OP9_SQL

            con = duckdb.connect()
            con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
            con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in before])
            copies = {i: taken // size for i, size, _, _, taken in con.execute(OP9_SQL).fetchall() if size}
            assert rows(docs) == sorted((r for r in before for _ in range(copies.get(r["doc_id"], 0))), key=key)
        else:
            library = vocabulary(default_model()).library
            want = [{"doc_id": r["doc_id"], "lang": r["lang"], "source": r["source"], "n_tokens": len(ids := library.encode(r["text"] or "")), "ids": ids} for r in before]
            assert rows(docs) == sorted(want, key=key)


def test_odd_rows_and_columns(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, a map and names that clash."""
    long = "the word and another one of many words here " * 30_000
    rows = [
        (1, "some words of a text here", "en", "s", 1, {"a": 1}, "x"), (1, "some words of a text here", "en", "s", 1, {"a": 1}, "x"), (1, "quite other words of a second text", None, None, None, None, None),
        (None, "a text without an id, in words", None, None, None, None, "y"), (None, None, None, None, None, None, None), (5, "", "en", "s", 0, {}, "z"), (6, long, "en", "t", 3, None, "w"), (7, "token = 'abcdefgh12345678' tail words", "en", "t", 4, None, "v"),
    ]
    docs = spark.createDataFrame(rows, KIND + ", spans map<string,int>, `the.name` string")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema) if name != "mixing" else docs
        if name == "simhash_near_dedup":
            assert sorted((r.doc_id or 0, (r.text or "")[:10]) for r in docs.collect()) == [(0, "a text wit"), (1, "quite othe"), (1, "some words"), (6, "the word a"), (7, "token = 'a")]
    assert "<secret>" in docs.where("doc_id = 7").first().text


def test_empty_documents(spark):
    for _, stage in P.STAGES:
        assert stage(spark, spark.createDataFrame([], KIND), SF_DIR).count() == 0


def test_extra_columns_stay(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in planted()[:8]], KIND + ", fp string, copies int")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns


def test_run(spark):
    assert P.run(spark, SF_DIR).count() > 100 and P.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    same_as_duckdb(con, QUERIES[name](spark, SF_DIR), ORACLE_SQL[name])
