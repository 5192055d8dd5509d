"""Secret scans (operator 2), in DataFrame and SQL functions only.

Base spans come from three patterns. Candidates are the values of base spans and, beside them, bare tokens: runs of at least 8
characters that a value may have, with a digit and a letter, outside every base span, without dots at their end. The
hash of each candidate is counted over the whole corpus by distinct repositories and owners. A value that more than
MAX_OWNERS owners hold, or that several owners hold in more than MAX_REPOS repositories, is a widely copied example; one held by fewer that looks random is live. A bare
token becomes a span of kind `owned` if its value isn't an example and is assigned somewhere, or if it is long and looks
random itself. Base spans always stay.

Counts are taken by (hash, repository, owner) first, so a value that stands in a third of all rows shrinks in each task
before it moves, and hashes that very many rows hold get their counts by a broadcast. Rows without a candidate, nearly all, take no part in
any join.

Defined cases: null text reads as empty and has no spans; texts of any length are read whole; null repositories or owners count as one more;
rows that repeat an id and a text get the same spans and count once; empty tables give empty results; columns named like
an added one are replaced, others may have any name and type. Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, named, plain_text, replacing, table
from .grouping import BROADCAST_ROWS, join_unique

#: kind -> (pattern, group that holds the value, least length of the value), in the order that spans are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {"assign": (ASSIGN, 2, 8), "access": (r"AKIA[A-Z0-9]{12,}", 0, 16), "hex": (r"[0-9a-f]{32,}", 0, 32)}
#: A whole run of characters of a value that has a digit.
TOKEN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z+/_.=-]*+[0-9][A-Za-z0-9+/_.=-]*+"
SHORTEST = 8
OWNED = "owned"
MAX_OWNERS, MAX_REPOS = 2, 10
#: What a token that looks random has: characters, and of them letters, digits, different ones, characters between dots.
RANDOM = {"length": 20, "letters": 3, "digits": 3, "different": 10, "part": 20}
#: Matches whose places are added up at a time.
BLOCK = 256
ADDED = ("n_assign", "n_access", "n_hex", "base_spans", "spans", "n_live", "n_example")
SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
SPOT = "array<struct<s:int,k:int,e:int>>"


def _matches(text: Column, pattern: str, group: int, rank: int) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, k, e, v>>: the text between matches gives their places, added up
    in blocks, as an array that grows match by match is copied each time."""
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else hits
    gaps = F.split(text, pattern, -1)
    # The last gap has no match behind it.
    found = F.arrays_zip(hits.alias("h"), values.alias("v"), F.slice(gaps, F.lit(1), F.size(hits)).alias("g"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["g"])
        end = start + F.length(x["h"])
        span = F.struct(start.alias("s"), F.lit(rank).alias("k"), end.alias("e"), x["v"].alias("v"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    def moved(block: Column, by: Column) -> Column:
        return F.transform(block["out"], lambda x: F.struct((x["s"] + by).alias("s"), x["k"].alias("k"), (x["e"] + by).alias("e"), x["v"].alias("v")))

    def place(done: Column, block: Column) -> Column:
        """Blocks one behind the other."""
        return F.struct((done["at"] + block["at"]).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda i: F.aggregate(F.slice(found, i * BLOCK + 1, F.lit(BLOCK)), begin, step))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    whole = F.flatten(F.zip_with(blocks, F.aggregate(blocks, none, place, lambda done: done["out"]), moved))
    return F.when(text.rlike(pattern), whole).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""

    def kept(rank: int, pattern: str, group: int, least: int) -> Column:
        return F.filter(_matches(text, pattern, group, rank), lambda x: F.length(x["v"]) >= least)

    return F.array_sort(F.concat(*[kept(rank, *kind) for rank, kind in enumerate(KINDS.values())]))


def _value(v: Column) -> Column:
    """A value as it is counted: a sentence's end isn't part of it."""
    return F.rtrim(v, F.lit("."))


def bare_tokens(text: Column) -> Column:
    """Tokens with a digit and a letter."""

    def trimmed(x: Column) -> Column:
        v = _value(x["v"])
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), (x["s"] + F.length(v)).alias("e"), v.alias("v"))

    return F.filter(F.transform(_matches(text, TOKEN, 0, len(KINDS)), trimmed), lambda x: (F.length(x["v"]) >= SHORTEST) & x["v"].rlike("[A-Za-z]"))


def different(v: Column) -> Column:
    return F.size(F.array_distinct(F.split(v, "")))


def looks_random(v: Column) -> Column:
    letters, digits = F.length(F.regexp_replace(v, "[^A-Za-z]", "")), F.length(F.regexp_replace(v, "[^0-9]", ""))
    long = (F.length(v) >= RANDOM["length"]) & v.rlike(f"[^.]{{{RANDOM['part']}}}")
    return long & (letters >= RANDOM["letters"]) & (digits >= RANDOM["digits"]) & (different(v) >= RANDOM["different"])


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, OWNED)])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _row_key(id_col: str, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(named(id_col).cast("string"), F.lit("null")), text))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __base, __bare and __key (null where a row has neither)."""
    text = plain_text(text_col)
    docs = docs.withColumn("__base", base_spans(text)).withColumn("__bare", bare_tokens(text))
    docs = docs.withColumn("__bare", F.filter("__bare", lambda t: ~F.exists("__base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"]))))
    return docs.withColumn("__key", F.when((F.size("__base") > 0) | (F.size("__bare") > 0), _row_key(id_col, text)))


def judge(found: DataFrame, repo_col: str, owner_col: str, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Rows of _found with a key -> (key, more: owned spans, live: base or owned spans that are live, copied: examples). Keys
    without any of them have no row."""
    rows = found.where(F.col("__key").isNotNull())
    seen = cut(
        rows.select(
            F.col("__key").alias("key"), named(repo_col).cast("string").alias("repo"), named(owner_col).cast("string").alias("owner"),
            F.explode(F.concat("__base", "__bare")).alias("x"),
        ).select("key", "repo", "owner", F.struct("x.s", "x.k", "x.e").alias("x"), F.sha2(_value(F.col("x.v")), 256).alias("hash"), (different(F.col("x.v")) >= RANDOM["different"]).alias("various"), looks_random(F.col("x.v")).alias("random"))
    )
    # By (hash, repository, owner) first: a common value becomes a row for each of them in every task.
    each = seen.groupBy("hash", "repo", "owner").agg(F.max((F.col("x.k") == 0).cast("int")).alias("assigned"))
    counts = cut(
        each.groupBy(F.col("hash").alias("h2")).agg(
            F.count_distinct(F.coalesce("repo", F.lit("\x00"))).alias("n_repos"),
            F.count_distinct(F.coalesce("owner", F.lit("\x00"))).alias("n_owners"),
            F.max("assigned").alias("assigned"),
        )
    )
    x = F.col("x")
    copied = (F.col("n_owners") > max_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") > max_repos))
    bare = x["k"] == len(KINDS)
    live = ~copied & F.when(bare, F.col("random")).otherwise(F.col("various"))
    owned = bare & (live | (~copied & (F.col("assigned") == 1)))
    told = F.array_compact(F.array(F.when(owned, "more"), F.when(live, "live"), F.when(copied & (~bare | F.col("random") | (F.col("assigned") == 1)), "copied")))
    spots = join_unique(seen.select("key", "x", "hash", "various", "random").distinct(), "hash", counts, "h2", counts.count()).select("key", "x", F.explode(told).alias("kind"))
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, x))).alias(kind)
    return spots.groupBy("key").agg(of("more"), of("live"), of("copied"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS
) -> DataFrame:
    """docs, without the text, with n_assign, n_access, n_hex, base_spans, spans (arrays), n_live and n_example."""
    docs = replacing(docs, *ADDED)
    names = [named(c) for c in docs.columns if c != text_col]
    found = cut(_found(docs, id_col, text_col).select(*names, "__base", "__bare", "__key"))
    verdicts = cut(judge(found, repo_col, owner_col, max_owners, max_repos)).withColumnRenamed("key", "__k")
    none = F.array().cast(SPOT)
    added = ["more", "live", "copied"]
    busy = join_unique(found.where(F.col("__key").isNotNull()), "__key", verdicts, "__k", verdicts.count()).withColumns({c: F.coalesce(c, none) for c in added})
    plain = found.where(F.col("__key").isNull()).withColumns({"__k": F.lit(None).cast("string")} | dict.fromkeys(added, none))
    both = plain.unionByName(busy)
    base = F.transform("__base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    count = lambda k: F.size(F.filter("__base", lambda x: x["k"] == k)).cast("long")
    return both.select(
        *names,
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        base.alias("base_spans"),
        F.array_sort(F.concat(base, "more")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        F.size("copied").cast("long").alias("n_example"),
    )


#: What any text with a candidate has, told quickly.
ANY = "|".join([ASSIGN, "AKIA[A-Z0-9]{12}", "[a-f]{32}", "[0-9]"])


def redact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", length_col: str | None = "n_chars"
) -> DataFrame:
    """docs with every span of scan() replaced: <example-secret> for widely copied values, <secret> for all others.

    Overlapping spans are replaced as one. No row goes. length_col, if there, gets the new length of a text that changed.
    The patterns run over the texts once; the spans of the few rows that change come back by a broadcast, or where those are
    many, to the rows that may have any.
    """
    names = docs.columns
    needed = list(dict.fromkeys([repo_col, owner_col]))
    narrow = docs.select(*[named(c).alias(f"__in{i}") for i, c in enumerate(needed)], named(id_col).alias("__id"), named(text_col).alias("__text"))
    found = _found(narrow, "__id", "__text").where(F.col("__key").isNotNull()).drop("__text", "__id")
    found = cut(found)
    repo, owner = (f"__in{needed.index(c)}" for c in (repo_col, owner_col))
    verdicts = judge(found, repo, owner)
    spot = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    bases = found.groupBy("__key").agg(F.first(F.transform("__base", spot)).alias("base"))  # rows of one key have the same
    none = F.array().cast(SPOT)
    spans = F.array_sort(F.concat("base", F.coalesce("more", none)))
    marked = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.array_contains(F.coalesce("copied", none), x).alias("copied")))
    changes = bases.join(verdicts, F.col("__key") == F.col("key"), "left").select(F.col("__key").alias("__k"), marked.alias("__spans"))
    changes = cut(changes.where(F.size("__spans") > 0))
    size = changes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("__spans")).alias("spans")).first()
    few = (size["spans"] or 0) + size["n"] <= BROADCAST_ROWS
    text = plain_text(text_col)
    rows = docs.withColumn("__key", _row_key(id_col, text))
    if few:
        rows = rows.join(F.broadcast(changes), F.col("__key") == F.col("__k"), "left")
    else:
        rows = rows.withColumn("__key", F.when(text.rlike(ANY), F.col("__key")))
        busy = join_unique(rows.where(F.col("__key").isNotNull()), "__key", changes, "__k", size["n"])
        rows = busy.unionByName(rows.where(F.col("__key").isNull()), allowMissingColumns=True)
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("open"), F.lit(True).alias("copied"), F.array().cast("array<string>").alias("out"))
    name = lambda copied: F.when(copied, "<example-secret>").otherwise("<secret>")

    def step(done: Column, x: Column) -> Column:
        """A span that begins inside the last one lengthens it; else the last one is written and this one opens."""
        inside = done["open"] & (x["s"] < done["at"])
        between = F.substring(text, done["at"] + 1, x["s"] - done["at"])
        closed = F.concat(done["out"], F.when(done["open"], F.array(name(done["copied"]))).otherwise(F.array().cast("array<string>")), F.array(between))
        return F.struct(
            F.when(inside, F.greatest(done["at"], x["e"])).otherwise(x["e"]).alias("at"),
            F.lit(True).alias("open"),
            F.when(inside, done["copied"] & x["copied"]).otherwise(x["copied"]).alias("copied"),
            F.when(inside, done["out"]).otherwise(closed).alias("out"),
        )

    def end(done: Column) -> Column:
        closed = F.concat(done["out"], F.array(name(done["copied"]), F.substring(text, done["at"] + 1, F.length(text) - done["at"])))
        return F.array_join(closed, "")

    changed = F.col("__spans").isNotNull()
    out = rows.withColumn("__new", F.when(changed, F.aggregate("__spans", begin, step, end)).otherwise(named(text_col)))
    length = named(length_col) if length_col in names else None
    picked = []
    for c in names:
        if c == text_col:
            picked.append(F.col("__new").alias(c))
        elif c == length_col:
            picked.append(F.when(changed, F.length("__new")).otherwise(length).cast(docs.schema[c].dataType).alias(c))
        else:
            picked.append(named(c))
    return out.select(*picked)


# ---------------------------------------------------------------- query
def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """A document is a repository, its source the owner."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_live", "n_example"
    )


def _sql_matches(pattern: str, group: int, rank: int) -> str:
    p = pattern.replace("'", "''")
    return f"""list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{
        's': list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i-1], lambda x: length(x))), 0),
        'k': {rank}, 'n': length(regexp_extract_all(t, '{p}')[i]), 'v': regexp_extract_all(t, '{p}', {group})[i]}})"""


#: The same runs without a look behind: the leftmost match begins where a run does.
_TOKEN_SQL = "[A-Za-z+/_.=-]*[0-9][A-Za-z0-9+/_.=-]*"
_ALL = "||".join(f"list_filter({_sql_matches(p, g, k)}, lambda x: length(x.v) >= {n})" for k, (p, g, n) in enumerate(KINDS.values()))
_RANDOM = f"""length(x.v) >= {RANDOM["length"]} AND regexp_matches(x.v, '[^.]{{{RANDOM["part"]}}}') AND length(regexp_replace(x.v, '[^A-Za-z]', '', 'g')) >= {RANDOM["letters"]}
  AND length(regexp_replace(x.v, '[^0-9]', '', 'g')) >= {RANDOM["digits"]} AND len(list_distinct(string_split(x.v, ''))) >= {RANDOM["different"]}"""
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS (SELECT rid, doc_id, source, t, {_ALL} AS base, {_sql_matches(_TOKEN_SQL, 0, len(KINDS))} AS bare FROM d),
b AS (SELECT rid, doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), '|', t)) AS key,
             list_transform(base, lambda x: {{'s': x.s, 'k': x.k, 'e': x.s + x.n, 'v': x.v}}) AS base,
             list_filter(list_transform(bare, lambda x: {{'s': x.s, 'k': x.k, 'e': x.s + length(rtrim(x.v, '.')), 'v': rtrim(x.v, '.')}}), lambda y: length(y.v) >= {SHORTEST}
               AND regexp_matches(y.v, '[A-Za-z]') AND len(list_filter(base, lambda z: z.s < y.e AND y.s < z.s + z.n)) = 0) AS bare
      FROM f),
c AS (SELECT DISTINCT key, doc_id, source, x FROM (SELECT key, doc_id, source, unnest(base || bare) AS x FROM b)),
n AS (SELECT rtrim(x.v, '.') AS v, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), chr(1))) AS repos, max(CASE WHEN x.k = 0 THEN 1 ELSE 0 END) AS assigned FROM c GROUP BY 1),
j AS (SELECT key, x, assigned = 1 AS assigned, owners > {MAX_OWNERS} OR (owners > 1 AND repos > {MAX_REPOS}) AS copied, x.k = {len(KINDS)} AS is_bare,
             len(list_distinct(string_split(x.v, ''))) >= {RANDOM["different"]} AS various, {_RANDOM} AS random
      FROM (SELECT DISTINCT key, x FROM c) JOIN n ON rtrim(x.v, '.') = n.v),
m AS (SELECT key, x, NOT copied AND CASE WHEN is_bare THEN random ELSE various END AS live, is_bare AND NOT copied AND (random OR assigned) AS owned,
             copied AND (NOT is_bare OR random OR assigned) AS example FROM j),
w AS (SELECT key, count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example FROM (SELECT DISTINCT key, x.s, x.k, x.e, live, example FROM m) GROUP BY key),
a AS (SELECT rid, x FROM (SELECT rid, unnest(base) AS x FROM b) UNION ALL SELECT b.rid, m.x FROM b JOIN m ON b.key = m.key AND m.owned),
s AS (SELECT rid, string_agg(['assign', 'access', 'hex', '{OWNED}'][x.k + 1] || ':' || x.s || ':' || x.e, ',' ORDER BY x.s, x.k) AS spans,
             string_agg(['assign', 'access', 'hex'][x.k + 1] || ':' || x.s || ':' || x.e, ',' ORDER BY x.s, x.k) FILTER (x.k < {len(KINDS)}) AS base_list FROM a GROUP BY rid)
SELECT b.doc_id, CAST(len(list_filter(base, lambda x: x.k = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(base, lambda x: x.k = 1)) AS BIGINT) AS n_access,
       CAST(len(list_filter(base, lambda x: x.k = 2)) AS BIGINT) AS n_hex, sha256(coalesce(base_list, '')) AS base_sha256, coalesce(s.spans, '') AS spans,
       coalesce(w.n_live, 0) AS n_live, coalesce(w.n_example, 0) AS n_example
FROM b LEFT JOIN s USING (rid) LEFT JOIN w ON b.key = w.key"""
