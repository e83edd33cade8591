"""Batch search over names and texts.

A search takes a batch of queries ``(query_id, text[, page, size])`` and
returns hits ``(query_id, total, rank, id, score)``. All matching is done
with equi-joins on an index (tokens, token prefixes or character n-grams)
against the query batch, never by pairing every query with every row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholargraph.functions.ids import rank_within
from scholargraph.functions.joins import bounded_broadcast, measured_broadcast, sized_join
from scholargraph.functions.text import fold, strip_ws, tokens
from scholargraph.session import cut_lineage, spread

PREFIX_KEY = 3  # prefix length of the vocabulary join key
BM25_K1 = 1.2
BM25_B = 0.75
LENGTH_MARK = "\u0001"  # stands for a text's length among its words; no word is equal to it


# ------------------------------------------------------------------ index


def token_postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(tok, id, tf)``: folded word counts per document."""
    return (
        docs.select(F.col(id_col).alias("id"), F.explode(tokens(text_col)).alias("tok"))
        .groupBy("tok", "id")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def query_words(queries: DataFrame) -> DataFrame:
    """``(query_id, w)``: distinct folded words of each query.

    Operator characters separate words, so ``jean-pierre`` is two
    required words.
    """
    return queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("w")).distinct()


def top_k(hits: DataFrame, k: int | None, order: list[Column], offset: int = 0) -> DataFrame:
    """Rank hits per query and keep ranks ``offset+1 .. offset+k``.

    With a literal bound Spark plans a window group limit, so each task
    keeps only its best rows per query before the shuffle. Without a bound
    every hit is ranked with the distributed ``rank_within`` (a query
    matching a third of the rows is not sorted in one task).
    """
    if k is None:
        r = rank_within(hits, ["query_id"], order)
    else:
        w = Window.partitionBy("query_id").orderBy(*order)
        r = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= offset + k)
    if offset:
        r = r.where(F.col("rank") > offset)
    return r


def _with_total(hits: DataFrame) -> DataFrame:
    """Hits with the number of hits of their query, written once for both.

    A left join, as only its right side, one row per query, may be broadcast.
    """
    hits = cut_lineage(hits.where(F.col("query_id").isNotNull()), "search-hits")
    totals = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return hits.join(totals, "query_id", "left")


# ------------------------------------------------------------ F1 prefix

PREFIX_CAP = 12  # longest prefix materialised for the prefix equi-join


def prefix_matches(vocab: DataFrame, words: DataFrame, cap: int = PREFIX_CAP) -> DataFrame:
    """``(w, tok)`` for every vocabulary token that starts with a query word.

    An equi-join, not a scan of all pairs: each token is cut to its
    prefixes at only the word lengths present in the batch (a short list,
    at most ``cap`` values, read from the batch); a word joins the tokens
    whose prefix of its own length equals it. Words longer than ``cap``
    join on their first ``cap`` characters and ``startswith`` checks the
    rest. A common short key (for instance many zero-padded numbers
    sharing "000") therefore never multiplies the batch by the vocabulary.
    """
    lens = sorted({r[0] for r in words.select(F.least(F.length("w"), F.lit(cap))).distinct().collect()})
    if not lens:
        return words.sparkSession.createDataFrame([], "w string, tok string")
    cuts = F.array(*[F.when(F.length("tok") >= n, F.substring("tok", 1, n)) for n in lens])
    pref = vocab.select("tok", F.explode(cuts).alias("pfx")).where(F.col("pfx").isNotNull())
    wk = words.withColumn("pfx", F.substring("w", 1, cap))
    # the estimate of pref is that of its files: never broadcast on it
    j = pref.hint("merge").join(wk, "pfx")
    return j.where((F.length("w") <= cap) | F.col("tok").startswith(F.col("w"))).select("w", "tok")



def search_prefix_all(names: DataFrame, queries: DataFrame, k: int | None = 3,
                      id_col: str = "id", text_col: str = "name") -> DataFrame:
    """every query word must be a prefix of some word of the name.

    Score: sum over query words of tf x ln(N / df), tf = name words
    starting with the query word, df = names having one (order is the
    contract, not the value). Ties by id. Output ``(query_id, total,
    rank, id, score)``.

    Plan: (1) queries of the same words are searched once; (2) the prefix
    match is an equi-join (``prefix_matches``); (3) word postings ``(w, id,
    tf)`` are built once per distinct word of the batch; (4) each query is
    driven by its rarest word (smallest df) to get candidates, and the other
    words are checked by an equi-join on (w, id). A word shared by many queries
    or matching most names is therefore never multiplied by the batch. Names
    and postings are never broadcast, queries only if they are measured small.
    """
    post = token_postings(names, id_col, text_col)
    n_docs = names.select(F.count(F.lit(1))).scalar()  # lazy scalar subquery
    # words hold no blank, so a sorted list of them is one string
    asked = query_words(queries).where(F.col("query_id").isNotNull()).groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_set("w")), " ").alias("words")
    )
    asked = cut_lineage(asked, "search-words")
    side = sized_join(asked)
    qw = asked.select("words").distinct().select(
        "words", F.size(F.split("words", " ")).alias("n_words"), F.explode(F.split("words", " ")).alias("w")
    )
    word_toks = prefix_matches(post.select("tok").distinct(), qw.select("w").distinct())
    # word postings: read by df, driver choice, candidates and scoring
    mw = cut_lineage(
        post.hint("merge").join(word_toks, "tok").groupBy("w", "id").agg(F.sum("tf").alias("tf")),
        "word-postings",
    )
    dfw = mw.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    qw = cut_lineage(qw.join(side(dfw), "w"), "search-word-counts")
    driver = (
        qw.groupBy("words", "n_words")
        .agg(F.min_by("w", F.struct("df", "w")).alias("w"), F.count(F.lit(1)).alias("n_found"))
        .where(F.col("n_found") == F.col("n_words"))
        .select("words", "w")
    )
    cand = mw.select("w", "id").join(side(driver), "w").select("words", "id")
    s = (
        cand.join(side(qw), "words")
        .join(mw.hint("merge"), ["w", "id"])
        .groupBy("words", "n_words", "id")
        .agg(
            F.count(F.lit(1)).alias("n_matched"),
            F.sum(F.col("tf") * F.log(n_docs / F.col("df"))).alias("score"),
        )
        .where(F.col("n_matched") == F.col("n_words"))
        .select(F.col("words").alias("query_id"), "id", F.round("score", 9).alias("score"))
    )
    found = top_k(_with_total(s), k, [F.desc("score"), F.asc("id")]).withColumnRenamed("query_id", "words")
    return found.join(side(asked), "words").select("query_id", "id", "score", "total", "rank")


# --------------------------------------------------------- F2 substring


def char_grams(text: Column, lengths: list[int]) -> Column:
    """Distinct substrings of ``text`` of the given lengths, at every position.

    A lookahead ``(?=(.{n}))`` returns the overlapping substrings of length
    n in one regex pass (generated code, no lambda).
    """
    parts = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in lengths]
    return F.array_distinct(parts[0] if len(parts) == 1 else F.concat(*parts))


def substring_candidates(rows: DataFrame, leaves: Column, queries: DataFrame, norm) -> DataFrame:
    """``(query_id, id)`` of rows where some leaf text contains the query.

    Rows are indexed by their character n-grams of length min(3, len(query))
    for the query lengths present in the batch (at most three lengths). A
    batch measured small is broadcast to the rows, which are checked with
    ``contains`` where they are read. For a larger one the n-grams, without
    their text, meet a query's leading n-gram and candidates are joined back to
    their row; a gram held by a third of the rows is split like any skewed join
    key. Rows and n-grams are never broadcast, however small their files are.
    """
    q = queries.select("query_id", norm(strip_ws("text")).alias("q")).where(F.col("q") != "")
    q = q.withColumn("g", F.substring("q", 1, PREFIX_KEY))
    # at most PREFIX_KEY distinct lengths
    lens = sorted(r[0] for r in q.select(F.length("g")).distinct().collect())
    if not lens:
        return rows.sparkSession.createDataFrame([], "query_id bigint, id bigint")
    # cutting texts into n-grams is work for all cores, also where one file holds them
    rows = spread(rows, 1 << 20)
    texts = rows.select("id", F.transform(leaves, lambda x: norm(x)).alias("leaves")).where(F.col("id").isNotNull())
    grams = F.array_distinct(F.flatten(F.transform("leaves", lambda x: char_grams(x, lens))))
    hit = F.exists("leaves", lambda x: x.contains(F.col("q")))
    small = measured_broadcast(q)
    if small is not None:
        met = texts.select("id", "leaves", F.explode(grams).alias("g")).join(small, "g")
    else:
        idx = texts.select("id", F.explode(grams).alias("g"))
        met = idx.join(q.hint("merge"), "g").select("id", "query_id", "q")
        met = texts.hint("merge").join(met, "id")
    return met.where(hit).select("query_id", "id").distinct()


def search_substring(names: DataFrame, queries: DataFrame, k: int | None = 3,
                     id_col: str = "id", text_col: str = "name") -> DataFrame:
    """the folded query is a substring of the folded name; ordered by id.

    Wildcards ``%`` and ``_`` are literal characters. A blank query has no
    hits. Output ``(query_id, total, rank, id, score)`` with score 0.
    """
    rows = names.select(F.col(id_col).alias("id"), F.array(F.col(text_col)).alias("leaves"))
    c = substring_candidates(rows, F.col("leaves"), queries, fold).withColumn("score", F.lit(0.0))
    return top_k(_with_total(c), k, [F.asc("id")])


def search_auto(names: DataFrame, queries: DataFrame, k: int | None = 3, min_len: int = 3,
                id_col: str = "id", text_col: str = "name") -> DataFrame:
    """prefix search for queries of ``min_len`` or more characters, else substring."""
    long_q = F.length(strip_ws("text")) >= min_len
    a = search_prefix_all(names, queries.where(long_q), k, id_col, text_col)
    b = search_substring(names, queries.where(~long_q), k, id_col, text_col)
    return a.unionByName(b)


def paginate(search, names: DataFrame, queries: DataFrame) -> DataFrame:
    """page ``page`` (0-based) of ``size`` hits per query, with page count.

    ``queries(query_id, text, page, size)``; ``search(names, queries, k)``
    a batch search. Every hit is ranked (``rank_within``: no window over a
    whole query), so one query's deep page does not bound the others. Output
    adds ``n_pages = ceil(total / size)``.
    """
    hits = search(names, queries, None)
    pages = queries.select("query_id", "page", "size")
    j = hits.join(sized_join(pages)(pages), "query_id")
    first = F.col("page") * F.col("size")
    return j.where((F.col("rank") > first) & (F.col("rank") <= first + F.col("size"))).withColumn(
        "n_pages", F.ceil(F.col("total") / F.col("size")).cast("bigint")
    )


# -------------------------------------------------------- F4/F5 any field


def string_leaves(c: Column, dt: T.DataType) -> Column | None:
    """Array of every string value under ``c`` at any depth (numbers excluded).

    The schema is walked once on the driver; the result is one built-in
    expression (no UDF).
    """
    if isinstance(dt, T.StringType):
        return F.array(c)
    if isinstance(dt, T.StructType):
        parts = [p for p in (string_leaves(c[f.name], f.dataType) for f in dt.fields) if p is not None]
        if not parts:
            return None
        return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])
    if isinstance(dt, T.ArrayType):
        inner = string_leaves(F.lit(None), dt.elementType)
        if inner is None:
            return None
        if isinstance(dt.elementType, T.StringType):
            return c
        return F.flatten(F.transform(c, lambda x: F.coalesce(string_leaves(x, dt.elementType), F.array().cast("array<string>"))))
    if isinstance(dt, T.MapType):
        return string_leaves(F.map_values(c), T.ArrayType(dt.valueType))
    return None


def search_fields(rows: DataFrame, queries: DataFrame, fields: list[str] | None = None,
                  limit: int | None = 10, offset: int = 0, id_col: str = "id") -> DataFrame:
    """case-insensitive substring in any listed field, or in any string leaf.

    ``fields`` are column paths (dotted paths allowed); ``None`` searches
    every string leaf at any depth. Output ``(query_id, total, rank, id)``:
    the full total and hits ``offset+1 .. offset+limit`` by id.
    """
    schema = rows.schema
    if fields is None:
        leaves = string_leaves(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields if f.name != id_col]),
                               T.StructType([f for f in schema.fields if f.name != id_col]))
    else:
        sub = rows.select(*[F.col(p).alias(f"_f{i}") for i, p in enumerate(fields)])
        leaves = F.concat(*[F.coalesce(string_leaves(F.col(p), f.dataType), F.array().cast("array<string>"))
                            for p, f in zip(fields, sub.schema.fields)])
    r = rows.select(F.col(id_col).alias("id"), F.filter(leaves, lambda x: x.isNotNull()).alias("leaves"))
    c = substring_candidates(r, F.col("leaves"), queries, F.lower)
    return top_k(_with_total(c), limit, [F.asc("id")], offset).drop("score")


# ------------------------------------------------------------ F6 BM25


def search_ranked(docs: DataFrame, queries: DataFrame, k: int | None = 3,
                  id_col: str = "id", text_col: str = "text") -> DataFrame:
    """any query word matches a word of the text; ranked by BM25.

    BM25 (Robertson and Zaragoza 2009) with k1=1.2, b=0.75 and
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Each text is tokenised once:
    a marker row with its length and its words, of which a semi join with the
    batch's words keeps what is asked for. The marker is joined like a word,
    so one plan serves a batch of any size. N and the mean length come from
    one (reused) scalar subquery.
    """
    d = docs.select(F.col(id_col).alias("id"), tokens(text_col).alias("toks"))
    qw = query_words(queries)
    marked = F.concat(F.array(F.lit(LENGTH_MARK)), F.col("toks"))
    wanted = qw.select(F.col("w").alias("tok")).unionByName(
        queries.sparkSession.range(1).select(F.lit(LENGTH_MARK).alias("tok"))
    ).distinct()
    occ = cut_lineage(
        d.select("id", F.size("toks").alias("dl"), F.explode(marked).alias("tok")).join(wanted, "tok", "left_semi"),
        "bm25-occurrences",
    )
    per_doc = occ.where(F.col("tok") == LENGTH_MARK)
    post = occ.where(F.col("tok") != LENGTH_MARK)
    stats = per_doc.select(F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).alias("s")).scalar()
    n_docs, avgdl = stats["n"], stats["avgdl"]
    post = post.groupBy("tok", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    dfs = post.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tfn = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / avgdl))
    s = (
        post.join(dfs, "tok")
        .join(qw.withColumnRenamed("w", "tok"), "tok")
        .groupBy("query_id", "id")
        .agg(F.sum(idf * tfn).alias("score"))
        .select("query_id", "id", F.round("score", 9).alias("score"))
    )
    return top_k(_with_total(s), k, [F.desc("score"), F.asc("id")])


# -------------------------------------------------------- F7 given/family


def split_name(c: Column) -> tuple[Column, Column]:
    """First word (given name) and the rest (family name), folded."""
    parts = F.split(strip_ws(fold(c)), r"\s+", 2)
    return parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def search_given_family(names: DataFrame, queries: DataFrame, k: int | None = 3,
                        id_col: str = "id", text_col: str = "name") -> DataFrame:
    """``given rest`` must equal the name's first word and the rest;
    a one-word query goes to the ranked any-word search (F6)."""
    qg, qf = split_name(F.col("text"))
    q = queries.select("query_id", "text", qg.alias("g"), qf.alias("f"))
    two = q.where(F.col("f") != "")
    ng, nf = split_name(F.col(text_col))
    n = names.select(F.col(id_col).alias("id"), ng.alias("g"), nf.alias("f"))
    exact = n.join(bounded_broadcast(two.select("query_id", "g", "f")), ["g", "f"]).select(
        "query_id", "id", F.lit(1.0).alias("score")
    )
    exact = top_k(_with_total(exact), k, [F.asc("id")]).withColumn("method", F.lit("given_family"))
    one = q.where((F.col("f") == "") & (F.col("g") != "")).select("query_id", "text")
    ranked = search_ranked(names.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), one, k)
    return exact.unionByName(ranked.withColumn("method", F.lit("ranked")))


# ---------------------------------------------------------- F9 fallback


def with_fallback(primary_hits: DataFrame, queries: DataFrame, secondary) -> DataFrame:
    """queries with no primary hit are answered by ``secondary(queries)``.

    The primary hits are read twice (output and the missed queries), so
    they are written once.
    """
    primary_hits = cut_lineage(primary_hits, "primary-hits")
    missed = queries.join(primary_hits.select("query_id").distinct(), "query_id", "left_anti")
    return primary_hits.withColumn("source", F.lit("primary")).unionByName(
        secondary(missed).withColumn("source", F.lit("secondary"))
    )


# ------------------------------------------------------------ F13 suggest


def suggest(titles: DataFrame, requests: DataFrame, linked: DataFrame, k: int = 10,
            min_len: int = 2) -> DataFrame:
    """first ``k`` titles containing the term, minus those already linked.

    ``titles(id, title)`` of one class; ``requests(person_id, term)``;
    ``linked(person_id, id)``. Ordered by title then id. Exact without
    pairing each request with every candidate: a person's answer lies in the
    first ``k + n`` candidates of the term, n being the person's links among
    the term's candidates. Candidates are ranked per term with
    ``rank_within``; every request asks for the ranks up to its own bound, one
    row each, and meets them by (term, rank): rows made are ``k`` per request
    and one per link, whatever the number of titles.
    """
    req = requests.where(F.length(strip_ws("term")) >= min_len).select("person_id", "term").distinct()
    terms = req.select(F.col("term").alias("text")).distinct()
    terms = terms.withColumn("query_id", F.xxhash64("text"))
    rows = titles.select("id", F.array(F.col("title")).alias("leaves"))
    cand = substring_candidates(rows, F.col("leaves"), terms, F.lower)
    # the files of titles, candidates and links may be tiny beside their rows: none is broadcast
    cand = cand.join(terms, "query_id").join(titles.hint("merge"), "id").select(F.col("text").alias("term"), "id", "title")
    # links of the requesting people only, written once: read for the
    # bound, the per-person counts and the final anti join
    linked = cut_lineage(linked.select("person_id", "id").join(req.select("person_id").distinct(), "person_id", "left_semi"),
                         "suggest-linked")
    cand = cut_lineage(cand, "suggest-candidates")
    owned = req.join(linked.hint("merge"), "person_id").join(cand.select("term", "id").hint("merge"), ["term", "id"], "left_semi")
    owned = cut_lineage(owned.distinct(), "suggest-owned")
    nl = owned.groupBy("person_id", "term").agg(F.count(F.lit(1)).alias("n_linked"))
    top = rank_within(cand, ["term"], [F.col("title").asc(), F.col("id").asc()], "crank")
    bounds = req.join(nl.hint("merge"), ["person_id", "term"], "left").withColumn("bound", F.lit(k) + F.coalesce("n_linked", F.lit(0)))
    bounds = bounds.select("person_id", "term", F.explode(F.sequence(F.lit(1).cast("bigint"), "bound")).alias("crank"))
    pairs = bounds.join(top.hint("merge"), ["term", "crank"])
    pairs = pairs.join(owned.select("person_id", "term", "id").hint("merge"), ["person_id", "term", "id"], "left_anti")
    w2 = Window.partitionBy("person_id", "term").orderBy("crank")
    return pairs.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k).select(
        "person_id", "term", "rank", "id", "title"
    )
