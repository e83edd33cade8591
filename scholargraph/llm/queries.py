"""Named queries of the operators, and their SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholargraph.llm.bpe import encode_documents
from scholargraph.llm.common import documents, merged_spans
from scholargraph.llm.exact_dedup import exact_dedup
from scholargraph.llm.lexical import ranked_search
from scholargraph.llm.line_dedup import repeated_lines
from scholargraph.llm.minhash import near_duplicates
from scholargraph.llm.neighbours import nearest
from scholargraph.llm.packing import pack_documents
from scholargraph.llm.passages import repeated_passages
from scholargraph.llm.quality import fit, held_out, score
from scholargraph.llm.sharding import shard_by_bytes
from scholargraph.llm.spelling import spelling_variants
from scholargraph.llm.substrings import repeated_spans, without_spans
from scholargraph.llm.syncmers import fingerprints

#: Folder of public tokenizer files, the same on every node; None: that of the installed package.
TOKENIZERS: str | None = None
#: Sequence length and end-of-document id of the packing query.
CAPACITY, END_ID = 1024, 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return f"{TOKENIZERS}/{name}" if TOKENIZERS else public_tokenizers.path(name)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """The quality model, from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return fit(docs, labels.select("doc_id", "quality"))


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op2_shard_documents")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of near-equal bytes."""
    out = shard_by_bytes(documents(spark, sf_dir), 16)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op3_nearest_neighbours")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


@query("op4_bpe_round_trip")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded with the word vocabulary, as digests."""
    return encode_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), digest=True)


@query("op5_repeated_passages")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that an earlier one has in a passage of at
    least 50 words, as runs of words."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    spans = merged_spans(repeated_passages(docs))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = docs.select("doc_id").join(spans, F.col("doc_id") == F.col("doc"), "left")
    return out.select("doc_id", F.coalesce(length, F.lit(0)).alias("n_repeated"), "spans")


@query("op6_repeated_strings")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that occur elsewhere."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = without_spans(docs, repeated_spans(docs, length=200))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op7_exact_dedup",
    r"""
    WITH n AS (
      SELECT doc_id, length(coalesce(text, '')) AS points,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
      FROM documents)
    SELECT doc_id,
           first_value(doc_id) OVER w AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept,
           text_sha256
    FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every document, blanks aside, with the row that stays."""
    return exact_dedup(documents(spark, sf_dir), digest=True)


def packed(df: DataFrame) -> DataFrame:
    """``df`` packed with the byte-level vocabulary, at the production sizes."""
    import public_tokenizers

    return pack_documents(
        df,
        tokenizer_file("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        {"<|endoftext|>": 50256},
        END_ID,
        CAPACITY,
        library_path=tokenizer_file("byte_bpe_50k.json"),
    )


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in few sequences of at most 1024 tokens."""
    return packed(documents(spark, sf_dir))


@query("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that repeat an earlier line of any."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    counted = docs.select("doc_id", n_lines.alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    out = counted.join(repeated_lines(docs), "doc_id", "left")
    return out.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


@query("op9_minhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 4-word shingles reach 0.8."""
    return near_duplicates(documents(spark, sf_dir), k=4, percent=80)


@query(
    "op11_spelling_variants",
    r"""
    WITH RECURSIVE crc AS (
      SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j:
               CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
    runs AS (
      SELECT doc_id, run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
      GROUP BY ALL),
    hashed AS (
      SELECT run, n, xor(4294967295, list_reduce(
               list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'),
                              lambda x: CAST('0x' || x AS BIGINT)),
               lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]), 4294967295)) AS h
      FROM runs, crc),
    words AS (
      SELECT word, CAST(sum(n) AS BIGINT) AS n
      FROM (SELECT CASE WHEN h % 199 = 0
                        THEN left(run, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2)
                        ELSE run END AS word, n
            FROM hashed)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    cuts AS (
      SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS rest
      FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
    near AS (
      SELECT DISTINCT word, n, other, other_n FROM (
        SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b USING (rest, i) WHERE a.word <> b.word
        UNION ALL SELECT a.word, a.n, w.word, w.n FROM cuts a JOIN words w ON w.word = a.rest
        UNION ALL SELECT w.word, w.n, a.word, a.n FROM cuts a JOIN words w ON w.word = a.rest)),
    best AS (
      SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n
      FROM near GROUP BY word),
    forms AS (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
             CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
      FROM words w LEFT JOIN best USING (word)),
    steps AS (
      SELECT word, word AS at FROM forms
      UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n
    FROM forms f JOIN steps s USING (word) JOIN forms e ON e.word = s.at WHERE e.form IS NULL
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, one run in 199 damaged, with the form each varies."""
    return spelling_variants(documents(spark, sf_dir), damage=199)


@query("op12_syncmer_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, compared."""
    return fingerprints(documents(spark, sf_dir))


@query(
    "op13_ranked_search",
    r"""
    WITH terms AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM documents WHERE doc_id IS NOT NULL),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
    n AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL),
    stats AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
    m AS (SELECT doc_id, 100 - 90 + ((90 * n * docs) // total) AS m FROM n, stats),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
          FROM (SELECT term, count(*) AS df FROM tf GROUP BY ALL), stats),
    items AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark WHERE item_id IS NOT NULL),
    scored AS (
      SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM items JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id)
      GROUP BY ALL HAVING score > 0),
    ranked AS (
      SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
      FROM scored)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked_search(documents(spark, sf_dir), items)
