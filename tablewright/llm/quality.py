"""Quality rules: counts within a document, and the frequency of its lines across the documents of its host.

Lines are normalised (lower case, white space collapsed), hashed, and counted once per document and host.  A line that
occurs in more than ``min_documents`` different texts of a host is removed there, however large the host is.  A document
that lines are removed from is rejected if too little of it is left.  Everything is a DataFrame expression;
counts are combined on the map side, so a line in every document costs one record per task.

Edge cases: a null text has no words and no lines and fails.  Whole copies in a host count once in line frequencies; rows
of equal id, text and host get equal results, and what is removed in one host stays in another.  A null host is a host of its own.  Empty tables give
empty tables.  Columns other than id, text and host are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common

SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SALTS = 8


def words(text: Column) -> Column:
    """The words of a text, split at space and the codes 9 to 13."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACES, "") != "")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " ")))


def _neighbours(array: str, apart: int, join) -> Column:
    """``join`` over all elements of ``array`` that are ``apart`` places from each other."""
    size = F.greatest(F.size(array) - apart, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), size), F.slice(array, F.lit(apart + 1), size), join)


def document_counts(df: DataFrame) -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` to (id, host, text, tag);
    the text goes."""
    both = lambda a, b: F.xxhash64(a, b)
    text = F.coalesce("text", F.lit(""))
    out = df.select(
        "id", "host", "tag", F.transform(words(text), lambda w: F.xxhash64(w)).alias("w1"),
        F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines_with_words(text).alias("lines"))
    kept = ["id", "host", "tag", "word_chars", "n_symbols"]
    out = out.select(*kept, F.size("w1").cast("bigint").alias("n_words"), _neighbours("w1", 1, both).alias("w2"),
                     (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"))
    kept += ["n_words", "n_dup_lines"]
    out = out.select(*kept, _neighbours("w2", 2, both).alias("w4"))
    out = out.select(*kept, _neighbours("w4", 4, both).alias("w8"))
    # Only texts with a repeated window go on: sort its windows, and mark those that have an equal neighbour.
    out = out.select(*kept, F.when(F.size(F.array_distinct("w8")) < F.size("w8"), F.col("w8")).alias("w8"))
    out = out.select(*kept, F.sort_array(F.transform("w8", lambda x, i: F.struct(x.alias("x"), i.alias("i")))).alias("s"))
    out = out.select(*kept, "s", _neighbours("s", 1, lambda a, b: a["x"] == b["x"]).alias("same"))
    no = F.array(F.lit(False))
    found = F.zip_with(F.concat(no, "same"), F.concat("same", no), lambda a, b: a | b)
    out = out.select(*kept, F.sort_array(F.filter(F.zip_with("s", found, lambda p, hit: F.when(hit, p["i"])),
                                                  lambda i: i.isNotNull())).alias("at"))
    gaps = _neighbours("at", 1, lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)
    return out.select(*kept, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def _prepared(df: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    text = df[text_column].cast("string")
    return df.select(df[id_column].alias("id"), df[host_column].alias("host"), text.alias("text"),
                     F.xxhash64(text).alias("tag"))


def frequent_lines(df: DataFrame, min_documents: int = 20, id_column: str = "doc_id", text_column: str = "text",
                   host_column: str = "source") -> DataFrame:
    """(host, line, documents): the hashes of lines in more than ``min_documents`` different texts of their host."""
    docs = _prepared(df, id_column, text_column, host_column)
    lines = F.array_distinct(F.transform(lines_with_words(F.coalesce("text", F.lit(""))), line_hash))
    # The hashes are stored, so copies meet as hashes and not as texts, and lines are cut once.
    hashed = common.stored(docs.select("host", "tag", lines.alias("lines")), "line_hashes")
    texts = hashed.groupBy("host", "tag").agg(F.first("lines").alias("lines"))
    return (texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line")
            .agg(F.count("*").alias("documents")).where(F.col("documents") > min_documents))


def _on_frequent(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows (id, host, line, ..) whose line is frequent in their host.  A line that is frequent fills many rows, so both
    sides are salted."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    limits = frequent.select(F.col("host").alias("h"), F.col("line").alias("l"), salts.alias("s"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "id", "tag"), F.lit(SALTS)).cast("int"))
    return salted.join(limits, (F.col("line") == F.col("l")) & (F.col("salt") == F.col("s"))
                       & F.col("host").eqNullSafe(F.col("h")))


def _removed(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(id, tag, host, n_removed_lines, removed_chars) of the documents with frequent lines."""
    lines = F.transform(lines_with_words(F.coalesce("text", F.lit(""))), lambda x: F.struct(
        line_hash(x).alias("line"), F.length(F.translate(x, SPACES, "")).alias("chars")))
    rows = docs.select("id", "tag", "host", F.posexplode(lines).alias("place", "own")).select(
        "id", "tag", "host", "place", "own.line", "own.chars")
    return (_on_frequent(rows, frequent).groupBy("id", "tag", "host", "place").agg(F.max("chars").alias("chars"))
            .groupBy("id", "tag", "host").agg(F.count("*").alias("n_removed_lines"), F.sum("chars").alias("removed_chars")))


def judge(df: DataFrame, min_documents: int = 20, keep_share: float = 0.3, min_chars: int = 60,
          id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """One row per row of ``df``: the counts, ``base_failed``, ``n_removed_lines``, ``removed_chars`` and ``kept``.

    A document that lines are removed from has to keep ``keep_share`` of its word characters and ``min_chars`` of them.
    """
    docs = _prepared(df, id_column, text_column, host_column)
    # Stored, so that its true size decides between a broadcast and a shuffled join.
    frequent = common.stored(frequent_lines(df, min_documents, id_column, text_column, host_column), "lines")
    removed = _removed(docs, frequent).select(F.col("id").alias("rid"), F.col("tag").alias("rtag"),
                                              F.col("host").alias("rhost"), "n_removed_lines", "removed_chars")
    counts = document_counts(docs)
    out = counts.join(removed, F.col("id").eqNullSafe(F.col("rid")) & F.col("tag").eqNullSafe(F.col("rtag"))
                      & F.col("host").eqNullSafe(F.col("rhost")), "left")
    gone = F.coalesce("removed_chars", F.lit(0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("word_chars") - gone
    depleted = (gone > 0) & ((left < keep_share * F.col("word_chars")) | (left < min_chars))
    return out.select(F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", failed.alias("base_failed"),
                      F.coalesce("n_removed_lines", F.lit(0)).alias("n_removed_lines"), gone.alias("removed_chars"),
                      (~failed & ~depleted).alias("kept"))


def without_lines(df: DataFrame, frequent: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  host_column: str = "source") -> DataFrame:
    """``df`` with the frequent lines taken out of its texts; other columns and rows stay."""
    docs = _prepared(df, id_column, text_column, host_column)
    hashes = F.explode(F.array_distinct(F.transform(F.split("text", "\n"), line_hash)))
    own = (_on_frequent(docs.select("id", "tag", "host", hashes.alias("line")), frequent)
           .groupBy(F.col("id").alias("__id"), F.col("tag").alias("__tag"), F.col("host").alias("__host"))
           .agg(F.collect_set("line").alias("__out")))
    text = df[text_column].cast("string")
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("__out", line_hash(x))), "\n")
    joined = df.join(own, df[id_column].eqNullSafe(F.col("__id")) & F.xxhash64(text).eqNullSafe(F.col("__tag"))
                     & df[host_column].eqNullSafe(F.col("__host")), "left")
    return joined.select(*[F.when(F.col("__out").isNull(), text).otherwise(rest).alias(c) if c == text_column
                           else F.col(c) for c in df.columns])
