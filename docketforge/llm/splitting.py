"""Problem 2: splitting oversized texts at natural boundaries, with overlap.

The text is turned into a string of one character for each byte of its UTF-8, so that bounded
quantifiers count bytes. One regular expression then consumes it: its alternatives, ordered
by strength of the boundary, each take up to the limit. Array functions look back from each
cut for the overlap. All of it is built-in SQL; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table


def _bytes_as_chars(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _chars_as_text(raw: Column) -> Column:
    return F.decode(F.encode(raw, "ISO-8859-1"), "UTF-8")


#: White space within a blank line beyond which it is no paragraph end but a line end.
BLANK = 8
#: Pieces of which the places are summed up at once.
BLOCK = 256


def boundary_pattern(limit: int) -> str:
    """Consumes at most limit bytes: the rest of the text, else up to the last paragraph end,
    sentence end, line end or white space after half the limit, else up to the last white space
    before a word that fits into a piece, else as many whole characters as fit."""
    low = max(1, limit // 2)
    most = lambda tail: f"{{{low},{max(low, limit - tail)}}}"
    cont = r"(?![\x80-\xBF])"
    return (
        "(?s)"
        rf".{{1,{limit}}}\z"
        rf"|.{most(BLANK + 4)}\r?\n[ \t]{{0,{BLANK}}}\r?\n"
        rf"|.{most(3)}[.!?;][\"')]?\s"
        rf"|.{most(2)}\r?\n"
        rf"|.{most(1)}\s"
        rf"|(?>.{{0,{limit - 1}}}\s)(?!\S{{{limit}}})"
        rf"|.{{1,{limit}}}{cont}"
    )


def _sums(column: str):
    """The places at which the strings of an array begin when put together, and their end.

    They are summed up in blocks, so that no long array is copied once an element.
    """
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    lengths = F.transform(column, F.length)
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(column) / BLOCK).cast("int")), lambda k: F.slice(lengths, k * BLOCK + 1, BLOCK))
    inner = F.transform(parts, lambda p: F.aggregate(p, F.array(F.lit(0)), add))
    starts = F.aggregate(F.transform(inner, lambda p: F.element_at(p, -1)), F.array(F.lit(0)), add)
    # both are bound by a struct, so that they are made once
    return F.transform(
        F.array(F.struct(inner.alias("inner"), starts.alias("starts"))),
        lambda s: F.flatten(F.transform(s["inner"], lambda p, i: F.transform(F.slice(p, 1, BLOCK), lambda x: x + F.get(s["starts"], i)))),
    )[0]


def _split(df: DataFrame, text: str, to: str, limit: Column, overlap: Column, pattern: Column) -> DataFrame:
    """split_text with a limit, an overlap and a pattern for each row."""
    raw = _bytes_as_chars(F.col(text))
    fresh = F.when(F.octet_length(text) <= limit, F.filter(F.array(raw), lambda x: x != "")).otherwise(F.regexp_extract_all(raw, pattern, F.lit(0)))
    # columns of their own, so that each is computed once and not for each piece
    df = df.withColumn("__fresh", fresh)
    df = df.withColumn("__starts", _sums("__fresh"))
    # the look-back begins after white space where there is some, else at a whole character
    word = lambda t: F.regexp_extract(t, r"(?s)^\S*\s+(\S.*)$", 1)
    df = df.withColumn("__backs", F.transform("__fresh", lambda x: F.transform(F.array(F.right(x, overlap)), lambda t: F.struct(t.alias("t"), word(t).alias("w")))[0]))
    back = lambda i: F.when((i == 0) | (overlap <= 0), F.lit("")).otherwise(
        F.when(F.length(F.get("__fresh", i - 1)) <= overlap, F.get("__backs", i - 1)["t"])
        .when(F.get("__backs", i - 1)["w"] != "", F.get("__backs", i - 1)["w"])
        .otherwise(F.regexp_replace(F.get("__backs", i - 1)["t"], r"^[\x80-\xBF]+", ""))
    )
    pieces = F.transform(
        "__fresh",
        lambda part, i: F.struct(
            (i + 1).alias("piece_no"), (F.get("__starts", i) - F.length(back(i))).alias("start_byte"), F.length(back(i)).alias("overlap_bytes"), _chars_as_text(F.concat(back(i), part)).alias("text")
        ),
    )
    return df.withColumn(to, F.when(F.col(text).isNotNull(), pieces)).drop("__fresh", "__starts", "__backs")


def _checked(limit: int, overlap: int) -> None:
    if not 0 <= overlap <= limit - 2 * BLANK:
        raise ValueError("overlap must leave room for new text")


def split_text(df: DataFrame, limit: int, overlap: int, text: str = "text", to: str = "pieces") -> DataFrame:
    """df with a column of array<struct<piece_no, start_byte, overlap_bytes, text>>: consecutive
    pieces of at most limit bytes.

    Each piece begins with up to overlap bytes repeated from the end of the piece before,
    beginning at a word where there is one and never inside a character. The new parts of the
    pieces put together are the text, byte for byte. Texts within the limit give one piece;
    null gives null and the empty text an empty array.
    """
    _checked(limit, overlap)
    return _split(df, text, to, F.lit(limit), F.lit(overlap), F.lit(boundary_pattern(limit - overlap)))


def split_documents(docs: DataFrame, configs: DataFrame, only_oversized: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text) for each provider of configs(provider, max_text_length, overlap_length).

    One row a piece: provider, doc_id, piece_no, start_byte, overlap_bytes, text. Null and
    empty texts have no pieces. Rows that repeat are split each; extra columns are not looked
    at. configs is a fixed list of a few rows; the corpus is read once for all of them.
    """
    specs = configs.select("provider", "max_text_length", "overlap_length").collect()
    for c in specs:
        _checked(c.max_text_length, c.overlap_length)
    kind = "array<struct<provider: string, most: int, back: int, pattern: string>>"
    each = F.array(*[F.struct(F.lit(c.provider), F.lit(c.max_text_length), F.lit(c.overlap_length), F.lit(boundary_pattern(c.max_text_length - c.overlap_length))) for c in specs]).cast(kind)
    src = docs.select("doc_id", "text", F.explode(each).alias("c")).select("c.*", "doc_id", "text")
    if only_oversized:
        src = src.where(F.octet_length("text") > F.col("most"))
    cut = _split(src, "text", "pieces", F.col("most"), F.col("back"), F.col("pattern"))
    # not inline: the optimiser would test the size of the pieces below, computing them twice
    return cut.select("provider", "doc_id", F.inline_outer("pieces")).where("piece_no is not null")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents for all providers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = split_documents(spread(docs, "doc_id"), table(spark, sf_dir, "prompt_configs"))
    return pieces.select("provider", "doc_id", "piece_no", "start_byte", "overlap_bytes", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the splitter cuts into more than one piece, by provider."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = split_documents(spread(docs, "doc_id"), table(spark, sf_dir, "prompt_configs"), only_oversized=True)
    return pieces.where("piece_no = 2").select("provider", "doc_id")


def p2_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new parts of each document's pieces put together, as a hash, and whether all its pieces are within the limit."""
    most = table(spark, sf_dir, "prompt_configs").select("provider", "max_text_length")
    new = F.substring(F.encode("text", "UTF-8"), F.col("overlap_bytes") + 1, F.octet_length("text"))
    parts = p2_pieces(spark, sf_dir).join(most, "provider").select("provider", "doc_id", "piece_no", new.alias("new"), (F.octet_length("text") <= F.col("max_text_length")).alias("fits"))
    whole = parts.groupBy("provider", "doc_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", F.decode("new", "ISO-8859-1").alias("new")))).alias("p"), F.bool_and("fits").alias("fits"))
    return whole.select("provider", "doc_id", F.sha2(F.encode(F.array_join("p.new", ""), "ISO-8859-1"), 256).alias("sha256"), "fits")
