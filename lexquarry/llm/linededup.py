"""Line dedup by content-defined chunks of lines, in DataFrame expressions alone.

A rolling hash over the hashes of two lines ends a chunk after a line where it is below half of its range, so boundaries
move with the lines and a passage is cut alike wherever it stands. The first and last chunk of a shared passage begin
and end in its surroundings; so besides whole chunks their ends and beginnings count as chunks too: from every line to
the next boundary, and from every boundary to each line before the next one, MIN_LINES to MAX_LINES lines. Of equal
chunks (not all empty) the first by doc_id, then place, stays, and every line that lies in a later one is removed.

Plan: hashes alone are aggregated and joined first; only for chunks whose hash occurs twice are the bytes compared. The
texts are shuffled once, by doc_id and a hash, and that exchange serves both joins with them: the one that fetches the
chunks to compare, and the one that cuts. Copies of a chunk are aggregated before their shuffle.

Cases: null counts as an empty text and stays null; rows equal in doc_id and text count as one place and fare alike;
rows of one doc_id with other texts are apart, ordered by a hash of the text; null ids come first. Only "\\n" ends a
line. Chunks of different bytes with one 64-bit hash all stay. All columns are kept, and n_chars, if there, follows the
text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LINES, MAX_LINES = 2, 16
_TEXT = "coalesce(text, '')"
#: cuts[i - 1]: whether a chunk ends after line i. Lines are counted from 1; marks are numbers from their hashes.
_MARKS = "transform(lines, l -> cast(conv(substr(md5(cast(l as binary)), 1, 8), 16, 10) as bigint))"
_CUTS = "transform(sequence(1, size(lines)), i -> i = size(lines) or i > 1 and (marks[i - 1] + 31 * marks[i - 2]) % 64 < 32)"
#: For each line the last line of the chunk that begins with it: the next boundary's; and the first line of the chunk that
#: ends with it: the one after the boundary before.
_LASTS = f"""transform(sequence(1, size(lines)), i ->
    coalesce(array_min(filter(sequence(i, least(i + {MAX_LINES - 1}, size(lines))), j -> j > i and cuts[j - 1])), least(i + {MAX_LINES - 1}, size(lines))))"""
_FIRSTS = f"""transform(sequence(1, size(lines)), j ->
    coalesce(array_max(filter(sequence(greatest(j - {MAX_LINES - 1}, 1), j), i -> i > 1 and cuts[i - 2])), greatest(j - {MAX_LINES - 1}, 1)))"""
#: (start, last), each once: a chunk of the second kind that is also one of the first counts as that.
_CHUNKS = f"""filter(concat(
    transform(lasts, (e, k) -> struct(k + 1 as start, e as last)),
    filter(transform(firsts, (s, k) -> struct(s as start, k + 1 as last)), c -> lasts[c.start - 1] <> c.last)
), c -> c.last - c.start >= {MIN_LINES - 1})"""


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text, rest): the other columns travel in a struct, so their names can't clash with those used here."""
    return docs.select("doc_id", F.expr(f"xxhash64({_TEXT})").alias("h"), "text", F.struct(*(c for c in docs.columns if c != "text")).alias("rest"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(place, last, hash): the chunks of docs(doc_id, text), by place (doc_id, hash of the text, first line)."""
    d = docs.select("doc_id", F.expr(f"xxhash64({_TEXT})").alias("h"), F.expr(f"split({_TEXT}, '\n', -1)").alias("lines"))
    d = d.withColumn("marks", F.expr(_MARKS)).withColumn("hashes", F.expr("transform(lines, l -> if(l = '', 0, xxhash64(l)))"))
    d = d.withColumn("cuts", F.expr(_CUTS)).withColumn("lasts", F.expr(_LASTS)).withColumn("firsts", F.expr(_FIRSTS)).select("doc_id", "h", "hashes", F.explode(F.expr(_CHUNKS)).alias("c"))
    d = d.withColumn("held", F.expr("slice(hashes, c.start, c.last - c.start + 1)")).where("exists(held, x -> x <> 0)")  # not all lines empty
    return d.select(F.struct("doc_id", "h", "c.start").alias("place"), "c.last", F.xxhash64("held").alias("hash"))


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, h, gone): first and last lines of the chunks to remove, for each document (by id and hash of the text)."""
    places = occurrences(docs)
    often = places.groupBy("hash").agg(F.count("*").alias("many"), F.min("place").alias("first")).where("many > 1").select("hash", "first")
    some = places.join(often, "hash").select("hash", "last", "place", (F.col("place") != F.col("first")).alias("later"))
    # lists of one document's chunks: bounded by its lines
    held = some.groupBy(F.col("place.doc_id").alias("id"), F.col("place.h").alias("th")).agg(F.collect_set(F.struct("place.start", "last", "hash")).alias("some"))
    texts = _keyed(docs).join(held, F.expr("doc_id <=> id and h = th")).withColumn("lines", F.expr(f"split({_TEXT}, '\n', -1)"))
    # the columns' hash is asked for only so that both joins read the same columns, and one exchange serves them
    texts = texts.select(F.xxhash64("rest").alias("rest"), F.explode(F.expr("transform(some, c -> struct(c.hash as hash, array_join(slice(lines, c.start, c.last - c.start + 1), '\n') as chunk))")).alias("c"))
    equal = texts.groupBy("c.hash", "c.chunk").agg(F.max("rest").alias("rest")).groupBy("hash").agg(F.count("*").alias("texts"), F.max("rest").alias("rest")).where("texts = 1 and rest is not null").select("hash")
    gone = some.where("later").join(equal, "hash")
    return gone.groupBy("place.doc_id", "place.h").agg(F.collect_set(F.struct("place.start", "last")).alias("gone"))


def deduped(docs: DataFrame) -> DataFrame:
    """All columns of docs with repeated chunks cut out of the text, and n_lines, n_removed_lines (these replace columns
    of docs by their names)."""
    docs = docs.drop("n_lines", "n_removed_lines")
    gone = repeated(docs).select(F.col("doc_id").alias("id"), F.col("h").alias("th"), "gone")
    d = _keyed(docs).join(gone, F.expr("doc_id <=> id and h = th"), "left").withColumn("lines", F.expr(f"split({_TEXT}, '\n', -1)"))
    kept = "array_except(sequence(1, size(lines)), flatten(transform(gone, c -> sequence(c.start, c.last))))"
    d = d.withColumn("kept", F.expr(f"if(gone is null, null, {kept})"))
    out = """named_struct('text', if(gone is null, text, array_join(transform(kept, i -> lines[i - 1]), '\n')), 'n_lines', cast(size(lines) as bigint),
        'n_removed_lines', cast(if(gone is null, 0, size(lines) - size(kept)) as bigint))"""
    # a generator, so that a later filter on these columns is not pushed below and computed anew for every line
    d = d.select("rest", F.inline(F.expr(f"array({out})")))
    d = d.select(*("text" if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns), "n_lines", "n_removed_lines")
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.expr("if(n_removed_lines = 0, n_chars, cast(char_length(text) as bigint))"))
    return d
