"""Line dedup with a log-template tree: lines that follow one template in many documents are dropped.

The tree has a fixed depth: a line goes by its number of tokens, then by its first LEAD tokens, to a leaf. Tokens that
look like variable fields (they hold a digit) are a wildcard from the start. In a leaf, a token stays in the template if
lines of at least MIN_DOCS documents have it at its place, else its place becomes a wildcard. A template whose fixed
tokens are at least FIXED of all and whose lines stand in at least MIN_DOCS documents recurs, and its lines are dropped
wherever they stand. FIXED guards templates made of different lines only: a line whose own masked form stands in MIN_DOCS
documents recurs whatever its share of wildcards ("Page 3 of 10"). A line of wildcards only is not masked: it recurs if
the very same line does.

Long lines, of LONG words or more, can't meet by chance: they recur from LONG_DOCS different texts on, by their masked form
if FIXED of its tokens are fixed, else word by word. Different texts, as copies of one text are the work of exact dedup; and
three of them, as two near copies would lose what they share in both.

Work shrinks at each step: lines are hashed where they are read (hashes and places are all that is shuffled), counted
once for each document, and only leaves that at least MIN_DOCS line-and-document pairs reach are looked at by token,
each distinct line once with its number of documents; so a line that all documents share is one row there. Documents of
a token are counted one by one only where neither a single line nor the leaf itself settles it, and lines of MIN_DOCS documents do.

A document is a doc_id with its text: rows that repeat both count once, rows that share only the id count each, and a
null doc_id is an id like any other. What goes depends on the text alone, so it is kept by text (a 64-bit hash and the
length in bytes), not by id. Blank lines are no lines and always stay. Null and empty texts have none and stay as they
are (null gives empty). An empty table gives an empty result. Extra columns are passed through by `without_templates`,
ignored elsewhere; it owns the names `__dropped`, `__numbers`, `__whole` and `__bytes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frontrank.llm.common import let, read, slices, small_batches, texts, written

LEAD, MIN_DOCS, FIXED = 4, 10, 0.7
LONG, LONG_DOCS = 20, 3
WILD = "<*>"
#: Bytes of dropped line numbers, and rows of lines, up to which they are broadcast.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 1_000_000


def parsed(docs: DataFrame, spelled: bool = False) -> DataFrame:
    """doc_id, whole and bytes of the text, number, hash, leaf, and of long lines a hash to compare; spelled: only hash and the line with variable fields masked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, limit=2 << 20):
            lists = pc.split_pattern(texts(batch.column(1)), "\n")
            lines = pc.utf8_trim_whitespace(pc.replace_substring_regex(lists.flatten(), r"\s+", " "))
            row = np.asarray(pc.list_parent_indices(lists), np.int64)
            number = np.arange(len(row)) - np.asarray(lists.offsets, np.int64)[row] + int(lists.offsets[0].as_py())
            some = np.flatnonzero(np.asarray(pc.not_equal(lines, ""), bool))
            distinct = pc.dictionary_encode(lines.take(pa.array(some)))
            if isinstance(distinct, pa.ChunkedArray):
                distinct = distinct.combine_chunks()
            plain = distinct.dictionary.to_pylist()
            masked = pc.replace_substring_regex(distinct.dictionary, r"\S*[0-9]\S*", WILD).to_pylist()
            own, leaf, far, long = np.empty(len(masked), np.int64), np.empty(len(masked), np.int64), np.zeros(len(masked), np.int64), np.zeros(len(masked), bool)
            for i, line in enumerate(masked):
                if line.startswith(WILD) and all(t == WILD for t in line.split(" ")):
                    own[i] = xxhash.xxh3_64_intdigest(plain[i]) - 2**63
                else:
                    own[i] = xxhash.xxh3_64_intdigest(line) - 2**63
            if spelled:
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(masked, pa.string())], ["line", "masked"])
                continue
            for i, line in enumerate(masked):
                blanks = line.count(" ")
                if blanks + 1 >= LONG:
                    tokens = line.split(" ")
                    long[i] = True
                    far[i] = xxhash.xxh3_64_intdigest(line if tokens.count(WILD) <= len(tokens) * (1 - FIXED) else plain[i]) - 2**63
                if line.startswith(WILD) and all(t == WILD for t in line.split(" ")):
                    leaf[i] = own[i]
                else:
                    leaf[i] = xxhash.xxh3_64_intdigest(f"{blanks} " + " ".join(line.split(" ", LEAD)[:LEAD])) - 2**63
            codes = np.asarray(distinct.indices)
            short = ~long[codes]
            column = texts(batch.column(1))
            whole = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in column.to_pylist()), np.uint64, batch.num_rows).view(np.int64)  # as Spark's xxhash64
            size = np.asarray(pc.binary_length(column), np.int64)
            columns = [batch.column(0).cast(pa.int64()).take(pa.array(row[some])), pa.array(whole[row[some]]), pa.array(size[row[some]]), pa.array(number[some], pa.int32()), pa.array(own[codes]), pa.array(leaf[codes]), pa.array(far[codes], mask=short)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "whole", "bytes", "number", "line", "leaf", "far"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "line long, masked string" if spelled else "doc_id long, whole long, bytes long, number int, line long, leaf long, far long")


def few(rows: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def supported(distinct: DataFrame, once: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, place, token) that lines of at least min_docs documents have."""
    token = ["leaf", "place", "token"]
    places = distinct.select("line", "leaf", "docs", F.posexplode("tokens").alias("place", "token")).filter(F.col("token") != WILD)
    reach = written(places.groupBy(*token).agg(F.sum("docs").alias("most"), F.max("docs").alias("least")).filter(F.col("most") >= min_docs), "reach")
    # All lines of a leaf share its leading tokens; if too few documents have them, no template of that leaf recurs anyway.
    sure = (F.col("least") >= min_docs) | (F.col("place") < LEAD)
    among = places.join(reach.filter(~sure).select(*token), token).join(once.select("line", "doc_id", "whole"), "line")
    counted = among.select(*token, "doc_id", "whole").distinct().groupBy(*token).count().filter(F.col("count") >= min_docs)
    return reach.filter(sure).select(*token).union(counted.select(*token))


def recurring(docs: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hashes of lines (column line) whose template recurs. lines: the table of parsed(docs)."""
    once = lines.select("line", "leaf", "doc_id", "whole").distinct()
    counted = written(once.groupBy("line", "leaf").agg(F.count("*").alias("docs")), "lines")
    alone = counted.filter(F.col("docs") >= min_docs).select("line")
    leaves = counted.groupBy("leaf").agg(F.sum("docs").alias("reach"), F.count("*").alias("lines")).filter(F.col("reach") >= min_docs).filter("lines > 1").select("leaf")
    hot = written(counted.join(leaves, "leaf"), "hot")
    spelled = parsed(docs, spelled=True).join(few(hot.select("line", "leaf", "docs")), "line").distinct()  # aggregated by hash: no sort of a hot line's occurrences
    distinct = written(spelled.select("line", "leaf", F.split("masked", " ").alias("tokens"), "docs"), "tokens")
    support = written(supported(distinct, once, min_docs), "support")
    places = distinct.select("line", "leaf", F.posexplode("tokens").alias("place", "token"))
    fixed = places.join(support, ["leaf", "place", "token"]).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("fixed"))
    shapes = distinct.join(fixed, "line").filter(F.size("fixed") >= F.size("tokens") * FIXED).select("line", F.xxhash64("leaf", F.size("tokens"), "fixed").alias("template"))
    shapes = written(shapes, "shapes")
    enough = once.join(few(shapes), "line").select("template", "doc_id", "whole").distinct().groupBy("template").count().filter(F.col("count") >= min_docs)
    return shapes.join(enough, "template").select("line").union(alone).distinct()


def long_recurring(lines: DataFrame, least: int = LONG_DOCS) -> DataFrame:
    """Hashes (column far) of long lines that stand in at least this many different texts."""
    once = lines.filter(F.col("far").isNotNull()).select("far", "whole").distinct()
    return once.groupBy("far").count().filter(F.col("count") >= least).select("far")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """whole and bytes of a text and the numbers (from 0) of its lines that are dropped, for texts that have some."""
    lines = written(parsed(docs), "parsed")
    bad = written(recurring(docs, lines, min_docs), "recurring")
    far = written(long_recurring(lines, min(min_docs, LONG_DOCS)), "long")
    at = ["whole", "bytes", "number"]
    found = lines.join(few(bad), "line").select(*at).union(lines.join(few(far), "far").select(*at))
    return written(found.groupBy("whole", "bytes").agg(F.sort_array(F.collect_set("number")).alias("dropped")), "dropped")


def without_numbers(lines: Column, numbers: Column) -> Column:
    """lines without those at these places (sorted, from 0), in one pass: the runs between them, on end."""

    def run(i: Column) -> Column:
        before, after = F.coalesce(F.get(numbers, i - 1), F.lit(-1)), F.coalesce(F.get(numbers, i), F.size(lines))
        return F.slice(lines, before + 2, after - before - 1)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(numbers)), run))


def without_templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the dropped lines taken out of text; all columns stay, and __dropped gives the number of lines gone."""
    gone = dropped_lines(docs, min_docs).withColumnsRenamed({"dropped": "__numbers", "whole": "__whole", "bytes": "__bytes"})
    held = gone.agg(F.coalesce(F.sum(F.lit(24) + 4 * F.size("__numbers")), F.lit(0))).first()[0]
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"__whole": F.xxhash64(text), "__bytes": F.octet_length(text).cast("long")})
    out = keyed.join(F.broadcast(gone) if held <= BROADCAST_BYTES else gone, ["__whole", "__bytes"], "left")
    kept = F.array_join(let(F.split(text, "\n"), lambda lines: without_numbers(lines, F.col("__numbers"))), "\n")
    own = out.withColumns({"text": F.when(F.col("__numbers").isNull(), text).otherwise(kept), "__dropped": F.coalesce(F.size("__numbers"), F.lit(0))})
    return own.select(*[F.col(f"`{c}`") for c in docs.columns if c != "__dropped"], "__dropped")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = without_templates(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__dropped").cast("long").alias("n_dropped"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
