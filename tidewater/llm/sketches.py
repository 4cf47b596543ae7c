"""Document fingerprints: threshold-scaled sketches of word shingles, built and compared by Spark functions alone.

A sketch keeps every shingle whose hash lies below a fixed fraction of the range, so its size follows the document's, the
sketch of a union is the union of sketches, and the share of a small document's sketch that a large one holds estimates
how much of the small document the large one contains, however unequal they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.storage import written

#: Words of a shingle; hexadecimal digits of its hash; and what a sketch keeps: hashes whose first digit is below FIRST, one
#: shingle in eight.
WIDTH, DIGITS, FIRST = 5, 15, 2
BELOW = FIRST << (4 * (DIGITS - 1))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The maximal runs of characters other than 0x20 and 0x09 to 0x0D, with A-Z lower-cased."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def sketch_of_words(found: Column, *, width: int = WIDTH) -> Column:
    """Sorted distinct hashes below the threshold of the shingles of ``found``; the least hash alone where none is below it.

    With fewer words than ``width`` the whole sequence is the only shingle; without words the sketch is empty. ``found``
    should be a column that is already there, not an expression, as each shingle looks at it ``width`` times. Hashes stay
    text until all but the few that matter are gone.
    """
    n = F.size(found)
    firsts = F.slice(found, F.lit(1), F.greatest(n - (width - 1), F.least(n, F.lit(1))))
    shingle = lambda w, i: F.concat_ws(" ", w, *[F.get(found, i + k) for k in range(1, width)])
    hashes = F.transform(firsts, lambda w, i: F.left(F.md5(shingle(w, i).cast("binary")), F.lit(DIGITS)))
    few = F.transform(F.array(hashes), lambda own: F.concat(F.filter(own, lambda h: h < str(FIRST)), F.array(F.array_min(own))))[0]
    numbers = F.transform(F.filter(few, lambda h: h.isNotNull()), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.transform(F.array(numbers), lambda own: kept(own))[0]


def kept(hashes: Column, below: int = BELOW) -> Column:
    """What a sketch keeps of ``hashes``. Sketches merge: ``kept(concat(a, b))`` of two sketches is the sketch of both
    documents' shingles together."""
    low = F.filter(hashes, lambda h: h < below)
    least = F.filter(F.array(F.array_min(hashes)), lambda h: h >= below)
    return F.array_sort(F.array_distinct(F.concat(low, least)))


def printed(sketch: Column) -> Column:
    """The sketch as text: each hash in DIGITS hexadecimal digits, comma-joined."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), ",")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles that the other holds, 0 to 1: of two sketches, what the smaller one
    shares. 1 for two empty sketches, 0 for one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def neighbours_in_order(keys: DataFrame, columns: list[str], keep: str, name: str) -> DataFrame:
    """Distinct ``keys`` with ``before``, the struct of ``columns`` and ``keep`` of the key before it in the global order
    of ``columns``; the first key's is the last key. Keys are range-sorted; only one row a range meets in one window."""
    whole = F.struct(*columns, keep)
    rows = written(keys.repartitionByRange(*[F.col(c).asc_nulls_first() for c in columns]).withColumn("_range", F.spark_partition_id()), name)
    lasts = rows.groupBy("_range").agg(F.max(whole).alias("_last"))
    over = Window.orderBy("_range")
    final = F.last("_last").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lasts = lasts.select("_range", F.coalesce(F.lag("_last").over(over), final).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in columns])
    return rows.join(F.broadcast(lasts), "_range").select(*columns, F.coalesce(F.lag(whole).over(inside), F.col("_before")).alias("before"))


def fingerprints(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """Sketches of every document, of its edited text, and how alike they and the next document's are.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. Null text counts as empty. The next
    document is that with the next doc_id, null first, after the last one the first; rows with one doc_id and several texts
    are documents in the order of a hash of the text, and rows that repeat both are one document, which all of them
    report. A document alone is its own next. The edited text is the text with the last half of its code points, rounded down,
    replaced by as many of the next document's first. Texts are shuffled once whole and once as the needed prefixes, with
    their sketches; a document longer than memory is not split. An empty table gives no rows.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    given = given.withColumns({"h1": F.xxhash64("doc_id", "text"), "h2": F.xxhash64(F.lit(7), "text", "doc_id")})
    keys = given.select("doc_id", "h1", "h2", F.length("text").alias("n")).distinct()
    ordered = neighbours_in_order(keys, ["doc_id", "h1", "h2"], "n", "document-order").select("h1", "h2", "before")

    # Both uses of ``own`` need the same columns, so that Spark shuffles it once.
    own = given.select("doc_id", "h1", "h2", "text", words(F.col("text")).alias("found"))
    own = own.select("doc_id", "h1", "h2", "text", sketch_of_words(F.col("found"), width=width).alias("sketch"))
    sent = own.join(ordered, ["h1", "h2"])
    prefix = F.substring("text", F.lit(1), F.shiftright("before.n", 1))
    sent = sent.select(F.col("before.h1").alias("h1"), F.col("before.h2").alias("h2"), F.col("doc_id").alias("next_id"), prefix.alias("prefix"), F.col("sketch").alias("next_sketch"))
    sent = sent.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("next_id", "prefix", "next_sketch")])

    both = own.join(sent, ["h1", "h2"])
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    stays = (F.col("n_chars") - F.shiftright("n_chars", 1)).cast("int")
    both = both.select("doc_id", "next_id", "n_chars", "sketch", "next_sketch", F.concat(F.substring("text", F.lit(1), stays), "prefix").alias("edited"))
    both = both.select("*", words(F.col("edited")).alias("edited_found"))
    both = both.select("doc_id", "next_id", "n_chars", "sketch", "next_sketch", "edited", sketch_of_words(F.col("edited_found"), width=width).alias("edited_sketch"))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.col("next_id").alias("next_doc_id"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op12: fingerprints of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_HASHES = "list_transform(range(1, greatest(len({w}) - 4, least(len({w}), 1)) + 1), lambda i: left(md5(array_to_string({w}[i:i + 4], ' ')), 15))"
_SKETCH = """list_sort(list_distinct(CASE WHEN len(list_filter({h}, lambda x: x < '2')) > 0 THEN list_filter({h}, lambda x: x < '2')
  WHEN len({h}) > 0 THEN [list_min({h})] ELSE []::VARCHAR[] END))"""
_NEAR = "CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE CAST(len({a}) = len({b}) AS DOUBLE) END"

SQL = f"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
following AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
  FROM given WINDOW o AS (ORDER BY doc_id)),
edited AS (SELECT *, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM following),
found AS (SELECT *, {_WORDS.format(t="text")} AS w, {_WORDS.format(t="next_text")} AS nw, {_WORDS.format(t="edited")} AS ew FROM edited),
hashed AS (SELECT doc_id, next_id, n, edited, {_HASHES.format(w="w")} AS h, {_HASHES.format(w="nw")} AS nh, {_HASHES.format(w="ew")} AS eh FROM found),
kept AS (SELECT doc_id, next_id, n, edited, {_SKETCH.format(h="h")} AS s, {_SKETCH.format(h="nh")} AS ns, {_SKETCH.format(h="eh")} AS es FROM hashed)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s, ',') AS fingerprint, array_to_string(es, ',') AS edited_fingerprint,
  {_NEAR.format(a="s", b="es")} AS near_edited, {_NEAR.format(a="s", b="ns")} AS near_next, next_id AS next_doc_id
FROM kept
"""
