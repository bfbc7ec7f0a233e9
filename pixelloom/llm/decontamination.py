"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

Words are runs of ASCII digits, ASCII letters (lower-cased) and all other characters beyond ASCII. A test phrase is a window
of `width` consecutive words of an item, or the whole item if it has fewer.

1. The index holds a posting (term, doc_id, text_key, pos) for every word of the corpus. Each part of the corpus writes its own
   postings, sorted by term, to the shared folder: no posting is shuffled, and the index serves any benchmark. text_key tells texts
   with the same doc_id apart.
2. The frequency of every test term comes from the index. A phrase with a term of frequency 0 cannot occur and goes. The terms of
   a phrase are ranked from the rarest on.
3. The lists of the rarest and second rarest terms are read and intersected at their offsets. What is left is intersected with
   the lists of all other terms, of which only the postings of documents still in question are read. An exact match has every
   term at its offset; a proximity match has every term within the phrase's width and `slop` of the rarest one, in any order.

Lists are joined by document and place, so a term that a third of all words are is spread like any other. Test terms and the
documents in question are broadcast only while their counted bytes stay under `BROADCAST_BYTES`; beyond it the same joins shuffle.
No step makes more rows than the corpus has words or the lists have postings; matches of a document are gathered as intervals.

Defined cases: a null or empty text has no words; an item without words has no phrase and no match; phrases that several
items share count for each of them; rows with one doc_id (null too) share
their hits, and each has its own words counted;
an empty table gives an empty result; an empty benchmark leaves every document clean; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.base import id_and_text, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Counted bytes of terms or document ids that may be broadcast.
BROADCAST_BYTES = 8 << 20


def words(text: Column) -> Column:
    """The words of a text with their letters as they are."""
    return F.array_remove(F.split(text, BETWEEN), "")


def lowered(word: Column) -> Column:
    """A-Z only; letters beyond ASCII keep their case. Most words need no change, which lower() tells faster."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def phrases(items: DataFrame, width: int = 8, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(terms array, items array): the distinct windows with the items that hold them."""
    w = items.select(F.col(id_col).alias("item"), words(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("terms")).groupBy("terms").agg(F.collect_set("item").alias("items"))


def _maybe_broadcast(df: DataFrame, *columns: str) -> DataFrame:
    """df, broadcast if its rows, with 16 bytes for each and the text of the string columns, are few; df must be cheap to count."""
    kinds = dict(df.dtypes)
    size = F.lit(16)
    for c in columns:
        size = size + (F.coalesce(F.octet_length(c), F.lit(0)) if kinds[c] == "string" else F.lit(8))
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, text_key, pos): the stored postings of all words of all documents."""
    d = id_and_text(docs, id_col, text_col).select("doc_id", F.hash("text").alias("text_key"), words(F.col("text")).alias("w"))
    p = d.select("doc_id", "text_key", F.posexplode("w").alias("pos", "word")).select(lowered(F.col("word")).alias("term"), "doc_id", "text_key", "pos")
    return materialize(p.sortWithinPartitions(F.xxhash64("term")), "postings")


def frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, freq) of the given terms (one column, distinct)."""
    return index.select("term").join(_maybe_broadcast(terms, "term"), "term").groupBy("term").agg(F.count("*").alias("freq"))


def ranked(found: DataFrame, freq: DataFrame) -> DataFrame:
    """(phrase, size, off, term, place): the terms of each phrase that can occur, place 1 the rarest."""
    each = found.select("phrase", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term")).join(freq, "term", "left")
    by = Window.partitionBy("phrase")
    known = each.withColumn("least", F.min(F.coalesce("freq", F.lit(0))).over(by)).where("least > 0")
    return known.select("phrase", "size", "off", "term", F.row_number().over(by.orderBy("freq", "off")).alias("place"))


KEY = ["doc_id", "text_key"]


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def matches(index: DataFrame, terms: DataFrame, slop: int | None = None) -> DataFrame:
    """(doc_id, text_key, start, phrase): places of the phrases, by the ranked terms. start is where the phrase's first word is.

    With a slop the terms need only be within size - 1 + slop places of the rarest one, in any order; start is then counted from
    the rarest one as if it were in its place.
    """
    reach = F.lit(0) if slop is None else F.col("size") - 1 + slop
    lists = materialize(index.join(_maybe_broadcast(terms.where("place <= 2").select("term").distinct(), "term"), "term"), "lists")
    first = lists.join(_maybe_broadcast(terms.where("place = 1"), "term"), "term").select(*KEY, (F.col("pos") - F.col("off")).alias("start"), F.col("pos").alias("at"), "phrase", "size")
    first = first if slop is not None else first.where("start >= 0")
    second = terms.where("place = 2").select("phrase", F.col("off").alias("off2"), F.col("term").alias("term2"))
    asked = first.join(_maybe_broadcast(second, "term2"), "phrase", "left")
    one = asked.where("term2 IS NULL").select(*KEY, "start", "at", "phrase", "size")
    two = asked.where("term2 IS NOT NULL")
    if slop is None:
        two = two.withColumn("want", F.col("start") + F.col("off2"))
        meet = (two["term2"] == lists["term"]) & (two["want"] == lists["pos"])
    else:  # places are dealt into blocks of the largest reach; what is within it stands in the same block or next to it
        widest = max(1, (terms.agg(F.max("size")).first()[0] or 1) - 1 + slop)
        block = F.floor(F.col("at") / widest)
        two = two.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
        lists = lists.withColumn("of", F.floor(F.col("pos") / widest))
        meet = (two["term2"] == lists["term"]) & (two["block"] == lists["of"]) & (F.abs(two["at"] - lists["pos"]) <= reach)
    two = two.join(lists, _same(two, lists) & meet, "left_semi").select(*KEY, "start", "at", "phrase", "size")
    left = materialize(one.union(two).distinct(), "candidates")
    rest = left.join(_maybe_broadcast(terms.where("place > 2").select("phrase", "off", "term"), "term"), "phrase")
    inside = _maybe_broadcast(left.select("doc_id").distinct(), "doc_id")
    terms_left = _maybe_broadcast(terms.where("place > 2").select("term").distinct(), "term")
    other = index.join(terms_left, "term").join(inside, index["doc_id"].eqNullSafe(inside["doc_id"]), "left_semi").select(*[F.col(c).alias(f"p_{c}") for c in ("term", "doc_id", "text_key", "pos")])
    here = F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("text_key") == F.col("p_text_key")) & (F.col("term") == F.col("p_term"))
    if slop is None:
        met = rest.withColumn("want", F.col("start") + F.col("off")).join(other, here & (F.col("want") == F.col("p_pos")), "left_semi")
    else:
        block = F.floor(F.col("at") / widest)
        near = rest.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
        met = near.join(other.withColumn("p_of", F.floor(F.col("p_pos") / widest)), here & (F.col("block") == F.col("p_of")) & (F.abs(F.col("at") - F.col("p_pos")) <= reach), "left_semi").drop("block").distinct()
    whole = met.groupBy(*KEY, "start", "phrase", "size").agg(F.count("*").alias("n")).where("n = size - 2").select(*KEY, "start", "phrase")
    return left.where("size <= 2").select(*KEY, "start", "phrase").union(whole)


def proximity_matches(index: DataFrame, items: DataFrame, slop: int, width: int = 8, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, start, items): places where all terms of a phrase stand near its rarest one, in any order."""
    found, terms = test_phrases(index, items, width, item_col, item_text)
    return matches(index, terms, slop).select("doc_id", "start", "phrase").distinct().join(found.select("phrase", "items"), "phrase").select("doc_id", "start", "items")


def test_phrases(index: DataFrame, items: DataFrame, width: int = 8, item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrase, terms, items) of the benchmark, and the ranked terms of the phrases that can occur."""
    found = materialize(phrases(items, width, item_col, item_text).withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    terms = found.select(F.explode("terms").alias("term")).distinct()
    freq = frequencies(index, materialize(terms, "terms"))
    return found, materialize(ranked(found, freq), "ranked")


def hits(docs: DataFrame, items: DataFrame, width: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, spans array of (start, size), items array) of the documents in which a phrase occurs."""
    index = build_index(docs, id_col, text_col)
    found, terms = test_phrases(index, items, width, item_col, item_text)
    at = matches(index, terms).join(found.select("phrase", F.size("terms").alias("size"), "items"), "phrase")
    return at.groupBy("doc_id").agg(
        F.collect_set(F.struct("start", "size")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """How many places the (start, size) spans cover together."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(so_far: Column, s: Column) -> Column:
        end = F.greatest(so_far["end"], s["start"] + s["size"])
        return F.struct(end.alias("end"), (so_far["n"] + end - F.greatest(so_far["end"], s["start"])).cast("long").alias("n"))

    return F.aggregate(F.array_sort(spans), none, add, lambda x: x["n"])


def contamination(docs: DataFrame, items: DataFrame, width: int = 8, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    d = id_and_text(docs, id_col, text_col)
    found = hits(docs, items, width, id_col, text_col)
    found = found.select("doc_id", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"))
    counts = d.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return counts.join(found.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_items", zero) >= least_items).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 8, least_items: int = 1) -> DataFrame:
    """The documents in which phrases of fewer than `least_items` items occur; all columns are kept."""
    bad = materialize(hits(docs, items, width).where(F.size("items") >= least_items).select("doc_id"), "contaminated")
    bad = _maybe_broadcast(bad, "doc_id")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")


ORACLE_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark
), bp AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM bw WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 7], ' ') AS p, least(len(w), 8) AS size FROM bp
), sizes AS (SELECT DISTINCT size FROM win
), dp AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size
), found AS (
  SELECT doc_id, i, dp.size AS size, item_id FROM dp JOIN win ON dp.size = win.size AND array_to_string(w[i : i + dp.size - 1], ' ') = p
), places AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id)
"""
