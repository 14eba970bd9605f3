"""Line-level deduplication with a suffix array over line-ID sequences, DataFrame functions only.

A document is the sequence of its non-blank lines, trimmed.  Every run of lines of at least
``min_words`` words that occurs more than once in the corpus is kept where it stands first (by
doc_id, then place) and deleted where it stands again.

1. Lines are counted by a 128-bit hash with a pre-aggregated count; a line that occurs once ends
   every repeated run, so only repeated lines go on, each with an ID.
2. Prefix doubling: the rank of a suffix by its first ``2h`` lines is the place, among the sorted
   distinct pairs, of its rank by ``h`` lines and the rank of the suffix ``h`` lines on.  Suffixes
   whose pair is unique are settled and leave.  The array is needed as deep as runs of ``min_words``
   words are long, so there are at most log2(min_words) rounds.
3. Suffixes whose common prefix reaches ``min_words`` words form an interval of the array.  Prefixes
   are compared by two overlapping power-of-two ranks.  The prefixes that just reach ``min_words``
   words forwards from each line and backwards from each line together cover exactly the maximal
   repeated runs.  The earliest member of an interval stays; the lines of the others go.

Groups are only ever counted or reduced to their least member, before the shuffle, so a line that
stands in a third of all documents gathers nowhere.  Only tables whose row count has been checked
are broadcast; beyond the bound the same join is shuffled.

Extra columns are kept, whatever their names.  A null text has no lines and stays null; rows that agree in doc_id and text are one document and get
the same result; rows without doc_id come before others.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, join_checked, materialize

MIN_WORDS = 40
BLANKS = " \t\r\f\x0b"
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["doc_id", "th"]


def _lines(docs: DataFrame) -> DataFrame:
    """Non-blank lines: document, place among them, place among all lines, words and hash."""
    split = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("p"), F.btrim(line, F.lit(BLANKS)).alias("line")))
    full = F.filter(split, lambda x: x["line"] != "")
    rows = docs.select(*KEY, F.posexplode(full).alias("pos", "x"))
    line = F.col("x.line")
    words = F.size(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))
    return rows.select(*KEY, "pos", F.col("x.p").alias("p"), words.alias("w"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def _windows(found: DataFrame, min_words: int) -> DataFrame:
    """Shortest runs of repeated lines with ``min_words`` words that start or end at each line."""
    segment = F.col("pos") - F.row_number().over(Window.partitionBy("d").orderBy("pos"))
    rows = found.select("d", "pos", "w", segment.alias("seg"))
    by = Window.partitionBy("d", "seg")
    rows = rows.withColumn("upto", F.sum("w").over(by.orderBy("pos"))).withColumn("before", F.col("upto") - F.col("w"))
    rows = rows.withColumn("all", F.sum("w").over(by)).withColumn("low", F.min("pos").over(by)).withColumn("high", F.max("pos").over(by))
    reach = Window.unboundedPreceding, -min_words
    after = F.min("pos").over(by.orderBy(F.desc("before")).rangeBetween(*reach))  # first line that the run needs no more
    last = F.max("pos").over(by.orderBy("upto").rangeBetween(*reach))  # last line before the run
    rows = rows.withColumn("end", F.coalesce(after - 1, "high")).withColumn("start", F.coalesce(last + 1, "low"))
    forwards = rows.where(F.col("all") - F.col("before") >= min_words).select("d", F.col("pos").alias("s"), (F.col("end") - F.col("pos") + 1).alias("len"))
    backwards = rows.where(F.col("upto") >= min_words).select("d", F.col("start").alias("s"), (F.col("pos") - F.col("start") + 1).alias("len"))
    return forwards.union(backwards).distinct().select("d", "s", F.col("len").cast("int").alias("len"))


def _later(runs: DataFrame, ranks: DataFrame, h: int) -> DataFrame:
    """Runs of ``h`` to ``2h - 1`` lines that stand somewhere before: the members of each interval
    but the earliest."""
    here = runs.where(F.col("len").between(h, 2 * h - 1))
    if h == 1:
        keyed = here.join(ranks.select("d", F.col("pos").alias("s"), F.col("r").alias("a")), ["d", "s"]).withColumn("b", F.col("a"))
    else:
        first = ranks.select("d", F.col("pos").alias("s"), F.col("r").alias("a"))
        second = ranks.select("d", F.col("pos").alias("t"), F.col("r").alias("b"))
        keyed = here.join(first, ["d", "s"]).withColumn("t", F.col("s") + F.col("len") - h).join(second, ["d", "t"])
    place = F.struct("d", "s")
    # Written before it is joined, so that a class with very many members can be split.
    least = materialize(keyed.groupBy("a", "b", "len").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "intervals")
    return join_checked(keyed, least, ["a", "b", "len"]).where(place > F.col("first")).select("d", "s", "len")


def _doubled(ranks: DataFrame, h: int) -> DataFrame | None:
    """Ranks by ``2h`` lines from ranks by ``h`` lines; None if all suffixes are settled."""
    onward = Window.partitionBy("d").orderBy("pos").rangeBetween(h, h)
    pairs = ranks.select("d", "pos", F.col("r").alias("a"), F.max("r").over(onward).alias("b")).where("b is not null")
    classes = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").orderBy("a", "b")
    ranked = materialize(classes.select("a", "b", F.monotonically_increasing_id().alias("r")), "classes")  # in the order of the pairs
    if ranked.isEmpty():
        return None
    out = materialize(join_checked(pairs, ranked, ["a", "b"]).select("d", "pos", "r"), "ranks")
    discard(ranked)
    return out


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, th, drop``: the places of the lines to delete, of documents that have any.
    ``docs`` has ``doc_id``, ``text`` and ``th``, a hash of the text."""
    lines = _lines(docs)
    counted = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    ids = materialize(counted.select("h1", "h2", F.monotonically_increasing_id().alias("r")), "line-ids")
    found = materialize(join_checked(lines, ids, ["h1", "h2"]).select(*KEY, "pos", "p", "w", "r"), "found")
    # Documents get numbers in their order, so that places compare quickly.
    order = found.select(*KEY).distinct().orderBy(F.asc_nulls_first("doc_id"), "th")
    order = materialize(order.select(*KEY, F.monotonically_increasing_id().alias("d")), "order")
    same = found["doc_id"].eqNullSafe(order["doc_id"]) & (found["th"] == order["th"])
    ranks = materialize(found.join(order, same).select("d", "pos", "p", "w", "r").distinct(), "ranks")
    discard(found)

    runs = materialize(_windows(ranks, min_words), "runs")
    longest = runs.agg(F.max("len")).first()[0] or 0
    level, h, later = ranks, 1, []
    while h <= longest:
        later.append(materialize(_later(runs, level, h), "later"))
        deeper = _doubled(level, h) if 2 * h <= longest else None
        if level is not ranks:
            discard(level)
        if deeper is None:
            break
        level, h = deeper, 2 * h
    if not later:
        return docs.sparkSession.createDataFrame([], "doc_id long, th long, drop array<int>")
    spans = later[0]
    for more in later[1:]:
        spans = spans.union(more)
    places = spans.select("d", F.explode(F.sequence("s", F.col("s") + F.col("len") - 1)).alias("pos")).distinct()
    gone = places.join(ranks.select("d", "pos", "p"), ["d", "pos"]).groupBy("d").agg(F.sort_array(F.collect_list("p")).alias("drop"))
    return materialize(gone.join(order, "d").select(*KEY, "drop"), "drop")


def dedup_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", deleted_col: str = "n_deleted"
) -> DataFrame:
    """All columns of ``docs`` with the repeated lines taken out of the text, and ``n_lines`` and
    ``n_deleted``, the non-blank lines it had and lost, which replace columns of these names."""
    key = {"doc_id": F.col(f"`{id_col}`").cast("long"), "text": F.col(f"`{text_col}`").cast("string")}
    slim = docs.select(*[c.alias(k) for k, c in key.items()]).withColumn("th", F.xxhash64("text")).where("text is not null")
    i, h, gone = fresh(docs, "drop_id", "drop_th", "drop")
    drop = repeated_lines(slim, min_words).select(F.col("doc_id").alias(i), F.col("th").alias(h), F.col("drop").alias(gone))
    on = key["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(key["text"]) == F.col(h))
    joined = join_checked(docs, drop, on, "left")
    parts = F.split(key["text"], "\n")
    lost = F.coalesce(F.greatest(F.size(gone), F.lit(0)), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone), lambda i: F.get(parts, i))
    text = F.when(F.col(gone).isNull(), key["text"]).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(BLANKS)) != "")), F.lit(0))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in (lines_col, deleted_col)]
    return joined.select(*columns, n_lines.cast("long").alias(lines_col), lost.cast("long").alias(deleted_col))


#: The same in SQL for ``documents``, where doc_id has no repeats: all runs that just reach the
#: number of words, forwards and backwards, by their text.
ORACLE_SQL = f"""
with raw as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as p from documents
), lines as (
  select doc_id, p, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) as line,
    row_number() over (partition by doc_id order by p) as pos from raw where trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> ''
), sums as (
  select *, sum(w) over (partition by doc_id order by pos) as upto from (select *, len(regexp_extract_all(line, '{WORD}')) as w from lines)
), starts as (
  select a.doc_id, a.pos as s, min(b.pos) as e from sums a join sums b on a.doc_id = b.doc_id and b.pos >= a.pos and b.upto - a.upto + a.w >= {MIN_WORDS}
  group by a.doc_id, a.pos
), ends as (
  select b.doc_id, max(a.pos) as s, b.pos as e from sums a join sums b on a.doc_id = b.doc_id and b.pos >= a.pos and b.upto - a.upto + a.w >= {MIN_WORDS}
  group by b.doc_id, b.pos
), runs as (
  select * from starts union select * from ends
), texts as (
  select r.doc_id, r.s, r.e, string_agg(l.line, chr(10) order by l.pos) as body
  from runs r join lines l on l.doc_id = r.doc_id and l.pos between r.s and r.e group by r.doc_id, r.s, r.e
), ranked as (
  select *, row_number() over (partition by body order by doc_id, s) as k from texts
), gone as (
  select distinct r.doc_id, l.p from ranked r join lines l on l.doc_id = r.doc_id and l.pos between r.s and r.e where k > 1
), kept as (
  select doc_id, string_agg(line, chr(10) order by p) as text from raw anti join gone using (doc_id, p) group by doc_id
), counts as (
  select doc_id, count(*) as n_lines from lines group by doc_id
), lost as (
  select doc_id, count(*) as n_deleted from gone group by doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
  cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_deleted, 0) as bigint) as n_deleted
from documents d left join kept k using (doc_id) left join counts using (doc_id) left join lost using (doc_id)
"""
