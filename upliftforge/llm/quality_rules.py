"""Quality rules with cross-document line frequency.

Each text is read once for its own statistics and the hashes of its normalised lines (ASCII lower
case, white space runs as one space).  Lines that more documents of a host hold than its limit are
boilerplate and count as removed; a document that keeps too small a share of its words is depleted
and rejected, as is one that fails the rules on its own text.

The limit of a host is ``max(min_docs, share * documents of the host)``.  Counting is pre-aggregated,
so neither a hot host nor a hot line gathers in one task.  A document's id is counted once however
often its row repeats; rows without an id count each.  Null texts have no words, null hosts are one
host, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh, join_checked, materialize, release

#: The six ASCII white space characters and the symbols that are counted.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
MIN_DOCS = 10
SHARE = 0.002
LEAST_KEPT = 0.5

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list) -> int:
    """Words that stand in some three-word window which the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0
    for k, window in enumerate(windows):
        if counts[window] > 1:
            total += k + 3 - max(k, covered)
            covered = k + 3
    return total


def describe(text: str | None) -> tuple[tuple[int, ...], list[tuple[int, int, int]]]:
    """Statistics of a whole text, and hash, words and place of each line that has a word."""
    import xxhash

    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines, seen, duplicates = [], set(), 0
    for place, line in enumerate(raw.split(b"\n")):
        parts = line.lower().split()
        if parts:
            duplicates += line in seen
            seen.add(line)
            value = xxhash.xxh64_intdigest(b" ".join(parts))
            lines.append((value - (value >> 63 << 64), len(parts), place))
    stats = (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        duplicates,
        repeated_words(words),
    )
    return stats, lines


def _describe_batches(batches):
    line_type = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32()), ("p", pa.int32())]))
    for batch in batches:
        found = [describe(t) for t in batch.column(4).to_pylist()]
        lines = pa.array([[{"h": h, "w": w, "p": p} for h, w, p in x[1]] for x in found], line_type)
        stats = [pa.array([x[0][k] for x in found], pa.int64()) for k in range(len(STATS))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *stats, lines], names=["uid", "doc_id", "th", "host", *STATS, "lines"])
    release()


def _removals(docs: DataFrame, min_docs: int, share: float, least_kept: float, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """``uid, doc_id, th``, the statistics, the verdicts, ``removed_words`` and the places ``drop`` of
    the removed lines, of every row."""
    bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"),
    )
    schema = "uid long, doc_id long, th long, host string, " + ", ".join(f"{s} long" for s in STATS) + ", lines array<struct<h: long, w: int, p: int>>"
    known = materialize(rows.mapInArrow(_describe_batches, schema), "lines")

    identity = F.coalesce("doc_id", -1 - F.col("uid"))
    hashes = known.select("host", identity.alias("d"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    spread = hashes.groupBy("host", "h").agg(F.count_distinct("d").alias("n")).where(F.col("n") > min_docs)
    hosts = materialize(known.select("host", identity.alias("d")).groupBy("host").agg((F.count_distinct("d") * F.lit(share)).alias("most")), "hosts")
    frequent = materialize(join_checked(spread, hosts, "host").where(F.col("n") > F.col("most")).select("host", "h"), "frequent")

    each = known.select("uid", "host", F.inline("lines"))
    removed = each.join(frequent, ["host", "h"]).groupBy("uid").agg(F.sum("w").alias("removed_words"), F.collect_list("p").alias("drop"))  # the lines of one row
    out = known.drop("lines", "host").join(removed, "uid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("removed_words")) < F.lit(least_kept) * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def score_documents(
    docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, least_kept: float = LEAST_KEPT,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``kept`` and ``removed_words`` of every row."""
    found = _removals(docs, min_docs, share, least_kept, id_col, text_col, host_col)
    return found.select("doc_id", *STATS, "base_failed", "kept", "removed_words")


def clean_documents(
    docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, least_kept: float = LEAST_KEPT,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` that are kept, without their frequent lines; rows that agree in id, text
    and host get the same result."""
    found = _removals(docs, min_docs, share, least_kept, id_col, text_col, host_col)
    i, h, k, gone = fresh(docs, "id", "th", "kept", "drop")
    changed = found.where("not kept or drop is not null").groupBy("doc_id", "th").agg(F.bool_and("kept").alias(k), F.first("drop").alias(gone))
    changed = materialize(changed.select(F.col("doc_id").alias(i), F.col("th").alias(h), k, gone), "changed")
    text = F.col(f"`{text_col}`").cast("string")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h))
    rows = join_checked(docs, changed, same, "left").where(F.col(k).isNull() | F.col(k))
    parts = F.split(text, "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone), lambda i: F.get(parts, i))
    cleaned = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(left, "\n"))
    return rows.select(*[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


#: The same in SQL, for ``documents`` with the columns doc_id, source and text.
ORACLE_SQL = f"""
with d as (
  select row_number() over () as uid, doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents
), w as (
  select uid, doc_id, host, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws from d
), stats as (
  select uid, doc_id, host, cast(len(ws) as bigint) as n_words,
    cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols
  from w
), lines as (
  select uid, doc_id, host, unnest(string_split(text, chr(10))) as line from d
), full_lines as (
  select uid, doc_id, host, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as nw,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') as form
  from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), dup as (
  select uid, sum(n - 1) as n_dup_lines from (select uid, line, count(*) as n from full_lines group by uid, line) group by uid
), wins as (
  select uid, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) > 2
), named as (
  select uid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as win from wins
), repeated as (
  select uid, i from (select uid, i, count(*) over (partition by uid, win) as n from named) where n > 1
), rep as (
  select uid, count(distinct p) as n_repeat_words from (select uid, unnest([i, i + 1, i + 2]) as p from repeated) group by uid
), spread as (
  select host, form, count(distinct coalesce(doc_id, -uid)) as n from full_lines group by host, form
), hosts as (
  select host, count(distinct coalesce(doc_id, -uid)) * {SHARE} as most from d group by host
), frequent as (
  select host, form from spread join hosts using (host) where n > {MIN_DOCS} and n > most
), removed as (
  select uid, sum(nw) as removed_words from full_lines join frequent using (host, form) group by uid
), joined as (
  select doc_id, n_words, word_chars, n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(coalesce(removed_words, 0) as bigint) as removed_words
  from stats left join dup using (uid) left join rep using (uid) left join removed using (uid)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) and not (n_words - removed_words < {LEAST_KEPT} * n_words) as kept,
  removed_words
from joined
"""
