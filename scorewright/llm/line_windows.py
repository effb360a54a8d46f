"""Line dedup by overlapping three-line windows, in DataFrame functions alone.

Every three consecutive lines that are not blank make a window. Windows are grouped by a 128-bit hash over the whole
table; all occurrences but the first, in order of (doc_id, text hash, position), are later ones. The lines that later
occurrences cover are merged and removed. A line is only removed where an equal one stays earlier.

Defined cases: a null text stays null, a text of fewer than three lines with words has no window and stays as it
is; blank lines stay. Null ids come first in the order. Rows equal in id and text are one document and get one result.
Other columns pass through unchanged, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorewright.llm.common import whole_text
from scorewright.session import materialise

LINES = 3


def _windows(docs: DataFrame, lines: int) -> DataFrame:
    """doc_id, text_key, at (number of the first line among those that are not blank), h1, h2."""
    worded = docs.select(F.col("doc_id"), F.xxhash64(whole_text()).alias("text_key"),
                         F.expr("filter(split(coalesce(text, ''), '\\n'), l -> l rlike '[^ \\t\\r]')").alias("lines_"))
    of = ", ".join(f"get(lines_, i + {k})" for k in range(lines))
    hashed = F.expr(f"transform(sequence(0, size(lines_) - {lines}), i -> struct(xxhash64({of}) as h1, xxhash64(1, {of}) as h2))")
    return (worded.where(F.size("lines_") >= lines)
            .select("doc_id", "text_key", F.posexplode(hashed).alias("at", "w"))
            .select("doc_id", "text_key", "at", "w.h1", "w.h2"))


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``docs`` with the text shortened, and ``n_lines`` (not blank, before) and ``n_removed`` added as ``dedup_``."""
    windows = materialise(_windows(docs, lines), "line-windows")
    place = F.struct("doc_id", "text_key", "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_key", "at")
    covered = (later.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("starts"))
               .select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"),
                       F.expr(f"array_distinct(flatten(transform(starts, s -> sequence(s, s + {lines - 1}))))").alias("covered")))
    rows = docs.select(F.struct("*").alias("row_"), F.xxhash64(whole_text()).alias("text_key"))
    met = rows.join(covered.hint("shuffle_hash"), F.col("row_.doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")), "left")
    split = met.select("row_", "covered", F.split(F.col("row_.text"), "\n").alias("all_"))
    worded = split.select("row_", "covered", "all_", F.expr(
        "filter(sequence(0, size(all_) - 1), i -> get(all_, i) rlike '[^ \\t\\r]')").alias("worded_"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(all_) - 1), transform(covered, c -> get(worded_, c))), "
                  "i -> get(all_, i)), '\\n')")
    text = F.when(F.col("covered").isNull(), F.col("row_.text")).otherwise(kept)
    return worded.select(
        F.col("row_").withField("text", text).alias("row_"),
        F.struct(F.coalesce(F.size("worded_"), F.lit(0)).cast("long").alias("n_lines"),
                 F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed")).alias("dedup_"))


def flat(deduped: DataFrame) -> DataFrame:
    """The document columns alone."""
    return deduped.select("row_.*")


ORACLE = r"""
with split as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
numbered as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from split),
worded as (select *, row_number() over (partition by doc_id order by i) - 1 as k from numbered where regexp_matches(line, '[^ \t\r]')),
windows as (select doc_id, k, line as a, lead(line) over w as b, lead(line, 2) over w as c from worded window w as (partition by doc_id order by k)),
ranked as (select *, row_number() over (partition by a, b, c order by doc_id, k) as nth from windows where c is not null),
covered as (select distinct doc_id, k + unnest([0, 1, 2]) as k from ranked where nth > 1),
kept as (select n.doc_id, string_agg(n.line, chr(10) order by n.i) as text, count(w.k) as n_lines
  from numbered n left join worded w on n.doc_id = w.doc_id and n.i = w.i
  where not exists (select 1 from covered c where c.doc_id = w.doc_id and c.k = w.k) group by n.doc_id)
select d.doc_id, coalesce(k.text, '') as text,
  coalesce((select count(*) from worded w where w.doc_id = d.doc_id), 0)::bigint as n_lines,
  coalesce((select count(*) from covered c where c.doc_id = d.doc_id), 0)::bigint as n_removed
from documents d left join kept k on d.doc_id = k.doc_id
"""
