"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

Every line is hashed; a rolling hash over the last ``len(MULTIPLIERS)`` line hashes closes a chunk
where it is divisible by ``DIVISOR``. Boundaries depend on the lines around them alone, so a passage
put in at another place is cut the same way after its first lines. A boundary right after another one is passed over, so that a
chunk closes from its second line on; a last line left alone takes the line before it in again. Chunks of several lines that
occur more than once anywhere are compared byte for byte with their first occurrence (smallest doc_id, null
last, then chunk number) and removed from all other places.

Only (id, chunk, digest) rows are grouped globally, reduced before the shuffle. Texts are moved by doc_id,
and those of repeated chunks by digest; the large side of a hot digest is split by the adaptive join.

Edge cases: null text is empty: one empty line, no chunk of several lines. Rows that share a doc_id (or have none) are one
document in several rows: what is removed is looked up by chunk number and digest, so rows with equal text lose the same lines
and keep equal chunks at equal places. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campuspulse.llm.common import ids_and_text, table, written

MULTIPLIERS = (1, 131)
DIVISOR = 3
MIN_LINES = 2


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def with_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lines)"""
    return ids_and_text(docs).select("doc_id", F.split("text", "\n", -1).alias("lines"))


def _boundary(hashes: Column, i: Column) -> Column:
    """Whether a chunk ends with line ``i`` (from 0)."""
    rolling = sum((F.when(i >= j, F.get(hashes, i - j)).otherwise(F.lit(0)) * F.lit(m) for j, m in enumerate(MULTIPLIERS)), F.lit(0))
    return (rolling % DIVISOR == 0) | (i == F.size(hashes) - 1)


def _ends(joined: bool) -> Column:
    """The lines (from 0) that end a chunk; ``joined`` closes chunks from their second line on."""
    every = F.sequence(F.lit(0), F.size("hashes") - 1)
    if not joined:
        return F.filter(every, lambda i: _boundary(F.col("hashes"), i))
    # One mark per line behind one for the start; of neighbouring marks every second one goes, from the left.
    marks = F.array_join(F.transform(every, lambda i: F.when(_boundary(F.col("hashes"), i), "1").otherwise("0")), "")
    kept = F.split(F.regexp_replace(F.concat(F.lit("1"), marks), "11", "10"), "")
    return F.filter(every, lambda i: (F.get(kept, i + 1) == "1") | (i == F.size("hashes") - 1))


def with_chunks(lined: DataFrame, joined: bool = True) -> DataFrame:
    """(doc_id, lines, chunks: array of first line, number of lines), all chunks of a document in order."""
    hashed = lined.withColumn("hashes", F.transform("lines", _line_hash))
    ends = hashed.withColumn("ends", _ends(joined))

    def chunk(end, k):
        start = F.when(k > 0, F.get(F.col("ends"), k - 1) + 1).otherwise(F.lit(0))
        if joined:
            start = F.when((start == end) & (end > 0), end - 1).otherwise(start)
        return F.struct(start.alias("start"), (end - start + 1).alias("n_lines"))

    return ends.select("doc_id", "lines", F.transform("ends", chunk).alias("chunks"))


def _text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["start"] + 1, chunk["n_lines"]), "\n")


def _keyed(chunked: DataFrame) -> DataFrame:
    """Chunks of several lines with number, place and digest."""
    numbered = F.transform("chunks", lambda c, k: F.struct(k.alias("chunk"), c["start"].alias("start"), c["n_lines"].alias("n_lines")))
    several = F.filter(numbered, lambda c: c["n_lines"] >= MIN_LINES)
    return chunked.select("doc_id", "lines", F.transform(several, lambda c: F.struct(
        c["chunk"].alias("chunk"), c["start"].alias("start"), c["n_lines"].alias("n_lines"),
        F.unhex(F.md5(_text(F.col("lines"), c))).alias("digest"))).alias("chunks"))


def chunk_rows(docs: DataFrame, joined: bool = True) -> DataFrame:
    """(doc_id, chunk, start, n_lines, digest) of every chunk of several lines."""
    # An inner explode lets the optimizer add a filter that repeats the whole derivation per element; the outer one does not.
    keyed = _keyed(with_chunks(with_lines(docs), joined)).select("doc_id", F.explode_outer("chunks").alias("c"))
    return keyed.where("c is not null").select("doc_id", "c.*")


def removals(docs: DataFrame, joined: bool = True) -> DataFrame:
    """(doc_id, chunk, start, n_lines, digest) of the chunks to remove, each equal in bytes to an earlier one."""
    rows = written(chunk_rows(docs, joined), "line-chunks")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "chunk")
    firsts = rows.groupBy("digest").agg(F.min(F.struct(place.alias("place"), "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # A last chunk that shares a line with the first place is no second place.
    shares = F.col("doc_id").eqNullSafe(F.col("first.place.doc_id")) & (F.col("start") < F.col("first.start") + F.col("n_lines")) & (F.col("chunk") > F.col("first.place.chunk"))
    repeated = rows.join(firsts, "digest").where(~shares).withColumn("is_first", place == F.col("first.place")).drop("first")
    by_doc = repeated.groupBy("doc_id").agg(
        F.collect_set(F.struct("chunk", "start", "n_lines", "digest", "is_first")).alias("chunks")).withColumnRenamed("doc_id", "id")
    texts = with_lines(docs).join(by_doc, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "lines", F.explode("chunks").alias("c"))
    texts = texts.select("doc_id", "c.*", _text(F.col("lines"), F.col("c")).alias("bytes"))
    # Rows that share an id may differ: a chunk counts where its text has its digest.
    texts = texts.where(F.unhex(F.md5("bytes")) == F.col("digest"))
    original = texts.where("is_first").groupBy("digest").agg(F.min("bytes").alias("original"))
    same = texts.where("not is_first").join(original, "digest").where(F.col("bytes") == F.col("original"))
    return same.select("doc_id", "chunk", "start", "n_lines", "digest")


def line_dedup(docs: DataFrame, joined: bool = True) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_chunks (removed), text (what is left)."""
    # Unwritten, so that both joins read one exchange of the texts.
    gone = removals(docs, joined).groupBy("doc_id").agg(
        F.collect_set(F.struct("chunk", "start", "n_lines", "digest")).alias("gone")).withColumnRenamed("doc_id", "id")
    texts = with_lines(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    mine = F.filter(F.coalesce("gone", F.array().cast("array<struct<chunk:int,start:int,n_lines:int,digest:binary>>")),
                    lambda c: F.unhex(F.md5(_text(F.col("lines"), c))) == c["digest"])
    marked = texts.select("doc_id", "lines", mine.alias("gone"))
    left = F.filter("lines", lambda _, i: ~F.exists("gone", lambda c: (i >= c["start"]) & (i < c["start"] + c["n_lines"])))
    kept = marked.withColumn("kept", F.when(F.size("gone") == 0, F.col("lines")).otherwise(left))
    # Counted by line: the last two chunks may share one.
    return kept.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
                       F.size("gone").cast("long").alias("n_chunks"), F.array_join("kept", "\n").alias("text"))


# --- registered query ----------------------------------------------------------


def op7_line_dedup(spark, sf_dir):
    """The operator's own rule: chunks close from their second line on."""
    return line_dedup(table(spark, sf_dir, "documents"))


def op7_line_dedup_single(spark, sf_dir):
    """Where a chunk may close after one line."""
    return line_dedup(table(spark, sf_dir, "documents"), joined=False)


QUERIES = {"op7_line_dedup": op7_line_dedup, "op7_line_dedup_single": op7_line_dedup_single}
ORACLES = {"op7_line_dedup_single": f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS n FROM d),
    hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM lines),
    cut AS (SELECT *, (h * {MULTIPLIERS[0]} + coalesce(lag(h) OVER w, 0) * {MULTIPLIERS[1]}) % {DIVISOR} = 0 OR i = n - 1 AS last
            FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    numbered AS (SELECT *, coalesce(sum(CAST(last AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cut),
    chunks AS (SELECT doc_id, k, min(i) AS i, count(*) AS m, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, k),
    judged AS (SELECT *, m >= {MIN_LINES} AND row_number() OVER (PARTITION BY m >= {MIN_LINES}, body ORDER BY doc_id, k) > 1 AS gone FROM chunks)
    SELECT doc_id, CAST(sum(m) AS BIGINT) AS n_lines, CAST(coalesce(sum(m) FILTER (gone), 0) AS BIGINT) AS n_removed,
           count(*) FILTER (gone) AS n_chunks, coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text
    FROM judged GROUP BY doc_id""", "op7_line_dedup": f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS n FROM d),
    hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM lines),
    raw AS (SELECT *, (h * {MULTIPLIERS[0]} + coalesce(lag(h) OVER w, 0) * {MULTIPLIERS[1]}) % {DIVISOR} = 0 AS mark
            FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    -- Of a row of neighbouring marks, the one at the start of the document (-1) included, the first, third, ... count.
    since AS (SELECT *, i - coalesce(max(i) FILTER (NOT mark) OVER (PARTITION BY doc_id ORDER BY i), -2) AS nth FROM raw),
    cut AS (SELECT *, mark AND nth % 2 = 1 OR i = n - 1 AS last FROM since),
    numbered AS (SELECT *, coalesce(sum(CAST(last AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cut),
    chunks AS (SELECT doc_id, k, max(i) AS j, CASE WHEN min(i) = max(i) THEN greatest(max(i) - 1, 0) ELSE min(i) END AS i FROM numbered GROUP BY doc_id, k),
    bodies AS (SELECT doc_id, k, i, j, j - i + 1 AS m, array_to_string(l[i + 1 : j + 1], chr(10)) AS body FROM chunks JOIN d USING (doc_id)),
    judged AS (SELECT *, m >= {MIN_LINES} AND row_number() OVER w > 1 AND NOT (doc_id = first_value(doc_id) OVER w AND i < first_value(j) OVER w + 1) AS gone
               FROM bodies WINDOW w AS (PARTITION BY m >= {MIN_LINES}, body ORDER BY doc_id, k)),
    lost AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM judged WHERE gone),
    counts AS (SELECT doc_id, count(*) FILTER (gone) AS n_chunks FROM judged GROUP BY doc_id)
    SELECT lines.doc_id, count(*) AS n_lines, count(lost.i) AS n_removed, any_value(n_chunks) AS n_chunks,
           coalesce(string_agg(line, chr(10) ORDER BY lines.i) FILTER (lost.i IS NULL), '') AS text
    FROM lines JOIN counts USING (doc_id) LEFT JOIN lost ON lost.doc_id = lines.doc_id AND lost.i = lines.i GROUP BY lines.doc_id"""}
