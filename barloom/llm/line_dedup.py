"""Line dedup by content-defined line chunks (operator 7), in DataFrame functions only.

A text's lines get small hashes; a rolling polynomial over the last ``SPAN`` line hashes closes a chunk where it is divisible by
``DIVISOR``. Boundaries depend on nearby lines only, so insertions elsewhere do not shift them. Of equal chunks of at least
``LEAST_LINES`` lines anywhere in the corpus, the first (smallest id, then position) stays; the others are removed after
their bytes have been compared with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage

#: Lines under the rolling hash, its multiplier and modulus, the divisor (expected lines of a chunk), lines of a chunk that may be removed.
SPAN, FACTOR, MODULUS, DIVISOR, LEAST_LINES = 2, 31, 1_000_003, 4, 2


def line_hash(line: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long"), F.lit(MODULUS))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once a row. A plain projection would be folded into the
    functions above it and computed again for every array element."""
    return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def with_chunks(rows: DataFrame) -> DataFrame:
    """rows(..., text) with ``chunks``: array of (at, lines, body)."""
    names = rows.columns
    cut = once(rows, "lines", F.split("text", "\n", -1))
    cut = once(cut, "hashes", F.transform("lines", line_hash))
    rolled = F.transform("hashes", lambda h, i: sum((F.coalesce(F.get("hashes", i - k), F.lit(0)) * FACTOR**k for k in range(1, SPAN)), h))
    cut = once(cut, "rolled", rolled)
    closes = F.transform("rolled", lambda r, i: F.when((F.pmod(r, F.lit(DIVISOR)) == 0) | (i == F.size("rolled") - 1), i + 1))
    cut = once(cut, "ends", F.array_compact(closes))
    starts = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1))
    cut = once(cut, "ranges", F.zip_with(starts, "ends", lambda at, end: F.struct(at.alias("at"), (end - at).alias("n"))))
    body = lambda c: F.array_join(F.slice("lines", c["at"] + 1, c["n"]), "\n")
    chunks = F.transform("ranges", lambda c: F.struct(c["at"].alias("at"), c["n"].alias("lines"), body(c).alias("body")))
    return once(cut, "chunks", chunks).select(*names, "chunks")


def repeated_chunks(docs: DataFrame, id_col="doc_id", text_col="text", stage: Stage | None = None) -> DataFrame:
    """(id, n_lines, n_removed, kept): each text without the chunks that an earlier equal chunk replaces.

    Null text counts as empty (one empty line); a null id sorts after all others. A row is known by its id and the MD5 of its text, so rows with one id, or none,
    and different texts are told apart (ties of ids go by that digest); rows repeated with one id and one text are told
    apart by nothing, so their chunks count as one occurrence. An empty table gives no rows. Chunks of blank lines only are text like any other.
    Other columns are not read. A chunk that very many texts share makes one large key in two joins with a row a key on the other
    side; Spark's adaptive skew handling splits these, and the counts before them are summed map-side.
    """
    stage = stage or Stage(docs.sparkSession, "lines")
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("mark"))
    keyed = with_chunks(rows).select("id", "mark", F.explode("chunks").alias("c")).filter(F.col("c.lines") >= LEAST_LINES)
    keyed = stage.table(keyed.select("id", "mark", F.col("c.at").alias("at"), F.unhex(F.md5("c.body")).alias("key")), "keys")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "at")).alias("first")
    seen = keyed.groupBy("key").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    seen = stage.table(seen, "repeated")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")) & (F.col("at") == F.col("first.at"))
    found = keyed.join(seen, "key").select("id", "mark", "at", "key", is_first.alias("own"))
    marks = found.groupBy("id", "mark").agg(F.map_from_entries(F.collect_set(F.struct("at", F.struct("key", "own")))).alias("marks")).toDF("m_id", "m_mark", "marks")
    same_row = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("mark") == F.col("m_mark"))
    marked = stage.table(rows.join(marks, same_row, "left").drop("m_id", "m_mark"), "texts")
    plain = marked.filter("marks is null").select("id", F.size(F.split("text", "\n", -1)).alias("n_lines"), F.lit(0).alias("n_removed"), F.col("text").alias("kept"))
    some = stage.table(with_chunks(marked.filter("marks is not null")).select("id", "mark", "chunks", "marks"), "chunks")
    # the bytes of every repeated chunk against those of its first occurrence
    bodies = some.select("id", "mark", "marks", F.explode("chunks").alias("c")).withColumn("m", F.try_element_at("marks", F.col("c.at"))).filter("m is not null")
    bodies = bodies.select("id", "mark", F.col("c.at").alias("at"), F.col("m.key").alias("key"), F.col("m.own").alias("own"), F.col("c.body").alias("body"))
    bodies = stage.table(bodies, "bodies")
    firsts = bodies.filter("own").select("key", F.col("body").alias("first_body")).dropDuplicates(["key"])
    firsts = stage.table(firsts, "firsts")
    gone = bodies.filter("not own").join(firsts, "key").filter("body = first_body")
    gone = stage.table(gone.groupBy("id", "mark").agg(F.collect_set("at").alias("gone")).toDF("m_id", "m_mark", "gone"), "gone")
    out = some.join(gone, same_row, "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.filter("chunks", lambda c: ~F.array_contains("gone", c["at"]))
    count = lambda a: F.aggregate(a, F.lit(0), lambda n, c: n + c["lines"])
    out = out.select("id", count("chunks").alias("n_lines"), (count("chunks") - count(kept)).alias("n_removed"), F.array_join(F.transform(kept, lambda c: c["body"]), "\n").alias("kept"))
    return plain.unionByName(out)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeated_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM cut),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT % {MODULUS} AS h FROM line),
rolled AS (SELECT *, (h + {FACTOR} * coalesce(lag(h) OVER d, 0)) % {DIVISOR} = 0 AS closes FROM hashed WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM rolled),
chunk AS (SELECT doc_id, c, min(i) AS pos, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, c),
judged AS (SELECT *, n >= {LEAST_LINES} AND row_number() OVER (PARTITION BY body, n >= {LEAST_LINES} ORDER BY doc_id, pos) > 1 AS gone FROM chunk)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
