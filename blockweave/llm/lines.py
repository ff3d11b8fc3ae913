"""Line dedup by content-defined chunks, in DataFrame functions only.

Each line of a text has a hash, each pair of neighbouring lines a rolling hash. A boundary lies after a line whose rolling
hash is a local minimum; it depends on four lines around it alone, so an inserted line moves few boundaries. Chunks have
at least two lines, unless the text has one only. A multi-line chunk whose hash is met more than once is compared byte by
byte with the others of that hash, by grouping on its text, and removed wherever it is not the first occurrence by id.

Hash counts are shuffled first and without texts; the texts of such chunks alone go on to be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm.common import cut, let, table

_P = 2147483647
_B = 1000003


def _line_hash(line: Column) -> Column:
    """60 bits of md5 modulo a prime, so that products fit a long and DuckDB can do the same."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long") % _P


def chunk_bounds(lines: Column) -> Column:
    """array<struct<k, s, n>>: number, first line (from 0) and number of lines of each chunk."""

    def by_roll(roll: Column) -> Column:
        # roll[i] covers lines i and i + 1 (from 0); a boundary after line b needs roll[b - 1], and b from 1 to lines - 3
        n = F.size(roll) + 1
        low = lambda b: (F.get(roll, b - 1) < F.coalesce(F.get(roll, b - 2), F.lit(_P))) & (F.get(roll, b - 1) <= F.get(roll, b))
        ends = F.when(n >= 4, F.filter(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), low)).otherwise(F.array().cast("array<int>"))
        return let(
            ends,
            lambda e: let(
                F.concat(F.array(F.lit(0)), F.transform(e, lambda x: x + 1), F.array(n)),
                lambda c: F.transform(
                    F.sequence(F.lit(1), F.size(c) - 1),
                    lambda i: F.struct(i.alias("k"), F.get(c, i - 1).alias("s"), (F.get(c, i) - F.get(c, i - 1)).alias("n")),
                ),
            ),
        )

    def rolls(h: Column) -> Column:
        return F.when(
            F.size(h) > 1,
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - 1, F.lit(1))), lambda i: (F.get(h, i - 1) * _B + F.get(h, i)) % _P),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(lines, _line_hash), lambda h: let(rolls(h), by_roll))


def _chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _piece(lines: Column, bound: Column) -> Column:
    """The text of a chunk."""
    return F.array_join(F.slice(lines, bound["s"] + 1, bound["n"]), "\n")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_lines, n_removed_chunks, n_removed_lines, text, then the columns of ``keep``: a row for each row of df.

    The first occurrence of a chunk is that in the smallest id (null last), there the first one; it stays. A null text has no
    lines and stays null; an empty one has one line. A text of which all chunks went becomes empty. Rows that repeat an id
    and text are one document: each gets the same result. Ids are numbers, or texts of numbers. Lines end at \\n alone. Columns that are not named are not read, so
    their names cannot clash; an empty table gives no rows.
    """
    docs = df.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("th"),
        *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)),
    )
    bounds = let(
        F.split("text", "\n"),
        lambda ls: let(
            chunk_bounds(ls),
            lambda b: F.transform(
                F.filter(b, lambda c: c["n"] > 1),
                lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"), _chunk_hash(_piece(ls, c)).alias("h")),
            ),
        ),
    )
    light = docs.where(F.col("text").contains("\n")).select("id", "th", F.explode(bounds).alias("c")).select(
        "id", "th", "c.k", "c.n", "c.h"
    )
    light = cut(light.dropDuplicates(["id", "th", "k"]))  # hashes and places only
    often = light.groupBy("h").agg(F.count("*").alias("times")).where(F.col("times") > 1).select("h")
    maybe = cut(light.join(cut(often), "h", "left_semi"))  # dealt anew on both sides, so a hot hash can be split
    per_doc = maybe.groupBy(F.col("id").alias("id1"), F.col("th").alias("th1")).agg(F.collect_list(F.struct("k", "h")).alias("ks"))  # a document's own chunks
    same = lambda a, b: F.col("id").eqNullSafe(F.col(a)) & (F.col("th") == F.col(b))
    texts = docs.join(per_doc, same("id1", "th1"), "left").where(F.col("ks").isNotNull())
    pieces = let(
        F.split("text", "\n"),
        lambda ls: let(
            chunk_bounds(ls),
            lambda b: F.transform(
                "ks", lambda x: F.struct(x["k"].alias("k"), x["h"].alias("h"), _piece(ls, F.get(b, x["k"] - 1)).alias("chunk"))
            ),
        ),
    )
    candidates = texts.select("id", "th", F.explode(pieces).alias("c")).select("id", "th", "c.k", "c.h", "c.chunk")
    place = F.struct(F.coalesce(F.col("id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col("th").alias("th"), F.col("k").alias("k"))
    # Byte comparison: only equal texts meet in a group.
    groups = cut(candidates.groupBy("h", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("times")))
    per_hash = groups.groupBy("h").agg(F.count("*").alias("n_texts"), F.min("first").alias("first"), F.max("times").alias("times"))
    alike = per_hash.where((F.col("n_texts") == 1) & (F.col("times") > 1)).select(F.col("h").alias("h2"), "first")
    gone = maybe.join(cut(alike), F.col("h") == F.col("h2")).where(place != F.col("first")).select("id", "th", "k", "n")
    clashes = per_hash.where(F.col("n_texts") > 1).select("h")
    if not clashes.isEmpty():  # one hash, several texts: these are told apart by their text
        told = groups.join(clashes, "h", "left_semi").where(F.col("times") > 1).select(
            F.col("h").alias("h2"), F.col("chunk").alias("chunk2"), "first"
        )
        more = candidates.join(told, (F.col("h") == F.col("h2")) & (F.col("chunk") == F.col("chunk2"))).where(
            place != F.col("first")
        ).select("id", "th", "k")
        gone = gone.unionByName(
            more.join(
                maybe.select(F.col("id").alias("id3"), F.col("th").alias("th3"), F.col("k").alias("k3"), "n"),
                F.col("id").eqNullSafe(F.col("id3")) & (F.col("th") == F.col("th3")) & (F.col("k") == F.col("k3")),
            ).select("id", "th", "k", "n")
        )
    removal = gone.groupBy(F.col("id").alias("id1"), F.col("th").alias("th1")).agg(
        F.collect_set("k").alias("ks"), F.sum("n").alias("lines")
    )
    left = let(
        F.split("text", "\n"),
        lambda ls: let(
            chunk_bounds(ls),
            lambda b: F.array_join(
                F.flatten(
                    F.transform(
                        F.array_except(F.transform(b, lambda c: c["k"]), F.col("ks")),
                        lambda k: let(F.get(b, k - 1), lambda c: F.slice(ls, c["s"] + 1, c["n"])),
                    )
                ),
                "\n",
            ),
        ),
    )
    out = docs.join(removal, same("id1", "th1"), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.when(F.col("ks").isNull(), 0).otherwise(F.size("ks")).cast("long").alias("n_removed_chunks"),
        F.coalesce("lines", F.lit(0)).cast("long").alias("n_removed_lines"),
        F.when(F.col("ks").isNull(), F.col("text")).otherwise(left).alias("text"),
        *(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
           FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, i, line, CAST('0x' || substr(md5(line), 1, 15) AS BIGINT) % 2147483647 AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
r AS (SELECT *, (h * 1000003 + lead(h) OVER w) % 2147483647 AS r FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, CASE WHEN i >= 1 AND i <= n - 3 AND lag(r) OVER w < coalesce(lag(r, 2) OVER w, 2147483647) AND lag(r) OVER w <= r THEN 1 ELSE 0 END AS ends
      FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
c AS (SELECT doc_id, k, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY doc_id, k),
f AS (SELECT *, lines > 1 AND row_number() OVER (PARTITION BY chunk, lines > 1 ORDER BY doc_id, k) > 1 AS gone FROM c)
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed_chunks, 0) AS n_removed_chunks, coalesce(s.n_removed_lines, 0) AS n_removed_lines,
       CASE WHEN s.n_removed_chunks > 0 THEN coalesce(s.text, '') ELSE d.text END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, CAST(sum(lines) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed_chunks,
         CAST(coalesce(sum(lines) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed_lines, string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone) AS text
  FROM f GROUP BY doc_id) s ON d.doc_id = s.doc_id
"""
