"""Line deduplication with a log-template tree, in DataFrame operations only.

A line goes down a tree of fixed depth: its number of tokens, then its leading tokens, tokens with a digit
being the variable field <*>. Below, a template is the line itself, or the line with one of its runs (a
quarter of what follows the leading tokens) generalised, so lines of one form that differ in one field meet.
A template that occurs in more than one document is dropped everywhere but in the document of least doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.storage import settle

#: Tokens that lead through the tree, runs of the rest, tokens from which a line takes part, and from which runs are generalised.
DEPTH, RUNS, LEAST, GENERAL = 3, 4, 3, 8
FIELD = "<*>"
NO_ID = -(1 << 63)


def _once(value: Column) -> Column:
    """A generator of one row: what stands above reads the value instead of computing it anew."""
    return F.explode(F.array(value))


def _row_key() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("mark")


def _free(name: str, taken: set[str]) -> str:
    while name.lower() in taken:
        name += "_"
    return name


def hashed_lines(docs: DataFrame) -> DataFrame:
    """Rows (doc, mark, pos, n, check, h0 .. h4) of the lines that take part: enough tokens, and half of them no variable field.

    doc and mark, a hash of the whole text, name the row. h0 is a hash of the number of tokens and the
    leading ones, the path through the tree; h1 to h4 are hashes of the runs behind them.
    """
    lines = docs.select(*_row_key(), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", r"(?<![^ \t\r])[^ \t\r0-9]*+[0-9][^ \t\r]*+", FIELD)).otherwise(F.col("line"))
    lines = lines.select("doc", "mark", "pos", _once(F.split(F.btrim(masked, F.lit(" \t\r")), "[ \t\r]+")).alias("t"))
    n = F.size("t")
    plain = n - F.when(F.array_contains("t", FIELD), F.size(F.filter("t", lambda x: x == FIELD))).otherwise(0)
    lines = lines.filter((n >= LEAST) & (plain >= LEAST) & (plain * 2 >= n))
    rest = F.greatest(n - DEPTH, F.lit(0))
    edges = [F.lit(DEPTH) + F.floor(rest * i / RUNS).cast("int") for i in range(RUNS + 1)]
    runs = [F.xxhash64(F.slice("t", edges[i] + 1, edges[i + 1] - edges[i])).alias(f"h{i + 1}") for i in range(RUNS)]
    return lines.select("doc", "mark", "pos", n.alias("n"), F.hash(F.slice("t", 1, DEPTH)).alias("check"), F.xxhash64(n, F.slice("t", 1, DEPTH)).alias("h0"), *runs)


def templates(lines: DataFrame) -> DataFrame:
    """Rows (doc, mark, pos, key, check): one for the line and one for each generalised run."""

    def key(skip: int) -> Column:
        return F.xxhash64(F.lit(skip), "h0", *(f"h{i + 1}" for i in range(RUNS) if i != skip))

    every = F.when(F.col("n") >= GENERAL, F.array(*(key(i) for i in range(-1, RUNS)))).otherwise(F.array(key(-1)))
    return lines.select("doc", "mark", "pos", "check", F.explode(every).alias("key"))


def drop_recurring_lines(docs: DataFrame, lines: str = "lines", dropped: str = "lines_dropped") -> DataFrame:
    """docs (doc_id, text, ...) with recurring lines taken out, and two counts of each row: its lines, and those dropped.

    A line with less than 3 tokens, or mostly of variable fields, always stays; so does every line that no
    other document shares. Rows that share a doc_id count as one document, and so do rows with a null one:
    what only they share stays, and each row loses its own lines alone. A document whose lines all go keeps
    its row with an empty text; a null text stays null with 0 lines. Other columns pass through, whatever
    their names: a count whose name is taken gets an underscore behind it. An empty table gives no rows.
    """
    found = templates(settle(hashed_lines(docs.select("doc_id", "text")), "lines"))
    spread = found.groupBy("key", "check").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    gone = found.join(spread.select("key", "check", "first"), ["key", "check"]).filter("doc > first")
    gone = gone.groupBy("doc", "mark").agg(F.collect_set("pos").alias("gone"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    taken = {c.lower() for c in docs.columns}
    met = docs.select(F.struct(*own).alias("row"), *_row_key()).join(gone, ["doc", "mark"], "left").select("gone", "row", F.col("row").getField("text").alias("text"))
    each = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(each) - 1), F.col("gone"))
    whole = F.col("gone").isNull() | F.col("text").isNull()
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(each, i)), "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    columns = [text.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return met.select(*columns, count.cast("long").alias(_free(lines, taken)), F.when(whole, 0).otherwise(F.size("gone")).cast("long").alias(_free(dropped, taken | {_free(lines, taken).lower()})))


ORACLE = """
WITH lines AS (
    SELECT doc_id, u.pos, u.line
    FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u
    WHERE text IS NOT NULL
), tokens AS (
    SELECT doc_id, pos, list_transform(string_split_regex(trim(line, ' ' || chr(9) || chr(13)), '[ \\t\\r]+'),
                                       lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t
    FROM lines
), parts AS (
    SELECT doc_id, pos, t, len(t) AS n, greatest(len(t) - 3, 0) AS rest FROM tokens
    WHERE len(t) >= 3 AND len(list_filter(t, lambda x: x <> '<*>')) >= 3 AND 2 * len(list_filter(t, lambda x: x <> '<*>')) >= len(t)
), keys AS (
    SELECT doc_id, pos, 'whole ' || array_to_string(t, ' ') AS k FROM parts
    UNION ALL
    SELECT doc_id, pos, n || ' ' || i || ' ' || array_to_string(t[1 : 3 + rest * i // 4], ' ') || ' | ' || array_to_string(t[4 + rest * (i + 1) // 4 : n], ' ')
    FROM parts, range(4) r(i) WHERE n >= 8
), firsts AS (
    SELECT k, min(doc_id) AS first FROM keys GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS (
    SELECT DISTINCT doc_id, pos FROM keys JOIN firsts USING (k) WHERE doc_id > first
), kept AS (
    SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text, count(*) AS lines, count(g.pos) AS lines_dropped
    FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT doc_id, coalesce(text, '') AS text, lines, lines_dropped FROM kept
"""
