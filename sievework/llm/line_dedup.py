"""Substring dedup by hashing lines and their pieces.

A line is parted after each run of white space that follows a full stop, exclamation or question
mark, so that a passage copied into the middle of a long line, or one with an edit near it, still
shares pieces with its source. A piece of min_words words is a unit; a shorter one is a unit
together with the pieces after it (over line ends) until they have that many, so that a passage
wrapped in short lines is caught and "Yes." alone is no evidence of copying. Units are normalised
(lower case, white space runs to one space) and named by a 128-bit digest.

Of the units that share a digest the earliest by (document id, place in the document) stays; the
pieces of the others are cut from their texts, with their offsets in the original text kept. Digests
are grouped globally as (digest, smallest id, largest id), combined before the shuffle; a document
sends each of its digests once, and repeats inside it are found where it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from sievework.llm.common import documents, release
from sievework.plans.staging import materialise

MIN_WORDS = 8
#: Words in a row that stand elsewhere too, from which on they are called a passage.
PASSAGE_WORDS = 32
_FOUND = "__sievework_found"
_SPACE = r"[\x20\x09\x0B-\x0D]"
_STOP = re.compile(rf"[.!?]{_SPACE}+")
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("unit", T.IntegerType()), T.StructField("kept_id", T.LongType())]))


def pieces(line: str) -> list[str]:
    """The line's pieces, each with the white space after it."""
    cuts = [m.end() for m in _STOP.finditer(line)]
    return [line[s:e] for s, e in zip([0, *cuts], [*cuts, len(line)], strict=True) if e > s] if cuts else [line] if line else []


def hashed(text: str, min_words: int = MIN_WORDS) -> tuple[list[int], list[tuple[int, int, bytes]]]:
    """(words of each piece with any, units as (first piece, piece after the last, digest)).

    Pieces without words are left out of the numbering. Where too few words follow, no unit begins.
    """
    norm = [w for line in text.lower().split("\n") for p in pieces(line) if (w := p.encode("utf-8", "surrogatepass").split())]
    n, found, stop, have = [*map(len, norm)], [], 0, 0
    joined = [b" ".join(w) for w in norm]
    for i, own in enumerate(n):
        while have < min_words and stop < len(n):
            have += n[stop]
            stop += 1
        if have < min_words:
            break
        found.append((i, stop, xxhash.xxh3_128_digest(joined[i] if stop == i + 1 else b" ".join(joined[i:stop]))))
        have -= own
    return n, found


def units(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, hi, lo): the two halves of each distinct digest of each row's text."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [sorted({d for _, _, d in hashed(t, min_words)[1]}) if t else [] for t in b.column(1).to_pylist()]
            halves = np.frombuffer(b"".join(b"".join(x) for x in names), dtype=">i8").astype(np.int64).reshape(-1, 2)
            row = np.repeat(np.arange(len(names)), [*map(len, names)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["id", "hi", "lo"])
        release()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").mapInArrow(run, f"id {kind}, hi long, lo long")


def _cut(text: str, min_words: int, passage: int, found: dict[bytes, tuple[bool, int | None]], own: int | None) -> tuple[str, list[dict], int]:
    """(text without its late pieces, their spans, words of its longest passage). found: of each digest
    that stands in other documents too, whether an earlier one holds it, and that one's id."""
    n, marked = hashed(text, min_words)
    shared, kept, seen = [False] * len(n), {}, set()
    for s, e, d in marked:
        late, first = found.get(d, (False, own))
        if d in found:
            shared[s:e] = [True] * (e - s)
        if late or d in seen:
            for i in range(s, e):
                kept.setdefault(i, first)
        seen.add(d)
    longest = words = 0
    for x, yes in zip(n, shared, strict=True):
        words = words + x if yes else 0
        longest = max(longest, words)
    if not kept:
        return text, [], longest if longest >= passage else 0
    place, i, stay, gone = 0, 0, [], []
    for line in text.split("\n"):
        parts, left, at = pieces(line), [], place
        for p in parts:
            if p.strip("\x20\x09\x0b\x0c\x0d"):
                if i in kept:
                    gone.append({"start": at, "end": at + len(p), "unit": i, "kept_id": kept[i]})
                else:
                    left.append(p)
                i += 1
            else:
                left.append(p)
            at += len(p)
        if left or not parts:
            stay.append("".join(left))
        place += len(line) + 1
    return "\n".join(stay), gone, longest if longest >= passage else 0


def dedup_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, passage: int = PASSAGE_WORDS) -> DataFrame:
    """df with the text cut, and two columns more: passage_words, and removed, an array of spans
    (start, end in code points of the original text, unit: number of the piece, kept_id).

    A line goes with its line feed when all its pieces go. passage_words: words of the longest run of
    pieces that other documents hold too, whether cut here or kept here as the earliest; 0 under
    `passage`. Null and empty texts pass unchanged. Rows with a null id are neither compared nor cut.
    Of rows that share an id and a unit none is later than the other: both keep it, unless an earlier
    document has it. All other columns pass, whatever their names; existing columns passage_words and
    removed are replaced. kept_id is the id as a long (null if the id is no number).
    """
    u = units(df, id_col, text_col, min_words)
    shared = materialise(u.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("hi", "lo", "first"), "shared")
    number = F.try_to_number(F.col("first").cast("string"), F.lit("9" * 19)).cast("long")
    met = u.join(shared, ["hi", "lo"]).select("id", F.struct("hi", "lo", (F.col("id") > F.col("first")).alias("late"), number.alias("kept")).alias("f"))
    per = met.groupBy("id").agg(F.collect_list("f").alias(_FOUND))
    base = df.drop("passage_words", "removed")
    joined = base.join(per, base[id_col] == per["id"], "left").select(*[base[c] for c in base.columns], per[_FOUND])
    key, at = base.columns.index(id_col), base.columns.index(text_col)
    schema = T.StructType([*base.schema.fields, T.StructField("passage_words", T.LongType()), T.StructField("removed", _SPAN)])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("unit", pa.int32()), ("kept_id", pa.int64())]))
    digest = lambda f: f["hi"].to_bytes(8, "big", signed=True) + f["lo"].to_bytes(8, "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, longest, spans = [], [], []
            for own, text, found in zip(b.column(key).to_pylist(), b.column(at).to_pylist(), (x.as_py() for x in b.column(b.num_columns - 1)), strict=True):
                if not text or own is None:
                    text, gone, words = text, [], 0
                else:
                    text, gone, words = _cut(text, min_words, passage, {digest(f): (f["late"], f["kept"]) for f in found or ()}, own if isinstance(own, int) else None)
                texts.append(text)
                spans.append(gone)
                longest.append(words)
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns[at] = pa.array(texts, type=b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(longest, type=pa.int64()), pa.array(spans, type=arrow_span)], names=[*b.schema.names[:-1], "passage_words", "removed"])
        release()

    return joined.mapInArrow(run, schema)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: whether it shares a passage with another, what was cut, and its text after the cuts."""
    out = dedup_units(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    kept = F.array_join(F.array_sort(F.array_distinct(F.transform("removed", lambda r: r["kept_id"]))).cast("array<string>"), ",")
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return out.select("doc_id", (F.col("passage_words") > 0).alias("shares_passage"), "passage_words", F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"), spans.alias("spans"), kept.alias("kept_in"), "text")


def cut_sql(docs: str, min_words: int = MIN_WORDS, passage: int = PASSAGE_WORDS) -> str:
    """DuckDB SQL of the cut over the relation docs, whose doc_ids are distinct."""
    reach = range(min_words)
    total = lambda k: " + ".join(f"coalesce(lead(n, {j}) OVER doc, 0)" for j in range(k + 1))
    whole = lambda k: " || ' ' || ".join(f"lead(norm, {j}) OVER doc" for j in range(k + 1))
    size = "CASE " + " ".join(f"WHEN {total(k)} >= {min_words} THEN {k + 1}" for k in reach) + " END"
    name = "CASE " + " ".join(f"WHEN size = {k + 1} THEN {whole(k)}" for k in reach) + " END"
    over = lambda flag: "(" + " OR ".join(f"coalesce(lag({flag}, {k}) OVER doc AND lag(size, {k}) OVER doc > {k}, false)" for k in reach) + ")"
    first = "coalesce(" + ", ".join(f"CASE WHEN lag(late, {k}) OVER doc AND lag(size, {k}) OVER doc > {k} THEN lag(first_id, {k}) OVER doc END" for k in reversed(reach)) + ")"
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS row FROM {docs}
), cut AS (
  SELECT doc_id, row, unnest(string_split(m, chr(1))) AS piece, generate_subscripts(string_split(m, chr(1)), 1) AS col
  FROM (SELECT doc_id, row, regexp_replace(line, '([.!?]{_SPACE}+)', '\\1' || chr(1), 'g') AS m FROM lines)
), normal AS (
  SELECT doc_id, row, col, piece, trim(regexp_replace(lower(piece), '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS norm FROM cut WHERE piece <> '' OR col = 1
), placed AS (
  SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(norm) - len(replace(norm, ' ', '')) + 1 END AS n,
    (coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY row, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + row - 1)::BIGINT AS place FROM normal
), sized AS (
  SELECT *, {size} AS size FROM placed WHERE n > 0 WINDOW doc AS (PARTITION BY doc_id ORDER BY row, col)
), named AS (
  SELECT *, {name} AS name FROM sized WINDOW doc AS (PARTITION BY doc_id ORDER BY row, col)
), ranked AS (
  SELECT *, name IS NOT NULL AND row_number() OVER (PARTITION BY name ORDER BY doc_id, row, col) > 1 AS late,
    name IS NOT NULL AND min(doc_id) OVER (PARTITION BY name) <> max(doc_id) OVER (PARTITION BY name) AS shared, min(doc_id) OVER (PARTITION BY name) AS first_id FROM named
), judged AS (
  SELECT doc_id, row, col, n, {over("late")} AS gone, {over("shared")} AS held, {first} AS kept,
    row_number() OVER doc AS i FROM ranked WINDOW doc AS (PARTITION BY doc_id ORDER BY row, col)
), runs AS (
  SELECT doc_id, sum(n) AS words FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM judged WHERE held) GROUP BY doc_id, run
), long AS (
  SELECT doc_id, max(words)::BIGINT AS words FROM runs GROUP BY doc_id HAVING max(words) >= {passage}
), marked AS (
  SELECT p.*, coalesce(j.gone, false) AS gone, j.kept FROM placed p LEFT JOIN judged j USING (doc_id, row, col)
), rebuilt AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY row) AS text FROM (
    SELECT doc_id, row, coalesce(string_agg(piece, '' ORDER BY col) FILTER (NOT gone), '') AS line FROM marked GROUP BY doc_id, row HAVING NOT bool_and(gone)
  ) GROUP BY doc_id
), removed AS (
  SELECT doc_id, count(*) AS n, sum(length(piece))::BIGINT AS chars, string_agg(place || '-' || (place + length(piece)), ',' ORDER BY row, col) AS spans,
    array_to_string(list_sort(list_distinct(list(kept))), ',') AS kept_in FROM marked WHERE gone GROUP BY doc_id
)
SELECT d.doc_id, coalesce(words, 0) > 0 AS shares_passage, coalesce(words, 0) AS passage_words, coalesce(r.n, 0) AS n_removed, coalesce(chars, 0) AS removed_chars, coalesce(spans, '') AS spans,
  coalesce(kept_in, '') AS kept_in, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(b.text, '') END AS text
FROM {docs} d LEFT JOIN rebuilt b USING (doc_id) LEFT JOIN removed r USING (doc_id) LEFT JOIN long USING (doc_id)"""


SQL = cut_sql("documents")
