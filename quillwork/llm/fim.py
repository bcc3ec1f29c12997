"""Fill-in-middle transformation: units are marked and found in UTF-8 by 64-bit words.

A unit is a run of letters A-Z, a-z or any other single character. Texts are viewed
as little-endian uint64; in each word arithmetic on all eight bytes at once marks
those that end a unit (bit 7 of the byte). ``bitwise_count`` counts the marks of a
word, running sums over words number the units of a whole batch, a binary search
finds the word that holds a given unit's end, and sums of bytes within that word its
place (select). No character of a text is looked at in Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .shared import bounded_batches, table, text_or_empty
from .words import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are transformed, and of 100 transformed ones so many put the suffix first.
RATE, SPM = 90, 20


def _each(byte: int) -> np.uint64:
    """The byte in all eight places of a word."""
    return np.uint64(byte * 0x0101010101010101)


def letters(word: np.ndarray) -> np.ndarray:
    """Bit 7 of each byte that is a letter: 7-bit sums carry into bit 7 from 'a' on, and again after 'z'."""
    low = (word | _each(0x20)) & _each(0x7F)
    return (low + _each(0x80 - 0x61)) & ~(low + _each(0x80 - 0x7B)) & ~word & _each(0x80)


def following(word: np.ndarray) -> np.ndarray:
    """Bit 7 of each byte 10xxxxxx, which goes on with a character."""
    return word & ~(word << np.uint64(1)) & _each(0x80)


def _next(marks: np.ndarray) -> np.ndarray:
    """The marks of each byte's successor, over the bounds of words."""
    out = marks >> np.uint64(8)
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


class Units:
    """Ends of the units of several texts: each text begins in a word of its own and ends before a zero byte."""

    def __init__(self, texts: list[bytes]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        held = size // 8 + 1
        self.last = np.cumsum(held)
        self.first = self.last - held
        buf = np.zeros(int(held.sum()) * 8, np.uint8)
        for text, at in zip(texts, self.first * 8, strict=True):
            buf[at : at + len(text)] = np.frombuffer(text, np.uint8)
        word = buf.view("<u8")
        letter = letters(word)
        # A character ends where none goes on; it ends a unit unless it and the next one are letters.
        marks = ~_next(following(word)) & ~(letter & _next(letter)) & _each(0x80)
        marks[self.last - 1] &= (np.uint64(1) << (8 * (size % 8)).astype(np.uint64)) - np.uint64(1)
        self.marks = marks
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])
        self.before = self.upto[self.first]
        #: Units of each text.
        self.n = self.upto[self.last] - self.before

    def end(self, units: np.ndarray) -> np.ndarray:
        """Bytes of each text up to the end of its so-many-th unit; 0 units end at 0."""
        rank = self.before + units
        at = np.searchsorted(self.upto, rank, "left") - 1
        at = np.clip(at, self.first, self.last - 1)
        left = (rank - self.upto[at]).astype(np.uint64)
        # Sums of the marks up to each byte; bytes whose sum is still too small come before the one looked for.
        sums = ((self.marks[at] >> np.uint64(7)) * _each(0x01)).view(np.uint8).reshape(-1, 8)
        place = (sums < left[:, None]).sum(1)
        return np.where(units > 0, (at - self.first) * 8 + place + 1, 0)


def numbers(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers that only the id and the seed decide."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(found[i : i + 8], 16) for i in (0, 8, 16, 24))


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row of ``docs (doc_id, text)``.

    ``n`` units; the two cuts are drawn from 0 to n by the id alone, so an attempt that
    is repeated gives the same output. ``form``: ``psm`` and ``spm`` as their parts are
    ordered, ``plain`` for texts that stay: empty ones, those that hold a marker, and
    ``100 - rate`` of 100. Null texts count as empty, a missing id as the empty string;
    rows that share an id share their numbers. Extra columns are not looked at.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        for batch in batches:
            for row, texts in slices(batch):
                ids = batch.column(0).slice(row, len(texts))
                units = Units(texts)
                drawn = [numbers(i, seed) for i in ids.to_pylist()]
                h1, h2 = (np.array([d[i] for d in drawn], np.int64) % (units.n + 1) for i in (0, 1))
                a, b = units.end(np.minimum(h1, h2)), units.end(np.maximum(h1, h2))
                form, prefix, middle, output = [], [], [], []
                for text, (_, _, h3, h4), i, j in zip(texts, drawn, a.tolist(), b.tolist(), strict=True):
                    if not text or h3 % 100 >= rate or any(m in text for m in marks):
                        form.append("plain")
                        prefix.append(None)
                        middle.append(None)
                        output.append(text)
                        continue
                    p, m, s = text[:i], text[i:j], text[j:]
                    first = h4 % 100 < spm
                    form.append("spm" if first else "psm")
                    prefix.append(len(p.decode()))
                    middle.append(len(m.decode()))
                    output.append(b"".join((marks[1], s, marks[0], p, marks[2], m) if first else (marks[0], p, marks[1], s, marks[2], m)))
                columns = [ids, pa.array(units.n), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(task, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its parts hold no marker, and no marker overlaps another, so the first of each kind is the one that was put there."""
    parts = lambda x, y: rf"(?s)\A{x}(.*?){y}(.*?){MIDDLE}(.*)\z"
    return (
        F.when(form == "psm", F.regexp_replace(output, parts(PREFIX, SUFFIX), "$1$3$2"))
        .when(form == "spm", F.regexp_replace(output, parts(SUFFIX, PREFIX), "$2$3$1"))
        .otherwise(output)
    )


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), k AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= {RATE} THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, array_to_string(u[: least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1 : greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1 :], '') AS s FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
