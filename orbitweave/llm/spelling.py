"""Spelling variants by anagram hashing.

``count_words`` counts the distinct lower-cased runs of letters (A-Z, a-z and U+00C0 to U+00FF) of all texts,
some of them misspelt on purpose.
``near_words`` finds words that differ by one inserted, deleted or exchanged letter: the integer key of a word
is the sum of the fifth powers of its letters' ranks, so that taking a letter away takes its power off the key.
Each word is listed under the key of what remains without one of its letters, and under its own key: where
these meet, the keys of two words differ by the value of one added, removed or exchanged letter. Such words
have the same letters but for one; whether they have them in the same order is then verified.

A key is shared by all words of the same letters, in any order, so it is joined together with a half of what
remains: one edit leaves the first or the last half as it was. Only pairs that are one edit apart leave the
join, which splits large keys by itself. Fifth powers of ranks from 1 to 90 have no two equal differences, so
each pair meets under one key, and at the first of the halves that it shares.

``variant_forms`` gives every word the commonest of its near words, if that is common enough, and follows
these forms to the last one by doubling the distance of a step. Counts at least double with each step, so
there are no cycles and at most 63 steps.

Cases: a null text has no words; a null id is hashed as the empty text; rows equal in id and text count as
often as they stand there; a word without near words has no form and is its own root; ties go to the smallest
word in code-point order; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.storage import materialise
from orbitweave.llm.textblocks import Batches, map_batches

#: A run whose hash this number divides loses a letter.
SLIP = 97
#: Code points and occurrences that a word needs.
MIN_LENGTH, MIN_COUNT = 5, 3
#: Times the count of a word that its form has at least.
COMMONER = 2


#: Of each code point up to U+00FF: its lower-cased letter, or a space; those beyond it are no letters either.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Entries and letters of a task's table of counts, which is passed on when it is full.
TABLE_WORDS, TABLE_LETTERS = 1 << 17, 1 << 22


def slipped_words(text: str | None, prefix: str, slip: int, min_length: int) -> Iterator[tuple[bytes, int]]:
    """Each word of a text in Latin-1 and how often it occurs; a word may come twice, by a slip."""
    base = zlib.crc32(prefix.encode())
    for run, times in Counter((text or "").encode("latin-1", "replace").translate(_LETTERS).split()).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), base)
        if h % slip == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= min_length:
            yield run, times


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the letter runs of whole texts, after the slips that their ids and hashes decide."""

    def count(batches: Batches) -> Batches:
        table: defaultdict[bytes, int] = defaultdict(int)
        letters = 0

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in table], pa.string()), pa.array(table.values(), pa.int64())], ["word", "n"])
            table.clear()
            return batch

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, times in slipped_words(text.as_py(), f"{key}:", slip, min_length):
                    if word not in table:
                        letters += len(word)
                    table[word] += times
                    if len(table) >= TABLE_WORDS or letters >= TABLE_LETTERS:
                        letters = 0
                        yield taken()
        if table:
            yield taken()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return map_batches(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_value(letter: Column) -> Column:
    """The fifth power of a letter's rank: a-z are 1 to 26, U+00C0 to U+00FF 27 to 90. Texts below 2 GB can't overflow their sum."""
    code = F.ascii(letter).cast("long")
    rank = F.when(code < 0xC0, code - 96).otherwise(code - 0xC0 + 27)
    return rank * rank * rank * rank * rank


def anagram_key(word: Column) -> Column:
    """The sum of the values of a word's letters."""
    return F.aggregate(F.transform(F.split(word, ""), letter_value), F.lit(0).cast("long"), lambda total, v: total + v)


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``word, near`` of distinct words one inserted, deleted or exchanged letter apart, in both directions."""
    keyed = words.select("word", F.char_length("word").alias("length"), anagram_key(F.col("word")).alias("key"))
    # A word as it is and, for each letter that it has, without one such letter; ``rest`` letters are left.
    whole = F.struct(F.col("key"), F.col("length").alias("rest"))
    without = F.transform(F.array_distinct(F.split("word", "")), lambda x: F.struct((F.col("key") - letter_value(x)).alias("key"), (F.col("length") - 1).alias("rest")))
    listed = keyed.select("word", "length", F.explode(F.concat(F.array(whole), without)).alias("left")).select("word", "length", "left.*")
    half = F.floor(F.col("rest") / 2).cast("int")
    first, last = F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), F.col("length") - (F.col("rest") - half) + 1, F.col("length"))
    # The lowest bit tells first halves from last ones.
    even = lambda *parts: F.shiftleft(F.xxhash64(*parts), 1)
    sides = listed.select("word", "key", F.explode(F.array(even("rest", first), even("rest", last) + 1)).alias("part"), (F.col("rest") == F.col("length")).alias("whole"))
    sides = materialise(sides, "anagrams")
    a, b = F.col("a.word"), F.col("b.word")
    half_a = F.floor((F.char_length(a) - F.when(F.col("a.whole"), 0).otherwise(1)) / 2).cast("int")
    # Each pair is taken once: at its first halves if they are equal, else at the last ones.
    same_first = F.substring(a, F.lit(1), half_a) == F.substring(b, F.lit(1), half_a)
    once = same_first == (F.col("a.part").bitwiseAND(F.lit(1)) == 0)
    met = sides.alias("a").join(sides.alias("b"), [F.col("a.key") == F.col("b.key"), F.col("a.part") == F.col("b.part"), ~(F.col("a.whole") & F.col("b.whole")), a != b, F.levenshtein(a, b, 1) == 1, once])
    return met.select(a.alias("word"), b.alias("near"))


def follow(steps: DataFrame) -> DataFrame:
    """``word, root`` of the rows ``word, form``, whose forms lead to no cycle: each form's form, and so on, to the last."""
    reached = materialise(steps.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.alias("a").join(reached.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        after = materialise(onward.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "roots")
        if not after.where("moved").take(1):
            return after.select("word", "root")
        reached = after.select("word", "root")


def variant_forms(words: DataFrame, commoner: int = COMMONER) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the rows ``word, n``."""
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # The least of (-n, word) is the commonest near word, and of those the smallest.
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.minus") >= commoner * F.col("n"), F.col("best")).alias("best"))
    formed = materialise(formed.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.minus")).alias("form_n")), "forms")
    roots = follow(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Bytes of the hashed text go through the usual table of crc32, which a rule makes; near words share what is left
#: without one letter, at the same place if the letter is exchanged. No anagram keys are used.
SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || range(8)::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
runs AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)),
counted AS (SELECT id, run, count(*)::BIGINT AS times FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(id || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) AS h
  FROM counted, crc),
slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
less AS MATERIALIZED (
  SELECT word, n, i, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
chain AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) c ON c.word = f.word
"""
