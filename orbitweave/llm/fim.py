"""Fill-in-middle arrangements of texts, in DataFrame functions only.

A text is cut into units, each the white space before a word and the word, or white space at the end. Two cuts
at units, taken from a sha-256 of the seed and the document's id, part it into prefix, middle and suffix; the
same hash decides whether the text stays as it is (``plain``) or is arranged as ``psm`` or ``spm`` behind
sentinels. ``restore`` parses the sentinels and gives the text back.

Which sentinel opens which part is told by the text between them alone: a text that holds a sentinel stays
plain, and none can arise where a part meets a sentinel, since each begins with ``<`` and has no other.

Cases: a null or empty text is plain, with no units and an empty output; a text of white space only is one
unit; a null id is hashed as the empty text; rows equal in id and text are arranged alike; an empty table gives
an empty result; all columns are kept, whatever their names, but those of ``COLUMNS`` are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: White space and word, or white space that no word follows.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SEED = 42
#: Per cent of the texts that are arranged, and of these the ones whose suffix comes first.
ARRANGED, SUFFIX_FIRST = 50, 80
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output")


def _draw(digest: Column, k: int) -> Column:
    """The k-th 8-digit group of a hexadecimal digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def arrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, arranged: int = ARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Adds ``n`` units, ``form``, the code points of prefix and middle (null if plain) and the ``output``."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS]
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    own = lambda name: f"__fim_{name}"
    cut = docs.select(*kept, text.alias(own("text")), F.regexp_extract_all(text, F.lit(UNIT), 0).alias(own("units")), digest.alias(own("digest")))
    n = F.size(own("units")).cast("long")
    cuts = [_draw(F.col(own("digest")), k) % (n + 1) for k in (0, 1)]
    sentinel = F.col(own("text")).rlike("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))
    plain = (n == 0) | sentinel | (_draw(F.col(own("digest")), 2) % 100 >= arranged)
    form = F.when(plain, "plain").when(_draw(F.col(own("digest")), 3) % 100 < suffix_first, "spm").otherwise("psm")
    placed = cut.select(*kept, own("text"), own("units"), n.alias("n"), form.alias("form"), F.least(*cuts).cast("int").alias(own("first")), F.greatest(*cuts).cast("int").alias(own("last")))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice(own("units"), start, length), ""))
    first, last = F.col(own("first")), F.col(own("last"))
    parts = placed.select(
        *kept, "n", "form", own("text"),
        part(F.lit(1), first).alias(own("prefix")), part(first + 1, last - first).alias(own("middle")), part(last + 1, F.size(own("units")) - last).alias(own("suffix")),
    )
    prefix, middle, suffix = (F.col(own(x)) for x in ("prefix", "middle", "suffix"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col(own("text")))
    )
    return parts.select(*kept, "n", "form", F.char_length(prefix).cast("long").alias("prefix_chars"), F.char_length(middle).cast("long").alias("middle_chars"), output.alias("output"))


def restore(rows: DataFrame, out_col: str = "restored") -> DataFrame:
    """Adds the text that ``output`` was made of, from ``output`` and ``form`` alone; a null output stays null."""
    parts = "__fim_parts"
    split = F.when(F.col("form") != "plain", F.split(F.col("output"), "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))), -1))
    part = lambda k: F.get(F.col(parts), F.lit(k))
    text = F.when(F.col("form") == "psm", F.concat(part(1), part(3), part(2))).when(F.col("form") == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col("output"))
    return rows.withColumn(parts, split).withColumn(out_col, text).drop(parts)


def digest(rows: DataFrame) -> DataFrame:
    """Arranged and restored texts as hashes."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restore(rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


#: Restoring is stated through the positions of the sentinels, not through a split.
SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[ \x09-\x0D]*[^ \x09-\x0D]+|[ \x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
    ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4
  FROM units),
formed AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM drawn),
parts AS (
  SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts),
found AS (SELECT *, strpos(o, '<P>') AS at_p, strpos(o, '<S>') AS at_s, strpos(o, '<M>') AS at_m FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN substr(o, at_p + 3, at_s - at_p - 3) || substr(o, at_m + 3) || substr(o, at_s + 3, at_m - at_s - 3)
    ELSE substr(o, at_p + 3, at_m - at_p - 3) || substr(o, at_m + 3) || substr(o, at_s + 3, at_p - at_s - 3) END) AS restored_sha256
FROM found
"""
