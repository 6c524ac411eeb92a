"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is dropped if an earlier line of the corpus (by doc_id, then position) is equal to it or one edit
(inserted, deleted or exchanged character) away; the earliest stays. Lines of fewer than ``min_chars``
characters are never dropped as one edit away, and as equal ones only from ``exact_chars`` characters on
(``min_chars`` if not given, as the SQL has it). Shorter lines of white space only are always kept.

Variants of a line, with one character deleted, are emitted as hashed keys and equal keys are joined:
a line equal to another's variant is one insertion away, and two lines with the same variant at the same
place one exchange. Within a key the earliest line decides, by aggregation, so no pairs are made inside a
group. That each line and the one that beats it are equal without the letters in question is then verified.

Variants are emitted only where cheaper keys allow a match. Two lines one edit apart share their first or
their last half, so lines that share neither with another line are set aside. The others are cut into
blocks; a variant that deletes from a block leaves what is before and after it, and only blocks of which
two different lines share that pair, hashed, emit variants. This loses nothing, and the work for a long
line stays far below its square.

Cases: a null text stays null; blank and short lines stay; of rows that are equal in id and text all keep
the same lines; a null id comes before all others; a document that loses lines may become empty; an empty
table gives an empty result; other columns are kept, whatever their names, but ``n_lines, n_exact,
n_near`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.storage import materialise

MIN_CHARS = 24
#: Characters of a block from which longer lines get more than two blocks.
BLOCK_CHARS = 256
#: Rows (keys, line hashes or dropped positions, some 16 bytes each) up to which a side is broadcast.
BROADCAST_ROWS = 50_000
#: A line that occurs more often than this, and than one in HOT_LINES of all lines, is looked up by a broadcast:
#: there are fewer than HOT_LINES such lines, whatever the corpus.
HOT_LINE, HOT_LINES = 1_000, 5_000


def _side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint if the written table is small enough, else the table as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.split(F.col(text_col), "\n").alias("parts"))
    rows = rows.select("doc", "th", F.posexplode("parts").alias("pos", "line"))
    return rows.where(F.char_length("line") >= min_chars).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _halves(line: Column) -> Column:
    """Keys of the first and the last half. With a line of one character more or less, that is the shorter's half."""
    n = F.char_length(line)

    def both(h: Column) -> list[Column]:
        return [F.xxhash64(F.lit(0), h, F.substr(line, F.lit(1), h)), F.xxhash64(F.lit(1), h, F.substr(line, n - h + 1))]

    h, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.when(h == less, F.array(*both(h))).otherwise(F.array(*both(h), *both(less)))


def _chain(pieces: Column) -> Column:
    """Hashes of the first 0, 1, 2, ... pieces, each made of the one before."""
    return F.aggregate(pieces, F.array(F.lit(0).cast("long")), lambda done, p: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), p))))


def _blocks(line: Column, rest: Column, taken: int) -> Column:
    """For a variant of ``rest`` characters: its blocks with the hashes of what is before and after each.

    ``taken`` is 1 if the line has one character more than the variant, in the block; else 0. A block and what
    follows it begin at the same places of the variant either way, so both sides are hashed piece by piece,
    once for all blocks. Blocks are as many as ``BLOCK_CHARS`` ask for, but no more than the square root of the
    characters: a long line is neither cut into very many blocks nor has very many variants in one."""
    size = F.greatest(F.ceil((rest + 1) / F.greatest(F.lit(2), F.least(F.ceil((rest + 1) / F.lit(BLOCK_CHARS)), F.ceil(F.sqrt(rest + 1))))), F.lit(1)).cast("int")
    parts = lambda text: F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))
    made = F.struct(size.alias("size"), parts(line).alias("pieces"), _chain(parts(line)).alias("before"), _chain(F.reverse(parts(F.substr(line, size + taken)))).alias("after"))

    def cut(m: Column) -> Column:
        def block(piece: Column, j: Column) -> Column:
            inside = piece if taken else F.substr(piece, F.lit(1), m["size"] - 1)
            return F.struct(
                F.lit(taken).alias("taken"),
                j.alias("j"),
                (j * m["size"]).alias("start"),
                rest.alias("rest"),
                F.get(m["before"], j).alias("before"),
                inside.alias("inside"),
                F.get(m["after"], F.greatest(F.size(m["after"]) - 1 - j, F.lit(0))).alias("after"),
            )

        # A line that ends where a block begins goes on into an empty block.
        whole = F.when(F.char_length(line) % m["size"] == 0, F.concat(m["pieces"], F.array(F.lit("")))).otherwise(m["pieces"])
        return F.filter(F.transform(whole, block), lambda b: b["start"] <= b["rest"])

    return F.flatten(F.transform(F.array(made), cut))


def _key(b: Column) -> Column:
    return F.xxhash64(b["j"], b["rest"], b["before"], b["after"])


def _all_blocks(line: Column) -> Column:
    n = F.char_length(line)
    return F.concat(_blocks(line, n, 0), _blocks(line, n - 1, 1))


def _shared(keys: DataFrame) -> DataFrame:
    """The keys that two different lines have."""
    return keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("key")


def near_lines(lines: DataFrame, texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """``h1, h2`` of the lines that have an earlier line one edit away.

    ``lines`` has ``h1, h2, keys``, ``texts`` ``h1, h2, line``, ``firsts`` ``h1, h2, first``."""
    keys = lines.select("h1", "h2", F.explode("keys").alias("key"))
    shared = materialise(_shared(keys), "line-keys")
    named = materialise(keys.join(_side(shared), "key", "left_semi").select("h1", "h2").distinct(), "line-candidates")
    found = texts.join(_side(named), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("line").alias("line"))
    found = materialise(found.join(firsts, ["h1", "h2"]), "line-texts")

    blocks = found.select("h1", "h2", "first", F.explode(_all_blocks(F.col("line"))).alias("b")).withColumn("key", _key(F.col("b")))
    blocks = blocks.join(_shared(blocks), "key", "left_semi")
    inside = F.col("b.inside")
    own = F.array(F.struct(F.lit(-1).alias("at"), F.xxhash64(F.lit(0), inside).alias("rest")))
    cut = F.transform(
        F.sequence(F.lit(1), F.char_length(inside)),
        lambda i: F.struct((F.col("b.start") + i).cast("int").alias("at"), F.xxhash64(F.lit(0), F.concat(F.substr(inside, F.lit(1), i - 1), F.substr(inside, i + 1))).alias("rest")),
    )
    variants = blocks.select("key", F.struct("first", "h1", "h2").alias("me"), F.explode(F.when(F.col("b.taken") == 0, own).otherwise(cut)).alias("v"))
    variants = materialise(variants.select("key", F.col("v.rest").alias("variant"), F.col("v.at").alias("at"), "me"), "line-variants")
    whole = variants.where("at = -1")
    deleted = variants.where("at >= 0")
    key = ["key", "variant"]
    nothing = F.lit(None).cast("int")
    best = lambda rows, *on: rows.groupBy(*on).agg(F.min(F.struct("me", "at")).alias("best"))

    def beaten(rows: DataFrame, others: DataFrame, on: list[str], mine: Column, other: Column) -> DataFrame:
        met = rows.join(others, on).where(F.col("best.me.first") < F.col("me.first"))
        return met.select(F.col("me.h1").alias("h1"), F.col("me.h2").alias("h2"), F.col("best.me.h1").alias("g1"), F.col("best.me.h2").alias("g2"), mine.alias("cut"), other.alias("other_cut"))

    inserted = beaten(deleted, best(whole, *key), key, F.col("at"), nothing)
    shortened = beaten(whole, best(deleted, *key), key, nothing, F.col("best.at"))
    exchanged = beaten(deleted, best(deleted, *key, "at"), [*key, "at"], F.col("at"), F.col("at"))
    pairs = inserted.unionByName(shortened).unionByName(exchanged).distinct()
    later = found.select("h1", "h2", F.col("line").alias("mine"))
    earlier = found.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("other"))
    # Verified by taking out the letters that the hashes name: linear in the line, as an edit distance is not.
    without = lambda line, at: F.when(F.col(at).isNull(), F.col(line)).otherwise(F.concat(F.substr(line, F.lit(1), F.col(at) - 1), F.substr(line, F.col(at) + 1)))
    return pairs.join(later, ["h1", "h2"]).join(earlier, ["g1", "g2"]).where(without("mine", "cut") == without("other", "other_cut")).select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and ``n_lines, n_exact, n_near``: its lines, and
    how many were dropped as equal to an earlier line or one edit away from one."""
    texts = _lines(docs, id_col, text_col, min_chars if exact_chars is None else min(min_chars, exact_chars))
    keys = _halves(F.col("line"))
    if exact_chars is not None:
        texts = texts.where((F.char_length("line") >= min_chars) | F.col("line").rlike(r"\S"))
        keys = F.when(F.char_length("line") >= min_chars, keys)
    lines = materialise(texts.select("doc", "th", "pos", "h1", "h2", keys.alias("keys")), "lines")
    place = F.struct("doc", "th", "pos")
    firsts = materialise(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "line-firsts")
    near = near_lines(lines, texts.select("h1", "h2", "line"), firsts.select("h1", "h2", "first")).withColumn("near", F.lit(True))
    # Only lines that occur again or are near another are looked up; those that occur most often without a shuffle.
    known = materialise(firsts.join(near, ["h1", "h2"], "left").where((F.col("n") > 1) | F.col("near")).withColumn("near", F.coalesce("near", F.lit(False))), "lines-known")
    hot = F.col("n") > F.lit(max(HOT_LINE, lines.count() // HOT_LINES))
    often = F.broadcast(known.where(hot))
    slim = lines.select("doc", "th", "pos", "h1", "h2")
    judged = slim.join(often, ["h1", "h2"]).unionByName(slim.join(often, ["h1", "h2"], "left_anti").join(known.where(~hot), ["h1", "h2"]))
    exact = ~F.struct("first.doc", "first.th", "first.pos").eqNullSafe(place)
    # Rows of equal id and text name the same positions.
    found = F.collect_set(F.struct("pos", F.col("exact").alias("exact"))).alias("found")
    dropped = (
        judged.withColumn("exact", exact)
        .where(F.col("exact") | F.col("near"))
        .groupBy(F.col("doc").alias("__doc"), F.col("th").alias("__th"))
        .agg(found)
        .select("__doc", "__th", F.col("found.pos").alias("__dropped"), F.size(F.filter("found", lambda x: x["exact"])).alias("n_exact"), F.size(F.filter("found", lambda x: ~x["exact"])).alias("n_near"))
    )
    dropped = materialise(dropped, "lines-dropped")
    positions = dropped.agg(F.sum(F.size("__dropped"))).first()[0] or 0
    kept = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    text, parts = F.col(text_col), F.col("__parts")
    joined = docs.select(*kept).join(_side(dropped, positions), F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text_col) == F.col("__th")), "left")
    joined = joined.withColumn("__parts", F.split(text, "\n"))  # a column: in the lambda below each line would split the text again
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__dropped"))
    new = F.when(F.col("__dropped").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    return joined.select(
        *(new.alias(c) if c == text_col else F.col(c) for c in kept),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n_exact", F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


#: The query's digest in SQL: lines one edit apart share their first or last half, and each such pair is compared.
SQL = """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, k AS pos, parts[k] AS line, length(parts[k]) AS n FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM t)),
f AS (SELECT line, n, min(doc_id * 1000000 + pos) AS first FROM l WHERE n >= 24 GROUP BY line, n),
h AS (SELECT line, n, first, unnest([n // 2, (n - 1) // 2]) AS h FROM f),
k AS (SELECT DISTINCT line, n, first, h, side, CASE side WHEN 0 THEN substr(line, 1, h) ELSE substr(line, n - h + 1) END AS half FROM h, (SELECT unnest([0, 1]) AS side)),
c AS (SELECT DISTINCT y.line AS line, y.n AS n, x.line AS other, x.n AS m FROM k x JOIN k y ON x.h = y.h AND x.side = y.side AND x.half = y.half AND x.first < y.first AND abs(x.n - y.n) <= 1),
g AS (SELECT line, CASE WHEN n >= m THEN line ELSE other END AS long, CASE WHEN n >= m THEN other ELSE line END AS short, greatest(n, m) AS a, least(n, m) AS b FROM c),
near AS (SELECT DISTINCT line FROM (SELECT *, unnest(range(1, a + 1)) AS i FROM g) WHERE substr(long, 1, i - 1) = substr(short, 1, i - 1) AND substr(long, i + 1) = substr(short, i + 1 - (a - b))),
j AS (SELECT l.doc_id, l.pos, l.line, coalesce(f.first <> l.doc_id * 1000000 + l.pos, false) AS exact, near.line IS NOT NULL AS near FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN near ON near.line = l.line),
r AS (SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE exact) AS BIGINT) AS n_exact, CAST(count(*) FILTER (WHERE near AND NOT exact) AS BIGINT) AS n_near, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT exact AND NOT near), '') AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, CAST(length(kept) AS BIGINT) AS kept_chars, md5(kept) AS kept_md5 FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""
