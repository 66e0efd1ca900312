"""Document fingerprints of closed syncmers, in built-in functions only.

Tokens are words; a letter of a script that is written without spaces is a token of its own, and a run of
more than PIECE other characters is cut there. Every token is hashed; a run of K tokens is a closed syncmer
if the smallest of its inner runs' hashes, here those of its single tokens, is the first or the last of
them. Whether a run of tokens is an anchor thus depends on these tokens alone, so an edit changes only the
anchors that touch it. A text is framed by K - 1 empty tokens on either side, so the shortest texts have
anchors too and the frame marks start and end. Texts of all lengths are treated alike.

A fingerprint is all anchors of a text: every distinct hash with the number of its places and the first of
them. Likeness compares two fingerprints whole: anchors of both, each as often as the text that has it less
often, whose first places differ by no more than SLACK tokens from the median shift of all common anchors,
as a share of the anchors of the text that has more. So a text of which a share is replaced keeps about the
rest as its likeness, and equal fingerprints have likeness 1.

Defined cases: null text is empty; texts without tokens share one fingerprint; the next document is the
one with the next smaller id (of equal ids: the next by text hash, then a repeated row; null ids last), after
the last the first; a table of one row is its own next document; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import let, shuffle_partitions

K, SLACK, PIECE = 4, 32, 24
CELL_BYTES = 64 << 20
#: Letters of scripts without spaces: kana, Han, Hangul syllables, Thai and Lao.
UNSPACED = "\\u0e00-\\u0eff\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7af"
TOKEN = f"([{UNSPACED}]|[^\\x20\\x09-\\x0D{UNSPACED}]{{1,{PIECE}}})"
ANCHORS = "array<struct<hash:bigint,n:int,at:int>>"


def tokens_of(text: Column) -> Column:
    """The tokens of a text, as TOKEN finds them; words that need no cutting, the usual case, are split off without it."""
    words = F.array_remove(F.split(F.regexp_replace(text, F.lit("[\\x09-\\x0D]"), F.lit(" ")), " "), "")
    cuts = lambda w: text.rlike(f"[{UNSPACED}]") | F.exists(w, lambda x: F.length(x) > PIECE)
    return let(words, lambda w: F.when(cuts(w), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))).otherwise(w))


def marked(tokens: Column) -> Column:
    """hash and place (with the frame) of every closed syncmer of an array of tokens."""
    frame = F.array_repeat(F.lit(""), K - 1)
    hashes = F.transform(F.concat(frame, tokens, frame), lambda w: F.xxhash64(w))

    def closed(h: Column) -> Column:
        def at(i):
            run = [F.get(h, i + j) for j in range(K)]
            edge, inner = F.least(run[0], run[-1]), F.least(*run[1:-1])
            return F.when(edge <= inner, F.struct(F.shiftrightunsigned(F.xxhash64(*run), 16).alias("hash"), i.alias("at")))

        return F.transform(F.sequence(F.lit(0), F.size(h) - K), at)

    return F.filter(let(hashes, closed), lambda x: x.isNotNull())


def anchors(text: Column) -> Column:
    """The fingerprint of a text as an array, by hash."""

    def counted(a: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i - 1)["hash"] != F.get(a, i)["hash"]))
        return let(begins, lambda b: F.transform(b, lambda i, j: F.struct(F.get(a, i)["hash"].alias("hash"), (F.coalesce(F.get(b, j + 1), F.size(a)) - i).alias("n"), F.get(a, i)["at"].alias("at"))))

    return let(F.sort_array(marked(tokens_of(text))), counted).cast(ANCHORS)


def packed(a: Column) -> Column:
    """A fingerprint as three arrays of numbers, less than half as large: what a cell's rows hold until the next row is known."""
    return let(a, lambda x: F.struct(x["hash"].alias("hash"), x["n"].alias("n"), x["at"].alias("at")))


def unpacked(p: Column) -> Column:
    return F.arrays_zip(p["hash"].alias("hash"), p["n"].alias("n"), p["at"].alias("at")).cast(ANCHORS)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, e: x + e["n"])


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 of two fingerprints, see above: one sort of both, in which common hashes are neighbours."""
    side = lambda x, s: F.transform(x, lambda e: F.struct(e["hash"].alias("hash"), F.lit(s).alias("side"), e["n"].alias("n"), e["at"].alias("at")))

    def common(m):
        pairs = F.transform(m, lambda e, i: F.when(F.get(m, i + 1)["hash"] == e["hash"], F.struct((e["at"] - F.get(m, i + 1)["at"]).alias("shift"), F.least(e["n"], F.get(m, i + 1)["n"]).alias("n"))))
        return F.filter(pairs, lambda x: x.isNotNull())

    def near(c):
        middle = F.get(F.sort_array(F.transform(c, lambda x: x["shift"])), F.floor(F.size(c) / 2).cast("int"))
        return let(middle, lambda m: total(F.filter(c, lambda x: F.abs(x["shift"] - m) <= SLACK)))

    shared = let(let(F.sort_array(F.concat(side(a, 0), side(b, 1))), common), near)
    apart = ~F.arrays_overlap(a["hash"], b["hash"])  # most texts that are no copies: told without a sort
    return F.when(a == b, F.lit(1.0)).when(apart, F.lit(0.0)).otherwise(F.coalesce(shared / F.greatest(total(a), total(b)), F.lit(0.0)))


def spelled(a: Column) -> Column:
    """A fingerprint as a string: hash.place in hexadecimal, and .n where there are more places, joined by commas."""
    one = lambda e: F.concat(F.hex(e["hash"]), F.lit("."), F.hex(e["at"].cast("long")), F.when(e["n"] > 1, F.concat(F.lit("."), e["n"].cast("string"))).otherwise(F.lit("")))
    return F.lower(F.array_join(F.transform(a, one), ","))


def place(id_: Column, text: Column) -> Column:
    """Where a row stands: by id, null first, then text hash; rows that are equal in both are told apart by their number."""
    return F.struct(id_.isNotNull().alias("known"), F.coalesce(id_, F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))


def count_below(bounds: list, at: Column) -> Column:
    """How many of the sorted bounds are at most `at`, by bisection: the number of a row's cell."""
    if not bounds:
        return F.lit(0)
    literal = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(b, (("known", "boolean"), ("id", "long"), ("hash", "long"), ("row", "long")), strict=True)]) for b in bounds])

    def halve(span, _):
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        up = (span["lo"] < span["hi"]) & (F.get(literal, middle) <= at)
        return F.struct(F.when(up, middle + 1).otherwise(span["lo"]).alias("lo"), F.when((span["lo"] < span["hi"]) & ~up, middle).otherwise(span["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve)["lo"]


def with_next(docs: DataFrame, **made: Column) -> DataFrame:
    """Rows (id, text) with next_text, the text of the next row by descending id.

    Each of `made`, a column made of the text, is evaluated once a row and given with that of the next row, as next_<name>.

    Keys alone are sorted first: their ranges, of about CELL_BYTES of text each, become cells, and a key's cell is
    found by bisection. Texts are shuffled once, by cell; the highest row of each cell (one a cell, a join on keys)
    is dealt to the cell above as well, so every row finds its next in its own cell.
    """
    keyed = docs.select("id", "text", place(F.col("id"), F.col("text")).alias("at"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    cells = max(shuffle_partitions(docs), -(-size // CELL_BYTES))
    ranges = keyed.select("at").repartitionByRange(cells, "at").groupBy(F.spark_partition_id().alias("part")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    ranges = sorted(ranges.select("lo", "hi").collect())  # a row a cell
    if not ranges:
        return docs.select("id", "text", *[c.alias(n) for n, c in made.items()], *[c.alias(f"next_{n}") for n, c in ({"text": F.col("text")} | made).items()])
    cell = count_below([tuple(r.lo) for r in ranges[1:]], F.col("at"))
    rows = keyed.select("id", "text", "at", cell.alias("cell"), F.lit(True).alias("own"))
    # the highest row of a cell comes after the lowest of the cell above; that of the highest after the lowest of all
    tops = docs.sparkSession.createDataFrame([(r.hi.known, r.hi.id, r.hi.hash, (i + 1) % len(ranges), i + 1 == len(ranges)) for i, r in enumerate(ranges)], "known boolean, top long, hash long, above int, last boolean")
    same = (F.col("id").isNotNull() == F.col("known")) & (F.coalesce("id", F.lit(0).cast("long")) == F.col("top")) & (F.xxhash64("text") == F.col("hash"))
    heads = docs.join(F.broadcast(tops), same).groupBy("above", "known", "top", "hash").agg(F.first("text").alias("text"))
    lowest = F.struct(F.lit(False).alias("known"), F.lit(-(2**63)).alias("id"), F.lit(-(2**63)).alias("hash"), F.lit(-1).cast("long").alias("row"))
    heads = heads.select(F.lit(None).cast("long").alias("id"), "text", lowest.alias("at"), F.col("above").alias("cell"), F.lit(False).alias("own"))
    down = F.col("at").desc()
    # texts alone are sorted; what is made of them is made of sorted rows, whose order the window keeps
    dealt = rows.unionByName(heads).repartition(len(ranges), "cell").sortWithinPartitions("cell", down)
    dealt = dealt.select("id", "text", "at", "cell", "own", *[c.alias(n) for n, c in made.items()])
    by = Window.partitionBy("cell").orderBy(down)
    return dealt.select("id", "text", "own", *made, *[F.lead(n).over(by).alias(f"next_{n}") for n in ("text", *made)]).filter("own").drop("own")


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, fingerprint (string) and marks (its anchors) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), anchors(F.coalesce(F.col(text_col), F.lit(""))).alias("marks")).withColumn("fingerprint", spelled(F.col("marks")))


def compared_with_next(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses to the edited and to the next text."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    rows = with_next(base, marks=packed(anchors(F.col("text")))).select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "marks", "next_marks")

    def row(m):
        own, other, after = (m[x] for x in ("own", "edited", "next"))
        return F.struct(spelled(own).alias("fingerprint"), spelled(other).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"), likeness(own, after).alias("near_next"))

    all_ = F.struct(unpacked(F.col("marks")).alias("own"), anchors(F.col("edited")).alias("edited"), unpacked(F.col("next_marks")).alias("next"))
    found = rows.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), let(all_, row).alias("f"))
    return found.select("doc_id", "n_chars", "edited_sha256", "f.fingerprint", "f.edited_fingerprint", "f.near_edited", "f.near_next")
