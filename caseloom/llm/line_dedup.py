"""Line dedup: an exact set-similarity join of all lines, later matches removed.

A line's set is its distinct words.  Two lines match if 100 times the shared words are at least ``percent`` times
the words of either.  A line goes if any earlier line (smaller doc_id, or the same document and an earlier line)
matches it; matches are judged on the input.  Words are ordered by rarity (a class of corpus count, then hash).

1. Lines with equal sets are collapsed to the first of them, so a line repeated everywhere is one row.
2. Leaders: lines of equal size that share one of their rarest words are compared with the first of them.  Families
   of variants end here with one comparison a member.
3. Lines still standing meet all earlier lines that share a prefix word, under the length filter, the positional
   filter and a bound from a parity signature (each differing word flips at most one bit): 64 bits, and 256 for long
   lines, of which 64 bits say nothing.  All of it is judged where the words meet, so no false candidate is moved.
4. What is left is verified on the words, the first candidate of a line before its others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm import shared
from caseloom.session import cut_lineage, shuffles_released

PERCENT = 80
#: Bits of a place in the rarity table and bits of the candidate table, both fixed bounds of what tasks are sent.
RARITY_BITS = 18
CANDIDATE_BITS = 1 << 20
#: Rarest words of a line by which leaders are sought.
LEADING = 3
#: Words from which a line carries a signature of 256 bits; shorter ones carry nulls.
LONG = 48
WIDE = ["s1", "s2", "s3"]


def _lines(docs: DataFrame, id_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("doc").isNotNull())
    return rows.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "l"))


def _words(text: Column) -> Column:
    """Array of the words of a text; only texts with other white space than blanks and line ends pass a pattern."""
    other = F.lit(False)
    for c in "\t\n\x0b\x0c\r":
        other = other | F.contains(text, F.lit(c))
    return F.when(other, shared.words_expr(text)).otherwise(F.array_remove(F.split(F.coalesce(text, F.lit("")), " "), ""))


def _rarity(docs: DataFrame) -> Column:
    """Array by the top bits of a word's hash: its class of corpus count, crossed with the top byte of the hash."""
    words = docs.select(F.explode(shared.words_expr(F.col("text").cast("string"))).alias("w"))
    words = words.select(F.shiftrightunsigned(F.xxhash64("w"), 64 - RARITY_BITS).alias("slot"))
    classes = shared.log_classes(words, "slot", 1 << RARITY_BITS)
    # Half of the class: the top bit is the sign, and the most frequent words must come last.
    crossed = ",".join(str(c >> 1 ^ slot >> (RARITY_BITS - 8)) for slot, c in enumerate(classes))
    return F.from_json(F.lit(f"[{crossed}]"), "array<bigint>")  # of constants, so it is read once


def _sets(docs: DataFrame, id_col: str, percent: int) -> DataFrame:
    """First line of each distinct set: ``doc, line, n``, signatures and the prefix words in order of rarity."""
    with shuffles_released(docs.sparkSession):
        rarity = _rarity(docs)
    rows = _lines(docs, id_col).select("doc", "line", F.array_distinct(F.transform(_words(F.col("l")), lambda w: F.xxhash64(w))).alias("h"))
    rows = rows.filter(F.size("h") > 0)

    def ranked(h: Column) -> Column:
        # The class takes the place of the top byte.  Words that differ in nothing else meet as one: more candidates, none lost.
        slot = F.shiftrightunsigned(h, 64 - RARITY_BITS).cast("int")
        return h.bitwiseXOR(F.shiftleft(F.coalesce(F.get(rarity, slot), F.lit(0).cast("long")), 56))

    part = "if(n < {0}, null, aggregate(h, 0L, (a, x) -> if((x & 192) = {1}, a ^ shiftleft(1L, cast(x & 63 as int)), a))) AS s{2}"
    rows = rows.withColumn("n", F.size("h")).select(
        "doc",
        "line",
        "n",
        F.expr("aggregate(h, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))").alias("sig"),
        *[F.expr(part.format(LONG, 64 * k, k)) for k in (1, 2, 3)],
        F.sort_array(F.transform("h", ranked)).alias("t"),
    )
    rows = rows.withColumn("prefix", F.expr(f"slice(t, 1, n - cast(ceil({percent} * n / 100) as int) + 1)"))
    rows = rows.withColumn("all", F.xxhash64("t")).drop("t")
    names = ["n", "sig", *WIDE, "prefix"]
    return rows.groupBy("all", *names).agg(F.min(F.struct("doc", "line")).alias("at")).select("at.*", *names)


def _may_match(a: str, b: str, percent: int) -> Column:
    """Length, positional and signature bounds for rows with columns n, i (place in the prefix), sig and the wide parts."""
    need = f"ceil({percent} * ({a}.n + {b}.n) / {100 + percent})"
    most = f"{a}.n + {b}.n - 2 * {need}"
    # All four parts of a signature of 256 bits make up the one of 64 bits.
    first = " ^ ".join(f"{x}.{c}" for x in (a, b) for c in ["sig", *WIDE])
    apart = " + ".join([f"bit_count({first})", *[f"bit_count({a}.{c} ^ {b}.{c})" for c in WIDE]])
    return F.expr(
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
        f" AND 1 + least({a}.n - {a}.i, {b}.n - {b}.i) >= {need}"
        f" AND bit_count({a}.sig ^ {b}.sig) <= {most} AND coalesce({apart} <= {most}, true)"
    )


def _close(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose word sets match."""
    earlier = texts.select(F.col("doc").alias("doc0"), F.col("line").alias("line0"), F.col("words").alias("words0"))
    both = pairs.join(texts, ["doc", "line"]).join(earlier, ["doc0", "line0"])
    common = F.size(F.array_intersect("words", "words0"))
    matched = both.filter(100 * common >= percent * (F.size("words") + F.size("words0") - common))
    return matched.select("doc", "line", "doc0", "line0")


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, percent: int) -> DataFrame:
    """Lines (doc, line) of pairs (doc, line, doc0, line0) whose word sets match; only the lines of pairs are fetched."""
    ends = pairs.select("doc", "line").unionByName(pairs.select(F.col("doc0").alias("doc"), F.col("line0").alias("line")))
    ends = ends.withColumn("h", F.xxhash64("doc", "line"))
    with shuffles_released(docs.sparkSession):
        bits = shared.bit_table(ends, "h", CANDIDATE_BITS)
    texts = _lines(docs, id_col).withColumn("h", F.xxhash64("doc", "line")).filter(shared.maybe_in(bits, "h"))
    texts = texts.join(ends.select("doc", "line").distinct(), ["doc", "line"], "left_semi").dropDuplicates(["doc", "line"])
    texts = cut_lineage(texts.select("doc", "line", F.array_distinct(_words(F.col("l"))).alias("words")))
    # One earlier line settles most; only lines that it leaves standing meet their other candidates.
    first = pairs.groupBy("doc", "line").agg(F.min(F.struct("doc0", "line0")).alias("at")).select("doc", "line", "at.*")
    settled = cut_lineage(_close(first, texts, percent).select("doc", "line"))
    rest = pairs.join(settled, ["doc", "line"], "left_anti").join(first, ["doc", "line", "doc0", "line0"], "left_anti")
    late = _close(rest, texts, percent).select("doc", "line").distinct()
    return cut_lineage(settled.unionByName(late), texts, pairs, settled)


def surviving_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id") -> DataFrame:
    """``doc, line`` of every line with a word that no earlier line matches."""
    sets = cut_lineage(_sets(docs, id_col, percent))
    # Leaders among the rarest words only: what they miss is met below.
    ranked = F.posexplode(F.slice("prefix", 1, LEADING)).alias("i", "t")
    led = sets.select("doc", "line", "n", "sig", *WIDE, ranked).withColumn("i", F.col("i") + 1)
    led = led.withColumn("first", F.expr("min(struct(doc, line, n, i, sig, s1, s2, s3)) OVER (PARTITION BY t, n)"))
    led = led.filter((F.col("first.doc") != F.col("doc")) | (F.col("first.line") != F.col("line")))
    led = led.alias("b").filter(_may_match("b", "first", percent))
    led = led.select("doc", "line", F.col("first.doc").alias("doc0"), F.col("first.line").alias("line0"))
    gone = _verified(cut_lineage(led.distinct()), docs, id_col, percent)

    open_ = sets.join(gone.withColumn("open", F.lit(0)), ["doc", "line"], "left").withColumn("open", F.coalesce("open", F.lit(1)))
    rows = open_.select("doc", "line", "n", "sig", *WIDE, "open", F.posexplode("prefix").alias("i", "t")).withColumn("i", F.col("i") + 1)
    dealt = rows.repartition("t")
    # The shorter of two sets needs a shorter prefix; equal sizes need it on both sides.
    short = f"ceil({2 * percent} * {{0}}.n / {100 + percent})"
    either = F.expr(
        f"(a.n <= b.n AND a.i <= a.n - {short.format('a')} + 1) OR (b.n <= a.n AND b.i <= b.n - {short.format('b')} + 1)"
    )
    order = F.expr("a.doc < b.doc OR (a.doc = b.doc AND a.line < b.line)")
    # A predicate of all columns of both sides, so that one dealing of the rows serves both.
    standing = F.expr("b.open * (a.i + a.open) > 0")
    pairs = dealt.alias("a").join(dealt.alias("b"), F.expr("a.t = b.t") & standing & order & either & _may_match("a", "b", percent))
    pairs = pairs.select("b.doc", "b.line", F.expr("a.doc AS doc0"), F.expr("a.line AS line0"))
    more = _verified(cut_lineage(pairs.distinct()), docs, id_col, percent)
    both = gone.unionByName(more).distinct()
    return cut_lineage(sets.select("doc", "line").join(both, ["doc", "line"], "left_anti"), sets, gone, more)


def dedup_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id") -> DataFrame:
    """Documents with matched later lines cut from ``text``, and ``n_removed_lines``; all columns pass through.

    Null and empty texts, blank lines and documents without an id stay as they are.  Rows repeated with one
    id keep the same lines.  An empty table stays empty.  Columns may have any names; one named ``n_removed_lines`` is
    replaced.
    """
    doc, bits, cut, stay_ = shared.unused(docs, "_doc", "_kept", "_lines", "_stay")
    kept = (
        surviving_lines(docs, percent, id_col)
        .groupBy("doc", F.expr("cast(line div 64 as int)").alias("block"))
        .agg(F.expr("bit_or(shiftleft(1L, line % 64))").alias("bits"))
        .groupBy(F.col("doc").alias(doc))
        .agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias(bits))
    )
    rows = docs.join(kept, F.col(id_col).cast("long") == F.col(doc), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    rows = rows.withColumn(cut, lines)
    stay = F.expr(
        f"filter({cut}, (l, i) -> not l rlike '[^\\\\x20\\\\x09-\\\\x0D]'"
        f" or (shiftright(coalesce(try_element_at({bits}, cast(i div 64 as int)), 0L), i % 64) & 1L) = 1L)"
    )
    rows = rows.withColumn(stay_, F.when(F.col(id_col).isNull(), F.col(cut)).otherwise(stay))
    removed = F.coalesce(F.size(cut) - F.size(stay_), F.lit(0)).cast("long")
    text = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.array_join(stay_, "\n"))
    columns = [text.alias(c) if c == "text" else docs[c] for c in docs.columns if c != "n_removed_lines"]
    return rows.select(*columns, removed.alias("n_removed_lines"))
