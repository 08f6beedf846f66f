"""Line dedup by deletion neighbourhoods.

Lines are compared trimmed and in lower case; blank ones are left alone. Two lines are near copies if one run of symbols
stands in each where they differ, and all else is equal: symbols are words, and a run has at most a fifth of its line's
words and at most three; symbols are characters too, and a run has one at most. Either takes lines of five symbols or more.
So one character, or one to three neighbouring words, may be replaced, added or missing, wherever they stand, in lines of any
length. In lines of ten words or more two words are a fifth, so that what is one character apart is a run of words apart as
well; characters are therefore looked at in shorter lines, and in those of up to CHARS characters. That is the edit bound: near copies
within it are all found, whatever the length of the lines, and others are not sought. A line goes if an earlier one (by
document id, hash of the text, place) is a copy or a near copy of it, even if that one goes as well.

Of near copies one half is equal, as a run cannot reach into both. Each distinct line gives out hashes of its first and of
its last symbols, a little less than half of them (Spark counts who shares one), and only lines that share a half go on.
Those emit as hashed keys all their variants with one run taken out, each with the place where it stood; lines are near
copies if and only if they have such a key in common, and all lines of a key are near copies of each other. It is
therefore enough to hold each against the key's earliest line: no pairs within a key are formed, however many lines have
it. Hashes of what stands before and after each place come from running sums, so that the work for a line grows with its
length alone. What shares a key is at last compared as text: all symbols outside the two runs.

DataFrame functions only. What is shuffled are keys and places, and of texts only the lines that share a half.

Defined results: a null text has no lines and stays null; blank lines stay; rows of one id and text are one document whose
lines are kept or go alike; rows that share an id alone are documents of their own; a null id comes before all others; an
empty table gives an empty table; other columns are kept by dedup_lines, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, need, sent_if_small, written

#: Symbols of a run: one in SHARE of the line's, at most MOST words or one character; characters up to which a line is
#: compared by characters as well, whatever its words.
SHARE, MOST, CHARS = 5, 3, 64
PLACE = ["id", "th", "line"]


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(id, th, line, key) of lines that are not blank. docs: (id, th, text)."""
    lines = docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return lines.select(*PLACE, F.trim(F.lower("raw")).alias("key")).where("key <> ''")


def with_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return need(docs, id_col, text_col).toDF("id", "text").withColumn("th", F.xxhash64("text"))


#: Symbols of a run at most, by kind of symbol: words, characters.
RUNS = (MOST, 1)


def half_length(n: Column, most: int, lower: int) -> Column:
    """Half of what a line of about n symbols has without a run. Near copies, whose numbers of symbols differ by a run at
    most, share the first or the last so many. Numbers are rounded down to a multiple of most + 1 (and once more, if
    `lower`), so that two that are near have one of two in common; null if there is none."""
    rounded = F.floor(n / (most + 1)).cast("int") * (most + 1) - lower * (most + 1)
    return F.when(rounded > 0, F.greatest(F.shiftright(rounded - most, 1), F.lit(1)))


def with_halves(lines: DataFrame) -> DataFrame:
    """lines (with key), n0 and n1 (words and characters) and `halves`: hashes of first and last symbols, at place
    4 * kind + 2 * side + lower. Lengths are columns of their own, so that none is worked out again where it is used."""
    spaces = F.octet_length("key") - F.octet_length(F.replace("key", F.lit(" "), F.lit("")))
    rows = lines.withColumns({"n0": spaces + 1, "n1": F.length("key")})
    used = F.col("n0") >= SHARE, (F.col("n1") >= SHARE) & ((F.col("n1") <= CHARS) | (F.col("n0") < 2 * SHARE))
    rows = rows.withColumns({f"h{k}{low}": F.when(used[k], half_length(F.col(f"n{k}"), most, low)) for k, most in enumerate(RUNS) for low in (0, 1)})
    # Words are taken as text, as splitting a line costs more than all else here.
    first = ("substring_index(key, ' ', h)", "substring(key, 1, h)")
    last = ("substring_index(key, ' ', -h)", "substring(key, n1 - h + 1, h)")
    # Lambdas, as a plain array of eight hashes makes one method too long for the JVM to compile.
    each = [f"transform(array(h{k}0, h{k}1), h -> if(h is null, null, xxhash64({k}, {side}, h, {part[k]})))" for k in (0, 1) for side, part in enumerate((first, last))]
    return rows.withColumn("halves", F.expr(f"concat({', '.join(each)})")).drop("h00", "h01", "h10", "h11")


def shown_halves(distinct: DataFrame) -> DataFrame:
    """(a, id, th, line, kind, at, h): at tells how many symbols, below zero for the last ones."""
    rows = distinct.select("a", "first.*", "n0", "n1", F.posexplode("halves").alias("pos", "h")).where("h is not null")
    at = F.lit(None).cast("int")
    for pos in range(8):
        kind, low = pos // 4, pos % 2
        length = half_length(F.col(f"n{kind}"), RUNS[kind], low)
        at = F.when(F.col("pos") == pos, -length if pos // 2 % 2 else length).otherwise(at)
    return rows.select("a", *PLACE, F.floor(F.col("pos") / 4).cast("int").alias("kind"), at.alias("at"), "h")


def variants(some: DataFrame) -> DataFrame:
    """Keys of all variants with a run taken out (a run of none included), and the place p and what is left behind it,
    q. some: (id, th, line, kind, a, symbols, head, tail), a line's rows in one task."""
    line = Window.partitionBy("a", *PLACE, "kind")
    before = line.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.least(F.floor(F.size("symbols") / SHARE).cast("int"), F.when(F.col("kind") == 0, RUNS[0]).otherwise(RUNS[1]))
    # One place more, behind the last symbol.
    each = some.select("a", *PLACE, "kind", "head", "tail", F.size("symbols").alias("n"), reach.alias("reach"), F.posexplode(F.concat("symbols", F.array(F.lit(None).cast("string")))).alias("k", "symbol"))
    zero = F.lit(0).cast("long")
    hashed = lambda place: F.when(F.col("k") < F.col("n"), F.xxhash64("symbol", place)).otherwise(zero)
    each = each.withColumn("x", hashed(F.col("k"))).withColumn("y", hashed(F.col("k") - F.col("n"))).drop("symbol")
    left, gone = F.coalesce(F.bit_xor("x").over(before), zero), F.coalesce(F.bit_xor("y").over(before), zero)
    each = each.withColumn("left", left).withColumn("right", F.bit_xor("y").over(line).bitwiseXOR(gone)).drop("x", "y")
    # No more runs than are in question; the outer kind, as for the other Spark adds a filter that works them out twice.
    runs = F.array(*[F.struct(F.lit(r).alias("r"), (F.col("right") if r == 0 else F.lead("right", r).over(line.orderBy("k"))).alias("right")) for r in range(MOST + 1)])
    runs = F.slice(runs, F.lit(1), F.col("reach") + 1)
    rows = each.withColumn("runs", runs).select("a", *PLACE, "kind", "head", "tail", "n", "k", "left", F.explode_outer("runs").alias("run"))
    q = F.col("n") - F.col("k") - F.col("run.r")
    rows = rows.where(q >= 0).withColumn("q", q)
    # A run lies outside the half that is shared.
    rows = rows.where((F.col("k") >= F.col("head")) | (F.col("q") >= F.col("tail")))
    return rows.select(F.xxhash64("kind", "k", "q", "left", "run.right").alias("v"), "a", *PLACE, "kind", F.col("k").alias("p"), "q")


def same_line(a: str, b: str) -> Column:
    return F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in PLACE))


def near_copies(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id, th, line, first) of lines with an earlier near copy. distinct: (a, first, n0, n1, halves) of each distinct
    line."""
    shown = shown_halves(distinct)
    shared = shown.groupBy("h").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("h")
    found = shown.join(sent_if_small(written(shared, "shared-halves")), "h", "left_semi")
    length = lambda side: F.min(F.when(side, F.abs("at")))
    going = written(found.groupBy("a", *PLACE, "kind").agg(length(F.col("at") > 0).alias("head"), length(F.col("at") < 0).alias("tail")), "lines-that-share")
    # Hashes alone are sent to every executor, as the driver holds what is sent, and rows take far more; what hashes let
    # through besides goes in the join by place. As a struct, as a null id is an id.
    holders = sent_if_small(going.select(F.xxhash64("id", "th").alias("hash")).distinct())
    some = docs.join(holders, F.xxhash64("id", "th") == F.col("hash"), "left_semi")
    places = sent_if_small(going.select(F.xxhash64(*PLACE).alias("hash")).distinct())
    texts = numbered_lines(some).join(places, F.xxhash64(*PLACE) == F.col("hash"), "left_semi")
    texts = texts.select(F.struct(*PLACE).alias("place"), "key").alias("t").join(going.withColumn("place", F.struct(*PLACE)).alias("g"), F.expr("t.place = g.place"))
    symbols = F.when(F.col("kind") == 0, F.split("key", " ")).otherwise(F.split("key", ""))
    some = texts.select("g.place", *[f"g.{c}" for c in PLACE], "kind", "a", "head", "tail", symbols.alias("symbols"))
    some = written(some.dropDuplicates(["place", "kind"]).drop("place"), "lines-with-symbols")  # of rows of one id and text
    keys = variants(some.repartition("a"))
    met = keys.groupBy("v").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("v")
    hits = written(keys.join(sent_if_small(written(met, "shared-variants")), "v"), "hits")
    firsts = hits.groupBy("v").agg(F.min(F.struct(*PLACE)).alias("first"))
    pairs = hits.join(firsts, "v").where(F.struct(*PLACE) > F.col("first")).select(*PLACE, "kind", "p", "q", "first").distinct()
    # Compared as text: what stands before and behind the runs.
    own, other = some.select(*PLACE, "kind", "symbols").alias("a"), some.select(*PLACE, "kind", "symbols").alias("b")
    joined = pairs.alias("n").join(own, same_line("n", "a") & F.expr("n.kind = a.kind")).join(other, F.expr(" and ".join(f"n.first.{c} <=> b.{c}" for c in PLACE) + " and n.kind = b.kind"))
    end = lambda t: f"slice({t}.symbols, size({t}.symbols) - n.q + 1, n.q)"
    equal = joined.where(f"slice(a.symbols, 1, n.p) = slice(b.symbols, 1, n.p) and {end('a')} = {end('b')}")
    return equal.groupBy(*[F.col(f"n.{c}").alias(c) for c in PLACE]).agg(F.min("n.first").alias("first"))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, line, first): each line that goes, and the place of the earliest line that it is a copy of; th is a
    hash of the document's text."""
    docs = with_hash(docs, id_col, text_col)
    # Equal lines by two independent hashes.
    lines = with_halves(numbered_lines(docs)).select(*PLACE, F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"), F.struct("n0", "n1", "halves").alias("half"))
    lines = written(lines, "lines")
    distinct = lines.groupBy("a", "b").agg(F.min(F.struct(*PLACE, "half")).alias("m"), F.count("*").alias("n"))
    distinct = written(distinct.select("a", "b", F.struct(*[f"m.{c}" for c in PLACE]).alias("first"), "m.half.*", "n"), "distinct-lines")
    repeated = sent_if_small(distinct.where("n > 1").select("a", "b", "first"))
    same = lines.select(*PLACE, "a", "b").join(repeated, ["a", "b"]).where(F.struct(*PLACE) > F.col("first")).select(*PLACE, "first").distinct()
    near = near_copies(docs, distinct.select("a", "first", "n0", "n1", "halves"))
    return same.union(near)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, dropped): the places of the lines that go, for documents that lose any."""
    gone = duplicate_lines(docs, id_col, text_col).groupBy("id", "th").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    gone = written(gone, "dropped")
    # As many as a narrow table's rows, however they are spread over documents.
    return sent_if_small(gone, size=F.size("dropped") + 4)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines and dropped lines (their places, from 0) of every document."""
    rows = with_hash(docs, id_col, text_col)
    lines = rows.select("id", "th", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = lines.alias("l").join(dropped_lines(docs, id_col, text_col).alias("g"), F.expr("l.id <=> g.id and l.th = g.th"), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select(F.col("l.id").alias(id_col), "n_lines", F.size(dropped).cast("long").alias("n_dropped"), F.array_join(dropped, ",").alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the repeated lines. Documents of which nothing but blank lines is left go; others keep all their
    columns, with the shorter text."""
    key, hashed, gone = (free_name(docs, n) for n in ("_id", "_th", "_gone"))
    dropped = dropped_lines(docs, id_col, text_col).toDF(key, hashed, gone)
    text = F.col(f"`{text_col}`")
    marked = docs.join(dropped, F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(hashed)), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")
    marked = marked.withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(kept))
    return marked.where(F.col(gone).isNull() | (F.trim(F.regexp_replace(text, "\n", " ")) != "")).drop(key, hashed, gone)
