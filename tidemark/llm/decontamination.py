"""Benchmark decontamination by winnowing.

Both sides are cut into words. Of the hashes of each K consecutive words, the least in every run of W - K + 1 is kept;
a span of W words that both sides share has the same least hash on both, so it is never missed. Kept hashes of the
documents are joined with those of the benchmark. Documents with a match are then read again and their hits
extended: every run of W words that a benchmark item holds, compared as text, marks its words.

Items of fewer than W words are one window each; documents are looked up for whole runs of just those lengths.

DataFrame functions only. A document's words never leave its row in the first pass; what is shuffled are matches.

Defined results: a null text, or one without words, has no words, no hits and no items; rows that share an id keep
their own results if their texts differ; repeated rows each get their row; a null id is an id; a benchmark without
words hits nothing; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, need, sent_if_small, written

#: Words of a window and of a hashed gram.
WINDOW, GRAM = 10, 5
#: What separates words: everything below 0x80 that is no digit or lower-case letter.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of the benchmark up to which it is sent to every executor.
SENT_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BREAK), "")


def shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows and one more column, worked out once however often later ones use it: the optimiser would otherwise put
    its expression in each of their places."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def rolling(a: Column, length: int) -> Column:
    """An array of structs f0, f1, ... of `length` consecutive elements; none if there are fewer."""
    parts = [shifted(a, i).alias(f"f{i}") for i in range(length)]
    return F.slice(F.arrays_zip(*parts), 1, F.greatest(F.size(a) - (length - 1), F.lit(0)))


def with_prints(rows: DataFrame, length: int, out: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """rows (with `words`) and a column of the hashes to look a run of `length` words up by: winnowed ones for whole
    windows, those of each run for shorter ones."""
    want, run = (gram, window - gram + 1) if length == window else (length, 1)
    kept = rows.columns
    rows = settled(rows, "_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = settled(rows, "_grams", F.transform(rolling(F.col("_hashes"), want), lambda x: F.xxhash64(*[x[f"f{i}"] for i in range(want)])))
    least = F.col("_grams") if run == 1 else F.transform(rolling(F.col("_grams"), run), lambda x: F.least(*[x[f"f{i}"] for i in range(run)]))
    return settled(rows, out, F.array_distinct(least)).select(*kept, out)


def joined(window: str, length: int) -> Column:
    return F.concat_ws(" ", *[F.col(window)[f"f{i}"] for i in range(length)])


def tagged(n: int):
    return lambda p: F.struct(F.lit(n).alias("n"), p.alias("print"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Words, hit words and items of every document."""
    docs = need(docs, id_col, text_col).toDF("id", "text").withColumn("th", F.xxhash64("text"))
    items = need(benchmark, item_col, item_text_col).toDF("item", "text").where("text is not null")
    items = written(settled(items, "words", words_of(F.col("text"))).drop("text").where("size(words) > 0"), "items")
    lengths = sorted(r.n for r in items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect())  # `window` at most
    keys, texts = [], []
    for n in lengths:
        some = items.where(F.size("words") == n) if n < window else items.where(F.size("words") >= n)
        keys.append(with_prints(some, n, "prints", window, gram).select(F.lit(n).alias("n"), F.explode("prints").alias("print")))
        texts.append(some.select("item", F.explode(rolling(F.col("words"), n)).alias("x")).select("item", F.lit(n).alias("n"), joined("x", n).alias("window")))

    def union(frames: list[DataFrame], empty: str) -> DataFrame:
        out = docs.sparkSession.createDataFrame([], empty)
        for f in frames:
            out = f if out is None else out.unionByName(f)
        return out

    keys = sent_if_small(written(union(keys, "n int, print long").distinct(), "prints"), SENT_WINDOWS)
    texts = written(union(texts, f"item {dict(items.dtypes)['item']}, n int, window string").distinct(), "windows")
    # A window that many items hold is met once, and its items are looked up once a document.
    windows = texts.groupBy("n", "window").agg(F.xxhash64("n", "window").alias("w"), F.xxhash64(F.lit(1), "n", "window").alias("w2"))
    windows = sent_if_small(written(windows, "window-ids"), SENT_WINDOWS)
    owners = texts.select("item", F.xxhash64("n", "window").alias("w"), F.xxhash64(F.lit(1), "n", "window").alias("w2"))

    # First pass: a row for each document (n = 0) and one for each of its prints that the benchmark has.
    words = settled(docs, "words", F.coalesce(words_of(F.col("text")), F.array().cast("array<string>"))).drop("text")
    for n in lengths:
        words = with_prints(words, n, f"prints{n}", window, gram)
    prints = [F.transform(f"prints{n}", tagged(n)) for n in lengths]
    # The document's own row has a print of its own, so that where both sides are shuffled these rows spread.
    marker = F.array(F.struct(F.lit(0).alias("n"), F.xxhash64("id", "th").alias("print")))
    seen = words.select("id", "th", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(marker, *prints)).alias("x")).select("id", "th", "n_words", "x.n", "x.print")
    seen = seen.join(keys.withColumn("met", F.lit(True)), ["n", "print"], "left").where("n = 0 or met")
    seen = written(seen.select("id", "th", "n_words", F.col("n").alias("n")), "seen")
    suspects = sent_if_small(seen.where("n > 0").select("id", "th").distinct())

    # Second pass, over documents with a match: extend to whole windows.
    again = docs.alias("d").join(suspects.alias("s"), F.expr("d.id <=> s.id and d.th = s.th"), "left_semi")
    again = settled(again, "words", words_of(F.col("text"))).drop("text")
    hits = []
    for n in lengths:
        found = again.select("id", "th", F.posexplode(rolling(F.col("words"), n)).alias("at", "x")).select("id", "th", F.col("at").cast("long"), F.lit(n).alias("n"), joined("x", n).alias("window"))
        hits.append(found.join(windows, ["n", "window"]).select("id", "th", "at", "n", "w", "w2"))
    hits = written(union(hits, f"id {dict(docs.dtypes)['id']}, th long, at long, n int, w long, w2 long"), "window-hits")
    spans = hits.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"))
    named = hits.select("id", "th", "w", "w2").distinct().join(sent_if_small(owners, SENT_WINDOWS), ["w", "w2"]).groupBy("id", "th").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    per_doc = spans.alias("s").join(named.alias("i"), F.expr("s.id <=> i.id and s.th = i.th")).select("s.id", "s.th", "spans", "items")
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), lambda acc, s: F.struct(F.greatest(acc["end"], s["at"] + s["n"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), s["at"] + s["n"] - F.greatest(acc["end"], s["at"]))).alias("n")))
    per_doc = per_doc.select("id", "th", covered["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("items"))
    every = seen.where("n = 0").select("id", "th", "n_words")
    out = every.alias("e").join(per_doc.alias("p"), F.expr("e.id <=> p.id and e.th = p.th"), "left")
    return out.select(F.col("e.id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
