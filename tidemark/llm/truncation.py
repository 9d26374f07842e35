"""Texts cut off by field limits or in mid-transfer, in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import cut

_NAME = r" \p{Lu}[\p{Ll}\p{M}][\p{L}\p{M}'’\-]*"
#: Steps that make a text into lines, of sentences with NEXT between them, of words: numbers as 0, each Han character a
#: word, words with a capital as N but for the first of a sentence; marks stay at their words. No step looks around its
#: match, so every regular expression engine runs them.
NEXT = "\x01"
STEPS = (
    (r"[0-9]+(?:[.,/\-\x{A0}\x{202F} ][0-9]+)*", "0"),
    (r"([\x{2E80}-\x{9FFF}\x{FF01}-\x{FF60}]) *", "$1 "),
    (r"([.。][\"”]?|[_=~*#]{4,}) +([^0-9a-z\s])", f"$1 {NEXT}$2"),
    (rf"{_NAME}(?:{_NAME})*", " N"),
    (r"[\t\x{A0}\x{200B}\x{FEFF}\x{FFFD}]+", " "),
)
BREAK = r"[\r\n]+"
#: How a sentence closes.
CLOSED = r"[.。!?][\")”]*$"
#: A mark that is put behind a break: no letters or in brackets, on its own or at the last word.
SET_APART, AT_WORD = r"^[^\p{L}\p{N}]+$|^[(\[].*[)\]]$", r"(\.\.\.|…)$"
#: What this share of texts (and at least two) end with is known as an ending ...
KNOWN = 3e-4
#: ... if that is this share of all its occurrences (page numbers are found inside of texts, too) ...
AT_ENDS = 0.01
#: ... and for a mark, this share.
MARK_AT_ENDS = 0.5
#: A trigram is frequent if it goes on this often, and almost never terminal if at most this share of it ends.
FREQUENT, TERMINAL = 10, 0.03
#: The broken part of a word is looked for among the first parts of words, up to this many characters.
PART = 40


def endings(docs: DataFrame, key: str, text: str, extra: list[str]) -> DataFrame:
    """(key, extra, lines) of every text that isn't null: its lines after STEPS, without empty ones."""
    t = F.col(text)
    for pattern, to in STEPS:
        t = F.regexp_replace(t, pattern, to)
    lines = F.filter(F.transform(F.split(t, BREAK), lambda x: F.trim(x)), lambda x: x != "")
    return docs.where(F.col(text).isNotNull()).select(key, *extra, lines.alias("lines"))


def _sentences(line: Column) -> Column:
    return F.split(line, f" ?{NEXT}")


def sentence_counts(ends: DataFrame) -> DataFrame:
    """s, closes (it is the last of a line), c: equal sentences are counted before anything is done with their words."""
    s = ends.select(F.explode("lines").alias("line")).select(_sentences(F.col("line")).alias("s")).select(F.size("s").alias("k"), F.posexplode("s").alias("i", "s"))
    return s.groupBy("s", (F.col("i") == F.col("k") - 1).alias("closes")).agg(F.count("*").alias("c"))


def _words(s: Column) -> Column:
    return F.split(F.concat(F.lit("<s> <s> "), s), " +")


def trigrams(counted: DataFrame) -> DataFrame:
    """before (two words, each with a space behind; <s> where there is none), word, c (occurrences), e (those at the end
    of a line that closes with a full stop). counted: s, closes, c."""
    w = counted.select("c", F.when(F.col("closes") & F.col("s").rlike(CLOSED), F.col("c")).otherwise(0).alias("e"), _words(F.col("s")).alias("w"))
    at = w.select("c", "e", "w", F.explode(F.sequence(F.lit(3), F.size("w"))).alias("j"))
    word = lambda k: F.element_at("w", F.col("j") - k)
    g = at.select(F.concat(word(2), F.lit(" "), word(1), F.lit(" ")).alias("before"), word(0).alias("word"), "c", F.when(F.col("j") == F.size("w"), F.col("e")).otherwise(0).alias("e"))
    return g.groupBy("before", "word").agg(F.sum("c").alias("c"), F.sum("e").alias("e"))


def _shorter(grams: DataFrame, *sums: str) -> DataFrame:
    """n (3, 2, 1), before, word: the trigrams, and their last two words and last word, summed up."""
    second = F.concat(F.element_at(F.split("before", " "), 2), F.lit(" "))
    forms = F.array(*[F.struct(F.lit(n).alias("n"), b.alias("before")) for n, b in ((3, F.col("before")), (2, second), (1, F.lit("")))])
    return grams.select(F.explode(forms).alias("x"), "word", *sums).groupBy("x.n", "x.before", "word").agg(*[F.sum(c).alias(c) for c in sums])


def lines_behind(ends: DataFrame, least: Column) -> DataFrame:
    """k: lines that recur at the ends of texts. At most 1 / KNOWN of them, however large the corpus."""
    last = ends.groupBy(F.try_element_at("lines", F.lit(-1)).alias("k")).agg(F.count("*").alias("e")).where(F.col("e") >= least)
    inside = ends.select(F.explode("lines").alias("line")).join(F.broadcast(last), F.col("line") == F.col("k")).groupBy("k").agg(F.count("*").alias("c"), F.first("e").alias("e"))
    return inside.where(F.col("e") >= AT_ENDS * F.col("c")).select("k")


def closing_sentences(finals: DataFrame, counted: DataFrame, least: Column) -> DataFrame:
    """k: sentences that recur at the ends of texts and mostly aren't the beginning of longer ones; at most 1 / KNOWN."""
    some = finals.groupBy(F.col("s").alias("k")).agg(F.count("*").alias("e")).where(F.col("e") >= least)
    word = F.substring_index("k", " ", -1)
    some = some.select("k", "e", word.alias("k_word"), F.left("k", F.length("k") - F.length(word)).alias("k_before"))
    heads = counted.select("s", "c", F.split("s", " +").alias("w")).select("s", "c", "w", F.posexplode("w").alias("i", "word"))
    heads = heads.select("s", "c", "word", F.when(F.col("i") == 0, "").otherwise(F.concat(F.array_join(F.slice("w", F.lit(1), F.col("i")), " "), F.lit(" "))).alias("before"))
    met = heads.join(F.broadcast(some), (F.col("before") == F.col("k_before")) & F.startswith("word", "k_word"))
    same = F.col("s") == F.col("k")
    judged = met.groupBy("k").agg(F.first("e").alias("e"), F.sum(F.when(same, F.col("c")).otherwise(0)).alias("c"), F.sum(F.when(same, 0).otherwise(F.col("c"))).alias("longer"))
    return judged.where((F.col("e") >= AT_ENDS * F.col("c")) & (F.col("longer") < F.col("e"))).select("k")


def evidence(finals: DataFrame, grams: DataFrame) -> DataFrame:
    """before, word, cut: what is known of each last trigram; finals: before, word, ends (texts that end so).

    c and e count the trigram, `longer` the same words before a longer word that begins with the last one. Where all
    three are rare the last two words are looked up instead, then the last.
    """
    f = finals.groupBy("before", "word").agg(F.sum("ends").alias("ends"))
    asked = _shorter(f, "ends")
    all_ = _shorter(grams, "c", "e")
    upto = F.sequence(F.lit(1), F.least(F.length("word"), F.lit(PART)))
    heads = all_.select("n", "before", "c", "e", F.explode(F.transform(upto, lambda k: F.struct(F.left("word", k).alias("word"), (k == F.length("word")).alias("whole")))).alias("h"))
    far = all_.where(F.length("word") > PART).select("n", "before", "c", "e", F.struct("word", F.lit(True).alias("whole")).alias("h"))
    h = heads.union(far).groupBy("n", "before", "h.word").agg(*[F.sum(F.when(F.col("h.whole"), F.col(c)).otherwise(0)).alias(c) for c in ("c", "e")], F.sum(F.when(F.col("h.whole"), 0).otherwise(F.col("c"))).alias("longer"))
    known = asked.join(h, ["n", "before", "word"], "left").select("n", "before", "word", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ends", "c", "e", "longer")])
    closed = F.col("word").rlike(CLOSED)
    end = F.when(closed, F.greatest("e", "ends")).otherwise(F.col("e") + F.col("ends")) - 1  # but for one text's own
    k = known.withColumn("end", end).withColumn("on", F.greatest(F.col("c") - F.col("end") - 1, F.lit(0)) + F.col("longer"))
    k = k.select("n", "before", "word", (F.col("on") + F.col("end") >= FREQUENT).alias("some"), ((F.col("on") >= FREQUENT) & (F.col("end") <= TERMINAL * (F.col("on") + F.col("end")))).alias("cut"))
    of = lambda n: k.where(F.col("n") == n).select(*[F.col(c).alias(f"{c}_{n}") for c in ("before", "word", "some", "cut")])
    second = F.concat(F.element_at(F.split("before_3", " "), 2), F.lit(" "))
    j = of(3).join(of(2), (second == F.col("before_2")) & (F.col("word_3") == F.col("word_2")), "left").join(of(1), F.col("word_3") == F.col("word_1"), "left")
    return j.select(F.col("before_3").alias("k_before"), F.col("word_3").alias("k_word"), F.when(F.col("some_3"), F.col("cut_3")).when(F.col("some_2"), F.col("cut_2")).otherwise(F.coalesce("cut_1", F.lit(False))).alias("cut"))


def truncated(ends: DataFrame, key: str, extra: list[str]) -> DataFrame:
    """(key, extra, cut) for every text of `ends` (a written table, for it is read again).

    Lines that recur at the ends of texts are taken off, and so are marks set behind a break. A text that then ends with
    a sentence known as an ending is whole. Of the others the last trigram counts: a text is cut if the trigram is
    frequent inside of texts but almost never terminal, that is, at the end of a text or of a line that closes with a full
    stop; a longer word in place of the last counts as going on, so a text that stops in mid-word is cut. A trigram that
    is too rare is judged by its last two words, then by the last. What nothing is known of counts as whole, and so does a
    text of nothing but such lines. An empty text and a blank one aren't judged and give no row.
    """
    ends = ends.where("size(lines) > 0")
    least = F.greatest(F.lit(2.0), KNOWN * ends.agg(F.count("*")).scalar())
    counted = cut(sentence_counts(ends), "sentences")
    grams = cut(trigrams(counted), "trigrams")
    behind = lines_behind(ends, least).agg(F.collect_list("k")).scalar()
    line = F.coalesce(F.try_element_at(F.filter("lines", lambda x: ~F.array_contains("behind", x)), F.lit(-1)), F.element_at("lines", -1))
    body = cut(ends.withColumn("behind", behind).select(key, *extra, F.split(F.regexp_replace(line, AT_WORD, " $1"), " +").alias("w")), "last-lines")
    bare = lambda x: F.translate(x, NEXT, "")
    last = body.select(bare(F.element_at("w", -1)).alias("k")).where(F.col("k").rlike(SET_APART)).groupBy("k").agg(F.count("*").alias("e")).where(F.col("e") >= least)
    inside = last.join(grams.groupBy(F.col("word").alias("k")).agg(F.sum("c").alias("c")), "k", "left")
    marks = inside.where(F.col("e") >= MARK_AT_ENDS * F.coalesce("c", F.lit(0))).agg(F.collect_list("k")).scalar()
    kept = F.array_max(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.when(~F.array_contains("marks", bare(F.element_at("w", i))), i)))
    s = F.element_at(_sentences(F.array_join(F.slice("w", F.lit(1), F.coalesce(kept, F.size("w"))), " ")), -1)
    finals = body.withColumn("marks", marks).select(key, *extra, s.alias("s")).withColumn("w", _words(F.col("s"))).select(key, *extra, "s", F.concat(F.element_at("w", -3), F.lit(" "), F.element_at("w", -2), F.lit(" ")).alias("before"), F.element_at("w", -1).alias("word"))
    finals = cut(finals, "finals")
    whole = closing_sentences(finals, counted, least)
    left = finals.join(F.broadcast(whole), F.col("s") == F.col("k"), "left")
    told = evidence(finals.select("before", "word", F.lit(1).alias("ends")), grams)
    out = left.join(told, (F.col("before") == F.col("k_before")) & (F.col("word") == F.col("k_word")), "left")
    return out.select(key, *extra, (F.col("k").isNull() & F.coalesce("cut", F.lit(False))).alias("cut"))
