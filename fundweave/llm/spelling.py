"""Spelling variants by PartEnum signatures of letter multisets.

One inserted, deleted or replaced letter changes a word's multiset of letters by at most
two. As a binary vector, with a dimension for the first, second, ... occurrence of each
letter, that is a Hamming distance of at most two. PartEnum finds such vectors by exact
signatures: the dimensions are dealt into n1 parts, one of which two near vectors differ in
by at most k2 = (2 + 1) / n1 - 1, rounded up; that part is dealt into n2 parts again, of which they
agree in n2 - k2 at least. A signature is the vector on one choice of n2 - k2 parts. Words
that share a signature meet by an equi-join and are verified by their edit distance.

Scale: signatures are made of distinct frequent words only. Lists of signatures longer than
`longest` are not compared pair by pair: their words are joined on what is left of them
without one letter, a key that the words near each other share and at most an alphabet of
others has.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import join_unique, like, staged

#: What a word is made of, and how rarely a letter is dropped.
RUN, ONE_IN = "[A-Za-zÀ-ÿ]+", 97
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(word: Column, i: Column) -> Column:
    """word without its code point i, from 0."""
    return F.concat(F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word)))


def dropped_letter(doc_id: Column, run: Column, one_in: int = ONE_IN) -> Column:
    """run, without one letter where a hash of the document and the run says so."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run).cast("binary"))
    return F.when(h % one_in == 0, without(run, (h % F.length(run)).cast("int"))).otherwise(run)


def frequent_words(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, one_in: int = ONE_IN
) -> DataFrame:
    """(word, n): the words of whole texts that are long and frequent enough."""
    d = like(docs, id_col, text_col).toDF("id", "text")
    run = F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")
    # Letters are only ever dropped, so that a run that is too short leads to no word.
    runs = d.select("id", run).where(F.length("run") >= least_length)
    words = runs.select(dropped_letter(F.col("id"), F.translate("run", _UPPER, _LOWER), one_in).alias("word"))
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def with_signatures(words: DataFrame, n1: int = 1, n2: int = 7, k: int = 2) -> DataFrame:
    """words with sigs, the PartEnum signatures of each word's letters, and mask, a 64-bit picture of them.

    Two words within k share a signature, and their masks differ in k bits at most.
    """
    k2 = max(0, math.ceil((k + 1) / n1) - 1)
    w = words.withColumn("letters", F.array_sort(F.split("word", "")))
    # The j-th of a letter's occurrences is a dimension: its place less that of the first.
    dimension = lambda c, i: F.xxhash64(c, i + 1 - F.array_position("letters", c))
    w = w.withColumn("dims", F.transform("letters", dimension))
    none = F.lit(0).cast("long")
    of = lambda at: F.aggregate("dims", none, lambda x, d: F.when(F.pmod(d, F.lit(n1 * n2)) == at, x.bitwiseXOR(d)).otherwise(x))
    bit = lambda x, d: x.bitwiseOR(F.element_at(F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)]), (F.pmod(F.shiftrightunsigned(d, 20), F.lit(64)) + 1).cast("int")))
    w = w.withColumn("parts", F.array(*[of(at) for at in range(n1 * n2)])).withColumn("mask", F.aggregate("dims", none, bit))
    chosen = [[i * n2 + j for j in c] for i in range(n1) for c in combinations(range(n2), n2 - k2)]
    joint = lambda c: F.xxhash64(F.lit(str(c)), reduce(lambda x, y: x.bitwiseXOR(y), [F.col("parts")[j] for j in c]))
    return w.withColumn("sigs", F.array(*[joint(c) for c in chosen])).select(*words.columns, "mask", "sigs")


def _by_signature(words: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(word, n, near, near_n) of words that share a short list and are near, word < near; words of long lists."""
    posted = with_signatures(words).select("word", "n", "mask", F.explode("sigs").alias("sig"))
    posted = staged(posted, "signatures")
    lists = posted.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    lists = staged(lists.withColumn("rows", F.col("size")), "signature-lists")
    met = join_unique(posted, lists, ["sig"], posted.count(), "rows")
    short = met.where(F.col("size") <= longest).groupBy("sig").agg(F.collect_list(F.struct("word", "n", "mask")).alias("l"))  # at most `longest`
    # Each word with those after it: a pair is compared once a list, and leaves it in one order.
    one = short.select(F.posexplode("l").alias("at", "w"), "l").select("w", F.slice("l", F.col("at") + 2, F.size("l")).alias("l"))
    # Vectors further apart than two are told by their masks; the edit distance decides on the others.
    alike = lambda x: (F.bit_count(F.col("w.mask").bitwiseXOR(x["mask"])) <= 2) & (F.levenshtein(F.col("w.word"), x["word"], 1) == 1)
    near = one.select("w", F.explode(F.filter("l", alike)).alias("x"))
    near = near.select(F.least("w", "x").alias("w"), F.greatest("w", "x").alias("v"))  # by word, which comes first
    found = near.select(F.col("w.word").alias("word"), F.col("w.n").alias("n"), F.col("v.word").alias("near"), F.col("v.n").alias("near_n"))
    return found, met.where(F.col("size") > longest).select("word", "n").distinct()


def _by_deletion(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all near words, by what is left without a letter."""
    w = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i"))
    w = staged(w.select("word", "n", "i", without(F.col("word"), F.col("i")).alias("left")), "deletions")
    # Words that leave the same at the same place differ in that letter: an alphabet at most.
    alike = w.groupBy("left", "i").agg(F.collect_list(F.struct("word", "n")).alias("l")).where(F.size("l") > 1)
    one = alike.select(F.explode("l").alias("w"), "l").select("w", F.explode("l").alias("v")).where("w.word <> v.word")
    replaced = one.select(F.col("w.word").alias("word"), F.col("w.n").alias("n"), F.col("v.word").alias("near"), F.col("v.n").alias("near_n"))
    longer = w.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("left").alias("word")).distinct().join(words, "word")
    longer = longer.select("word", "n", "near", "near_n")
    shorter = longer.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return replaced.unionByName(longer).unionByName(shorter)


def near_words(words: DataFrame, longest: int = 128) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words one edit apart, once."""
    found, hot = _by_signature(words, longest)
    hot = staged(hot, "frequent-signatures")
    if not hot.isEmpty():
        found = found.unionByName(_by_deletion(hot).where("word < near"))
    turned = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.distinct().select(F.inline(turned))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: forms are followed to the last, twice as far each round."""
    r = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = r.select(F.col("word").alias("root"), F.col("root").alias("next"))
        counts = r.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        known = staged(on.join(counts, "root"), "root-forms")  # forms that have a form, and how many words lead to them
        if known.isEmpty():
            return r
        far = join_unique(r, known, ["root"], r.count()).select("word", F.col("next").alias("root"))
        r = staged(far.unionByName(r.join(far.select("word").hint("merge"), "word", "left_anti")), "roots")


def variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, ratio: int = 2,
    one_in: int = ONE_IN, longest: int = 128,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word.

    A word's form is its near word (one letter inserted, deleted or replaced) of largest n,
    the smallest in code-point order in a tie, if that n is at least `ratio` times its own;
    root is the last of the forms that follow from it, or the word itself. Null, empty and
    letterless texts have no words; a null id counts as an empty one; repeated rows count
    each. An empty table gives no rows; other columns play no part.
    """
    if ratio < 2:
        raise ValueError("ratio is 2 at least, so that forms lead to ever more frequent words")
    words = staged(frequent_words(docs, id_col=id_col, text_col=text_col, least_length=least_length, least_count=least_count, one_in=one_in), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    near = near_words(words, longest).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    w = words.join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    ok = -F.col("b.m") >= ratio * F.col("n")
    w = w.select("word", "n", "n_near", F.when(ok, F.col("b.near")).alias("form"), F.when(ok, -F.col("b.m")).alias("form_n"))
    w = staged(w, "forms")
    roots = _roots(w.where("form is not null"))
    return w.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
