"""Benchmark decontamination by templates, in DataFrame functions alone.

Words become a template: numbers, names (capitalised words inside a sentence) and units after
numbers turn into typed placeholders, everything else is lower-cased and bared of punctuation.
Where any word would be capitalised (the start of a sentence, a line, a quotation, the text) a
capitalised word may be a name or not, so a window with such words is hashed twice: with all of
them as names, and with all of them as plain words.
Windows of consecutive template words are hashed and joined with the benchmark's. A document
holds an item when enough of the item's windows are met; the words that stand in the item's
slots are then compared, occurrence by occurrence: unchanged values make an exact copy, values
that are renamed alike throughout a re-parameterised one, and values that contradict each other
are no copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm._tables import by_ids, kept

#: Template words of a window; share of an item's windows that a document must hold.
WINDOW, SHARE = 8, 0.5
#: Benchmark windows broadcast at most; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 1_000_000
NAME, NUMBER, UNIT, MAYBE, POINT = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
MARKS = NAME + NUMBER + UNIT + MAYBE + POINT
# Words that count as units after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres cup cups gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent kmh mph"
).split()


def words(text: Column) -> Column:
    """The text's words in order; names, words that may be names, and numbers carry a mark in front."""
    x = F.translate(F.coalesce(text, F.lit("")), MARKS, " " * len(MARKS))
    # the patterns begin with what is rare, so that most places fail at once
    x = F.regexp_replace(x, r"\p{Lu}(?<=[\p{Ll},;] \p{Lu})\p{Ll}+", NAME + "$0")
    x = F.regexp_replace(x, rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}{NAME}]\p{{Lu}})\p{{Ll}}+", MAYBE + "$0")
    x = F.regexp_replace(x, r"[.,:/](?<=\p{N}[.,:/])(?=\p{N})", POINT)
    x = F.regexp_replace(x, rf"\p{{N}}[\p{{N}}{POINT}]*", NUMBER + "$0")
    found = F.split(F.lower(x), rf"[^\p{{L}}\p{{N}}{MARKS}]+")
    # only the first and the last can be empty
    first, last = F.element_at(found, 1) == "", (F.size(found) > 1) & (F.element_at(found, -1) == "")
    return F.slice(found, F.when(first, 2).otherwise(1), F.size(found) - first.cast("int") - last.cast("int"))


def _bare(word: Column) -> Column:
    return F.translate(word, NAME + MAYBE, "")


def template(of: Column) -> Column:
    """The placeholders and plain words for ``words``; a word that may be a name keeps its mark."""

    def one(w: Column, i: Column) -> Column:
        mark = F.ascii(w)
        after = F.when(i > 0, F.ascii(F.get(of, i - 1))) == ord(NUMBER)
        return F.when(mark == ord(NAME), NAME).when(mark == ord(NUMBER), NUMBER).when(after & F.ltrim(w, F.lit(MAYBE)).isin(UNITS), UNIT).otherwise(w)

    return F.transform(of, one)


def _windows(rows: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """length, at, window (hash): one row for each window of each row's template, and one more where a word may be a name or not."""
    names = F.transform("template", lambda w: F.xxhash64(F.when(F.ascii(w) == ord(MAYBE), NAME).otherwise(w)))
    plain = F.transform("template", lambda w: F.xxhash64(F.ltrim(w, F.lit(MAYBE))))
    rows = rows.select(*keep, names.alias("names"), plain.alias("plain"))
    # outer, and no filter: a filter would be pushed below and compute the words again for every word
    rows = rows.select("*", F.explode_outer(F.array(*map(F.lit, lengths))).alias("length"))
    n = F.size("names") - F.col("length")
    rows = rows.select("*", F.explode_outer(F.when(n >= 0, F.sequence(F.lit(0), n))).alias("at"))

    def hashed(of: str) -> Column:
        one = {n: F.xxhash64(F.lit(n), *(F.get(of, F.col("at") + k) for k in range(n))) for n in lengths}
        return F.coalesce(*(F.when(F.col("length") == n, x) for n, x in one.items()))

    rows = rows.select(*keep, "length", "at", hashed("names").alias("by_names"), hashed("plain").alias("by_words"))
    both = F.array("by_names", F.when(F.col("by_names") != F.col("by_words"), F.col("by_words")))
    return rows.select(*keep, "length", "at", F.explode_outer(both).alias("window"))


def benchmark_windows(benchmark: DataFrame, length: int) -> DataFrame:
    """item_id, item_hash (of the text), item_at, window, n_windows, length, item_words, item_template (of the window) of the items with at least one word, one row for each reading of a window; a short item is one window of its own length."""
    rows = benchmark.select("item_id", F.xxhash64("text").alias("item_hash"), words(F.col("text")).alias("words")).withColumn("template", template(F.col("words"))).where(F.size("words") > 0)
    rows = rows.withColumn("own", F.least(F.lit(length), F.size("template")))
    found = _windows(rows, list(range(1, length + 1)), ["item_id", "item_hash", "words", "template", "own"]).where("length = own AND window IS NOT NULL")
    part = lambda c: F.slice(c, F.col("at") + 1, F.col("length"))
    return found.select("item_id", "item_hash", F.col("at").alias("item_at"), "window", (F.size("template") - F.col("length") + 1).alias("n_windows"), "length", part("words").alias("item_words"), part("template").alias("item_template"))


PAIR = ["doc_id", "text_hash", "item_id", "item_hash", "n_windows"]


def _occurrences(met: DataFrame) -> DataFrame:
    """``ways``: the occurrences of the item that a met window may belong to.

    A document may hold an item several times, with other values each time. Its met windows are
    taken together by equal shift against the item, by shifts at most half the item apart (words
    put in or left out), by runs that go forward in the item (however much stands between), and
    all at once. A pair with one shift has one occurrence.
    """
    rows = met.withColumn("shift", F.col("at") - F.col("item_at"))
    pair, step = Window.partitionBy(*PAIR), F.lit(1)
    by_shift, by_place = pair.orderBy("shift"), pair.orderBy("at", "item_at")
    far = F.when((F.col("shift") - F.lag("shift").over(by_shift)) * 2 > F.col("n_windows") + F.col("length") - 1, step).otherwise(0)
    at, item_at = F.lag("at").over(by_place), F.lag("item_at").over(by_place)
    back = F.when((F.col("item_at") < item_at) | ((F.col("item_at") == item_at) & (F.col("at") > at)), step).otherwise(0)
    rows = rows.withColumns({"far": far, "back": back, "one": F.min("shift").over(pair) == F.max("shift").over(pair)})
    rows = rows.withColumns({"near": F.sum("far").over(by_shift.rowsBetween(Window.unboundedPreceding, 0)), "run": F.sum("back").over(by_place.rowsBetween(Window.unboundedPreceding, 0))})
    way = lambda k, of: F.struct(F.lit(k).alias("by"), of.cast("bigint").alias("number"))
    whole = way(0, F.lit(0))
    ways = F.when(F.col("one"), F.array(whole)).otherwise(F.array(whole, way(1, F.col("shift")), way(2, F.col("near")), way(3, F.col("run"))))
    return rows.withColumn("ways", ways).select(*met.columns, "ways")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, text_hash, item_id, n_windows, n_matched, n_slots, n_changed, kind (exact, renamed): the items that documents hold.

    Null and empty texts hold nothing and are held by nothing. Rows that repeat a doc_id count
    by their texts (text_hash); equal rows give one result. Items with one id and different
    texts are told apart by their texts and reported under the id once, the fullest match.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark_windows(benchmark.select("item_id", "text").where("text IS NOT NULL").distinct(), window)
    few = items.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    lengths = [r[0] for r in items.select("length").distinct().collect()]  # 1..window at most
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = docs.select("doc_id", "text_hash", words(F.col("text")).alias("words")).select("doc_id", "text_hash", template(F.col("words")).alias("template"))
    if not lengths:
        return spark.createDataFrame([], "doc_id bigint, text_hash bigint, item_id bigint, n_windows int, n_matched bigint, n_slots bigint, n_changed bigint, kind string")
    met = _windows(rows, sorted(lengths), ["doc_id", "text_hash"]).drop("length").join(F.broadcast(items) if few else items, "window")
    met = kept(met.drop("window").distinct(), "met")  # a window may be met by both readings
    ids = kept(met.select("text_hash").distinct(), "ids")
    texts = by_ids(docs, ids, ["text_hash"], "left_semi").dropDuplicates(["text_hash"]).select("text_hash", words(F.col("text")).alias("all"))
    found = _occurrences(met).join(texts, "text_hash").withColumn("words", F.slice("all", F.col("at") + 1, F.col("length"))).drop("all")
    maybe = lambda w: F.substring(w, 1, 1) == MAYBE
    slots = F.filter(F.arrays_zip(F.col("item_template").alias("kind"), F.col("item_words").alias("was"), F.col("words").alias("is")), lambda s: s["kind"].isin(NAME, NUMBER, UNIT) | maybe(s["kind"]))
    # sure: a slot whatever its value; open: a slot only by the reading as a name
    slots = F.transform(slots, lambda s: F.struct(F.when(maybe(s["kind"]), NAME).otherwise(s["kind"]).alias("kind"), _bare(s["was"]).alias("was"), _bare(s["is"]).alias("is"), (~maybe(s["kind"])).alias("sure"), (maybe(s["kind"]) | maybe(s["is"])).alias("open")))
    found = found.withColumn("slots", F.array_distinct(slots))
    # each occurrence is judged with all windows, and with those alone in which no open slot is changed
    plain = ~F.exists("slots", lambda s: s["open"] & (s["was"] != s["is"]))
    pair = [*PAIR, "way", "plain"]
    found = found.withColumn("plain", F.explode(F.when(plain, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))).withColumn("way", F.explode("ways"))
    each = found.select(*pair, "item_at", F.explode_outer("slots").alias("slot"))
    values = each.groupBy(*pair, "slot.kind", "slot.was").agg(F.min("slot.is").alias("x"), F.max("slot.is").alias("y"), F.max("slot.sure").alias("sure"))
    # a word that may be a name and stands unchanged is no slot
    values = values.withColumn("was", F.when(F.expr("sure OR was <> x OR was <> y"), F.col("was")))
    values = values.groupBy(*pair).agg(F.count("was").alias("n_slots"), F.count_if(F.expr("x <> y")).alias("n_torn"), F.count_if(F.expr("was <> x OR was <> y")).alias("n_changed"))
    matched = found.groupBy(*pair).agg(F.countDistinct("item_at").alias("n_matched")).where(F.col("n_matched") >= F.col("n_windows") * share)
    same = [matched[c].eqNullSafe(values[c]) for c in pair]
    both = matched.join(values, same).select(*(matched[c] for c in pair), "n_matched", "n_slots", "n_torn", "n_changed")
    # a few repeated values inside one item may be torn by chance; half of all slots is a contradiction
    held = both.where((F.col("n_torn") * 2 <= F.col("n_slots")) | (F.col("n_changed") == 0))
    # the fullest occurrence counts, of these the least changed
    order = F.struct(F.col("n_matched") / F.col("n_windows"), "n_windows", -F.col("n_changed"), "n_slots")
    best = held.groupBy("doc_id", "text_hash", "item_id").agg(F.max_by(F.struct("n_windows", "n_matched", "n_slots", "n_changed"), order).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", "b.*", F.when(F.col("b.n_changed") == 0, "exact").otherwise("renamed").alias("kind"))
