"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words inside a sentence; runs count once) and units (a
unit word after a number) turn into typed placeholders, other words into lower case. Windows of the
templates are hash-joined with the benchmark's; along each alignment of a document with an item, the values
that fill the placeholders must map one to one, so a question with other numbers or names is caught while
unrelated texts of the same shape are not. DataFrame operations only.

Windows of few ordinary words are not searched as templates. Items that consist of them, and items of fewer than
``MIN_TOKENS`` template tokens, are found as they are: by ``VERBATIM`` words in a row, or whole if they are shorter.

Defined results: null and empty texts match nothing; an item of a single word is found in each text that has the
word; items shorter than a window are looked for whole; rows without doc_id are reported together as
doc_id null; repeated rows and items change nothing; an empty benchmark gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, maybe_broadcast, small, stage, table

WINDOW = 8
MIN_TOKENS = 5
#: A window needs this share of ordinary words, so that placeholders alone match nothing.
MIN_LITERAL = 0.5
#: An alignment counts from this share of the item's tokens in windows that are searched, or from this many windows.
COVERAGE, LONG_RUN = 0.5, 20
#: Offsets of a document and item that differ by at most this much continue one alignment: words were inserted or dropped.
BAND = 8
#: A verbatim run of so many words counts whatever the item's length or its share of placeholders; shorter items count whole.
VERBATIM = 13
#: Tokens of the grams that say where a window may match; see ``_candidates``.
GRAM = 4

NAME, NUM, UNIT = "\ue001", "\ue002", "\ue003"
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr ms day days week weeks month months year years hour hours minute minutes "
    "second seconds meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams "
    "kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons percent dollar dollars euro euros cent cents "
    "degree degrees volt volts watt watts hz khz mhz ghz kb mb gb tb mph kph"
).split()
#: A capitalised word, or a run of them, after a word, number, comma or semicolon and one blank: inside a sentence.
NAME_RE = r"\p{Lu}(?<=[\p{L}\p{Nd},;][ \t]\p{Lu})\p{Ll}+(?:[ \t]\p{Lu}\p{Ll}+)*"
NUM_RE = r"[0-9]+(?:[.,][0-9]+)*"
#: What stands between tokens: white space, punctuation and symbols of the common blocks.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xBF\u2000-\u206F\u3000-\u303F]+"


def _marked(df: DataFrame, *ids: str) -> DataFrame:
    """``ids``, text, and x: the text with its placeholders, in lower case."""
    x = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), NAME_RE, f" {NAME} ")
    x = F.regexp_replace(x, NUM_RE, f" {NUM} ")
    unit = rf"({NUM} ?[ \t]?)(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{Nd}}])"
    return df.select(*ids, "text", F.lower(F.regexp_replace(x, unit, f"$1 {UNIT} ")).alias("x"))


def _tokens(df: DataFrame, *ids: str) -> DataFrame:
    """``ids``, text and c: the template's tokens."""
    return _marked(df, *ids).select(*ids, "text", F.array_remove(F.split("x", BETWEEN), "").alias("c"))


def _fills(text: Column, c: Column, start: Column, length: Column) -> Column:
    """Column: what fills each token of the window, null for ordinary words.

    The k-th placeholder of a kind stands for the k-th match of that kind's pattern. Only windows that
    matched are asked, so this may search the text anew.
    """
    names = F.regexp_extract_all(text, F.lit(NAME_RE), F.lit(0))
    nameless = F.regexp_replace(text, NAME_RE, f" {NAME} ")
    numbers = F.regexp_extract_all(nameless, F.lit(NUM_RE), F.lit(0))
    numberless = F.regexp_replace(nameless, NUM_RE, f" {NUM} ")
    units = F.regexp_extract_all(numberless, F.lit(rf"{NUM} ?[ \t]?((?i:{'|'.join(UNITS)}))(?![\p{{L}}\p{{Nd}}])"), F.lit(1))
    win = F.slice(c, start, length)

    def fill(x: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(c, 1, start + i - 1), lambda y: y == x))
        return F.when(x == NAME, F.get(names, nth)).when(x == NUM, F.get(numbers, nth)).when(x == UNIT, F.get(units, nth))

    any_slot = F.arrays_overlap(win, F.array(F.lit(NAME), F.lit(NUM), F.lit(UNIT)))
    return F.when(any_slot, F.transform(F.transform(win, fill), F.lower)).otherwise(F.transform(win, lambda x: F.lit(None).cast("string")))


def _starts(c: Column, w) -> Column:
    n = F.size(c) - F.lit(w) + 1
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _gram(n: int) -> tuple[int, int]:
    """Gram length and stride for windows of ``n`` tokens: each holds exactly one gram that starts at a multiple of the stride."""
    return min(GRAM, n), n - min(GRAM, n) + 1


def _keys(bench: DataFrame) -> DataFrame:
    """(glen, gkey): every gram of every benchmark window (len, words), wherever it stands in the window."""
    g = F.least(F.col("len"), F.lit(GRAM))
    grams = F.transform(F.sequence(F.lit(1), F.col("len") - g + 1), lambda o: F.xxhash64(F.slice("words", o, g)))
    return bench.select(F.col("len").alias("glen"), F.explode(grams).alias("gkey")).distinct()


def _candidates(tokens: DataFrame, c: str, lens: list[int], keys: DataFrame) -> DataFrame:
    """``tokens`` once for each window (p, len) that may be one of the benchmark's, with its key.

    Only grams at multiples of the stride are hashed, a fifth to a tenth of all positions. The few that the benchmark
    holds name the windows around them, and each window has one such gram, so none is missed or named twice.
    """
    n, cols = F.size(c), tokens.columns

    def aligned(k: int) -> Column:
        g, step = _gram(k)
        at = F.when(n >= k, F.sequence(F.lit(1), n - g + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("a"), F.lit(k).alias("len"), F.xxhash64(F.slice(c, i, g)).alias("key")))

    grams = [aligned(k) for k in lens]
    # explode_outer: for explode the optimizer would add a filter that evaluates the hashes once more.
    at = tokens.select(*cols, F.explode_outer(F.concat(*grams) if len(grams) > 1 else grams[0]).alias("w"))
    at = at.select(*cols, F.col("w.a").alias("a"), F.col("w.len").alias("glen"), F.col("w.key").alias("gkey"))
    at = at.join(F.broadcast(keys), ["gkey", "glen"], "left_semi")
    first, last = F.greatest(F.lit(1), F.col("a") - F.col("glen") + F.least(F.col("glen"), F.lit(GRAM))), F.least(F.col("a"), n - F.col("glen") + 1)
    around = F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("p"), F.xxhash64(F.slice(c, i, F.col("glen"))).alias("key"))))
    at = at.select(*cols, F.col("glen").alias("len"), F.explode_outer(around).alias("w"))
    return at.select(*cols, "len", F.col("w.p").alias("p"), F.col("w.key").alias("key"))


def _every(tokens: DataFrame, c: str, lens: list[int], *ids: str) -> DataFrame:
    """(ids, len, p, key) of every window of the tokens, for a join that shuffles."""
    each = [F.transform(_starts(F.col(c), k), lambda i: F.struct(F.lit(k).alias("len"), i.alias("p"), F.xxhash64(F.slice(c, i, k)).alias("key"))) for k in lens]
    at = tokens.select(*ids, F.explode_outer(F.concat(*each) if len(each) > 1 else each[0]).alias("w"))
    return at.select(*ids, "w.len", "w.p", "w.key")


def benchmark_windows(items: DataFrame, w: int = WINDOW) -> DataFrame:
    """(item_id, item_pos, len, key, words, slots, item_windows, item_tokens) of every window of every item.

    The first word of an item may stand inside a sentence once it is pasted into a text, and would be read
    as a name there, so windows at the start of an item are kept under both readings.
    """
    it = _tokens(items.where("text IS NOT NULL").dropDuplicates(["item_id", "text"]), "item_id").where(F.size("c") >= MIN_TOKENS)
    it = it.withColumn("len", F.least(F.size("c"), F.lit(w))).withColumn("item_windows", F.size("c") - F.col("len") + 1)
    poor = lambda x: x.isin(NUM, NAME, UNIT)
    rich = F.filter(_starts(F.col("c"), F.col("len")), lambda i: F.size(F.filter(F.slice("c", i, F.col("len")), lambda x: ~poor(x))) >= F.col("len") * F.lit(MIN_LITERAL))
    it = it.withColumn("item_tokens", F.size(F.array_distinct(F.flatten(F.transform(rich, lambda i: F.sequence(i, i + F.col("len") - 1))))))
    win = it.withColumn("item_pos", F.explode_outer(_starts(F.col("c"), F.col("len"))))
    win = win.select("item_id", "item_pos", "len", "item_windows", "item_tokens", F.slice("c", F.col("item_pos"), F.col("len")).alias("words"), _fills(F.col("text"), F.col("c"), F.col("item_pos"), F.col("len")).alias("slots"))
    first = F.get("words", 0)
    head = win.where((F.col("item_pos") == 1) & ~first.isin(NUM, NAME, UNIT))
    rest = F.slice("words", 2, w)
    as_name = head.select("item_id", "item_pos", "len", "item_windows", "item_tokens", F.concat(F.array(F.lit(NAME)), rest).alias("words"), F.concat(F.array(first), F.slice("slots", 2, w)).alias("slots"))
    win = win.unionByName(as_name)
    literal = F.size(F.filter("words", lambda x: ~x.isin(NUM, NAME, UNIT)))
    return win.where(literal >= F.col("len") * F.lit(MIN_LITERAL)).withColumn("key", F.xxhash64("words")).distinct()


def verbatim_runs(docs: DataFrame, items: DataFrame, n: int = VERBATIM) -> DataFrame:
    """(doc_id, item_id, windows, item_windows) of documents with ``n`` words, or all, of an item in a row as they are."""
    plain = lambda df, k: df.select(k, F.array_remove(F.split(F.lower("text"), BETWEEN), "").alias("r"))
    it = plain(items.where("text IS NOT NULL").dropDuplicates(["item_id", "text"]), "item_id").where(F.size("r") > 0).withColumn("len", F.least(F.size("r"), F.lit(n)))
    it = it.withColumn("item_windows", F.size("r") - F.col("len") + 1).withColumn("item_pos", F.explode(_starts(F.col("r"), F.col("len"))))
    bench = it.select("item_id", "item_pos", "len", "item_windows", F.slice("r", F.col("item_pos"), F.col("len")).alias("words")).withColumn("key", F.xxhash64("words"))
    lens = [r["len"] for r in bench.select("len").distinct().collect()] or [n]  # at most n values
    at = plain(docs.where("text IS NOT NULL"), "doc_id")
    if small(bench, BROADCAST_ROWS // 8):
        hits = _candidates(at, "r", lens, _keys(bench)).join(F.broadcast(bench), ["key", "len"])
        hits = hits.where(F.slice("r", F.col("p"), F.col("len")) == F.col("words"))
    else:
        hits = _every(at, "r", lens, "doc_id").join(bench, ["key", "len"])  # 64 bits of hash; the texts are not shuffled
    return hits.groupBy("doc_id", "item_id").agg(F.count_distinct("item_pos").alias("windows"), F.max("item_windows").alias("item_windows"))


def find(docs: DataFrame, items: DataFrame, w: int = WINDOW) -> DataFrame:
    """One row per contaminated document and item: (doc_id, item_id, windows, item_windows, slots, changed, kind).

    Windows count along one offset and along chains of neighbouring offsets, each with its own check of the slots.
    Documents that hold only a verbatim run of words are reported with its windows of words and no slots.

    The benchmark's windows are broadcast when their counted number allows it; then documents are
    neither shuffled nor copied. Beyond that only (doc_id, position, hash) rows are shuffled for the join, and
    the documents that matched are read again.
    """
    bench = benchmark_windows(items, w)
    lens = [r["len"] for r in bench.select("len").distinct().collect()]  # at most w values
    if not lens:
        lens = [w]
    tokens = _tokens(docs.where("text IS NOT NULL"), "doc_id")
    if small(bench, BROADCAST_ROWS // 8):
        hits = _candidates(tokens, "c", lens, _keys(bench)).join(F.broadcast(bench), ["key", "len"])
    else:
        at = _every(tokens, "c", lens, "doc_id").join(bench, ["key", "len"])
        hits = at.join(tokens.select(F.col("doc_id").alias("d"), "text", "c"), F.col("doc_id").eqNullSafe(F.col("d"))).drop("d")
    hits = hits.where(F.slice("c", F.col("p"), F.col("len")) == F.col("words"))
    mine = _fills(F.col("text"), F.col("c"), F.col("p"), F.col("len"))
    hits = hits.select("doc_id", "item_id", "item_pos", "len", "item_windows", "item_tokens", "p", "slots", mine.alias("mine"))
    fills = F.filter(F.arrays_zip(F.col("slots").alias("a"), F.col("mine").alias("b")), lambda x: x["a"].isNotNull())
    fills = F.transform(fills, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    lines = hits.groupBy("doc_id", "item_id", "item_windows", "item_tokens", "len", (F.col("p") - F.col("item_pos")).alias("offset")).agg(
        F.collect_set("item_pos").alias("pos"), F.array_distinct(F.flatten(F.collect_set(fills))).alias("fills")
    )
    lines = stage(lines, "lines")  # few rows, read twice
    same = ["doc_id", "item_id", "item_windows", "item_tokens", "len"]
    order = Window.partitionBy(*same).orderBy("offset")
    gap = F.coalesce(F.col("offset") - F.lag("offset").over(order), F.lit(0))
    lines = lines.withColumn("new", (gap > BAND).cast("int")).withColumn("chain", F.sum("new").over(order))
    chains = lines.groupBy(*same, "chain").agg(F.array_distinct(F.flatten(F.collect_list("pos"))).alias("pos"), F.array_distinct(F.flatten(F.collect_list("fills"))).alias("fills"), F.count("*").alias("n"))
    lines = lines.select(*same, "pos", "fills").unionByName(chains.where("n > 1").select(*same, "pos", "fills"))
    lines = lines.withColumn("windows", F.size("pos").cast("long"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("pos", lambda i: F.sequence(i, i + F.col("len") - 1)))))
    ways = lambda k: F.size(F.array_distinct(F.transform("fills", lambda x: x[k])))
    lines = lines.withColumn("slots", F.size("fills")).where((ways("a") == F.col("slots")) & (ways("b") == F.col("slots")))
    lines = lines.where((covered >= F.col("item_tokens") * F.lit(COVERAGE)) | (F.col("windows") >= LONG_RUN))
    changed = F.size(F.filter("fills", lambda x: x["a"] != x["b"]))
    best = lines.groupBy("doc_id", "item_id").agg(F.max(F.struct("windows", (-changed).alias("same"), "slots", "item_windows")).alias("m"))
    best = best.select(
        "doc_id", "item_id", F.col("m.windows").alias("windows"), F.col("m.item_windows").alias("item_windows"), F.col("m.slots").alias("slots"),
        (-F.col("m.same")).alias("changed"), F.when(F.col("m.same") < 0, "reparameterised").otherwise("verbatim").alias("kind"),
    )
    runs = verbatim_runs(docs, items).select("doc_id", "item_id", "windows", "item_windows", F.lit(0).alias("slots"), F.lit(0).alias("changed"), F.lit("verbatim").alias("kind"))
    row = F.struct("first", "windows", "item_windows", "slots", "changed", "kind")
    both = best.withColumn("first", F.lit(1)).unionByName(runs.withColumn("first", F.lit(0)))
    return both.groupBy("doc_id", "item_id").agg(F.max(row).alias("m")).select("doc_id", "item_id", "m.windows", "m.item_windows", "m.slots", "m.changed", "m.kind")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without those that hold a benchmark item.

    Rows without doc_id are told apart by their text (a hash stands in for the id), so a contaminated one goes as well.
    Rows of one id stand or fall together. Extra columns stay as they are.
    """
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    bad = find(docs.select(own.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(maybe_broadcast(stage(bad, "contaminated")), own == F.col("_bad"), "left_anti")


QUERIES = {"op1_template_decontamination": op1_template_decontamination}
ORACLE: dict[str, str] = {}
