"""Secret scans: patterns for known shapes, and character Markov models for everything else.

Two first-order character models, one of random strings and one of ordinary identifiers, are counted from
labelled samples; a token is reported when the log-likelihood ratio per transition favours the random model.
The ratios are stored as whole numbers (1/1000 nat), so sums are exact and do not depend on order. Tokens
that lie within a pattern's span are not reported again; longer ones are judged whole. DataFrame operations only.

Defined results: a null text counts as empty; a text without spans has empty ``spans`` and the hash of the
empty string; offsets are code points, end exclusive; repeated rows are scanned each; texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the models judge: a run of 20 or more of these characters.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SCALE = 1000
#: Thousandths of a nat per transition above which a token counts as random.
THRESHOLD = 350

#: Words that the ordinary samples are joined from.
WORDS = (
    "user account session request response server client config value index buffer stream reader writer parser token handler "
    "manager service factory builder controller database table column record document message event queue worker thread process "
    "memory cache storage network socket address port host domain path file folder directory image video audio text string number "
    "integer float double boolean array list map set tree graph node edge vertex matrix vector model train test batch epoch layer "
    "weight gradient loss metric score label feature sample dataset pipeline transform filter select group order limit offset count "
    "total average minimum maximum start end begin finish create update delete insert remove append merge split join sort search "
    "find match replace format encode decode compress extract upload download export import public private static final abstract "
    "the and that with have this from they will would there their what about which when make like time just know take people into "
    "year your good some could them other than then look only come over think also back after work first well even want because"
).split()


def labelled_samples(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Labelled strings (text, random): digests in hexadecimal, Base64 and Base-32-like form, and joined words."""
    n, words = F.col("id"), F.split(F.lit(" ".join(WORDS)), " ")
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.lit(k), n), F.lit(len(WORDS))) + 1).cast("int"))
    digest = F.sha2(n.cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    cap = lambda k: F.initcap(pick(k))
    forms = F.array(
        F.concat_ws("_", pick(1), pick(2), pick(3)), F.concat(pick(1), cap(2), cap(3), cap(4)), F.concat_ws("-", pick(1), pick(2), pick(3)),
        F.concat_ws("/", pick(1), pick(2), pick(3)), F.upper(F.concat_ws("_", pick(1), pick(2), pick(3))), F.concat(pick(1), pick(2), pick(3), pick(4)),
    )
    odd = F.array(digest, b64, F.translate(b64, "+/=", "ZzQ"), F.upper(F.translate(b64, "+/=", "234")), b64)
    base = spark.range(rows)
    ordinary = base.select(F.element_at(forms, (F.pmod(n, F.lit(6)) + 1).cast("int")).alias("text"), F.lit(False).alias("random"))
    return ordinary.unionByName(base.select(F.element_at(odd, (F.pmod(n, F.lit(5)) + 1).cast("int")).alias("text"), F.lit(True).alias("random")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[int]:
    """The table of log ratios, one whole number for each pair of the 67 characters, from (text, random) rows.

    Transitions are counted in Spark; at most 2 x 67 x 67 counts reach the driver whatever the samples' size.
    """
    import math

    k = len(ALPHABET)
    at = F.transform(F.split("text", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = samples.where("text IS NOT NULL AND random IS NOT NULL AND length(text) > 1").select("random", at.alias("c"))
    pairs = pairs.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1) * 1000 + F.get("c", i))).alias("p"))
    counts = {(r["random"], r["p"]): r["count"] for r in pairs.groupBy("random", "p").count().collect()}
    out = []
    for a in range(1, k + 1):
        row = {r: [counts.get((r, a * 1000 + b), 0) + smoothing for b in range(1, k + 1)] for r in (True, False)}
        out += [round(SCALE * math.log((row[True][b] / sum(row[True])) / (row[False][b] / sum(row[False])))) for b in range(k)]
    return out


def log_ratio(token, ratios: list[int]):
    """Column: summed log ratio of a token in 1/1000 nat, over its transitions."""
    table_, k = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>"), len(ALPHABET)  # one literal once folded
    at = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.aggregate(
        at, F.struct(F.lit(-1).alias("p"), F.lit(0).cast("long").alias("s")),
        lambda acc, c: F.struct(c.cast("int").alias("p"), (acc["s"] + F.when(acc["p"] < 0, F.lit(0)).otherwise(F.get(table_, acc["p"] * k + c))).cast("long").alias("s")),
        lambda acc: acc["s"],
    )


def _spans(text, pattern: str, kind: int, keep=None):
    """Column: [(start, kind, end, match)] of a pattern's leftmost non-overlapping matches, in code points."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int,t:string>>").alias("out"))
    walk = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("g")), zero,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"])).alias("s"), F.lit(kind).alias("k"), (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("e"), x["m"].alias("t")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    spans = walk if keep is None else F.filter(walk, keep)
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,t:string>>"))


def _text(spans):
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """Each document's spans: (doc_id, base, extra), arrays of (s, k, e, t) sorted by start, then kind.

    One pass over the texts, no shuffle. The models run in a second projection over the few long tokens.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    long_enough = lambda x: F.length(F.regexp_extract(x["t"], ASSIGN, 1)) >= 6
    d = docs.select("doc_id", _spans(t, ASSIGN, 0, long_enough).alias("a"), _spans(t, ACCESS, 1).alias("b"), _spans(t, HEX, 2).alias("h"), _spans(t, TOKEN, 3).alias("c"))
    d = d.select("doc_id", F.array_sort(F.concat("a", "b", "h")).alias("base"), "c")
    free = F.filter("c", lambda x: ~F.exists("base", lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"])))
    d = d.select("doc_id", "base", F.when(F.size("c") > 0, free).otherwise(F.col("c")).alias("c"))
    odd = F.filter("c", lambda x: log_ratio(x["t"], ratios) > F.lit(threshold) * (F.length(x["t"]) - 1))
    return d.select("doc_id", "base", F.when(F.size("c") > 0, odd).otherwise(F.col("c")).alias("extra"))


def op2_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), train(labelled_samples(spark)))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.size("extra").cast("long").alias("n_random"),
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )


QUERIES = {"op2_markov_secret_scan": op2_markov_secret_scan}
ORACLE: dict[str, str] = {}
