"""Operator 10: secret scans, in DataFrame functions only.

Three fixed patterns find assignments, access keys and hex runs. Beside them, runs of key-like characters, as far as no
fixed pattern covers them, are scored by two character Markov models, of random strings and of ordinary identifiers,
trained from labelled samples: the log-likelihood ratio of a stretch is the sum of a table's entries over its adjacent
characters, in thousandths, so it is the same on every machine. All stretches of at least 20 characters count, so that
names and paths before or after a random string don't hide it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The patterns of the base rules and the characters of key-like runs.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SHORTEST = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
#: Ordinary words from which identifiers are put together.
WORDS = (
    "the and for with this that from have not are user name file path value index list count size time date page text data type "
    "config service handler manager request response session account number server client table column query result error message "
    "version release package module function method class object string integer array buffer stream reader writer parser "
    "station nation through thought other weather there whether under ending reading string thing interest standing believe "
    "und der die das nicht ein eine auf mit ist sich werden schaft heit keit lich ung zeit arbeit sprache gesellschaft zwischen "
    "que de la les des pour dans est une avec mais elle leur sont tion ment eaux euse notre votre fonction ouvrage lentement "
    "el los las por para como pero este esta entre sobre cuando donde mente cion ado idad llamar guerra pequeno trabajo"
).split()

_SPAN = "array<struct<start:int,rank:int,end:int>>"


@dataclass(frozen=True)
class Models:
    """table: by place of a character in ALPHABET and of its follower, the log-likelihood ratio in thousandths."""

    table: tuple[int, ...]
    #: A run or stretch counts as random from this mean ratio per adjacent pair (thousandths) on.
    least: int = 900


def samples(spark: SparkSession, count: int = 3000, first: int = 0) -> DataFrame:
    """(value, random): *count* labelled rows of each of four kinds of random strings and of four kinds of identifiers.

    Rows of other numbers from *first* on are other strings, for evaluation on what no model was trained on.
    """
    n = F.col("id")

    def digest(salt: str) -> Column:
        return F.sha2(F.concat(F.lit(salt), n.cast("string")), 256)

    def word(salt: int) -> Column:
        return F.element_at(F.split(F.lit(" ".join(WORDS)), " "), (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(WORDS))) + 1).cast("int"))

    def cut(c: Column, salt: int) -> Column:
        return F.substring(c, F.lit(1), (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(24)) + 20).cast("int"))

    mixed = F.base64(F.unhex(digest("mixed")))
    year, month = F.pmod(F.xxhash64(n, F.lit(7)), F.lit(40)) + 1990, F.pmod(F.xxhash64(n, F.lit(8)), F.lit(12)) + 1
    kinds = [
        (digest("hex"), 1), (cut(mixed, 21), 1), (cut(F.translate(F.upper(F.base64(F.unhex(digest("upper")))), "+/=", "QZ7"), 22), 1), (cut(F.translate(F.base64(F.unhex(digest("url"))), "+/", "-_"), 23), 1),
        (F.concat_ws("_", word(1), word(2), word(3)), 0), (F.concat(word(4), F.initcap(word(5)), F.initcap(word(6)), F.initcap(word(9))), 0),
        (F.concat(word(10), F.element_at(F.split(F.lit(",-,/,_,=,+"), ","), (F.pmod(n, F.lit(6)) + 1).cast("int")), word(11), word(12), F.upper(word(13))), 0), (F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), (n * 7919).cast("string"), word(14)), 0),
    ]
    return spark.range(first, first + count).select(F.inline(F.array(*(F.struct(v.alias("value"), F.lit(k).alias("random")) for v, k in kinds))))


def train(labelled: DataFrame, least: int = 900) -> Models:
    """Models from labelled rows (value string, random 0 or 1); other labels, nulls and characters outside ALPHABET are passed over.

    Adjacent characters are counted by a groupBy, which leaves two tables of at most 67 x 67 counts, however many rows
    there are. Each count has one half added.
    """
    import math

    size = len(ALPHABET)
    pairs = labelled.filter(F.col("random").isin(0, 1)).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("value") - 1, F.lit(1))), lambda i: F.substring("value", i, F.lit(2)))).alias("pair"))
    counts = {(r.random, r.pair): r.n for r in pairs.filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}

    def chance(k: int, a: str, b: str) -> float:
        return (counts.get((k, a + b), 0) + 0.5) / (sums[k, a] + size / 2)

    sums = {(k, a): sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in (0, 1) for a in ALPHABET}
    return Models(tuple(round(1000 * math.log(chance(1, a, b) / chance(0, a, b))) for a in ALPHABET for b in ALPHABET), least)


def _bound(value: Column, use) -> Column:
    """use(value), with *value* evaluated once: what stands in the body of a lambda is evaluated anew for each element, unless it is a variable."""
    return F.get(F.transform(F.array(value), use), 0)


def _starts(entries: Column) -> Column:
    """Sums of all entries before each one; in two levels, so long arrays cost no quadratic copying."""
    return _bound(entries, _starts_of)


def _starts_of(lengths: Column) -> Column:
    step = 256

    def running(values: Column, zero: Column) -> Column:
        state = F.struct(zero.alias("at"), F.expr("cast(array() as array<bigint>)").alias("seen"))
        return F.aggregate(values, state, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["seen"], s["at"]).alias("seen")), lambda s: s["seen"])

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / step).cast("int") - 1, F.lit(0))), lambda i: F.slice(lengths, i * step + 1, F.lit(step)))
    total = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x)
    return _bound(parts, lambda ps: F.flatten(F.zip_with(ps, running(F.transform(ps, total), F.lit(0).cast("long")), running)))


def _spans(text: Column, pattern: str, rank: int) -> Column:
    """Spans (code points) of all leftmost non-overlapping matches, with their texts; the pattern matches no empty text.

    The texts between matches are what split() leaves, so the sums of lengths give the places.
    """

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = _bound(F.zip_with(found, gaps, lambda m, g: F.length(g) + F.length(m)), lambda steps: F.zip_with(_starts(steps), steps, lambda a, b: a + b))
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).cast("int").alias("start"), F.lit(rank).alias("rank"), e.cast("int").alias("end"), m.alias("found")))

    made = _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(text.rlike(pattern), made).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,end:int,found:string>>)"))


def _pairs(run: Column, models: Models) -> Column:
    """The log-likelihood ratio of each adjacent pair."""
    size = len(ALPHABET)
    table = F.split(F.lit(",".join(map(str, models.table))), ",").cast("array<int>")
    place_of = F.split(F.lit(",".join(str(ALPHABET.find(chr(c))) for c in range(128))), ",").cast("array<int>")
    # split() takes the characters in one pass, where substring() would walk to each from the start
    places = F.transform(F.split(run, ""), lambda c: F.get(place_of, F.ascii(c)))
    return _bound(places, lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.get(table, a * size + b)))


def _ratio(run: Column, models: Models) -> Column:
    return F.aggregate(_pairs(run, models), F.lit(0).cast("long"), lambda s, x: s + x)


def _uncovered(run: Column, base: Column) -> Column:
    """What the spans of *base*, sorted by start, leave over of a run: array<struct<start, found>>, parts of SHORTEST characters at least."""
    over = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    none = F.struct(run["start"].alias("at"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("gaps"))
    gap = lambda s, end: F.array_append(s["gaps"], F.struct(s["at"].alias("a"), end.alias("b")))
    gaps = F.aggregate(over, none, lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), gap(s, b["start"]).alias("gaps")), lambda s: gap(s, run["end"]))
    long = F.filter(gaps, lambda g: g["b"] - g["a"] >= SHORTEST)
    return F.transform(long, lambda g: F.struct(g["a"].alias("start"), F.substring(run["found"], g["a"] - run["start"] + 1, g["b"] - g["a"]).alias("found")))


def _random(part: Column, models: Models) -> Column:
    """The random spans of a part of a run: all of it if its mean reaches the least, else what its stretches cover.

    A stretch of n pairs that reaches the mean can be cut into ones of a to 2 a - 1 pairs (a = SHORTEST - 1), one of which reaches it
    too. So it is enough to look at these lengths; of each start the shortest that does counts, and those that overlap are one span.
    """
    least, first = SHORTEST - 1, part["start"]
    excess = F.transform(_pairs(part["found"], models), lambda x: (x - models.least).cast("long"))

    def covered(sums: Column) -> Column:  # the sum of what is in excess before each character
        last = F.size(sums) - 1
        starts = F.filter(F.sequence(F.lit(0), last - least), lambda k: F.array_max(F.slice(sums, k + least + 1, F.lit(least))) >= F.get(sums, k))
        ends = lambda k: F.filter(F.sequence(F.lit(least), F.least(F.lit(2 * least - 1), last - k)), lambda m: F.get(sums, k + m) >= F.get(sums, k))
        stretches = F.transform(starts, lambda k: F.struct(k.alias("a"), (k + F.get(ends(k), 0) + 1).alias("b")))
        none = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.expr(f"cast(array() as {_SPAN})").alias("done"))
        done = lambda s: F.when(s["b"] > 0, F.array_append(s["done"], F.struct((first + s["a"]).alias("start"), F.lit(3).alias("rank"), (first + s["b"]).alias("end")))).otherwise(s["done"])
        joined = lambda s, x: F.when(x["a"] <= s["b"], F.struct(F.when(s["b"] > 0, s["a"]).otherwise(x["a"]).alias("a"), F.greatest(s["b"], x["b"]).alias("b"), s["done"].alias("done"))).otherwise(F.struct(x["a"].alias("a"), x["b"].alias("b"), done(s).alias("done")))
        whole = F.array(F.struct(first.alias("start"), F.lit(3).alias("rank"), (first + last + 1).alias("end")))
        return F.when(F.get(sums, last) >= 0, whole).otherwise(F.aggregate(stretches, none, joined, done))

    return _bound(_starts(F.array_append(excess, F.lit(0).cast("long"))), covered)


def scan(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """*docs* with a column __adjudica_spans, array<struct<start, rank, end>>: all spans by start, then kind (see KINDS).

    Base spans are always there; the random stretches of what they leave over of runs add theirs. A null or empty text has no
    spans, whole texts are scanned whatever their length, repeated rows each.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    bare = lambda x: F.struct(x["start"], x["rank"], x["end"])
    values = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1))
    assigned = F.filter(F.when(t.rlike(ASSIGN), F.zip_with(_spans(t, ASSIGN, 0), values, lambda s, v: F.struct(s["start"], s["rank"], s["end"], (F.length(v) >= 6).alias("long")))), lambda s: s["long"])
    base = F.concat(F.coalesce(F.transform(assigned, bare), F.expr(f"cast(array() as {_SPAN})")), F.transform(_spans(t, ACCESS, 1), bare), F.transform(_spans(t, HEX, 2), bare))
    first = docs.withColumn("__adjudica_base", F.array_sort(base)).withColumn("__adjudica_runs", _spans(t, RUN, 3))
    parts = _bound(F.col("__adjudica_base"), lambda b: F.flatten(F.transform("__adjudica_runs", lambda r: _uncovered(r, b))))
    added = F.flatten(F.transform("__adjudica_parts", lambda p: _random(p, models)))
    both = first.withColumn("__adjudica_parts", parts).withColumn("__adjudica_spans", F.array_sort(F.concat("__adjudica_base", added)))
    return both.drop("__adjudica_base", "__adjudica_runs", "__adjudica_parts")


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, models: Models, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of *docs*: key, n_assign, n_access, n_hex, base_sha256, spans.

    A null or empty text has none; repeated rows are scanned each; other columns are not read; a null key stays null; an empty table
    gives no rows.
    """
    found = scan(docs.select(F.col(key), F.col(text).alias("_text")), models, "_text")
    count = lambda rank: F.size(F.filter("__adjudica_spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.filter("__adjudica_spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"), _joined(F.col("__adjudica_spans")).alias("spans"))


def redact(docs: DataFrame, models: Models, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """*docs* with each stretch that spans cover, alone or overlapping, replaced by *mark*.

    A null text stays null and an empty one empty; texts without spans stay as they are; spans that overlap or touch become one mark;
    repeated rows are treated each, alike; whole texts whatever their length; an empty table stays empty; other columns stay.
    """
    found = scan(docs, models, text)
    spans = F.col("__adjudica_spans")
    # the text between covered stretches: from the furthest end so far to the next start beyond it
    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("gaps"))
    walk = F.aggregate(
        spans,
        none,
        lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when((x["start"] >= s["at"]) & ((x["start"] > s["at"]) | (F.size(s["gaps"]) == 0)), F.array_append(s["gaps"], F.struct(s["at"].alias("a"), x["start"].alias("b")))).otherwise(s["gaps"]).alias("gaps")),
    )
    kept = F.concat(F.array_join(F.transform(walk["gaps"], lambda g: F.concat(F.substring(text, g["a"] + 1, g["b"] - g["a"]), F.lit(mark))), ""), F.substring(text, walk["at"] + 1, F.lit(2**31 - 1)))
    return found.withColumn(text, F.when(F.size(spans) > 0, kept).otherwise(F.col(text))).drop("__adjudica_spans")
