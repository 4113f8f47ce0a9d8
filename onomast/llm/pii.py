"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns find emails, IP addresses, card numbers (Luhn) and phone numbers.
They seed the method: the words beside a base span are lexical patterns, two or one
before it and two or one after it.  A candidate is any other word with a digit or an
``@`` that such words are beside; numbers that follow a number are one candidate.
A pattern of one word says more than one of two only if the word is found next to
varying words: it needs base spans with ``support`` distinct words on its far side.
Patterns and values form a graph.  Round by round a pattern's confidence in a kind
is the mean score of the distinct values that follow it, and a value's score is
1 - prod(1 - confidence) over its patterns of at least ``confident``; base values keep
score 1.  Patterns with fewer than ``support`` distinct values have no confidence.
Candidates behind a confident pattern that reach ``confident`` become spans.

Matches are located without Python: the pieces between matches and the matches
themselves, from one regular expression, add up to offsets.  Long texts yield rows,
not nested arrays, so a text with very many matches is only more rows.  Regular
expressions are linear: possessive, with starts fixed by what stands before.

Defined results: null text is empty; null and repeated ids are told apart by row;
copies of a passage count once as values; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.sources.scratch import written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
_GAP = r"\x20\x09-\x0D"
# A whole token of digits, no IP address.
_NUMBER = rf"\(?+(?![0-9]++\.[0-9]++\.[0-9]++\.[0-9])[0-9][0-9()./-]*+(?![^{_GAP},;:!?])"
_BESIDE = 120
_REGEX = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # At least 16 digits: shorter runs are no cards, and a run's first digit is where it starts.
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "word": rf"(?<![^{_GAP}])(?:{_NUMBER}(?:\x20{_NUMBER})*+|[^{_GAP}0-9@]*+[0-9@])[^{_GAP}]*+",
}
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "word": ""}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", (n <= 19) & F.coalesce(F.call_function("luhn_check", F.when(n <= 19, digits)), F.lit(False)))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, id, kind, start, end, value, left, right) of every match of every kind in
    ``docs`` (row, id and text), and a row of the kind "doc" for each document, which alone
    has its id.  left ends where the match starts, right starts where it ends, and both are
    text, whatever else matches in them."""
    some = docs.select("row", "id", F.col(text_col).alias("text"))
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    none = F.array().cast("array<string>")
    kinds = [F.struct(F.lit("doc").alias("kind"), F.array(F.lit(""), F.lit("")).alias("pieces"), F.array(F.lit("")).alias("matches"))]
    kinds += [
        F.when(
            may & F.contains("text", F.lit(_NEEDS[k])),
            F.struct(
                F.lit(k).alias("kind"),
                F.split("text", F.lit(r), -1).alias("pieces"),
                F.regexp_extract_all("text", F.lit(r), 0).alias("matches"),
            ),
        ).otherwise(F.struct(F.lit(k).alias("kind"), none.alias("pieces"), none.alias("matches")))
        for k, r in _REGEX.items()
    ]
    found = some.select("row", "id", F.explode(F.array(*kinds)).alias("k")).where("size(k.matches) > 0")
    pairs = F.arrays_zip(F.slice("k.pieces", F.lit(1), F.size("k.matches")).alias("piece"), F.col("k.matches").alias("match"), F.slice("k.pieces", F.lit(2), F.size("k.matches")).alias("next"))
    found = found.select("row", F.when(F.col("k.kind") == "doc", F.col("id")).alias("id"), "k.kind", F.posexplode(pairs).alias("at", "pair"))
    found = found.select(
        "row", "id", "kind", "at", F.length("pair.piece").alias("gap"), F.length("pair.match").alias("n"),
        F.col("pair.match").alias("value"), F.right("pair.piece", F.lit(_BESIDE)).alias("before"), F.left("pair.next", F.lit(_BESIDE)).alias("after"),
    )
    # Two matches away is far enough for two words.
    order = Window.partitionBy("row", "kind").orderBy("at")
    tail, head = F.right("value", F.lit(_BESIDE)), F.left("value", F.lit(_BESIDE))
    left = [f(x, k, "").over(order) for k in (2, 1) for f, x in ((F.lag, F.col("before")), (F.lag, tail))]
    right = [f(x, k, "").over(order) for k in (1, 2) for f, x in ((F.lead, head), (F.lead, F.col("after")))]
    found = found.withColumn("left", F.right(F.concat(*left, "before"), F.lit(_BESIDE))).withColumn("right", F.left(F.concat("after", *right), F.lit(_BESIDE)))
    end = F.sum(F.col("gap") + F.col("n")).over(order)
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    return found.where(_valid(F.col("kind"), F.col("value"))).select("row", "id", "kind", "start", "end", "value", "left", "right")


def _free(found: DataFrame) -> DataFrame:
    """Documents, base spans, and the words that overlap none of those, without the marks
    around.  One projection, so that the texts are searched once."""
    word = F.col("kind") == "word"
    base = ~F.col("kind").isin("word", "doc")
    ahead = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    marked = found.withColumn("upto", F.max(F.when(base, F.col("end"))).over(ahead))
    marked = marked.withColumn("from", F.min(F.when(base, F.col("start"))).over(back))
    clear = (F.coalesce("upto", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("from"), F.col("end")) >= F.col("end"))
    marks = r"^(?:(?!\([0-9]++\)[\x20.-]?[0-9])[^\p{L}\p{N}])++"  # "(555) 555" keeps its brackets
    core = F.regexp_replace("value", marks + r"|[^\p{L}\p{N}]++$", "")
    lead = F.length("value") - F.length(F.regexp_replace("value", marks, ""))
    start = F.when(word, F.col("start") + lead).otherwise(F.col("start"))
    value = F.when(word, core).otherwise(F.col("value"))
    end = F.when(word, start + F.length(core)).otherwise(F.col("end"))
    kept = marked.where(~word | clear).select("row", "id", "kind", start.alias("start"), end.alias("end"), value.alias("value"), "left", "right")
    return kept.where((F.col("kind") != "word") | (F.col("end") > F.col("start")))


def _patterns() -> Column:
    """(pattern, far) of a mention, lower-cased: two words before it (one where there is
    one only), one word, and the same after it; far is the word on the far side of a
    one-word pattern."""

    def words(text: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.lower(text), rf"[{_GAP}]+", " "))
        return F.filter(F.split(plain, " "), lambda w: w != "")

    before = F.reverse(words(F.regexp_replace("left", rf"(?<![^{_GAP}])[^\p{{L}}\p{{N}}{_GAP}]++$", "")))
    after = words(F.regexp_replace("right", r"^[^\p{L}\p{N}]++", ""))

    def of(side: str, near: Column) -> list[Column]:
        far = F.get(near, 1)
        two = F.struct(F.concat_ws(" ", F.lit(f"{side}2"), F.get(near, 0), far).alias("pattern"), F.lit(None).cast("string").alias("far"))
        one = F.struct(F.concat_ws(" ", F.lit(f"{side}1"), F.get(near, 0)).alias("pattern"), far.alias("far"))
        return [F.when(F.size(near) > 0, x) for x in (two, one)]

    return F.filter(F.array(*of("<", before), *of(">", after)), lambda x: x.isNotNull())


def learned(free: DataFrame, support: int, confident: float, rounds: int) -> DataFrame:
    """(pattern, value, kind) that the pattern-value graph vouches for."""
    seen = free.where("kind <> 'doc'").select(F.explode(_patterns()).alias("p"), "kind", F.lower("value").alias("value")).select("p.pattern", "p.far", "kind", "value")
    short = F.substring("pattern", 2, 1) == "1"
    varied = seen.where(short & F.col("far").isNotNull() & (F.col("kind") != "word")).select("pattern", "far").distinct()
    varied = varied.groupBy("pattern").count().where(F.col("count") >= support).select("pattern")
    edges = seen.where(~short).unionByName(seen.where(short).join(varied, "pattern", "left_semi"))
    edges = edges.groupBy("pattern", "value").agg(F.min(F.when(F.col("kind") != "word", F.col("kind"))).alias("base"))
    totals = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count("base").alias("seeds"))
    edges = edges.join(totals.where((F.col("n") >= support) & (F.col("seeds") > 0)), "pattern")
    edges = written(edges.select("pattern", "value", "base", "n"), "pii-graph")
    scores = edges.where("base is not null").select("value", F.col("base").alias("kind"), F.lit(1.0).alias("score")).distinct()
    seeds = scores
    trusted = None
    for _ in range(rounds):
        sums = edges.join(scores, "value").groupBy("pattern", "kind").agg((F.sum("score") / F.first("n")).alias("confidence"))
        trusted = written(sums.where(F.col("confidence") >= confident), "pii-patterns")
        # 1 - prod(1 - c), by logarithms; a confidence of 1 is held just below it
        unsure = F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(1 - 1e-9)))))
        more = edges.where("base is null").join(trusted, "pattern").groupBy("value", "kind").agg((1 - unsure).alias("score"))
        scores = written(seeds.unionByName(more), "pii-scores")
    found = edges.where("base is null").join(trusted, "pattern").join(scores.where(F.col("score") >= confident), ["value", "kind"])
    return found.select("pattern", "value", "kind").distinct()


def spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 8, confident: float = 0.9, rounds: int = 3
) -> DataFrame:
    """One row per document: id and ``found``, sorted (kind_no, start, end, base)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    free = written(_free(mentions(rows)), "mentions")
    known = learned(free, support, confident, rounds).select("pattern", F.col("value").alias("known"), F.col("kind").alias("of"))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    base = free.where("kind not in ('word', 'doc')").select("row", F.struct(number.alias("no"), "start", "end", F.lit(True).alias("base")).alias("span"))
    words = free.where("kind = 'word'").select("row", "start", "end", F.lower("value").alias("value"), F.explode(_patterns()).alias("p"))
    words = words.select("row", "start", "end", "value", "p.pattern")
    new = words.join(known, (words["pattern"] == known["pattern"]) & (F.col("value") == F.col("known"))).select("row", "start", "end", F.col("of").alias("kind"))
    new = new.groupBy("row", "start", "end").agg(F.min("kind").alias("kind"))
    new = new.select("row", F.struct(number.alias("no"), "start", "end", F.lit(False).alias("base")).alias("span"))
    hits = base.unionByName(new)
    # One shuffle brings ids and spans together; a document without spans has its own row only.
    every = free.where("kind = 'doc'").select("row", F.struct("id").alias("own"), F.lit(None).cast(hits.schema["span"].dataType).alias("span"))
    every = every.unionByName(hits.select("row", F.lit(None).cast(every.schema["own"].dataType).alias("own"), "span"))
    both = every.groupBy("row").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list("span")).alias("found"))
    return both.select(F.col("own.id").alias(id_col), "found")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, their digest, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))

    def text(spans: Column) -> Column:
        part = F.transform(spans, lambda s: F.concat(F.element_at(names, s["no"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
        return F.array_join(part, ",")

    base = F.filter("found", lambda s: s["base"])

    def count(number: int) -> Column:
        return F.size(F.filter(base, lambda s: s["no"] == number)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
