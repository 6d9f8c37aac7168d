"""Personal data: patterns for e-mail, ip, card and phone, and information-theoretic sanitisation of terms around them.

DataFrame functions only. *Base* mentions are the matches of fixed patterns, leftmost and without
overlap for each kind, kept when they pass the kind's test. *Terms* are found from the corpus: with N
documents, df(c) documents that mention entity c (a kind with its value), df(t) documents that hold the word t and
n(c,t) documents in which t is among the ``reach`` words before or after a mention of c, the pointwise mutual
information of c and t is log(N n / (df(c) df(t))), and c holds log(N / df(c)) of information. A term discloses c when the former
reaches the share ``alpha`` of the latter, which is n(c,t) / df(t) >= (df(c)/N)^(1-alpha), with n(c,t) >= ``least``
documents (1: no floor, as most personal data occurs once). Every mention counts for its value and for what it shares with
others: the domain of a mail address, the /24 of an ip, the issuer of a card (six digits), a phone number without its last
four digits. The kind itself is no such entity: the sanitised text states it. Disclosing terms are removed wherever they
stand in a document that mentions the entity they disclose; base mentions are generalised to their kind.

Words are the runs of letters of the whole text. Words that overlap a base mention are part of it: they are no terms, and
contexts read on past them, and past matches that fail their test, until they have ``reach`` words or the text ends.
All statistics count all documents and whole texts. Only words that may be terms are counted: they are tested against
a bitmap of bounded size, which loses none of them.

Defined cases: null text counts as empty and has no spans; several kinds may overlap, all are kept; rows that repeat
are each reported (and count as documents); null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.llm.shared import text_of, written

KINDS = ("email", "ip", "card", "phone", "term")
# The fixed patterns, written so that a long run of characters is scanned once and without recursion:
# a match may only begin where its run begins or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# a text without these cannot match
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits pass the Luhn test."""
    last = F.length(digits)

    def weight(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((last - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), last), F.lit(0), lambda acc, i: acc + weight(i))
    return F.when(last.between(12, 19), total % 10 == 0).otherwise(False)


def _passes(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", _luhn(digits))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


def _scans(text: Column) -> list[Column]:
    """Per kind the matches (``f_<kind>``) and the lengths of the stretches between them (``g_<kind>``)."""
    out = []
    for kind, pattern in PATTERNS.items():
        between = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        out += [F.when(text.rlike(NEEDS[kind]), c).alias(f"{p}_{kind}") for p, c in (("f", F.regexp_extract_all(text, F.lit(pattern), 0)), ("g", between))]
    return out


def _matches(kind: str) -> Column:
    """Per match its kind, number, the code points since the last one and the value."""
    found, between = F.col(f"f_{kind}"), F.col(f"g_{kind}")
    zipped = F.arrays_zip(found.alias("m"), between.alias("g"))
    return F.transform(F.slice(zipped, 1, F.size(found)), lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m["g"].alias("gap"), m["m"].alias("value")))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text) of the documents; ``row`` numbers them."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))


def _candidates(rows: DataFrame) -> DataFrame:
    """(row, id, text, each): every match of a pattern; the text is null where none of them can pass."""
    scanned = rows.select("row", "id", "text", *_scans(F.col("text")))
    each = F.flatten(F.filter(F.array(*map(_matches, PATTERNS)), lambda a: a.isNotNull()))
    # a number of fewer than 12 characters is no card
    able = F.exists("each", lambda m: (m["kind"] != "card") | (F.length(m["value"]) >= 12))
    return scanned.select("row", "id", "text", each.alias("each")).select("row", "id", F.when(able, F.col("text")).alias("text"), "each")


def mentions(candidates: DataFrame) -> DataFrame:
    """(row, id, kind, value, start, end) of every base mention, and one row with null kind for a text without any.

    Positions are code points, the end is exclusive.
    """
    flat = candidates.select("row", "id", F.explode_outer("each").alias("m")).select("row", "id", "m.*")
    size = F.length("value").cast("long")
    end = F.sum(F.col("gap") + size).over(W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    placed = flat.withColumn("end", end).withColumn("start", F.col("end") - size)
    good = F.col("kind").isNull() | _passes(F.col("kind"), F.col("value"))
    # a failing match leaves its row behind, so that a text without mentions is still there
    kept = placed.select("row", "id", *[F.when(good, F.col(c)).alias(c) for c in ("kind", "value", "start", "end")])
    return written(kept, "mentions")


def _entities() -> Column:
    """The value of a mention and what it shares with others."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    shared = (
        F.when(F.col("kind") == "email", F.lower(F.substring_index("value", "@", -1)))
        .when(F.col("kind") == "ip", F.substring_index("value", ".", 3))
        .when(F.col("kind") == "card", F.substring(digits, 1, 6))
        .otherwise(F.substring(digits, F.lit(1), F.length(digits) - 4))
    )
    return F.array(F.concat_ws(":", "kind", "value"), F.concat_ws("~", "kind", shared))


def _words_and_mentions(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """(row, start, end, term, kind, value, k) of the documents with mentions: words outside all mentions with their number ``k``, and
    mentions (null term) with the number of words before them."""
    letters = r"\p{L}++"
    own = found.where("kind IS NOT NULL")
    texts = candidates.where("text IS NOT NULL").join(own.select("row").distinct(), "row", "left_semi")
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(letters), 0).alias("word"), F.transform(F.split("text", letters, -1), lambda g: F.length(g).cast("long")).alias("gap"))
    words = texts.select("row", F.posexplode(zipped).alias("i", "w")).where("w.word IS NOT NULL").select("row", "i", F.col("w.word").alias("word"), "w.gap")
    size = F.length("word").cast("long")
    end = F.sum(F.col("gap") + size).over(W.partitionBy("row").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    none = F.lit(None).cast("string")
    words = words.select("row", (end - size).alias("start"), end.alias("end"), F.lower("word").alias("term"), none.alias("kind"), none.alias("value"))
    marks = own.select("row", "start", "end", none.alias("term"), "kind", "value")
    order = W.partitionBy("row").orderBy("start", F.col("term").isNotNull(), "end", "kind")
    # words do not overlap each other, so a mention that begins inside a word comes right after it
    reached = F.max(F.when(F.col("term").isNull(), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    placed = words.unionByName(marks).withColumn("reached", reached).withColumn("next", F.lead("start").over(order))
    free = F.col("term").isNotNull() & (F.coalesce(F.col("reached"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end"))
    k = F.sum(free.cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0))
    numbered = placed.withColumn("free", free).withColumn("k", k).where("free OR term IS NULL").drop("reached", "next", "free")
    return written(numbered, "words-and-mentions")


def _context_terms(placed: DataFrame, reach: int) -> DataFrame:
    """(row, entity, term) of the words next to the mentions."""
    marks = placed.where("term IS NULL").select("row", _entities().alias("entities"), "k")
    spots = marks.select("row", F.explode("entities").alias("entity"), "k").distinct().select("row", "entity", F.explode(F.sequence(F.col("k") - reach + 1, F.col("k") + reach)).alias("k"))
    return spots.join(placed.where("term IS NOT NULL").select("row", "k", "term"), ["row", "k"]).select("row", "entity", "term").distinct()


def _document_counts(docs: DataFrame, terms: DataFrame, text_col: str, most_bits: int = 1 << 26) -> DataFrame:
    """(term, df): documents that hold each term, counted over whole texts."""
    size = 64
    while size < min(most_bits, 32 * terms.count()):
        size *= 2
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    bits = terms.select(slot("term").alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("CAST(s & 63 AS INT)"))).alias("bits"))
    words = docs.select(F.explode(F.array_distinct(F.transform(F.split(text_of(text_col), r"[^\p{L}]+"), F.lower))).alias("term")).withColumn("s", slot("term"))
    # at most most_bits / 64 rows are broadcast
    maybe = words.withColumn("word", F.shiftright("s", 6)).join(F.broadcast(bits), "word").where(F.expr("getbit(bits, CAST(s & 63 AS INT)) = 1"))
    counted = maybe.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.join(terms, "term", "left_semi")


def disclosing_terms(docs: DataFrame, candidates: DataFrame, found: DataFrame, text_col: str = "text", reach: int = 4, alpha: float = 0.8, least: int = 1) -> DataFrame:
    """(row, start, end) of every word that discloses an entity its document mentions."""
    placed = _words_and_mentions(candidates, found)
    near = written(_context_terms(placed, reach), "context-terms")
    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    pairs = written(pairs, "entity-terms")
    mentioned = placed.where("term IS NULL").select("row", F.explode(_entities()).alias("entity")).distinct()
    entities = mentioned.groupBy("entity").agg(F.count(F.lit(1)).alias("df_c"))
    total = docs.count()
    # A term is in at least as many documents as have it next to a mention. Pairs that fail the threshold on that count alone
    # (common words, above all) fail it on the true one, so these words need not be counted.
    beside = near.select("row", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    told = F.log(F.lit(float(max(1, total))) * F.col("n") / (F.col("df_c") * F.col("df"))) >= alpha * F.log(F.lit(float(max(1, total))) / F.col("df_c"))
    pairs = written(pairs.join(entities, "entity").join(beside, "term").where(told).select("entity", "term", "n", "df_c"), "possible-terms")
    counts = written(_document_counts(docs, pairs.select("term").distinct(), text_col), "term-documents")
    known = pairs.join(counts, "term")
    telling = written(known.where(told).select("entity", "term"), "disclosing")
    # by the term first: one that tells of many entities is rare, while a common entity may have many documents and many terms
    words = placed.where("term IS NOT NULL").select("row", "term", "start", "end")
    told_here = words.select("row", "term").distinct().join(telling, "term").join(mentioned, ["row", "entity"], "left_semi").select("row", "term").distinct()
    return words.join(told_here, ["row", "term"], "left_semi").select("row", "start", "end")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 4, alpha: float = 0.8, least: int = 1) -> DataFrame:
    """(row, id, spans): per row all spans as structs (start, rank, end, kind), sorted; base kinds rank before terms."""
    candidates = written(_candidates(_numbered(docs, id_col, text_col)), "candidates")
    found = mentions(candidates)
    base = found.select("row", "id", "start", "end", "kind")
    terms = disclosing_terms(docs, candidates, found, text_col, reach, alpha, least).select("row", F.lit(None).cast(found.schema["id"].dataType).alias("id"), "start", "end", F.lit("term").alias("kind"))
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    one = F.when(F.col("kind").isNotNull(), F.struct("start", rank.alias("rank"), "end", "kind"))
    return base.unionByName(terms).groupBy("row").agg(F.max("id").alias("id"), F.array_sort(F.collect_list(one)).alias("spans"))


def sanitised(text: Column, found: Column) -> Column:
    """The text with base mentions generalised to their kind and disclosing terms removed; of overlapping spans the first is taken."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        token = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        moved = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), token).alias("out"))
        return F.when(s["start"] >= acc["at"], moved).otherwise(acc)

    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
