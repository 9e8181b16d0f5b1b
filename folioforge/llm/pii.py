"""Personal data: patterns for four kinds, and terms that reveal what the patterns find; DataFrame operations only.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its check. The method adds spans of
kind ``term``: a protected entity is a value of a base span. Words of a whole text, those inside of base spans left out,
co-occur with the entities that it holds; all counts are of distinct texts. Of N texts, n hold an entity, d hold a term and c hold both. The share of the
term's texts that hold the entity is estimated as P = (c + SHRINK * n/N) / (d + SHRINK), which draws terms that were
seen once or twice towards the entity's own rate instead of leaving them out. A term discloses the share
1 + log P / log(N/n) of the entity's information, its pointwise mutual information over the entity's information
content. Terms that disclose DISCLOSED of it at least, and foretell the entity with P >= LIKELY, are spans in every
document that holds both; other documents are left alone. It follows that a term has to occur with the entity in two
different texts at least, at every size of the corpus: with SHRINK = 1, P stays too low after one.
``sanitised`` generalises spans to the name of their kind.

Defined results: a null text is the empty text. Copies of a text count once. Repeated rows get the
same spans; other columns are not read. Patterns are possessive where that can't change a match, so that very long runs
need no stack, and may begin only where a run begins or the last match ended, which leaves leftmost matches as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import hot_bound, lookup, lookup_left, stored

KINDS = ["email", "ip", "card", "phone", "term"]
#: The kinds' patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
SHRINK, DISCLOSED, LIKELY, TERM = 1, 0.9, 0.6, r"[\p{L}\p{N}]{2,}"
#: Terms up to this many are broadcast, so that other words don't leave the scan that counts them; beyond that they are joined.
MOST_TERMS = 1_000_000
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, pattern: Column | str, kind: int) -> Column:
    """Spans of all matches in order, in code points: the text between them is what a split leaves."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    both = F.arrays_zip(found.alias("value"), between.alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["value"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(F.filter(both, lambda x: x["value"].isNotNull()), start, add, lambda s: s["spans"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Every second digit from the right doubles (less 9 above 9); the sum is a multiple of 10."""

    def worth(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = digit * 2
        return F.when(i % 2 == 0, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def base_spans(text: Column) -> Column:
    """All spans of the four kinds that pass their checks; texts without a kind's marks skip its pattern."""
    none = F.array().cast(SPANS)

    def kept(mark: Column, pattern: str, kind: int, check) -> Column:
        return F.when(mark, F.filter(matches(text, pattern, kind), lambda s: check(s["value"]))).otherwise(none)

    size = lambda v: F.length(digits_of(v))
    card = lambda v: F.when(size(v).between(14, 19), passes_luhn(digits_of(v))).otherwise(False)
    return F.concat(
        kept(F.contains(text, F.lit("@")), EMAIL, 0, lambda v: F.lit(True)),
        kept(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP, 1, lambda v: v.rlike(OCTETS)),
        kept(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), CARD, 2, card),
        kept(F.contains(text, F.lit("+")), PHONE, 3, lambda v: size(v).between(10, 15)),
    )


def entity_of(span: Column) -> Column:
    """Kind and value: lower case for emails and addresses, digits alone for numbers."""
    return F.concat(span["kind"].cast("string"), F.lit(":"), F.when(span["kind"] < 2, F.lower(span["value"])).otherwise(digits_of(span["value"])))


def has_marks(text: Column) -> Column:
    """Whether a text may hold a base span: an at sign, a plus or enough digits; false for most texts."""
    return F.contains(text, F.lit("@")) | F.contains(text, F.lit("+")) | text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]|[0-9](?:[\x20-]?[0-9]){13}")


def masked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the characters of spans."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, s: Column) -> Column:
        begin, end = F.greatest(s["start"], state["at"]), F.greatest(s["end"], state["at"])
        parts = F.array(F.substring(text, state["at"] + 1, begin - state["at"]), F.repeat(F.lit(" "), end - begin))
        return F.struct(end.alias("at"), F.concat(state["parts"], parts).alias("parts"))

    whole = F.aggregate(F.array_sort(spans), start, add, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def terms_of(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def least_share(n: Column, total: int) -> Column:
    """The share P that a term has to reach to disclose an entity which n of total texts hold."""
    rate = n / F.greatest(F.lit(float(total)), n + 1)
    return F.greatest(F.lit(LIKELY), F.pow(rate, F.lit(1 - DISCLOSED)))


def reaches(both: Column, seen: Column, n: Column, total: int) -> Column:
    rate = n / F.greatest(F.lit(float(total)), n + 1)
    return both + SHRINK * rate >= least_share(n, total) * (seen + SHRINK)


def with_classes(held: DataFrame) -> DataFrame:
    """print, terms, classes of the texts that hold an entity which other texts hold too.

    Entities with the same texts co-occur with the same terms, so they are one class: class and n (texts that hold it).
    """
    holders = held.select("print", F.explode("entities").alias("entity"))
    own = F.xxhash64("print")
    known = holders.groupBy("entity").agg(F.count("*").alias("n"), F.bit_xor(own).alias("one"), F.sum(F.hash("print").cast("long")).alias("two")).where("n > 1")
    known = stored(known.select("entity", "n", F.xxhash64("n", "one", "two").alias("class"), F.col("n").alias("uses")))
    placed = lookup(holders, known, "entity", "uses", hot_bound(holders.count()))
    return held.select("print", "terms").join(placed.groupBy("print").agg(F.collect_set(F.struct("class", "n")).alias("classes")), "print")


def disclosing_terms(texts: DataFrame, held: DataFrame, named: DataFrame, total: int) -> DataFrame:
    """class, term, both for all terms that disclose enough of a class of entities.

    texts: of ``with_classes``; held: print, terms of all texts with an entity; named: print, text (masked) of all documents. How
    many texts hold a term is counted for those terms only that could still disclose if no text without entities had them.
    """
    pairs = texts.select(F.explode("terms").alias("term"), "classes").select("term", F.explode("classes").alias("x"))
    together = stored(pairs.groupBy("term", F.col("x.class").alias("class"), F.col("x.n").alias("n")).agg(F.count("*").alias("both")).where("both > 1"))
    seen = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("seen"))
    uses = seen.join(together.groupBy("term").agg(F.count("*").alias("uses")), "term")
    open_pairs = stored(lookup(together, uses, "term", "uses", hot_bound(together.count())).where(reaches(F.col("both"), F.col("seen"), F.col("n"), total)))
    wanted = stored(open_pairs.select("term").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_TERMS else wanted
    words = named.select("print", F.explode(terms_of(F.col("text"))).alias("term")).join(wanted, "term", "left_semi")
    spread = words.groupBy("term").agg(F.countDistinct("print").alias("texts"))
    return open_pairs.join(spread, "term").where(reaches(F.col("both"), F.col("texts"), F.col("n"), total)).select("class", "term", "both")


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc (all columns of docs) and ``pii_spans``: start, kind (a place in KINDS), end and value of all spans, by start, then kind."""
    value = F.coalesce(F.col(text), F.lit(""))
    print_ = F.concat_ws("-", F.hex(F.xxhash64(value)), F.hex(F.hash(value)))
    named = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), value.alias("text"), print_.alias("print"))
    value, marked = F.col("text"), has_marks(F.col("text"))
    found = named.where(marked).select("print", value, base_spans(value).alias("spans")).where(F.size("spans") > 0)
    found = found.select("print", F.array_distinct(F.transform("spans", entity_of)).alias("entities"), terms_of(masked(value, F.col("spans"))).alias("terms"))
    held = stored(found.groupBy("print").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count("*").alias("copies")))
    texts = stored(with_classes(held))
    total = named.agg(F.countDistinct("print")).first()[0]
    bare = F.when(marked, masked(value, base_spans(value))).otherwise(value)
    flagged = stored(disclosing_terms(texts, held, named.select("print", bare.alias("text")), total))
    uses = flagged.agg(F.coalesce(F.sum("both"), F.lit(0))).first()[0]
    pairs = texts.select("print", F.explode("terms").alias("term"), "classes").select("print", "term", F.explode("classes.class").alias("class"))
    own = lookup(pairs, flagged, ["class", "term"], "both", hot_bound(uses)).groupBy("print").agg(F.array_sort(F.collect_set("term")).alias("pii_terms"))
    # texts with very many copies are few and looked up by broadcast
    by_text = stored(own.join(held.select("print", "copies"), "print"))
    rows = lookup_left(named.where(marked), by_text, "print", "copies", hot_bound(docs.count()))
    rows = rows.unionByName(named.where(~marked).withColumn("pii_terms", F.lit(None).cast("array<string>")))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("pii_terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    terms = F.when(F.col("pii_terms").isNotNull(), matches(bare, pattern, 4)).otherwise(F.array().cast(SPANS))
    return rows.select("doc", F.array_sort(F.concat(base_spans(value), terms)).alias("pii_spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = with_spans(docs.select("doc_id", "text")).select("doc.doc_id", "pii_spans")

    def count(kind: int) -> Column:
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("pii_spans", lambda s: s["kind"] < 4)
    return rows.select("doc_id", *[count(i).alias(f"n_{KINDS[i]}") for i in range(4)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, columns unchanged, with every span in the text replaced by its kind in brackets; overlapping spans are one."""
    rows = with_spans(docs, text)
    original = F.col("doc").getField(text)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, s: Column) -> Column:
        fresh = F.concat(state["parts"], F.array(F.substring(original, state["at"] + 1, s["start"] - state["at"]), F.element_at(names, s["kind"] + 1)))
        inside = s["start"] < state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(inside, state["parts"]).otherwise(fresh).alias("parts"))

    def end(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(original, state["at"] + 1, F.length(original)))

    clean = F.when(F.size("pii_spans") > 0, F.aggregate("pii_spans", start, add, end)).otherwise(original)
    return rows.select(*[(clean if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns])
