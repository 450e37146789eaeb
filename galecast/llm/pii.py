"""PII: fixed patterns for identifiers, and information-theoretic sanitisation of the terms that reveal them.

Identifiers (email, ip, card, phone) are the leftmost non-overlapping matches
of one pattern each, with a check on the match.  They are the protected
entities.  What else gives an entity away is read from the corpus: a term is a
word of four letters or more, and it co-occurs with an entity where it stands
within ``REACH`` characters of it, on whatever line.  With c(t) the occurrences of
a term in all documents, N those of all terms, c(t, e) those near e and m(e)
those of all terms near e,

    PMI(t; e) = log2(c(t, e) N / (c(t) m(e)))     IC(e) = log2(N / m(e))

and PMI / IC is the share of the entity's information content that the term
discloses: 1 if it occurs near e only.  Terms that disclose ``GENERALISE`` or
more, seen in ``CONTEXTS`` different contexts of the entity at least (copies of
a passage are one context), get a span wherever they occur, outside identifiers, in
the documents that hold the entity, and from ``REMOVE`` on they are removed rather
than replaced by a general word.

Everything is DataFrame functions.  Counts are partial aggregates over all
documents; terms near one frequent entity are pre-aggregated, and the joins
that bring counts back may be split.  The terms of a document are joined by term
(a term discloses few entities, as it must occur mostly near them), then by
document and entity.  Text is shuffled only if the list of documents with
disclosing terms is too large to be broadcast.

Positions are code points, the end exclusive.  A match is placed by the lengths
of what ``split`` leaves between matches.  The patterns are written so that no
text takes more than a few steps per character; each is equal to its plain form
in the contract (see the tests).

Defined results.  Null text is empty.  Repeated rows get equal spans.  Null ids
are kept.  Other columns are kept by ``sanitise`` and may have any name but
those that begin with ``pii_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage_table

REACH, CONTEXTS = 64, 2
GENERALISE, REMOVE = 0.9, 0.97
TERM = r"\p{L}{4,}"
KINDS = ("email", "ip", "card", "phone")
#: An email may begin where the last one ended; the others begin and end at runs of their own characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MASK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "general": "[TERM]", "removed": ""}
SPAN = "array<struct<start:int,end:int,value:string>>"


def _located(text: Column, pattern: str) -> Column:
    """``start, end, value`` of every match, in order."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(F.filter(parts, lambda x: x["hit"].isNotNull()), none, add, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))

    def part(i: Column) -> Column:
        digit = F.substring(back, i, F.lit(1)).cast("int")
        double = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, double).otherwise(digit)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(back)), part), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _sound(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike(PATTERNS[kind]))
    return F.when(hint, F.filter(_located(text, PATTERNS[kind]), lambda s: _sound(kind, s["value"]))) \
        .otherwise(F.array().cast(SPAN))


def _rows(docs: DataFrame) -> DataFrame:
    """Per document the base spans, for each the text within reach, and the terms where there is one; staged without the text."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("pii_text"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "pii_text", "text", *[_base(F.col("text"), k).alias(k) for k in KINDS])

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                    s["value"].alias("value")))

    spans = F.concat(*[named(k) for k in KINDS])
    text = F.col("text")

    def context(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - REACH, F.lit(0)) + 1, F.least(s["start"], F.lit(REACH)))
        after = F.substring(text, s["end"] + 1, F.lit(REACH))
        return F.struct(F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), before.alias("before"),
                        (s["start"] - F.length(before)).alias("before_at"), after.alias("after"), s["end"].alias("after_at"),
                        F.length(text).alias("length"))

    return stage_table(rows.withColumn("spans", spans).select(
        "doc_id", "pii_text", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                                       s["end"].alias("end"))).alias("spans"),
        F.transform("spans", context).alias("contexts"),
        F.when(F.size("spans") > 0, F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)))
        .alias("words")), "pii-rows")


def _near(rows: DataFrame) -> DataFrame:
    """Every term near an entity: ``doc_id, pii_text, entity, context, term, start, end``."""
    c = rows.select("doc_id", "pii_text", F.explode("contexts").alias("c")).select("doc_id", "pii_text", "c.*")
    whole = lambda name, cut: F.filter(_located(F.col(name), TERM), cut)  # noqa: E731  words cut by the reach are left out
    before = whole("before", lambda s: (s["start"] > 0) | (F.length("before") < REACH))
    after = whole("after", lambda s: (s["end"] < F.length("after")) | (F.length("after") < REACH)
                  | (F.col("after_at") + F.length("after") == F.col("length")))
    shift = lambda spans, at: F.transform(spans, lambda s: F.struct(
        F.lower(s["value"]).alias("term"), (s["start"] + F.col(at)).alias("start"), (s["end"] + F.col(at)).alias("end")))
    return (c.withColumn("t", F.explode(F.concat(shift(before, "before_at"), shift(after, "after_at"))))
            .select("doc_id", "pii_text", "entity", F.xxhash64("before", "after").alias("context"), "t.*"))


def disclosing_terms(docs: DataFrame, near: DataFrame, contexts: int = CONTEXTS, share: float = GENERALISE) -> DataFrame:
    """``entity, term, disclosed`` of the terms that disclose ``share`` or more of an entity."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    counts = words.groupBy(F.lower("term").alias("term")).agg(F.count("*").alias("c_term"))
    counts = stage_table(counts, "pii-terms")
    pairs = (near.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term")
             .agg(F.sum("n").alias("c_both"), F.count("*").alias("contexts")))
    around = near.groupBy("entity").agg(F.count("*").alias("m"))
    n = float(counts.agg(F.sum("c_term")).first()[0] or 0)
    return (pairs.where(F.col("contexts") >= contexts).join(around, "entity").join(counts, "term")
            .withColumn("disclosed", F.log2(F.col("c_both") * n / (F.col("c_term") * F.col("m"))) / F.log2(n / F.col("m")))
            .where((F.col("m") < n) & (F.col("disclosed") >= share)).select("entity", "term", "disclosed"))


def _everywhere(docs: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, pii_text, start, end, disclosed`` of each disclosing term in all of the documents that hold its entity."""
    held = rows.select("doc_id", "pii_text", F.explode(F.array_distinct(F.transform("contexts", lambda c: c["entity"]))).alias("entity"))
    held = held.join(known.select("entity").distinct(), "entity").select(
        F.col("doc_id").alias("own"), F.col("pii_text").alias("own_text"), F.col("entity").alias("own_entity"))
    terms = rows.select("doc_id", "pii_text", F.explode("words").alias("term")).join(known, "term")
    same = (F.col("pii_text") == F.col("own_text")) & F.col("doc_id").eqNullSafe(F.col("own"))
    marks = (terms.join(held, same & (F.col("entity") == F.col("own_entity")), "left_semi")
             .groupBy("doc_id", "pii_text", "term").agg(F.max("disclosed").alias("disclosed"))
             .groupBy(F.col("doc_id").alias("own"), F.col("pii_text").alias("own_text"))
             .agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosed"))).alias("marks")))
    marks = stage_table(marks, "pii-marks", small=True)
    texts = docs.select("doc_id", F.xxhash64("text").alias("pii_text"), "text").join(marks, same)
    parts = F.zip_with(F.split("text", TERM, -1), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)),
                       lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,disclosed:double>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end, disclosed = start + F.length(x["hit"]), F.element_at("marks", F.lower(x["hit"]))
        span = F.struct(start.alias("start"), end.alias("end"), disclosed.alias("disclosed"))
        return F.struct(end.alias("at"), F.when(disclosed.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    spots = F.aggregate(F.filter(parts, lambda x: x["hit"].isNotNull()), none, add, lambda acc: acc["out"])
    spots = texts.select("doc_id", "pii_text", F.explode(spots).alias("s")).select("doc_id", "pii_text", "s.*")
    base = rows.select(F.col("doc_id").alias("own"), F.col("pii_text").alias("own_text"), F.explode("spans").alias("b"))
    inside = same & (F.col("start") < F.col("b.end")) & (F.col("b.start") < F.col("end"))
    return spots.join(base, inside, "left_anti")


def find_pii(docs: DataFrame, contexts: int = CONTEXTS, share: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Per document ``doc_id, pii_text`` (a hash of the text), ``base`` and ``terms``: arrays of ``kind, start, end``.

    The kind of a term is ``general`` or ``removed``.
    """
    rows = _rows(docs)
    near = stage_table(_near(rows), "pii-near", small=True)
    known = stage_table(disclosing_terms(docs, near, contexts, share), "pii-known", small=True)
    beside = near.join(known, ["entity", "term"]).select("doc_id", "pii_text", "start", "end", "disclosed")
    spots = beside.unionByName(_everywhere(docs, rows, known))
    found = (spots.groupBy("doc_id", "pii_text", "start", "end").agg(F.max("disclosed").alias("disclosed"))
             .groupBy(F.col("doc_id").alias("own"), F.col("pii_text").alias("own_text"))
             .agg(F.array_sort(F.collect_list(F.struct(
                 "start", "end", F.when(F.col("disclosed") >= remove, "removed").otherwise("general").alias("kind")))).alias("terms")))
    terms = F.transform("terms", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return (rows.select("doc_id", "pii_text", F.col("spans").alias("base"))
            .join(found, (F.col("pii_text") == F.col("own_text")) & F.col("doc_id").eqNullSafe(F.col("own")), "left")
            .select("doc_id", "pii_text", "base",
                    F.coalesce(terms, F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("terms")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, contexts: int = CONTEXTS, share: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with its identifiers masked and its disclosing terms replaced or removed."""
    found = find_pii(docs, contexts, share, remove).dropDuplicates(["doc_id", "pii_text"]).select(
        F.col("doc_id").alias("pii_id"), F.col("pii_text").alias("pii_of"), F.array_sort(F.transform(
            F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        .alias("pii_all"))
    apart = F.aggregate(  # of spans that overlap, the first one
        "pii_all", F.slice("pii_all", 1, 0),
        lambda out, s: F.when((F.size(out) == 0) | (F.coalesce(F.get(out, F.size(out) - 1)["end"], F.lit(0)) <= s["start"]),
                              F.concat(out, F.array(s))).otherwise(out))
    names = F.create_map(*[F.lit(x) for kv in MASK.items() for x in kv])
    end = lambda i: F.coalesce(F.get("pii_kept", i)["end"], F.lit(0))
    pieces = F.transform("pii_kept", lambda s, i: F.concat(
        F.substring("text", end(i - 1) + 1, s["start"] - end(i - 1)), names[s["kind"]]))
    last = end(F.size("pii_kept") - 1)
    own = docs.withColumn("pii_hash", F.xxhash64("text"))
    return (own.join(found, (F.col("pii_hash") == F.col("pii_of")) & F.col("doc_id").eqNullSafe(F.col("pii_id")), "left")
            .withColumn("pii_kept", apart)
            .withColumn("text", F.when(F.size("pii_kept") > 0, F.concat(
                F.array_join(pieces, ""), F.substring("text", last + 1, F.length("text")))).otherwise(F.col("text")))
            .select(*docs.columns))
