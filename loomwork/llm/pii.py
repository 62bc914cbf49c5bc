"""Personal data: fixed patterns, then information-theoretic sanitisation. Built-in functions only.

The values that the patterns find are the protected entities. Terms near them are counted over the corpus; a
term t discloses an entity e to the degree PMI(e; t) / IC(e) = log(N c(e,t) / (c(e) c(t))) / log(N / c(e)), which is 1
where t always means e. Terms above the lower threshold are generalised, those above the upper one removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import read, stored

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalise", "remove")

# The patterns of the base kinds. Possessive forms match the same and never recurse or go back over
# long runs; an email starts where a run of its characters starts, or right behind the email before.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Four letters or more, or a shorter word with a capital (or of a script without): names like Li and Ann.
TERM = r"(?<![\p{L}\p{N}_@.+-])(?:\p{L}[\p{L}\p{N}_-]{3,}+|[\p{Lu}\p{Lt}\p{Lo}][\p{L}\p{N}_-]{1,2}+)(?![\p{L}\p{N}_@]|[.+-][\p{L}\p{N}@])"
BORDER = r"[.!?](?=\s)|[\n\r\u3002\uFF01\uFF1F]"  # of sentences
NEAR, FAR = 8, 24  # words on either side of an entity that count anyway, and that count up to the border of the sentence
SUPPORT = 1  # distinct texts in which a term stands near an entity before it counts as evidence
PLAIN = 3  # distinct texts from which on evidence counts in full; less is shrunk, and counts for names alone
GENERALISE, REMOVE = 0.8, 0.95
LITERALS = 20_000  # disclosed terms that may go into an expression; beyond, they are joined


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: int, value: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.rlike(value, F.lit(f"^{BYTE}(?:\\.{BYTE}){{3}}$"))
    n = F.length(digits(value))
    if kind == 2:
        return n.between(14, 19) & F.when(n.between(14, 19), luhn(digits(value))).otherwise(F.lit(False))
    return n.between(10, 15)


def passing(kind: int):
    return lambda value: passes(kind, value)


def found(text: Column, pattern: str, only: Column | None = None) -> Column:
    """All matches of a pattern; none where ``only`` says that there can be none."""
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return every if only is None else F.when(only, every).otherwise(F.array().cast("array<string>"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, add) -> Column:
    """The running results of ``add`` over an array of numbers: in pieces of the root of its length, then over the pieces, so
    that building the arrays costs the power 1.5 of the length, not its square."""
    empty = F.array().cast("array<int>")

    def scan(some: Column) -> Column:
        step = lambda done, x: F.concat(done, F.array(F.when(F.size(done) == 0, x).otherwise(add(F.element_at(done, F.greatest(F.size(done), F.lit(1))), x))))
        return F.aggregate(some, empty, step)

    def joined(pieces: Column) -> Column:
        ends = scan(F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.element_at(p, -1)))
        rest = F.zip_with(F.slice(pieces, F.lit(2), F.size(pieces) - 1), ends, lambda p, e: F.transform(p, lambda x: add(e, x)))
        return F.concat(F.element_at(pieces, 1), F.flatten(rest))

    def cut(some: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(some))).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), width - 1), lambda k: scan(F.slice(some, k * width + 1, width)))
        return F.when(F.size(some) == 0, empty).otherwise(bound(F.filter(pieces, lambda p: F.size(p) > 0), joined))

    return bound(values, cut)


def placed(text: Column, pattern: str, matches: Column, kind: Column | int, keep) -> Column:
    """Spans (start, kind, end, value) of those ``matches`` that ``keep`` accepts.

    Places are running sums of the lengths of matches and of what ``split`` leaves before them, in code points.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    kind = F.lit(kind) if isinstance(kind, int) else kind

    def spans(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), F.lit(1), F.size(found))
        ends = running(F.zip_with(found, gaps, lambda m, g: F.length(m) + g), lambda a, b: a + b)
        every = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), kind.alias("kind"), e.alias("end"), m.alias("value")))
        return F.when(F.exists(found, keep), F.filter(every, lambda s: keep(s["value"]))).otherwise(empty)

    return bound(matches, spans)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``base``: the spans of the fixed kinds by start, then kind as listed."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    has = (F.contains("text", F.lit("@")), F.contains("text", F.lit(".")), None, F.contains("text", F.lit("+")))
    for i, (name, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE))):
        out = out.withColumn(f"m_{name}", found(F.col("text"), pattern, has[i]))
    spans = [placed(F.col("text"), p, F.col(f"m_{n}"), i, passing(i)) for i, (n, p) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE)))]
    return out.select("doc_id", "text", F.array_sort(F.concat(*spans)).alias("base"))


def terms_of(text: Column) -> Column:
    """Distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(found(text, TERM), lambda m: F.lower(m)))


WORD_KIND = 10


def entity_of(span: Column) -> Column:
    return F.concat(span["kind"].cast("string"), F.lit(":"), F.lower(span["value"]))


def contexts(base: DataFrame) -> DataFrame:
    """(key, entity, term, named) for every term near an entity, a row or more for each distinct text.

    Entities, terms and the borders of sentences stand in one array by place; the terms near an entity are the NEAR on either
    side and on up to FAR within its sentence, so they are in proportion to the entities however long a sentence is. ``named``:
    whether the term begins with a capital there and not with a sentence.
    """
    tokens = placed(F.col("text"), f"{TERM}|{BORDER}", found(F.col("text"), f"{TERM}|{BORDER}"), WORD_KIND, lambda m: F.lit(True))
    some = base.where(F.size("base") > 0).select(F.xxhash64("text").alias("key"), "text", "base").dropDuplicates(["key"])
    listed = some.select("key", F.array_sort(F.concat("base", tokens)).alias("all"))
    border = lambda x: (x["kind"] == WORD_KIND) & ~F.rlike(x["value"], F.lit(r"^\p{L}"))
    kinds = F.transform("all", lambda x: F.struct(x["kind"].alias("kind"), F.when(border(x), "").otherwise(x["value"]).alias("value")))
    marked = listed.select("key", kinds.alias("all"))

    def named(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at("all", F.greatest(i, F.lit(1)))["value"]).otherwise("")
        return (before != "") & F.rlike(x["value"], F.lit(r"^[\p{Lu}\p{Lt}\p{Lo}]"))

    full = marked.select("key", F.transform("all", lambda x, i: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), named(x, i).alias("named"))).alias("all"))
    is_border = lambda some: F.transform(some, lambda x: x["value"] == "")

    def near(i: Column) -> Column:
        after = F.slice("all", i + 2, F.lit(FAR))
        before = F.reverse(F.slice("all", F.greatest(i - FAR, F.lit(0)) + 1, F.least(i, F.lit(FAR))))
        inside = lambda some: F.slice(some, F.lit(1), F.greatest(F.when(F.array_position(is_border(some), True) == 0, FAR).otherwise(F.array_position(is_border(some), True) - 1), F.lit(NEAR)).cast("int"))
        return F.filter(F.concat(inside(before), inside(after)), lambda x: (x["kind"] == WORD_KIND) & (x["value"] != ""))

    around = F.transform("all", lambda x, i: F.when(x["kind"] != WORD_KIND, F.struct(entity_of(x).alias("entity"), near(i).alias("terms"))))
    each = full.select("key", F.explode(F.filter(around, lambda x: x.isNotNull())).alias("e"))
    return each.select("key", "e.entity", F.explode_outer("e.terms").alias("t")).select("key", "entity", F.lower("t.value").alias("term"), "t.named")


def disclosures(base: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(term, entity, together, term_rows, entity_rows, disclosure) of all terms that disclose an entity enough.

    Counts are numbers of distinct texts, over the whole corpus. ``base`` comes from ``base_spans``. Evidence from fewer
    than PLAIN of an entity's m texts says little of a word that is merely rare, so there only its c uses as a name count, and
    enter PMI as (c - 1/2) c / m: a name from one text is generalised where it is rare enough, and never removed.
    """
    near = stored(contexts(base).groupBy("key", "entity", "term").agg(F.max(F.col("named").cast("int")).alias("named")))
    entities = near.select("key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("entity_rows"))
    n = F.lit(float(base.select(F.xxhash64("text").alias("key")).distinct().count()))
    together = near.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("together"), F.sum("named").alias("as_name")).where(F.col("together") >= support)
    together = together.join(entities, "entity")
    shrunk = (F.col("as_name") - 0.5) * F.col("as_name") / F.col("entity_rows")
    together = together.withColumn("evidence", F.when(F.col("together") >= PLAIN, F.col("together").cast("double")).otherwise(shrunk)).where("evidence > 0")
    together = together.withColumn("most", F.col("evidence") * F.pow(n / F.col("entity_rows"), F.lit(1.0 - least)))
    # A term in more than ``most`` texts can't reach the threshold; it is in at least as many rows as it is near any entity in.
    beside = near.where("term is not null").select("key", "term").distinct().groupBy("term").agg(F.count("*").alias("beside"))
    together = stored(together.join(beside, "term").where(F.col("beside") <= F.col("most") + 1).drop("most", "beside", "as_name"))
    candidates = together.select("term").distinct()
    small = candidates.limit(10 * LITERALS + 1).count() <= 10 * LITERALS
    every = base.select(F.xxhash64("text").alias("key"), F.explode(found(F.col("text"), TERM)).alias("word")).select("key", F.lower("word").alias("term"))
    terms = every.join(F.broadcast(candidates) if small else candidates, "term").groupBy("term").agg(F.countDistinct("key").alias("term_rows"))
    pmi = F.log(n * F.col("evidence") / (F.col("entity_rows") * F.col("term_rows")))
    out = together.join(terms, "term").withColumn("disclosure", pmi / F.nullif(F.log(n / F.col("entity_rows")), F.lit(0.0)))
    return out.where(F.col("disclosure") >= least).drop("evidence")


def label(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, *TERM_KINDS)))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def cleaned(text: Column, spans: Column) -> Column:
    """The text with base spans and generalised terms replaced by their kind, and removed terms taken out; of spans that
    overlap the first counts."""
    words = F.array(*map(F.lit, ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")))
    reached = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    before = F.concat(F.array(F.lit(0)), reached)
    pieces = F.transform(
        F.zip_with(spans, F.slice(before, F.lit(1), F.size(spans)), lambda s, at: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), at.alias("at"))),
        lambda s: F.when(s["start"] >= s["at"], F.concat(F.substring(text, s["at"] + 1, s["start"] - s["at"]), F.element_at(words, s["kind"] + 1))).otherwise(""),
    )
    return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(before, -1) + 1, F.length(text)))


def sanitise(docs: DataFrame, with_text: bool = False, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Personal data and disclosing terms of every whole text of ``docs(doc_id, text, ...)``.

    Returns doc_id, n_email, n_ip, n_card, n_phone, n_base (all four), n_terms, base_sha256, spans and, ``with_text``, clean_text. Terms are
    compared in lower case and marked wherever they stand, in any row. A null text counts as empty; texts that repeat count
    once; a term that discloses several entities takes the highest degree; other columns are
    ignored; an empty table gives no rows.
    """
    base = base_spans(docs)
    known = stored(disclosures(base, support, generalise).groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    listed = known.limit(LITERALS + 1).collect()  # bounded; beyond the bound the terms are joined
    if len(listed) <= LITERALS:
        gone = sorted(r.term for r in listed if r.disclosure >= remove)
        kept = sorted(r.term for r in listed if r.disclosure < remove)
        rows = base.withColumn("words", found(F.col("text"), TERM) if listed else F.array().cast("array<string>"))
        inside = lambda names: (lambda m: F.lower(m).isin(names) if names else F.lit(False))
        parts = [placed(F.col("text"), TERM, F.col("words"), 4 + i, inside(names)) for i, names in enumerate((kept, gone)) if names]
    else:
        keyed = base.withColumn("row", F.xxhash64("doc_id", "text"))
        every = keyed.select("row", F.explode(terms_of(F.col("text"))).alias("term"))
        hits = every.join(F.broadcast(known) if known.limit(10 * LITERALS + 1).count() <= 10 * LITERALS else known, "term").groupBy("row").agg(F.collect_set(F.when(F.col("disclosure") < remove, F.col("term"))).alias("kept"), F.collect_set(F.when(F.col("disclosure") >= remove, F.col("term"))).alias("gone"))
        rows = keyed.join(hits, "row", "left").withColumn("words", found(F.col("text"), TERM, F.col("kept").isNotNull()))
        holds = lambda c: (lambda m: F.coalesce(F.array_contains(F.col(c), F.lower(m)), F.lit(False)))
        parts = [placed(F.col("text"), TERM, F.col("words"), 4 + i, holds(c)) for i, c in enumerate(("kept", "gone"))]
    terms = F.concat(*parts) if parts else F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    rows = rows.select("doc_id", "text", "base", terms.alias("terms"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    every_span = F.array_sort(F.concat("base", "terms"))
    out = rows.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.size("base").cast("long").alias("n_base"),
        F.size("terms").cast("long").alias("n_terms"),
        F.sha2(label(F.col("base")), 256).alias("base_sha256"),
        label(every_span).alias("spans"),
        *([cleaned(F.col("text"), every_span).alias("clean_text")] if with_text else []),
    )
    return out


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(read(spark, sf_dir, "documents"))
