"""Personal data: fixed rules, and terms that disclose them, with DataFrame functions only.

Information-theoretic sanitisation: over the whole corpus, how many documents hold both a term and a protected value,
against how many hold either, gives their pointwise mutual information. A term that carries at least DISCLOSURE of the
information content of a value reveals it; its occurrences in all texts are spans of their own, and sanitise()
generalises them (if more than SUPPORT documents have them) or removes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, small, stage

KINDS = ("email", "ip", "card", "phone", "term")
#: Share of a value's information content, documents that must show term and value together.
DISCLOSURE, SUPPORT = 0.8, 3

# The patterns of the contract, written so that Java's matcher takes time in proportion to the text: possessive
# where giving back could not help, and started only where a run begins (or the last match ended).
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MAYBE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_TERM = r"\p{L}[\p{L}\p{N}]{2,}"
#: Marks matches; a noncharacter, which is replaced by another one where a text holds it.
_MARK, _OTHER = "\ufdd0", "\ufdd1"
_SPAN = "struct<kind:int,start:int,end:int,value:string>"
#: Parts of a text whose matches are gathered together (an even number): each step copies what is gathered so far.
_CHUNK = 64


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (value, start, end), in code points from 0, end exclusive."""
    parts = F.split(F.regexp_replace(F.translate(text, _MARK, _OTHER), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    let = lambda x, f: F.transform(F.array(x), f)[0]
    none = F.array().cast("array<struct<value:string,start:int,end:int>>")

    def places(chunk: Column, at: Column) -> Column:
        """Every second part of a chunk is a match."""

        def step(acc: Column, part: Column) -> Column:
            end = acc["at"] + F.length(part)
            one = F.struct(part.alias("value"), acc["at"].alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["got"], F.array(one))).otherwise(acc["got"]).alias("got"))

        return F.aggregate(chunk, F.struct(at.alias("at"), F.lit(False).alias("inside"), none.alias("got")), step, lambda acc: acc["got"])

    def of_chunks(chunks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        step = lambda acc, c: F.struct((acc["at"] + F.length(F.array_join(c, ""))).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
        return F.flatten(F.zip_with(chunks, F.aggregate(chunks, first, step, lambda acc: acc["starts"]), places))

    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _CHUNK).cast("int")), lambda j: F.slice(p, j * _CHUNK + 1, _CHUNK))
    return let(let(parts, cut), of_chunks)


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, F.lit("[^0-9]"), F.lit(""))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _kind_spans(n: int, kind: str) -> Column:
    none = F.array().cast(f"array<{_SPAN}>")
    text = F.col("text")
    kept = F.filter(matches(text, _PATTERNS[kind]), lambda m: _holds(kind, m["value"]))

    one = lambda m: F.struct(F.lit(n).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))
    return F.when(text.contains("@") if kind == "email" else text.rlike(_MAYBE[kind]), F.transform(kept, one)).otherwise(none)


def terms_of(text: Column) -> Column:
    """Each term of a text once, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), lambda v: F.lower(v)))


def _outside(text: Column, spans: Column) -> Column:
    """The text with a space for every stretch that spans cover."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    places = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    between = lambda acc, s: F.when(s["start"] > acc["at"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise("")
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], between(acc, s), F.lit(" ")).alias("out"))
    return F.aggregate(places, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, the spans of the fixed rules by kind, then start, and the terms outside of them (words; of
    documents with spans only); staged, a row for each row."""
    rows = _texts(docs).withColumn("spans", F.concat(*(_kind_spans(n, k) for n, k in enumerate(KINDS[:4]))))
    words = F.when(F.size("spans") > 0, terms_of(_outside(F.col("text"), F.col("spans")))).otherwise(F.array().cast("array<string>"))
    return stage(rows.select("doc_id", "text_hash", "spans", words.alias("words")), "pii_spans")


def _term_pairs(docs: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(values, pairs, total). values, staged: kind, value, holders and the class s1, s2 of values that the very same documents hold.
    pairs: class, holders, term, documents, a row for each document with both that might disclose.

    A document's words are exploded once, and meet its classes of values, not its values: a list of addresses that several documents
    repeat is one class.
    """
    repeated = stage(base.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).filter("rows > 1"), "pii_repeated")
    total = base.count() - (repeated.agg(F.sum(F.col("rows") - 1)).first()[0] or 0)
    own = F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    having = base.filter(F.size("spans") > 0)
    held = having.select("doc_id", "text_hash", F.explode(own).alias("v")).select("doc_id", "text_hash", "v.*").distinct()
    mark = lambda n: F.bit_xor(F.xxhash64(F.lit(n), "doc_id", "text_hash")).alias(f"s{n}")
    # Values in fewer documents than SUPPORT, or in all, have no disclosing terms.
    values = held.groupBy("kind", "value").agg(F.count("*").alias("holders"), mark(1), mark(2))
    values = stage(values.filter((F.col("holders") >= SUPPORT) & (F.col("holders") < total)), "pii_values")
    most = values.agg(F.max("holders")).first()[0] or 0
    # As term and value are together in `holders` documents at most, a term of many more documents can't reach the threshold.
    content = lambda holders: F.log2(F.lit(float(max(total, 2))) / holders)
    could = lambda holders: F.log2("documents") <= F.log2(holders) + (1 - DISCLOSURE) * content(holders) + 1e-6
    texts = _texts(docs)
    seen = texts.select(F.explode(terms_of(F.col("text"))).alias("term"), F.lit(1).cast("long").alias("rows"))
    if not repeated.isEmpty():  # of a document's rows all but one are taken off again
        again = small(repeated.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), (1 - F.col("rows")).alias("rows")))
        again = texts.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).dropDuplicates(["doc_id", "text_hash"])
        seen = seen.unionByName(again.select(F.explode(terms_of(F.col("text"))).alias("term"), "rows"))
    seen = seen.groupBy("term").agg(F.sum("rows").alias("documents")).filter((F.col("documents") >= SUPPORT) & could(F.lit(float(max(most, 1)))))
    classes = held.join(small(values), ["kind", "value"]).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "s1", "s2", "holders").distinct()
    largest = classes.groupBy(F.col("d").alias("doc_id"), F.col("h").alias("text_hash")).agg(F.max("holders").alias("largest"))
    largest = small(stage(largest, "pii_largest")).withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    words = having.dropDuplicates(["doc_id", "text_hash"]).join(largest, same).select("doc_id", "text_hash", "largest", F.explode("words").alias("term"))
    words = words.join(seen, "term").filter(could(F.col("largest")))
    pairs = words.join(classes, same).filter(could(F.col("holders"))).select("s1", "s2", "holders", "term", "documents")
    return values, pairs, total


def _disclosing(pairs: DataFrame, total: int) -> DataFrame:
    """s1, s2, term, together, documents, information: terms beyond the disclosure threshold, by class of values."""
    known = pairs.groupBy("s1", "s2", "holders", "term", "documents").agg(F.count("*").alias("together")).filter(F.col("together") >= SUPPORT)
    content = F.log2(F.lit(float(max(total, 2))) / F.col("holders"))
    shared = F.log2(F.lit(float(total)) * F.col("together") / (F.col("documents") * F.col("holders")))
    return known.withColumn("information", shared).filter((content > 0) & (shared >= DISCLOSURE * content)).select("s1", "s2", "term", "together", "documents", "information")


def disclosing_terms(docs: DataFrame, base: DataFrame) -> DataFrame:
    """kind, value, term, together, documents (with the term), information: terms beyond the disclosure threshold.

    Term and value stand together in a document that holds both, however far apart. Rows that repeat a document (doc_id and
    text) count once throughout.
    """
    values, pairs, total = _term_pairs(docs, base)
    return _disclosing(pairs, total).join(values, ["s1", "s2"]).select("kind", "value", "term", "together", "documents", "information")


def _marked(docs: DataFrame, told: DataFrame) -> DataFrame:
    """Every occurrence of the terms `told` (term, documents) in all texts: doc_id, text_hash, terms (array of start, end, term, documents)."""
    texts, told = _texts(docs), small(told)
    # Places are told for texts that hold such a term only.
    holding = texts.select("doc_id", "text_hash", F.explode(terms_of(F.col("text"))).alias("term")).join(told, "term").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    holding = small(stage(holding, "pii_holding"))
    some = texts.join(holding, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi")
    every = some.select("doc_id", "text_hash", F.explode(matches(F.col("text"), _TERM)).alias("m"))
    every = every.select("doc_id", "text_hash", F.lower("m.value").alias("term"), "m.start", "m.end").join(told, "term")
    return every.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end", "term", "documents"))).alias("terms"))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (spans of the fixed rules) and terms (disclosing spans), a row for each row of `docs`.

    base: array of kind, start, end and value, by kind as listed, then start. terms: array of start, end, term,
    documents, by start: each occurrence of a disclosing term that overlaps no span of base, in every text. A null text is empty. Repeated rows get the same spans, and count once in the statistics. Other columns play no part; an empty table gives an empty result.
    """
    base = base_spans(docs)
    _, pairs, total = _term_pairs(docs, base)
    told = stage(_disclosing(pairs, total).select("term", "documents").distinct(), "pii_told")
    spans = _marked(docs, told)
    spans = spans.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    both = base.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    none = F.array().cast("array<struct<start:int,end:int,term:string,documents:bigint>>")
    clear = F.filter(F.coalesce("terms", none), lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return both.select("doc_id", "text_hash", F.col("spans").alias("base"), clear.alias("terms"))


def span_text(spans: Column, kind: int | None = None) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    name = lambda s: F.lit(KINDS[kind]) if kind is not None else F.element_at(names, s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """`docs` with values replaced by [KIND] and disclosing terms generalised to [TERM], or removed if nothing else in the
    corpus has them. Spans of one kind that overlap an earlier one of another are passed over. Columns stay as they are."""
    found = (find_pii(docs) if found is None else found).dropDuplicates(["doc_id", "text_hash"])
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    one = lambda start, end, put: F.struct(start.alias("start"), end.alias("end"), put.alias("put"))
    edits = F.array_sort(F.concat(F.transform("base", lambda s: one(s["start"], s["end"], F.element_at(names, s["kind"] + 1))), F.transform("terms", lambda t: one(t["start"], t["end"], F.when(t["documents"] > SUPPORT, F.lit("[TERM]")).otherwise(F.lit(""))))))
    d, h, own = fresh(docs, "_d", "_h", "_edits")
    marked = found.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), edits.alias(own)).filter(F.size(own) > 0)
    text = F.coalesce("text", F.lit(""))
    both = docs.join(marked, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(h)), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, e: F.when(e["start"] >= acc["at"], F.struct(e["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["put"]).alias("out"))).otherwise(acc)
    clean = F.aggregate(own, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return both.select([F.when(F.col(own).isNull(), col(c)).otherwise(clean).alias(c) if c == "text" else col(c) for c in docs.columns])
