"""Personal data, and the terms that give it away.

Base spans come from patterns.  The words of their texts are then weighed over the corpus: the more a
term's documents are those of one protected value, the more of the value's information it
discloses.  Terms that disclose too much become spans too, to be generalised or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checked_broadcast, hub_join, marked, written
from .quality import bind

KINDS = ("email", "ip", "card", "phone", "term", "broad")
#: What a span is replaced by; a term that discloses most is removed.
REPLACEMENTS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "[TERM]")

# Each finds the leftmost non-overlapping matches of the plain pattern in linear time: it starts
# only where a run of its first class starts, or where the last match ended, and never gives back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"
#: A run of three letters and digits or more, with a letter, whatever stands around it.
TERM = r"(?<![\p{L}\p{N}])(?=\p{N}*+\p{L})[\p{L}\p{N}]{3,}+"
#: A group of values tells of somebody if it is in at most one text of so many.
GROUP_RARITY = 8
#: Spans that are gathered at a time.
BLOCK = 256
#: Copies of a text that one task joins with its spans.
MANY_COPIES = 10_000
#: Rows of numbers alone that are broadcast at most: about 32 bytes each.
BROADCAST_NUMBERS = 500_000

SPAN = "struct<start:int,end:int,kind:int,value:string>"


def luhn(digits: Column) -> Column:
    """Whether digits pass the check: from the right, every second digit doubled, its digits summed."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: bind(d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(places, F.lit(0), lambda a, v: a + v) % 10 == 0


def located(text: Column, pattern: str, kind: int, valid=None) -> Column:
    """Spans of the pattern's matches: the lengths of the matches, and of what lies between, add up to places.

    Spans are gathered BLOCK at a time, so that a text's time grows with its matches, not with their square.
    """
    empty = F.array().cast(f"array<{SPAN}>")

    def span_at(found: Column):
        def add(a: Column, i: Column) -> Column:
            start = a["at"] + F.length(F.get(found["gaps"], i))
            value = F.get(found["hits"], i)
            end = start + F.length(value)
            span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), value.alias("value")))
            kept = F.concat(a["spans"], span) if valid is None else F.when(valid(value), F.concat(a["spans"], span)).otherwise(a["spans"])
            return F.struct(end.alias("at"), kept.alias("spans"))

        return add

    def all_spans(found: Column) -> Column:
        last = F.size(found["hits"]) - 1

        def block(a: Column, b: Column) -> Column:
            places = F.sequence(b * BLOCK, F.least(b * BLOCK + (BLOCK - 1), last))
            some = F.aggregate(places, F.struct(a["at"].alias("at"), empty.alias("spans")), span_at(found))
            return bind(some, lambda x: F.struct(x["at"].alias("at"), F.concat(a["blocks"], F.array(x["spans"])).alias("blocks")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("blocks"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), start, block, lambda a: F.flatten(a["blocks"]))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return bind(both, lambda found: F.when(F.size(found["hits"]) > 0, all_spans(found)).otherwise(empty))


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    guarded = [
        (text.contains("@"), located(text, EMAIL, 0)),
        (text.rlike(r"[0-9]\.[0-9]"), located(text, IP, 1, lambda v: v.rlike(f"^{OCTETS}$"))),
        (text.rlike(r"[0-9][\x20-]?[0-9]"), located(text, CARD, 2, lambda v: luhn(digits(v)))),
        (text.contains("+"), located(text, PHONE, 3, lambda v: F.length(digits(v)).between(10, 15))),
    ]
    return F.array_sort(F.transform(F.flatten(F.array(*[F.when(may, spans).otherwise(none) for may, spans in guarded])), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))


def masked(text: Column, spans: Column) -> Column:
    """text with blanks in place of its spans, which come by start."""

    def add(a: Column, s: Column) -> Column:
        pieces = F.concat(a["pieces"], F.array(F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.repeat(F.lit(" "), s["end"] - F.greatest(s["start"], a["at"]))))
        return F.when(s["end"] > a["at"], F.struct(s["end"].alias("at"), pieces.alias("pieces"))).otherwise(a)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))
    return F.aggregate(spans, start, add, lambda a: F.concat(F.array_join(a["pieces"], ""), F.substr(text, a["at"] + 1, F.length(text))))


def term_key(term: Column) -> Column:
    return F.xxhash64(F.lower(term))


def terms_of(text: Column) -> Column:
    """Keys of the distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), term_key))


def entities_of(spans: Column) -> Column:
    """(entity, grouped, names): each protected value, and the groups it belongs to.

    Groups are an e-mail's domain and owner, an address's network, a card's issuer and a phone's
    number without its last four digits.  names are the keys of the words of an e-mail's owner.
    """
    none = F.array().cast("array<bigint>")

    def each(s: Column) -> Column:
        lowered, digits = F.lower(s["value"]), F.regexp_replace(s["value"], "[^0-9.]", "")
        words = F.when(s["kind"] == 0, F.array_sort(F.array_distinct(F.regexp_extract_all(F.substring_index(lowered, "@", 1), F.lit("[a-z]{3,}"), F.lit(0))))).otherwise(F.array().cast("array<string>"))
        group = F.when(s["kind"] == 0, F.substring_index(lowered, "@", -1)).when(s["kind"] == 1, F.substring_index(digits, ".", 3)).when(s["kind"] == 2, F.substring(digits, 1, 6)).otherwise(F.regexp_replace(digits, ".{4}$", ""))
        entity = lambda h, grouped, names: F.struct(h.alias("entity"), F.lit(grouped).alias("grouped"), names.alias("names"))
        value = entity(F.xxhash64(s["kind"], F.when(s["kind"] >= 1, digits).otherwise(lowered)), False, F.transform(words, term_key))
        owner = entity(F.xxhash64(F.lit("owner"), F.array_join(words, " ")), True, none)
        both = F.array(value, entity(F.xxhash64(F.lit("group"), s["kind"], group), True, none))
        return F.when(F.size(words) > 0, F.concat(both, F.array(owner))).otherwise(both)

    return F.array_distinct(F.flatten(F.transform(spans, each)))


def same_texts() -> Column:
    """A hash, in an aggregate, of the set of texts that its rows are in, each once."""
    return F.xxhash64(F.bit_xor(F.xxhash64("text_key")), F.bit_xor(F.xxhash64("text_key", F.lit(1))), F.count("*"))


def spread_join(found: DataFrame, sizes: DataFrame, added: DataFrame) -> DataFrame:
    """found left joined with added by text_key, whose copies, as sizes counts them, are dealt to several tasks where they are many."""
    total = sizes.agg(F.coalesce(F.sum("copies"), F.lit(0))).collect()[0][0]
    share = max(MANY_COPIES, total // BROADCAST_ROWS + 1)
    many = sizes.filter(F.col("copies") > share).join(added.select("text_key"), "text_key", "left_semi")
    many = F.broadcast(many.select("text_key", F.ceil(F.col("copies") / share).alias("parts")))  # BROADCAST_ROWS at most
    dealt = found.join(many, "text_key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), "parts"), F.lit(0)))
    parts = added.join(many, "text_key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1)))
    return dealt.drop("parts").join(parts.drop("parts"), ["text_key", "part"], "left").drop("part")


def find_private(
    docs: DataFrame, min_support: int = 2, group_support: int = 3, broad_at: float = 0.7, remove_at: float = 0.9, group_rarity: float | None = GROUP_RARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_key, base, added): arrays of spans (start, kind, end, value) for each row of docs.

    A term discloses PMI(term; value) / IC(value) of a protected value, or of a group of values,
    from counts of distinct texts; from broad_at on it is to be generalised, from remove_at on
    removed, wherever it stands in the texts that hold the value or one of the group.  Both are in
    min_support distinct texts or more, group_support for a group; a word of an e-mail's owner needs
    one only.  Groups in more than one of group_rarity texts tell of nobody; None judges them all.

    Null and empty texts have no spans; copies of a text count once for the statistics and get the
    same spans; rows that repeat a doc_id keep their own spans; other columns are left out; an empty
    table gives no rows.  Values, terms, texts and sets of texts are told apart by 64-bit hashes.

    Values that are in the same texts are one class, and so are such terms: a pair of classes counts
    once, so a list of many addresses and many words is one pair, not each with each.  Terms too
    frequent to disclose enough of a class, even if they came with it always, aren't paired.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = rows.withColumn("base", base_spans(F.col("text")))
    held = F.when(F.size("base") > 0, masked(F.col("text"), F.col("base")))
    found = written(spans.select("doc_id", F.xxhash64("text").alias("text_key"), "base", held.alias("held")), "private")
    sizes = written(found.groupBy("text_key").agg(F.count("*").alias("copies")), "private-sizes")
    n = sizes.count()
    disclosed = lambda n_term: F.log2(F.col("n_both") * float(n) / (n_term * F.col("n_entity"))) / F.log2(float(n) / F.col("n_entity"))

    texts = found.filter("held is not null").dropDuplicates(["text_key"])
    texts = written(texts.select("text_key", "held", entities_of(F.col("base")).alias("entities"), terms_of(F.col("held")).alias("terms")), "private-texts")
    of_texts = texts.select("text_key", "terms", F.explode("entities").alias("e")).select("text_key", "e.entity", "e.grouped", F.array_intersect("e.names", "terms").alias("own"))
    counts = of_texts.groupBy("entity", "grouped").agg(F.count("*").alias("n_entity"), same_texts().alias("texts_of"))
    support = F.when(F.col("grouped"), group_support).otherwise(min_support)
    rare = F.lit(True) if group_rarity is None else ~F.col("grouped") | (F.col("n_entity") * group_rarity <= n)
    per_entity = counts.filter(rare & (F.col("n_entity") < n)).select("entity", "n_entity", (F.col("n_entity") >= support).alias("enough"), support.alias("support"), F.xxhash64("texts_of", support).alias("e_class"))
    per_entity = written(per_entity, "private-entities")
    judged = hub_join(of_texts.select("text_key", "entity", "own"), per_entity, "entity", "n_entity").filter(F.col("enough") | (F.size("own") > 0))
    judged = written(judged, "private-judged")

    # a term is in as many texts, at least, as it is in texts with protected values: most terms tell too little even so
    per_near = texts.select("text_key", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_near"), same_texts().alias("t_class"))
    per_near = written(per_near, "private-near")
    most = lambda m: F.greatest(m.cast("double"), F.pow(m / float(n or 1), F.lit(broad_at)) * float(n) * (1 + 1e-6))
    widest = per_entity.filter("enough").agg(F.max(most(F.col("n_entity")))).collect()[0][0]
    useful = per_near.filter((F.col("n_near") >= min(min_support, group_support)) & (F.col("n_near") <= F.lit(widest or 0.0)))
    in_near = hub_join(texts.select("text_key", F.explode("terms").alias("term")), useful, "term", "n_near")
    their_terms = in_near.groupBy("text_key").agg(F.collect_set(F.struct("t_class", "n_near")).alias("ts"))
    their_values = judged.filter("enough").groupBy("text_key").agg(F.collect_set(F.struct("e_class", "n_entity", "support")).alias("es"))
    classes = written(their_values.join(their_terms, "text_key"), "private-classes")

    def paired(only: DataFrame | None = None) -> DataFrame:
        """(text_key, classes of a value and a term, their counts) of each text, of some classes of values only if so asked."""
        values = classes.select("text_key", "ts", F.explode("es").alias("e")).select("text_key", "ts", "e.*")
        values = values if only is None else values.join(checked_broadcast(only, BROADCAST_NUMBERS), "e_class", "left_semi")
        near = values.withColumn("t", F.explode(F.filter("ts", lambda t: t["n_near"] <= most(F.col("n_entity")))))
        return near.select("text_key", "e_class", "n_entity", "support", "t.*")

    pairs = paired().groupBy("e_class", "t_class").agg(F.count("*").alias("n_both"), *[F.first(c).alias(c) for c in ("n_entity", "support", "n_near")])
    pairs = written(pairs.filter((F.col("n_both") >= F.col("support")) & (disclosed(F.col("n_near")) >= broad_at)), "private-pairs")
    # words of an owner, whatever their support: at most a value's own words each
    owned = judged.select("text_key", "entity", "n_entity", F.explode("own").alias("term"))
    own = owned.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"))
    own = written(hub_join(own, per_near.select("term", "n_near"), "term", "n_near").filter(disclosed(F.col("n_near")) >= broad_at), "private-own")

    chosen = written(pairs.select("t_class").distinct(), "private-chosen")
    of_classes = written(per_near.join(checked_broadcast(chosen, BROADCAST_NUMBERS), "t_class", "left_semi"), "private-class-terms")
    terms = written(of_classes.select("term").union(own.select("term")).distinct(), "private-terms")
    in_texts = rows.select(F.xxhash64("text").alias("text_key"), F.explode(terms_of(F.col("text"))).alias("term"))
    few = terms.limit(BROADCAST_NUMBERS + 1).count() <= BROADCAST_NUMBERS
    in_texts = in_texts.join(F.broadcast(terms), "term") if few else marked(in_texts, terms, "term")
    per_term = written(in_texts.distinct().groupBy("term").agg(F.count("*").alias("n_term")), "private-counts")

    def counted(of: DataFrame) -> DataFrame:
        return of.join(checked_broadcast(per_term, BROADCAST_NUMBERS), "term", "left").withColumn("n_term", F.greatest(F.coalesce("n_term", F.lit(0)), "n_near"))

    kind = F.when(F.col("share") >= remove_at, 4).otherwise(5).alias("kind")
    of_classes = written(counted(of_classes).select("term", "t_class", "n_term"), "private-counted")
    telling = pairs.join(of_classes.select("t_class", "n_term").distinct(), "t_class").withColumn("share", disclosed(F.col("n_term"))).filter(F.col("share") >= broad_at)
    telling = written(telling.select("e_class", "t_class", "n_term", kind), "private-telling")
    values = written(telling.select("e_class").distinct(), "private-telling-values")
    told = paired(values).select("text_key", "e_class", "t_class").join(checked_broadcast(telling, BROADCAST_NUMBERS), ["e_class", "t_class"])
    told = told.groupBy("text_key", "t_class", "n_term").agg(F.min("kind").alias("kind"))
    told = told.join(checked_broadcast(of_classes, BROADCAST_NUMBERS), ["t_class", "n_term"]).select("text_key", "term", "kind")
    own = written(counted(own).withColumn("share", disclosed(F.col("n_term"))).filter(F.col("share") >= broad_at).select("entity", "term", kind), "private-owned")
    told_own = owned.select("text_key", "entity", "term").join(checked_broadcast(own, BROADCAST_NUMBERS), ["entity", "term"]).select("text_key", "term", "kind")

    told = told.unionByName(told_own).groupBy("text_key", "term").agg(F.min("kind").alias("kind"))
    told = told.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("told"))
    places = located(F.col("held"), TERM, 4, lambda v: F.map_contains_key("told", term_key(v)))
    added = F.transform(places, lambda s: F.struct(s["start"].alias("start"), F.try_element_at(F.col("told"), term_key(s["value"])).alias("kind"), s["end"].alias("end"), F.lower(s["value"]).alias("value")))
    added = written(texts.select("text_key", "held").join(told, "text_key").select("text_key", added.alias("added")), "private-added")
    none = F.array().cast(added.schema["added"].dataType)
    joined = spread_join(found.filter(F.size("base") > 0).select("doc_id", "text_key", "base"), sizes, added)
    bare = found.filter(F.size("base") == 0).select("doc_id", "text_key", "base", none.alias("added"))
    return joined.select("doc_id", "text_key", "base", F.coalesce("added", none).alias("added")).unionByName(bare)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def private_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of docs; the cases are find_private's."""
    found = find_private(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with each span of text_col replaced: base kinds by their name, telling terms generalised or removed.

    Of overlapping spans the first in (start, kind) order counts.
    """
    found = find_private(docs, id_col=id_col, text_col=text_col, **options).dropDuplicates(["doc_id", "text_key"])
    spans = found.select(F.col("doc_id").alias("_private_id"), F.col("text_key").alias("_private_key"), F.array_sort(F.concat("base", "added")).alias("_private"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.withColumn("_key", F.xxhash64(text)).join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("_private_id")) & (F.col("_key") == F.col("_private_key")), "left")
    names = F.array(*map(F.lit, REPLACEMENTS))

    def add(a: Column, s: Column) -> Column:
        pieces = F.concat(a["pieces"], F.array(F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"])))
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), pieces.alias("pieces"))).otherwise(a)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))
    clean = F.aggregate("_private", start, add, lambda a: F.concat(F.array_join(a["pieces"], ""), F.substr(text, a["at"] + 1, F.length(text))))
    return joined.withColumn(text_col, F.when(F.size("_private") > 0, clean).otherwise(F.col(text_col))).select(*docs.columns)
