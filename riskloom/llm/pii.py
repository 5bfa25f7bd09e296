"""Surrogates for personal data, in Spark expressions only.

Every entity has a normal form (an address in lower case, a number's digits, one word of a name),
and its surrogate is a keyed digest of kind and normal form, written in the entity's own format:
digits for digits, letters of the same script and case for letters, a woman's name for a
woman's name. Equal entities therefore get equal surrogates anywhere in the corpus. Surrogates
that two entities share, or that are themselves an entity of the corpus, are drawn again; later
draws are longer, so that there are enough of them for any number of entities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.plans.rows import BROADCAST_ROWS
from riskloom.session import settle

# Draws in the format of the entity; each one after them is longer by one digit or octet. Names take a syllable more with every draw.
FREE_DRAWS = 4
DEFAULT_KEY = "surrogates-1"

FEMALE = "Mrs|MRS|Ms|MS|Miss|Madam|Madame|Mademoiselle|Mme|Mlle|Frau|Señora|Señorita|Sra|Signora|г-жа|госпожа|κυρία"
MALE = "Mr|MR|Sir|Monsieur|Herr|Señor|Sr|Signor|г-н|господин|κύριος"
_NAME_WORD = r"\p{Lu}[\p{L}'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: kind -> pattern; the first kind that fits a match counts.
PATTERNS = {
    "email": r"(?<![\w.+%-])[\w.+%-]+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}(?![\p{L}\p{N}])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "phone": r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "secret": r"(?<=[=: \"'])(?=[A-Za-z0-9_/+.-]{8})(?=[_/+.-]*[A-Za-z0-9])(?<=(?i:password|passwd|pwd|token|secret|api_key|apikey) {0,3}[=:] {0,3}[\"']?)[A-Za-z0-9_/+.-]{8,}",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{FEMALE}|{MALE})\.? {_NAME_WORD}(?: {_NAME_WORD}){{0,2}}",
}
# One pass over a text; the card pattern's group number holds as it is the only group.
# Every kind starts where no word character precedes.
_ANY = r"(?<!\w)(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
# A text in which neither is found has no entity. Both start with one class of characters, which is what makes them cheap.
_SIGNS = r"[@=:0-9]"
_TITLES = f"{FEMALE}|{MALE}".split("|")
_TITLE = rf"[{''.join(sorted({t[0] for t in _TITLES}))}](?:{'|'.join(sorted({t[1:] for t in _TITLES}))})\.? \p{{Lu}}"
# Syllables of made-up names, by script. An ending tells the gender of a given name.
_SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge gi go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе би бо да де ди до га ге ги го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе пи по ра ре ри ро са се си со та те ти то ва ве ви во".split(),
    "greek": "βα βε βι βο δα δε δι δο γα γε γι γο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι πο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}
_ENDINGS = {
    ("latin", "f"): "na", ("latin", "m"): "n", ("latin", "s"): "r", ("cyrillic", "f"): "на", ("cyrillic", "m"): "н", ("cyrillic", "s"): "р",
    ("greek", "f"): "να", ("greek", "m"): "νος", ("greek", "s"): "ρου",
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(key: str, kind: Column, value: Column, draw: Column) -> Column:
    """128 hex digits keyed as in HMAC: key, then the digest of key and message."""
    message = F.concat_ws("\u0001", kind, value, draw.cast("string"))
    one = lambda n: F.sha2(F.concat(F.lit(f"{key}\u0002{n}\u0002"), F.sha2(F.concat(F.lit(f"{key}\u0003"), message), 256)), 256)
    return F.concat(one(0), one(1))


def _number(digest: Column, i: Column, base: int | Column) -> Column:
    """A number below base from four hex digits of the digest."""
    at = F.pmod(i, F.lit(31)) * 4 + 1
    return F.conv(F.substring(digest, at, F.lit(4)), 16, 10).cast("int") % base


def _written(digest: Column, value: Column, digits: str = "0123456789", lower: str = "abcdefghijklmnopqrstuvwxyz", upper: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
    """The value with every digit and letter replaced by one of its kind; other characters stay."""
    def char(c: Column, i: Column) -> Column:
        pick = lambda pool: F.substring(F.lit(pool), _number(digest, i, len(pool)) + 1, F.lit(1))
        return (F.when(c.rlike(r"^\d$"), pick(digits)).when(c.rlike("^[a-z]$"), pick(lower)).when(c.rlike("^[A-Z]$"), pick(upper))
                .when(c.rlike(r"^\p{IsCyrillic}$"), pick("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"^\p{IsGreek}$"), pick("αβγδεζηθικλμνξοπρστυφχψω"))
                .when(c.rlike(r"^\p{Ll}$"), pick(lower)).when(c.rlike(r"^\p{Lu}$"), pick(upper)).otherwise(c))

    return F.array_join(F.transform(F.split(value, ""), char), "")


def _luhn(digits: Column) -> Column:
    """The digit that makes ``digits`` and it a valid card number."""
    doubled = lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), doubled), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def _luhn_holds(digits: Column) -> Column:
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.substring(digits, F.length(digits), F.lit(1)) == _luhn(body)


def _name(digest: Column, kind: Column, value: Column, draw: Column) -> Column:
    """A made-up name of three syllables, one more for each draw, and the ending of its kind, in the value's script."""
    def by_script(of: Callable[[str], Column]) -> Column:
        return (F.when(value.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(value.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin")))

    pool = by_script(lambda script: F.array(*map(F.lit, _SYLLABLES[script])))
    places = F.sequence(F.lit(0), F.least(draw.cast("int"), F.lit(28)) + 2)
    body = F.array_join(F.transform(places, lambda i: F.element_at(pool, _number(digest, i, F.size(pool)) + 1)), "")
    ending = by_script(lambda script: F.when(kind == "given_f", _ENDINGS[script, "f"]).when(kind == "given_m", _ENDINGS[script, "m"]).otherwise(_ENDINGS[script, "s"]))
    return F.concat(body, ending)


def surrogate(key: str, kind: Column, value: Column, draw: Column) -> Column:
    """Normal form of the surrogate of an entity's normal form."""
    return _let(_digest(key, kind, value, draw), lambda digest: _drawn(key, kind, value, draw, digest))


def _drawn(key: str, kind: Column, value: Column, draw: Column, digest: Column) -> Column:
    extra = F.greatest(draw.cast("int") - (FREE_DRAWS - 1), F.lit(0))
    # Digits of a digest of their own, as those of a long value use up all of the first.
    own = F.sha2(F.concat(F.lit(f"{key}\u0004"), F.substring(digest, 1, 128)), 512)
    more = F.when(extra > 0, F.substring(F.translate(own, "abcdef", "024135"), F.lit(1), extra)).otherwise("")
    local = F.substring_index(value, "@", 1)
    # The host's surrogate depends on the host alone, so colleagues stay colleagues; it lies in a name space set apart for examples.
    host = F.substring_index(value, "@", -1)
    label = _let(_digest(key, F.lit("host"), host, F.lit(0)), lambda d: _written(d, F.lpad(F.regexp_replace(F.substring_index(host, ".", 1), r"[^a-z0-9]", "a"), 8, "a")))
    last = F.length(value) - 1
    middle = _written(digest, F.substring(value, F.lit(2), last - 1))
    return (
        F.when(kind == "email", F.concat(_written(digest, local), more, F.lit("@"), label, F.lit(".example.com")))
        .when(kind == "card", _let(F.concat(F.substring(value, 1, 1), middle, more), lambda x: F.concat(x, _luhn(x))))
        .when(kind == "ssn", F.concat(F.lit("9"), _written(digest, F.substring(value, F.lit(2), F.length(value))), more))
        .when(kind == "ip", F.array_join(F.transform(F.sequence(F.lit(0), extra + 3), lambda i: (_number(digest, i, 254) + 1).cast("string")), "."))
        .when(kind == "phone", F.concat(F.substring(value, 1, 1), _written(digest, F.substring(value, F.lit(2), F.length(value)), digits="23456789"), more))
        .when(kind == "key", F.concat(F.substring(value, 1, 4), _written(digest, F.substring(value, F.lit(5), F.length(value))), more))
        .when(kind == "iban", F.concat(F.substring(value, 1, 2), _written(digest, F.substring(value, F.lit(3), F.length(value))), more))
        .when((kind == "secret") & value.rlike("^[0-9a-f]+$"), F.concat(_written(digest, value, lower="abcdef"), more))
        .when(kind == "secret", F.concat(_written(digest, value), more))
        .otherwise(_name(digest, kind, value, draw)))


def _kind(match: Column) -> Column:
    """Kind of a match; ``plain`` if it only looks like one."""
    out = None
    for kind, pattern in PATTERNS.items():
        if kind != "secret":  # looks behind the match, and is what remains
            whole = match.rlike(f"^(?:{pattern})$")
            if kind == "card":  # sixteen digits without a right check digit are some other number
                whole = whole & _luhn_holds(F.regexp_replace(match, r"\D", ""))
            out = F.when(whole, kind) if out is None else out.when(whole, kind)
    return out.when(match.rlike(f"^(?:{PATTERNS['card']})$"), "plain").otherwise("secret")


def _units(match: Column) -> Column:
    """The entities in a match, array<struct<kind, value>>: each word of a name, else the one."""
    return _let(_kind(match), lambda kind: _units_of(match, kind))


def _units_of(match: Column, kind: Column) -> Column:
    names = F.slice(F.split(match, " "), 2, 9)
    given = F.when(match.rlike(rf"^(?:{FEMALE})\.? "), F.lit("given_f")).otherwise(F.lit("given_m"))
    of_name = F.transform(names, lambda w, i: F.struct(
        F.when(i == F.size(names) - 1, F.lit("surname")).otherwise(given).alias("kind"), F.lower(w).alias("value")))
    normal = (
        F.when(kind.isin("card", "phone"), F.regexp_replace(match, r"\D", "")).when(kind == "email", F.lower(match))
        .when(kind == "iban", F.regexp_replace(match, " ", "")).otherwise(match))
    none = F.array().cast("array<struct<kind: string, value: string>>")
    return F.when(kind == "plain", none).when(kind == "name", of_name).otherwise(F.array(F.struct(kind.alias("kind"), normal.alias("value"))))


def _rendered(match: Column, units: Column, made: Column) -> Column:
    """The surrogates in the form of the match: its separators, or its title and the case of its words."""
    def in_format(normal: Column, slot: str) -> Column:
        """Every character of the match that is a slot takes the next of the normal form; what is left of that follows."""
        slots = F.length(F.regexp_replace(match, slot.replace("[", "[^"), ""))
        return F.concat(F.array_join(F.transform(F.split(match, ""), lambda c, i: F.when(
            c.rlike(slot), F.substring(normal, F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), slot.replace("[", "[^"), "")), F.lit(1))).otherwise(c)), ""), F.substring(normal, slots + 1, F.length(normal)))

    kind, first = F.get(units, F.lit(0))["kind"], F.get(made, F.lit(0))
    words = F.slice(F.split(match, " "), 2, 9)
    cased = F.zip_with(made, words, lambda s, w: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(s)).otherwise(
        F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))))
    return (
        F.when(kind.isin("given_f", "given_m", "surname"), F.concat_ws(" ", F.substring_index(match, " ", 1), F.array_join(cased, " ")))
        .when(kind.isin("card", "phone"), in_format(first, "[0-9]")).when(kind == "iban", in_format(first, "[A-Z0-9]"))
        .when((kind == "email") & (match == F.upper(match)), F.upper(first)).when(kind.isNull(), match).otherwise(first))


def _found(text: Column) -> Column:
    """Matches in text order; none for null and for texts that the gate shows to have none."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(_SIGNS) | text.rlike(_TITLE), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(none)


def redrawn(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, draw) of the distinct entities whose first surrogate clashes, with the draw that does not.

    Of entities with one surrogate the smallest keeps it; one that equals an entity of its kind is
    kept by none. Names of all kinds share one space, as a surname can be another's given name. Draws
    grow longer, so the rounds end whatever the number of entities.
    """
    space = F.when(F.col("kind").isin("given_f", "given_m", "surname"), "name").otherwise(F.col("kind"))
    base = settle(entities.withColumn("space", space), "entities")
    real = base.select("space", F.col("value").alias("made")).distinct().withColumn("real", F.lit(True))
    drawn = base.select("*", F.lit(0).alias("draw"), surrogate(key, F.col("kind"), F.col("value"), F.lit(0)).alias("made"))
    while True:
        drawn = settle(drawn, "drawn")
        owners = drawn.groupBy("space", "made").agg(F.count("*").alias("n"), F.min(F.struct("draw", "kind", "value")).alias("first"))
        owners = owners.join(real, ["space", "made"], "left").filter("n > 1 OR real")
        clashes = owners.select("space", "made", "first", F.coalesce("real", F.lit(False)).alias("real"))
        if clashes.isEmpty():
            return drawn.filter("draw > 0").select("kind", "value", "draw")
        mine = F.struct("draw", "kind", "value")
        loses = F.col("first").isNotNull() & (F.col("real") | (F.col("first") != mine))
        drawn = drawn.join(clashes, ["space", "made"], "left").withColumn("draw", F.col("draw") + F.when(loses, 1).otherwise(0)).drop("first", "real")
        drawn = drawn.withColumn("made", surrogate(key, F.col("kind"), F.col("value"), F.col("draw")))


def pseudonymize(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """``docs`` (doc_id, text and any other columns, kept as they are) with surrogates in text, and n_entities.

    Every row returns once, in no order. Null texts stay null with 0 entities, empty ones empty. A
    column n_entities of the input is replaced. Texts without an entity are unchanged.
    """
    found = _found(F.col("text"))
    rows = docs.drop("n_entities")
    entities = rows.select(F.explode(F.flatten(F.transform(found, _units))).alias("u")).select("u.kind", "u.value").distinct()
    again = redrawn(entities, key)
    many = again.count()
    name = "__draws"
    with_matches = rows.withColumn("__found", found)
    if many:
        # The draws of a text's entities as a map; only texts with such an entity need the join.
        used = rows.select("doc_id", F.explode(F.flatten(F.transform(found, _units))).alias("u")).select("doc_id", "u.kind", "u.value").distinct()
        side = F.broadcast(again) if many <= BROADCAST_ROWS else again
        maps = used.join(side, ["kind", "value"]).groupBy(F.col("doc_id").alias("__id")).agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "value"), "draw"))).alias(name))
        with_matches = with_matches.join(maps, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
        draw_of = lambda u: F.coalesce(F.element_at(F.col(name), F.concat_ws("\u0001", u["kind"], u["value"])), F.lit(0))
    else:
        draw_of = lambda u: F.lit(0)
    made = lambda m: _let(_units(m), lambda units: _let(
        F.transform(units, lambda u: surrogate(key, u["kind"], u["value"], draw_of(u))), lambda s: _rendered(m, units, s)))
    surrogates = F.transform(F.col("__found"), made)
    gaps = F.split(F.col("text"), _ANY)
    woven = F.array_join(F.flatten(F.zip_with(gaps, surrogates, lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    n = F.size("__found")
    entities = F.size(F.filter("__found", lambda m: F.size(_units(m)) > 0))
    return with_matches.withColumn("n_entities", F.when(n > 0, entities).otherwise(0).cast("long")).withColumn(
        "text", F.when(n > 0, woven).otherwise(F.col("text"))).drop("__found", name)
