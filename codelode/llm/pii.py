"""Surrogates for personal data (DataFrame operations only).

Entities are found by one pattern. Each distinct entity, in canonical form (letters of e-mail addresses in lower
case, only the digits of phone and card numbers), gets a replacement drawn from a keyed digest: of the same type,
length and format; card numbers pass their checksum. Of persons each word of the name is an entity: words after a
title or next to a common given name, and wherever else the same text repeats them, so "Mr. Smith", "Herr Smith" and
a later "Smith" stay one person; titles stay. Given names become given names of their gender and script, other
words invented surnames of their script and ending. A table of all distinct entities then makes replacements
distinct: of entities with one replacement all but the first, and those whose replacement is an entity of the corpus
or taken, draw again until none is left. A format with fewer values than entities is lengthened after ``MOST_DRAWS``
draws: being distinct comes before the length. A mention takes its entity's replacement in its own format.

Texts are searched once, and written with what was found. An entity of many mentions and a text of many copies meet
their one row where they are, so no task gets all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, join_split, staged

# Patterns by type, in order of precedence. A domain name has 127 labels at most.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.){1,126}[A-Za-z]{2,}+",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "card": r"\b\d{4}(?:[ \-]?\d{4}){3}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "phone": r"\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]?\d{2,4}){2,4}\b|\(\d{3}\) \d{3}-\d{4}\b|\b\d{3}-\d{3}-\d{4}\b",
}
# Names by gender of the title and script.
NAMES = {
    ("m", "latin"): ["Adrian", "Bruno", "Carlos", "Daniel", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Julian", "Karl", "Leo", "Marc", "Noah", "Oscar", "Paul"],
    ("f", "latin"): ["Alma", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Marta", "Nora", "Olga", "Paula"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан", "Фёдор"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"],
}
# Common given names that are looked for, besides those above.
COMMON = {
    ("m", "latin"): ["Andreas", "Anthony", "Antonio", "Charles", "Christopher", "David", "Edward", "François", "George", "Hans", "Jacques", "James", "Javier", "Jean", "John", "Joseph", "Jürgen", "Klaus", "Luis", "Manuel", "Michael", "Miguel", "Peter", "Pierre", "Richard", "Robert", "Stefan", "Thomas", "William", "Wolfgang"],
    ("f", "latin"): ["Alice", "Ana", "Anna", "Barbara", "Carmen", "Catherine", "Charlotte", "Elizabeth", "Emma", "Hannah", "Ingrid", "Isabel", "Jennifer", "Jessica", "Linda", "Lucía", "Maria", "María", "Marie", "Mary", "Monika", "Nancy", "Nathalie", "Patricia", "Petra", "Sarah", "Sophie", "Susan", "Teresa", "Ursula"],
    ("m", "cyrillic"): ["Александр", "Алексей", "Андрей", "Дмитрий", "Михаил", "Николай", "Сергей", "Юрий"],
    ("f", "cyrillic"): ["Александра", "Екатерина", "Наталья", "Светлана", "Татьяна", "Юлия"],
}
SYLLABLES = {"latin": ["ba", "co", "da", "fe", "go", "hu", "ke", "la", "mo", "ni", "pe", "ra", "so", "ti", "vu", "ze"], "cyrillic": ["ба", "ве", "го", "да", "жи", "за", "ко", "лу", "ме", "ни", "пе", "ра", "со", "ту", "фе", "ши"]}
TITLE = r"(?:\b(?:Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Señora?)|(?<!\p{L})г-(?:н|жа))\.? (?:\p{Lu}\. )?"
#: Titles that a given name may follow; in the languages of the others any noun may follow a surname in upper case.
TITLE_OF_TWO = r"\b(?:Mrs?|Ms|Miss|Dr|Prof|Mme|Señora?)\.? "
NAME = r"\p{Lu}(?:\p{L}|['’\-](?!s\b)\p{L})++"
#: The letter in front and the first letter are looked at before any name is tried.
_GIVEN = r"(?=[A-ZА-Я])(?<!\p{L})(?:" + "|".join(sorted({n for names in (NAMES, COMMON) for some in names.values() for n in some}, reverse=True)) + ")"
_AFTER_WORD = rf"(?<=\p{{L}} )(?:(?<={_GIVEN} )|(?<={TITLE_OF_TWO}\p{{Lu}}[\p{{L}}'’\-]{{1,40}} ))"
PATTERNS["person"] = rf"(?=\p{{Lu}})(?:(?:(?<=[.\p{{L}}] )(?<={TITLE})|{_AFTER_WORD}){NAME}|{_GIVEN}(?= {NAME}))"
ALL = "|".join(PATTERNS.values())
DIGIT_TYPES = ("card", "phone", "ssn")
#: Draws in an entity's own format before replacements get longer.
MOST_DRAWS = 60


def kind_of(entity: Column) -> Column:
    """Type of a mention. Names of persons go by the words around them and match no other pattern."""
    return reduce(lambda rest, k: F.when(entity.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(rest), reversed([k for k in PATTERNS if k != "person"]), F.lit("person"))


def canonical(kind: Column, entity: Column) -> Column:
    return F.when(kind == "email", F.lower(entity)).when(kind.isin(*DIGIT_TYPES), F.regexp_replace(entity, r"\D", "")).otherwise(entity)


def _number(digest: Column, at: Column) -> Column:
    """Number from 0 to 65,535 at a place of the digest; each later round of places is shifted."""
    return F.conv(F.substring(digest, F.pmod(at * 4 + F.floor(at / 15), F.lit(60)).cast("int") + 1, F.lit(4)), 16, 10).cast("int")


def _pick(values: str, number: Column) -> Column:
    return F.substring(F.lit(values), F.pmod(number, F.lit(len(values))) + 1, F.lit(1))


def _by_character(text: Column, digest: Column) -> Column:
    """Digits for digits, letters for letters, case by case; other characters stay."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def one(c, i):
        n = _number(digest, i)
        return F.when(c.rlike("[0-9]"), _pick(digits, n)).when(c.rlike("[a-z]"), _pick(lower, n)).when(c.rlike("[A-Z]"), _pick(upper, n)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _card(entity: Column, digest: Column) -> Column:
    """First digit kept, the others drawn, the last one by the checksum."""
    body = F.concat(F.substring(entity, 1, 1), F.substring(_by_character(entity, digest), F.lit(2), F.length(entity) - 2))

    def weighed(c, i):
        d = c.cast("int") * F.when(F.pmod(i, F.lit(2)) == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.split(body, ""), weighed), F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))


def _ip(entity: Column, digest: Column) -> Column:
    return F.array_join(F.transform(F.split(entity, r"\."), lambda o, i: (F.pmod(_number(digest, i), F.lit(254)) + 1).cast("string")), ".")


def _person(entity: Column, digest: Column, draw: int) -> Column:
    """A given name of the same gender and script, or an invented surname; each further draw adds a syllable."""

    def syllables(script, n):
        return F.concat(*[F.element_at(F.array(*map(F.lit, SYLLABLES[script])), F.pmod(_number(digest, F.lit(k + 1)), F.lit(16)) + 1) for k in range(n)]) if n else F.lit("")

    cyrillic = F.initcap(syllables("cyrillic", draw + 3))
    surname = F.when(entity.rlike(r"\p{IsCyrillic}"), F.concat(cyrillic, F.when(entity.rlike("[ая]$"), "ва").otherwise("в"))).otherwise(F.initcap(syllables("latin", draw + 3)))
    for (gender, script), names in NAMES.items():
        name = F.element_at(F.array(*map(F.lit, names)), F.pmod(_number(digest, F.lit(0)), F.lit(len(names))) + 1)
        surname = F.when(entity.isin(*names, *COMMON[gender, script]), F.concat(name, syllables(script, draw))).otherwise(surname)
    return surname


def surrogate(kind: Column, entity: Column, draw: int, key: str) -> Column:
    """Replacement of a canonical entity at a number of draws."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, F.lit(str(draw))), 256)
    email = F.concat(_by_character(F.regexp_extract(entity, r"^(.*)\.[^.]+$", 1), digest), F.regexp_extract(entity, r"(\.[^.]+)$", 1))
    iban = F.concat(F.substring(entity, 1, 2), F.substring(_by_character(entity, digest), F.lit(3), F.length(entity)))
    phone = F.concat(F.substring(entity, 1, 1), F.substring(_by_character(entity, digest), F.lit(2), F.length(entity)))
    drawn = F.when(kind == "email", email).when(kind == "iban", iban).when(kind == "card", _card(entity, digest)).when(kind == "ip", _ip(entity, digest)).when(kind == "phone", phone).when(kind == "person", _person(entity, digest, draw)).otherwise(_by_character(entity, digest))
    if draw <= MOST_DRAWS:
        return drawn
    more = F.concat(*[_pick("0123456789", _number(digest, F.lit(k + 20))) for k in range(draw - MOST_DRAWS)])
    return F.when(kind == "person", drawn).when(kind == "email", F.concat(more, drawn)).otherwise(F.concat(drawn, more))


def in_format(kind: Column, mention: Column, replacement: Column) -> Column:
    """The replacement in the format of a mention."""
    def digit(c, i):
        at = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"\D", ""))
        return F.when(c.rlike("[0-9]"), F.substring(replacement, at, F.lit(1))).otherwise(c)

    def cased(c, r):
        return F.when(c.rlike("[A-Z]"), F.upper(r)).otherwise(r)

    more = F.substring(replacement, F.length(F.regexp_replace(mention, r"\D", "")) + 1, F.length(replacement))
    by_digit = F.concat(F.array_join(F.transform(F.split(mention, ""), digit), ""), more)
    by_case = F.array_join(F.zip_with(F.split(mention, ""), F.split(replacement, ""), cased), "")
    return F.when(kind.isin(*DIGIT_TYPES), by_digit).when(kind == "email", by_case).otherwise(replacement)


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, replacement) of distinct (kind, entity); no two entities of a kind share one and none is an entity itself.

    Each round only those without a replacement draw. Of those that draw the same the first in order takes it.
    """
    real = entities.select("kind", F.col("entity").alias("replacement"))
    order = Window.partitionBy("kind", "replacement").orderBy("entity")
    pending, settled = entities.select("kind", "entity"), []
    while True:
        drawn = pending.withColumn("replacement", surrogate(F.col("kind"), F.col("entity"), len(settled), key)).withColumn("place", F.row_number().over(order))
        taken = reduce(DataFrame.unionByName, [s.select("kind", "replacement") for s in settled], real).withColumn("taken", F.lit(True))
        drawn = drawn.join(taken.hint("merge"), ["kind", "replacement"], "left")
        drawn = staged(drawn.select("kind", "entity", "replacement", ((F.col("place") > 1) | F.col("taken").isNotNull()).alias("again")), "drawn")
        settled.append(drawn.filter(~F.col("again")).drop("again"))
        pending = drawn.filter("again").select("kind", "entity")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, settled)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with entities replaced, n_entities.

    Null texts stay null and have no entities. Texts that are equal are rewritten equally, whatever their ids; null
    and repeated ids are returned as they are. An empty table gives an empty result. Extra columns are ignored.
    A word that is part of a name in a text is replaced throughout that text, where it begins with upper case.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    first = F.when(F.col("text").rlike(rf"[0-9@]|{TITLE}|{_GIVEN} "), F.regexp_extract_all("text", F.lit(ALL), F.lit(0)))
    hint = staged(rows.withColumn("first", first), "hint")
    size = F.coalesce(F.size("first"), F.lit(0))
    plain = hint.filter(size <= 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    names = F.reverse(F.array_sort(F.array_distinct(F.filter("first", lambda m: m.rlike(rf"^{NAME}$")))))
    again = F.concat(F.lit(ALL + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))
    found = hint.filter(size > 0).select("doc_id", "text", F.sha2("text", 256).alias("text_key"), "first", F.when(F.size(names) > 0, again).otherwise(ALL).alias("pattern"))
    every = F.when(F.col("pattern") == ALL, F.col("first")).otherwise(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    texts = staged(found.select("text_key", every.alias("mentions")).groupBy("text_key").agg(F.first("mentions").alias("mentions"), F.count(F.lit(1)).alias("copies")), "texts")
    mentions = texts.select("text_key", F.posexplode("mentions").alias("at", "mention")).withColumn("kind", kind_of(F.col("mention")))
    mentions = staged(mentions.withColumn("entity", canonical(F.col("kind"), F.col("mention"))), "mentions")
    entities = staged(mentions.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("times")), "kinds")
    replaced = distinct_surrogates(entities, key)
    n_mentions, n_found = (t.agg(F.sum(c)).first()[0] or 0 for t, c in ((entities, "times"), (texts, "copies")))
    inserted = join_split(mentions, replaced.join(entities.hint("merge"), ["kind", "entity"]), ["kind", "entity"], "times", n_mentions)
    inserted = inserted.select("text_key", "at", in_format(F.col("kind"), F.col("mention"), F.col("replacement")).alias("put"))
    inserted = inserted.groupBy("text_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "put"))), lambda x: x["put"]).alias("puts"))
    puts = staged(inserted.join(texts.select("text_key", "copies").hint("merge"), "text_key"), "puts")
    discard(texts, mentions, replaced, entities)
    parts = F.split("text", F.col("pattern"), -1)
    rewritten = F.array_join(F.zip_with(parts, F.col("puts"), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    changed = join_split(found, puts, ["text_key"], "copies", n_found).select("doc_id", rewritten.alias("text"), F.size("puts").cast("long").alias("n_entities"))
    return plain.unionByName(changed)
