"""Personal data replaced by surrogates, in DataFrame operations only.

Detected are e-mail addresses, phone numbers, IPv4 addresses, payment cards, social security numbers, secrets (cloud keys, values after
password, token and the like) and names behind a form of address. An entity is reduced to a normal form (an address in lower case,
a number's digits), so that all its spellings refer to one thing. The surrogate of a normal form is drawn from a keyed SHA-256 and keeps
the type and format: digits for digits, letters for letters of the same case, hexadecimal for hexadecimal, valid octets, a valid check digit for
a valid card, country code and top-level domain as they were; a name's given name and surname are drawn each by itself, of the same gender and
script, so that a surname alone still refers to the same person. It is written back into each occurrence's own spelling.

Collision checks: no two entities of a type get one surrogate, and no surrogate equals an entity found in the corpus. Entities in a
clash (all but the smallest) are drawn again with the next attempt number, until there is none. Given names and surnames are checked word by
word, whatever their capitals: distinct words get distinct surrogates in all names that hold them, so distinct names do. They are a word of a short list and a
syllable; each further attempt adds a syllable, and so has 80 times the space. A word in capitals stays one; middle names are given names. Secrets and addresses grow after LONGER attempts, as very short ones may
have no free surrogate of their length. What holds no letter or digit to be drawn is not detected.

Null texts stay null. Repeated rows and shared or null ids are treated alike, text by text. Empty tables give empty results. Other
columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table, written

KEY = "change me: the deployment's secret"
MOST_ATTEMPTS = 50
LONGER = 8

# Forms of address by gender, and names by script and gender.
MALE = "Mr|Herr|Monsieur|Señor|Sr"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra"
OTHER = "Dr|Prof"
GIVEN = {
    "latin_m": ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Martin", "Noah", "Oscar", "Paul"],
    "latin_f": ["Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Katia", "Laura", "Maria", "Nina", "Olga", "Paula"],
    "cyrillic_m": ["Иван", "Пётр", "Олег", "Антон", "Борис", "Павел", "Роман", "Сергей"],
    "cyrillic_f": ["Анна", "Мария", "Ольга", "Ирина", "Нина", "Вера", "Елена", "Дарья"],
}
SURNAMES = {
    "latin": ["Abbott", "Becker", "Carter", "Dubois", "Evans", "Fischer", "Garcia", "Hansen", "Ibarra", "Jansen", "Keller", "Lambert", "Moreau", "Novak", "Ortega", "Parker", "Quintana", "Richter", "Schmid", "Turner", "Urban", "Vogel", "Weber", "Young"],
    "cyrillic": ["Смирнов", "Кузнецов", "Попов", "Соколов", "Лебедев", "Козлов", "Новиков", "Морозов"],
}

EMAIL = r"(?<![A-Za-z0-9._%+\-])(?=[._%+\-]*[A-Za-z0-9]|[._%+\-]+@[\-.]*[A-Za-z0-9][A-Za-z0-9\-.]*\.[A-Za-z])[A-Za-z0-9._%+\-]{1,256}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}"
PHONE = r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3}[ .\-]?\d{2,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<!\d)\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
CARD = r"(?<!\d)\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{4}(?!\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CLOUD = r"AKIA[A-Z0-9]{16}"
SECRET = r"(?<=\b(?:password|passwd|pwd|token|secret|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?)(?=[_\-]*[A-Za-z0-9])[A-Za-z0-9_\-]{6,}"
NAME = rf"\b(?:{MALE}|{FEMALE}|{OTHER})\.? \p{{Lu}}[\p{{L}}'\-]{{1,40}}(?: \p{{Lu}}[\p{{L}}'\-]{{1,40}}){{0,2}}"
ANY = "|".join((SECRET, EMAIL, PHONE, SSN, CARD, IP, CLOUD, NAME))


def kind_of(entity: Column) -> Column:
    """The type of a found entity, from its form."""
    digits = F.length(F.regexp_replace(entity, r"\D", ""))
    return (
        F.when(entity.rlike(f"^(?:{EMAIL})$"), "email")
        .when(entity.rlike(f"^(?:{IP})$"), "ip")
        .when(entity.rlike(f"^(?:{SSN})$"), "ssn")
        .when(entity.rlike(r"^[\d \-]+$") & (digits == 16), "card")
        .when(entity.rlike(r"^\+?[\d ().\-]+$") & (digits >= 7), "phone")
        .when(entity.rlike(rf"^(?:{NAME})$"), "name")
        .otherwise("secret")
    )


def normal_form(kind: Column, entity: Column) -> Column:
    return F.when(kind == "email", F.lower(entity)).when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, r"\D", "")).otherwise(entity)


def _draw(seed: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _by_class(chars: Column, seed: Column, hexadecimal: Column) -> Column:
    """Characters drawn anew: digits for digits, letters for letters of the same case; others stay."""
    lower, upper, hexes = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("abcdef")

    def one(c, i):
        return (
            F.when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string"))
            .when(c.rlike("[a-f]") & hexadecimal, F.substring(hexes, _draw(seed, i, 6) + 1, F.lit(1)))
            .when(c.rlike("[a-z]"), F.substring(lower, _draw(seed, i, 26) + 1, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substring(upper, _draw(seed, i, 26) + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column, weigh_last: bool) -> Column:
    """The Luhn sum of a string of digits; with ``weigh_last`` the last digit counts double, as before a check digit."""
    rest = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == (0 if weigh_last else 1), 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(rest, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def _named(names: DataFrame) -> DataFrame:
    """(kind, normal) of names, with surname, given and middle: their words as entities of their own, given names behind their gender.

    The gender is the form of address's. A neutral one (Dr, Prof) takes that of the other forms in front of the same full name; where there are none (or as
    many of either), of those in front of the same given name; then of the lists below; then any, by the given name's hash. So a person is one, however addressed."""
    words = F.split("normal", " ")
    parts = names.withColumn("surname", F.lower(F.element_at(words, -1)))
    for k, c in ((1, "given"), (2, "middle")):
        parts = parts.withColumn(c, F.when(F.size(words) > k + 1, F.lower(F.get(words, F.lit(k)))))
    address = F.element_at(words, 1)
    parts = parts.withColumn("says", F.when(address.rlike(rf"^(?:{FEMALE})\.?$"), -1).when(address.rlike(rf"^(?:{MALE})\.?$"), 1).otherwise(0))
    said = parts.where("given IS NOT NULL AND says <> 0")
    person, first = ["surname", "given", "middle"], ["given"]
    by_person, by_first = (said.groupBy(*keys).agg(F.sign(F.sum("says")).cast("int").alias(c)) for keys, c in ((person, "by_person"), (first, "by_first")))
    neutral = parts.where("given IS NOT NULL AND says = 0")
    by_person = by_person.select(*[F.col(c).alias(f"_{c}") for c in person], "by_person")
    neutral = neutral.join(by_person, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in person], "left").join(by_first, "given", "left")
    listed = lambda which: F.col("given").isin([x.lower() for script in ("latin", "cyrillic") for x in GIVEN[f"{script}_{which}"]])
    drawn = F.when(listed("m"), 1).when(listed("f") | (F.pmod(F.xxhash64("given"), F.lit(2)) == 0), -1).otherwise(1)
    neutral = neutral.withColumn("says", F.coalesce(F.nullif("by_person", F.lit(0)), F.nullif("by_first", F.lit(0)), drawn))
    kept = ["kind", "normal", "surname", "given", "middle", "says"]
    every = parts.where("given IS NULL OR says <> 0").select(kept).union(neutral.select(kept))
    behind = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.when(F.col("says") < 0, "f|").otherwise("m|"), F.col(c))).alias(c)
    return every.select("kind", "normal", "surname", behind("given"), behind("middle"))


def _word(kind: Column, normal: Column, attempt: Column, seed: Column) -> Column:
    """A given name or surname in lower case: one of a list and a syllable, and one more for each further attempt."""
    pick = lambda names: F.element_at(F.array(*[F.lit(x.lower()) for x in names]), _draw(seed, F.lit(0), len(names)) + 1)
    letter = lambda letters, i: F.substring(F.lit(letters), _draw(seed, i, len(letters)) + 1, F.lit(1))

    def drawn(script, consonants, vowels):
        stem = F.when(kind == "surname", pick(SURNAMES[script])).when(normal.startswith("f|"), pick(GIVEN[f"{script}_f"])).otherwise(pick(GIVEN[f"{script}_m"]))
        syllables = F.transform(F.sequence(F.lit(1), attempt + 1), lambda i: F.concat(letter(consonants, 2 * i), letter(vowels, 2 * i + 1)))
        return F.concat(stem, F.array_join(syllables, ""))

    return F.when(normal.rlike(r"\p{IsCyrillic}"), drawn("cyrillic", "бвгдзклмнпрстфхш", "аеиоу")).otherwise(drawn("latin", "bdfghklmnprstvwz", "aeiou"))


def surrogate(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a normal form, itself in normal form."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, normal, attempt.cast("string")), 256)
    chars, never = F.split(normal, ""), F.lit(False)
    plain = _by_class(chars, seed, normal.rlike("^[0-9a-f]+$"))
    top = F.regexp_extract(normal, r"(\.[a-z]+)$", 1)
    email = F.concat(_by_class(F.split(F.regexp_replace(normal, r"\.[a-z]+$", ""), ""), seed, never), top)
    ip = F.array_join(F.transform(F.split(normal, r"\."), lambda c, i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    digits = _by_class(chars, seed, never)
    # phones keep all but their last ten digits, and an area code does not start with 0 or 1
    head = F.greatest(F.length(normal) - 10, F.lit(0))
    phone = F.concat(F.substring(normal, F.lit(1), head), (_draw(seed, F.lit(99), 8) + 2).cast("string"), F.substring(digits, head + 2, F.lit(99)))
    body = F.concat(F.substring(normal, 1, 1), F.substring(digits, F.lit(2), F.length(normal) - 2))
    check = F.pmod(10 - F.pmod(_luhn(body, True), F.lit(10)), F.lit(10))
    card = F.concat(body, F.when(F.pmod(_luhn(normal, False), F.lit(10)) == 0, check).otherwise(F.pmod(check + 1 + _draw(seed, F.lit(98), 9), F.lit(10))).cast("string"))
    longer = F.substring(seed, F.lit(1), F.greatest(attempt - LONGER, F.lit(0)))
    cloud = F.concat(F.lit("AKIA"), F.substring(plain, F.lit(5), F.lit(99)))
    return (
        F.when(kind == "email", F.concat(longer, email)).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "ssn", digits).when(kind == "card", card)
        .when(kind.isin("given", "surname"), _word(kind, normal, attempt, seed)).when(normal.rlike(f"^{CLOUD}$"), cloud).otherwise(F.concat(plain, longer))
    )


def _spelled(kind: Column, entity: Column, new: Column) -> Column:
    """A surrogate in the spelling of an occurrence: its separators and its capitals."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    filled = F.aggregate(F.split(entity, ""), start, lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["out"], F.substring(new, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))))["out"]
    cased = F.array_join(F.zip_with(F.split(entity, ""), F.split(new, ""), lambda c, n: F.when(c.rlike("[A-Z]"), F.upper(n)).otherwise(n)), "")
    return F.when(kind.isin("phone", "card", "ssn"), filled).when(kind == "email", cased).otherwise(new)


def assigned(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, normal) -> (kind, normal, new): surrogates without clashes."""
    spark = entities.sparkSession
    named, other = (entities.where(x).select("kind", "normal").distinct() for x in (F.col("kind") == "name", F.col("kind") != "name"))
    named = written(_named(named), spark, "names")
    words = named.select(F.lit("surname").alias("kind"), F.col("surname").alias("normal")).union(named.select(F.lit("given"), F.explode(F.array("given", "middle"))))
    drawn = other.union(words.where("normal IS NOT NULL").distinct()).withColumn("attempt", F.lit(0))
    for _ in range(MOST_ATTEMPTS):
        drawn = written(drawn.withColumn("new", surrogate(F.col("kind"), F.col("normal"), F.col("attempt"), key)), spark, "surrogates")
        # how often a surrogate is drawn, who keeps it, and whether it is an entity itself
        uses = drawn.select("kind", F.col("new").alias("value"), "normal", F.lit(False).alias("found")).union(drawn.select("kind", F.when(F.col("kind") == "given", F.substring("normal", 3, 100)).otherwise(F.col("normal")).alias("value"), F.lit(None).cast("string"), F.lit(True)))
        uses = uses.groupBy(F.col("kind").alias("used_kind"), "value").agg(F.count("normal").alias("times"), F.min("normal").alias("keeper"), F.max("found").alias("found")).where("times > 0 AND (times > 1 OR found)")
        if not uses.head(1):
            break
        uses = uses.withColumnRenamed("value", "used")
        met = drawn.join(uses, (F.col("kind") == F.col("used_kind")) & (F.col("new") == F.col("used")), "left")
        clash = F.coalesce(F.col("found") | (F.col("keeper") != F.col("normal")), F.lit(False))
        drawn = met.select("kind", "normal", (F.col("attempt") + F.when(clash, 1).otherwise(0)).alias("attempt"))
    else:
        raise ValueError(f"surrogates still clash after {MOST_ATTEMPTS} attempts")
    own = F.split("normal", " ")
    for k, c in ((-1, "surname"), (2, "given"), (3, "middle")):
        new = drawn.where(F.col("kind") == ("surname" if c == "surname" else "given")).select(F.col("normal").alias(c), F.col("new").alias(f"new_{c}"))
        word = F.element_at(own, k) if k < 0 else F.get(own, F.lit(k - 1))
        named = named.join(new, c, "left").withColumn(f"new_{c}", F.when(word == F.upper(word), F.upper(f"new_{c}")).otherwise(F.initcap(f"new_{c}")))
    names = named.select("kind", "normal", F.concat_ws(" ", F.element_at(own, 1), "new_given", "new_middle", "new_surname").alias("new"))
    return drawn.where(~F.col("kind").isin("given", "surname")).select("kind", "normal", "new").union(names)


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with its text pseudonymised, and n_entities."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "n_entities"]
    possible = docs.where(F.col("text").rlike("[0-9@=:]|" + "|".join(x for x in f"{MALE}|{FEMALE}|{OTHER}".split("|"))))
    id_, new_ = fresh(docs.columns, "_id", "_new")
    row = F.xxhash64("doc_id", "text")  # rows that shared it would only know each other's entities, whose surrogates are the same everywhere
    found = possible.select(row.alias(id_), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))).alias("entity"))
    found = found.withColumn("kind", kind_of(F.col("entity"))).withColumn("normal", normal_form(F.col("kind"), F.col("entity")))
    found = written(found, spark, "entities")
    new = assigned(found, key)
    pairs = found.join(new, ["kind", "normal"]).select(id_, F.struct("entity", _spelled(F.col("kind"), F.col("entity"), F.col("new")).alias("new")).alias("pair"))
    maps = pairs.groupBy(id_).agg(F.map_from_entries(F.array_distinct(F.collect_list("pair"))).alias(new_))
    met = docs.select(*names).withColumn(id_, row).join(maps, id_, "left")
    hits, rest = F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), F.split("text", ANY, -1)
    replaced = F.array_join(F.zip_with(rest, hits, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(F.element_at(new_, b), b, F.lit("")))), "")
    touched = F.col(new_).isNotNull() & F.col("text").isNotNull()
    return met.select(*[F.when(touched, replaced).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in names], F.when(touched, F.size(hits)).otherwise(0).cast("long").alias("n_entities"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_entities", "text")
