"""Surrogates for personal data, in DataFrame functions only.

E-mail and IP addresses, phone, card, social-security and account numbers,
secret tokens and titled names are found by one pattern and replaced by
keyed surrogates of the same type and format: digits stay digits, letters
keep case and script, separators, country prefixes and titles stay, cards
that pass the Luhn check get surrogates that pass it, account numbers whose
check digits hold get ones that hold, names follow the title's gender. An entity is its type and canonical form (digits only for
numbers, after a + for international phones; lower case for addresses, single
spaces for names), so all its spellings in all documents get the same
surrogate (coreference). The country code of an international phone is told
from its digits, so it is the same in all spellings.

Distinctness is checked over the corpus: an entity whose surrogate equals
another's or a real entity's of the type (names of all genders are one type
here) is drawn again under the next attempt number, until none is left; of
several that collide the smallest keeps its draw. From the third attempt on addresses grow by digits, names by
a generated word, so that small formats can't run out. Numbers whose format
is full stay at MAX_ATTEMPTS and raise.

Only the rows that hold an entity are joined, by a hash of their text;
copies of a text are worked on once.

Defined cases: null or empty text stays as it is with no entity; repeated
rows are replaced alike; an empty table gives no rows; a column of the
table's own named n_entities gives way to the count, other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_dir, written

QUERY = "op8_pii_surrogates"
ORACLE_SQL = None       # keyed surrogates with redraws; tested by properties

KEY = "surrogate-key-1"
MAX_ATTEMPTS = 64

# Titles by gender, given names by gender, family names.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Г-жа", "госпожа"],
          "m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Г-н", "господин"],
          "n": ["Dr", "Prof"]}
GIVEN = {("f", "Latin"): ["Anna", "Clara", "Elena", "Emma", "Ines", "Julia", "Laura", "Marie"],
         ("m", "Latin"): ["Adam", "David", "Felix", "Hugo", "Leon", "Martin", "Paul", "Thomas"],
         ("n", "Latin"): ["Alex", "Andrea", "Chris", "Kim", "Robin", "Sam", "Sascha", "Toni"],
         ("f", "Cyrillic"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга"],
         ("m", "Cyrillic"): ["Антон", "Борис", "Иван", "Максим", "Олег", "Павел"],
         ("n", "Cyrillic"): ["Валя", "Женя", "Саша", "Шура"]}
FAMILY = {"Latin": ["Adler", "Berger", "Costa", "Duval", "Ferrer", "Garnier", "Hansen", "Iversen",
                    "Jansen", "Keller", "Lopez", "Moreau", "Navarro", "Olsen", "Perrin", "Romero"],
          "Cyrillic": ["Бондарь", "Гончар", "Коваль", "Мельник", "Олейник", "Скляр", "Ткач", "Швец"]}
ALPHABETS = {"[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz",
             "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "[а-яё]": "абвгдежзийклмнопрстуфхцчшщыэюя", "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ",
             "[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω", "[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
             "\\p{Ll}": "abcdefghijklmnopqrstuvwxyz", "\\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + ")"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"\b(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,64}\b|\b(?:sk|pk|ghp|xox[bp])[_-][A-Za-z0-9_-]{16,}"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"
IP = (r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}"
      r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9])(?!\.[0-9])")
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
         r"|(?<![0-9])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
         r"|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
NAME = rf"(?<!\p{{L}}){_TITLE}\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"
# Country codes are prefix-free: one digit, two, else three.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
PATTERN = "|".join((EMAIL, SECRET, IBAN, IP, SSN, PHONE, CARD, NAME))
TRIGGER = rf"[0-9@]|\b(?:sk|pk|ghp|xox[bp])[_-]|{_TITLE}\.? \p{{Lu}}"


def entity_type(m: Column) -> Column:
    """Type of a match of PATTERN."""
    gender = F.when(m.rlike("^(?:" + "|".join(TITLES["f"]) + r")\b"), "name_f").when(
        m.rlike("^(?:" + "|".join(TITLES["m"]) + r")\b"), "name_m").otherwise("name_n")
    return (F.when(m.contains("@"), "email")
            .when(m.rlike(rf"^(?:{IP})$"), "ip")
            .when(m.rlike(rf"^(?:{SSN})$"), "ssn")
            .when(m.rlike(rf"^(?:{CARD})$"), "card")
            .when(m.rlike(rf"^(?:{PHONE})$"), "phone")
            .when(m.rlike(rf"^{_TITLE}\.? "), gender)
            .when(m.rlike(rf"^(?:{SECRET})$"), "secret")
            .otherwise("iban"))


def canonical(kind: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    name = F.regexp_replace(m, rf"^{_TITLE}\.? ", "")
    plus = F.when((kind == "phone") & m.startswith("+"), "+").otherwise("")
    return (F.when(kind.isin("phone", "card", "ssn"), F.concat(plus, digits))
            .when(kind == "email", F.lower(m))
            .when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
            .when(kind.startswith("name"), name).otherwise(m))


def _stream(key: str, *cols: Column) -> Column:
    """256 hex digits keyed by the columns."""
    seed = F.concat_ws("\x1f", F.lit(key), *cols)
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(4)])


def _value(stream: Column, i: Column) -> Column:
    at = F.pmod(i, F.lit(127)) * 2 + 1
    return F.conv(F.substr(stream, at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _shaped(text: Column, stream: Column, hexed: bool = False) -> Column:
    """``text`` with letters and digits redrawn inside their alphabet."""
    def one(i):
        c = F.substr(text, i.cast("int"), F.lit(1))
        if hexed:
            return F.when(c.rlike("[0-9a-f]"), F.substr(
                F.lit("0123456789abcdef"), _value(stream, i) % 16 + 1, F.lit(1))).otherwise(c)
        out = None
        for cls, letters in ALPHABETS.items():
            drawn = F.substr(F.lit(letters), _value(stream, i) % len(letters) + 1, F.lit(1))
            out = F.when(c.rlike(cls), drawn) if out is None else out.when(c.rlike(cls), drawn)
        return out.otherwise(c)
    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), one), ""))


def _luhn_sum(digits: Column, from_right: int) -> Column:
    """Sum of the Luhn products; ``from_right`` = 0 if the last digit is the
    check digit, 1 if the check digit is still missing."""
    n = F.length(digits)

    def product(i):
        d = F.substr(digits, i.cast("int"), F.lit(1)).cast("int")
        twice = (n - i + from_right) % 2 == 1
        return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), product), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """``text`` (digits and capitals, these as 10 to 35) modulo 97."""
    def step(rest, i):
        c = F.substr(text, i.cast("int"), F.lit(1))
        return F.when(c.rlike("[0-9]"), rest * 10 + c.cast("int")).otherwise(
            rest * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), F.lit(0), step)


def _iban(canon: Column, shaped: Column) -> Column:
    """Country and format stay; check digits that held hold again."""
    country, body = F.substr(canon, F.lit(1), F.lit(2)), F.substr(shaped, F.lit(5))
    held = _mod97(F.concat(F.substr(canon, F.lit(5)), F.substr(canon, F.lit(1), F.lit(4)))) == 1
    check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, F.when(held, check).otherwise(F.substr(shaped, F.lit(3), F.lit(2))),
                    body)


def surrogate(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The canonical form of an entity's surrogate at ``attempt``."""
    s = _stream(key, kind, canon, attempt.cast("string"))
    shaped = _shaped(canon, s)
    grow = F.when(attempt >= 2, _shaped(F.repeat(F.lit("0"), (attempt * 2).cast("int")),
                                        F.reverse(s))).otherwise("")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    d = _stream(key, F.lit("domain"), domain)
    email = F.concat(_shaped(local, s), grow, F.lit("@"),
                     _shaped(F.regexp_replace(domain, r"\.[^.]+$", ""), d), F.lit(".example"))
    octet = [(_value(s, F.lit(i)) % 254 + 1).cast("string") for i in range(4)]
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)),
                    F.substr(shaped, F.lit(2), F.length(canon) - 2))
    check = ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string")
    card = F.when(_luhn_sum(canon, 0) % 10 == 0, F.concat(body, check)).otherwise(
        F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(shaped, F.lit(2))))
    country = F.regexp_extract(canon, COUNTRY, 1)
    phone = F.when(country == "", shaped).otherwise(
        F.concat(country, F.substr(shaped, F.length(country) + 2)))
    return (F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", *octet))
            .when(kind == "phone", phone)
            .when(kind == "card", card)
            .when(kind == "secret", F.when(canon.rlike("^[0-9a-f]+$"), _shaped(canon, s, True))
                  .otherwise(F.concat(F.regexp_extract(canon, "^[a-z]+[_-]", 0), _shaped(
                      F.regexp_replace(canon, "^[a-z]+[_-]", ""), s))))
            .when(kind == "iban", _iban(canon, shaped))
            .when(kind.startswith("name"), _name(kind, canon, s, attempt))
            .otherwise(shaped))


def _name(kind: Column, canon: Column, s: Column, attempt: Column) -> Column:
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "Cyrillic").otherwise("Latin")

    def pick(words, i):
        return F.element_at(F.array(*[F.lit(w) for w in words]),
                            _value(s, F.lit(i)) % len(words) + 1)
    given = family = None
    for (g, sc), words in GIVEN.items():
        c = (kind == f"name_{g}") & (script == sc)
        given = F.when(c, pick(words, 0)) if given is None else given.when(c, pick(words, 0))
    for sc, words in FAMILY.items():
        c = script == sc
        family = F.when(c, pick(words, 1)) if family is None else family.when(c, pick(words, 1))
    more = F.when(script == "Cyrillic", _shaped(F.lit("Ввввввв"), F.reverse(s))).otherwise(
        _shaped(F.lit("Xxxxxxx"), F.reverse(s)))
    family = F.when(attempt == 0, family).otherwise(more)
    # One word is a family name, two are given and family name.
    return F.when(canon.contains(" "), F.concat(given, F.lit(" "), family)).otherwise(family)


def spelled(kind: Column, m: Column, s: Column) -> Column:
    """Surrogate ``s`` in the spelling of match ``m``."""
    def digit(i):
        c = F.substr(m, i.cast("int"), F.lit(1))
        before = F.length(F.regexp_replace(F.substr(m, F.lit(1), i.cast("int")), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substr(s, before, F.lit(1))).otherwise(c)
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), digit), "")

    def spaced(i):
        c = F.substr(m, i.cast("int"), F.lit(1))
        before = F.length(F.replace(F.substr(m, F.lit(1), i.cast("int")), F.lit(" "), F.lit("")))
        return F.when(c == " ", c).otherwise(F.substr(s, before, F.lit(1)))
    return (F.when(kind.isin("phone", "card", "ssn"), digits)
            .when(kind == "email", F.when(m == F.upper(m), F.upper(s)).otherwise(s))
            .when(kind == "iban", F.array_join(F.transform(
                F.sequence(F.lit(1), F.length(m)), spaced), ""))
            .when(kind.startswith("name"), F.concat(F.regexp_extract(m, rf"^{_TITLE}\.? ", 0), s))
            .otherwise(s))


def _distinct_surrogates(entities: DataFrame, base: str, key: str) -> DataFrame:
    """(kind, canon, s) with one s per entity, unlike any other and any real
    entity of the kind; all kinds of names count as one."""
    space = F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind"))
    form = F.when(F.col("kind") == "phone", F.regexp_replace("canon", r"\+", "")).otherwise(
        F.col("canon"))
    real = entities.select(space.alias("k"), form.alias("r"))
    taken = (F.col("space") == F.col("k")) & (F.col("s") == F.col("r"))
    tasks = 4 * entities.sparkSession.sparkContext.defaultParallelism
    todo, done, attempt = entities, None, 0
    while True:
        # Draws cost far more than reading: a few megabytes of entities are
        # work for many tasks.
        drawn = written(todo.repartition(tasks).withColumn("s", surrogate(
            F.col("kind"), F.col("canon"), F.lit(attempt), key)), f"{base}/drawn-{attempt}")
        good = drawn.groupBy(space.alias("space"), "s").agg(
            F.min(F.struct("kind", "canon")).alias("e")).select("space", "s", "e.*").join(
            real, taken, "left_anti")
        if done is not None:
            good = good.join(done.select(space.alias("k"), F.col("s").alias("r")), taken,
                             "left_anti")
        good = written(good.select("kind", "canon", "s"), f"{base}/good-{attempt}")
        done = good if done is None else done.unionByName(good)
        todo = written(drawn.drop("s").join(good, ["kind", "canon"], "left_anti"),
                       f"{base}/again-{attempt}")
        if todo.isEmpty():
            return done
        attempt += 1
        if attempt == MAX_ATTEMPTS:
            raise ValueError("a format has no free surrogates left")


def surrogates(docs: DataFrame, text_col: str = "text", key: str = KEY
               ) -> tuple[DataFrame, DataFrame]:
    """(docs with ``text_col`` rewritten and ``n_entities`` added, the entity
    table kind, canon, s)."""
    base = work_dir(docs.sparkSession, "pii")
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    d = docs.withColumn("__m", F.when(text.rlike(TRIGGER), found))
    clash = "n_entities" in docs.columns
    if clash:
        d = d.drop("n_entities")
    held = d.filter(F.size("__m") > 0).withColumn("__h", F.sha2(text, 256))
    per = written(held.select("__h", "__m").dropDuplicates(["__h"]), f"{base}/matches")
    each = per.select("__h", F.posexplode("__m").alias("pos", "m"))
    spellings = written(each.select("m").distinct().withColumn(
        "kind", entity_type(F.col("m"))).withColumn(
        "canon", canonical(F.col("kind"), F.col("m"))), f"{base}/spellings")
    entities = written(spellings.select("kind", "canon").distinct(), f"{base}/entities")
    table = _distinct_surrogates(entities, base, key)
    spelt = written(spellings.join(table, ["kind", "canon"]).select("m", spelled(
        F.col("kind"), F.col("m"), F.col("s")).alias("to")), f"{base}/spelt")
    swap = written(each.join(spelt, "m").groupBy("__h").agg(F.array_sort(F.collect_list(
        F.struct("pos", "to"))).alias("swap")).select(
        F.col("__h").alias("__k"), F.col("swap.to").alias("__to")), f"{base}/swaps")
    plain = d.filter("__m is null or size(__m) = 0").withColumn("n_entities", F.lit(0).cast("long"))
    gaps = F.split(text, PATTERN, -1)
    joined = held.join(swap, F.col("__h") == F.col("__k")).withColumn(
        text_col, F.array_join(F.zip_with(gaps, F.col("__to"), lambda g, t: F.concat(
            g, F.coalesce(t, F.lit("")))), "")).withColumn(
        "n_entities", F.size("__m").cast("long"))
    cols = [c for c in docs.columns if c != "n_entities"] + ["n_entities"]
    return plain.select(*cols).unionByName(joined.select(*cols)), table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document with its personal data replaced."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return surrogates(docs)[0]
