"""Personal data replaced by keyed surrogates, in SQL expressions only.

An entity is (kind, canonical form): spelling variants of one address or number are one entity, a given name and a surname
are entities each. The surrogate is drawn from a keyed digest and has the entity's type and format: letters become letters of the
script, digits digits, cards keep a valid check digit, dates stay dates, names keep gender and script. Gender comes from the forms of
address that the corpus has for a given name, else from the lists of names; if these disagree, the surrogate is neutral. Key and entity
decide, so an entity has one surrogate in the whole corpus (coreference). Entities are collected once; where two of a kind draw the same
surrogate, or one that is a real entity, all but the first draw again. After PLAIN_DRAWS draws a surrogate gets a character more with
each further draw (dates: a later year), so that no format is ever used up (distinctness).

Names are found by a form of address, or by a known given name before a capitalised word. Their parts are then replaced wherever they
stand alone as words of the same text. Names in scripts other than Latin, Cyrillic and Greek get Latin surrogates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

#: Forms of address with the gender that they tell.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Madam", "Госпожа", "г-жа")
NEUTRAL = ("Dr", "Prof", "Доктор")
#: Given names by script and gender; beginnings and ends that surnames are put together from.
GIVEN = {
    ("latin", "m"): "Adam Alan Albert Anton Arthur Bruno Carl Daniel David Edgar Emil Erik Felix Frank Georg Hugo Ivan Jakob Julian Karl Leo Lucas Martin Nils Oscar Paul Peter Robert Simon Theo Victor Walter".split(),
    ("latin", "f"): "Ada Alice Anna Berta Carla Clara Diana Edith Ella Emma Eva Flora Greta Hanna Helena Ida Irene Julia Laura Lena Lucia Maria Martha Nina Nora Olga Paula Rosa Sara Sofia Vera Zoe".split(),
    ("latin", "n"): "Alex Andrea Ariel Chris Dana Jamie Jean Jo Kim Kris Lee Max Micha Noa Pat Quinn Robin Sam Sascha Toni".split(),
    ("cyrillic", "m"): "Алексей Андрей Антон Борис Виктор Глеб Денис Егор Иван Игорь Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур Юрий".split(),
    ("cyrillic", "f"): "Алина Анна Вера Дарья Ева Елена Зоя Инна Ирина Кира Лидия Мария Нина Ольга Полина Раиса София Тамара Ульяна Юлия".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Тоня Шура Вася Паша".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Πέτρος Σταύρος".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("greek", "n"): "Άγγελος Εμμανουήλ Πασχάλης Φωτεινή".split(),
}
SURNAMES = {
    "latin": ("Al Bach Berg Brand Dal Ferr Gold Grün Hart Holm Kalt Kamp Land Lind Mar Neu Nord Ost Reich Ros Sand Schön Stein Stern Sund Val Vald Wald West Winter".split(), "acher arz au beck dahl ener er feld heim hoff ing ler lund mann ner oni quist sen sson wall".split()),
    "cyrillic": ("Бел Бор Верх Волк Гор Дуб Жук Зим Кал Крыл Лаз Лес Мак Мор Нов Орл Пет Род Сад Сок Том Фед Хол Шум".split(), "анский енко ин ников ов овский онов ук".split()),
    "greek": ("Αθαν Γεωργ Δημητρ Θεοδ Κων Μαρκ Νικολ Παν Σταυρ Χρηστ".split(), "άκης ίδης όπουλος ιάδης ούλης".split()),
}
#: Given names that tell a name without a form of address, besides those above; words of streets that stay.
KNOWN = {
    "m": "Andrew Anthony Carlos Charles Claude François Friedrich Hans Heinrich James Javier John Jonathan Jorge José Joseph Juan Jürgen Klaus Louis Luis Matthew Michael Miguel Nicolas Philippe Pierre Richard Stefan Thomas William Wolfgang".split(),
    "f": "Barbara Christine Elizabeth Émilie Françoise Jennifer Jessica Karen Linda Marie Mary Patricia Sabine Susan Ursula".split(),
}
STREET = "street st avenue ave road rd lane ln drive boulevard blvd court square rue place chemin calle avenida plaza de del des du la le los las".split()
PLAIN_DRAWS = 8
_TITLE = r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True)) + r")\.? "
_NAME = r"\p{Lu}[\p{L}\p{M}'’-]++"
_GIVEN = r"(?=\p{Lu})(?<![\p{L}\p{N}'’-])(?:" + "|".join(sorted({x for names in (*KNOWN.values(), *GIVEN.values()) for x in names}, key=lambda x: (-len(x), x))) + r") "
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "aws_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "hex_secret": r"(?<![A-Za-z0-9])(?=[0-9a-fA-F]{32})(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,}+(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "birth": r"(?=\d)(?<=born |born on |born: |DOB |DOB: |birth: |geboren am |geb\. |né le |née le |nacido el |nacida el )" + _DATE + r"(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:(?<!\d)\+\d{1,3}[ .-]?|(?<![\d+]))(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .-]\(?\d{1,5}\)?){2,5}(?!\d)|(?<!\d)\+\d{8,15}(?!\d)",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "street": r"(?=\d)(?<![\p{L}\p{N}])\d{1,5}(?:(?: \p{Lu}[\p{L}'’-]+){1,3} (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)(?![\p{L}\p{N}])| (?:rue|avenue|boulevard|place|chemin)(?: (?:de|du|des|la|le))* \p{Lu}[\p{L}'’-]+)",
    "name": _TITLE + _NAME + rf"(?: {_NAME})?",
    "given": _GIVEN + _NAME,
    "street_before": r"(?<![\p{L}\p{N}])(?:(?:Calle|Avenida|Plaza)(?: (?:de|del|la|los|las))* \p{Lu}[\p{L}'’-]+|(?=\p{Lu}\p{Ll}*(?:straße|strasse|weg|platz|allee|gasse) )\p{Lu}\p{Ll}+) \d{1,5}(?!\d)",
}
_DIGITS, _LETTERS = ("hex_secret", "ip", "birth", "ssn", "phone", "card", "street"), ("aws_key", "hex_secret", "iban", "name", "given", "street_before")
#: Cheap tests stand first: most places are within a word, of the others most have no digit, +, ( or capital.
ALL = "(?:" + PATTERNS["email"] + "|(?=[0-9+(])(?:" + "|".join(PATTERNS[k] for k in _DIGITS) + r")|(?=[\p{Lu}a-fг])(?<![\p{L}\p{N}])(?:" + "|".join(PATTERNS[k] for k in _LETTERS) + "))"
_LOOSE = "[ .()+-]"


def _suspect(text: Column) -> Column:
    """Cheap and lossless: every pattern has a digit, an @, a form of address or a known given name."""
    some = text.rlike("[0-9@]")
    for title in (*MALE, *FEMALE, *NEUTRAL):
        some = some | text.contains(title)
    return some | text.rlike(_GIVEN)


def _is_name(value: Column) -> Column:
    return value.rlike(f"^(?:{_TITLE}|{_NAME} {_NAME}$)")


def _kind(value: Column) -> Column:
    """The first pattern that the whole value fits, its surroundings not being there; "word": a part of a name that stands alone."""
    out = F.when(_is_name(value), "name").when(value.contains("@"), "email").when(value.rlike("^AKIA[0-9A-Z]{16}$"), "aws_key")
    out = out.when(value.rlike("^[0-9a-fA-F]{32,}$") & value.rlike("[a-fA-F]"), "hex_secret").when(value.rlike(f"^{_NAME}$"), "word").when(value.rlike(r"^[A-Z]{2}\d"), "iban")
    out = out.when(value.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip").when(value.rlike(f"^{_DATE}$"), "birth").when(value.rlike(r"\p{L}"), "street")
    return out.when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(value.rlike(f"^(?:{PATTERNS['phone']})$"), "phone").otherwise("card")


def _canon(kind: Column, value: Column) -> Column:
    return F.lower(F.when(kind.isin("phone", "card", "ssn", "iban"), F.regexp_replace(value, _LOOSE, "")).otherwise(value))


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _given(name: Column) -> Column:
    return F.concat(F.lit("given_"), _script(name), F.lit("|"), F.lower(name))


def _surname(name: Column) -> Column:
    return F.concat(F.lit("surname_"), _script(name), F.lit("|"), F.lower(name))


def _name_parts(value: Column) -> tuple[Column, Column, Column, Column]:
    """Form of address with its blank, gender, given name ("" if there is but one name), surname."""
    title = F.regexp_extract(value, f"^{_TITLE}", 0)
    bare = F.regexp_replace(title, r"\.? $", "")
    names = F.split(F.regexp_replace(value, f"^{_TITLE}", ""), " ")
    given = F.when(F.size(names) > 1, F.get(names, F.lit(0))).otherwise("")
    listed = lambda g: given.isin(*KNOWN[g], *(x for (_, k), names in GIVEN.items() if k == g for x in names))
    gender = F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").when(listed("m"), "m").when(listed("f"), "f").otherwise("n")
    return title, gender, given, F.element_at(names, -1)


def _keys(value: Column, kind: Column, canon: Column) -> Column:
    """Array of (entity "kind|canonical form", gender) of a value; names have two, words none of their own."""
    _, gender, given, surname = _name_parts(value)
    one = lambda e, g: F.struct(e.alias("entity"), g.alias("gender"))
    none = F.lit(None).cast("string")
    names = F.array_compact(F.array(one(_surname(surname), none), F.when(given != "", one(_given(given), gender))))
    return F.when(kind == "name", names).when(kind == "word", F.slice(names, 1, 0)).otherwise(F.array(one(F.concat(kind, F.lit("|"), canon), none)))


def _draw(kind: Column, canon: Column, key: str, attempt: Column) -> Column:
    """The surrogate's canonical form: as long as canon, but for ip, streets and names, and from PLAIN_DRAWS attempts on."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    digest = F.concat(F.sha2(seed, 512), F.sha2(F.concat(F.lit("|"), seed), 512))
    byte = lambda i: F.conv(F.substring(digest, F.lit(1) + i * 2 % 254, F.lit(2)), 16, 10).cast("int")
    wide = lambda i: F.conv(F.substring(digest, F.lit(1) + i * 8 % 248, F.lit(8)), 16, 10).cast("long")
    number = lambda i, n: (byte(i) % n).cast("string")
    letter = lambda letters, i: F.substring(F.lit(letters), 1 + byte(i) % len(letters), F.lit(1))

    def fill(x: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            script = F.when(c.rlike(r"\p{IsCyrillic}"), letter("абвгдежзиклмнопрстуфхцчшэюя", i)).when(c.rlike(r"\p{IsGreek}"), letter("αβγδεζηθικλμνξοπρστυφχψω", i))
            return F.when(c.rlike(r"\p{N}"), number(i, 10)).when(c.rlike(r"\p{L}"), script.otherwise(letter("abcdefghijklmnopqrstuvwxyz", i))).otherwise(c)

        return F.array_join(F.transform(F.split(x, ""), one), "")

    more = fill(F.repeat(F.lit("0"), F.greatest(attempt - PLAIN_DRAWS + 1, F.lit(0))))
    tail = F.substring_index(canon, ".", -1)
    email = F.concat(F.translate(more, "0123456789", "abcdefghij"), fill(F.substring(canon, F.lit(1), F.length(canon) - F.length(tail))), tail)
    hexes = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.substring(digest, F.lit(1) + (i + F.floor(i / 254).cast("int")) % 254, F.lit(1))), "")
    ip = F.concat_ws(".", (1 + byte(F.lit(0)) % 223).cast("string"), *((1 + byte(F.lit(i)) % 254).cast("string") for i in (1, 2, 3)))
    # a country code stays; a number's own first digit is 2 to 9
    code = F.greatest(F.length(canon) - 10, F.lit(0))
    phone = F.concat(F.substring(canon, F.lit(1), code), (2 + byte(F.lit(90)) % 8).cast("string"), fill(F.substring(canon, code + 2, F.length(canon))), more)
    body = F.concat(F.substring(canon, 1, 1), fill(F.substring(canon, F.lit(2), F.length(canon) - 2)))
    last = F.when(_luhn(canon) == 0, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")).otherwise(number(F.lit(100), 10))
    two = lambda i, n: F.lpad((1 + byte(F.lit(i)) % n).cast("string"), 2, "0")
    year = F.least(1930 + wide(F.lit(0)) % (75 + 40 * attempt), F.lit(9999)).cast("string")
    mark = F.substring(F.regexp_replace(canon, "[0-9]", ""), 1, 1)
    birth = F.when(mark == "-", F.concat_ws("-", year, two(5, 12), two(6, 28))).otherwise(F.concat(two(5, 12), mark, two(6, 12), mark, year))

    def surname(script: str, at: Column) -> Column:
        begins, ends = SURNAMES[script]
        pick = lambda words, i: F.get(F.array(*map(F.lit, words)), (wide(at + i) % len(words)).cast("int"))
        # longer ones only where short ones could not keep entities apart
        return F.concat(pick(begins, 0), F.when(attempt > 0, F.lower(pick(begins, 1))).otherwise(""), F.when(attempt > 2, F.lower(pick(begins, 2))).otherwise(""), pick(ends, 3))

    end = lambda w: F.regexp_extract(w, "(straße|strasse|weg|platz|allee|gasse)$", 1)
    word = lambda w, i: F.when(w.rlike("^[0-9]"), F.concat((1 + byte(i) % 9).cast("string"), fill(F.substring(w, F.lit(2), F.length(w))), more)).when(w.isin(*STREET), w).otherwise(F.concat(F.lower(surname("latin", 4 * i)), end(w)))
    street = F.array_join(F.transform(F.split(canon, " "), word), " ")
    out = F.when(kind == "email", email).when(kind == "hex_secret", F.concat(hexes, more)).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", F.concat(body, last, more)).when(kind == "birth", birth).when(kind == "street", street)
    out = out.when(kind == "aws_key", F.concat(F.lit("akia"), fill(F.substring(canon, 5, 100)), more)).when(kind == "iban", F.concat(F.substring(canon, 1, 2), fill(F.substring(canon, 3, 100)), more)).when(kind == "ssn", F.concat(fill(canon), more))
    for (script, gender), names in GIVEN.items():
        pick = F.get(F.array(*map(F.lit, names)), (wide(F.lit(0)) % len(names)).cast("int"))
        second = F.when(attempt > 0, F.concat(F.lit("-"), surname(script, F.lit(2)))).otherwise("")
        out = out.when(kind == f"given_{script}_{gender}", F.concat(pick, second))
    for script in SURNAMES:
        out = out.when(kind == f"surname_{script}", surname(script, F.lit(0)))
    return out


def _luhn(digits: Column) -> Column:
    """Sum modulo 10 of the digits, every second from the right doubled; 0 if the check digit is right."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def surrogates(entities: DataFrame, key: str, most_attempts: int = 40) -> DataFrame:
    """(entity, surrogate) of distinct entities ("kind|canonical form"): of one kind no two are equal, and none is a real entity's.

    Kinds that differ by gender only count as one. An empty table gives no rows. Each draw beyond PLAIN_DRAWS widens the format ten times,
    so most_attempts draws are enough for any table; raises if they are not.
    """
    split = entities.select("entity", F.substring_index("entity", "|", 1).alias("kind"))
    every = C.cut(split.select("*", F.regexp_replace("kind", "_[mfn]$", "").alias("base"), F.expr("substring(entity, length(kind) + 2)").alias("canon")))
    real, done, missing = every.select("base", F.col("canon").alias("s")), None, every.count()
    for attempt in range(most_attempts):
        left = every if done is None else every.join(done.select("entity"), "entity", "left_anti")
        free = left.withColumn("surrogate", _draw(F.col("kind"), F.col("canon"), key, F.lit(attempt))).withColumn("s", F.lower("surrogate"))
        for x in [real] if done is None else [real, done]:
            free = free.join(x.select("base", "s"), ["base", "s"], "left_anti")
        new = C.cut(free.groupBy("base", "s").agg(F.min(F.struct("entity", "surrogate")).alias("x")).select("base", "s", "x.entity", "x.surrogate"))
        done = new if done is None else done.unionByName(new)
        missing -= new.count()
        if not missing:
            return done.select("entity", "surrogate")
    raise RuntimeError(f"{missing} entities are without a surrogate after {most_attempts} draws")


def _lay_out(x: Column, found: Column) -> Column:
    """The surrogate of a hit (v, kind, canon, mapped), laid out as v is: with its separators and capitals; null for a word that is no name of the text."""
    value, kind, canon, mapped = x["v"], x["kind"], x["canon"], x["mapped"]
    title, _, given, surname = _name_parts(value)
    name = F.concat(title, F.when(given != "", F.concat(F.element_at(found, _given(given)), F.lit(" "))).otherwise(""), F.element_at(found, _surname(surname)))
    word = F.coalesce(F.element_at(found, _surname(value)), F.element_at(found, _given(value)))
    loose = kind.isin("phone", "card", "ssn", "iban")
    longer = F.length(mapped) - F.length(canon)
    before = F.when(kind == "email", longer).otherwise(0)

    def one(c: Column, i: Column) -> Column:
        at = F.when(loose, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), _LOOSE, ""))).otherwise(i + 1)
        x = F.substring(mapped, at + before, F.lit(1))
        return F.when(loose & c.rlike(_LOOSE), c).when(c.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x)

    chars = F.concat(F.substring(mapped, F.lit(1), before), F.array_join(F.transform(F.split(value, ""), one), ""), F.substring(mapped, F.length(canon) + before + 1, longer - before))
    street = F.array_join(F.zip_with(F.split(value, " "), F.split(mapped, " "), lambda v, m: F.when(v.rlike(r"^\p{Lu}"), F.initcap(m)).otherwise(m)), " ")
    return F.when(kind == "name", name).when(kind == "word", word).when(kind == "street", street).when(kind.isin("ip", "birth"), mapped).otherwise(chars)


def _names(hits: Column) -> Column:
    """The words of the names among the hits, longest first."""
    names = F.transform(F.filter(hits, _is_name), lambda v: F.split(F.regexp_replace(v, f"^{_TITLE}", ""), " "))
    words = F.filter(F.array_distinct(F.flatten(names)), lambda w: F.length(w) > 1)
    return F.reverse(F.sort_array(words))


def replace(docs: DataFrame, key: str = "quire", counts: bool = True) -> DataFrame:
    """docs with personal data in text replaced; n_chars, if there, follows the text.

    With counts, n_entities (places replaced) follows, named n_entities_1 and so on where docs has that column. Null text stays null,
    text without personal data stays as it is; of long texts all is read. Equal texts get equal results, so repeated rows and ids do.
    An empty table gives no rows.
    """
    rows = C.packed(docs, F.col("text").alias("t"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    first = rows.where(_suspect(F.col("t"))).select("t", "a", "b", F.regexp_extract_all("t", F.lit(ALL), F.lit(0)).alias("h")).where(F.size("h") > 0)
    alone = F.concat(F.lit(ALL + r"|(?<![\p{L}\p{N}'’-])(?:"), F.array_join("names", "|"), F.lit(r")(?![\p{L}\p{M}\p{N}'’-])"))
    some = first.withColumn("names", _names(F.col("h"))).withColumn("pattern", F.when(F.size("names") > 0, alone))
    hits = F.when(F.col("pattern").isNull(), F.col("h")).otherwise(F.call_function("regexp_extract_all", F.col("t"), F.col("pattern"), F.lit(0)))
    # once for equal texts
    texts = some.select("a", "b", "pattern", F.transform(hits, lambda v: F.struct(v.alias("v"), _kind(v).alias("kind"))).alias("hits")).dropDuplicates(["a", "b"])
    texts = C.cut(texts.withColumn("hits", F.transform("hits", lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), _canon(x["kind"], x["v"]).alias("canon")))))
    values = texts.select("a", "b", F.explode(F.array_distinct("hits")).alias("x"))
    values = C.cut(values.select("a", "b", F.inline(_keys(F.col("x.v"), F.col("x.kind"), F.col("x.canon")))).distinct())
    # one gender for each given name
    seen = lambda g: F.max(F.when(F.col("gender") == g, 1).otherwise(0)) == 1
    told = values.groupBy("entity").agg(F.max("gender").alias("any"), seen("m").alias("m"), seen("f").alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n")
    full = F.when(F.col("any").isNull(), F.col("entity")).otherwise(F.concat(F.substring_index("entity", "|", 1), F.lit("_"), gender, F.lit("|"), F.expr("substring(entity, instr(entity, '|') + 1)")))
    told = C.cut(told.select("entity", full.alias("full")))
    mapping = told.join(surrogates(told.select(F.col("full").alias("entity")), key).withColumnRenamed("entity", "full"), "full").select("entity", "surrogate")
    found = values.select("a", "b", "entity").distinct().join(mapping, "entity").groupBy("a", "b").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("found"))
    mapped = lambda x: F.element_at(F.col("found"), F.concat(x["kind"], F.lit("|"), x["canon"]))
    placed = texts.join(found, ["a", "b"]).withColumn("hits", F.transform("hits", lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), x["canon"].alias("canon"), mapped(x).alias("mapped"))))
    placed = C.cut(placed.select("a", "b", "pattern", F.transform("hits", lambda x: F.coalesce(_lay_out(x, F.col("found")), x["v"])).alias("placed")))
    both = rows.join(C.small_side(placed, 20_000), ["a", "b"], "left")
    gaps = F.when(F.col("pattern").isNull(), F.split("t", ALL, -1)).otherwise(F.call_function("split", F.col("t"), F.col("pattern"), F.lit(-1)))
    joined = F.array_join(F.zip_with(gaps, F.col("placed"), lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
    text = F.when(F.col("placed").isNull(), F.col("t")).otherwise(joined)
    return C.unpacked(both, docs, text, {"n_entities": F.coalesce(F.size("placed"), F.lit(0)).cast("long")} if counts else {})
