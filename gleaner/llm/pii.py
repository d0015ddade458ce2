r"""PII surrogates: every detected entity gets a keyed replacement of its own kind.

Only DataFrame functions are used.  Detection is one regular expression with a group
for each kind: e-mail, secret, IBAN, IP address, phone, social security number, card,
and the given and family names that follow a form of address.  The same entity always
gets the same replacement, in every document, and written forms of one number ("+1
(386) 555-3733", "+13865553733") count as one entity.

A replacement comes from a keyed hash of the kind, the entity and an attempt number:
letters become letters, digits digits, separators and case stay, cards keep a valid
check digit, names keep script and gender.  The register of distinct entities checks
for collisions: where two entities of a kind share a replacement, or it equals an
entity that occurs, all but one go to their next attempt until none is left.

Null and blank texts stay as they are, and texts without an entity are never shuffled.
Very long texts are read whole.  Repeated rows get equal results, an empty table gives
an empty one, and all columns are kept; helper columns avoid the names in use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import free_name, let, stored

#: Forms of address by gender, and the names given out, by script and gender.
TITLES_MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Don", "господин", "Господин", "г-н", "κύριος", "Κύριος")
TITLES_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Doña", "госпожа", "Госпожа", "г-жа", "κυρία", "Κυρία")
TITLES_OTHER = ("Dr", "Prof")
GIVEN = {
    ("latin", "m"): ("Adam", "Boris", "Cyril", "David", "Emil", "Felix", "Gavin", "Hugo", "Ivan", "Jonas", "Klaus", "Lucas"),
    ("latin", "f"): ("Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karla", "Laura"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("cyrillic", "f"): ("Алла", "Вера", "Галина", "Дарья", "Елена", "Инна", "Клара", "Лидия"),
    ("greek", "m"): ("Αλέξης", "Γιάννης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία"),
}
FAMILY_SYLLABLES = {
    "latin": ("ba", "den", "for", "gel", "han", "kor", "lin", "mar", "nov", "per", "ros", "stan", "tor", "val", "win", "zel"),
    "cyrillic": ("ба", "вол", "гор", "дан", "зор", "кар", "лес", "мир", "нов", "пет", "рог", "сол", "тар", "фил", "хар", "чер"),
    "greek": ("βα", "γα", "δη", "κα", "λα", "μα", "νι", "πα", "ρο", "σα", "τα", "φα"),
}
FAMILY_ENDINGS = {"latin": ("son", "er"), "cyrillic": ("ов", "ин"), "greek": ("ίδης", "άκης")}
FAMILY_ENDINGS_FEMALE = {"latin": ("son", "er"), "cyrillic": ("ова", "ина"), "greek": ("ίδου", "άκη")}

NAME = r"\p{Lu}[\p{Ll}\p{M}]{1,29}(?:[-'’]\p{Lu}[\p{Ll}\p{M}]{1,29})?(?![\p{L}\p{N}])"


def _after(titles: tuple[str, ...], between: str = "") -> str:
    """A name that follows a form of address; the cheap test for a capital comes first."""
    return rf"(?=\p{{Lu}})(?<=(?<![\p{{L}}\p{{N}}])(?:{'|'.join(titles)})\.?[ \t]{between}){NAME}"


_OTHER_NAME = r"\p{Lu}[\p{L}\p{M}'’-]{1,30}[ \t]"
_FOLLOWED = r"(?=[ \t]\p{Lu}[\p{Ll}\p{M}])"
ALL_TITLES = (*TITLES_MALE, *TITLES_FEMALE, *TITLES_OTHER)
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}(?<!-)",
    "secret": (
        r"(?<=[=:\"' \t])(?=[A-Za-z0-9+/_.-]{8})(?<=(?i:token|password|passwd|pwd|secret|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?)"
        r"[A-Za-z0-9+/_.-]{7,}[A-Za-z0-9+/_-]"
        r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])"
        r"|(?<![A-Za-z0-9])(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"
    ),
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)|(?<!\d)3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)",
    "phone": (
        r"(?<![\p{L}\d])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)"
        r"|(?<![\p{L}\d])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
    ),
    "given_m": _after(TITLES_MALE) + _FOLLOWED,
    "given_f": _after(TITLES_FEMALE) + _FOLLOWED,
    "family_f": _after(TITLES_FEMALE) + "|" + _after(TITLES_FEMALE, _OTHER_NAME),
    "family": _after(ALL_TITLES) + "|" + _after(ALL_TITLES, _OTHER_NAME),
}
NAME_KINDS = ("given_m", "given_f", "family_f", "family")
VALUE_KINDS = tuple(kind for kind in KINDS if kind not in NAME_KINDS)
PLAIN = "|".join(KINDS[kind] for kind in VALUE_KINDS)
WITH_NAMES = PLAIN + "|" + "|".join(f"({KINDS[kind]})" for kind in NAME_KINDS)
#: Cheap tests that every text with an entity, or with a name, passes.
HINT = (
    r"[0-9@]|(?=[tpsaTPSAg])(?:(?i:token|password|passwd|pwd|secret|api[_-]?key)[ \t]{0,3}[=:]"
    r"|AKIA|gh[pousr]_|sk-)"
)
NAME_HINT = (
    rf"(?=[{''.join(sorted({title[0] for title in ALL_TITLES}))}])"
    rf"(?:{'|'.join(ALL_TITLES)})\.?[ \t]\p{{Lu}}"
)
DIGIT_KINDS = ("ssn", "card", "phone")
STREAM = 256


def _kind(value: Column) -> Column:
    """The kind of an entity that is no name, from its form."""
    cases = [F.when(value.contains("@") & value.rlike(f"^(?:{KINDS['email']})$"), F.lit("email"))]
    for kind in ("ip", "ssn", "card", "phone", "iban"):
        cases.append(F.when(value.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind)))
    return F.coalesce(*cases, F.lit("secret"))


def mentions(text: Column) -> Column:
    """``array<struct<kind, value>>`` of the entities in a text, in its order."""

    def plain(value: Column) -> Column:
        return F.struct(_kind(value).alias("kind"), value.alias("value"))

    def named(groups: Column) -> Column:
        def at(i: Column) -> Column:
            value = F.get(groups["all"], i)
            cases = [F.when(F.get(groups[name], i) != "", F.lit(name)) for name in NAME_KINDS]
            kind = F.coalesce(*cases, _kind(value))
            # Latin family names have one form, so "Mrs Smith" and "Mr Smith" share theirs.
            kind = F.when((kind == "family_f") & (_script(value) == "latin"), "family").otherwise(kind)
            return F.struct(kind.alias("kind"), value.alias("value"))

        return F.when(
            F.size(groups["all"]) > 0,
            F.transform(F.sequence(F.lit(0), F.size(groups["all"]) - 1), at),
        )

    groups = F.struct(
        F.regexp_extract_all(text, F.lit(WITH_NAMES), F.lit(0)).alias("all"),
        *(
            F.regexp_extract_all(text, F.lit(WITH_NAMES), F.lit(i)).alias(name)
            for i, name in enumerate(NAME_KINDS, 1)
        ),
    )
    none = F.expr("cast(array() as array<struct<kind:string,value:string>>)")
    found = F.when(text.rlike(NAME_HINT), let(groups, named)).when(
        text.rlike(HINT), F.transform(F.regexp_extract_all(text, F.lit(PLAIN), F.lit(0)), plain)
    )
    return F.coalesce(found, none)


def has_mention(text: Column) -> Column:
    found = F.when(text.rlike(NAME_HINT), text.rlike(WITH_NAMES)).when(
        text.rlike(HINT), text.rlike(PLAIN)
    )
    return F.coalesce(found, F.lit(False))


def _gaps(text: Column) -> Column:
    """The text between the entities; one piece more than there are entities."""
    return F.when(text.rlike(NAME_HINT), F.split(text, WITH_NAMES, -1)).otherwise(
        F.split(text, PLAIN, -1)
    )


def canonical(kind: Column, value: Column) -> Column:
    """What written forms of one entity have in common."""
    return (
        F.when(kind.isin(*DIGIT_KINDS), F.regexp_replace(value, r"\D", ""))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "email", F.lower(value))
        .otherwise(value)
    )


def _keyed(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """``STREAM`` hexadecimal digits that follow from key, kind, entity and attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(STREAM // 64)))


def _number(stream: Column, place: Column | int, digits: int = 4) -> Column:
    """A number from the stream; places wrap around."""
    at = (F.lit(place) if isinstance(place, int) else place) * digits % (STREAM - digits) + 1
    return F.conv(F.substring(stream, at, F.lit(digits)), 16, 10).cast("int")


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*(F.lit(value) for value in values)), number % len(values))


def _restyled(value: Column, stream: Column) -> Column:
    """Each letter becomes a letter of its case, each digit a digit; the rest stays."""

    def char(old: Column, i: Column) -> Column:
        number = _number(stream, i + 1)
        return (
            F.when(old.rlike("[0-9]"), (number % 10).cast("string"))
            .when(old.rlike("[a-z]"), F.char(number % 26 + 97))
            .when(old.rlike("[A-Z]"), F.char(number % 26 + 65))
            .otherwise(old)
        )

    # Split at once: a substring for each place takes time with the square of a long secret.
    return F.array_join(F.transform(F.split(value, ""), char), "")


def _hexadecimal(value: Column, stream: Column) -> Column:
    """Hexadecimal digits for hexadecimal digits."""
    places = F.sequence(F.lit(1), F.char_length(value))
    return F.array_join(
        F.transform(places, lambda i: F.lower(F.hex((_number(stream, i) % 16).cast("long")))), ""
    )


def _luhn(digits: Column) -> Column:
    """The Luhn sum, modulo ten, of a string of digits that ends with its check digit."""

    def part(i: Column) -> Column:
        digit = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    places = F.sequence(F.lit(0), F.char_length(digits) - 1)
    return F.aggregate(F.transform(places, part), F.lit(0), lambda a, b: a + b) % 10


def _card(digits: Column, stream: Column) -> Column:
    """The same issuer digit; the check digit is right if it was right before."""

    def checked(body: Column) -> Column:
        without = F.concat(body, F.lit("0"))
        return F.concat(body, ((10 - _luhn(without)) % 10).cast("string"))

    body = F.concat(
        F.substring(digits, 1, 1),
        _restyled(F.expr("substring(entity, 2, char_length(entity) - 2)"), stream),
    )
    plain = F.concat(F.substring(digits, 1, 1), _restyled(F.expr("substring(entity, 2)"), stream))
    return F.when(_luhn(digits) == 0, let(body, checked)).otherwise(plain)


def _script(value: Column) -> Column:
    return (
        F.when(value.rlike(r"^\p{IsCyrillic}"), F.lit("cyrillic"))
        .when(value.rlike(r"^\p{IsGreek}"), F.lit("greek"))
        .otherwise(F.lit("latin"))
    )


def _given(script: str, gender: str, stream: Column, attempt: Column) -> Column:
    """One name, and one more joined by a hyphen for every attempt after the first."""
    names = GIVEN[script, gender]
    places = F.sequence(F.lit(0), attempt)
    return F.array_join(F.transform(places, lambda i: _pick(names, _number(stream, i))), "-")


def _family(script: str, endings: tuple[str, ...], stream: Column, attempt: Column) -> Column:
    syllables = FAMILY_SYLLABLES[script]
    places = F.sequence(F.lit(0), attempt + 2)
    stem = F.array_join(F.transform(places, lambda i: _pick(syllables, _number(stream, i))), "")
    return F.initcap(F.concat(stem, _pick(endings, _number(stream, 60))))


def _name(kind: Column, entity: Column, stream: Column, attempt: Column) -> Column:
    cases = []
    for script in FAMILY_SYLLABLES:
        here = _script(entity) == script
        for gender in "mf":
            cases.append((here & (kind == f"given_{gender}"), _given(script, gender, stream, attempt)))
        female = _family(script, FAMILY_ENDINGS_FEMALE[script], stream, attempt)
        cases.append((here & (kind == "family_f"), female))
        cases.append((here & (kind == "family"), _family(script, FAMILY_ENDINGS[script], stream, attempt)))
    return F.coalesce(*(F.when(condition, value) for condition, value in cases))


def with_surrogate(entities: DataFrame, key: str) -> DataFrame:
    """``kind, entity, attempt`` -> the same with ``surrogate``."""
    # Bound by let(): the optimizer copies a column into the filters on the surrogate, and
    # there the hashes of the entity would be taken anew for each of its characters.
    stream = _keyed(key, F.col("kind"), F.col("entity"), F.col("attempt"))
    return entities.withColumn("surrogate", let(stream, _surrogate))


def _surrogate(stream: Column) -> Column:
    kind, entity = F.col("kind"), F.col("entity")
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.substring_index(domain, ".", -1)
    octets = [(_number(stream, i) % 256).cast("string") for i in range(4)]
    return (
        F.when(kind == "email", F.concat(
            _restyled(local, stream), F.lit("@"),
            _restyled(F.expr("left(substring_index(entity, '@', -1), char_length(substring_index(entity, '@', -1)) - char_length(substring_index(entity, '.', -1)))"), F.reverse(stream)),
            top,
        ))
        .when((kind == "secret") & entity.rlike("^[0-9a-f]+$"), _hexadecimal(entity, stream))
        .when(kind == "secret", F.concat(
            F.regexp_extract(entity, "^(AKIA|gh[pousr]_|sk-)?", 0),
            _restyled(F.regexp_replace(entity, "^(AKIA|gh[pousr]_|sk-)", ""), stream),
        ))
        .when(kind == "iban", F.concat(F.substring(entity, 1, 2), _restyled(F.expr("substring(entity, 3)"), stream)))
        .when(kind == "ip", F.when(entity.startswith("10."), F.concat_ws(".", F.lit("10"), *octets[1:])).otherwise(F.concat_ws(".", *octets)))
        .when(kind == "card", _card(entity, stream))
        .when(kind == "phone", F.concat(F.substring(entity, 1, 1), _restyled(F.expr("substring(entity, 2)"), stream)))
        .when(kind == "ssn", _restyled(entity, stream))
        .otherwise(_name(kind, entity, stream, F.col("attempt")))
    )


#: Kinds whose replacements must differ from each other, named by the space they share.
def _space(kind: Column) -> Column:
    return F.when(kind.isin("family", "family_f"), F.lit("family")).otherwise(kind)


def register(entities: DataFrame, key: str) -> DataFrame:
    """``kind, entity, surrogate`` for distinct entities, without collisions.

    Each round settles the first entity of every free replacement; the others try
    again.  A replacement is free if no settled entity has it and no entity equals it.
    """
    real = entities.select(_space(F.col("kind")).alias("space"), F.col("entity").alias("surrogate")).distinct()
    waiting = entities.withColumn("attempt", F.lit(0))
    settled: list[DataFrame] = []
    while True:
        tried = with_surrogate(waiting, key).withColumn("space", _space(F.col("kind")))
        taken = reduce(DataFrame.unionByName, [real, *(s.select("space", "surrogate") for s in settled)])
        first = F.min(F.struct("kind", "entity")).alias("first")
        owners = tried.groupBy("space", "surrogate").agg(first).join(taken, ["space", "surrogate"], "left_anti")
        owners = owners.withColumn("owned", F.lit(True))
        judged = stored(
            tried.join(owners, ["space", "surrogate"], "left").select(
                "kind", "entity", "attempt", "space", "surrogate",
                F.coalesce(
                    (F.col("first.kind") == F.col("kind")) & (F.col("first.entity") == F.col("entity")),
                    F.lit(False),
                ).alias("settled"),
            ),
            "pii-register",
        )
        settled.append(judged.where("settled"))
        if judged.where("not settled").isEmpty():
            break
        waiting = judged.where("not settled").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
    return reduce(DataFrame.unionByName, settled).select("kind", "entity", "surrogate")


def _written(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The replacement in the written form of the mention: its separators and its case."""

    def place(i: Column) -> Column:
        old = F.substring(mention, i, F.lit(1))
        slot = F.char_length(F.regexp_replace(F.substring(mention, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        return F.when(old.rlike(r"[\p{L}\p{N}]"), F.substring(surrogate, slot, F.lit(1))).otherwise(old)

    places = F.sequence(F.lit(1), F.char_length(mention))
    spaced = F.array_join(F.transform(places, place), "")

    def cased(i: Column) -> Column:
        new = F.substring(surrogate, i, F.lit(1))
        return F.when(F.substring(mention, i, F.lit(1)).rlike("[A-Z]"), F.upper(new)).otherwise(new)

    same_case = F.array_join(F.transform(places, cased), "")
    return (
        F.when(kind.isin(*DIGIT_KINDS, "iban"), spaced)
        .when((kind == "email") & mention.rlike("[A-Z]"), same_case)
        .otherwise(surrogate)
    )


def anonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same rows and columns, with replacements in place of the entities."""
    row, found = free_name(docs, "row"), free_name(docs, "found")
    column = F.col(f"`{text}`")
    clean = docs.where(~has_mention(column))
    tagged = stored(
        docs.where(has_mention(column))
        .withColumn(row, F.monotonically_increasing_id())
        .withColumn(found, mentions(column)),
        "pii-tagged",
    )
    pairs = tagged.select(F.col(f"`{row}`").alias("row"), F.posexplode(found).alias("place", "mention")).select(
        "row", "place", "mention.kind", "mention.value",
        canonical(F.col("mention.kind"), F.col("mention.value")).alias("entity"),
    )
    known = register(pairs.select("kind", "entity").distinct(), key)
    replaced = (
        pairs.join(known, ["kind", "entity"])
        .select("row", "place", _written(F.col("kind"), F.col("value"), F.col("surrogate")).alias("new"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("place", "new"))).alias("new"))
        .select(F.col("row").alias(row), F.col("new.new").alias(found))
    )
    gaps = _gaps(column)
    joined = F.array_join(
        F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), F.col(f"`{found}`").alias("new")),
                              lambda pair: F.array(F.coalesce(pair["gap"], F.lit("")), F.coalesce(pair["new"], F.lit(""))))),
        "",
    )
    changed = tagged.drop(found).join(replaced, row).withColumn(text, joined)
    names = [F.col(f"`{name}`") for name in docs.columns]
    return clean.select(*names).unionAll(changed.select(*names))
