"""Personal data replaced by keyed surrogates of the same type, in DataFrame operations only.

Entities are found by one pattern over whole texts. Every distinct entity gets a surrogate from a keyed hash of
its type and value, so the same value reads the same everywhere (coreference) and nothing leads back without
the key. Surrogates keep length, case, script, punctuation and what a type requires: country codes, top-level
domains, check digits, titles and their gender. A collision check over all entities of the corpus moves every
surrogate that two values share, or that is itself an entity of the corpus, to its next draw. Later draws are
longer (mail gets another domain label from the second draw on, numbers and secrets get digits from the fifth on), so
the check ends however many values share a form.

Defined results: null stays null; a text without entities is unchanged; rows need no id, and repeated rows get
equal replacements. Only the text column is read or changed, and ``n_chars`` if ``count`` names it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyward.session import materialize

# Titles by gender.
MALE = ("Mr", "Herr", "Monsieur", "Sr", "Señor", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Sra", "Srta", "Señora", "г-жа")
NEUTRAL = ("Dr", "Prof")
GIVEN = {
    ("latin", "m"): "Adam Alan Bruno Carl David Emil Felix Hugo Ivan Jonas Karl Leon Marco Noah Oscar Paul".split(),
    ("latin", "f"): "Ada Alma Bella Clara Diana Elena Flora Greta Helen Ida Julia Laura Marta Nina Olga Paula".split(),
    ("latin", "n"): "Alex Andrea Charlie Dominique Eden Kim Jordan Lou Morgan Noel Quinn Robin Sam Sascha Toni Val".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Марк Олег Павел Роман Семён Тимур Юрий".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Ева Жанна Зоя Инна Лидия Майя Нина Ольга Полина Рита Софья Тамара Юлия".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура Тоня Паша Вася Мика Ника Сима Тори Лика Рома Стася Дана".split(),
}
SYLLABLES = {
    "latin": "ba ber do dan el fa gor hal ka len lin mar mo nel per ro sel tan vor wil".split(),
    "cyrillic": "ба вер го дан ел за кор лен лин мар мо нел пер ро сел тан фор хал шин юр".split(),
}
ALPHABETS = {
    "0-9": "0123456789",
    "a-z": "abcdefghijklmnopqrstuvwxyz",
    "A-Z": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "а-яё": "абвгдежзиклмнопрстуфхцчшэюя",
    "А-ЯЁ": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "α-ω": "αβγδεζηθικλμνξοπρστυφχψω",
    "à-öø-ÿß": "àáâäæçèéêëìíîïñòóôöùúûü",
    "À-ÖØ-Þ": "ÀÁÂÄÆÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ",
    r"\p{IsHan}": "安白北本昌大东方光国海和江金林明南平清山天文新中",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてと",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテト",
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",  # of any other script
    r"\p{N}": "0123456789",
}

_WORD = r"\p{Lu}[\p{L}'-]{1,40}"
_TOLD = r"(?=[^\s\"'\p{L}\p{N}]*+[\p{L}\p{N}])"  # a row of asterisks or dashes tells no secret
_TITLES = "|".join([*FEMALE, *MALE, *NEUTRAL])
#: Types in order of precedence. Quantifiers are bounded or possessive, and each type begins with a cheap test of one character,
#: so that a scan stays linear and quick over text without entities. A secret includes the words that reveal it.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}",
    "secret": rf"(?=[Apgst])(?:\bAKIA[0-9A-Z]{{16}}\b|password={_TOLD}[^\s\"']{{4,}}+|token ?= ?\"?{_TOLD}[^\s\"']{{8,}}+"
    r"|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9_-]{20,}+)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?=\d)(?<![\d.+-])(?:(?:\d{4}[ -]){3}\d{1,7}|\d{13,19})(?!\d)",
    "phone": r"(?=[\d+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?|\d{1,4}[ .-])(?:\d{2,4}[ .-]){1,3}\d{2,4}(?!\d)"
    r"|\+\d{8,15}(?!\d)|(?<![\d)])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))",
    "name": rf"(?=[{''.join(sorted({t[0] for t in _TITLES.split('|')}))}])(?<!\p{{L}})(?:{_TITLES})\.? {_WORD}(?: {_WORD})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _may_hold() -> Column:
    """False only for texts without any entity; decided by plain searches."""
    text = F.col("text")
    return F.coalesce(text.rlike("[0-9@]") | text.contains("password=") | text.contains("token") | text.contains("sk-") | text.rlike(PATTERNS["name"]), F.lit(False))


@dataclass(frozen=True)
class SurrogateSettings:
    key: str  # secret; keep it out of the repository


def _draw(stream: Column, i: Column | int) -> Column:
    """The i-th number from 0 to 65535 of a hash stream of 128 hex digits."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(31)) * 4 + 1
    return F.conv(F.substr(stream, at, F.lit(4)), 16, 10).cast("int")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))) + 1)


def _syllable(parts: list[str], stream: Column, i: Column) -> Column:
    return _pick(parts, _draw(stream, i))


def _redrawn(value: Column, stream: Column) -> Column:
    """Every letter and digit replaced by one of its own script and case (of a script without an alphabet here, by
    a Latin one); a hex text stays hex."""
    is_hex = value.rlike("^[0-9a-f]+$") & value.rlike("[0-9]") & value.rlike("[a-f]")

    def one(c: Column, i: Column) -> Column:
        n = _draw(stream, i)
        out = F.when(is_hex, F.substr(F.lit("0123456789abcdef"), F.pmod(n, F.lit(16)) + 1, F.lit(1)))
        for letters, alphabet in ALPHABETS.items():
            drawn = F.substr(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))
            out = out.when(c.rlike(f"[{letters}]"), drawn)
        return out.otherwise(c)

    letters = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substr(value, i, F.lit(1)))
    return F.when(F.length(value) > 0, F.array_join(F.transform(letters, one), "")).otherwise(value)


def _with_check_digit(number: Column) -> Column:
    """The last digit set so that the Luhn sum is a multiple of ten."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    body = F.reverse(F.substr(digits, F.lit(1), F.length(digits) - 1))
    places = F.transform(
        F.sequence(F.lit(1), F.length(body)),
        lambda i: F.substr(body, i, F.lit(1)).cast("int") * (1 + F.pmod(i, F.lit(2))),
    )
    total = F.aggregate(places, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))
    check = F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")
    return F.concat(F.substr(number, F.lit(1), F.length(number) - 1), check)


def _person(value: Column, stream: Column, attempt: Column) -> Column:
    """The same title, then as many names as before, of the title's gender and the name's script."""
    title = F.regexp_extract(value, r"^(\S+) ", 1)
    bare = F.regexp_replace(title, r"\.$", "")
    gender = F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").otherwise("n")
    script = F.when(value.rlike(r" [Ѐ-ӿ]"), "cyrillic").otherwise("latin")
    given = F.lit(None).cast("string")
    for (s, g), names in GIVEN.items():
        given = F.when((script == s) & (gender == g), _pick(names, _draw(stream, 0))).otherwise(given)
    family = F.lit(None).cast("string")
    for s, parts in SYLLABLES.items():
        made = F.transform(
            F.sequence(F.lit(1), F.least(F.lit(3) + attempt, F.lit(12))),
            partial(_syllable, parts, stream),
        )
        family = F.when(script == s, F.initcap(F.array_join(made, ""))).otherwise(family)
    names = F.when(F.size(F.split(value, " ")) > 2, F.concat_ws(" ", given, family)).otherwise(family)
    return F.concat_ws(" ", title, names)


def surrogate(kind: Column, value: Column, attempt: Column, settings: SurrogateSettings) -> Column:
    stem = F.concat_ws("\u0001", F.lit(settings.key), kind, value, attempt.cast("string"))
    stream = F.concat(F.sha2(F.concat(stem, F.lit("0")), 256), F.sha2(F.concat(stem, F.lit("1")), 256))
    host = F.regexp_extract(value, "@(.*)$", 1)
    # what later attempts add, longer each time, so that no value runs out of surrogates
    more = F.reverse(stream)
    label = F.substr(F.translate(more, "0123456789abcdef", "bcdfghklmnprstvz"), F.lit(1), F.least(2 + 2 * attempt, F.lit(40)))
    digits = F.substr(F.translate(more, "abcdef", "012345"), F.lit(1), F.least(2 * (attempt - 3), F.lit(40)))
    longer = F.when(attempt > 3, digits).otherwise("")
    outer = F.regexp_extract(host, r"^(.*)\.[^.]+\.[^.]+$", 1)  # labels before the last two
    mail = F.concat(
        _redrawn(F.substring_index(value, "@", 1), stream),
        F.lit("@"),
        F.when(outer != "", F.concat(_redrawn(outer, F.reverse(stream)), F.lit("."))).otherwise(""),
        F.when(attempt > 0, F.concat(label, F.lit("."))).otherwise(""),
        F.lit("example."),
        F.substring_index(host, ".", -1),
    )
    octet = [F.pmod(_draw(stream, k), F.lit(256)).cast("string") for k in (1, 2, 3)]
    kept = F.when(kind == "secret", F.regexp_extract(value, "^(AKIA|gh[pousr]_|sk-|password=|token ?= ?\"?)", 1)).otherwise(
        F.when(kind == "phone", F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-])|\+\d)", 1)).otherwise(
            F.when(kind == "iban", F.substr(value, F.lit(1), F.lit(2))).otherwise(
                F.when(kind == "card", F.substr(value, F.lit(1), F.lit(1))).otherwise(
                    F.when(kind == "ssn", F.lit("9")).otherwise(F.lit(""))
                )
            )
        )
    )
    rest = F.concat(kept, _redrawn(F.substr(value, F.length(kept) + 1, F.length(value)), stream), longer)
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", F.concat(F.concat_ws(".", F.lit("10"), *octet), longer))
        .when(kind == "card", _with_check_digit(rest))
        .when(kind == "name", _person(value, stream, attempt))
        .otherwise(rest)
    )


def kind_of(value: Column) -> Column:
    """The type of a found entity, by the first pattern that it fits as a whole."""
    out = F.when(value.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for kind in ("iban", "ssn", "ip", "card", "phone", "name"):
        out = out.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("secret")


def found_in(docs: DataFrame) -> DataFrame:
    """Distinct ``text_key`` (hash of the text) and ``value`` of all entities, written once."""
    values = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ANY), 0)))
    return materialize(
        docs.where(_may_hold()).select(F.xxhash64("text").alias("text_key"), values.alias("value")).distinct()
    )


def entities(found: DataFrame, settings: SurrogateSettings) -> DataFrame:
    """Distinct entities of the corpus: ``value``, ``kind``, ``surrogate``, free of collisions."""
    known = materialize(found.select("value").distinct().withColumn("kind", kind_of(F.col("value"))))
    drawn = known.withColumn("attempt", F.lit(0)).withColumn(
        "surrogate", surrogate(F.col("kind"), F.col("value"), F.lit(0), settings)
    )
    drawn = materialize(drawn)
    while True:
        taken = W.partitionBy("surrogate").orderBy("attempt", "value")
        ranked = drawn.withColumn("rank", F.row_number().over(taken)).join(
            known.select(F.col("value").alias("surrogate"), F.lit(True).alias("is_entity")), "surrogate", "left"
        )
        clash = (F.col("rank") > 1) | F.col("is_entity").isNotNull()
        ranked = materialize(ranked.withColumn("clash", clash))
        if ranked.where("clash").isEmpty():
            return ranked.select("value", "kind", "surrogate")
        attempt = F.col("attempt") + F.col("clash").cast("int")
        again = surrogate(F.col("kind"), F.col("value"), attempt, settings)
        drawn = materialize(
            ranked.select(
                "value",
                "kind",
                attempt.alias("attempt"),
                F.when(F.col("clash"), again).otherwise(F.col("surrogate")).alias("surrogate"),
            )
        )


def replace(docs: DataFrame, settings: SurrogateSettings, count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``, plus ``pii_replaced`` (places replaced).

    Texts meet their replacements by text hash: copies share one row of replacements, and a hash collision would
    only add unused entries. Texts that cannot hold an entity skip the shuffle.
    """
    columns = docs.columns
    found = found_in(docs)
    maps = (
        found.join(entities(found, settings).select("value", "surrogate"), "value")
        .groupBy("text_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("_map"))
        .withColumnRenamed("text_key", "_text_key")
    )
    met = docs.where(_may_hold()).withColumn("_text_key", F.xxhash64("text")).join(maps, "_text_key", "left")
    has = F.col("_map").isNotNull()
    parts = met.select(
        *columns,
        "_map",
        F.when(has, F.split("text", ANY, -1)).alias("_pieces"),
        F.when(has, F.regexp_extract_all("text", F.lit(ANY), 0)).alias("_found"),
    )
    written = F.array_join(
        F.transform(
            "_pieces",
            lambda p, i: F.concat(p, F.coalesce(F.element_at("_map", F.get("_found", i)), F.get("_found", i), F.lit(""))),
        ),
        "",
    )
    changed = parts.withColumn("text", F.coalesce(written, "text")).select(
        *columns, F.coalesce(F.size("_found"), F.lit(0)).alias("pii_replaced")
    )
    # size() of a null array is -1 in the legacy mode of Spark
    changed = changed.withColumn("pii_replaced", F.greatest("pii_replaced", F.lit(0)))
    same = docs.where(~_may_hold()).select(*columns, F.lit(0).alias("pii_replaced"))
    out = same.unionByName(changed)
    return out.withColumn(count, F.length("text").cast(docs.schema[count].dataType)) if count else out
