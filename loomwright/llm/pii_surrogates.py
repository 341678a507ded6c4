"""Surrogates for personal data: entities are replaced by keyed, type-consistent others.

Found are email addresses (of any script), telephone numbers, IPv4 and IPv6 addresses, card numbers (13 to 16 digits that pass Luhn's test), IBANs that pass their check, US social
security numbers, and names after titles or a phrase that introduces one: the whole run of capitalised words, with their apostrophes, hyphens,
inner capitals and initials, up to the next title; a possessive 's stays outside. Where a document names somebody so, each word of the name is replaced wherever else the
document has it capitalised, unless it has the word in small letters too. A surrogate follows from a keyed hash of the entity in its normal form
(coreference: the same entity, the same surrogate, whatever its punctuation), and keeps type and format: digits stay digits in their places, country and area
prefixes stay, card numbers and IBANs pass their tests and keep issuer digit and country, addresses keep their octets' ranges, mail keeps its domain's ending. Names are replaced word by
word, so a surname alone and with a given name get the same surrogate; a word keeps its script (Latin, Cyrillic, Greek; others get Latin names) and the gender that most of its titles in the corpus tell.

Distinctness: all distinct entities of the corpus are one table. Where two of one type get the same surrogate, or a surrogate is itself an entity, all but the
first by key are hashed again with the next round number, until none collides. From the second round on names get a second part that grows by two syllables a round, so no number of them uses up the
lists; addresses and telephone numbers give up more of their prefix in later rounds. Only a corpus that holds nearly all values that a format has at all has no distinct surrogates, and the query fails.
Surrogates are joined back to the texts that hold them.

Cases: null and empty texts have none; entities that overlap count as the first kind found at the leftmost place; repeated rows and null ids are rewritten alike, row by
row; very long texts take time about as their length; an empty table gives no rows; other columns stay, whatever their names. All steps are DataFrame functions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before, between, chars_of, let, materialise, part, text_of, unused
from .secret_scan import located

# Given names by gender and script, of like length of list.
NAMES = {
    ("f", "latin"): ("Alice", "Anna", "Clara", "Diana", "Elena", "Emma", "Grace", "Helen", "Irene", "Julia", "Laura", "Maria", "Nina", "Olivia", "Rosa", "Sophia"),
    ("m", "latin"): ("Adam", "Albert", "Bruno", "Carl", "David", "Edward", "Felix", "Henry", "Jacob", "Leon", "Martin", "Oscar", "Paul", "Robert", "Thomas", "Victor"),
    ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Иван", "Михаил", "Олег", "Павел", "Сергей"),
    ("f", "greek"): ("Αθηνά", "Δάφνη", "Ειρήνη", "Ζωή", "Θάλεια", "Κλειώ", "Μυρτώ", "Χλόη"),
    ("m", "greek"): ("Άγγελος", "Βασίλης", "Γιάννης", "Κώστας", "Λευτέρης", "Νίκος", "Πέτρος", "Στέφανος"),
}
#: Consonants and vowels of the second parts of names.
SOUNDS = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστ", "αειου")}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}
SMALL = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: Titles and phrases that introduce a name, by the gender they tell ("" for none).
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Mme", "Frau", "Sra", "Señora", "[Гг]-жа", "[Гг]оспожа"),
    "m": ("Mr", "Herr", "Sr", "Señor", "Monsieur", "[Гг]-н", "[Гг]осподин"),
    "": ("Dr", "Prof", "[Дд]-р"),
}
PHRASES = ("[Mm]y name is", "[Мм]еня зовут")
KINDS = ("email", "card", "ssn", "ip", "phone", "name", "iban", "ip6")
EMAIL = r"[\p{L}\p{M}\p{N}._%+-]+@[\p{L}\p{M}\p{N}-]+(?:\.[\p{L}\p{M}\p{N}-]+)*\.\p{L}{2,}"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}.+-])[0-9](?:[ -]?[0-9]){12,15}(?![\p{L}\p{N}])"
SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\p{N}]|\.[0-9])"
#: Telephone numbers in groups that end in four digits, after a plus sign with 8 to 15 digits however grouped, or with a slash behind the area code.
GROUPED = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![\p{L}\p{N}])"
ABROAD = r"\+[0-9](?:[ .()/-]{0,2}[0-9]){7,14}(?![\p{L}\p{N}])"
SLASHED = r"0[0-9]{2,4}/[0-9]{4,8}(?![\p{L}\p{N}/])"
PHONE = rf"(?<![\p{{L}}\p{{N}}+])(?:{GROUPED}|{ABROAD}|{SLASHED})"
#: IPv6 addresses: eight groups, or fewer around a double colon; five parts and a digit at least, as code has double colons too.
GROUP = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:{GROUP}(?::{GROUP}){{7}}|{GROUP}(?::{GROUP}){{0,5}}::{GROUP}(?::{GROUP}){{0,5}})(?![\p{{L}}\p{{N}}:])"
TITLE = "(?:" + "|".join(t for some in TITLES.values() for t in some) + r")(?![\p{L}\p{N}])\.?"
#: A capitalised word of a name: Anna, McDonald, O'Brien, Anne-Marie; the letter of an initial.
NAME_WORD = r"\p{Lu}(?:(?:['’](?!s(?!\p{L}))|-)?[\p{L}\p{M}])+"
INITIAL = r"\p{Lu}\.(?: |(?=\p{Lu}))"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{TITLE} |(?:{'|'.join(PHRASES)}) )(?:{TITLE} )*((?:{INITIAL})*(?!{TITLE} ){NAME_WORD}(?: (?:{INITIAL})*(?!{TITLE} ){NAME_WORD})*)"
MENTION = r"(?<![\p{L}\p{N}])" + NAME_WORD
SPAN = "array<struct<start:int,kind:int,end:int,head:int,whole:string>>"
#: Spans that one block holds while those that overlap are taken out.
BLOCK = 64


def luhn(digits: Column) -> Column:
    """Luhn's sum of a digit string, modulo 10."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, 1).cast("int")
    part = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)))
    return F.aggregate(part, F.lit(0), lambda a, x: a + x) % 10


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def mod97(x: Column) -> Column:
    """The number that letters (10 to 35) and digits of x spell, modulo 97."""
    return F.aggregate(chars_of(x), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def is_iban(x: Column) -> Column:
    return let(F.replace(x, F.lit(" "), F.lit("")), lambda n: mod97(F.concat(F.substring(n, 5, 40), F.substring(n, 1, 4))) == 1)


def _apart(spans: Column) -> Column:
    """Of sorted spans those that begin where the last one taken has ended."""
    none = F.array().cast(SPAN)

    def in_block(at: Column, block: Column) -> Column:
        step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(s)).alias("out"))).otherwise(a)
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step)

    def over(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: part(v, b * BLOCK, F.least(b * BLOCK + BLOCK, F.size(v))))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        step = lambda a, block: let(in_block(a["at"], block), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))
        return F.flatten(F.aggregate(blocks, begin, step)["out"])

    return let(spans, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(none))


def entity_of(s: Column) -> Column:
    return F.substring(s["whole"], s["head"] + 1, F.length(s["whole"]))


def _mentions(text: Column, spans: Column) -> Column:
    """Further places of the words of the names among spans; a word that the text also has in small letters is not taken for a name."""
    words = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.filter(F.split(entity_of(s), " "), lambda w: w.rlike(f"^{NAME_WORD}$")))))
    small = lambda w: F.array_intersect(F.transform(w, F.lower), F.array_distinct(F.split(text, r"[^\p{L}\p{M}'’-]+")))
    names = let(words, lambda w: let(small(w), lambda x: F.filter(w, lambda n: ~F.array_contains(x, F.lower(n)))))
    found = let(names, lambda n: F.filter(located(text, MENTION), lambda s: F.array_contains(n, s["whole"])))
    mention = lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("name")).alias("kind"), s["end"].alias("end"), F.lit(0).alias("head"), s["whole"].alias("whole"))
    return F.when(F.size(spans) > 0, F.transform(found, mention)).otherwise(F.array().cast(SPAN))


def entity_spans(text: Column) -> Column:
    """Spans that do not overlap, leftmost first; whole is the matched text, head the length of what stays before the entity proper (a title)."""
    rough = {
        "email": (EMAIL, F.contains(text, F.lit("@"))), "card": (CARD, text.rlike("[0-9][0-9 -]{11,}[0-9]")), "ssn": (SSN, text.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}")),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]")), "phone": (PHONE, text.rlike(r"[0-9]{3,4}[ .-][0-9]{4}|\+[0-9]|[0-9]/[0-9]{4}")), "ip6": (IP6, text.rlike(":[0-9A-Fa-f]{1,4}:")), "name": (NAME, text.rlike(NAME)), "iban": (IBAN, text.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")),
    }

    def of(kind: str) -> Column:
        pattern, guard = rough[kind]
        spans = F.transform(located(text, pattern, 1 if kind == "name" else 0), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), (s["end"] - s["start"] - s["inner"]).alias("head"), s["whole"].alias("whole")))
        if kind == "card":
            spans = F.filter(spans, lambda s: luhn(only_digits(s["whole"])) == 0)
        if kind == "iban":
            spans = F.filter(spans, lambda s: is_iban(s["whole"]))
        if kind == "ip6":
            spans = F.filter(spans, lambda s: s["whole"].rlike("[0-9]") & (F.size(F.split(s["whole"], ":")) >= 5))
        return F.when(guard, spans).otherwise(F.array().cast(SPAN))

    others = F.concat(*(of(kind) for kind in KINDS if kind != "name"))
    return let(of("name"), lambda names: _apart(F.sort_array(F.concat(others, names, _mentions(text, names)))))


def normal(kind: Column, entity: Column) -> Column:
    """What tells entities apart: mail and IPv6 in lower case, numbers by their digits, IBANs without blanks, words of names as they stand."""
    return F.when(kind.isin(0, 7), F.lower(entity)).when(kind.isin(1, 2, 4), only_digits(entity)).when(kind == 6, F.replace(entity, F.lit(" "), F.lit(""))).otherwise(entity)


def _digit(seed: Column, i: Column) -> Column:
    """The i-th (from 0) digit that a 64-digit hexadecimal seed gives; it starts anew beyond 32."""
    return F.conv(F.substring(seed, (i % 32) * 2 + 1, 2), 16, 10).cast("int") % 10


def _number(entity: Column, seed: Column, keep: Column) -> Column:
    """Digits beyond the first ``keep`` replaced, everything else as it stands."""
    chars = F.filter(F.split(entity, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        new = F.when(digit & (a["i"] >= keep), _digit(seed, a["i"]).cast("string")).otherwise(c)
        return F.struct((a["i"] + F.when(digit, 1).otherwise(0)).alias("i"), F.concat(a["out"], new).alias("out"))

    return F.aggregate(chars, start, step)["out"]


def _card(digits: Column, seed: Column) -> Column:
    body = let(_number(digits, seed, F.lit(1)), lambda x: F.substring(x, 1, F.length(x) - 1))
    return let(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))


def _ip(entity: Column, seed: Column, round_: int) -> Column:
    """The first octet stays (it tells private from public ranges), in later rounds of private ranges with one that has more room; the others are drawn anew."""
    octet = lambda i: (F.conv(F.substring(seed, 4 * i + 1, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    first = F.substring_index(entity, ".", 1)
    private = F.substring_index(entity, ".", 2)
    keep_two = private.isin("192.168", "169.254") | private.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])$")
    own = F.concat_ws(".", private, octet(2), octet(3)) if round_ < 8 else F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3))
    return F.when(keep_two, own).otherwise(F.concat_ws(".", first, octet(1), octet(2), octet(3)))


def _ip6(norm: Column, seed: Column) -> Column:
    """The first group stays (it tells the kind of address), all other hexadecimal digits are drawn anew in their places."""
    first = F.substring_index(norm, ":", 1)
    drawn = lambda c, i: F.when(c == ":", c).otherwise(F.substring(F.lit("0123456789abcdef"), _code(seed, i) % 16 + 1, 1))
    return F.concat(first, F.array_join(F.transform(chars_of(F.substring(norm, F.length(first) + 1, F.length(norm))), drawn), ""))


def _code(seed: Column, i: Column) -> Column:
    return F.conv(F.substring(seed, (i % 32) * 2 + 1, 2), 16, 10).cast("int")


def _letters(part_: Column, seed: Column) -> Column:
    """Letters and digits of a mail's name replaced one by one within their script, separators kept."""

    def new(c: Column, i: Column) -> Column:
        drawn = lambda script: F.substring(F.lit(SMALL[script]), _code(seed, i) % len(SMALL[script]) + 1, 1)
        out = F.when(c.rlike(r"\p{N}"), (_code(seed, i) % 10).cast("string"))
        for script, pattern in SCRIPTS.items():
            out = out.when(c.rlike(pattern), drawn(script))
        return out.when(c.rlike(r"\p{L}"), drawn("latin")).otherwise(c)

    return F.array_join(F.transform(chars_of(part_), new), "")


def _email(normal_form: Column, seed: Column) -> Column:
    """A new name of the same shape (and a tail where it is short), at a reserved domain that ends like the old one's top."""
    return F.concat(_letters(F.substring_index(normal_form, "@", 1), seed), F.lit("."), F.substring(seed, 57, 6), F.lit("@example."), F.when(F.substring_index(normal_form, ".", -1).isin("com", "net", "org"), F.substring_index(normal_form, ".", -1)).otherwise("com"))


def _iban(norm: Column, seed: Column) -> Column:
    """Country kept, letters and digits drawn anew in their places, check digits that fit."""
    new = lambda c, i: F.when(c.rlike("[0-9]"), (_code(seed, i) % 10).cast("string")).otherwise(F.substring(F.lit(SMALL["latin"].upper()), _code(seed, i) % 26 + 1, 1))
    body, country = F.array_join(F.transform(chars_of(F.substring(norm, 5, 40)), new), ""), F.substring(norm, 1, 2)
    return let(body, lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))


def script_of(word: Column) -> Column:
    out = F.lit("latin")
    for script, pattern in SCRIPTS.items():
        out = F.when(word.rlike(pattern), script).otherwise(out)
    return out


def _name(word: Column, gender: Column, seed: Column, round_: int) -> Column:
    """A word of the same gender and script. Lists are short, so further rounds add a second part, longer each time."""
    number = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("\x1f", seed, F.lit(str(i))), 256), 1, 8), 16, 10).cast("long")
    script, out = script_of(word), F.lit(None).cast("string")
    for (g, of), names in NAMES.items():
        out = F.when((gender == g) & (script == of), F.get(F.array(*map(F.lit, names)), (number(0) % len(names)).cast("int"))).otherwise(out)
    if not round_:
        return out
    more = F.lit(None).cast("string")
    for of, (consonants, vowels) in SOUNDS.items():
        sound = lambda i, letters: F.substring(F.lit(letters), (number(i) % len(letters) + 1).cast("int"), 1)  # noqa: B023, E731
        tail = F.concat(*(sound(i, vowels if i % 2 == 0 else consonants.upper() if i == 1 else consonants) for i in range(1, 4 * round_ + 3)))
        more = F.when(script == of, tail).otherwise(more)
    return F.concat(out, F.lit("-"), more)


def told_gender(head: Column, gender: str) -> Column:
    return head.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(TITLES[gender]) + r")(?![\p{L}\p{N}])")


def gender_of(women: Column, men: Column, word: Column, seed: Column) -> Column:
    """What most titles before the word tell (women and men count them), else the lists, else a hash."""
    listed = lambda g: word.isin(*(n for (x, _), names in NAMES.items() if x == g for n in names))
    return F.when(women > men, "f").when(men > women, "m").when(listed("f"), "f").when(listed("m"), "m").when(F.substring(seed, 64, 1) < "8", "f").otherwise("m")


def surrogate(kind: Column, norm: Column, gender: Column, seed: Column, round_: int) -> Column:
    """In normal form: numbers as digits alone."""
    return (F.when(kind == 0, _email(norm, seed)).when(kind == 1, _card(norm, seed)).when(kind == 2, _number(norm, seed, F.lit(0)))
            .when(kind == 3, _ip(norm, seed, round_)).when(kind == 4, _number(norm, seed, F.greatest(F.length(norm) - 7 - max(0, round_ - 8), F.lit(0)))).when(kind == 6, _iban(norm, seed)).when(kind == 7, _ip6(norm, seed)).otherwise(_name(norm, gender, seed, round_)))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities: kind, norm, gender (null but for names), distinct by kind and norm. Adds new, distinct within a kind and no entity itself."""
    settled = None
    open_ = entities
    taken = entities.select("kind", F.col("norm").alias("new"))
    for number in range(64):
        seed = F.sha2(F.concat_ws("\x1f", F.lit(key), F.col("kind").cast("string"), F.col("norm"), F.lit(str(number))), 256)
        drawn = open_.withColumn("new", surrogate(F.col("kind"), F.col("norm"), F.col("gender"), seed, number))
        first = drawn.groupBy("kind", "new").agg(F.min("norm").alias("first"))
        free = first.join(taken, ["kind", "new"], "left_anti")
        drawn = materialise(drawn.join(free, ["kind", "new"], "left").withColumn("ok", F.coalesce(F.col("norm") == F.col("first"), F.lit(False))).drop("first"))
        good = drawn.where("ok").select("kind", "norm", "new")
        settled = good if settled is None else settled.unionByName(good)
        open_ = drawn.where("not ok").select("kind", "norm", "gender")
        if open_.isEmpty():
            return settled
        taken = taken.unionByName(good.select("kind", "new"))
    raise ValueError("surrogates still collide after 64 rounds")


def in_format(kind: Column, entity: Column, new: Column) -> Column:
    """A surrogate in normal form, put into the entity's own punctuation."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        own = c.rlike("[0-9]") | ((kind == 6) & (c != " "))
        return F.struct((a["i"] + F.when(own, 1).otherwise(0)).alias("i"), F.concat(a["out"], F.when(own, F.substring(new, a["i"] + 1, 1)).otherwise(c)).alias("out"))

    return F.when(kind.isin(1, 2, 4, 6), F.aggregate(chars_of(entity), start, step)["out"]).otherwise(new)


def replace_pii(docs: DataFrame, key: str, count: str = "__n_entities", new_text: str = "__new_text") -> DataFrame:
    """Adds the number of entities and the new text under the given names (columns that have them already give way) to docs, which needs text. Rows without entities are not shuffled."""
    docs = docs.drop(count, new_text)
    row_id, spans, news = unused(docs, "__row", "__spans", "__news")
    marked = materialise(docs.withColumn(row_id, F.monotonically_increasing_id()).withColumn(spans, entity_spans(text_of())))
    plain = marked.where(F.size(spans) == 0).withColumn(count, F.lit(0)).withColumn(new_text, F.col("text"))
    rows = marked.where(F.size(spans) > 0)
    name = KINDS.index("name")
    pieces = rows.select(F.col(row_id).alias("row"), F.posexplode(spans).alias("pos", "s"))
    words = F.when(F.col("s.kind") == name, F.split(entity_of(F.col("s")), " ")).otherwise(F.array(entity_of(F.col("s"))))
    found = pieces.select("row", "pos", F.col("s.kind").alias("kind"), F.substring("s.whole", F.lit(1), F.col("s.head")).alias("head"), F.posexplode(words).alias("k", "entity"))
    found = materialise(found.withColumn("norm", normal(F.col("kind"), F.col("entity"))))
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), F.col("norm")), 256)
    titled = lambda g: F.count_if(told_gender(F.col("head"), g)).alias(g)
    entities = found.groupBy("kind", "norm").agg(titled("f"), titled("m"))
    entities = materialise(entities.select("kind", "norm", F.when(F.col("kind") == name, gender_of(F.col("f"), F.col("m"), F.col("norm"), seed)).alias("gender")))
    named = found.join(surrogates(entities, key), ["kind", "norm"]).select("row", "pos", "k", in_format(F.col("kind"), F.col("entity"), F.col("new")).alias("new"))
    # A name's words, then a text's own entities, come together again; they are no more than the text holds.
    together = lambda place: F.transform(F.sort_array(F.collect_list(F.struct(place, "new"))), lambda x: x["new"])
    each = named.groupBy("row", "pos").agg(F.array_join(together("k"), " ").alias("new"))
    back = each.groupBy("row").agg(together("pos").alias(news)).withColumnRenamed("row", row_id)

    def stitched(chars: Column, to: Column) -> Column:
        own = F.col(spans)
        kept = F.transform(own, lambda s, i: F.concat(between(chars, F.get(to, i), s["start"] + s["head"]), F.get(F.col(news), i)))
        return F.concat(F.array_join(kept, ""), between(chars, F.element_at(own, -1)["end"], F.size(chars)))

    ends = before(F.transform(spans, lambda s: s["end"]), F.greatest)
    changed = rows.join(back, row_id).withColumn(count, F.size(spans)).withColumn(new_text, let(chars_of(F.col("text")), lambda chars: let(ends, lambda to: stitched(chars, to)))).drop(news)
    return plain.unionByName(changed).drop(row_id, spans)
