"""PII surrogates, with DataFrame functions only.

Detected entities (secrets, e-mail addresses, network addresses, payment cards, phone and
social security numbers, account numbers, titled names) are replaced by surrogates drawn
with a secret key from a hash of the entity: of the same type, each character of the same
kind and script, in the same format (cards pass the Luhn check, names keep the title's
gender and the case in which they are written). The same entity gets the same surrogate in every document and in each way to write
it: a card or a phone number by its digits, mail and IPv6 addresses in any case, a person by
surname and given name apart, in any case, whatever the title. Entities of the whole table are checked
for collisions: where two would share a surrogate, or one would equal an entity that occurs,
all but the first draw again, in a wider space from the third time on (from the ninth on for
numbers, which then get digits behind their format, one more each time), until all are
distinct. Names in scripts without syllables here (Georgian and others) get Latin ones.

The key is an argument. Queries take it from the session's ``spark.tallyforge.pii.key``; where
that is unset, a random one is made for the session.

Numbers of card length that fail the Luhn check are not cards and stay. In a longer run of
digits and blanks (a card, its date, its check number), what passes from one group to
another is the card. A mail address ends with the last label of its domain.

Cases: null texts stay null, empty ones empty; texts are read whole; equal rows are
replaced equally; overlapping entities are one, the leftmost; rows that share an id share a
mapping, and rows without one are replaced as others are; no rows give no rows; ``replace_pii``
keeps all other columns, whatever their names (where one is called ``n_entities``, it is kept and
the count is not added).
"""

from __future__ import annotations

import itertools
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise, own_name, released, salted_join, table

#: Types in the order in which they are tried at a place of the text.
PATTERNS = {
    "secret": r"(?<![\p{L}\p{N}])(?:(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|eyJ[\w-]{10,}+\.[\w-]{10,}+\.[\w-]{10,}+)(?![\p{L}\p{N}])|(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}+|gh[pousr]_[A-Za-z0-9]{20,}+)",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=[\p{L}\p{N}.-]*\.[\p{L}\p{N}-]*\p{L}{2})[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{N}]|\.\d)",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,38}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "phone": r"(?<![\p{L}\p{N}])(?:(?=\+(?:[ .()-]{0,2}\d){5})\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|(?:1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[.-])?\d{3}[.-]\d{3}[.-]\d{4}|(?:1 )?[2-9]\d{2} [2-9]\d{2}[ -]\d{4}|1[3-9]\d[ -]\d{4}[ -]\d{4}|(?!\d{1,2}[ /-]\d{1,2}[ /-]\d{4}(?!\d))(?=(?:[() /-]{0,2}\d){9})(?:0\d{1,5}|\(0\d{1,5}\))[ /-]{1,2}\d{2,8}(?:[ -]\d{2,8}){0,4})(?!\p{N})",
    "card": r"(?<![\p{L}\p{N}])(?=\d(?:[ -]?\d){12})\d++(?![\p{L}\p{N}])(?:[ -](?!\d{3}-\d{2}-\d{4}(?!\d)|\d{3}-\d{3}-\d{4}(?!\d)|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d)\d++(?![\p{L}\p{N}]))*+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "name": r"(?<![\p{L}\p{N}])(?:(?:Mrs|Mr|Ms|Miss|Mister|Sir|Madam|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señora|Señor|Sra|Sr|Don|Doña)\.? \p{Lu}\p{Ll}++(?:[ -]\p{Lu}\p{Ll}++)?|(?:MRS|MR|MS|MISS|MISTER|MADAM|DR|PROF|HERR|FRAU|MONSIEUR|MADAME|MME|MLLE|SEÑORA|SEÑOR|SRA)\.? \p{Lu}{2,}+(?:[ -]\p{Lu}{2,}+)?)(?!\p{L})",
}
ANY = "|".join(PATTERNS.values())
#: How a card is written that stands in a longer run of digits: its digits together, or in groups of four to six.
CARD = r"^(?:\d{13,19}|\d{4}(?:[ -]\d{4,6}){1,3}[ -]\d{1,6})$"
#: A text that matches none of these has no entity; it is cheaper to look for.
HINT = r"[@\p{N}]|\b(?:M[Rr]|M[Ss]\b|Miss|MISS|Sir\b|Madam|MADAM|D[Rr]\b|Prof|PROF|Herr|HERR|Frau|FRAU|Monsieur|MONSIEUR|M[Mm][Ee]\b|M[Ll][Ll][Ee]\b|Señor|SEÑOR|S[Rr]|Don\b|Doña|Mister|MISTER)|(?:sk|pk|rk)[-_]|gh[pousr]_|AKIA|eyJ"
FEMALE = r"^(?i:Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Sra|Doña)\b"
MALE = r"^(?i:Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Don)\b"
GIVEN = {
    "f": "Alma Berta Clara Dora Edith Flora Greta Hanna Ida Julia Karla Lena Maria Nora Olga Paula".split(),
    "m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oskar Paul".split(),
    "n": "Alex Robin Kim Sascha Dominique Jamie Luca Marian Nikola Quinn Rene Sam Toni Uli Vale Kai".split(),
}
SYLLABLES = "an bel cor dan el fal gor han il jor kel lan mar nor ol per ran sel tor ul ver wen xan yor zel bri cal dor fen gal hol kin".split()
#: Syllables of names in other scripts, by what tells a name of that script.
SCRIPTS = {
    r"^\p{IsCyrillic}": "ан бел вор дан ел фал гор хан ил йор кел лан мар нор ол пер ран сел тор ул вер зен бри кал дор фен гал хол кин рис мол тан".split(),
    r"^\p{IsGreek}": "αν βελ κορ δαν ελ φαλ γορ χαν ιλ καλ κελ λαν μαρ νορ ολ περ ραν σελ τορ υλ βερ ξεν ζελ βρι θορ δορ φεν γαλ χολ κιν ριμ τασ".split(),
    r"^\p{IsArmenian}": "ան բել կոր դան ել ֆալ գոր հան իլ յոր կել լան մար նոր ոլ պեր ռան սել տոր ուլ վեր զեն բրի կալ դոր ֆեն գալ հոլ կին րիս մոլ տան".split(),
}
#: Stands before digits that a number gets beyond its format.
MORE = "\u0001"
#: Country codes of one and two digits; the others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Letters from which those of the same script and case are drawn.
ALPHABETS = {
    r"[a-z]": "abcdefghijklmnopqrstuvwxyz", r"[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[0-9]": "0123456789", r"[\p{IsLatin}&&\p{Ll}]": "àáâãäåæçèéêëìíîïñòóôõöøùúûüý",
    r"[\p{IsLatin}&&\p{Lu}]": "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", r"[\p{IsCyrillic}&&\p{Ll}]": "абвгдежзиклмнопрстуфхцчшщыэюя", r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЫЭЮЯ",
    r"[\p{IsGreek}&&\p{Ll}]": "αβγδεζηθικλμνξοπρστυφχψω", r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"\p{IsHan}": "一二三四五六七八九十百千万上下大小中人山川田水火木", r"\p{IsHangul}": "가나다라마바사아자차카타파하",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねの", r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
}


def cards(run: Column) -> Column:
    """The places (start, length) of cards in a run of digits: the run, if it passes as one, or else what does from group to group, from the left and as long as can be."""
    digits = lambda v: F.length(F.regexp_replace(v, r"\D", ""))
    size = F.length(run)

    def take(state: Column, at: Column) -> Column:
        starts = (at >= state["next"]) & ((at == 1) | ~run.substr(at - 1, F.lit(1)).rlike(r"\d"))
        fits = lambda n: (at + n - 1 <= size) & ~run.substr(at + n, F.lit(1)).rlike(r"\d") & run.substr(at, n).rlike(CARD) & digits(run.substr(at, n)).between(13, 19) & luhn(run.substr(at, n))
        n = F.when(starts, F.array_max(F.filter(F.sequence(F.lit(13), F.lit(25)), fits)))
        return F.when(n.isNull(), state).otherwise(F.struct((at + n).alias("next"), F.concat(state["found"], F.array(F.struct(at.alias("start"), n.alias("length")))).alias("found")))

    whole = digits(run).between(13, 19) & luhn(run)
    none = F.array().cast("array<struct<start:int,length:int>>")
    parts = F.aggregate(F.sequence(F.lit(1), size), F.struct(F.lit(1).alias("next"), none.alias("found")), take)["found"]
    return F.when(whole, F.array(F.struct(F.lit(1).alias("start"), size.alias("length")))).otherwise(parts)


def card_parts(run: Column) -> Column:
    """A run of digits cut at the cards in it: (kind, value) of each part, no kind between them."""
    part = lambda kind_, value: F.struct(F.lit(kind_).cast("string").alias("kind"), value.alias("value"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<kind:string,value:string>>").alias("parts"))
    add = lambda state, x: F.struct((x["start"] + x["length"]).alias("at"), F.concat(state["parts"], F.array(part(None, run.substr(state["at"], x["start"] - state["at"])), part("card", run.substr(x["start"], x["length"])))).alias("parts"))
    return F.aggregate(cards(run), start, add, lambda state: F.concat(state["parts"], F.array(part(None, run.substr(state["at"], F.length(run))))))


def entity(kind_: Column, value: Column) -> Column:
    """What is the same in all ways to write a thing: digits of cards and phone numbers (with the country, where it is known), folded addresses."""
    digits = F.regexp_replace(value, r"\D", "")
    us = value.rlike(r"^(?:1[ .-]?)?(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|[2-9]\d{2} [2-9]\d{2}[ -]\d{4})$")
    phone = F.when(value.startswith("+"), F.concat(F.lit("+"), digits)).when(us, F.concat(F.lit("+1"), F.right(digits, F.lit(10)))).when(digits.startswith("00"), F.concat(F.lit("+"), F.substring(digits, F.lit(3), F.length(digits)))).otherwise(digits)
    return F.when(kind_ == "phone", phone).when(kind_ == "card", digits).when(kind_.isin("email", "ip6", "surname") | kind_.startswith("given"), F.lower(value)).when(kind_ == "iban", F.replace(value, F.lit(" "), F.lit(""))).otherwise(value)


def formatted(kind_: Column, raw: Column, new: Column) -> Column:
    """A surrogate of an entity in the way in which ``raw`` is written. What stands behind its mark ``MORE`` follows the format."""
    more = F.regexp_replace(new, f"^[^{MORE}]*{MORE}?", "")
    new = F.substring_index(new, MORE, 1)
    slot = F.when(kind_ == "iban", F.lit("[A-Z0-9]")).otherwise(F.lit("[0-9]"))
    rest = F.when(kind_ == "iban", F.lit("[^A-Z0-9]")).otherwise(F.lit("[^0-9]"))
    letters = F.regexp_replace(new, rest, F.lit(""))
    count = lambda v: F.length(F.regexp_replace(v, rest, F.lit("")))
    one = lambda c, i: F.when(F.regexp_like(c, slot), F.substring(letters, F.length(letters) - count(F.substring(raw, i + 1, F.length(raw))) + 1, F.lit(1))).otherwise(c)
    placed = F.array_join(F.transform(F.filter(F.split(raw, ""), lambda c: c != ""), one), "")
    placed = F.when(raw.startswith("00") & (kind_ == "phone"), F.concat(F.lit("00"), F.substring(placed, F.lit(3), F.length(placed)))).otherwise(placed)
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    shown = F.when(kind_.isin("phone", "card", "iban"), placed).when(~kind_.isin("ip", "ssn", "secret") & upper & (F.length(raw) > 1), F.upper(new)).otherwise(new)
    return F.concat(shown, more)


def parts(mentions: DataFrame) -> DataFrame:
    """The parts of each of ``mentions`` (value), in order: (value, pos, kind, raw, entity), no kind where the text stays."""
    kinds = mentions.select("value", kind(F.col("value")).alias("kind")).where("kind is not null")
    value, none = F.col("value"), F.lit(None).cast("string")
    others = kinds.where("kind not in ('card', 'name')").select("value", F.lit(0).alias("pos"), "kind", F.col("value").alias("raw"))
    runs = kinds.where("kind = 'card'").select("value", F.posexplode(card_parts(value)).alias("pos", "part"))
    # a name: title, given name or first half of a surname, blank or hyphen, surname
    title, first, gap, last = (F.regexp_extract(value, r"^(\S+ )(?:(\p{L}+)([ -]))?(\p{L}+)$", i) for i in range(1, 5))
    gender = F.when(value.rlike(FEMALE), "given_f").when(value.rlike(MALE), "given_m").otherwise("given_n")
    part = lambda kind_, raw: F.struct(kind_.alias("kind"), raw.alias("value"))
    names = kinds.where("kind = 'name'").select("value", F.posexplode(F.array(part(none, title), part(F.when(gap == " ", gender).when(gap == "-", "surname"), first), part(none, gap), part(F.lit("surname"), last))).alias("pos", "part"))
    split = runs.unionByName(names).select("value", "pos", F.col("part.kind").alias("kind"), F.col("part.value").alias("raw"))
    return others.unionByName(split).withColumn("entity", entity(F.col("kind"), F.col("raw")))


def kind(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$") , name).otherwise(out)
    return out


def luhn(value: Column) -> Column:
    """Whether a string's digits pass the Luhn check."""
    digits = F.reverse(F.split(F.regexp_replace(value, r"\D", ""), ""))
    numbers = F.filter(F.transform(digits, lambda d: d.try_cast("int")), lambda d: d.isNotNull())
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _noise(key: str, value: Column, attempt: Column) -> Column:
    """512 hexadecimal digits from the key, the entity and the attempt."""
    return F.concat(*(F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit(str(i)), attempt.cast("string"), value), 512) for i in range(4)))


def _number(noise: Column, at: Column | int, digits: int = 6) -> Column:
    start = (at if isinstance(at, Column) else F.lit(at)) % (512 - digits) + 1
    return F.conv(F.substring(noise, start, F.lit(digits)), 16, 10).cast("long")


def _drawn(text: Column, noise: Column) -> Column:
    """Each letter and digit drawn anew, of the same script and case; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for pattern, letters in reversed(ALPHABETS.items()):
            out = F.when(c.rlike(pattern), F.substring(F.lit(letters), (_number(noise, i * 7, 5) % len(letters)).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _words(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def _of(words: Column, number: Column) -> Column:
    return F.element_at(words, (number % F.size(words)).cast("int") + 1)


def surrogate(kind_: Column, value: Column, attempt: Column, noise: Column) -> Column:
    # what is drawn of each type, behind what stays of it: all at once, a mail address in two parts
    begins = F.when(kind_ == "secret", F.regexp_extract(value, "^((?:sk|pk|rk)[-_]|gh[pousr]_|AKIA|eyJ)", 1)).when(kind_ == "phone", F.regexp_extract(value, f"{COUNTRY}|^0*", 0)).when(kind_ == "iban", F.substring(value, 1, 2)).otherwise(F.substring(value, 1, 1))
    rest = F.substring(value, F.length(begins) + 1, F.length(value) - F.length(begins) - F.when(kind_ == "card", 1).otherwise(0))
    drawn = _drawn(F.when(kind_ == "email", F.concat(F.regexp_extract(value, "^(.*)@", 1), F.lit(MORE), F.regexp_extract(value, r"@([^.]*)", 1))).otherwise(rest), noise)
    wider = F.when(attempt > 1, F.concat(F.lit("."), F.substring(noise, 400, 8))).otherwise("")
    email = F.concat(F.substring_index(drawn, MORE, 1), wider, F.lit("@"), F.regexp_replace(F.substring_index(drawn, MORE, -1), "^-|-$", "x"), F.lit("."), _of(_words(["example.com", "example.org", "example.net"]), _number(noise, 300)))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(noise, i * 16) % 254 + 1).cast("string")), ".")
    hexes = F.substring(F.repeat(noise, F.ceil(F.length(value) / 512).cast("int")), F.lit(1), F.length(value))
    one = lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(noise, i + 1, F.lit(1))).when(c.rlike("[A-F]"), F.upper(F.substring(noise, i + 1, F.lit(1)))).otherwise(c)
    ip6 = F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")
    secret = F.when(value.rlike("^[0-9a-f]+$"), hexes).when(value.rlike("^[0-9A-F]+$"), F.upper(hexes)).otherwise(F.concat(begins, drawn))
    phone, iban, ssn = F.concat(begins, drawn), F.concat(begins, drawn), F.concat(F.lit("9"), drawn)
    # a card: the first digit and the format stay, the last digit makes the check come out
    sums = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(begins, drawn, d.cast("string"))), luhn)
    known = _words(SYLLABLES)
    for script, words in SCRIPTS.items():
        known = F.when(value.rlike(script), _words(words)).otherwise(known)

    def syllables(n: Column, at: int) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _of(known, _number(noise, i * 9 + at))), "")

    surname = F.initcap(syllables(F.when(attempt > 1, F.lit(6)).otherwise(F.lit(3)), 210))
    draw = lambda words: _of(_words(words), _number(noise, 200))
    listed = F.when(kind_ == "given_f", draw(GIVEN["f"])).when(kind_ == "given_m", draw(GIVEN["m"])).otherwise(draw(GIVEN["n"]))
    # too few are listed for a large table: from the second draw on they grow longer
    given = F.when(value.rlike("|".join(SCRIPTS)), F.initcap(syllables(F.when(attempt > 1, F.lit(5)).otherwise(F.lit(2)), 210))).when(attempt == 0, listed).otherwise(F.concat(listed, syllables(F.greatest(F.lit(1), F.least(attempt, F.lit(5))), 210)))
    # numbers of a format that is used up get more digits, one more each time
    digits = F.when(attempt > 7, F.concat(F.lit(MORE), F.array_join(F.transform(F.sequence(F.lit(8), F.greatest(attempt, F.lit(8))), lambda i: (_number(noise, i * 5) % 10).cast("string")), ""))).otherwise("")
    ip, phone, iban, ssn = (F.concat(x, digits) for x in (ip, phone, iban, ssn))
    card = F.concat(sums[0], digits)
    return F.when(kind_ == "email", email).when(kind_ == "ip", ip).when(kind_ == "ip6", ip6).when(kind_ == "secret", secret).when(kind_ == "phone", phone).when(kind_ == "iban", iban).when(kind_ == "ssn", ssn).when(kind_ == "card", card).when(kind_ == "surname", surname).when(kind_.startswith("given"), given)


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """Surrogates of distinct ``entities`` (kind, value): (space, value, surrogate), no two of a space (a kind, or all given names) alike, in any case, and none that is an entity itself."""
    space = F.substring_index("kind", "_", 1).alias("space")
    entities = materialise(entities.select("kind", "value", space))
    originals = entities.select("space", F.lower("value").alias("folded")).distinct()
    pending, done = entities, None
    drawing = surrogate(F.col("kind"), F.col("value"), F.col("attempt"), F.col("noise"))
    for attempt in itertools.count():
        drawn = pending.withColumn("attempt", F.lit(attempt)).withColumn("noise", _noise(key, F.col("value"), F.col("attempt"))).select("kind", "value", "space", drawing.alias("surrogate"))
        drawn = drawn.withColumn("folded", F.lower(F.replace("surrogate", F.lit(MORE), F.lit(""))))
        first = Window.partitionBy("space", "folded").orderBy("value")
        free = drawn.join(originals, ["space", "folded"], "left_anti")
        if done is not None:
            free = free.join(done.select("space", "folded"), ["space", "folded"], "left_anti")
        good = free.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
        before = [x for x in (done, pending) if x is not None and x is not entities]
        done = materialise(good if done is None else done.unionByName(good))
        pending = materialise(entities.join(done.select("space", "value"), ["space", "value"], "left_anti"))
        for x in before:
            released(x)
        if pending.isEmpty():
            released(pending)
            released(entities)
            return done.select("space", "value", "surrogate")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (doc_id, text, and any others) with surrogates in ``text``, and ``n_entities``, the number of those replaced."""
    text = F.col("text")
    columns = docs.columns
    row, whole, found_, new_ = (own_name(columns, x) for x in ("_row", "_map", "_found", "_new"))
    # rows without an id are told apart by their texts
    docs = docs.withColumn(row, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256))))
    found = docs.select(F.col(row).alias("row"), "text").where(text.rlike(HINT)).select("row", F.array_distinct(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("values")).where(F.size("values") > 0)
    occurs = materialise(found.select("row", F.explode("values").alias("value")).distinct())
    written = materialise(parts(occurs.select("value").distinct()))
    # a given name is of the gender of all its titles, of neither if they differ
    whose = F.array_remove(F.collect_set("kind"), "given_n")
    given = written.where("kind like 'given%'").groupBy("entity").agg(F.when(F.size(whose) == 1, whose[0]).otherwise("given_n").alias("kind"))
    entities = written.where("kind is not null and kind not like 'given%'").select("kind", "entity").distinct().unionByName(given.select("kind", "entity")).withColumnRenamed("entity", "value")
    named = mapping(entities, key)
    replaced = named.select("space", F.col("value").alias("entity"), F.col("surrogate").alias("new"))
    piece = F.struct("pos", F.coalesce(formatted(F.col("kind"), F.col("raw"), F.col("new")), "raw").alias("text"))
    counted = F.count(F.when(F.col("kind").isNotNull() & ((F.col("kind") != "surname") | (F.col("pos") == 3)) & ~F.col("kind").startswith("given"), 1))
    joined = written.withColumn("space", F.substring_index("kind", "_", 1)).join(replaced, ["space", "entity"], "left")
    mentions = joined.groupBy("value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "").alias("surrogate"), counted.alias("n")).where("n > 0")
    total = occurs.count()
    often = occurs.groupBy("value").agg(F.count("*").alias("times"))
    pairs = salted_join(occurs, mentions.join(often, "value"), ["value"], "row", total, n="times").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("value", F.struct("surrogate", "n")))).alias(whole))
    pairs = materialise(pairs.withColumnRenamed("row", row))
    for x in (occurs, written, named):
        released(x)
    out = docs.join(pairs.hint("merge"), row, "left").withColumn(found_, F.when(F.col(whole).isNotNull(), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    out = out.withColumn(new_, F.transform(found_, lambda v: F.coalesce(F.try_element_at(F.col(whole), v), F.struct(v.alias("surrogate"), F.lit(0).cast("long").alias("n")))))
    between = F.split("text", ANY, -1)
    woven = F.array_join(F.zip_with(between, F.concat(F.col(new_)["surrogate"], F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    n = F.aggregate(F.col(new_)["n"], F.lit(0).cast("long"), lambda a, b: a + b)
    count = [] if "n_entities" in {c.lower() for c in columns} else [F.when(F.col(found_).isNotNull(), n).otherwise(0).cast("long").alias("n_entities")]
    return out.select(*(F.when(F.col(found_).isNotNull(), woven).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in columns), *count)


_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The session's ``spark.tallyforge.pii.key``; a random one for the application where that is unset."""
    return spark.conf.get("spark.tallyforge.pii.key", None) or _keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return replace_pii(docs, session_key(spark)).withColumn("n_chars", F.length("text").cast("long"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates in place of what is private."""
    return replace_pii(docs, session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
