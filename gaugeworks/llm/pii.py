"""Personal data replaced by surrogates.

Method: one pattern finds the entities of a text, and its groups tell their kinds. An entity is one piece, but for a
name, whose title, given names and surnames are pieces of their own. Each piece gets a surrogate drawn by a keyed
digest of its kind and normal form, so that the same piece has the same surrogate in all documents: `Mr Smith`,
`Mr. Smith` and `Mr John Smith` share a surname (coreference). A surrogate has its entity's shape: letters for letters
of the same script and case, digits for digits, separators kept; addresses move to reserved example domains, card
numbers keep their first digit and get a right check digit, names keep title, particles, hyphens, gender and script.
The distinct pieces of the corpus are then checked: where two share a surrogate, or a surrogate is some real piece, all
but one draw again until none collides (distinctness), however many draws that takes. Names come from a larger pool
each time, with one more syllable, and addresses have one more letter from draw GROWS on, so that no corpus has more of
them than there are surrogates; kinds of a fixed number of digits have no more surrogates than their format. All of it
is DataFrame functions. Texts are shuffled only where pieces had to draw again, and documents without such a piece are
then spread evenly.

What counts as a name: one to eight capitalised words after a title (TITLES), or after a given name of GIVEN or MORE_GIVEN
without a title. Of its words the last one, with all that hyphens join to it, is the surname; those before are given
names; particles in lower case stay. A given name's gender is that of its list, else that of the title, else the
digest decides.

Defined results: null texts stay null, empty ones empty; equal texts get equal results; card numbers need a right
check digit, IP addresses bytes of 0 to 255; an empty table gives an empty table; other columns are kept, whatever
their names, unless named `found`, which is replaced. No expression recurses, so long texts need no deep stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import discard, free_name, kept_columns, materialise, stored_alone

#: Titles with the gender they tell, in the scripts of their languages; n tells none.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Signora", "Dona", "г-жа", "госпожа", "Κυρία"),
    "m": ("Mr", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Dom", "г-н", "господин", "Κύριος", "Κύριε"),
    "n": ("Mx", "Dr", "Prof", "Professor", "Doctor", "доктор", "профессор"),
}
#: Given names of surrogates by gender and script; they also begin names without a title.
GIVEN = {
    ("f", "latin"): ("Anna", "Clara", "Elena", "Emma", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia"),
    ("m", "latin"): ("Adam", "Daniel", "Erik", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Viktor"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"),
    ("m", "cyrillic"): ("Антон", "Борис", "Иван", "Лев", "Максим", "Олег", "Павел", "Фёдор"),
    ("f", "greek"): ("Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία"),
    ("m", "greek"): ("Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
}
#: Further given names that begin a name without a title.
MORE_GIVEN = {
    "f": ("Alice", "Barbara", "Carmen", "Catherine", "Elizabeth", "Ingrid", "Jane", "Jennifer", "Karen", "Linda", "Lucía", "Margaret", "María", "Mary", "Olga", "Patricia", "Sarah", "Susan", "Ursula"),
    "m": ("Andrew", "Charles", "David", "Edward", "Fernando", "George", "Hans", "James", "Jean", "John", "José", "Juan", "Klaus", "Michael", "Peter", "Pierre", "Richard", "Robert", "Thomas", "William"),
}
#: Syllables of surrogate names.
SYLLABLES = {
    "latin": ("ba", "del", "fen", "gor", "hal", "ken", "lin", "mar", "nor", "pel", "ros", "sten", "tal", "ver", "wil", "zan"),
    "cyrillic": ("ба", "вел", "гор", "дан", "зор", "кал", "лен", "мир", "нов", "пет", "рос", "сев", "тар", "фед", "хар", "шум"),
    "greek": ("βα", "γορ", "δελ", "ζαν", "θεν", "καλ", "λιν", "μαρ", "νορ", "πελ", "ροσ", "σταν", "ταλ", "φερ", "χαν", "ψιλ"),
}

_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAMES = {g: tuple(dict.fromkeys(n for (h, _), ns in GIVEN.items() if h == g for n in ns)) + MORE_GIVEN[g] for g in "fm"}
_TITLE = rf"(?:{'|'.join(sorted({x for ts in TITLES.values() for t in ts for x in (t, t.upper())}, key=lambda t: (-len(t), t)))})\b\.?"
_FIRST = rf"(?:{'|'.join(sorted(_NAMES['f'] + _NAMES['m'], key=lambda t: (-len(t), t)))})(?![\p{{L}}\p{{M}}])"
#: A capitalised word: McDonald, O'Brien, d'Artagnan, José.
_WORD = r"(?:[dlDL]['’])?+\p{Lu}[\p{L}\p{M}]*+(?:['’]\p{Lu}[\p{L}\p{M}]*+)*+"
_PARTICLE = r"(?:von|van|vom|zu|zum|zur|der|den|dem|de|del|della|di|da|do|dos|das|du|la|le|el|al|bin|ibn|ter|ten|y|e) "
_NEXT = rf"[ -](?:{_PARTICLE}){{0,3}}+{_WORD}"
#: What each kind looks like; possessive repeats, so that no text makes the matcher recurse. A pattern never begins
#: inside a word, number or address.
PATTERNS = {
    "email": r"[\p{L}0-9][\p{L}0-9._%+-]*+@[\p{L}0-9][\p{L}0-9.-]*+",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"{_BYTE}(?:\.{_BYTE}){{3}}(?![0-9]|\.[0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "person": rf"(?=[\p{{Lu}}гдп])(?:{_TITLE} (?:{_PARTICLE}){{0,3}}+{_WORD}(?:{_NEXT}){{0,7}}+|{_FIRST}(?:{_NEXT}){{1,7}}+)",
}
KINDS = tuple(PATTERNS)
PATTERN = rf"(?<![\p{{L}}\p{{M}}0-9._%+@-])(?:{'|'.join(f'({p})' for p in PATTERNS.values())})"
#: The draw from which on addresses are longer than their entities.
GROWS = 4
#: Pieces of one task of the collision check.
TASK_PIECES = 2000

# Private-use characters: around an entity, between its groups, and two that escape them in texts that hold them.
_MARK, _SLOT, _ESCAPE, _IS_MARK, _IS_ESCAPE = (chr(0xE000 + k) for k in range(5))
_PIECE = "struct<kind:string,text:string,form:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- finding -----------------------------------------------------------------------------------------------------


def parts_of(text: Column) -> Column:
    """The text cut at its entities: stretches between them at even places, entities at odd ones, their seven groups
    divided by _SLOT. The pattern runs once."""
    clean = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _IS_ESCAPE)), F.lit(_MARK), F.lit(_ESCAPE + _IS_MARK))
    groups = _SLOT.join(f"${k}" for k in range(1, len(KINDS) + 1))
    return F.split(F.regexp_replace(clean, PATTERN, _MARK + groups + _MARK), _MARK, -1)


def between(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit(_ESCAPE + _IS_MARK), F.lit(_MARK)), F.lit(_ESCAPE + _IS_ESCAPE), F.lit(_ESCAPE))


def digits_of(entity: Column) -> Column:
    return F.regexp_replace(entity, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The weighted sum of a number that lacks its last digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10)).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def check_digit(digits: Column) -> Column:
    return F.pmod(F.lit(10) - _luhn_sum(digits) % 10, F.lit(10)).cast("string")


def normal(text: Column, kind: Column) -> Column:
    """Spellings that mean the same piece."""
    return F.when(kind.isin("phone", "card", "ssn"), digits_of(text)).when(kind == "iban", F.replace(text, F.lit(" "), F.lit(""))).otherwise(F.lower(text))


def _piece(kind: Column, text: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"), F.when(kind.isNotNull(), normal(text, kind)).alias("form"))


def _no_kind() -> Column:
    return F.lit(None).cast("string")


def _spelt(gender: str) -> list[str]:
    return [x for t in TITLES[gender] for x in (t, t.upper())]


def _name_pieces(name: Column) -> Column:
    title = F.regexp_extract(name, f"^{_TITLE} ", 0)
    bare = F.regexp_replace(title, "[. ]+$", "")
    told = F.when(bare.isin(*_spelt("f")), "f").when(bare.isin(*_spelt("m")), "m")
    tokens = F.split(F.substring(name, F.length(title) + 1, F.length(name)), "(?<=[ -])|(?=[ -])")

    def one(t: Column, i: Column) -> Column:
        behind = F.array_position(F.reverse(tokens), " ")  # the last space, counted from the end
        last = F.when(behind > 0, F.size(tokens) - behind).otherwise(-1)
        gender = F.when(t.isin(*_NAMES["f"]), "f").when(t.isin(*_NAMES["m"]), "m")
        gender = F.coalesce(told, gender, F.when(F.crc32(F.lower(t).cast("binary")) % 2 == 0, "f").otherwise("m"))
        kind = F.when(~t.rlike(r"^(?:[dlDL]['’])?\p{Lu}"), _no_kind()).when(i > last, "surname").otherwise(F.concat(F.lit("given_"), gender))
        return _piece(kind, t)

    head = F.when(title != "", F.array(_piece(_no_kind(), title))).otherwise(F.array().cast(f"array<{_PIECE}>"))
    return F.concat(head, F.transform(tokens, one))


def entity_of(part: Column) -> Column:
    return let(F.split(part, _SLOT, -1), lambda slots: let(F.array_join(slots, ""), lambda text: _entity(slots, text)))


def _entity(slots: Column, text: Column) -> Column:
    """Struct (kind, pieces) of an odd part; kind is null for what the pattern finds but no kind holds: card numbers
    whose check digit is wrong, addresses without a top-level domain. The texts of the pieces make up the entity."""
    kind = F.get(F.lit(list(KINDS)), F.array_position(F.transform(slots, lambda s: s != ""), True).cast("int") - 1)
    core = F.regexp_extract(text, r"^[^@]+@[\p{L}0-9.-]*\.\p{L}{2,}", 0)  # a full stop or number may follow an address
    digits = digits_of(text)
    right = F.right(digits, F.lit(1)) == check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1))
    kind = F.when((kind == "card") & ~right, _no_kind()).when((kind == "email") & (core == ""), _no_kind()).otherwise(kind)
    tail = F.substring(text, F.length(core) + 1, F.length(text))
    pieces = F.when(kind == "person", _name_pieces(text)).when(kind == "email", F.array(_piece(kind, core), _piece(_no_kind(), tail))).otherwise(F.array(_piece(kind, text)))
    return F.struct(kind.alias("kind"), pieces.alias("pieces"))


def entities_of(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda p, i: i % 2 == 1), entity_of)


# ---- drawing -----------------------------------------------------------------------------------------------------


def draw(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)


def drawn(digest: Column, at: Column | int, below: int) -> Column:
    """A number from 0 to below - 1 by two bytes of the digest."""
    at = F.lit(at) if isinstance(at, int) else at
    return (F.conv(F.substring(digest, (at % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int") % below).cast("int")


def pick(digest: Column, at: int, values: tuple[str, ...]) -> Column:
    return F.element_at(F.lit(list(values)), drawn(digest, at, len(values)) + 1)


def shaped(entity: Column, digest: Column) -> Column:
    """Letters for letters of the same script and case, digits for digits, all else kept."""

    def one(c: Column, i: Column) -> Column:
        ranges = ((r"[0-9]", "0", 10), (r"[\p{IsLatin}&&[^\p{Lu}]]", "a", 26), (r"[\p{IsLatin}&&\p{Lu}]", "A", 26), ("[а-яё]", "а", 32), ("[А-ЯЁ]", "А", 32), ("[α-ω]", "α", 25), ("[Α-Ω]", "Α", 17))
        out = F.when(F.lit(False), c)
        for regex, first, n in ranges:
            letters = "".join(chr(ord(first) + k) for k in range(n))
            out = out.when(c.rlike(regex), F.substring(F.lit(letters), drawn(digest, i, n) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def respelt(entity: Column, digits: Column) -> Column:
    """The entity with other digits in the places of its own."""
    place = lambda i: F.length(digits_of(F.substring(entity, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")


def _name(text: Column, kind: Column, digest: Column, salt: Column) -> Column:
    """A surname or given name in the script of text; in capitals if text is."""
    script = lambda part: F.when(text.rlike(r"\p{IsCyrillic}"), part("cyrillic")).when(text.rlike(r"\p{IsGreek}"), part("greek")).otherwise(part("latin"))
    syllable = lambda s: lambda k: F.element_at(F.lit(list(SYLLABLES[s])), drawn(digest, k, len(SYLLABLES[s])) + 1)
    made = lambda n: lambda s: F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), syllable(s)), ""))
    listed = lambda g: F.when(salt == 0, script(lambda s: pick(digest, 0, GIVEN[g, s]))).otherwise(script(made(salt + 1)))
    out = F.when(kind == "surname", script(made(salt + 3))).when(kind == "given_f", listed("f")).otherwise(listed("m"))
    return F.when((F.length(text) > 1) & (text == F.upper(text)), F.upper(out)).otherwise(out)


def _email(text: Column, digest: Column, salt: Column, key: str) -> Column:
    label = F.substring_index(F.substring_index(text, "@", -1), ".", 1)
    more = F.repeat(F.lit("a"), F.greatest(salt - GROWS + 1, F.lit(0)))
    domain = draw(key, F.lit("domain"), F.lower(F.substring_index(text, "@", -1)), salt.cast("string"))
    return let(domain, lambda d: F.concat(shaped(F.concat(F.substring_index(text, "@", 1), more), digest), F.lit("@"), shaped(label, d), F.lit(".example."), pick(d, 31, ("com", "net", "org"))))


def _phone(text: Column, digits: Column, other: Column, digest: Column) -> Column:
    """A number's country code stays; the number after it begins with 2 to 9."""
    code = F.when(text.startswith("+"), F.length(F.regexp_extract(text, r"^\+([0-9]{1,3})(?![0-9])", 1))).otherwise(F.lit(0))
    first = (drawn(digest, 31, 8) + 2).cast("string")
    new = F.concat(F.substring(digits, F.lit(1), code), first, F.substring(other, code + 2, F.length(digits)))
    return let(new, lambda d: respelt(text, d))


def _number(text: Column, kind: Column, digest: Column) -> Column:
    def of(digits: Column, other: Column) -> Column:
        body = F.concat(F.substring(digits, 1, 1), F.substring(other, F.lit(2), F.length(digits) - 2))
        card = let(body, lambda b: let(F.concat(b, check_digit(b)), lambda d: respelt(text, d)))
        return F.when(kind == "phone", _phone(text, digits, other, digest)).when(kind == "card", card).otherwise(respelt(text, other))

    other = lambda digits: F.array_join(F.transform(F.split(digits, ""), lambda c, i: drawn(digest, i, 10).cast("string")), "")
    return let(digits_of(text), lambda digits: let(other(digits), lambda o: of(digits, o)))


def surrogate(text: Column, kind: Column, salt: Column, key: str) -> Column:
    """What stands for a piece at its draw number `salt`."""

    def of(digest: Column) -> Column:
        ip = F.concat_ws(".", *((drawn(digest, k, 254) + 1).cast("string") for k in range(4)))
        iban = F.concat(F.substring(text, 1, 2), shaped(F.substring(text, F.lit(3), F.length(text)), digest))
        out = F.when(kind == "email", _email(text, digest, salt, key)).when(kind.isin("phone", "ssn", "card"), _number(text, kind, digest))
        return out.when(kind == "ip", ip).when(kind == "iban", iban).otherwise(_name(text, kind, digest, salt))

    return let(draw(key, kind, normal(text, kind), salt.cast("string")), of)


def redrawn(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(kind, form, salt) of the pieces of the corpus whose first draw collided: salt is the draw that didn't."""
    pieces = F.flatten(F.transform(entities_of(parts_of(F.col(column))), lambda e: e.pieces))
    found = df.where(F.col(column).isNotNull()).select(F.explode(pieces).alias("p")).select("p.*").where("kind is not null")
    known = materialise(found.groupBy("kind", "form").agg(F.min("text").alias("text")), "pieces")
    tasks = known.count() // TASK_PIECES + 1
    real = known.select("kind", F.col("form").alias("drawn"), F.lit(True).alias("real"))
    again = normal(surrogate(F.col("text"), F.col("kind"), F.col("salt"), key), F.col("kind"))
    state = known.repartition(tasks).withColumn("salt", F.lit(0))
    state = materialise(state.withColumn("drawn", again), "draws")
    while True:
        taken = state.groupBy("kind", "drawn").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("salt", "form")).alias("keeper"))
        clash = taken.join(real, ["kind", "drawn"], "left").where((F.col("n") > 1) | F.col("real")).select("kind", "drawn", "keeper", F.coalesce("real", F.lit(False)).alias("real"))
        clash = materialise(clash, "clashes")
        if clash.isEmpty():
            return state.where("salt > 0").select("kind", "form", "salt")
        loses = F.col("keeper").isNotNull() & (F.col("real") | (F.struct("salt", "form") != F.col("keeper")))
        next_draw = state.join(clash, ["kind", "drawn"], "left").withColumn("_loses", F.coalesce(loses, F.lit(False)))
        next_draw = next_draw.withColumn("salt", F.col("salt") + F.col("_loses").cast("int"))
        old, next_draw = state, next_draw.withColumn("drawn", F.when(F.col("_loses"), again).otherwise(F.col("drawn")))
        state = materialise(next_draw.select("kind", "form", "text", "salt", "drawn"), "draws")
        discard(old, clash)


def replace_pii(df: DataFrame, key: str, column: str = "text", found: str = "found") -> DataFrame:
    """df with each entity of the text replaced, and `found`: kind and surrogate of each, in order."""
    df = df.drop(found)
    salts = stored_alone(lambda: redrawn(df, key, column), "salts")
    own = {n: free_name(df, n) for n in ("parts", "entities", "salts", "place", "swapped", "text_key")}
    parts, entities, salt_map, place, swapped, text_key = map(F.col, own.values())
    rows = df.withColumn(own["parts"], parts_of(F.col(column))).withColumn(own["entities"], F.when(F.size(parts) > 1, entities_of(parts)))
    none = F.lit(None).cast("map<string,int>")
    if salts.isEmpty():
        rows = rows.withColumn(own["salts"], none)
    else:
        # texts without an entity match nothing and are dealt by their places, so that no key holds them all
        rows = rows.withColumn(own["place"], F.when(entities.isNull(), F.monotonically_increasing_id()).otherwise(-1)).withColumn(own["text_key"], F.xxhash64(column))
        asked = rows.where(entities.isNotNull()).select(text_key.alias("k"), F.explode(F.flatten(F.transform(entities, lambda e: e.pieces))).alias("p")).select("k", "p.kind", "p.form").where("kind is not null").distinct()
        maps = asked.join(salts, ["kind", "form"]).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "form"), "salt"))).alias(own["salts"]))
        maps = maps.select(F.col("k").alias(own["text_key"]), F.lit(-1).cast("bigint").alias(own["place"]), own["salts"])
        rows = rows.join(maps, [own["place"], own["text_key"]], "left")

    def replaced(p: Column) -> Column:
        salt = F.coalesce(F.element_at(salt_map, F.concat_ws("|", p.kind, p.form)), F.lit(0))
        return F.when(p.kind.isNull(), p.text).otherwise(surrogate(p.text, p.kind, salt, key))

    done = F.transform(entities, lambda e: F.struct(e.kind.alias("kind"), F.transform(e.pieces, replaced).alias("new"), F.transform(e.pieces, lambda p: p.kind).alias("kinds")))
    rows = rows.withColumn(own["swapped"], done)
    gaps = F.transform(F.filter(parts, lambda p, i: i % 2 == 0), between)
    text = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.zip_with(swapped, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda s, g: F.concat(F.array_join(s.new, ""), g)), ""))
    out = rows.withColumn(column, F.when(swapped.isNull(), F.col(column)).otherwise(text))
    # an address's surrogate is its first piece alone: what follows isn't part of it
    shown = lambda s: F.struct(s.kind.alias("kind"), F.when(s.kind == "email", F.get(s.new, F.lit(0))).otherwise(F.array_join(s.new, "")).alias("text"))
    every = F.coalesce(F.transform(F.filter(swapped, lambda s: s.kind.isNotNull()), shown), F.array().cast("array<struct<kind:string,text:string>>"))
    return out.select(*kept_columns(df), every.alias(found))
