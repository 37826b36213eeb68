"""Personal data replaced by surrogates, in DataFrame expressions only.

Detected entities get a keyed replacement of their own type and format: the same entity always the same one (coreference), different
entities different ones (distinctness).

* Numbers (phones, cards, IPv4 addresses, social security numbers) pass a keyed Feistel permutation of the numbers of their length, so
  distinctness holds by construction, whatever signs part the digits; a phone's country code stays, and so does the check digit of a card, right or wrong by as much as it was.
* Emails, secrets, IBANs and names get keyed characters, letter for letter of the same case and script, digit for digit, or for names keyed
  syllables in the script and with the ending of the gender. Two of these could meet by chance, or meet an entity that occurs; a collision check
  over the distinct entities finds such cases and gives all but one of them the next attempt, until none is left. From attempt ``LONGER`` on, each is
  longer by a syllable or two letters than the one before, so there is room for any number of entities.

Given names, surnames and their bearer's gender come from an honorific or from the lists below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, shielded
from .quality import let

# Honorifics by gender.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Госпожа", "Κυρία"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
OTHER_TITLES = ["Dr", "Prof"]
# Common given names by gender.
FEMALE_NAMES = ["Alice", "Amelia", "Anna", "Camille", "Carmen", "Chloé", "Elena", "Elizabeth", "Emily", "Emma", "Greta", "Hannah", "Isabella", "Jennifer", "Jessica", "Julia", "Katharina", "Laura", "Lucía", "Maria", "María", "Marie", "Mary", "Olivia", "Patricia", "Sarah", "Sophia", "Susan", "Ursula", "Анна", "Мария", "Ольга", "Μαρία", "Ελένη"]
MALE_NAMES = ["Antonio", "Carlos", "Charles", "Daniel", "David", "Friedrich", "Hans", "James", "Jean", "Johann", "John", "José", "Joseph", "Juan", "Karl", "Luis", "Michael", "Miguel", "Pierre", "Richard", "Robert", "Thomas", "William", "Wolfgang", "Алексей", "Иван", "Сергей", "Γιώργος", "Νίκος"]
# Letters by script and case, digits; a character is replaced by one of its own row.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "àáâäçèéêëìíîïñòóôöùúûü", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
# Syllables by script, and the endings of female, male and other given names, and of surnames.
SYLLABLES = {
    "latin": (["ba", "bel", "cor", "da", "del", "fa", "gal", "ha", "jo", "ka", "la", "lin", "ma", "mel", "na", "or", "pa", "ra", "sel", "ta", "ti", "va", "vel", "za"], {"f": "ia", "m": "on", "n": "e", "s": "er"}),
    "cyrillic": (["ба", "ве", "да", "ди", "за", "ка", "ла", "ле", "ма", "ми", "на", "ни", "ра", "ро", "са", "та"], {"f": "ия", "m": "ор", "n": "е", "s": "ов"}),
    "greek": (["βα", "γα", "δα", "θε", "κα", "λα", "λε", "μα", "μι", "να", "νι", "ρα", "ρο", "σα", "τα", "φι"], {"f": "ία", "m": "ος", "n": "ι", "s": "ης"}),
}

_NAME = r"\p{Lu}[\p{Ll}\p{M}]+(?:-\p{Lu}[\p{Ll}\p{M}]+)?"
_TITLE = "(?:" + "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES) + r")\.?"
_GIVEN = "(?:" + "|".join(FEMALE_NAMES + MALE_NAMES) + ")"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds in order of precedence, with what matches them; the order of the alternatives decides where several match at one place.
PATTERNS = {
    # Groups repeat possessively: Java runs such loops without recursion, so texts may be as long as they like. A dot counts if a label follows.
    "email": r"(?<![\w.%+\-\p{L}\p{N}])[\w.%+\-\p{L}\p{N}]++@(?:(?:[\w\-\p{L}\p{N}]++\.(?=[\w\-\p{L}\p{N}]))++\p{L}{2,}|[\w\-\p{L}\p{N}]++\.\p{L}{2,})",
    # What may stand before the value, and its length, are looked at before the word that announces it.
    "secret": r"(?<=[\"'=: ])(?=[A-Za-z0-9_/+.=-]{12})(?<=(?:token|secret|passwd|password|api_key|apikey|access_key|private_key)[\"']? ?[=:] ?[\"']?)[A-Za-z0-9_/+.=-]++|(?<![\p{L}\p{N}])(?=[0-9a-fAgs])(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv4": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\p{L}\p{N}(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]\d)",
    "card": r"(?<![\p{L}\p{N}])\d{13,19}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?![\p{L}\p{N}])",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:{_TITLE} {_NAME}(?: {_NAME})?|{_GIVEN} {_NAME})(?![\p{{L}}\p{{N}}])",
}
_CARD = PATTERNS["card"].replace(r"([ -])\d{4}\1\d{4}\1", r"(?: \d{4} \d{4} |-\d{4}-\d{4}-)")
_ANY = "|".join(f"(?:{_CARD if kind == 'card' else p})" for kind, p in PATTERNS.items())
# Substrings one of which every secret without a digit has or follows.
SECRET_MARKS = ["token", "secret", "passw", "key", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-"]
NUMBERS = ("ipv4", "ssn", "phone", "card")
# Country calling codes of one digit and of two; the others have three.
CODES = r"^\+((?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\d{3})"
LONGER = 4  # attempts at the original length


def kind_of(e: Column) -> Column:
    """The kind of a matched string."""
    chain = F.when(e.contains("@"), "email").when(e.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"), "iban")
    chain = chain.when(e.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), "ipv4").when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    chain = chain.when(e.rlike(r"^\d{4}([ -])\d{4}\1\d{4}\1\d{4}$|^\d{13,19}$"), "card").when(e.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
    return chain.when(e.rlike(rf"^(?:{_TITLE} {_NAME}( {_NAME})?|{_GIVEN} {_NAME})$"), "name").otherwise("secret")


def norm_of(kind: Column, e: Column) -> Column:
    """What two mentions of one entity share."""
    bare = F.regexp_replace(e, r"[^\p{L}\p{N}+]", "")  # a phone's plus says that a country code follows
    return F.when(kind.isin("phone", "card", "ssn", "iban"), bare).when(kind.isin("email", "name"), F.lower(e)).otherwise(e)


def _digest(key: str, *parts) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def _number(hexed: Column) -> Column:
    """A non-negative long from the first 15 of some hexadecimal digits."""
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted(key: str, kind, digits: Column, rounds: int = 6) -> Column:
    """A keyed permutation of the digit strings of one length (up to 36): a Feistel network on its halves."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")

    def step(s: Column, i: Column) -> Column:
        # The left half moves by a keyed function of the right one; then the halves change places.
        moved = F.pmod(s["a"] + F.pmod(_number(_digest(key, kind, i, n, s["b"])), _power(s["na"])), _power(s["na"]))
        return F.struct(s["b"].alias("a"), moved.alias("b"), s["nb"].alias("na"), s["na"].alias("nb"))

    start = F.struct(F.substr(digits, F.lit(1), low).cast("long").alias("a"), F.substr(digits, low + 1).cast("long").alias("b"), low.alias("na"), (n - low).alias("nb"))
    join = lambda s: F.concat(F.lpad(s["a"].cast("string"), s["na"], "0"), F.lpad(s["b"].cast("string"), s["nb"], "0"))
    return F.when(n < 2, F.pmod(digits.cast("long") + F.pmod(_number(_digest(key, kind, "one")), F.lit(10)), F.lit(10)).cast("string")).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, join)
    )


def luhn(digits: Column) -> Column:
    """The check digit that belongs after some digits."""

    def value(c: Column, i: Column, n: Column) -> Column:
        d = c.cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = let(F.split(digits, ""), lambda cs: F.aggregate(F.transform(cs, lambda c, i: value(c, i, F.size(cs))), F.lit(0), lambda s, x: s + x))
    return F.pmod(-total, F.lit(10))


def formatted(shape: Column, chars: Column) -> Column:
    """``shape`` with its letters and digits replaced, in order, by ``chars``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    put = lambda s, c: F.when(c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(s["s"], F.substr(chars, s["i"], F.lit(1))).alias("s"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["s"], c).alias("s"), s["i"].alias("i")))
    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["s"])


def spelled(key: str, kind, seed: Column, shape: Column, hexed: Column) -> Column:
    """``shape`` with each letter or digit replaced by a keyed one of its own alphabet (``hexed``: lower-case letters up to f)."""

    def char(c: Column, i: Column, once: Column) -> Column:
        h = F.conv(F.substr(F.get(once["bits"], F.floor(i / 16).cast("int")), i % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")
        out = c
        for row in reversed(ALPHABETS):
            n = F.when(once["hexed"], 6).otherwise(26) if row[0] == "a" else F.lit(len(row))
            out = F.when(F.locate(row[0], F.lit(row)).isNotNull() & F.lit(row).contains(c), F.substr(F.lit(row), (F.pmod(h, n) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    bits = let(F.sha2(seed, 256), lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.length(shape) / 16).cast("int")), lambda j: _digest(key, kind, j, v)))
    return let(F.struct(bits.alias("bits"), hexed.alias("hexed")), lambda once: F.array_join(F.transform(F.split(shape, ""), lambda c, i: char(c, i, once)), ""))


def checked_iban(body: Column) -> Column:
    """An IBAN without blanks, with right check digits."""
    turned = F.concat(F.substr(body, F.lit(5)), F.substr(body, F.lit(1), F.lit(2)), F.lit("00"))
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + F.expr("0") + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return F.concat(F.substr(body, F.lit(1), F.lit(2)), F.lpad((98 - rest).cast("string"), F.lit(2), "0"), F.substr(body, F.lit(5)))


def named(key: str, word: Column, gender: Column, attempt: Column) -> Column:
    """A keyed name of the word's script with the ending of ``gender`` (f, m, n or s for a surname), in the word's case."""

    def of(script: str) -> Column:
        syllables, endings = SYLLABLES[script]
        table = F.array(*map(F.lit, syllables))
        ending = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in endings.items() for x in pair]), gender), F.lit(""))
        last = F.least(3 + F.greatest(attempt - LONGER + 1, F.lit(0)), F.lit(15))
        pick = lambda bits: F.transform(F.sequence(F.lit(0), last), lambda i: F.get(table, F.pmod(F.conv(F.substr(bits, i * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(len(syllables)))))
        return let(_digest(key, "name", gender, attempt, F.lower(word)), lambda b: F.concat(F.array_join(pick(b), ""), ending))

    low = F.when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(word.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))
    return F.initcap(low)


def gender_of(e: Column) -> Column:
    first = F.regexp_replace(F.split(e, " ")[0], r"\.$", "")
    second = F.coalesce(F.get(F.split(e, " "), F.lit(1)), F.lit(""))
    chain = F.when(first.isin(FEMALE_TITLES + FEMALE_NAMES), "f").when(first.isin(MALE_TITLES + MALE_NAMES), "m")
    return chain.when(second.isin(FEMALE_NAMES), "f").when(second.isin(MALE_NAMES), "m").otherwise("n")


def person(key: str, e: Column, attempt: Column) -> Column:
    """Surrogate of a mention: a title stays; the last word is a surname, one before it a given name of the same gender."""

    def build(words: Column) -> Column:
        titled = F.regexp_replace(words[0], r"\.$", "").isin(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)
        n = F.size(words)
        word = lambda w, i: F.when(titled & (i == 0), w).when(i == n - 1, named(key, w, F.lit("s"), attempt)).otherwise(named(key, w, gender_of(e), attempt))
        return F.array_join(F.transform(words, word), " ")

    return let(F.split(e, " "), build)


def surrogate(key: str, kind: Column, norm: Column, e: Column, attempt: Column) -> Column:
    """The replacement of the mention ``e``. ``attempt`` counts from 0; permuted numbers need no other."""
    digits = F.regexp_replace(e, r"\D", "")
    code = F.regexp_extract(F.regexp_replace(e, r"[^\d+]", ""), CODES, 1)
    extra = F.substr(F.lit("a" * 40), F.lit(1), F.least(2 * F.greatest(attempt - LONGER + 1, F.lit(0)), F.lit(40)))  # what is appended before it is spelled
    phone = formatted(e, F.concat(code, permuted(key, F.concat(F.lit("phone"), code), F.substr(digits, F.length(code) + 1))))
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    card = let(permuted(key, "card", body), lambda d: F.concat(d, F.pmod(luhn(d) + F.substr(digits, F.length(digits)).cast("int") - luhn(body), F.lit(10)).cast("string")))
    ssn = formatted(e, permuted(key, "ssn", digits))
    octets = F.split(e, r"\.")
    half = lambda i: F.get(octets, F.lit(i)).cast("int") * 256 + F.get(octets, F.lit(i + 1)).cast("int")
    mixed = lambda s, i: F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(_number(_digest(key, "ipv4", i, s["b"])), F.lit(65536)).cast("int"), F.lit(65536)).alias("b"))
    dotted = lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)])
    ipv4 = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.struct(half(0).alias("a"), half(2).alias("b")), mixed, dotted)
    bare = F.regexp_replace(e, " ", "")
    iban = formatted(e, checked_iban(F.concat(F.substr(bare, F.lit(1), F.lit(4)), spelled(key, "iban", F.concat_ws("/", norm, attempt.cast("string")), F.substr(bare, F.lit(5)), F.lit(False)))))
    hexed = e.rlike("^[0-9a-f]+$")
    prefix = F.regexp_extract(e, r"^(AKIA|gh[pousr]_|sk-)", 1)
    secret = F.concat(prefix, spelled(key, "secret", F.concat_ws("/", norm, attempt.cast("string")), F.concat(F.substr(e, F.length(prefix) + 1), extra), hexed))
    at = F.instr(e, "@")
    host = F.substr(e, at + 1)
    top = F.regexp_extract(host, r"\.\p{L}+$", 0)
    label = F.substr(host, F.lit(1), F.length(host) - F.length(top))
    email = F.concat(
        spelled(key, "local", F.concat_ws("/", norm, attempt.cast("string")), F.concat(F.substr(e, F.lit(1), at - 1), extra), F.lit(False)),
        F.lit("@"), spelled(key, "host", F.lower(label), label, F.lit(False)), top,
    )
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", formatted(e, card)).when(kind == "ssn", ssn).when(kind == "ipv4", ipv4)
        .when(kind == "iban", iban).when(kind == "name", person(key, e, attempt)).otherwise(secret)
    )


def detected(text: Column) -> Column:
    """Entities of a text as matched, in order."""
    return F.regexp_extract_all(text, F.lit(f"({_ANY})"), F.lit(1))


def parted(text: Column) -> Column:
    """A text cut at its entities: they stand at the odd places. One pass: entities are marked, then the marks are split at."""
    marked = F.split(F.regexp_replace(text, f"({_ANY})", "\x01$1\x01"), "\x01", -1)
    pairs = lambda es: F.zip_with(F.split(text, f"(?:{_ANY})", -1), es, lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b)))
    slow = let(detected(text), lambda es: F.flatten(pairs(es)))
    return F.when(text.contains("\x01"), slow).otherwise(marked)


def possible(text: Column) -> Column:
    """Whether a text may hold an entity: cheap tests that most texts fail. Every entity has a digit, an at sign, a name or one of the marks."""
    tests = [text.contains("@"), text.rlike(r"[0-9]"), text.rlike(rf"(?=\p{{Lu}})(?:{_TITLE}|{_GIVEN}) \p{{Lu}}"), *[text.contains(m) for m in SECRET_MARKS]]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def mentions(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, norm, mention) of all texts."""
    has = df.where(possible(F.col(text)))
    rows = has.select(F.explode(detected(F.col(text))).alias("mention")).groupBy("mention").agg(F.count("*").alias("n"))
    kind = kind_of(F.col("mention"))
    return rows.select(kind.alias("kind"), "mention", "n").withColumn("norm", norm_of(F.col("kind"), F.col("mention")))


def collisions(found: DataFrame, key: str) -> DataFrame:
    """Entities (kind, norm, attempt) whose first surrogate is taken: by another entity, or by an entity that occurs.

    Rounds run over the distinct entities only; in each, the one of the fewest attempts, then the smallest, of those that share a surrogate keeps it and
    the others go on. Surrogates grow from attempt ``LONGER`` on, so a round comes in which none collide.
    """
    now = durable(found.where(~F.col("kind").isin(*NUMBERS)).groupBy("kind", "norm").agg(F.min("mention").alias("mention")).withColumn("attempt", F.lit(0)))
    occurs = now.select(F.col("kind").alias("_kind"), F.col("norm").alias("_norm")).union(found.where("kind = 'name'").select("kind", F.lower("mention")))
    while True:
        made = durable(now.withColumn("s", F.lower(surrogate(key, F.col("kind"), F.col("norm"), F.col("mention"), F.col("attempt")))))
        first = made.groupBy(F.col("kind").alias("_kind"), F.col("s").alias("_s")).agg(F.min(F.struct("attempt", "norm")).alias("_w"), F.count("*").alias("_n")).where("_n > 1")
        again = made.join(first, (F.col("kind") == F.col("_kind")) & (F.col("s") == F.col("_s"))).where(F.struct("attempt", "norm") != F.col("_w")).select("kind", "norm")
        taken = made.join(occurs, (F.col("kind") == F.col("_kind")) & (F.regexp_replace("s", r"[^\p{L}\p{N}@._ -]", "") == F.col("_norm")), "left_semi").select("kind", "norm")
        lost = durable(again.union(taken).distinct().select(F.col("kind").alias("_kind"), F.col("norm").alias("_norm")))
        if not lost.limit(1).count():
            break
        hit = F.col("_norm").isNotNull()
        now = durable(now.join(lost, (F.col("kind") == F.col("_kind")) & (F.col("norm") == F.col("_norm")), "left").select("kind", "norm", "mention", (F.col("attempt") + hit.cast("int")).alias("attempt")))
    return now.where("attempt > 0").select("kind", "norm", "attempt")


def replace(df: DataFrame, key: str, text: str = "text", broadcast_rows: int = 10_000) -> DataFrame:
    """``df`` with ``text`` in which each entity is replaced, and pii: an array of (kind, surrogate) in order.

    Texts without an entity, empty and null ones stay as they are, with an empty array. The work on a row is narrow: regular expressions and
    keyed expressions. The exceptions that the collision check found go along as one map if there are at most ``broadcast_rows`` of them, else they
    are joined to the texts that need them. ``key`` is the secret; another key gives other surrogates. Columns named pii are replaced.
    """
    df, columns, to = shielded(df)
    back = [F.col(to[c]).alias(c) for c in columns if c != "pii"]
    text = to[text]
    odd = collisions(durable(mentions(df, text)), key)
    names = df.columns
    n = odd.count()
    entry = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "norm"), "attempt"))).alias("_odd")
    if not n:
        with_odd = df.select(*names).withColumn("_odd", F.lit(None).cast("map<string,int>"))
    elif n <= broadcast_rows:
        with_odd = df.select(*names).crossJoin(F.broadcast(odd.agg(entry)))  # one row
    else:
        own = df.where(possible(F.col(text))).select(F.sha2(text, 256).alias("_text"), F.explode(F.array_distinct(detected(F.col(text)))).alias("_e")).distinct()
        own = own.withColumn("_k", kind_of(F.col("_e"))).withColumn("_v", norm_of(F.col("_k"), F.col("_e")))
        hits = own.join(odd, (F.col("_k") == F.col("kind")) & (F.col("_v") == F.col("norm"))).select("_text", "kind", "norm", "attempt").distinct().groupBy("_text").agg(entry)
        with_odd = df.select(*names).withColumn("_of", F.sha2(text, 256)).join(hits, F.col("_of") == F.col("_text"), "left").drop("_of", "_text")
    t = F.col(text)
    attempt = lambda kind, norm: F.coalesce(F.element_at(F.col("_odd"), F.concat_ws("\x1f", kind, norm)), F.lit(0))
    one = lambda e: let(kind_of(e), lambda k: let(norm_of(k, e), lambda v: F.struct(k.alias("kind"), surrogate(key, k, v, e, attempt(k, v)).alias("surrogate"))))
    part = lambda e, i: F.when(i % 2 == 1, one(e)).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), e.alias("surrogate")))
    none = F.array().cast("array<struct<kind:string,surrogate:string>>")
    made = with_odd.withColumn("_parts", F.when(possible(t), F.transform(parted(t), part)).otherwise(none)).drop("_odd")
    made = made.withColumn("pii", F.filter("_parts", lambda p: p["kind"].isNotNull()))
    whole = F.array_join(F.transform("_parts", lambda p: p["surrogate"]), "")
    return made.withColumn(text, F.when(F.size("pii") > 0, whole).otherwise(t)).select(*back, "pii")
