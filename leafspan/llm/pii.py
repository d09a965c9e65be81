r"""Personal data replaced by surrogates.

Entities are found by one ordered pattern: secrets assigned to a key, e-mail
addresses, access keys, IPv6 and IPv4 addresses, bank accounts (IBAN, by their check
digits), phone numbers, payment cards (Luhn), social security numbers, and names behind
a title.  Names found so are then looked for in the whole text, so a later mention
without the title is replaced alike.  Each entity has a type and a normal form, so one
written in two ways (``4111 1111 ...``, ``41111111...``) stays one.

A surrogate is drawn from a keyed hash of type, normal form and attempt.  It keeps
the type and its shape: letters, digits and separators stay where they are, a card
keeps its first digit and a valid check digit, an account its country and valid check
digits, an address stays an address, an e-mail's domain is replaced by one under the
reserved ``.example`` (the same for all its addresses), a given name keeps its gender,
and names keep their script (Latin, Cyrillic, Greek, Armenian) and capitals.

The distinct entities of the whole corpus form a table.  Collision checks run on it
until none is left: of entities that draw the same surrogate one keeps it, a
surrogate that is itself an entity of the corpus is refused, and the others draw
again.  So equal entities get equal surrogates in all documents and different ones
different ones; if a format has fewer forms than the corpus has entities, that is an
error after ROUNDS draws.

The pattern runs once: rows are staged with their entities and the text between them,
and only rows with entities meet the table, by (row, entity) pairs; joins on a hot
entity can be split.  Everything is built-in functions.  The key is the argument, else
the session's ``spark.leafspan.pii.key``, else a public one for tests.

Defined cases: null text stays null; texts without entities pass unchanged; numbers
of card length that fail the Luhn test are no entities; a value behind a key is a secret
up to the next blank, quote, ``,``, ``;``, ``&`` or bracket if it is quoted, stands behind
``=`` alone, or holds a digit and 8 characters; addresses behind a key stay addresses;
names of one letter and names without a title anywhere in the text are not found; equal
rows get equal results; rows may repeat or lack a doc_id; other columns pass through,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small, stage

#: Where the session has the key, and the key of tests.
KEY_SETTING, KEY = "spark.leafspan.pii.key", "leafspan"
#: Draws after which the checks give up; each round is a few small jobs.
ROUNDS = 40

_TITLES = {"m": "Mr Herr Monsieur Sr Señor Sir Signor Г-н Господин Κύριος Κος", "f": "Mrs Ms Miss Frau Madame Mme Mlle Sra Señora Lady Signora Г-жа Госпожа Κυρία Κα", "n": "Dr Prof Professor"}
_TITLES = {g: "|".join(dict.fromkeys([*names.split(), *names.upper().split()])) for g, names in _TITLES.items()}
_ANY_TITLE = "|".join(_TITLES.values())
_KEYWORD = r"(?=[AaPpSsTt])(?i:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|auth)[_-]?key)[\"']?"
_ASSIGN = _KEYWORD + r"\s{0,3}[:=]\s{0,3}[\"']?"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
_ACCESS = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}(?![A-Za-z0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*+[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,5}})?::{_HEX}(?::{_HEX}){{0,5}})(?![\p{{L}}\p{{N}}:])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_NO_ADDRESS = rf"(?!{_EMAIL}|{_IP}(?![A-Za-z0-9+/_=~-]))"
_VALUE, _END = r"[^\s\"'<>,;&(){}\[\]]", r"(?<![.:!?])"
_SECRET = (rf"{_KEYWORD}(?:\s{{0,3}}[:=]\s{{0,3}}[\"']{_NO_ADDRESS}[^\s\"']{{4,}}+|=(?!(?i:none|null|true|false)\b){_NO_ADDRESS}{_VALUE}{{6,}}{_END}(?![(\[{{])"
           rf"|\s{{0,3}}[:=]\s{{0,3}}{_NO_ADDRESS}(?=[^\s\"'<>,;&(){{}}\[\]0-9]*+[0-9]){_VALUE}{{8,}}{_END})")
_CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7})(?![0-9])"
_PHONE = (r"\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
          r"|(?<![0-9.-])(?:1[ .-])?[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])|(?<![0-9.-])(?<![0-9] )(?:1[ .-])?[2-9][0-9]{2}[ .][0-9]{3}[ .][0-9]{4}(?![0-9])(?![ .-][0-9])")
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Words that begin sentences rather than names; fixed values.
_NO_NAME = "A|An|And|At|But|He|Her|His|I|If|In|It|No|Of|On|Our|She|That|The|They|This|To|We|You"
_WORD = rf"(?!(?:{_NO_NAME})(?![\p{{L}}\p{{M}}]))\p{{Lu}}(?:[\p{{L}}\p{{M}}]{{1,40}}+(?:['’-]\p{{Lu}}[\p{{L}}\p{{M}}]{{0,40}}+){{0,3}}|['’]\p{{Lu}}[\p{{L}}\p{{M}}]{{1,40}}+)"
_PARTICLES = r"(?:(?:van|von|der|den|de|la|le|du|da|di|del|dos|ter|ten|zu|bin|ibn|al|el) ){0,3}"
_NAME = rf"(?<![\p{{L}}])(?:{_ANY_TITLE})\.? (?:{_WORD} )?{_PARTICLES}{_WORD}"
_any = "|".join
#: What can begin inside a word, at a word's start, or with a sign; a look at the first character spares most places the rest.
PATTERN = _any([f"(?:{_SECRET})", rf"(?<![A-Za-z0-9])(?=[\p{{L}}0-9:])(?:{_any([_EMAIL, _ACCESS, _IP6, _IBAN])})", rf"(?=[0-9+(])(?:{_any([_IP, _PHONE, _CARD, _SSN])})", rf"(?=\p{{Lu}}){_NAME}"])
_TRACE = rf"[0-9@]|(?=\p{{Lu}})(?:{_ANY_TITLE})\.? (?:{_PARTICLES})\p{{Lu}}|{_ASSIGN}"

#: Given names by gender and script, surnames by script; fixed values.
GIVEN = {
    "m": ("Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Leon Martin Oscar Paul Robert Simon Victor".split(), "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел".split(), "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Παύλος Πέτρος Στέφανος".split(), "Արամ Գագիկ Դավիթ Հայկ Կարեն Վահան Տիգրան".split()),
    "f": ("Alice Bella Clara Diana Emma Flora Helen Irene Julia Laura Maria Nora Paula Rosa Sofia Vera".split(), "Алина Вера Дарья Елена Зоя Инна Кира Лидия Мария Нина Ольга Софья".split(), "Μαρία Ελένη Άννα Σοφία Κατερίνα Ειρήνη Δήμητρα Βασιλική".split(), "Անի Գայանե Լիլիթ Մարիամ Նարե Սոնա Շուշան".split()),
    "n": ("Alex Andrea Charlie Dominique Francis Jamie Kim Lou Morgan Noel Robin Sacha Sam Taylor".split(), "Саша Женя Валя Слава".split(), "Αλέξης Φώτης Χρύσα Ζωή".split(), "Արփի Նուրի Հրանտ".split()),
}
SURNAMES = ("Arden Bell Corbin Dorn Ellis Falk Grant Hale Irving Jansen Keller Lorne Marsh Novak Olsen Petri Quill Rossi Stone Turner Urban Vogel Weber Young".split(), "Белов Волков Громов Дымов Ершов Зимин Исаев Котов Лунин Мохов Орлов Рогов".split(), "Αγγέλου Βλάχος Γεωργίου Δήμου Ζήσης Ιωάννου Κανάρης Λάμπρου Μάρκου Νικολάου Ράπτης".split(), "Աբրահամյան Գրիգորյան Հակոբյան Մարտիրոսյան Պետրոսյան Սարգսյան".split())
_SYLLABLES = ("ba de fi go lu ma ne pi ro su ta ve wi zo ka li".split(), "ба де фи го лу ма не пи ро су та ве ви зо ка ли".split(), "βα δε γι λο μα νε πι ρο σα τι".split(), "բա դե գի լո մա նե պի րո սա տի".split())
_SCRIPTS = (None, "Cyrillic", "Greek", "Armenian")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENTITY = "array<struct<prefix:string,body:string,pieces:array<struct<type:string,norm:string>>>>"
_NAMES = "array<struct<name:string,type:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _check_sum(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _remainder(account: Column) -> Column:
    """Remainder by 97 of an account's number, its country and check digits moved to the end."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    step = lambda s, c: F.when(c.rlike("[0-9]"), s * 10 + c.cast("int")).when(c.rlike("[A-Z]"), s * 100 + F.ascii(c) - 55).otherwise(s) % 97
    return F.aggregate(F.transform(F.split(moved, ""), lambda c: c), F.lit(0), lambda s, c: step(s, c).cast("int"))


def _read(e: Column, names: Column) -> Column:
    """What one match is: the part that stays before it, the part that is replaced, and its types and normal forms.

    ``names`` are the names of the text (name, type) for mentions without a title.
    """
    titled = e.rlike(rf"^(?:{_ANY_TITLE})\.? (?:{_PARTICLES})\p{{Lu}}")
    prefix = F.when(e.rlike(f"^{_ASSIGN}"), F.regexp_extract(e, f"^{_ASSIGN}", 0)).when(titled, F.regexp_extract(e, rf"^(?:{_ANY_TITLE})\.? {_PARTICLES}", 0)).otherwise("")
    body = F.substring(e, F.length(prefix) + 1, F.length(e))
    piece = lambda kind, norm: F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), norm.alias("norm"))
    gender = F.when(prefix.rlike(rf"^(?:{_TITLES['f']})\.? "), "given:f").when(prefix.rlike(rf"^(?:{_TITLES['m']})\.? "), "given:m").otherwise("given:n")
    words, none = F.split(F.lower(body), " "), F.array().cast("array<struct<type:string,norm:string>>")
    mention = F.get(F.filter(names, lambda n: n["name"] == F.lower(e)), 0)
    account = F.replace(e, F.lit(" "), F.lit(""))
    pieces = (
        F.when(titled, F.when(F.size(words) > 1, F.array(piece(gender, F.get(words, 0)), piece("surname", F.element_at(words, -1)))).otherwise(F.array(piece("surname", F.get(words, 0)))))
        .when(prefix != "", F.when(body.rlike(f"^{_ACCESS}$"), F.array(piece("access", body))).otherwise(F.array(piece("secret", body))))
        .when(e.contains("@"), F.array(piece("email", F.lower(e))))
        .when(e.rlike(f"^{_ACCESS}$"), F.array(piece("access", e)))
        .when(e.contains(":"), F.array(piece("ip6", F.lower(e))))
        .when(e.rlike(f"^{_IP}$"), F.array(piece("ip", e)))
        .when(e.rlike(f"^{_IBAN}$"), F.when(_remainder(account) == 1, F.array(piece("iban", account))).otherwise(none))
        .when(e.rlike(r"^\p{L}"), F.when(mention.isNotNull(), F.array(piece(mention["type"], mention["name"]))).otherwise(none))
        .when(e.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.array(piece("ssn", _digits(e))))
        .when(e.rlike(f"^(?:{_PHONE})$"), F.array(piece("phone", F.concat(F.when(e.startswith("+"), "+").otherwise(""), _digits(e)))))
        .otherwise(F.when(_check_sum(_digits(e)) % 10 == 0, F.array(piece("card", _digits(e)))).otherwise(none))
    )
    return F.struct(prefix.alias("prefix"), body.alias("body"), pieces.alias("pieces"))


def find_entities(df: DataFrame) -> DataFrame:
    """``df`` with gaps, the text between matches (null if there is no entity), and own, the matches in order, read.

    Matches without pieces are no entities and stay.  Texts with names are matched once
    more, with the names as a last alternative.
    """
    none = F.array().cast(_ENTITY)
    df = df.withColumn("_all", F.when(F.col("text").rlike(_TRACE), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    df = df.withColumn("_first", F.when(F.size("_all") > 0, F.col("_all")))
    no_names = F.array().cast(_NAMES)
    df = df.withColumn("_read", F.transform("_first", lambda e: _read(e, no_names)))
    people = F.filter(F.flatten(F.transform("_read", lambda r: r["pieces"])), lambda p: p["type"].rlike("^(?:given|surname)"))
    df = df.withColumn("_names", F.array_distinct(F.transform(people, lambda p: F.struct(p["norm"].alias("name"), p["type"].alias("type")))))
    edge = r"[\p{L}\p{M}\p{N}]"
    words = F.array_join(F.transform("_names", lambda n: n["name"]), "|")
    again = F.concat(F.lit(PATTERN + rf"|(?<!{edge})(?=\p{{Lu}})(?iu:"), words, F.lit(rf")(?!{edge})"))
    people = F.size("_names") > 0
    df = df.withColumn("gaps", F.when(people, F.split("text", again, -1)).when(F.size("_first") > 0, F.split("text", PATTERN, -1)))
    df = df.withColumn("own", F.when(people, F.transform(F.regexp_extract_all("text", again, F.lit(0)), lambda e: _read(e, F.col("_names")))).otherwise(F.col("_read")))
    found = F.exists("own", lambda e: F.size(e["pieces"]) > 0)
    return df.withColumn("gaps", F.when(found, F.col("gaps"))).withColumn("own", F.when(found, F.col("own")).otherwise(none)).drop("_all", "_first", "_read", "_names")


def _draw(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """128 keyed hex digits."""
    message = F.concat_ws("\x1f", kind, norm, attempt.cast("string"))
    inner = F.sha2(F.concat(F.lit(key + "\x1f"), message), 256)
    return F.concat(F.sha2(F.concat(F.lit(key + "\x1e"), inner), 256), F.sha2(F.concat(F.lit(key + "\x1d"), inner), 256))


def _number(hexes: Column, i, most: int) -> Column:
    """The i-th number below most."""
    at = (i % 63) * 2 + 1 if isinstance(i, Column) else F.lit(i % 63 * 2 + 1)
    return F.conv(F.substring(hexes, at, F.lit(4)), 16, 10).cast("int") % most


def _shape(s: Column, hexes: Column) -> Column:
    """Another string with letters, capitals, digits and everything else in the same places."""
    pick = lambda letters, i, n: F.substring(F.lit(letters), _number(hexes, i, n) + 1, F.lit(1))
    return F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when(c.rlike("[0-9]"), pick("0123456789", i, 10)).when(c.rlike("[a-z]"), pick(_LOWER, i, 26)).when(c.rlike("[A-Z]"), pick(_UPPER, i, 26)).otherwise(c)), "")


def _surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    h = _draw(kind, norm, attempt, key)
    domain = _draw(F.lit("domain"), F.substring_index(norm, "@", -1), F.lit(0), key)
    email = F.concat(_shape(F.substring_index(norm, "@", 1), h), F.lit("@"), _shape(F.lit("aaaaaaaaaa"), domain), F.lit(".example"))
    octet = _number(h, 0, 220) + 1
    ip = F.concat_ws(".", F.when(octet.isin(10, 127), octet + 1).otherwise(octet), _number(h, 2, 256), _number(h, 4, 256), _number(h, 6, 254) + 1)
    stem = F.concat(F.substring(norm, 1, 1), _shape(F.substring(norm, F.lit(2), F.length(norm) - 2), h))
    card = F.concat(stem, ((10 - _check_sum(F.concat(stem, F.lit("0"))) % 10) % 10).cast("string"))
    lead = F.regexp_extract(norm, r"^\+?[0-9]", 0)
    phone = F.concat(lead, (_number(h, 60, 8) + 2).cast("string"), _shape(F.substring(norm, F.length(lead) + 2, F.lit(40)), h))
    access = F.concat(F.substring(norm, 1, 4), _shape(F.substring(norm, 5, 16), h))
    ip6 = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), _number(h, i, 16) + 1, F.lit(1))).otherwise(c)), "")
    bare = F.concat(F.substring(norm, 1, 2), F.lit("00"), _shape(F.substring(norm, F.lit(5), F.length(norm)), h))
    iban = F.concat(F.substring(norm, 1, 2), F.lpad((98 - _remainder(bare)).cast("string"), 2, "0"), F.substring(bare, F.lit(5), F.length(norm)))
    secret = F.when(norm.rlike("^[0-9a-f]+$"), F.substring(F.repeat(h, F.ceil(F.length(norm) / 128).cast("int")), F.lit(1), F.length(norm))).otherwise(_shape(norm, h))

    def named(lists):
        def of(script):
            names, parts = F.array(*map(F.lit, lists[script])), F.array(*map(F.lit, _SYLLABLES[script]))
            more = F.array_join(F.transform(F.sequence(F.lit(1), F.least(attempt, F.lit(12)) + 1), lambda i: F.get(parts, _number(h, i * 2, len(_SYLLABLES[script])))), "")
            return F.concat(F.get(names, _number(h, 0, len(lists[script]))), F.when(attempt > 0, more).otherwise(""))

        out = None
        for i, script in enumerate(_SCRIPTS[1:], 1):
            out = (F if out is None else out).when(norm.rlike(rf"\p{{Is{script}}}"), of(i))
        return out.otherwise(of(0))

    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "access", access).when(kind == "secret", secret).when(kind == "ip6", ip6).when(kind == "iban", iban)
            .when(kind == "ssn", _shape(norm, h)).when(kind == "given:m", named(GIVEN["m"])).when(kind == "given:f", named(GIVEN["f"])).when(kind == "given:n", named(GIVEN["n"])).otherwise(named(SURNAMES)))


def _family(kind: Column) -> Column:
    """Types whose surrogates must not be mistaken for each other's entities."""
    return F.when(kind.rlike("^(?:given|surname)"), "name").otherwise(kind)


def surrogate_table(found: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """(type, norm, surrogate) of the distinct entities (type, norm) in ``found``, free of collisions."""
    pending = everything = stage(found.select("type", "norm").distinct(), "entities")
    refused = everything.select(_family(F.col("type")).alias("family"), F.col("norm").alias("plain")).distinct()
    done = None
    for attempt in range(rounds):
        drawn = pending.withColumn("surrogate", _surrogate(F.col("type"), F.col("norm"), F.lit(attempt), key))
        drawn = drawn.withColumn("n", F.row_number().over(Window.partitionBy("type", "surrogate").orderBy("norm")))
        drawn = drawn.withColumn("family", _family(F.col("type"))).withColumn("plain", F.when(F.col("family") == "name", F.lower("surrogate")).otherwise(F.col("surrogate")))
        kept = drawn.where("n = 1").drop("n").join(refused, ["family", "plain"], "left_anti")
        if done is not None:
            kept = kept.join(done.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        kept = stage(kept.select("type", "norm", "surrogate"), "kept")
        done = kept if done is None else done.union(kept)
        left = pending.join(kept, ["type", "norm"], "left_anti")
        if left.isEmpty():
            return done
        pending = stage(left, "pending")
    raise RuntimeError("surrogates still collide")


def _write(entity: Column, names: Column) -> Column:
    """One match with surrogates in its own layout."""
    first, second, body = F.get(entity["pieces"], 0), F.get(entity["pieces"], 1), entity["body"]
    look = lambda p: F.element_at(names, F.concat_ws("\x1f", p["type"], p["norm"]))
    cased = lambda new, old: F.when((old == F.upper(old)) & (F.length(old) > 1), F.upper(new)).otherwise(new)
    new = look(first)

    def laid(marks: str, signs: Column) -> Column:
        """The signs, one after the other, where the body has one of its own."""
        step = lambda s, c: F.struct(F.concat(s["out"], F.when(c.rlike(marks), F.substring(signs, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + c.rlike(marks).cast("int")).alias("at"))
        return F.aggregate(F.split(body, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step)["out"]

    words = F.split(body, " ")
    person = F.when(second.isNotNull(), F.concat_ws(" ", cased(new, F.get(words, 0)), F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), " "), cased(look(second), F.element_at(words, -1)))).otherwise(cased(new, body))
    person = F.regexp_replace(person, "  ", " ")
    out = (F.when(first["type"].isin("card", "phone", "ssn"), laid("[0-9]", _digits(new))).when(first["type"] == "iban", laid("[A-Z0-9]", new))
           .when(first["type"].isin("email", "ip6"), cased(new, body)).when(_family(first["type"]) == "name", person).otherwise(new))
    return F.concat(entity["prefix"], F.when(F.size(entity["pieces"]) > 0, out).otherwise(body))


def replace_pii(df: DataFrame, text_column: str = "text", key: str | None = None) -> DataFrame:
    """All columns, the text with surrogates, and pii_entities (type and number of each found)."""
    spark = df.sparkSession
    shared_dir(spark)
    columns = df.columns
    row = F.struct(F.lit(None).cast("int").alias("c"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns) if c != text_column))
    read = find_entities(df.select(row.alias("row"), F.col(f"`{text_column}`").alias("text")))
    # the number is fixed once it is written
    rows = stage(read.select(F.monotonically_increasing_id().alias("id"), "row", F.when(F.col("gaps").isNull(), F.col("text")).alias("text"), "gaps", "own"), "rows")
    hits = rows.where("gaps is not null")
    pairs = stage(hits.select("id", F.explode(F.array_distinct(F.flatten(F.transform("own", lambda e: e["pieces"])))).alias("p")).select("id", "p.type", "p.norm"), "pairs")
    table = stage(surrogate_table(pairs, key or spark.conf.get(KEY_SETTING, None) or KEY), "table")
    names = pairs.join(small(table), ["type", "norm"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "type", "norm"), "surrogate"))).alias("names"))
    names = stage(names, "names")
    kinds = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform("own", lambda e: F.transform(e["pieces"], lambda p: p["type"])))), lambda t: F.struct(t.alias("type"), F.size(F.filter(F.flatten(F.transform("own", lambda e: e["pieces"])), lambda p: p["type"] == t)).alias("n"))))
    kind = "array<struct<type:string,n:int>>"
    pieces = F.zip_with("gaps", "own", lambda gap, e: F.concat(gap, F.coalesce(_write(e, F.col("names")), F.lit(""))))
    met = hits.join(names, "id").select("row", F.array_join(pieces, "").alias("text"), kinds.cast(kind).alias("found"))
    out = met.union(rows.where("gaps is null").select("row", "text", F.array().cast(kind).alias("found")))
    return out.select(*((F.col("text") if c == text_column else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(columns)), F.col("found").alias("pii_entities"))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_pii(documents).select("doc_id", "text", F.coalesce(F.aggregate("pii_entities", F.lit(0), lambda s, e: s + e["n"]), F.lit(0)).cast("long").alias("n_entities"), F.array_join(F.transform("pii_entities", lambda e: e["type"]), ",").alias("entity_types"))
