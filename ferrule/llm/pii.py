"""PII: surrogates for detected entities, in DataFrame functions only.

Detected are e-mail addresses, telephone numbers, payment card numbers, IPv4 addresses, social
security numbers, bank account numbers (IBAN) and personal names (after a title, or a known given
name before a capitalised word). Each entity has a canonical form, so that spellings of one entity
share a surrogate (coreference); the surrogate is drawn with a keyed hash of type, canonical form
and attempt, and written in the layout of the mention: digits for digits, letters of the same case
and script for letters, the same punctuation; cards keep the state of their check digit, names
their title, their gender and their script. A given name is drawn from the lists of its script by
its own gender or that of the title before it; surnames are made of syllables where the script has
some here, else of letters of the script. Letters of scripts without an alphabet here become Latin.

The texts are searched once: rows, with what was found in them, are written in the shared folder,
and all further steps read that table.

Distinctness is checked over all entities: of those that drew one surrogate, all but the first by
name draw again, as do those whose surrogate is an entity of the texts itself, until none is left.
What is drawn anew is a table that is joined by row, only to rows that mention such an entity.

Defined results: null text stays null and empty stays empty, with no entities; repeated rows get
equal results; null doc_id is kept; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, erased, partitions, row_check, row_key, written

# Titles by gender, and given names by gender and script.
TITLES_F = "Mrs Ms Miss Frau Señora Madame Mme Госпожа".split()
TITLES_M = "Mr Sir Herr Señor Monsieur Господин".split()
TITLES_X = "Dr Prof".split()
GIVEN_F = "Alice Barbara Charlotte Elizabeth Emily Francesca Ingrid Jennifer Jessica Josephine Katharina Margaret Mary Olivia Patricia Sophia Susan Victoria".split()
GIVEN_M = "Alexander Benjamin Charles Christopher David Frederick George James John Joseph Matthew Michael Nicholas Oliver Patrick Robert Thomas William".split()
GIVEN_CYR_F = "Анна Елена Екатерина Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split()
GIVEN_CYR_M = "Александр Алексей Андрей Дмитрий Иван Михаил Николай Павел Сергей Юрий".split()
GIVEN_GRE_F = "Αικατερίνη Άννα Βασιλική Ελένη Μαρία Σοφία".split()
GIVEN_GRE_M = "Αντώνιος Γεώργιος Γιώργος Δημήτρης Κωνσταντίνος Νικόλαος".split()
GIVEN_MORE_F = "Aisha Amina Fatima Ifeoma Khadija Leila Mariam Priya Sakura Yasmin Yuki".split()
GIVEN_MORE_M = "Ahmed Arjun Carlos Hiroshi Ibrahim Jorge Kenji Mohammed Omar Rajesh Yusuf".split()
SYLLABLES = "bar cal den fol gar hol kel lor mar nor pel rud sol tam vel wil".split()
SYLLABLES_GRE = "βαρ γολ δαν ζαρ καλ λεν μιρ νοβ παλ ρουδ σαβ τιμ φεδ χολ μαν κορ".split()
SYLLABLES_CYR = "бар вол гор дан зар кал лен мир нов пав руд сав тим фед хол чер".split()
#: Letters by script, of which surrogates are made; no word of any language.
ALPHABETS = {
    "IsCyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "IsGreek": "αβγδεζηθικλμνξοπρστυφχψω",
    "IsHebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "IsArabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "IsArmenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ",
    "IsGeorgian": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
    "IsDevanagari": "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह",
    "IsThai": "กขคงจฉชซญดตถทธนบปผพฟภมยรลวสหอ",
    "IsHiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのまみむめもやゆよらりるれろわ",
    "IsKatakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノマミムメモヤユヨラリルレロワ",
    "IsHangul": "가강고구기김나남노다도라류마민박배서선성수신안양오우유윤이임장정조진차최한허홍황",
    "IsHan": "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗田山木村川本中小石原上野明文华建国平春海云东立志",
}
TYPES = ("email", "phone", "card", "ip", "ssn", "iban", "name")

_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
POOLS = (GIVEN_F, GIVEN_M, GIVEN_MORE_F, GIVEN_MORE_M, GIVEN_CYR_F, GIVEN_CYR_M, GIVEN_GRE_F, GIVEN_GRE_M)
GIVEN = [x for pool in POOLS for x in pool]
_given = "|".join(GIVEN)
_first, _letter = r"[\p{Lu}\p{Lo}]", r"[\p{L}\p{M}]"  # scripts without case have no capitals
_titles = "|".join([*TITLES_F, *TITLES_M, *TITLES_X])
ENTITY = "|".join(
    [
        r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}{2,}+",
        rf"(?<![\d.])(?:{_octet}\.){{3}}{_octet}(?!\d|\.\d)",
        r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
        r"(?<![\w+.-])\d(?:[ -]?\d){12,18}(?!\d)",
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]\d{4}(?!\w)",
        r"(?<!\w)\+\d(?:[ ./-]?\(?\d\)?){7,14}(?!\w)",  # in groups of any size: 8 to 15 digits in all
        r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
        rf"(?<![\p{{L}}\p{{N}}])(?:{_titles})\.? {_first}{_letter}+(?: {_first}{_letter}+)?(?![\p{{L}}\p{{N}}])",
        rf"(?<![\p{{L}}\p{{N}}])(?:{_given}) {_first}{_letter}+(?![\p{{L}}\p{{N}}])",
    ]
)
#: What every entity holds; texts without either are passed on as they are.
HINT = "[@0-9]"
_initials = "".join(sorted({w[0] for w in [*TITLES_F, *TITLES_M, *TITLES_X, *GIVEN]}))
NAME_HINT = rf"(?=[{_initials}])(?:{_titles}|{_given})\.? {_first}"


def kind(m: Column) -> Column:
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^[+(0-9]"), F.when((digits >= 13) & ~m.startswith("+"), "card").otherwise("phone"))
        .otherwise("name")
    )


def canonical(m: Column, t: Column) -> Column:
    digits = F.regexp_replace(m, r"\D", "")
    return (
        F.when(t == "email", F.lower(m))
        .when(t == "phone", F.right(digits, F.lit(10)))
        .when((t == "card") | (t == "ssn"), digits)
        .when(t == "iban", F.regexp_replace(m, " ", ""))
        .when(t == "name", F.lower(F.element_at(F.split(m, " "), -1)))
        .otherwise(m)
    )


def draw(secret: str, t: Column, canon: Column, attempt: Column) -> Column:
    """192 hexadecimal digits from the key, the entity and the attempt."""
    what = [F.lit(secret), t, canon, attempt.cast("string")]
    return F.concat(*[F.sha2(F.concat_ws("\x1f", *what, F.lit(str(i))), 256) for i in range(3)])


def number(h: Column, i: Column, below: int) -> Column:
    """The i-th number drawn, below a limit; i from 0."""
    at = F.pmod(i.cast("int"), F.lit(48)) * 4 + 1
    return F.pmod(F.conv(F.substring(h, at, F.lit(4)), 16, 10).cast("int"), F.lit(below))


def letters_and_digits(s: Column, h: Column, digits: bool = True) -> Column:
    """s with a drawn letter of the same case and script for each letter, a digit for each digit."""

    def one(i):
        ch = F.substring(s, i, F.lit(1))
        low = F.lower(ch)
        latin = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), number(h, i, 26) + 1, F.lit(1))
        new = F.when(low.between("a", "z"), latin)
        for script, letters in ALPHABETS.items():
            new = new.when(low.rlike(rf"\p{{{script}}}"), F.substring(F.lit(letters), number(h, i, len(letters)) + 1, F.lit(1)))
        new = new.when(low.rlike(r"\p{L}"), latin)
        new = F.when(ch != low, F.upper(new)).otherwise(new)
        if digits:
            new = F.when(ch.rlike(r"[0-9]"), number(h, i, 10).cast("string")).otherwise(new)
        return F.coalesce(new, ch)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), "")


def luhn(digits: Column) -> Column:
    """The check sum of a card number, modulo 10."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))


def drawn_digits(canon: Column, h: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(canon), F.lit(1))), lambda i: number(h, i, 10).cast("string")), "")


def checked_digits(t: Column, canon: Column, drawn: Column) -> Column:
    """Drawn digits, of which the last keeps a valid card valid."""
    body = F.substring(drawn, F.lit(1), F.length(canon) - 1)
    last = F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when((t == "card") & (luhn(canon) == 0), F.concat(body, last)).otherwise(drawn)


def in_layout(m: Column, digits: Column) -> Column:
    """m with its last digits replaced by the given ones, from the right."""
    spare = F.length(F.regexp_replace(m, r"\D", "")) - F.length(digits)

    def one(i):
        ch = F.substring(m, i, F.lit(1))
        ordinal = F.length(F.regexp_replace(F.substring(m, F.lit(1), i), r"\D", "")) - spare
        return F.when(ch.rlike("[0-9]") & (ordinal > 0), F.substring(digits, ordinal, F.lit(1))).otherwise(ch)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")


def new_name(m: Column, h: Column, attempt: Column, secret: str) -> Column:
    """Title kept; a given name for another of its gender and script; the last word for a drawn surname.

    A surname has a syllable or letter more with each attempt, so that there are always more of them than entities.
    """
    parts = F.split(m, " ")
    turn = F.conv(F.substring(F.sha2(F.lit(secret + "\x1fgiven"), 256), 1, 4), 16, 10).cast("int")
    array = lambda pool: F.array(*[F.lit(x) for x in pool])

    def listed(p):
        new = None
        for names in POOLS:
            pool = array(names)
            other = F.element_at(pool, (F.pmod(F.array_position(pool, p) + F.pmod(turn, F.lit(len(names) - 1)), F.lit(len(names))) + 1).cast("int"))
            new = F.when(p.isin(names), other) if new is None else new.when(p.isin(names), other)
        return new

    def unlisted(p):
        own = F.conv(F.substring(F.sha2(F.concat(F.lit(secret + "\x1fgiven\x1f"), F.lower(p)), 256), 1, 7), 16, 10).cast("int")
        drawn = lambda pool: F.element_at(array(pool), F.pmod(own, F.lit(len(pool))) + 1)
        title = F.regexp_replace(F.element_at(parts, 1), r"\.", "")

        def by_gender(f, m):
            return F.when(title.isin(TITLES_F), drawn(f)).when(title.isin(TITLES_M), drawn(m)).otherwise(drawn([*f, *m]))

        return (
            F.when(p.rlike(r"^\p{IsLatin}"), by_gender(GIVEN_F, GIVEN_M))
            .when(p.rlike(r"^\p{IsCyrillic}"), by_gender(GIVEN_CYR_F, GIVEN_CYR_M))
            .when(p.rlike(r"^\p{IsGreek}"), by_gender(GIVEN_GRE_F, GIVEN_GRE_M))
            .otherwise(letters_and_digits(p, h, False))
        )

    def surname(p):
        def pick(pool):
            return F.array_join(F.transform(F.sequence(F.lit(1), attempt + 4), lambda i: F.element_at(array(pool), number(h, i, len(pool)) + 1)), "")

        longer = F.concat(p, F.repeat(F.right(p, F.lit(1)), attempt))
        made = F.when(p.rlike(r"^\p{IsLatin}"), pick(SYLLABLES)).when(p.rlike(r"^\p{IsCyrillic}"), pick(SYLLABLES_CYR)).when(p.rlike(r"^\p{IsGreek}"), pick(SYLLABLES_GRE))
        return F.initcap(F.coalesce(made, letters_and_digits(longer, h, False)))

    title = rf"^(?:{_titles})\.?$"
    last = F.size(parts)

    def one(p, i):
        # the last word is what tells the entity, also if it is a given name
        return F.when(p.rlike(title), p).when(i == last - 1, surname(p)).when(p.isin(GIVEN), listed(p)).otherwise(unlisted(p))

    return F.array_join(F.transform(parts, one), " ")


def surrogates(entities: Column, secret: str) -> Column:
    """The surrogates of an array of (m, t, c, attempt).

    What a step needs more than once is a field of the array of the step before, as an expression
    within a lambda function is evaluated wherever it stands.
    """
    keep = lambda x, *names: [x[n].alias(n) for n in names]
    numeric = lambda t: t.isin("phone", "card", "ssn")

    def split(x):
        domain = F.substring_index(x["m"], "@", -1)
        return F.struct(
            *keep(x, "m", "t", "c", "attempt"),
            draw(secret, x["t"], x["c"], x["attempt"]).alias("h"),
            F.when(x["t"] == "email", draw(secret, F.lit("domain"), F.lower(domain), F.lit(0))).alias("hd"),
            F.when(x["t"] == "email", F.substring_index(x["m"], "@", 1)).alias("local"),
            F.when(x["t"] == "email", F.substring_index(domain, ".", -1)).alias("top"),
            F.when(x["t"] == "email", F.regexp_replace(domain, r"\.[^.]*$", "")).alias("below"),
        )

    def digits(x):
        return F.struct(*keep(x, "m", "t", "c", "attempt", "h", "hd", "local", "top", "below"), F.when(numeric(x["t"]), drawn_digits(x["c"], x["h"])).alias("d"))

    def checked(x):
        return F.struct(*keep(x, "m", "t", "c", "attempt", "h", "hd", "local", "top", "below"), F.when(numeric(x["t"]), checked_digits(x["t"], x["c"], x["d"])).alias("d"))

    def written_out(x):
        m, t, h = x["m"], x["t"], x["h"]
        # a local part too short for all addresses to differ grows after some attempts
        more = F.when(x["attempt"] >= 8, F.substring(h, -8, 8)).otherwise("")
        email = F.concat(letters_and_digits(x["local"], h), more, F.lit("@"), letters_and_digits(x["below"], x["hd"]), F.lit("."), x["top"])
        octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (number(h, i, 254) + 1).cast("string")), ".")
        plain = F.concat(F.substring(x["c"], 1, 2), letters_and_digits(F.substring(x["c"], F.lit(3), F.length(x["c"])), h))
        iban = F.when(m.contains(" "), F.trim(F.regexp_replace(plain, "(.{4})", "$1 "))).otherwise(plain)
        return (
            F.when(t == "email", email).when(t == "ip", octets).when(t == "iban", iban).when(t == "name", new_name(m, h, x["attempt"], secret)).otherwise(in_layout(m, x["d"]))
        )

    return F.transform(F.transform(F.transform(F.transform(entities, split), digits), checked), written_out)


def mentions(text: Column) -> Column:
    """The entities of a text in order, as (m, t, c)."""
    found = F.when(text.rlike(HINT) | text.rlike(NAME_HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    typed = F.transform(found, lambda m: F.struct(m.alias("m"), kind(m).alias("t")))
    full = F.transform(typed, lambda x: F.struct(x["m"].alias("m"), x["t"].alias("t"), canonical(x["m"], x["t"]).alias("c")))
    return F.coalesce(full, F.array().cast("array<struct<m:string,t:string,c:string>>"))


def attempts(entities: DataFrame, secret: str) -> DataFrame:
    """t, c, attempt of the entities whose first draw is not theirs to keep."""
    drawn = entities.withColumn("attempt", F.lit(0))
    parts = partitions(entities.sparkSession)
    while True:
        one = F.array(F.struct(F.col("c").alias("m"), "t", "c", "attempt"))
        drawn = drawn.repartition(parts, "t", "c").withColumn("new", F.element_at(surrogates(one, secret), 1))
        drawn = drawn.select("t", "c", "attempt", F.lower(canonical(F.col("new"), F.col("t"))).alias("s"))
        drawn = written(drawn, "drawn")
        first = drawn.groupBy("t", "s").agg(F.min("c").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "s", "first")
        known = entities.select("t", F.lower("c").alias("s")).distinct().withColumn("known", F.lit(True))
        tried = drawn.join(first, ["t", "s"], "left").join(known, ["t", "s"], "left")
        again = (F.col("first").isNotNull() & (F.col("first") != F.col("c"))) | F.col("known").isNotNull()
        tried = written(tried.select("t", "c", "attempt", again.alias("again")), "tried")
        erased(drawn)
        if tried.where("again").isEmpty():
            return tried.where("attempt > 0").select("t", "c", "attempt")
        drawn = tried.select("t", "c", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def pseudonymise(docs: DataFrame, secret: str) -> DataFrame:
    """doc_id, text with surrogates, and the number of entities of each type of every row."""
    rows = written(docs.select("doc_id", "text", row_key().alias(ROW[0]), row_check().alias(ROW[1])).withColumn("found", mentions(F.col("text"))), "found")
    some = rows.where(F.size("found") > 0)
    entities = written(some.select(F.explode("found").alias("e")).select("e.t", "e.c").distinct(), "entities")
    anew = attempts(entities, secret)
    none = F.create_map().cast("map<int,int>")
    if anew.isEmpty():
        rows = rows.withColumn("drawn", none)
    else:
        at = some.select(*ROW, F.posexplode("found").alias("i", "e")).select(*ROW, "i", "e.t", "e.c").distinct()
        told = at.join(anew, ["t", "c"]).groupBy(*ROW).agg(F.map_from_entries(F.collect_list(F.struct("i", "attempt"))).alias("drawn"))
        some = some.join(written(told, "told"), list(ROW), "left").withColumn("drawn", F.coalesce("drawn", none))
        rows = rows.where(F.size("found") == 0).withColumn("drawn", none).unionByName(some)
    attempt = lambda i: F.coalesce(F.try_element_at(F.col("drawn"), i), F.lit(0))
    full = F.transform("found", lambda e, i: F.struct(e["m"].alias("m"), e["t"].alias("t"), e["c"].alias("c"), attempt(i).alias("attempt")))
    # text is what stands between the entities, and they
    between = F.split(F.col("text"), ENTITY, -1)
    put = F.array_join(F.flatten(F.zip_with(between, surrogates(full, secret), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    new = F.when(F.size("found") > 0, put).otherwise(F.col("text"))
    of = F.transform("found", lambda e: e["t"])
    counts = [F.size(F.filter(of, partial(lambda t, x: x == t, F.lit(t)))).cast("long").alias(f"n_{t}") for t in TYPES]
    return rows.select("doc_id", new.alias("text"), *counts)
